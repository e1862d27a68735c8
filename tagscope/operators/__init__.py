"""Tag-history operators: filters, as-of lookups, resampling, aggregates, events."""
