"""Query plans: the registered query catalog, request dispatch and templates."""
