"""Column-level building blocks (time arithmetic, parsing, formatting, decoding)."""
