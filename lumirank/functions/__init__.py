"""Column functions: vectors, records, texts, pixels."""
