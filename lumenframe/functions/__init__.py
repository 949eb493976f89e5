"""Column functions: vectors, text, geometry, hashes."""
