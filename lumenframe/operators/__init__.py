"""Relational operators of the retrieval algebra."""
