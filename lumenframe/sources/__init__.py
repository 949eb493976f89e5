"""Readers, keyed tables and writers."""
