"""Stateful and windowed stream operators with their batch twins."""
