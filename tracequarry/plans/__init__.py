"""Composed queries: derived views, corpus rollups, the check runner."""
