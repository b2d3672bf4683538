"""Readers of session logs, indexes and snapshots."""
