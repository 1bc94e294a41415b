"""Incremental forms of the batch loads."""
