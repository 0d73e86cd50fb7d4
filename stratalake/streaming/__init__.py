"""Streams beside the batch engine."""
