"""Streaming variants of the signal operators."""
