"""Streaming variants of the operators whose state is associative per key."""
