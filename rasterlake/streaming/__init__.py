"""Structured Streaming forms of operators that need no order between rows."""
