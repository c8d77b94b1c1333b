"""Streaming forms of batch operators: an extension, there is no such thing to match."""
