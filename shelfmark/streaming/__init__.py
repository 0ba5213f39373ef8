"""Structured Streaming forms of the operators. They extend the batch operators; the catalogue itself is a batch table."""
