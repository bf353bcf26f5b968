"""Chunking operators: one document row in, its chunk rows out, no shuffle."""
