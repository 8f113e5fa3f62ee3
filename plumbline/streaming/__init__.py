"""Structured Streaming extension: bars from events, and a journal fed by micro-batches."""
