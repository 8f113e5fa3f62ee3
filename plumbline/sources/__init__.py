"""Scans, adapters, ingest-time cleaning, sessions and the synthetic market."""
