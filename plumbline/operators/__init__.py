"""Relational and statistical operators over long tables keyed by symbol."""
