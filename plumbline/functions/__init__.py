"""Column builders: null-safe arithmetic, rolling windows, indicators, statistics."""
