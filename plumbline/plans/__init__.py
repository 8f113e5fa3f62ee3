"""Whole studies as one plan: run, compare, screen, simulate."""
