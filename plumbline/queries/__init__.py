"""The registered queries of the price-bar engine, each with its SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("functions", "indicators", "ingest", "backtest", "walkforward", "portfolio", "journal", "watch", "simulation", "reports", "pipelines", "commands")


def collect() -> tuple[dict, dict]:
    """(name -> callable, name -> SQL)."""
    from plumbline.queries.base import ORACLES, QUERIES

    for m in MODULES:
        import_module(f"plumbline.queries.{m}")
    return QUERIES, ORACLES
