"""CLI, REP-09..13 and WAT-05 queries: each command runs on a synthetic market; its exit code and the headings of its report are the rows."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import functions as F

from plumbline.config import SyntheticConfig
from plumbline.operators.models import available_models
from plumbline.queries.base import add
from plumbline.sources import ingest, synthetic
from plumbline.sources.scratch import new_folder

MARKET = ("--days", "620", "--train-size", "400", "--test-size", "100")


def spoken(spark, argv, fetch=None) -> list[str]:
    """The exit code and the lines that a command prints."""
    from plumbline.cli import main

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        code = main(list(argv), spark, fetch)
    return [f"exit {code}", *out.getvalue().splitlines()]


def headings(spark, argv, fetch=None):
    said = spoken(spark, argv, fetch)
    kept = [said[0], *(x for x in said[1:] if x.startswith("#") and x.lstrip("#").startswith(" "))]
    return spark.createDataFrame(list(enumerate(kept)), "position int, line string")


def _lines(*lines: str) -> str:
    return "select * from (values " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(lines)) + ") t(position, line)"


READ = ("## How to read this", "## Caveats")


@add("cli_01_data", "select symbol, 300::bigint as bars from (values ('AAA'), ('BBB')) t(symbol)")
def data(spark, sf_dir):
    folder = new_folder(spark, "market")
    assert spoken(spark, ["data", "--days", "300", "--out", folder]) == ["exit 0"]
    return ingest.load_universe(spark, folder).groupBy("symbol").agg(F.count("*").alias("bars"))


@add("cli_02_backtest", _lines("exit 0", "# Backtest", "## Setup", "## Result", "## Equity", "## Folds", "## Parameters, chosen inside each fold", "### Choices", "## By volatility", "## Features", *READ))
def backtest(spark, sf_dir):
    return headings(spark, ["backtest", *MARKET, "--tune", "alpha=1,100", "--tune-metric", "rmse", "--tune-lower"])


@add("cli_03_compare", _lines("exit 0", "# Comparison", "## Setup", "## Ranking", "### AAA", "### BBB", "## Equity", "## All figures", *READ))
def compare(spark, sf_dir):
    return headings(spark, ["compare", *MARKET, "--models", "zero,momentum,ridge", "--sort-by", "excess_sharpe"])


@add("cli_04_simulate", _lines("exit 0", "# Simulation", "## Setup", "## Permutation test", "## Bootstrap", "## Paths ahead", "## Caveats"))
def simulate(spark, sf_dir):
    return headings(spark, ["simulate", *MARKET, "--model", "momentum", "--null-method", "shuffle", "--sim-horizon", "60"])


@add("cli_05_screen", _lines("exit 0", "# Screen", "## Setup", "## Ranking", "## Survivors", "## Held together", "## Caveats"))
def screen(spark, sf_dir):
    return headings(spark, ["screen", *MARKET, "--model", "momentum", "--efficient", "--alpha", "0.0001"])


@add("cli_06_journal", _lines("exit 0", "# Forecast journal", "## Data", "## Live", "### By symbol", "## Against always long", "## In flight"))
def journal(spark, sf_dir):
    return headings(spark, ["journal", *MARKET, "--journal", new_folder(spark, "journal"), "--asof", "2012-05-21", "--no-compare", "--fail-if-stale", "30"])


@add("cli_07_watch", _lines("exit 0", "# Market watch", "## Out of the ordinary", "## Latest session", "## Range and volatility", "## How unusual", "## Overnight"))
def watch(spark, sf_dir):
    return headings(spark, ["watch", "--days", "400"])


@add("cli_08_models", _lines("exit 0", *available_models()))
def models(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(spoken(spark, ["models"]))), "position int, line string")


@add("cli_10_daily_loop", "select * from (values ('first day', 'exit 4', 1), ('same day again', 'exit 0', 1)) t(run, outcome, forecasts)")
def daily(spark, sf_dir):
    """One ticker arrives, one does not: the forecast is recorded, the failure is told by the exit code; the next run adds nothing."""
    market = synthetic.generate_ohlcv(spark, SyntheticConfig(n_days=620), ("AAA",))

    def fetch(ticker):
        if ticker != "AAA":
            raise ConnectionError(ticker)
        return market.drop("symbol")

    book, cache, out = new_folder(spark, "journal"), new_folder(spark, "cache"), []
    for run, tickers in (("first day", "AAA,GONE"), ("same day again", "AAA")):
        said = spoken(spark, ["daily", "--tickers", tickers, "--cache-dir", cache, "--journal", book, *MARKET, "--asof", "2012-05-18", "--no-compare", "--fail-if-stale", "30", "--quiet"], fetch)
        out.append((run, said[0], spark.read.parquet(book).count()))
    return spark.createDataFrame(out, "run string, outcome string, forecasts int")
