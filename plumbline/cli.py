"""Command line: data, backtest, compare, simulate, screen, journal, watch, daily, models.

Exit codes: 0 done, 2 wrong input, 3 the price data are stale, 4 a daily run could not fetch every ticker.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys
from collections.abc import Callable, Sequence
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import BacktestConfig, ExperimentConfig, FeatureConfig, SimulationConfig, SyntheticConfig, TuningConfig, WalkForwardConfig
from plumbline.operators import features as fea
from plumbline.operators import journal as jr
from plumbline.operators import portfolio as pf
from plumbline.operators import reporting as rep
from plumbline.operators import simulation as sim
from plumbline.operators import walkforward as wf
from plumbline.operators import watch as wt
from plumbline.operators.models import available_models, factory_of
from plumbline.plans import studies
from plumbline.sources import ingest, synthetic

STALE, PARTIAL = 3, 4


def _group(c: argparse.ArgumentParser, title: str, *options: tuple) -> None:
    g = c.add_argument_group(title)
    for name, settings in options:
        g.add_argument(name, **settings)


def _number(default, help_: str, kind: type = float) -> dict:
    return {"type": kind, "default": default, "help": help_}


def _flag(help_: str) -> dict:
    return {"action": "store_true", "help": help_}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline", description="Honest forecasting research on daily price bars", epilog="Research tooling. Not investment advice.")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, study: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=help_)
        _group(
            c, "data",
            ("--data", {"nargs": "+", "help": "CSV files, or folders of them; a synthetic market without"}),
            ("--tickers", {"help": "symbols to fetch, comma-separated"}), ("--cache-dir", {"help": "where fetched bars are kept and looked for"}), ("--period", {"default": "12y", "help": "history to fetch"}),
            ("--days", _number(1200, "synthetic sessions", int)), ("--seed", _number(42, "synthetic seed", int)), ("--start", {"default": "2010-01-04", "help": "first synthetic session"}),
            ("--initial-price", _number(100.0, "synthetic starting price")), ("--ar1", _number(None, "synthetic autocorrelation")), ("--reversion", _number(None, "synthetic pull over five sessions")),
            ("--efficient", _flag("a synthetic market that nothing forecasts")),
        )
        _group(c, "output", ("--out", {"help": "folder for reports and tables"}), ("--quiet", _flag("print nothing")))
        if study:
            _group(c, "features", ("--horizon", _number(1, "sessions ahead", int)), ("--neutral-band", _number(0.0, "smaller moves have no direction")), ("--no-volume-features", _flag("leave volumes out")))
            _group(
                c, "walk-forward",
                ("--train-size", _number(750, "bars to train on", int)), ("--test-size", _number(125, "bars to test on", int)), ("--step", _number(None, "bars from fold to fold", int)),
                ("--rolling", _flag("a window of fixed length")), ("--embargo", _number(None, "bars between training and test", int)),
                ("--tune", {"action": "append", "metavar": "NAME=V,V", "help": "values of a parameter to choose from inside each fold"}), ("--tune-metric", {"default": "ic_pearson", "help": "metric that candidates are chosen by"}), ("--tune-lower", _flag("the lower metric wins")),
            )
            _group(
                c, "backtest",
                ("--sizing", {"choices": ("sign", "long_only", "proportional"), "default": "sign"}), ("--threshold", _number(0.0, "signals below it are flat")), ("--max-leverage", _number(1.0, "largest position")),
                ("--scale", _number(100.0, "position for a signal, if proportional")), ("--cost-bps", _number(1.0, "commission")), ("--slippage-bps", _number(1.0, "slippage")),
                ("--no-short", _flag("never short")), ("--vol-target", _number(None, "annual volatility to aim at")),
            )
        return c

    command("data", "write a synthetic market as CSV", False)
    command("backtest", "walk-forward one model and trade it").add_argument("--model", default="ridge")
    c = command("compare", "rank several models on the same folds")
    c.add_argument("--models", default="zero,train_mean,momentum,reversion,ridge")
    c.add_argument("--sort-by", default="sharpe")
    null = {"choices": ("rotation", "shuffle"), "default": "rotation"}
    c = command("simulate", "permutation test, bootstrap and paths")
    c.add_argument("--model", default="ridge")
    c.add_argument("--paths", **_number(200, "paths ahead", int))
    c.add_argument("--sim-horizon", **_number(252, "sessions ahead", int))
    c.add_argument("--sim-method", choices=("block_bootstrap", "iid_bootstrap", "gaussian"), default="block_bootstrap")
    c.add_argument("--block-size", **_number(20, "sessions in a block", int))
    c.add_argument("--permutations", **_number(200, "draws of the null", int))
    c.add_argument("--null-method", **null)
    c.add_argument("--sim-seed", **_number(7, "seed", int))
    c = command("screen", "all symbols with correction for multiple testing")
    c.add_argument("--model", default="ridge")
    c.add_argument("--permutations", **_number(100, "draws of the null for each symbol", int))
    c.add_argument("--alpha", **_number(0.05, "level after correction"))
    c.add_argument("--rank-by", default="excess_sharpe")
    c.add_argument("--null-method", **null)
    for name, help_ in (("journal", "record, append, score and compare forecasts"), ("daily", "fetch, record, score, check that the journal only grew, report")):
        c = command(name, help_)
        c.add_argument("--model", default="ridge")
        c.add_argument("--journal", required=True)
        c.add_argument("--asof", required=name == "journal", default=str(dt.date.today()), help="the day it is")
        c.add_argument("--min-train-rows", **_number(250, "labelled bars that a forecast needs", int))
        c.add_argument("--skip-record", **_flag("score only"))
        c.add_argument("--skip-score", **_flag("record only"))
        c.add_argument("--no-compare", **_flag("no walk-forward to compare with"))
        c.add_argument("--rolling-window", **_number(30, "forecasts in a window over time", int))
        c.add_argument("--fail-if-stale", **_number(None, "days after which data are stale; without it the sessions missed decide", int))
        if name == "daily":
            c.add_argument("--skip-fetch", **_flag("use the bars that are there"))
            c.add_argument("--dry-run", **_flag("write no forecast"))
    c = command("watch", "the latest session against its history", False)
    c.add_argument("--notes")
    c.add_argument("--universe", help="tickers with their names as comments")
    sub.add_parser("models", help="list the models")
    return p


def synthetic_config(a: argparse.Namespace) -> SyntheticConfig:
    c = SyntheticConfig(n_days=a.days, seed=a.seed, start=a.start, initial_price=a.initial_price)
    c = replace(c, ar1=0.0, reversion=0.0) if a.efficient else c
    return replace(c, **{k: v for k in ("ar1", "reversion") if (v := getattr(a, k)) is not None})


def experiment(a: argparse.Namespace) -> ExperimentConfig:
    return ExperimentConfig(
        synthetic_config(a),
        FeatureConfig(horizon=a.horizon, neutral_band=a.neutral_band, include_volume_features=not a.no_volume_features),
        WalkForwardConfig(a.train_size, a.test_size, a.step, not a.rolling, a.embargo),
        BacktestConfig(a.sizing, a.threshold, a.max_leverage, a.scale, a.cost_bps, a.slippage_bps, not a.no_short, a.vol_target),
    )


def tuning(a: argparse.Namespace) -> TuningConfig:
    """--tune alpha=0.1,10 --tune kind=a,b"""
    grid = {}
    for item in a.tune or ():
        name, _, values = item.partition("=")
        if not name or not values:
            raise ValueError(f"--tune takes NAME=VALUE,VALUE, not {item!r}")
        grid[name] = tuple(_value(v) for v in values.split(","))
    return TuningConfig(grid=grid, metric=a.tune_metric, higher_is_better=not a.tune_lower)


def _value(text: str) -> int | float | str:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def bars_of(spark: SparkSession, a: argparse.Namespace, fetch: Callable[[str], DataFrame] | None = None) -> DataFrame:
    tickers = [t.strip() for t in (a.tickers or "").split(",") if t.strip()]
    if a.data or tickers:
        bars = ingest.load_universe(spark, a.data, tickers, fetch, a.cache_dir)
        return ingest.validate(ingest.clamp_extremes(ingest.drop_untraded(bars)))
    return synthetic.generate_ohlcv(spark, synthetic_config(a), ("AAA", "BBB"))


def emit(a: argparse.Namespace, name: str, text: str, frame: DataFrame | None = None) -> None:
    if not a.quiet:
        print(text)
    if a.out:
        Path(a.out).mkdir(parents=True, exist_ok=True)
        Path(a.out, f"{name}.md").write_text(text)
        if frame is not None:
            frame.write.mode("overwrite").option("header", True).csv(str(Path(a.out, name)))


def signals_of(preds: DataFrame) -> DataFrame:
    return wf.pooled(preds).select("symbol", "date", "close", "signal")


def setup(bars: DataFrame, c: ExperimentConfig, *more: str) -> list[str]:
    span = bars.agg(F.min("date"), F.max("date"), F.count("*")).first()
    return [*more, *rep.setup_lines(c, span[0], span[1], span[2])]


def run(a: argparse.Namespace, spark: SparkSession, fetch: Callable[[str], DataFrame] | None = None) -> int:
    if a.command == "models":
        print("\n".join(available_models()))
        return 0
    if a.command == "daily":
        return daily(a, spark, fetch)
    bars = bars_of(spark, a, fetch).cache()
    try:
        return _study(a, spark, bars)
    finally:
        bars.unpersist()


def _study(a: argparse.Namespace, spark: SparkSession, bars: DataFrame) -> int:
    if a.command == "data":
        if not a.out:
            raise ValueError("data needs --out")
        ingest.save_csv(bars, a.out)
        return 0
    if a.command == "watch":
        return watch(a, spark, bars)
    c = experiment(a)
    if a.command == "journal":
        return journal(a, c, spark, bars)
    names = a.models.split(",") if a.command == "compare" else [a.model]
    for name in names:
        factory_of(name.strip())  # an unknown name is told before anything is fitted
    if a.command == "compare":
        dataset = fea.build_dataset(bars, c.features, a.horizon)
        preds = studies.predictions(dataset, [n.strip() for n in names], c, fea.feature_names(c.features)).cache()
        ranking = studies.compare_models(preds, c, a.sort_by)
        emit(a, "comparison", rep.comparison_report(ranking, setup(bars, c, f"Models: {a.models}", f"Ranked by: {a.sort_by}"), studies.trade(preds, c.backtest)), ranking)
    elif a.command == "backtest":
        backtest(a, c, bars)
    elif a.command == "simulate":
        s = SimulationConfig(a.paths, a.sim_horizon, a.sim_method, a.block_size, a.permutations, a.sim_seed)
        signals = signals_of(studies.run_model(bars, a.model, c)).cache()
        parts = studies.simulate(signals, s, c.backtest, a.null_method)
        emit(a, "simulation", rep.simulation_report(parts["paths"], parts["null"], parts["bootstrap"], parts["draws"].where("perm > 0"), setup(bars, c, f"Model: {a.model}", f"Paths: {a.paths} of {a.sim_horizon} sessions, {a.sim_method}", f"Null: {a.permutations} draws by {a.null_method}")))
    elif a.command == "screen":
        preds = studies.run_model(bars, a.model, c).cache()
        result = studies.screen(signals_of(preds), None, c.backtest, SimulationConfig(n_permutations=a.permutations), a.rank_by, a.alpha, a.null_method).cache()
        returns = studies.trade(preds, c.backtest).select("symbol", "date", F.col("strategy_return").alias("ret"))
        n = studies.ranked(result).count()
        together = pf.portfolio_metrics(returns) if n > 1 else None
        emit(a, "screen", rep.screen_report(studies.screen_table(studies.ranked(result)), together, n, a.alpha, studies.failures(result), setup(bars, c, f"Model: {a.model}", f"Ranked by: {a.rank_by}")), result)
    return 0


def backtest(a: argparse.Namespace, c: ExperimentConfig, bars: DataFrame) -> None:
    grid = tuning(a)
    dataset, names = fea.build_dataset(bars, c.features, a.horizon), fea.feature_names(c.features)
    folds = wf.folds_of(dataset, c.walk_forward, a.horizon)
    if grid.enabled:
        preds, records = wf.tuned_predictions(dataset, folds, a.model, names, grid, c.walk_forward.resolved_embargo(a.horizon))
        records = records.cache()
    else:
        preds, records = studies.predictions(dataset, [a.model], c, names), None
    preds = preds.cache()
    rows = studies.trade(preds, c.backtest)
    importance = None if a.model in studies.BASELINES else wf.importance_stability(wf.importances(dataset, folds, a.model, names))
    regimes = wf.regime_metrics(preds, wf.trailing_volatility(bars)).select("symbol", "regime", "n", "ic_pearson", "directional_accuracy", "realised_vol_mean")
    emit(a, "backtest", rep.backtest_report(studies.run_metrics(preds, c), wf.fold_metrics(preds), rows, setup(bars, c, f"Model: {a.model}"), records, regimes, importance), rows)
    preds.unpersist()


def watch(a: argparse.Namespace, spark: SparkSession, bars: DataFrame) -> int:
    shots = wt.snapshot(bars).cache()
    notes = ingest.load_notes(spark.read.option("header", True).csv(a.notes)) if a.notes else None
    names = {r["ticker"]: r["name"] for r in ingest.symbol_names(spark.read.text(a.universe)).collect()} if a.universe else None
    emit(a, "watch", rep.watch_report(shots, wt.flags(shots), wt.overnight_links(bars, bars), wt.note_followups(notes, bars) if notes is not None else None, names))
    shots.unpersist()
    return 0


def journal(a: argparse.Namespace, c: ExperimentConfig, spark: SparkSession, bars: DataFrame) -> int:
    fresh = jr.data_freshness(bars, a.asof).cache()
    names = fea.feature_names(c.features)
    before = jr.load_journal(spark, a.journal).cache()
    n_before = before.count()
    if not a.skip_record and not getattr(a, "dry_run", False):
        eligible = bars.join(jr.outcome_begun(bars, f"{a.asof} 00:00:00"), "symbol", "left_anti")
        rows = fea.build_features(eligible, c.features)
        last = rows.join(eligible.groupBy("symbol").agg(F.max("date").alias("date")), ["symbol", "date"], "left_semi")
        made = jr.record(fea.build_dataset(eligible, c.features, a.horizon), last, a.model, names, a.horizon, eligible, c.backtest, a.min_train_rows)
        jr.save_journal(made.join(before.select(*jr.KEY), list(jr.KEY), "left_anti"), a.journal)
    book = jr.load_journal(spark, a.journal)
    if not jr.is_append_only(before, book):
        raise ValueError("the journal lost or changed rows")
    added = book.count() - n_before
    if not a.skip_score:
        scored = jr.score(book, bars, c.backtest.total_cost_bps).cache()
        calendar, compared, rolling = jr.trading_calendar(bars), None, None
        if not a.no_compare:
            claim = wf.walk_forward_metrics(studies.run_model(bars, a.model, c), a.horizon).agg(F.avg("directional_accuracy"), F.avg("ic_fold_mean")).first()
            compared = jr.compare_with_backtest(scored, calendar, claim[0] or 0.0, claim[1] or 0.0)
            rolling = jr.rolling_compare(scored, calendar, claim[0] or 0.0, claim[1] or 0.0, a.rolling_window)
        shown, left = jr.in_flight(jr.pending_rows(scored))
        text = rep.journal_report(jr.live_metrics(scored), compared, jr.compare_with_always_long(scored, calendar), fresh, shown, jr.by_symbol(jr.scored_rows(scored)), rolling, left.first()[0])
        emit(a, "journal", text + f"\n{added} forecasts added.\n")
        scored.unpersist()
    late = jr.stale_symbols(fresh, a.fail_if_stale) if a.fail_if_stale is not None else fresh.where("stale")
    return STALE if late.count() else 0


def daily(a: argparse.Namespace, spark: SparkSession, fetch: Callable[[str], DataFrame] | None) -> int:
    """Fetch into the cache, record and score, check that the journal only grew; what could not be fetched is told after the report, so that it costs no forecast."""
    tickers, failed = [t.strip() for t in (a.tickers or "").split(",") if t.strip()], {}
    if tickers and not a.skip_fetch:
        if fetch is None:
            raise ValueError("nothing fetches the tickers; use --skip-fetch with --cache-dir")
        for t in tickers:
            try:
                ingest.load_universe(spark, None, [t], lambda x: ingest.fetch_with_retry(fetch, x), a.cache_dir)
            except Exception as e:  # a vendor may fail in any way; the others go on
                failed[t] = str(e)
    a.tickers = ",".join(t for t in tickers if t not in failed)
    bars = bars_of(spark, a, fetch).cache()
    status = journal(a, experiment(a), spark, bars)
    bars.unpersist()
    for t, why in failed.items():
        print(f"not fetched: {t}: {why}", file=sys.stderr)
    return status or (PARTIAL if failed else 0)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, fetch: Callable[[str], DataFrame] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return run(a, spark or SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").getOrCreate(), fetch)
    except (ValueError, FileNotFoundError, TypeError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
