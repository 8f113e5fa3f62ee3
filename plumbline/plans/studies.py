"""Multi-operator queries. Everything is keyed by symbol; nothing loops over symbols."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import BacktestConfig, ExperimentConfig, SimulationConfig

from plumbline.operators import backtest as bt
from plumbline.operators import features as fea
from plumbline.operators import metrics as m
from plumbline.operators import simulation as sim
from plumbline.operators import walkforward as wf
from plumbline.sources.scratch import kept

BASELINES = ("zero", "train_mean", "momentum", "reversion")


def predictions(dataset: DataFrame, models: Sequence[str], config: ExperimentConfig, features: Sequence[str]) -> DataFrame:
    """Predictions of several models over the same folds of one data set."""
    folds = wf.folds_of(dataset, config.walk_forward, config.features.horizon)
    out = None
    plain = [n for n in models if n in BASELINES]
    if plain:
        out = wf.baseline_predictions(dataset, folds).where(F.col("model").isin(plain))
    for name in models:
        if name not in BASELINES:
            one = wf.fit_predict(dataset, folds, name, features).select(*wf.KEYS, "fold", "date", "pos", "signal", "forward_return", "direction", "close")
            out = one if out is None else out.unionByName(one)
    return out


def trade(preds: DataFrame, config: BacktestConfig) -> DataFrame:
    """One backtest for each (symbol, model); the pair is the key of every window."""
    pooled = wf.pooled(preds).withColumn("pair", F.concat_ws("\u001f", "symbol", "model"))
    rows = bt.run_backtest(pooled.select(F.col("pair").alias("symbol"), "date", "close", "signal"), config)
    parts = F.split("symbol", "\u001f")
    return rows.withColumn("model", parts[1]).withColumn("symbol", parts[0])


def run_metrics(preds: DataFrame, config: ExperimentConfig) -> DataFrame:
    """Predictive and financial metrics of each (symbol, model) with benchmark and excess Sharpe ratio."""
    preds = kept(preds, "predictions")  # fits run once, three groups of metrics read them
    rows = trade(preds, config.backtest)
    strategy = m.financial_metrics(rows, "strategy_return", "equity", "position", wf.KEYS)
    benchmark = m.financial_metrics(rows, "benchmark_return", "benchmark_equity", None, wf.KEYS).select(*wf.KEYS, F.col("sharpe").alias("benchmark_sharpe"), F.col("total_return").alias("benchmark_return"))
    forecast = wf.walk_forward_metrics(preds, config.features.horizon).drop("n")
    return strategy.join(benchmark, list(wf.KEYS)).join(forecast, list(wf.KEYS)).withColumn("excess_sharpe", F.col("sharpe") - F.col("benchmark_sharpe"))


def run_model(bars: DataFrame, model: str, config: ExperimentConfig | None = None) -> DataFrame:
    c = config or ExperimentConfig()
    dataset = kept(fea.build_dataset(bars, c.features, c.features.horizon), "dataset")
    return predictions(dataset, [model], c, fea.feature_names(c.features))


def compare_models(preds: DataFrame, config: ExperimentConfig, sort_by: str = "sharpe") -> DataFrame:
    """Metrics ranked within each symbol; what has no value comes last."""
    out = run_metrics(preds, config)
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc_nulls_last(sort_by), "model"))
    return out.withColumn("rank", rank)


def screen(signals: DataFrame, shifts: Sequence[int] | None = None, config: BacktestConfig | None = None, simulation: SimulationConfig | None = None, rank_by: str = "excess_sharpe", alpha: float = 0.05, method: str = "rotation") -> DataFrame:
    """One row a symbol: metrics, permutation p-value, q-value over all symbols, rank. symbol, date, close, signal in; symbols too short for a test have an error and come last."""
    c = config or BacktestConfig()
    sizes = signals.groupBy("symbol").agg(F.count("*").alias("n_bars"))
    fine = signals.join(sizes.where("n_bars >= 10").select("symbol"), "symbol", "left_semi")
    rows = bt.run_backtest(fine, c)
    a = m.financial_metrics(rows, "strategy_return", "equity", "position")
    b = m.financial_metrics(rows, "benchmark_return", "benchmark_equity").select("symbol", F.col("sharpe").alias("benchmark_sharpe"))
    tested = a.join(b, "symbol").withColumn("excess_sharpe", F.col("sharpe") - F.col("benchmark_sharpe"))
    p = sim.significance(sim.null_distribution(fine, shifts, c, simulation, method)).select("symbol", "p_value")
    out = sizes.join(tested, "symbol", "left").join(p, "symbol", "left")
    out = m.benjamini_hochberg(out).withColumn("error", F.when(F.col("n_bars") < 10, "too few bars"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("error").isNotNull(), F.desc_nulls_last(rank_by), "symbol"))
    return out.withColumn("rank", rank)


def survivors(screened: DataFrame, alpha: float = 0.05) -> DataFrame:
    return screened.where((F.col("excess_sharpe") > 0) & (F.col("q_value") <= alpha))


def ranked(screened: DataFrame) -> DataFrame:
    return screened.where("error is null").orderBy("rank")


def failures(screened: DataFrame) -> DataFrame:
    return screened.where("error is not null")


TABLE = ("symbol", "rank", "n_bars", "sharpe", "benchmark_sharpe", "excess_sharpe", "annualised_return", "max_drawdown", "hit_rate", "annual_turnover", "p_value", "q_value")


def screen_table(screened: DataFrame) -> DataFrame:
    return screened.select(*TABLE)


def simulate(signals: DataFrame, simulation: SimulationConfig | None = None, config: BacktestConfig | None = None, method: str = "rotation") -> dict[str, DataFrame]:
    """Paths, permutation test (draws and their summary) and bootstrap of the same strategy returns."""
    s = simulation or SimulationConfig()
    returns = bt.run_backtest(signals, config).select("symbol", "date", F.col("strategy_return").alias("ret"))
    draws = sim.null_distribution(signals, None, config, s, method)
    return {
        "paths": sim.path_summary(sim.price_paths(sim.sample_returns(returns, s)), horizon=s.horizon_days, quantiles=s.quantiles),
        "draws": draws,
        "null": sim.significance(draws),
        "bootstrap": sim.bootstrap_summary(sim.bootstrap(returns, s), returns),
    }
