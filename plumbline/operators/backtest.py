"""From signals to lagged, cost-aware positions and equity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import BacktestConfig
from plumbline.functions.core import PERIODS_PER_YEAR, by_symbol, full, melt, running, safe_divide, trailing


def simple_return(close: str = "close") -> Column:
    """c / previous c - 1; 0 on the first bar."""
    return F.coalesce(safe_divide(F.col(close), F.lag(close).over(by_symbol())) - 1, F.lit(0.0))


def trailing_volatility(returns: str = "asset_return", lookback: int = 20) -> Column:
    return full(F.stddev_samp(returns), returns, lookback, trailing(lookback)) * PERIODS_PER_YEAR**0.5


def target_position(signal: str | Column, config: BacktestConfig, volatility: str | Column | None = None) -> Column:
    """Position wanted for a signal: 0 in the dead band and where it is unknown; scaled to the volatility target last."""
    s = F.col(signal) if isinstance(signal, str) else signal
    top = float(config.max_leverage)
    if config.sizing == "sign":
        want = F.signum(s) * top
    elif config.sizing == "long_only":
        want = F.when(s > config.threshold, top).otherwise(0.0)
    else:
        want = F.least(F.greatest(s * config.scale, F.lit(-top)), F.lit(top))
    want = F.when(F.abs(s) <= config.threshold, 0.0).otherwise(want)
    if not config.allow_short:
        want = F.greatest(want, F.lit(0.0))
    if config.vol_target is not None:
        if volatility is None:
            raise ValueError("a volatility target needs a volatility column")
        v = F.col(volatility) if isinstance(volatility, str) else volatility
        want = F.least(F.greatest(want * F.coalesce(F.when(v > 0, config.vol_target / F.when(v > 0, v)), F.lit(0.0)), F.lit(-top)), F.lit(top))
    return F.coalesce(want, F.lit(0.0))


def run_backtest(signals: DataFrame, config: BacktestConfig | None = None) -> DataFrame:
    """symbol, date, close, signal -> one row a bar: positions trade a bar after their signal, and pay for what they trade."""
    c = config or BacktestConfig()
    w = by_symbol()
    rate = c.total_cost_bps * 1e-4
    out = signals.withColumn("asset_return", simple_return())
    vol = None
    if c.vol_target is not None:
        out = out.withColumn("__vol", trailing_volatility("asset_return", c.vol_lookback))
        vol = "__vol"
    out = out.withColumn("__target", target_position(F.coalesce("signal", F.lit(0.0)), c, vol))
    out = out.withColumn("position", F.coalesce(F.lag("__target").over(w), F.lit(0.0)))
    out = out.withColumn("trade", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))))
    out = out.withColumn("cost", F.col("trade") * rate).withColumn("gross_return", F.col("position") * F.col("asset_return"))
    out = out.withColumn("strategy_return", F.col("gross_return") - F.col("cost"))
    first = F.row_number().over(w) == 1
    out = out.withColumn("benchmark_return", F.when(first, F.col("asset_return") - rate).otherwise(F.col("asset_return")))
    grow = running()
    out = out.withColumn("equity", c.initial_equity * F.product(1 + F.col("strategy_return")).over(grow)).withColumn("benchmark_equity", c.initial_equity * F.product(1 + F.col("benchmark_return")).over(grow))
    return out.drop("__target", "__vol")


def align_signals(prices: DataFrame, signals: DataFrame) -> DataFrame:
    """symbol, date, close, signal on the dates that both sides have; a symbol with fewer than two raises."""
    both = prices.select("symbol", "date", "close").join(signals.select("symbol", "date", "signal"), ["symbol", "date"])
    n = F.count("*").over(Window.partitionBy("symbol"))
    few = F.raise_error(F.concat(F.col("symbol"), F.lit(": fewer than two bars of price and signal"))).cast("double")
    return both.withColumn("close", F.when(n < 2, few).otherwise(F.col("close")))


def summary(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Wide strategy_* and benchmark_* metrics -> metric, strategy, buy_and_hold."""
    names = sorted(c.removeprefix("strategy_") for c in metrics.columns if c.startswith("strategy_"))
    a = melt(metrics.select(*keys, *[F.col(f"strategy_{n}").alias(n) for n in names]), keys, names, "metric", "strategy")
    b = melt(metrics.select(*keys, *[F.col(f"benchmark_{n}").alias(n) for n in names]), keys, names, "metric", "buy_and_hold")
    return a.join(b, [*keys, "metric"], "full_outer")


def excess(strategy: str | Column, benchmark: str | Column) -> Column:
    return (F.col(strategy) if isinstance(strategy, str) else strategy) - (F.col(benchmark) if isinstance(benchmark, str) else benchmark)


