"""Resampling: path simulation, permutation nulls, bootstraps.

Draws come from hashes of (seed, path, block), so that a query gives the same rows on any
cluster and in any order; NumPy's generators are not used. Rotations are
pure arithmetic on positions and can be exhaustive or a fixed list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import BacktestConfig, SimulationConfig

from plumbline.operators import metrics as m
from plumbline.operators.backtest import simple_return, target_position, trailing_volatility


def positioned(returns: DataFrame) -> DataFrame:
    """Cleaned returns with pos (from 0) and n by symbol; fewer than two raise."""
    rows = returns.where(F.col("ret").isNotNull() & ~F.isnan("ret"))
    w = Window.partitionBy("symbol")
    out = rows.withColumn("pos", F.row_number().over(w.orderBy("date")) - 1).withColumn("n", F.count("*").over(w))
    return out.withColumn("n", F.when(F.col("n") < 2, F.raise_error(F.lit("at least two returns are needed")).cast("bigint")).otherwise(F.col("n")))


def _draw(*parts: Column | str) -> Column:
    """The text of an MD5 hash of (seed, symbol, ...): the same in any engine."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts]).cast("binary"))


def _uniform(*parts: Column | str) -> Column:
    """Uniform draw in [0, 1): 52 bits of the hash."""
    return F.conv(F.substring(_draw(*parts), 1, 13), 16, 10).cast("bigint").cast("double") / float(1 << 52)


def sample_returns(returns: DataFrame, config: SimulationConfig | None = None, horizon: int | None = None) -> DataFrame:
    """symbol, path, step, ret: circular blocks, single draws, or normal draws with the sample's mean and deviation. A horizon of 0 means the length of each symbol's own sample."""
    c = config or SimulationConfig()
    rows = positioned(returns)
    size = rows.groupBy("symbol").agg(F.max("n").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"))
    size = size.withColumn("h", (F.col("n") if horizon == 0 else F.lit(horizon or c.horizon_days)).cast("bigint"))
    grid, zero = size.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(c.n_paths - 1)))), F.lit(0).cast("bigint")
    seed = F.lit(c.seed or 0)
    if c.method == "gaussian":
        grid = grid.withColumn("step", F.explode(F.sequence(zero, F.col("h") - 1)))
        u, v = _uniform(seed, "symbol", "path", "step", F.lit(1)), _uniform(seed, "symbol", "path", "step", F.lit(2))
        normal = F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-300)))) * F.cos(2 * 3.141592653589793 * v)
        return grid.select("symbol", "path", "step", (F.col("mean") + F.col("sd") * normal).alias("ret"))
    # one draw for each block; its steps follow
    grid = grid.withColumn("size", F.lit(1).cast("bigint") if c.method == "iid_bootstrap" else F.least(F.lit(c.block_size).cast("bigint"), "n"))
    grid = grid.withColumn("block", F.explode(F.sequence(zero, F.floor((F.col("h") - 1) / F.col("size")))))
    grid = grid.withColumn("start", F.floor(_uniform(seed, "symbol", "path", "block") * F.col("n"))).withColumn("i", F.explode(F.sequence(zero, F.col("size") - 1)))
    grid = grid.withColumn("step", F.col("block") * F.col("size") + F.col("i")).where("step < h")
    drawn = grid.select("symbol", "path", "step", F.pmod(F.col("start") + F.col("i"), F.col("n")).cast("int").alias("pos"))
    return drawn.join(rows.select("symbol", "pos", "ret"), ["symbol", "pos"]).select("symbol", "path", "step", "ret")


def price_paths(drawn: DataFrame, initial_value: float = 1.0) -> DataFrame:
    """symbol, path, terminal, max_drawdown of sampled returns."""
    w = Window.partitionBy("symbol", "path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = drawn.withColumn("value", initial_value * F.greatest(F.product(1 + F.col("ret")).over(w), F.lit(0.0)))
    rows = rows.withColumn("peak", F.max("value").over(w)).withColumn("dd", F.when(F.col("peak") > 0, F.col("value") / F.when(F.col("peak") > 0, F.col("peak")) - 1).otherwise(-1.0))
    return rows.groupBy("symbol", "path").agg(F.max_by("value", "step").alias("terminal"), F.min("dd").alias("max_drawdown"))


def path_summary(paths: DataFrame, initial_value: float = 1.0, horizon: int = 252, quantiles: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    r = paths.withColumn("r", F.col("terminal") / initial_value - 1).withColumn("__var", F.percentile("r", 0.05).over(Window.partitionBy("symbol")))
    tail = F.when(F.col("r") <= F.col("__var"), F.col("r"))
    aggs = [F.count("*").cast("double").alias("n_paths"), F.lit(float(horizon)).alias("horizon_days"), F.median("terminal").alias("median_terminal_value"), F.avg("r").alias("mean_terminal_return"), F.median("r").alias("median_terminal_return"), F.avg((F.col("terminal") < initial_value).cast("double")).alias("probability_of_loss"), F.max("__var").alias("value_at_risk_95"), F.coalesce(F.avg(tail), F.max("__var")).alias("conditional_value_at_risk_95"), F.median("max_drawdown").alias("median_max_drawdown"), F.min("max_drawdown").alias("worst_max_drawdown")]
    aggs += [F.percentile("r", q).alias(f"terminal_return_q{round(q * 100):02d}") for q in quantiles]
    return r.groupBy("symbol").agg(*aggs)


def drawdown_distribution(drawn: DataFrame) -> DataFrame:
    return price_paths(drawn).select("symbol", "path", "max_drawdown")


def statistic(name: str, ret: str = "ret") -> Column:
    """Aggregate by name: sharpe, total_return or annualised_return."""
    kinds = {"sharpe": lambda: m.sharpe(ret), "total_return": lambda: F.product(1 + F.col(ret)) - 1, "annualised_return": lambda: m.annualised_return(ret)}
    if name not in kinds:
        raise ValueError(f"unknown statistic {name!r}; there are {', '.join(kinds)}")
    return kinds[name]()


def net_return(asset: Column, position: Column, trade: Column, rate: float) -> Column:
    return position * asset - F.abs(trade) * rate


def null_distribution(signals: DataFrame, shifts: Sequence[int] | None = None, config: BacktestConfig | None = None, simulation: SimulationConfig | None = None, method: str = "rotation", name: str = "sharpe") -> DataFrame:
    """symbol, perm, value. perm 0 is the observed order. symbol, date, close, signal in.

    Each permutation runs the whole chain: sizing, one-bar lag, costs. Rotations are by a
    fixed list of shifts, or by seeded draws; shuffles sort by a seeded hash.
    """
    if method not in ("rotation", "shuffle"):
        raise ValueError("the method is rotation or shuffle")
    c, s = config or BacktestConfig(), simulation or SimulationConfig()
    w = Window.partitionBy("symbol")
    base = signals.withColumn("asset", simple_return()).withColumn("pos", F.row_number().over(w.orderBy("date")) - 1).withColumn("n", F.count("*").over(w))
    base = base.withColumn("n", F.when(F.col("n") < 10, F.raise_error(F.lit("at least ten bars are needed")).cast("bigint")).otherwise(F.col("n")))
    if c.vol_target is not None:
        base = base.withColumn("__vol", trailing_volatility("asset", c.vol_lookback))
    if shifts is not None:
        perms = F.explode(F.array(*[F.struct(F.lit(i).alias("perm"), F.lit(k).alias("shift")) for i, k in enumerate([0, *shifts])]))
        each = base.select("symbol", "pos", "n", F.coalesce("signal", F.lit(0.0)).alias("signal"), perms.alias("__p")).select("symbol", "pos", "n", "signal", "__p.perm", "__p.shift")
    else:
        each = base.select("symbol", "pos", "n", F.coalesce("signal", F.lit(0.0)).alias("signal"), F.explode(F.sequence(F.lit(0), F.lit(s.n_permutations))).alias("perm"))
        drawn = 1 + F.floor(_uniform(F.lit(s.seed or 0), "symbol", "perm") * (F.col("n") - 1))
        each = each.withColumn("shift", F.when(F.col("perm") == 0, F.lit(0)).otherwise(drawn))
    if method == "rotation":
        moved = each.select("symbol", "perm", F.pmod(F.col("pos") + F.col("shift"), F.col("n")).cast("int").alias("pos"), "signal")
    else:
        key = F.when(F.col("perm") > 0, _draw(F.lit(s.seed or 0), "symbol", "perm", "pos"))
        moved = each.select("symbol", "perm", (F.row_number().over(Window.partitionBy("symbol", "perm").orderBy(key, "pos")) - 1).alias("pos"), "signal")
    rows = moved.join(base.drop("signal", "n", "close", "date"), ["symbol", "pos"])
    by = Window.partitionBy("symbol", "perm").orderBy("pos")
    rows = rows.withColumn("__t", target_position("signal", c, "__vol" if c.vol_target is not None else None))
    rows = rows.withColumn("__pos", F.coalesce(F.lag("__t").over(by), F.lit(0.0)))
    rows = rows.withColumn("ret", net_return(F.col("asset"), F.col("__pos"), F.col("__pos") - F.coalesce(F.lag("__pos").over(by), F.lit(0.0)), c.total_cost_bps * 1e-4))
    return rows.groupBy("symbol", "perm").agg(statistic(name).alias("value"))


def significance(null: DataFrame) -> DataFrame:
    """Observed value, moments of the null, percentile and p-value of each symbol."""
    seen = null.where("perm = 0").select("symbol", F.col("value").alias("observed"))
    rest = null.where("perm > 0 and value is not null").join(seen, "symbol")
    out = rest.groupBy("symbol").agg(F.max("observed").alias("observed"), F.avg("value").alias("null_mean"), F.stddev_samp("value").alias("null_std"), F.percentile("value", 0.95).alias("null_q95"), (100 * F.avg((F.col("value") <= F.col("observed")).cast("double"))).alias("percentile_of_observed"), ((1 + F.sum((F.col("value") >= F.col("observed")).cast("double"))) / (1 + F.count("*"))).alias("p_value"), F.count("*").cast("double").alias("n_permutations"))
    return seen.select("symbol").join(out, "symbol", "left")


def bootstrap(returns: DataFrame, config: SimulationConfig | None = None, name: str = "sharpe") -> DataFrame:
    """symbol, path, value over samples as long as the history itself."""
    return sample_returns(returns, config, 0).groupBy("symbol", "path").agg(statistic(name).alias("value"))


def bootstrap_summary(samples: DataFrame, returns: DataFrame, name: str = "sharpe", confidence: float = 0.9) -> DataFrame:
    if not 0 < confidence < 1:
        raise ValueError("confidence lies between 0 and 1")
    a = (1 - confidence) / 2
    point = returns.where("ret is not null").groupBy("symbol").agg(statistic(name).alias("point_estimate"))
    agg = samples.where("value is not null").groupBy("symbol").agg(F.avg("value").alias("bootstrap_mean"), F.percentile("value", a).alias("ci_low"), F.percentile("value", 1 - a).alias("ci_high"), F.lit(confidence).alias("confidence"), F.avg((F.col("value") > 0).cast("double")).alias("fraction_above_zero"))
    return point.join(agg, "symbol", "left")


