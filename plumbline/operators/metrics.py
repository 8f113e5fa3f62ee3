"""Metrics as built-in aggregates. What has no value (too few rows, no spread) is NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.core import EPS, PERIODS_PER_YEAR, average_rank, col, guarded_corr, normal_cdf, normal_ppf, safe_divide


def annualised_return(r: str, ppy: float = PERIODS_PER_YEAR) -> Column:
    growth, n = F.product(1 + F.col(r)), F.count(r)
    return F.when(n == 0, None).when(growth <= 0, -1.0).otherwise(F.pow(F.when(growth > 0, growth), safe_divide(F.lit(float(ppy)), n)) - 1)


def annualised_volatility(r: str, ppy: float = PERIODS_PER_YEAR) -> Column:
    return F.when(F.count(r) >= 2, F.stddev_samp(r) * ppy**0.5)


def sharpe(r: str | Column, ppy: float | Column = PERIODS_PER_YEAR, risk_free: float = 0.0) -> Column:
    x = col(r) - risk_free / ppy
    root = F.sqrt(ppy) if isinstance(ppy, Column) else F.lit(ppy**0.5)
    return F.when((F.count(x) >= 2) & (F.stddev_samp(x) >= EPS), F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0)) * root)


def sortino(r: str, ppy: float = PERIODS_PER_YEAR, risk_free: float = 0.0) -> Column:
    x = F.col(r) - risk_free / ppy
    down = F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), 2)))
    return F.when((F.count(x) >= 2) & (down >= EPS), F.avg(x) / F.nullif(down, F.lit(0.0)) * ppy**0.5)


def drawdown(equity: str, keys: Sequence[str] = ("symbol",), order: str = "date") -> Column:
    peak = F.max(equity).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return safe_divide(equity, peak) - 1


def probabilistic_sharpe(r: str, benchmark: float | Column = 0.0, ppy: float = PERIODS_PER_YEAR) -> Column:
    """Probability that the true Sharpe ratio exceeds an annual benchmark; raw moments are those of the population."""
    x = F.col(r)
    n, sd, pop = F.count(x), F.stddev_samp(x), F.stddev_pop(x)
    s = F.avg(x) / F.nullif(sd, F.lit(0.0))
    skew, kurt = F.skewness(x), F.kurtosis(x) + 3
    inside = 1 - skew * s + (kurt - 1) / 4 * s * s
    z = (s - benchmark / ppy**0.5) * F.sqrt(n - 1) / F.sqrt(F.when(inside > 0, inside))
    return F.when((n >= 8) & (sd >= EPS) & (pop > 0), normal_cdf(z))


GAMMA = 0.5772156649015329


def expected_max_sharpe(trials: str | Column, deviation: str | Column) -> Column:
    n, s = col(trials).cast("double"), col(deviation)
    many = F.when(n > 1, n)
    value = s * ((1 - GAMMA) * normal_ppf(1 - 1 / many) + GAMMA * normal_ppf(1 - 1 / (many * 2.718281828459045)))
    return F.when((n <= 1) | (s < EPS), 0.0).otherwise(value)


def financial_metrics(rows: DataFrame, ret: str, equity: str, position: str | None = None, keys: Sequence[str] = ("symbol",), order: str = "date", ppy: float = PERIODS_PER_YEAR) -> DataFrame:
    """One row for each key: 11 metrics of a return series, and 3 more of its positions."""
    w = Window.partitionBy(*keys).orderBy(order)
    data = rows.where(F.col(ret).isNotNull()).withColumn("__dd", drawdown(equity, keys, order))
    if position:
        p = F.coalesce(F.col(position), F.lit(0.0))
        data = data.withColumn("__p", p).withColumn("__turn", F.abs(F.col("__p") - F.coalesce(F.lag("__p").over(w), F.lit(0.0))))
    r = F.col(ret)
    loss = F.coalesce(-F.sum(F.when(r < 0, r)), F.lit(0.0))
    aggs = [
        F.count(ret).cast("double").alias("n_periods"),
        (F.product(1 + r) - 1).alias("total_return"),
        annualised_return(ret, ppy).alias("annualised_return"),
        annualised_volatility(ret, ppy).alias("annualised_volatility"),
        sharpe(ret, ppy).alias("sharpe"),
        sortino(ret, ppy).alias("sortino"),
        F.min("__dd").alias("max_drawdown"),
        F.avg((r > 0).cast("double")).alias("hit_rate"),
        F.when(loss > EPS, F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)) / F.nullif(loss, F.lit(0.0))).alias("profit_factor"),
        probabilistic_sharpe(ret, 0.0, ppy).alias("probabilistic_sharpe"),
    ]
    if position:
        aggs += [F.avg(F.abs("__p")).alias("avg_exposure"), (F.avg("__turn") * ppy).alias("annual_turnover"), F.avg((F.col("__p") != 0).cast("double")).alias("time_in_market")]
    out = data.groupBy(*keys).agg(*aggs)
    return out.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("annualised_return") / F.abs("max_drawdown")))


def regression_metrics(rows: DataFrame, truth: str, prediction: str, keys: Sequence[str]) -> DataFrame:
    """n, mae, rmse, r2, ic_pearson, ic_spearman, directional_accuracy for each key."""
    data = rows.where(F.col(truth).isNotNull() & F.col(prediction).isNotNull())
    data = data.withColumn("__rt", average_rank(truth, keys)).withColumn("__rp", average_rank(prediction, keys))
    t, p = F.col(truth), F.col(prediction)
    error = t - p
    total = F.var_pop(t) * F.count(t)
    return data.groupBy(*keys).agg(
        F.count(t).cast("double").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(total > EPS, 1 - F.sum(error * error) / F.nullif(total, F.lit(0.0))).alias("r2"),
        guarded_corr(truth, prediction).alias("ic_pearson"),
        guarded_corr("__rt", "__rp").alias("ic_spearman"),
        F.avg(F.when(p != 0, (F.signum(p) == F.signum(t)).cast("double"))).alias("directional_accuracy"),
    )


def classification_metrics(rows: DataFrame, truth: str, score: str, keys: Sequence[str]) -> DataFrame:
    """n, accuracy, precision, recall, f1, roc_auc, base_rate for each key; AUC from average ranks."""
    data = rows.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    data = data.select(*keys, (F.col(truth) > 0).cast("double").alias("__y"), (F.col(score) > 0).cast("double").alias("__z"), average_rank(score, keys).alias("__rank"))
    y, z = F.col("__y"), F.col("__z")
    sums = data.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.avg((y == z).cast("double")).alias("accuracy"), F.sum(y * z).alias("__tp"), F.sum(z).alias("__pp"), F.sum(y).alias("__pos"), F.sum(y * F.col("__rank")).alias("__ranks"))
    tp, pp, pos, n = F.col("__tp"), F.col("__pp"), F.col("__pos"), F.col("n")
    zero = F.lit(0.0)
    neg = n - pos
    return sums.select(*keys, "n", "accuracy", F.coalesce(safe_divide(tp, pp), zero).alias("precision"), F.coalesce(safe_divide(tp, pos), zero).alias("recall"), F.coalesce(safe_divide(2 * tp, pp + pos), zero).alias("f1"), safe_divide(F.col("__ranks") - pos * (pos + 1) / 2, pos * neg).alias("roc_auc"), (pos / n).alias("base_rate"))


def benjamini_hochberg(rows: DataFrame, p: str = "p_value", keys: Sequence[str] = ()) -> DataFrame:
    """rows with q_value; NULL p-values stay NULL and do not count; a p-value outside 0..1 raises."""
    valid = F.when(F.col(p).isNull() | F.isnan(p), None).when((F.col(p) < 0) | (F.col(p) > 1), F.raise_error(F.lit("p-values lie between 0 and 1"))).otherwise(F.col(p))
    part = [F.col(k) for k in keys] or [F.lit(0)]
    known = rows.withColumn("__p", valid)
    w = Window.partitionBy(*part, F.col("__p").isNull())
    known = known.withColumn("__rank", F.row_number().over(w.orderBy("__p"))).withColumn("__m", F.count("*").over(w))
    q = F.min(F.col("__p") * F.col("__m") / F.col("__rank")).over(w.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0))
    return known.withColumn("q_value", F.when(F.col("__p").isNotNull(), F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)))).drop("__p", "__rank", "__m")


def bonferroni_threshold(n_tests: int, alpha: float = 0.05) -> float:
    if n_tests < 1 or not 0 < alpha < 1:
        raise ValueError("n_tests must be positive and alpha between 0 and 1")
    return alpha / n_tests


def expected_false_positives(n_tests: int, alpha: float = 0.05) -> float:
    if n_tests < 0 or not 0 < alpha < 1:
        raise ValueError("n_tests must not be negative and alpha lies between 0 and 1")
    return n_tests * alpha


def covered_ratio(intervals: DataFrame, start: str, end: str, keys: Sequence[str]) -> DataFrame:
    """Length of the union of [start, end) over the mean width, for each key; touching intervals merge."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)).alias("__new")
    marked = intervals.select(*keys, start, end, new)
    islands = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy(*keys, "__island").agg((F.max(end) - F.min(start)).alias("__covered"), F.sum(F.col(end) - F.col(start)).alias("__width"), F.count("*").alias("__n"))
    total = spans.groupBy(*keys).agg(F.sum("__covered").alias("c"), F.sum("__width").alias("w"), F.sum("__n").alias("n"))
    return total.select(*keys, F.when(F.col("w") <= 0, F.col("n").cast("double")).otherwise(F.col("c") * F.col("n") / F.nullif(F.col("w"), F.lit(0))).alias("ratio"))


def quantile_bins(rows: DataFrame, value: str, n_bins: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """rows with bin (0-based): right-closed bins on linear quantile edges; equal edges count once."""
    shares = [i / n_bins for i in range(n_bins + 1)]
    edges = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(s) for s in shares]))).alias("__edges"))
    joined = rows.join(edges, list(keys))
    v = F.col(value)
    below = F.size(F.filter("__edges", lambda e: e < v))
    return joined.withColumn("bin", F.when(v.isNotNull(), F.greatest(below - 1, F.lit(0)))).withColumn("n_bins", F.size("__edges") - 1).drop("__edges")
