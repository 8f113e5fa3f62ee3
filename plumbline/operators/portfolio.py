"""Sleeves of returns held together. Long tables (date, symbol, ret); matrices are pair tables (sym_a, sym_b)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.core import EPS, PERIODS_PER_YEAR, guarded_corr, safe_divide
from plumbline.operators import metrics as m
from plumbline.sources.scratch import kept

ROLLING_WINDOW = 63


def wide(returns: DataFrame) -> DataFrame:
    """Full outer alignment: a row for each date, a column for each symbol."""
    return returns.groupBy("date").pivot("symbol").agg(F.first("ret"))


def common(returns: DataFrame) -> DataFrame:
    """Only the dates on which every symbol has a return; nothing is filled."""
    known = returns.where("ret is not null")
    symbols = known.select("symbol").distinct().count()
    if symbols < 1:
        return known
    dates = known.groupBy("date").agg(F.count_distinct("symbol").alias("n")).where(F.col("n") == symbols).select("date")
    return known.join(dates, "date", "left_semi")


def weekly(returns: DataFrame) -> DataFrame:
    """Compounded by calendar week; date is the Sunday that ends it."""
    out = returns.where("ret is not null").groupBy("symbol", F.date_add(F.date_trunc("week", F.col("date").cast("timestamp")).cast("date"), 6).alias("date"))
    return out.agg((F.product(1 + F.col("ret")) - 1).alias("ret"))


def sleeve_weights(sleeves: DataFrame, scheme: str = "equal") -> DataFrame:
    """symbol, weight: equal, or by the inverse of sample volatility (no volatility raises)."""
    if scheme not in ("equal", "inverse_vol"):
        raise ValueError("the scheme is equal or inverse_vol")
    per = sleeves.groupBy("symbol").agg(F.stddev_samp("ret").alias("sd"))
    raw = F.lit(1.0) if scheme == "equal" else F.when(F.col("sd") > EPS, 1 / F.when(F.col("sd") > EPS, F.col("sd"))).otherwise(F.raise_error(F.lit("a sleeve without volatility has no inverse weight")).cast("double"))
    per = per.withColumn("raw", raw)
    return per.select("symbol", (F.col("raw") / F.sum("raw").over(Window.partitionBy())).alias("weight"))


def pair_rows(sleeves: DataFrame, half: bool = False) -> DataFrame:
    """date, sym_a, sym_b, ret_a, ret_b: all ordered pairs of symbols of a date, or only those with sym_a <= sym_b."""
    a = sleeves.select("date", F.col("symbol").alias("sym_a"), F.col("ret").alias("ret_a"))
    b = sleeves.select("date", F.col("symbol").alias("sym_b"), F.col("ret").alias("ret_b"))
    same = F.col("a.date") == F.col("b.date")
    return a.alias("a").join(b.alias("b"), same & (F.col("sym_a") <= F.col("sym_b")) if half else same).select("a.date", "sym_a", "sym_b", "ret_a", "ret_b")


def _mirrored(pairs: DataFrame, value: str) -> DataFrame:
    """A symmetric pair table from its half."""
    return pairs.unionByName(pairs.where("sym_a < sym_b").select(F.col("sym_b").alias("sym_a"), F.col("sym_a").alias("sym_b"), value))


def covariance(sleeves: DataFrame) -> DataFrame:
    return _mirrored(pair_rows(sleeves, True).groupBy("sym_a", "sym_b").agg(F.covar_samp("ret_a", "ret_b").alias("cov")), "cov")


def correlation(sleeves: DataFrame, least: int = 2) -> DataFrame:
    return _mirrored(pair_rows(sleeves, True).groupBy("sym_a", "sym_b").agg(guarded_corr("ret_a", "ret_b", least).alias("corr")), "corr")


def mean_off_diagonal(pairs: DataFrame) -> DataFrame:
    return pairs.where("sym_a < sym_b").agg(F.avg("corr").alias("mean_correlation"))


def checked_weights(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """weights, if none is negative and they fit the covariance symbol by symbol; running the plan raises otherwise."""
    have = cov.select(F.col("sym_a").alias("symbol")).union(cov.select(F.col("sym_b").alias("symbol"))).distinct().withColumn("covered", F.lit(True))
    both = weights.join(have, "symbol", "full")
    fault = F.when(F.col("covered").isNull(), "a weight without a covariance").when(F.col("weight").isNull(), "a covariance without a weight").when(F.col("weight") < 0, "weights must not be negative")
    return both.select("symbol", F.when(fault.isNotNull(), F.raise_error(F.concat(F.col("symbol"), F.lit(": "), fault)).cast("double")).otherwise(F.col("weight")).alias("weight"))


def weighted_pairs(cov: DataFrame, weights: DataFrame) -> DataFrame:
    weights = checked_weights(cov, weights)
    a = weights.select(F.col("symbol").alias("sym_a"), F.col("weight").alias("w_a"))
    b = weights.select(F.col("symbol").alias("sym_b"), F.col("weight").alias("w_b"))
    return cov.join(a, "sym_a").join(b, "sym_b")


def diversification(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """diversification_ratio and effective_bets (its square)."""
    one = F.col("sym_a") == F.col("sym_b")
    sums = weighted_pairs(cov, weights).agg(F.sum(F.when(one, F.col("w_a") * F.sqrt(F.greatest("cov", F.lit(0.0))))).alias("s"), F.sum(F.col("w_a") * F.col("w_b") * F.col("cov")).alias("v"))
    ratio = F.when(F.col("v") > EPS, F.col("s") / F.sqrt(F.when(F.col("v") > EPS, F.col("v"))))
    return sums.select(ratio.alias("diversification_ratio"), (ratio * ratio).alias("effective_bets"))


def rolling_bets(sleeves: DataFrame, weights: DataFrame, window: int = ROLLING_WINDOW) -> DataFrame:
    """date, mean_correlation, effective_bets over trailing windows with fixed weights; full windows only."""
    if window < 2:
        raise ValueError("a rolling correlation needs a window of at least 2")
    w = Window.partitionBy("sym_a", "sym_b").orderBy("date").rowsBetween(-(window - 1), 0)
    # both orders of a pair have one covariance: half of them, counted twice
    both = F.when(F.col("sym_a") == F.col("sym_b"), 1.0).otherwise(2.0)
    pairs = weighted_pairs(pair_rows(sleeves, True), weights).withColumn("w_b", F.col("w_b") * both)
    rolled = pairs.select("date", "sym_a", "sym_b", "w_a", "w_b", F.count("*").over(w).alias("n"), F.covar_samp("ret_a", "ret_b").over(w).alias("cov"), F.stddev_samp("ret_a").over(w).alias("sa"), F.stddev_samp("ret_b").over(w).alias("sb")).where(F.col("n") == window)
    corr = F.when(F.col("sa") * F.col("sb") > EPS, F.col("cov") / F.nullif(F.col("sa") * F.col("sb"), F.lit(0.0)))
    out = rolled.groupBy("date").agg(F.avg(F.when(F.col("sym_a") < F.col("sym_b"), corr)).alias("mean_correlation"), F.sum(F.when(F.col("sym_a") == F.col("sym_b"), F.col("w_a") * F.col("sa"))).alias("s"), F.sum(F.col("w_a") * F.col("w_b") * F.col("cov")).alias("v"))
    return out.select("date", "mean_correlation", F.when(F.col("v") > EPS, F.col("s") * F.col("s") / F.when(F.col("v") > EPS, F.col("v"))).alias("effective_bets"))


def portfolio_returns(sleeves: DataFrame, weights: DataFrame) -> DataFrame:
    """date, ret, equity of the weighted sum."""
    daily = sleeves.join(weights, "symbol").groupBy("date").agg(F.sum(F.col("ret") * F.col("weight")).alias("ret"))
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("equity", F.product(1 + F.col("ret")).over(w))


def build_portfolio(returns: DataFrame, scheme: str = "equal", assets: DataFrame | None = None) -> dict[str, DataFrame]:
    """sleeves on their common dates, weights, returns with equity, common_fraction and, if given, asset returns on those dates (which must cover them)."""
    sleeves = common(returns)
    weights = sleeve_weights(sleeves, scheme)
    dates = returns.select("date").distinct()
    fraction = dates.agg(F.count("*").alias("n")).join(sleeves.select("date").distinct().agg(F.count("*").alias("k"))).select((F.col("k") / F.col("n")).alias("common_fraction"))
    out = {"sleeves": sleeves, "weights": weights, "returns": portfolio_returns(sleeves, weights), "common_fraction": fraction}
    if assets is not None:
        held = sleeves.select("symbol", "date").join(assets, ["symbol", "date"], "left")
        if not held.where("ret is null").isEmpty():
            raise ValueError("asset returns must cover every date the sleeves trade")
        out["assets"] = held
    return out


def drawdown_series(returns: DataFrame) -> DataFrame:
    """date, drawdown of a portfolio's equity."""
    return returns.withColumn("__k", F.lit(0)).select("date", m.drawdown("equity", ("__k",)).alias("drawdown"))


def rolling_bets_with_drawdown(sleeves: DataFrame, weights: DataFrame, window: int = ROLLING_WINDOW) -> DataFrame:
    return rolling_bets(sleeves, weights, window).join(drawdown_series(portfolio_returns(sleeves, weights)), "date")


def drawdown_bins(rolling: DataFrame, n_bins: int = 3) -> DataFrame:
    from plumbline.operators.walkforward import regime_labels

    binned = m.quantile_bins(rolling.withColumn("__k", F.lit(0)), "drawdown", n_bins, ("__k",))
    return binned.withColumn("regime", regime_labels(names=("deep_drawdown", "mid_drawdown", "shallow_drawdown"), prefix="drawdown")).drop("__k")


def bets_by_drawdown(rolling: DataFrame, n_bins: int = 3) -> DataFrame:
    return drawdown_bins(rolling, n_bins).groupBy("regime").agg(F.count("*").cast("double").alias("n_windows"), F.avg("drawdown").alias("mean_drawdown"), F.avg("mean_correlation").alias("mean_correlation"), F.avg("effective_bets").alias("effective_bets"))


def stress_z(rolling: DataFrame, window: int = ROLLING_WINDOW) -> DataFrame:
    """gap of effective bets between deep and shallow drawdowns: z with overlapping windows counted once, and naively."""
    deep, shallow = F.col("regime") == "deep_drawdown", F.col("regime") == "shallow_drawdown"
    b = F.col("effective_bets")
    s = drawdown_bins(rolling).agg(F.avg(F.when(deep, b)).alias("md"), F.avg(F.when(shallow, b)).alias("ms"), F.var_samp(F.when(deep, b)).alias("vd"), F.var_samp(F.when(shallow, b)).alias("vs"), F.count(F.when(deep, b)).alias("nd"), F.count(F.when(shallow, b)).alias("ns"))

    def z(scale: float):
        error = F.sqrt(F.col("vd") / F.greatest(F.col("nd") / scale, F.lit(1.0)) + F.col("vs") / F.greatest(F.col("ns") / scale, F.lit(1.0)))
        return F.when((F.col("nd") >= 2) & (F.col("ns") >= 2) & (error > EPS), (F.col("md") - F.col("ms")) / F.nullif(error, F.lit(0.0)))

    return s.select(F.col("md").alias("deep"), F.col("ms").alias("shallow"), (F.col("md") - F.col("ms")).alias("gap"), z(float(window)).alias("z"), z(1.0).alias("z_naive"))


def risk_contributions(cov: DataFrame, weights: DataFrame) -> DataFrame:
    pairs = weighted_pairs(cov, weights).withColumn("part", F.col("w_a") * F.col("w_b") * F.col("cov"))
    per = pairs.groupBy(F.col("sym_a").alias("symbol")).agg(F.sum("part").alias("part"))
    total = F.sum("part").over(Window.partitionBy())
    return per.select("symbol", F.when(total > EPS, F.col("part") / F.when(total > EPS, total)).alias("risk_contribution"))


def sleeve_table(sleeves: DataFrame, weights: DataFrame, ppy: float = PERIODS_PER_YEAR) -> DataFrame:
    per = sleeves.groupBy("symbol").agg((F.stddev_samp("ret") * ppy**0.5).alias("annualised_volatility"), (F.avg("ret") * ppy).alias("annualised_return"))
    per = per.withColumn("sharpe", safe_divide("annualised_return", "annualised_volatility"))
    return weights.join(per, "symbol").join(risk_contributions(covariance(sleeves), weights), "symbol")


def sharpe_if_independent(sleeves: DataFrame, weights: DataFrame, ppy: float = PERIODS_PER_YEAR) -> DataFrame:
    per = sleeves.groupBy("symbol").agg(F.stddev_samp("ret").alias("sd"), F.avg("ret").alias("mean")).join(weights, "symbol")
    root = F.sqrt(F.sum(F.pow(F.col("weight") * F.col("sd"), 2)))
    return per.agg(F.when(root > EPS, F.sum(F.col("weight") * F.col("mean")) / F.nullif(root, F.lit(0.0)) * ppy**0.5).alias("sharpe_if_independent"))


def portfolio_metrics(returns: DataFrame, assets: DataFrame | None = None, scheme: str = "equal", window: int = ROLLING_WINDOW) -> DataFrame:
    """metric, value: the financial metrics of the portfolio and what its diversification amounts to."""
    p = build_portfolio(kept(returns, "returns"), scheme, None if assets is None else kept(assets, "assets"))
    sleeves, weights = kept(p["sleeves"], "sleeves"), kept(p["weights"], "weights")
    off = correlation(sleeves).where("sym_a < sym_b")
    rolling = kept(rolling_bets_with_drawdown(sleeves, weights, window), "rolling")
    z = stress_z(rolling, window)
    week = weekly(sleeves)
    parts = [
        m.financial_metrics(portfolio_returns(sleeves, weights).withColumn("k", F.lit(0)), "ret", "equity", keys=("k",)).drop("k"),
        sleeves.agg(F.count_distinct("symbol").cast("double").alias("n_sleeves")),
        off.agg(F.avg("corr").alias("mean_correlation"), F.max("corr").alias("max_correlation"), F.min("corr").alias("min_correlation")),
        diversification(covariance(sleeves), weights),
        p["common_fraction"],
        rolling.agg(F.lit(float(window)).alias("rolling_window"), F.count("*").cast("double").alias("n_rolling_windows"), F.min("effective_bets").alias("effective_bets_min")),
        z.select(F.col("deep").alias("effective_bets_deep_drawdown"), F.col("shallow").alias("effective_bets_shallow_drawdown"), F.col("gap").alias("effective_bets_stress_gap"), F.col("z").alias("effective_bets_stress_z"), F.col("z_naive").alias("effective_bets_stress_z_naive")),
        sharpe_if_independent(sleeves, weights),
        week.agg(F.count_distinct("date").cast("double").alias("n_weeks")),
        correlation(week).where("sym_a < sym_b").agg(F.avg("corr").alias("mean_correlation_weekly")),
    ]
    if assets is not None:
        held = p["assets"]
        parts += [correlation(held).where("sym_a < sym_b").agg(F.avg("corr").alias("mean_asset_correlation")), diversification(covariance(held), weights).select(F.col("effective_bets").alias("asset_effective_bets")), correlation(weekly(held)).where("sym_a < sym_b").agg(F.avg("corr").alias("mean_asset_correlation_weekly"))]
    one = None
    for part in parts:
        row = part.withColumn("__k", F.lit(0))
        one = row if one is None else one.join(row, "__k")
    one = one.withColumn("sharpe_diversification_gap", F.col("sharpe_if_independent") - F.col("sharpe")).withColumn("sleeve_alignment_gap", F.col("mean_correlation_weekly") - F.col("mean_correlation"))
    if assets is not None:
        one = one.withColumn("asset_alignment_gap", F.col("mean_asset_correlation_weekly") - F.col("mean_asset_correlation"))
    names = [c for c in one.columns if c != "__k"]
    return one.unpivot(["__k"], [F.col(n).cast("double").alias(n) for n in names], "metric", "value").drop("__k")
