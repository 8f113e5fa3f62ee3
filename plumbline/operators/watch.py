"""The latest session of each symbol against its own history; descriptive, not predictive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.core import by_symbol, guarded_corr, safe_divide
from plumbline.operators.joins import asof_join

YEAR, VOL_HISTORY = 252, 756
RETURN_WINDOWS, MEAN_WINDOWS, FOLLOW_UPS = (1, 5, 20, 60), (20, 60, 200), (5, 20)
UNUSUAL_Z, BUSY, CALM = 2.0, 2.0, 0.9


def _between(a: int, b: int):
    return by_symbol().rowsBetween(a, b)


def snapshot(bars: DataFrame) -> DataFrame:
    """One row a symbol: trailing returns, range, gaps to means, volatility, and how unusual the last move and volume are.

    Only each symbol's last bars, as many as the longest history needs, take part in windows; k counts them back from the latest.
    """
    w, back = by_symbol(), Window.partitionBy("symbol").orderBy(F.desc("date"))
    tail = bars.select("symbol", "date", "close", "volume", F.row_number().over(back).alias("k")).where(F.col("k") <= VOL_HISTORY + YEAR)
    tail = tail.withColumn("r", F.col("close") / F.lag("close").over(w) - 1).withColumn("l", F.log("close") - F.log(F.lag("close").over(w)))
    last20 = F.stddev_samp("l").over(_between(-19, 0))
    tail = tail.withColumn("vol", F.when(F.count("l").over(_between(-19, 0)) == 20, last20 * YEAR**0.5))
    own = Window.partitionBy("symbol")
    tail = tail.withColumn("r1", F.max(F.when(F.col("k") == 1, F.col("r"))).over(own)).withColumn("vol1", F.max(F.when(F.col("k") == 1, F.col("vol"))).over(own))
    k = F.col("k")

    def at(name: str, i: int) -> Column:
        return F.max(F.when(k == i, F.col(name)))

    def span(name: str, first: int, last: int) -> Column:
        return F.when(k.between(first, last), F.col(name))

    out = tail.groupBy("symbol").agg(
        F.max("date").alias("date"), at("close", 1).alias("close"), at("volume", 1).alias("volume"), F.count("*").alias("n"), at("r", 1).alias("r"), at("vol", 1).alias("volatility"),
        *[at("close", 1 + j).alias(f"close_{j}") for j in RETURN_WINDOWS],
        *[F.avg(span("close", 1, j)).alias(f"mean_{j}") for j in MEAN_WINDOWS],
        F.max(span("close", 1, YEAR)).alias("high_52w"), F.min(span("close", 1, YEAR)).alias("low_52w"),
        F.when(F.count(span("r", 2, 61)) >= 20, F.stddev_samp(span("r", 2, 61))).alias("spread"),
        F.count_if(k.between(2, YEAR + 1) & (F.abs("r") >= F.abs("r1"))).alias("similar_moves"),
        F.count(span("vol", 1, VOL_HISTORY)).alias("vols"), F.count_if(k.between(1, VOL_HISTORY) & (F.col("vol") <= F.col("vol1"))).alias("calmer"),
        F.avg(span("volume", 2, 21)).alias("busy"),
    )
    ends = bars.groupBy("symbol", F.year("date").alias("y")).agg(F.max_by("close", "date").alias("c"))
    prior = out.select("symbol", F.year("date").alias("y0")).join(ends, "symbol").where("y < y0").groupBy("symbol").agg(F.max_by("c", "y").alias("last_year"))
    out = out.join(prior, "symbol", "left")
    width, z = F.col("high_52w") - F.col("low_52w"), F.col("spread") > 0
    return out.select(
        "symbol", "date", "close", *[(F.col("close") / F.col(f"close_{j}") - 1).alias(f"ret_{j}") for j in RETURN_WINDOWS], (F.col("close") / F.col("last_year") - 1).alias("ytd"), "high_52w", "low_52w",
        F.when(width > 0, (F.col("close") - F.col("low_52w")) / F.when(width > 0, width)).alias("range_position"),
        *[F.when(F.col("n") >= j, F.col("close") / F.col(f"mean_{j}") - 1).alias(f"ma_gap_{j}") for j in MEAN_WINDOWS], "volatility",
        F.when(F.col("volatility").isNotNull() & (F.col("vols") > 0), F.col("calmer") / F.when(F.col("vols") > 0, F.col("vols"))).alias("volatility_percentile"),
        F.when(z, F.col("r") / F.when(z, F.col("spread"))).alias("move_z"), "similar_moves",
        safe_divide("volume", F.when(F.col("n") > 20, F.col("busy"))).alias("volume_ratio"),
    )


def flags(snapshots: DataFrame) -> DataFrame:
    """symbol, flag: one row for each thing out of the ordinary."""
    marks = F.array(
        F.when(F.abs("move_z") >= UNUSUAL_Z, "unusual_move"),
        F.when(F.col("close") >= F.col("high_52w"), "high_52w").when(F.col("close") <= F.col("low_52w"), "low_52w"),
        F.when(F.col("volume_ratio") >= BUSY, "heavy_volume"),
        F.when(F.col("volatility_percentile") >= CALM, "high_volatility"),
    )
    return snapshots.select("symbol", F.explode(F.array_compact(marks)).alias("flag"))


def overnight_pairs(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """Each follower bar with the return of the leader's last bar strictly before it."""
    w = by_symbol()
    lead = leader.withColumn("leader_return", F.col("close") / F.lag("close").over(w) - 1).where("leader_return is not null").select(F.col("symbol").alias("leader"), F.col("date").alias("leader_date"), "leader_return")
    foll = follower.withColumn("gap", F.col("open") / F.lag("close").over(w) - 1).withColumn("intraday", F.col("close") / F.col("open") - 1).where("gap is not null and intraday is not null").select(F.col("symbol").alias("follower"), "date", "gap", "intraday")
    pairs = foll.join(lead.select("leader").distinct(), F.col("leader") != F.col("follower"))
    return asof_join(pairs, lead, ["leader"], "date", "leader_date", ["leader_return"], strict=True).where("leader_return is not null")


def overnight_links(leader: DataFrame, follower: DataFrame, window: int = YEAR, least: int = 30) -> DataFrame:
    """Slope and correlation of the follower's gap on the leader's last return, over the window before the latest pair."""
    pairs = overnight_pairs(leader, follower)
    rank = pairs.withColumn("__k", F.row_number().over(Window.partitionBy("leader", "follower").orderBy(F.desc("date"))))
    recent = rank.where((F.col("__k") > 1) & (F.col("__k") <= window + 1))
    fit = recent.groupBy("leader", "follower").agg(F.count("*").alias("n"), F.var_samp("leader_return").alias("v"), F.covar_samp("leader_return", "gap").alias("c"), guarded_corr("leader_return", "gap", 2).alias("correlation"), guarded_corr("leader_return", "intraday", 2).alias("intraday_correlation")).where(F.col("n") >= least)
    fit = fit.withColumn("slope", F.when(F.col("v") > 0, F.col("c") / F.when(F.col("v") > 0, F.col("v")))).drop("v", "c")
    last = rank.where("__k = 1").select("leader", "follower", "date", "leader_return", "gap", "intraday")
    return last.join(fit, ["leader", "follower"]).withColumn("expected_gap", F.col("slope") * F.col("leader_return"))


def note_followups(notes: DataFrame, bars: DataFrame) -> DataFrame:
    """What each noted symbol did 5 and 20 bars after the last bar at or before the note; NULL where that is still to come."""
    each = notes.select("date", F.explode(F.split("symbols", ";")).alias("symbol"), "category", "note").withColumn("symbol", F.trim("symbol")).where("symbol <> ''")
    w = by_symbol()
    ahead = bars.select("symbol", F.col("date").alias("bar_date"), *[(F.lead("close", k).over(w) / F.col("close") - 1).alias(f"ret_{k}") for k in FOLLOW_UPS])
    return asof_join(each, ahead, ["symbol"], "date", "bar_date", [f"ret_{k}" for k in FOLLOW_UPS])
