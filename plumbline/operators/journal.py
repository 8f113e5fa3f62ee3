"""The append-only forecast journal: record, append, score as horizons elapse, compare."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.config import BacktestConfig
from plumbline.functions.core import EPS, PERIODS_PER_YEAR, fisher_z, guarded_corr, missed_sessions
from plumbline.operators.backtest import simple_return, target_position, trailing_volatility
from plumbline.operators.joins import count_until
from plumbline.operators.models import factory_of
from plumbline.sources.scratch import kept

KEY = ("asof_date", "symbol", "model", "horizon")
SCHEMA = "asof_date date, symbol string, model string, horizon int, signal double, position double, close double"


def save_journal(journal: DataFrame, path: str) -> None:
    """Write (or append to) the journal; a path that ends in .csv is a folder of CSV files, else Parquet."""
    writer = journal.write.mode("append")
    writer.option("header", True).csv(path) if path.endswith(".csv") else writer.parquet(path)


def load_journal(spark: SparkSession, path: str) -> DataFrame:
    """The journal at a path: empty with its columns where there is none; columns are matched by name, and a missing one raises."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SCHEMA)
    raw = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    types = [x.split(" ") for x in SCHEMA.split(", ")]
    missing = [n for n, _ in types if n not in raw.columns]
    if missing:
        raise ValueError(f"the journal lacks {missing}")
    return raw.select(*[F.col(n).cast(t) for n, t in types])


def forecast_row(rows: DataFrame) -> DataFrame:
    """The journal's rows as they are written: dates as ISO text."""
    return rows.select(*[F.date_format("asof_date", "yyyy-MM-dd").alias(n) if n == "asof_date" else F.col(n) for n in (x.split(" ")[0] for x in SCHEMA.split(", "))])


def append(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The journal after an idempotent append: known keys are not written again."""
    fresh = incoming.dropDuplicates(list(KEY)).join(existing.select(*KEY), list(KEY), "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def is_append_only(previous: DataFrame, current: DataFrame) -> bool:
    """Whether every row of the old journal is still in the new one, as often as before."""
    return previous.exceptAll(current).isEmpty()


def rows_added(previous: DataFrame, current: DataFrame) -> int:
    return current.count() - previous.count()


def size_last(bars: DataFrame, signals: DataFrame, config: BacktestConfig) -> DataFrame:
    """symbol, asof_date, signal -> with position, sized by the volatility of the full history."""
    vol = bars.withColumn("asset_return", simple_return()).select("symbol", F.col("date").alias("asof_date"), "close", trailing_volatility("asset_return", config.vol_lookback).alias("__vol"))
    return signals.join(vol, ["symbol", "asof_date"]).withColumn("position", target_position("signal", config, "__vol")).drop("__vol")


def record(dataset: DataFrame, latest: DataFrame, model: str, features: Sequence[str], horizon: int, bars: DataFrame, config: BacktestConfig | None = None, min_rows: int = 250) -> DataFrame:
    """One forecast a symbol for its latest bar with all features, fitted on all labelled rows; symbols whose fit fails are left out."""
    names, factory = list(features), factory_of(model)
    both = dataset.select("symbol", "date", *names, "forward_return", "direction").unionByName(latest.select("symbol", "date", *names, F.lit(None).cast("double").alias("forward_return"), F.lit(None).cast("double").alias("direction")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=["symbol", "asof_date", "signal"])
        pdf = pdf.sort_values("date")
        known, last = pdf[pdf["forward_return"].notna()], pdf.iloc[-1:]
        if len(known) < max(2, min_rows) or last[names].isna().any(axis=None):
            return empty
        try:
            estimator = factory()
            label = "direction" if estimator.is_classifier else "forward_return"
            estimator.fit(known[names].to_numpy(float), known[label].to_numpy(float), names)
            signal = float(estimator.predict(last[names].to_numpy(float))[0])
        except (ValueError, KeyError, RuntimeError):
            return empty
        return pd.DataFrame({"symbol": last["symbol"].to_numpy(), "asof_date": last["date"].to_numpy(), "signal": [signal]})

    signals = both.groupBy("symbol").applyInPandas(run, "symbol string, asof_date date, signal double")
    sized = size_last(bars, signals, config or BacktestConfig())
    return sized.select("asof_date", "symbol", F.lit(model).alias("model"), F.lit(horizon).alias("horizon"), "signal", "position", "close")


def realised(journal: DataFrame, bars: DataFrame) -> DataFrame:
    """journal with realised_return: ln(close h bars after / close) on an exact date; NULL while it has not elapsed."""
    at = bars.select("symbol", F.col("date").alias("asof_date"), F.col("close").alias("__c0"), F.row_number().over(Window.partitionBy("symbol").orderBy("date")).alias("__pos"))
    ahead = at.select("symbol", F.col("__pos").alias("__to"), F.col("__c0").alias("__c1"))
    out = journal.join(at, ["symbol", "asof_date"], "left").withColumn("__to", F.col("__pos") + F.col("horizon")).join(ahead, ["symbol", "__to"], "left")
    return out.withColumn("realised_return", F.log("__c1") - F.log("__c0")).drop("__to", "__pos", "__c0", "__c1")


def sessions_held(journal: DataFrame, bars: DataFrame) -> DataFrame:
    """journal with sessions_held: bars since the forecast before of the same symbol and model; 1 for the first, NULL without bars."""
    seen = count_until(journal, bars, ["symbol"], "asof_date", "date", "__seen")
    w = Window.partitionBy("symbol", "model").orderBy("asof_date")
    known = bars.select("symbol", F.lit(True).alias("__known")).distinct()
    held = F.when(F.row_number().over(w) == 1, 1.0).otherwise((F.col("__seen") - F.lag("__seen").over(w)).cast("double"))
    return seen.withColumn("sessions_held", held).join(known, "symbol", "left").withColumn("sessions_held", F.when(F.col("__known"), F.col("sessions_held"))).drop("__seen", "__known")


def score(journal: DataFrame, bars: DataFrame, cost_bps: float = 2.0) -> DataFrame:
    """journal with turnover, cost, sessions_held, realised_return and pnl; pending rows have neither of the last two."""
    w = Window.partitionBy("symbol", "model").orderBy("asof_date")
    out = journal.withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))))
    out = realised(sessions_held(out.withColumn("cost", F.col("turnover") * cost_bps * 1e-4), bars), bars)
    return out.withColumn("pnl", F.col("position") * F.col("realised_return") - F.col("cost"))


def scored_rows(rows: DataFrame) -> DataFrame:
    return rows.where("realised_return is not null")


def pending_rows(rows: DataFrame) -> DataFrame:
    return rows.where("realised_return is null").drop("realised_return", "pnl")


def decided(scored: DataFrame) -> DataFrame:
    return scored.where("position <> 0")


def trading_calendar(bars: DataFrame) -> DataFrame:
    return bars.select("date").distinct()


def annualised_turnover(keys: Sequence[str]):
    """Aggregate: turnover per session held, a year."""
    fine = F.col("sessions_held").isNotNull()
    sessions = F.sum(F.when(fine, F.col("sessions_held")))
    return F.when(sessions > 0, F.sum(F.when(fine, F.col("turnover"))) / F.when(sessions > 0, sessions) * PERIODS_PER_YEAR)


def _hit() -> Column:
    return (F.signum("position") == F.signum("realised_return")).cast("double")


def live_sharpe() -> Column:
    """Aggregate: Sharpe ratio at the horizon's own frequency; NULL for mixed horizons."""
    one = F.count_distinct("horizon") == 1
    ppy = PERIODS_PER_YEAR / F.max("horizon").cast("double")
    sd = F.stddev_samp("pnl")
    return F.when(one & (F.count("pnl") >= 2) & (sd >= EPS), F.avg("pnl") / F.nullif(sd, F.lit(0.0)) * F.sqrt(ppy))


def live_turnover(rows: DataFrame) -> DataFrame:
    """Mean over symbols with at least two rows, scored or pending."""
    per = rows.groupBy("symbol").agg(F.count("*").alias("n"), annualised_turnover(()).alias("t")).where("n >= 2")
    return per.agg(F.avg("t").alias("live_annual_turnover"))


def _grouped(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (rows, list(keys)) if keys else (rows.withColumn("__all", F.lit(0)), ["__all"])


def live_metrics(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Hit rate, information coefficients, P&L and turnover of the scored rows."""
    rows, by = _grouped(rows, keys)
    done = scored_rows(rows)
    flat = done.groupBy(*by).agg(
        F.count("*").cast("double").alias("n_scored"),
        F.avg(F.when(F.col("position") != 0, _hit())).alias("hit_rate"),
        guarded_corr("signal", "realised_return").alias("live_ic_pooled"),
        F.avg("pnl").alias("mean_pnl"),
        F.sum("pnl").alias("total_pnl"),
        live_sharpe().alias("live_sharpe"),
        annualised_turnover(()).alias("annual_turnover"),
        F.count_distinct("symbol").cast("double").alias("n_symbols"),
        F.datediff(F.max("asof_date"), F.min("asof_date")).cast("double").alias("span_days"),
    )
    ic = done.groupBy(*by, "symbol").agg(guarded_corr("signal", "realised_return").alias("ic")).groupBy(*by).agg(F.avg("ic").alias("live_ic"))
    waiting = rows.groupBy(*by).agg(F.count(F.when(F.col("realised_return").isNull(), 1)).cast("double").alias("n_pending"))
    per = rows.groupBy(*by, "symbol").agg(F.count("*").alias("n"), annualised_turnover(()).alias("t")).where("n >= 2").groupBy(*by).agg(F.avg("t").alias("live_annual_turnover"))
    out = waiting.join(flat, by, "left").join(ic, by, "left").join(per, by, "left")
    out = out.withColumn("n_scored", F.coalesce("n_scored", F.lit(0.0)))
    return out if keys else out.drop("__all")


def by_symbol(scored: DataFrame) -> DataFrame:
    return decided(scored).groupBy("symbol").agg(F.count("*").alias("n"), F.avg(_hit()).alias("hit_rate"), F.avg("pnl").alias("mean_pnl"), F.sum("pnl").alias("total_pnl")).orderBy(F.desc("total_pnl"))


def independent_blocks(rows: DataFrame, calendar: DataFrame, keys: Sequence[str] = (), name: str = "n_independent") -> DataFrame:
    """Number of distinct horizon-long blocks of sessions, counted from the first forecast, that hold a row."""
    rows, by = _grouped(rows, keys)
    dates = calendar.select(F.col("date").alias("asof_date")).union(rows.select("asof_date")).distinct()
    numbered = dates.select("asof_date", F.row_number().over(Window.orderBy("asof_date")).alias("__rn"))
    placed = rows.select(*by, "asof_date", "horizon").join(numbered, "asof_date")
    w = Window.partitionBy(*by)
    placed = placed.withColumn("__first", F.min("__rn").over(w)).withColumn("__h", F.greatest(F.max("horizon").over(w), F.lit(1)))
    out = placed.groupBy(*by).agg(F.count_distinct(F.floor((F.col("__rn") - F.col("__first")) / F.col("__h"))).cast("double").alias(name))
    return out if keys else out.drop("__all")


def compare_with_backtest(rows: DataFrame, calendar: DataFrame, claimed_accuracy: float, claimed_ic: float, keys: Sequence[str] = ()) -> DataFrame:
    """Gaps between live and claimed hit rate and IC, with z-values by independent blocks and naive ones."""
    tagged, by = _grouped(rows, keys)
    done = scored_rows(tagged)
    base = live_metrics(tagged, by).select(*by, "n_scored", "hit_rate", "live_ic")
    n_decided = decided(done).groupBy(*by).agg(F.count("*").cast("double").alias("n_decided"))
    out = base.join(n_decided, by, "left").join(independent_blocks(decided(done), calendar, by), by, "left").join(independent_blocks(done, calendar, by, "n_independent_ic"), by, "left")
    out = out.fillna(0.0, ["n_decided", "n_independent", "n_independent_ic"])
    p, q = F.lit(float(claimed_accuracy)), F.lit(float(claimed_ic))
    spread = claimed_accuracy * (1 - claimed_accuracy)

    def z(n: str) -> Column:
        return F.when((F.col(n) >= 1) & F.lit(0 < claimed_accuracy < 1), (F.col("hit_rate") - p) / F.sqrt(F.lit(spread) / F.when(F.col(n) >= 1, F.col(n))))

    out = out.select(*by, "n_scored", "n_decided", "n_independent", "n_independent_ic", p.alias("backtest_directional_accuracy"), F.col("hit_rate").alias("live_hit_rate"), (F.col("hit_rate") - p).alias("hit_rate_gap"), q.alias("backtest_ic"), "live_ic", (F.col("live_ic") - q).alias("ic_gap"), fisher_z("live_ic", q, "n_scored").alias("ic_z_naive"), fisher_z("live_ic", q, "n_independent_ic").alias("ic_z"), z("n_decided").alias("hit_rate_z_naive"), z("n_independent").alias("hit_rate_z"))
    return out if keys else out.drop("__all")


def compare_with_always_long(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """McNemar comparison of the model's hits with those of always being long, and of the two P&Ls."""
    done = scored_rows(rows)
    d = decided(done).withColumn("__m", F.signum("position") == F.signum("realised_return")).withColumn("__l", F.col("realised_return") > 0)
    discordant = d.where("__m <> __l")
    k = F.lit(0).alias("__k")
    a = d.select("*", k).groupBy("__k").agg(F.count("*").cast("double").alias("n_decided"), F.avg(F.col("__m").cast("double")).alias("live_hit_rate"), F.avg(F.col("__l").cast("double")).alias("always_long_hit_rate"), F.sum((F.col("position") < 0).cast("double")).alias("n_short"), F.sum((F.col("__m") & ~F.col("__l")).cast("double")).alias("b"), F.sum((~F.col("__m") & F.col("__l")).cast("double")).alias("c"))
    paired = F.col("pnl") - F.col("realised_return")
    e = done.select("*", k).groupBy("__k").agg(F.sum("pnl").alias("live_pnl"), F.sum("realised_return").alias("always_long_pnl"), F.avg(paired).alias("pm"), F.stddev_samp(paired).alias("ps"), F.count("*").alias("n"))
    x = independent_blocks(discordant, calendar, (), "n_independent_discordant").select("*", k)
    y = independent_blocks(done, calendar, (), "n_independent_pnl").select("*", k)
    out = e.join(a, "__k", "left").join(x, "__k", "left").join(y, "__k", "left").fillna(0.0, ["n_decided", "n_short", "b", "c", "n_independent_discordant", "n_independent_pnl"])
    n = F.col("b") + F.col("c")
    rate = F.when(n > 0, (F.col("b") - F.col("c")) / F.when(n > 0, n))
    drift = F.when(F.col("ps") > 0, F.col("pm") / F.when(F.col("ps") > 0, F.col("ps")))
    return out.select("n_decided", "live_hit_rate", "always_long_hit_rate", (F.col("live_hit_rate") - F.col("always_long_hit_rate")).alias("hit_rate_gap"), "n_short", n.alias("n_discordant"), "n_independent_discordant", (rate * F.sqrt("n_independent_discordant")).alias("skill_z"), (rate * F.sqrt(n)).alias("skill_z_naive"), "live_pnl", "always_long_pnl", (F.col("live_pnl") - F.col("always_long_pnl")).alias("pnl_gap"), "n_independent_pnl", (drift * F.sqrt("n_independent_pnl")).alias("pnl_gap_z"), (drift * F.sqrt("n")).alias("pnl_gap_z_naive"))


def rolling_windows(scored: DataFrame, window: int = 30) -> DataFrame:
    """window_end, window_start: for each date the shortest run of whole dates that ends there and holds at least `window` rows."""
    per = scored.groupBy("asof_date").agg(F.count("*").alias("k"))
    w = Window.orderBy("asof_date").rowsBetween(Window.unboundedPreceding, 0)
    cum = per.select("asof_date", F.sum("k").over(w).alias("upto"), (F.sum("k").over(w) - F.col("k")).alias("before"))
    ends = cum.select(F.col("asof_date").alias("window_end"), (F.col("upto") - window).alias("most"))
    # the start is the last date whose rows before it number at most `most`: an as-of join on counts
    starts = cum.select(F.col("before").alias("at"), F.col("asof_date").alias("window_start"), F.lit(0).alias("side"))
    both = starts.select("at", "side", "window_start", F.lit(None).cast("date").alias("window_end")).unionByName(ends.where("most >= 0").select(F.col("most").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("date").alias("window_start"), "window_end"))
    found = both.withColumn("window_start", F.last("window_start", ignorenulls=True).over(Window.orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)))
    return found.where("side = 1").select("window_end", "window_start")


def rolling_compare(rows: DataFrame, calendar: DataFrame, claimed_accuracy: float, claimed_ic: float, window: int = 30) -> DataFrame:
    done = scored_rows(rows)
    spans = rolling_windows(done, window)
    # a window is a run of dates: number them, and the range becomes an equi-join on the number
    dates = done.select("asof_date").distinct().withColumn("rn", F.row_number().over(Window.orderBy("asof_date")))
    first, last = dates.select(F.col("asof_date").alias("window_start"), F.col("rn").alias("a")), dates.select(F.col("asof_date").alias("window_end"), F.col("rn").alias("b"))
    spans = spans.join(first, "window_start").join(last, "window_end").select("window_end", F.explode(F.sequence("a", "b")).alias("rn"))
    inside = kept(done.join(dates, "asof_date").join(spans, "rn").drop("rn"), "windows")  # half a dozen figures read it
    return compare_with_backtest(inside, calendar, claimed_accuracy, claimed_ic, ["window_end"]).withColumnRenamed("window_end", "asof_date")


def last_bar(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("date").alias("last_bar"))


def data_freshness(bars: DataFrame, asof: str, symbols: DataFrame | None = None, allowed: int = 1) -> DataFrame:
    """symbol, last_bar, age_days, missed_sessions, stale; symbols without a bar are infinitely old and stale."""
    seen = last_bar(bars)
    out = symbols.select("symbol").distinct().join(seen, "symbol", "left") if symbols is not None else seen
    reference = F.lit(asof).cast("date")
    infinite = F.lit(float("inf"))
    out = out.withColumn("age_days", F.when(F.col("last_bar").isNull(), infinite).otherwise(F.datediff(reference, "last_bar").cast("double")))
    out = out.withColumn("missed_sessions", F.when(F.col("last_bar").isNull(), infinite).otherwise(missed_sessions("last_bar", reference).cast("double")))
    return out.withColumn("stale", F.col("missed_sessions") > allowed)


def stale_symbols(freshness: DataFrame, older_than_days: float) -> DataFrame:
    return freshness.where(F.col("age_days").isNull() | (F.col("age_days") > older_than_days)).select("symbol").orderBy("symbol")


def outcome_begun(bars: DataFrame, now: str) -> DataFrame:
    """Symbols whose next session has closed by now, so that a forecast from their last bar would come too late."""
    from plumbline.sources.ingest import next_session_close

    out = last_bar(bars).withColumn("closes", next_session_close("symbol", "last_bar"))
    return out.where(F.col("closes") <= F.lit(now).cast("timestamp")).select("symbol")


def in_flight(pending: DataFrame, budget: int = 40) -> tuple[DataFrame, DataFrame]:
    """Rows of the oldest whole dates within the budget (the first date always), and the number left out."""
    per = pending.groupBy("asof_date").agg(F.count("*").alias("k"))
    w = Window.orderBy("asof_date").rowsBetween(Window.unboundedPreceding, 0)
    keep = per.withColumn("cum", F.sum("k").over(w)).withColumn("rn", F.row_number().over(Window.orderBy("asof_date"))).where((F.col("rn") == 1) | (F.col("cum") <= budget)).select("asof_date")
    shown = pending.join(keep, "asof_date", "left_semi").select("asof_date", "symbol", "signal", "position")
    left = pending.join(keep, "asof_date", "left_anti").agg(F.count("*").alias("omitted"))
    return shown, left
