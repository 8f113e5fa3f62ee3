"""SRC queries: adapters, scans and ingest-time cleaning."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.config import SyntheticConfig
from plumbline.queries.base import PATH, SEGMENTS, add, rounded
from plumbline.sources import adapters, ingest, synthetic
from plumbline.sources.scratch import new_folder


@add("adapter_raw_bars", "with " + adapters.RAW_SQL + "select * from bars")
def raw(spark, sf_dir):
    return adapters.raw_bars(spark, sf_dir)


@add("adapter_price_path", PATH + "select * from bars")
def path(spark, sf_dir):
    return adapters.price_path(spark, sf_dir)


@add("adapter_segment_bars", SEGMENTS + "select * from bars")
def segments(spark, sf_dir):
    return adapters.segment_bars(spark, sf_dir)


@add("adapter_hourly_bars", "with " + adapters.HOURLY_SQL + "select * from bars")
def hourly(spark, sf_dir):
    bars = adapters.hourly_bars(spark, sf_dir)
    return bars.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@add("src_02_header_normaliser", "select c_custkey as date, c_acctbal as adj_close, c_nationkey as volume, c_name as o_name from customer")
def headers(spark, sf_dir):
    raw = adapters.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias(" Date"), F.col("c_acctbal").alias("Adj-Close"), F.col("c_nationkey").alias("VOL"), F.col("c_name").alias("O Name"))
    return ingest.normalise_columns(raw)


TEXT = "concat('T', cast(c_custkey as string), case when c_custkey % 3 = 0 then '  # note' else '' end)"


@add("src_08_universe_reader", "select concat('T', c_custkey::varchar) as ticker from customer where c_custkey % 5 <> 0")
def universe(spark, sf_dir):
    lines = adapters.read(spark, sf_dir, "customer").select(F.expr(f"case when c_custkey % 5 = 0 then '# comment' else {TEXT} end").alias("value"))
    return ingest.read_universe(lines)


@add("src_11_symbol_names", "select concat('T', c_custkey::varchar) as ticker, 'note' as name from customer where c_custkey % 3 = 0")
def names(spark, sf_dir):
    return ingest.symbol_names(adapters.read(spark, sf_dir, "customer").select(F.expr(TEXT).alias("value")))


BROKEN = PATH + ", br as (select symbol, date, case when day(date) = 7 then null else open end as open, case when day(date) = 9 then round(greatest(open, close) * 0.999, 6) else high end as high, low, close, volume from bars)"


def broken(spark, sf_dir):
    bars = adapters.price_path(spark, sf_dir)
    day = F.dayofmonth("date")
    return bars.select("symbol", "date", F.when(day != 7, F.col("open")).alias("open"), F.when(day == 9, F.round(F.greatest("open", "close") * 0.999, 6)).otherwise(F.col("high")).alias("high"), "low", "close", "volume")


@add("src_17_drop_untraded", BROKEN + " select * from br where open is not null")
def untraded(spark, sf_dir):
    return ingest.drop_untraded(broken(spark, sf_dir))


@add("src_18_clamp_extremes", BROKEN + " select symbol, date, open, greatest(high, open, close) as high, least(low, open, close) as low, close, volume from br where open is not null")
def clamped(spark, sf_dir):
    return ingest.clamp_extremes(ingest.drop_untraded(broken(spark, sf_dir)))


TICK = "case symbol when 'A' then 'A' when 'N' then 'N.TW' else 'R.ZZ' end"
CLOSES = "case symbol when 'A' then (date::timestamp + interval 16 hour) at time zone 'America/New_York' when 'N' then (date::timestamp + interval 13 hour + interval 30 minute) at time zone 'Asia/Taipei' end"
LIMIT = "1997-06-16 18:00:00"


def ticked(spark, sf_dir):
    return adapters.price_path(spark, sf_dir).withColumn("symbol", F.expr(TICK))


@add("src_19_drop_unclosed", PATH + f" select {TICK} as symbol, date, close from bars where coalesce({CLOSES} <= timestamptz '{LIMIT}+00', true)")
def unclosed(spark, sf_dir):
    return ingest.drop_unclosed(ticked(spark, sf_dir), LIMIT).select("symbol", "date", "close")


STEP = "(date + case isodow(date) when 5 then 3 when 6 then 2 else 1 end)"


@add("src_20_next_session_close", PATH + f" select {TICK} as symbol, date, ({CLOSES.replace('date::timestamp', STEP + '::timestamp')} at time zone 'UTC') as closes from bars")
def next_close(spark, sf_dir):
    return ticked(spark, sf_dir).select("symbol", "date", ingest.next_session_close("symbol", "date").cast("timestamp_ntz").alias("closes"))


RULES = ["duplicate_dates", *[f"{c}_missing" for c in ingest.PRICES], *[f"{c}_not_positive" for c in ingest.PRICES], "volume_negative", "low_above_body", "high_below_body"]


@add("src_21_contract", BROKEN + " select symbol, (count(*) - count(distinct date))::bigint as duplicate_dates, " + ", ".join(f"count(*) filter ({c} is null)::bigint as {c}_missing, count(*) filter ({c} <= 0)::bigint as {c}_not_positive" for c in ingest.PRICES) + ", count(*) filter (volume < 0)::bigint as volume_negative, count(*) filter (low > least(open, close))::bigint as low_above_body, count(*) filter (high < greatest(open, close))::bigint as high_below_body from br group by symbol")
def contract(spark, sf_dir):
    return ingest.violations(broken(spark, sf_dir))


@add("src_22_synthetic_market")
def market(spark, sf_dir):
    return synthetic.generate_market(spark, SyntheticConfig(n_days=500), ("AAA", "BBB"))


@add("src_23_synthetic_ohlcv")
def ohlcv(spark, sf_dir):
    return ingest.validate(synthetic.generate_ohlcv(spark, SyntheticConfig(n_days=300)))


@add("src_28_theoretical_ic")
def theoretical(spark, sf_dir):
    return rounded(synthetic.theoretical_ic(synthetic.generate_market(spark, SyntheticConfig(n_days=1000), ("AAA", "BBB"))))


def written_universe(spark, sf_dir):
    """The price path in CSV folders, one a symbol, with differing column orders and header names, and a further column in one of them."""
    bars, top = adapters.price_path(spark, sf_dir), new_folder(spark, "universe")
    shapes = {"A": ["date", "open", "high", "low", "close", "volume"], "N": ["close", "date", "volume", "open", "low", "high"], "R": ["volume", "low", "date", "high", "close", "open"]}
    for symbol, order in shapes.items():
        own = bars.where(F.col("symbol") == symbol).select(*order)
        if symbol == "N":
            own = own.withColumn("Note", F.concat(F.lit("n"), F.dayofmonth("date"))).withColumnRenamed("volume", "Vol").withColumnRenamed("date", "Timestamp")
        own.write.option("header", True).csv(f"{top}/symbol={symbol}")
    return top


@add("src_01_csv_scan", PATH + " select symbol, date, open, high, low, close, volume, case when symbol = 'N' then 'n' || day(date) end as note from bars")
def csv_scan(spark, sf_dir):
    """Files of differing header order in one scan; the further column stays text."""
    top = written_universe(spark, sf_dir)
    return ingest.load_csv(spark, [f"{top}/symbol={s}" for s in "ANR"], check=True)


@add("src_05_universe_scan", PATH + " select symbol, count(*)::bigint as bars, min(date) as first_bar, max(date) as last_bar, round(sum(close), 4) as closes from bars group by symbol union all select 'FETCHED', count(*)::bigint, min(date), max(date), round(sum(close), 4) from bars where symbol = 'A'")
def universe_scan(spark, sf_dir):
    """A folder, a ticker that is fetched (and read from its cache the second time), and one that cannot be fetched."""
    top, cache = written_universe(spark, sf_dir), new_folder(spark, "cache")
    bars = adapters.price_path(spark, sf_dir)

    def fetch(ticker):
        if ticker == "GONE":
            raise ConnectionError(ticker)
        return bars.where("symbol = 'A'")

    for source in (fetch, None):
        rows = ingest.load_universe(spark, top, ["FETCHED", "GONE"], source, cache, skip_errors=True)
    return rows.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("date").alias("first_bar"), F.max("date").alias("last_bar"), F.round(F.sum("close"), 4).alias("closes"))


@add("src_03_csv_sink", PATH + " select symbol, date, open, high, low, close, volume from bars")
def csv_sink(spark, sf_dir):
    path = new_folder(spark, "sink")
    ingest.save_csv(adapters.price_path(spark, sf_dir), path)
    return ingest.load_universe(spark, path).select("symbol", "date", "open", "high", "low", "close", "volume")


@add("src_06_directory_expansion", "select * from (values (0, 'A'), (1, 'N'), (2, 'R'), (3, 'A')) t(position, symbol)")
def expansion(spark, sf_dir):
    top = written_universe(spark, sf_dir)
    found = ingest.expand_paths(spark, [top, f"{top}/symbol=A/*.csv"])
    return spark.createDataFrame([(i, ingest.stem(p if "*" not in p else p.rsplit("/", 1)[0])) for i, p in enumerate(found)], "position int, symbol string")


@add("src_07_price_source_switch", PATH + " select 'files' as source, count(*)::bigint as bars from bars where symbol = 'A' union all select 'synthetic', 300")
def price_source(spark, sf_dir):
    files = ingest.load_prices(spark, f"{written_universe(spark, sf_dir)}/symbol=A")
    made = ingest.load_prices(spark, None, SyntheticConfig(n_days=300))
    return files.select(F.lit("files").alias("source")).unionByName(made.select(F.lit("synthetic").alias("source"))).groupBy("source").agg(F.count("*").alias("bars"))


@add("src_09_fetch_with_retry", PATH + " select symbol, date, close, 3 as attempts from bars where symbol = 'A'")
def retried(spark, sf_dir):
    bars, tries = adapters.price_path(spark, sf_dir), []

    def flaky(ticker):
        tries.append(ticker)
        if len(tries) < 3:
            raise ConnectionError(ticker)
        return bars.where(F.col("symbol") == ticker)

    out = ingest.fetch_with_retry(flaky, "A", 2)
    return out.select("symbol", "date", "close", F.lit(len(tries)).alias("attempts"))


@add("src_10_fetch_job", PATH + " select symbol, count(*)::bigint as bars, '' as error from bars where symbol in ('A', 'N') group by symbol union all select 'X', 0, 'no such ticker'")
def fetch_job(spark, sf_dir):
    bars = adapters.price_path(spark, sf_dir)

    def fetch(ticker):
        if ticker == "X":
            raise LookupError("no such ticker")
        return bars.where(F.col("symbol") == ticker)

    got, errors = ingest.fetch_all(fetch, ["A", "X", "N"], skip_errors=True)
    failed = spark.createDataFrame([(t, 0, e) for t, e in errors.items()], "symbol string, bars bigint, error string")
    return got.groupBy("symbol").agg(F.count("*").alias("bars")).withColumn("error", F.lit("")).unionByName(failed)


@add("src_04_vendor_connector", PATH + " select symbol, date, open, greatest(high, open, close) as high, least(low, open, close) as low, close, volume from bars where symbol in ('A', 'N') and date <= date '1997-06-16'")
def vendor(spark, sf_dir):
    """A stub vendor through the data source, then the repairs: no unclosed session, no untraded rows, extremes widened, the contract kept."""
    rows = {}
    for r in adapters.price_path(spark, sf_dir).where("symbol in ('A', 'N') and date <= '1997-06-17'").collect():
        rows.setdefault(r["symbol"], []).append((r["date"], r["open"], r["high"] * (0.999 if r["date"].day == 9 else 1.0), r["low"], r["close"], r["volume"]))
    top = {s: {x[0]: x for x in v} for s, v in rows.items()}
    stub = {s: list(v.values()) for s, v in top.items()}
    spark.dataSource.register(ingest.vendor_source(lambda ticker: iter(stub[ticker])))
    bars = spark.read.format("vendor_bars").option("tickers", "A,N").load()
    cleaned = ingest.clean_bars(bars, "1997-06-17 12:00:00")
    fixed = F.dayofmonth("date") == 9
    return cleaned.withColumn("high", F.when(fixed, F.greatest(F.round(F.col("high") / 0.999, 9), "open", "close")).otherwise(F.col("high")))


#: Moments of the synthetic market against their closed forms, within five standard errors of 400 symbols.
@add("src_24_regime_simulator", "select * from (values ('bars in the first regime', true), ('bars left per bar', true), ('first bar', true)) t(moment, holds)")
def regimes(spark, sf_dir):
    c = SyntheticConfig(n_days=400)
    rows = synthetic.generate_market(spark, c, tuple(f"S{i}" for i in range(400)))
    w = Window.partitionBy("symbol").orderBy("date")
    moved = rows.withColumn("before", F.lag("regime").over(w)).withColumn("n", F.row_number().over(w))
    leave = moved.where("before is not null").groupBy("before").agg(F.avg((F.col("regime") != F.col("before")).cast("double")).alias("share"), F.count("*").alias("k"))
    p = F.get(F.array(*[F.lit(1 - x) for x in c.regime_persistence]), F.col("before"))
    fine = leave.agg(F.bool_and(F.abs(F.col("share") - p) < 5 * F.sqrt(p * (1 - p) / F.col("k"))).alias("holds"))
    exits = [1 - x for x in c.regime_persistence]  # from a regime, each of the two others alike: the stationary share is proportional to 1 / exit
    first = (1 / exits[0]) / sum(1 / x for x in exits)
    share = moved.where("n > 200").agg((F.abs(F.avg((F.col("regime") == 0).cast("double")) - first) < 0.05).alias("holds"))
    start = moved.where("n = 1").agg(F.bool_and(F.col("regime") == 1).alias("holds"))
    named = lambda df, name: df.select(F.lit(name).alias("moment"), "holds")
    return named(share, "bars in the first regime").unionByName(named(fine, "bars left per bar")).unionByName(named(start, "first bar"))


@add("src_25_return_simulator", "select * from (values ('mean of a bar', true), ('mean variance multiplier', true), ('first multiplier', true), ('planted edge', true)) t(moment, holds)")
def returns(spark, sf_dir):
    """The conditional mean rebuilt from the returns by window, and the volatility multiplier's mean of one."""
    c = SyntheticConfig(n_days=400)
    w = Window.partitionBy("symbol").orderBy("date")
    rows = synthetic.generate_market(spark, c, tuple(f"S{i}" for i in range(300)))
    drift, vol = (F.get(F.array(*[F.lit(x) for x in v]), F.col("regime")) for v in (c.regime_drifts, c.regime_vols))
    rows = rows.withColumn("n", F.row_number().over(w)).withColumn("h", F.pow(F.col("volatility") / vol, 2) * 252)
    r = F.coalesce(F.col("log_return"), F.lit(0.0))
    past = F.sum(r).over(w.rowsBetween(-5, -1))
    rows = rows.withColumn("rebuilt", drift / 252 + c.ar1 * F.lag("log_return").over(w) + c.reversion * past)
    checks = rows.agg(
        (F.max(F.when(F.col("n") > 8, F.abs(F.col("rebuilt") - F.col("conditional_mean")))) < 1e-4).alias("mean of a bar"),  # prices have four digits
        (F.abs(F.avg("h") - 1) < 0.05).alias("mean variance multiplier"),
        F.bool_and(F.when(F.col("n") == 1, F.abs(F.col("h") - (1 - c.garch_alpha)) < 1e-9)).alias("first multiplier"),
        (F.corr("conditional_mean", "log_return") > 0.05).alias("planted edge"),
    )
    return checks.unpivot([], checks.columns, "moment", "holds")


@add("src_26_shock_draw", "select * from (values ('normal', 'mean', true), ('normal', 'variance', true), ('normal', 'kurtosis', true), ('student', 'mean', true), ('student', 'variance', true), ('student', 'kurtosis', true)) t(kind, moment, holds)")
def shock(spark, sf_dir):
    """Unit variance for both, and the excess kurtosis 6 / (df - 4) of a t with 12 degrees of freedom."""
    out = []
    for kind, df, excess in (("normal", None, 0.0), ("student", 12.0, 0.75)):
        d = synthetic.draws(list(range(200)), SyntheticConfig(n_days=2000, fat_tail_df=df))
        z = (d["shock"] / d["tail"]).ravel()
        kurtosis = ((z - z.mean()) ** 4).mean() / z.var() ** 2 - 3
        out += [(kind, "mean", bool(abs(z.mean()) < 0.01)), (kind, "variance", bool(abs(z.var() - 1) < 0.02)), (kind, "kurtosis", bool(abs(kurtosis - excess) < 0.15))]
    return spark.createDataFrame(out, "kind string, moment string, holds boolean")


@add("src_27_ohlcv_from_returns", "select * from (values ('gap', true), ('upper wick', true), ('lower wick', true), ('log volume', true), ('close from returns', true), ('contract', true)) t(moment, holds)")
def bars_from_returns(spark, sf_dir):
    """Half-normal wicks of mean range * sqrt(2 / pi) and normal gaps, in units of the bar's volatility."""
    c = SyntheticConfig(n_days=400)
    w = Window.partitionBy("symbol").orderBy("date")
    rows = synthetic.generate_market(spark, c, tuple(f"S{i}" for i in range(300)))
    rows = rows.withColumn("before", F.coalesce(F.lag("close").over(w), F.lit(c.initial_price)))
    rows = rows.withColumn("gap", F.log(F.col("open") / F.col("before")) / F.col("volatility"))
    wick = c.intraday_range_mult * math.sqrt(2 / math.pi)
    broken = ingest.violations(rows)
    ok = rows.agg(
        (F.abs(F.stddev_pop("gap") - c.overnight_gap_vol) < 0.01).alias("gap"),
        (F.abs(F.avg(F.log(F.col("high") / F.greatest("open", "close")) / F.col("volatility")) - wick) < 0.03).alias("upper wick"),
        (F.abs(F.avg(F.log(F.least("open", "close") / F.col("low")) / F.col("volatility")) - wick) < 0.03).alias("lower wick"),
        (F.abs(F.avg(F.log("volume")) - math.log(c.base_volume)) < 0.03).alias("log volume"),
        F.bool_and(F.abs(F.log(F.col("close") / F.col("before")) - F.coalesce("log_return", F.log(F.col("close") / c.initial_price))) < 1e-9).alias("close from returns"),
    ).unpivot([], ["gap", "upper wick", "lower wick", "log volume", "close from returns"], "moment", "holds")
    sums = sum(F.col(x) for x in broken.columns if x != "symbol")
    return ok.unionByName(broken.agg(F.sum(sums).alias("n")).select(F.lit("contract").alias("moment"), (F.col("n") == 0).alias("holds")))
