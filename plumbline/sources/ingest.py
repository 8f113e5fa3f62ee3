"""CSV scans and sinks, header names, repairs, sessions and the OHLCV contract."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
NUMBERS = (*PRICES, "volume", "adj_close")
#: Header aliases, names of the date column, exchanges by ticker suffix.
ALIASES = {"adj close": "adj_close", "vol": "volume", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}
DATE_NAMES = ("date", "datetime", "timestamp", "time", "index")
SESSIONS = (("", "America/New_York", "16:00"), ("TW", "Asia/Taipei", "13:30"), ("TWO", "Asia/Taipei", "13:30"))
MAX_UNTRADED, MAX_REPAIR = 0.5, 0.005


def normal_name(name: str) -> str:
    key = name.strip().lower().replace("-", " ")
    return ALIASES.get(key, key).replace(" ", "_")


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normal_name(c) for c in df.columns])


def expand_paths(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """Files in the order given, a folder standing for its *.csv entries by name; the listing is Spark's, so any store that it reads will do."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out: list[str] = []
    for p in [paths] if isinstance(paths, str) else paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(conf)
        if p.endswith(".csv") or "*" in p or fs.getFileStatus(at).isFile():
            out.append(p)
        else:
            inside = sorted(x.getPath().toString() for x in fs.listStatus(at))
            out += [x for x in inside if x.endswith(".csv") or "/symbol=" in x]
    return out


def _headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """Header line -> files that start with it. One row a file comes to the driver, as Spark's own listing does."""
    at = F.monotonically_increasing_id()  # grows along a file's first block
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("at", at)
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("header")).orderBy("file")
    out: dict[str, list[str]] = {}
    for r in first.collect():
        out.setdefault(r["header"], []).append(r["file"])
    return out


def load_csv(spark: SparkSession, path: str | Sequence[str], date_column: str | None = None, symbol: Column | None = None, check: bool = False) -> DataFrame:
    """Bars of one or many CSV files as one long table, columns matched by name file by file.

    The symbol is the file's stem (or its symbol=... folder). Prices and volume are
    numbers; further columns are kept as text. No type is inferred. check: raise
    unless the bars keep the contract.
    """
    out = None
    for files in _headers(spark, [path] if isinstance(path, str) else list(path)).values():
        raw = normalise_columns(spark.read.option("header", True).csv(files))
        names = [normal_name(date_column)] if date_column else [c for c in DATE_NAMES if c in raw.columns]
        if not names or names[0] not in raw.columns:
            raise ValueError(f"no date column among {raw.columns}")
        file = F.input_file_name()
        stem = F.coalesce(F.nullif(F.regexp_extract(file, r"/symbol=([^/]+)/", 1), F.lit("")), F.regexp_extract(file, r"([^/]+)\.csv$", 1))
        rest = [F.col(f"`{c}`").cast("double").alias(c) if c in NUMBERS else F.col(f"`{c}`") for c in raw.columns if c not in (names[0], "symbol")]
        one = raw.select((symbol if symbol is not None else F.url_decode(stem)).alias("symbol"), F.to_date(F.col(f"`{names[0]}`").cast("timestamp")).alias("date"), *rest)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no rows in {path}")
    return validate(out) if check else out


def load_universe(spark: SparkSession, data_paths: str | Sequence[str] | None = None, tickers: Sequence[str] | None = None, fetch: Callable[[str], DataFrame] | None = None, cache_dir: str | None = None, skip_errors: bool = False) -> DataFrame:
    """Bars of files, folders of files and fetched tickers as one long table.

    A symbol that two sources hold raises, and so does a (symbol, date) that occurs
    twice. cache_dir: a fetched ticker is written there and read from there the next
    time. skip_errors: leave out tickers that cannot be fetched.
    """
    if not data_paths and not tickers:
        raise ValueError("a universe needs data_paths, tickers or both")
    out = None
    if data_paths:
        files = expand_paths(spark, data_paths)
        stems = [stem(f) for f in files if "*" not in f]
        again = {x for x in stems if stems.count(x) > 1}
        if again:
            raise ValueError(f"{sorted(again)[0]} comes from more than one file")
        out = load_csv(spark, files)
    for t in tickers or ():
        if out is not None and not out.where(F.col("symbol") == t).isEmpty():
            raise ValueError(f"{t} comes from more than one source")
        try:
            one = _fetched(spark, t, fetch, cache_dir)
        except Exception:
            if skip_errors:
                continue
            raise
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no ticker could be fetched")
    twice = out.groupBy("symbol", "date").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['symbol']} has {twice[0]['date']} more than once")
    return out


def _fetched(spark: SparkSession, ticker: str, fetch: Callable[[str], DataFrame] | None, cache_dir: str | None) -> DataFrame:
    if cache_dir:
        path = f"{cache_dir.rstrip('/')}/{ticker.replace('/', '_')}.csv"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return load_csv(spark, path, symbol=F.lit(ticker))
    if fetch is None:
        raise ValueError(f"nothing fetches {ticker}")
    bars = fetch(ticker).drop("symbol")
    if not cache_dir:
        return bars.select(F.lit(ticker).alias("symbol"), "*")
    bars.sortWithinPartitions("date").write.option("header", True).csv(path)
    return load_csv(spark, path, symbol=F.lit(ticker))


def save_csv(bars: DataFrame, path: str) -> None:
    """One folder of CSV files for each symbol, in date order."""
    bars.repartition("symbol").sortWithinPartitions("symbol", "date").write.option("header", True).partitionBy("symbol").csv(path)


def load_prices(spark: SparkSession, path: str | None = None, config=None) -> DataFrame:
    from plumbline.sources.synthetic import generate_ohlcv

    return load_csv(spark, path) if path else generate_ohlcv(spark, config)


def fetch_with_retry(fetch: Callable[[str], DataFrame], ticker: str, retries: int = 2, wait: float = 0.0) -> DataFrame:
    for attempt in range(retries + 1):
        try:
            return fetch(ticker)
        except Exception:
            if attempt == retries:
                raise
            time.sleep(wait)
    raise AssertionError


def fetch_all(fetch: Callable[[str], DataFrame], tickers: Sequence[str], skip_errors: bool = False, now: str | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Bars of every ticker that could be fetched, and the errors of the others."""
    out, errors = None, {}
    for t in tickers:
        try:
            one = clean_bars(fetch_with_retry(fetch, t), now)
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        except Exception as e:
            if not skip_errors:
                raise
            errors[t] = str(e)
    return out, errors


def clean_bars(bars: DataFrame, now: str | None = None) -> DataFrame:
    out = drop_unclosed(bars, now) if now else bars
    return validate(clamp_extremes(drop_untraded(out)))


def vendor_source(fetch: Callable[[str], list[tuple]]):
    """A Python data source class over a vendor's fetch function: one partition a ticker (option `tickers`, comma-separated)."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.tickers = [t.strip() for t in options.get("tickers", "").split(",") if t.strip()]

        def partitions(self):
            return [InputPartition(t) for t in self.tickers]

        def read(self, partition):
            for row in fetch(partition.value):
                yield (partition.value, *row)

    class Vendor(DataSource):
        @classmethod
        def name(cls):
            return "vendor_bars"

        def schema(self):
            return "symbol string, date date, open double, high double, low double, close double, volume double"

        def reader(self, schema):
            return Reader(self.options)

    return Vendor


def read_universe(lines: DataFrame) -> DataFrame:
    """Tickers of text lines (value): before the comment sign, blank lines dropped."""
    return lines.select(F.trim(F.split("value", "#")[0]).alias("ticker")).where("ticker <> ''")


def symbol_names(lines: DataFrame) -> DataFrame:
    """ticker and the first word of its comment."""
    out = lines.select(F.trim(F.split("value", "#")[0]).alias("ticker"), F.regexp_extract("value", r"#\s*(\S+)", 1).alias("name"))
    return out.where("ticker <> '' and name <> ''")


def load_notes(rows: DataFrame) -> DataFrame:
    """Notes (all strings) with their date parsed, in date order."""
    missing = {"date", "symbols", "category", "note"} - set(rows.columns)
    if missing:
        raise ValueError(f"notes lack {sorted(missing)}")
    return rows.withColumn("date", F.to_date("date")).orderBy("date")


def drop_untraded(bars: DataFrame, check: bool = True) -> DataFrame:
    """Without bars that lack a price; raises where more than half of a symbol's go."""
    gone = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()
    if check:
        bad = bars.groupBy("symbol").agg(F.avg(gone.cast("double")).alias("share")).where(F.col("share") > MAX_UNTRADED).limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0]['symbol']}: {bad[0]['share']:.0%} of the bars have no price")
    return bars.where(~gone)


def clamp_extremes(bars: DataFrame, tolerance: float = MAX_REPAIR, check: bool = True) -> DataFrame:
    """High and low widened to the body where they miss it by at most the tolerance; more raises."""
    top, low = F.greatest("open", "close"), F.least("open", "close")
    miss = F.greatest(top - F.col("high"), F.col("low") - low, F.lit(0.0)) / F.abs("close")
    if check:
        worst = bars.groupBy("symbol").agg(F.max(miss).alias("m")).where(F.col("m") > tolerance).limit(1).collect()
        if worst:
            raise ValueError(f"{worst[0]['symbol']}: a bar's extreme misses its body by {worst[0]['m']:.2%}")
    return bars.withColumn("high", F.greatest("high", "open", "close")).withColumn("low", F.least("low", "open", "close"))


def exchange(symbol: str | Column) -> tuple[Column, Column]:
    """(time zone, close time) of a ticker's exchange; NULL for an unknown suffix."""
    s = F.col(symbol) if isinstance(symbol, str) else symbol
    suffix = F.upper(F.regexp_extract(s, r"\.([^.]+)$", 1))
    zone = close = None
    for key, z, t in SESSIONS:
        zone = F.when(suffix == key, z) if zone is None else zone.when(suffix == key, z)
        close = F.when(suffix == key, t) if close is None else close.when(suffix == key, t)
    return zone, close


def session_close(symbol: str | Column, date: str | Column) -> Column:
    """UTC instant at which the session of a date closes; NULL for an unknown exchange."""
    zone, close = exchange(symbol)
    d = F.col(date) if isinstance(date, str) else date
    local = F.to_timestamp(F.concat(d.cast("string"), F.lit(" "), close))
    return F.when(zone.isNotNull(), F.to_utc_timestamp(local, zone))


def next_session_close(symbol: str | Column, date: str | Column) -> Column:
    """UTC close of the next weekday's session."""
    d = F.col(date) if isinstance(date, str) else date
    step = F.when(F.weekday(d) == 4, 3).when(F.weekday(d) == 5, 2).otherwise(1)
    return session_close(symbol, F.date_add(d, step))


def drop_unclosed(bars: DataFrame, now: str) -> DataFrame:
    """Without bars whose session has not closed by now (UTC); bars of unknown exchanges stay. A symbol that would lose all bars raises."""
    closes = session_close("symbol", "date")
    kept = bars.withColumn("__closes", closes).where(F.col("__closes").isNull() | (F.col("__closes") <= F.lit(now).cast("timestamp"))).drop("__closes")
    lost = bars.select("symbol").distinct().join(kept.select("symbol").distinct(), "symbol", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"{lost[0]['symbol']}: no session has closed")
    return kept


def violations(bars: DataFrame) -> DataFrame:
    """For each symbol the number of rows that break each rule of the contract."""
    bad = {f"{c}_missing": F.col(c).isNull() | F.isnan(c) for c in PRICES} | {f"{c}_not_positive": F.col(c) <= 0 for c in PRICES}
    bad |= {"volume_negative": F.col("volume") < 0, "low_above_body": F.col("low") > F.least("open", "close"), "high_below_body": F.col("high") < F.greatest("open", "close")}
    counts = bars.groupBy("symbol").agg((F.count("*") - F.count_distinct("date")).alias("duplicate_dates"), *[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in bad.items()])
    return counts


def validate(bars: DataFrame) -> DataFrame:
    """bars, if they keep the contract; raises with the first broken rule otherwise."""
    missing = [c for c in ("symbol", "date", *PRICES, "volume") if c not in bars.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    rows = violations(bars).orderBy("symbol").collect()
    if not rows:
        raise ValueError("there are no bars")
    for row in rows:
        for rule, n in row.asDict().items():
            if rule != "symbol" and n:
                raise ValueError(f"{row['symbol']}: {n} rows with {rule.replace('_', ' ')}")
    return bars


def stem(path: str) -> str:
    """The symbol that a path stands for."""
    return re.sub(r"^symbol=|\.csv$", "", path.rstrip("/").rsplit("/", 1)[-1])
