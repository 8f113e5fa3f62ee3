"""Price bars from the star-schema tables.

raw_bars: one bar for each return flag and ship day. price_path: the same calendar with
moves below 2 % a bar, for whatever compounds. segment_bars: five market segments with
differing calendars. hourly_bars: events by hour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.core import by_symbol, running


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _money(c: str):
    return F.col(c).cast("decimal(18,2)")


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), _money("l_extendedprice").alias("e"), _money("l_quantity").alias("q"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "e")
    bars = lines.groupBy("symbol", "date").agg(F.min_by("px", order).alias("open"), F.max("px").alias("h"), F.min("px").alias("l"), F.sum("e").cast("double").alias("e"), F.sum("q").cast("double").alias("volume"))
    close = F.round(F.col("e") / F.col("volume"), 6)
    bars = bars.withColumn("close", close).withColumn("open", F.round("open", 6))
    return bars.select("symbol", "date", "open", F.greatest(F.round("h", 6), "open", "close").alias("high"), F.least(F.round("l", 6), "open", "close").alias("low"), "close", "volume")


def _path(values: DataFrame) -> DataFrame:
    """symbol, date, vwap, volume -> bars whose close compounds gently."""
    x = F.log("vwap") - F.avg(F.log("vwap")).over(Window.partitionBy("symbol"))
    bars = values.withColumn("x", x).withColumn("r", F.round(0.02 * F.col("x") / (1 + F.abs("x")), 6))
    bars = bars.withColumn("close", F.round(100 * F.exp(F.sum("r").over(running())), 6))
    bars = bars.withColumn("open", F.coalesce(F.lag("close").over(by_symbol()), F.lit(100.0)))
    return bars.select("symbol", "date", "open", F.round(F.greatest("open", "close") * 1.002, 9).alias("high"), F.round(F.least("open", "close") * 0.998, 9).alias("low"), "close", "volume")


def price_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), _money("l_extendedprice").alias("e"), _money("l_quantity").alias("q"))
    sums = lines.groupBy("symbol", "date").agg(F.sum("e").cast("double").alias("e"), F.sum("q").cast("double").alias("volume"))
    return _path(sums.select("symbol", "date", (F.col("e") / F.col("volume")).alias("vwap"), "volume"))


def segment_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("date"), _money("o_totalprice").alias("e"))
    customer = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("symbol"))
    sums = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("symbol", "date").agg(F.sum("e").cast("double").alias("e"), F.count("*").cast("double").alias("volume"))
    return _path(sums.select("symbol", "date", (F.col("e") / F.col("volume")).alias("vwap"), "volume"))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").where("value > 0").select(F.col("event_type").alias("symbol"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), "ts", "event_id", "value")
    at = F.struct("ts", "event_id")
    return events.groupBy("symbol", "hour").agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").cast("double").alias("volume"))


_PATH_SQL = """
px_x as (select *, ln(vwap) - avg(ln(vwap)) over (partition by symbol) as x from px_v),
px_r as (select symbol, date, volume, round(0.02 * x / (1 + abs(x)), 6) as r from px_x),
px_c as (select symbol, date, volume, round(100 * exp(sum(r) over (partition by symbol order by date)), 6) as close from px_r),
px_o as (select *, coalesce(lag(close) over (partition by symbol order by date), 100.0) as open from px_c),
bars as (select symbol, date, open, round(greatest(open, close) * 1.002, 9) as high, round(least(open, close) * 0.998, 9) as low, close, volume from px_o)
"""
PRICE_PATH_SQL = (
    """
px_s as (
  select l_returnflag as symbol, cast(l_shipdate as date) as date, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as e,
         cast(sum(cast(l_quantity as decimal(18,2))) as double) as volume
  from lineitem group by 1, 2),
px_v as (select symbol, date, e / volume as vwap, volume from px_s),"""
    + _PATH_SQL
)
SEGMENT_SQL = (
    """
px_s as (
  select c_mktsegment as symbol, cast(o_orderdate as date) as date, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as e,
         cast(count(*) as double) as volume
  from orders join customer on o_custkey = c_custkey group by 1, 2),
px_v as (select symbol, date, e / volume as vwap, volume from px_s),"""
    + _PATH_SQL
)
RAW_SQL = """
px_s as (
  select l_returnflag as symbol, cast(l_shipdate as date) as date,
         round(min_by(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_extendedprice as decimal(18,2)))), 6) as open,
         round(max(l_extendedprice / l_quantity), 6) as h, round(min(l_extendedprice / l_quantity), 6) as l,
         round(cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / cast(sum(cast(l_quantity as decimal(18,2))) as double), 6) as close,
         cast(sum(cast(l_quantity as decimal(18,2))) as double) as volume
  from lineitem group by 1, 2),
bars as (select symbol, date, open, greatest(h, open, close) as high, least(l, open, close) as low, close, volume from px_s)
"""
HOURLY_SQL = """
bars as (
  select event_type as symbol, date_trunc('hour', ts) as hour, min_by(value, (ts, event_id)) as open, max(value) as high, min(value) as low,
         max_by(value, (ts, event_id)) as close, cast(count(*) as double) as volume
  from events where value > 0 group by 1, 2)
"""
