"""IND and FEA queries over price-path bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import indicators as ind
from plumbline.functions.core import by_symbol
from plumbline.operators import features as fea
from plumbline.queries.base import ANNUAL, PATH, W, add, frame, rolled, rounded, smoothed
from plumbline.sources.adapters import price_path

BASE = PATH + f""",
b0 as (select *, lag(close) over {W} as pc from bars),
b1 as (select *, close - pc as change, ln(close) - ln(pc) as r1, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) as tr,
              case when volume > 0 then ln(volume) end as lv from b0),
b2 as (select *, case when change is not null then greatest(change, 0.0) end as gain, case when change is not null then greatest(-change, 0.0) end as loss from b1)
"""
A14 = 1 / 14
BANDS = f"{rolled('avg', 'close', 20)} as mid, {rolled('stddev_pop', 'close', 20)} as dev"
CHANNEL = "case when count(low) over {f} = {n} then min(low) over {f} end as ll, case when count(high) over {f} = {n} then max(high) over {f} end as hh"


def _channel(n: int) -> str:
    return CHANNEL.format(f=frame(n), n=n)


MACD_SQL = f"""
m1 as (select *, {smoothed('close', 2 / 13, 12)} - {smoothed('close', 2 / 27, 26)} as macd from b2),
m2 as (select *, {smoothed('macd', 2 / 10, 9)} as macd_signal from m1)
"""


def _one(name: str, column, value_sql: str, more: str = "", places: int = 6) -> None:
    def run(spark, sf_dir):
        bars = fea.base_columns(price_path(spark, sf_dir))
        return bars.select("symbol", "date", F.round(column(), places).alias("value"))

    src = "b2" if not more else more.split(" as ")[0].strip().split()[-1]
    add(name, BASE + (f", {more}" if more else "") + f"select symbol, date, round({value_sql}, {places}) as value from {src}")(run)


_one("ind_01_log_return", lambda: ind.log_return("close", 5), f"ln(close) - ln(lag(close, 5) over {W})")
_one("ind_02_sma", lambda: ind.sma("close", 20), rolled("avg", "close", 20), places=8)
_one("ind_03_ema", lambda: ind.ema("close", 26), smoothed("close", 2 / 27, 26))
_one("ind_04_wilder", lambda: ind.wilder("__change", 14), smoothed("change", A14, 14))
_one("ind_05_roc", lambda: ind.roc("close", 10), f"close / nullif(lag(close, 10) over {W}, 0) - 1")
_one("ind_06_realised_volatility", lambda: ind.realised_volatility("__r1", 20), f"({rolled('stddev_samp', 'r1', 20)}) * {ANNUAL}")
_one("ind_07_rsi", lambda: ind.rsi("__change", 14), "case when g is null then null when l = 0 and g = 0 then 50.0 when l = 0 then 100.0 else 100.0 - 100.0 / (1.0 + g / nullif(l, 0)) end", f"r9 as (select *, {smoothed('gain', A14, 14)} as g, {smoothed('loss', A14, 14)} as l from b2)")
_one("ind_10_true_range", lambda: F.col("__tr"), "tr")
_one("ind_11_atr", lambda: ind.atr("__tr", 14), smoothed("tr", A14, 14))
_one("ind_13_donchian_position", lambda: ind.donchian_position(20), "case when hh = ll then 0.5 else (close - ll) / nullif(hh - ll, 0) end", f"d9 as (select *, {_channel(20)} from b2)")
_one("ind_14_obv", lambda: ind.obv("__change"), "sum(coalesce(sign(change), 0) * volume) over (partition by symbol order by date rows between unbounded preceding and current row)")


@add("ind_08_macd", BASE + "," + MACD_SQL + "select symbol, date, round(macd, 6) as macd, round(macd_signal, 6) as macd_signal, round(macd - macd_signal, 6) as macd_hist from m2")
def macd(spark, sf_dir):
    line = price_path(spark, sf_dir).withColumn("macd", ind.macd_line())
    return rounded(line.withColumn("macd_signal", ind.ema("macd", 9)).select("symbol", "date", "macd", "macd_signal", (F.col("macd") - F.col("macd_signal")).alias("macd_hist")))


@add("ind_09_bollinger", BASE + f", q as (select *, {BANDS} from b2) select symbol, date, round(mid, 8) as bb_mid, round(mid + 2 * dev, 6) as bb_upper, round(mid - 2 * dev, 6) as bb_lower, round((close - (mid - 2 * dev)) / nullif(4 * dev, 0), 6) as bb_percent_b, round(4 * dev / nullif(mid, 0), 6) as bb_bandwidth from q")
def bollinger(spark, sf_dir):
    return rounded(price_path(spark, sf_dir).select("symbol", "date", *[v.alias(k) for k, v in ind.bollinger().items()]), bb_mid=8)


@add("ind_12_stochastic", BASE + f", q as (select *, {_channel(14)} from b2), k as (select *, case when hh = ll then 50.0 else 100 * (close - ll) / nullif(hh - ll, 0) end as stoch_k from q) select symbol, date, round(stoch_k, 6) as stoch_k, round({rolled('avg', 'stoch_k', 3)}, 6) as stoch_d from k")
def stochastic(spark, sf_dir):
    k = price_path(spark, sf_dir).withColumn("stoch_k", ind.stochastic_k(14))
    return rounded(k.select("symbol", "date", "stoch_k", ind.sma("stoch_k", 3).alias("stoch_d")))


FEATURES_SQL = (
    BASE
    + ","
    + MACD_SQL
    + f""",
f1 as (select *, {BANDS}, {smoothed('gain', A14, 14)} as g, {smoothed('loss', A14, 14)} as l, {smoothed('tr', A14, 14)} as atr,
       sum(coalesce(sign(change), 0) * volume) over (partition by symbol order by date rows between unbounded preceding and current row) as obv,
       case when count(low) over {frame(14)} = 14 then min(low) over {frame(14)} end as ll14, case when count(high) over {frame(14)} = 14 then max(high) over {frame(14)} end as hh14,
       case when count(low) over {frame(20)} = 20 then min(low) over {frame(20)} end as ll20, case when count(high) over {frame(20)} = 20 then max(high) over {frame(20)} end as hh20,
       ({rolled('stddev_samp', 'r1', 5)}) * {ANNUAL} as volatility_5, ({rolled('stddev_samp', 'r1', 20)}) * {ANNUAL} as volatility_20 from m2),
f2 as (select *, case when hh14 = ll14 then 50.0 else 100 * (close - ll14) / nullif(hh14 - ll14, 0) end as stoch_k from f1),
feats as (select symbol, date, close,
  {', '.join(f'ln(close) - ln(lag(close, {k}) over {W}) as ret_{k}d' for k in (1, 2, 3, 5, 10))},
  {', '.join(f'close / nullif({rolled("avg", "close", k)}, 0) - 1 as close_over_sma_{k}' for k in (5, 10, 20, 50))},
  {', '.join(f'close / nullif({smoothed("close", 2 / (k + 1), k)}, 0) - 1 as close_over_ema_{k}' for k in (12, 26))},
  {', '.join(f'close / nullif(lag(close, {k}) over {W}, 0) - 1 as roc_{k}' for k in (5, 10, 20))},
  volatility_5, volatility_20, volatility_5 / nullif(volatility_20, 0) as volatility_ratio,
  case when g is null then null when l = 0 and g = 0 then 50.0 when l = 0 then 100.0 else 100.0 - 100.0 / (1.0 + g / nullif(l, 0)) end as rsi_14,
  macd / nullif(close, 0) as macd_norm, (macd - macd_signal) / nullif(close, 0) as macd_hist_norm,
  (close - (mid - 2 * dev)) / nullif(4 * dev, 0) as bb_percent_b, 4 * dev / nullif(mid, 0) as bb_bandwidth,
  stoch_k, {rolled('avg', 'stoch_k', 3)} as stoch_d, atr / nullif(close, 0) as atr_norm,
  case when hh20 = ll20 then 0.5 else (close - ll20) / nullif(hh20 - ll20, 0) end as donchian_position,
  {', '.join(f'(lv - ({rolled("avg", "lv", k)})) / nullif({rolled("stddev_samp", "lv", k)}, 0) as volume_z_{k}' for k in (5, 20))},
  (obv - lag(obv, 20) over {W}) / nullif(({rolled('avg', 'volume', 20)}) * 20, 0) as obv_slope_20
  from f2)
"""
)
NAMES = fea.feature_names()
ROUNDED = ", ".join(f"round({n}, 5) as {n}" for n in NAMES)


@add("fea_01_feature_columns", FEATURES_SQL + f"select symbol, date, {ROUNDED} from feats")
def feature_columns(spark, sf_dir):
    return rounded(fea.build_features(price_path(spark, sf_dir)).select("symbol", "date", *NAMES), 5)


@add("fea_02_build_features", FEATURES_SQL + "select symbol, count(*)::bigint as bars, " + ", ".join(f"count({n})::bigint as {n}" for n in NAMES) + " from feats group by symbol")
def build_features(spark, sf_dir):
    return fea.build_features(price_path(spark, sf_dir)).groupBy("symbol").agg(F.count("*").alias("bars"), *[F.count(n).alias(n) for n in NAMES])


TARGETS_SQL = f"targets as (select symbol, date, close, ln(lead(close, 5) over {W}) - ln(close) as forward_return from bars)"


@add("fea_03_build_targets", PATH + ", " + TARGETS_SQL + "select symbol, date, round(forward_return, 6) as forward_return, case when forward_return is null or abs(forward_return) <= 0.002 then null when forward_return > 0 then 1.0::double else 0.0::double end as direction from targets")
def build_targets(spark, sf_dir):
    return rounded(fea.build_targets(price_path(spark, sf_dir), 5, 0.002).select("symbol", "date", "forward_return", "direction"))


DATASET_SQL = FEATURES_SQL + f""", ff as (select *, ln(lead(close, 1) over {W}) - ln(close) as forward_return from feats),
ds as (select *, (row_number() over {W} - 1)::int as pos, case when forward_return > 0 then 1.0::double else 0.0::double end as direction from ff where forward_return is not null and {' and '.join(f'{n} is not null' for n in NAMES)})
"""


@add("fea_04_build_dataset", DATASET_SQL + f"select symbol, date, pos, {ROUNDED}, round(forward_return, 5) as forward_return, direction, close from ds")
def build_dataset(spark, sf_dir):
    return rounded(fea.build_dataset(price_path(spark, sf_dir)), 5, close=6)


@add("fea_05_slice", DATASET_SQL + "select symbol, date, pos, close from ds where pos >= 100 and pos < 150")
def slice_dataset(spark, sf_dir):
    return fea.slice_positions(fea.build_dataset(price_path(spark, sf_dir)), 100, 150).select("symbol", "date", "pos", "close")


@add("fea_06_target", DATASET_SQL + "select symbol, date, round(direction, 6) as classification, round(forward_return, 6) as regression from ds")
def targets(spark, sf_dir):
    ds = fea.build_dataset(price_path(spark, sf_dir))
    return rounded(ds.select("symbol", "date", F.col(fea.target(True)).alias("classification"), F.col(fea.target(False)).alias("regression")))


@add("src_29_latent_log_returns", PATH + f"select symbol, date, round(ln(close) - lag(ln(close)) over {W}, 6) as value from bars")
def latent_returns(spark, sf_dir):
    w = by_symbol()
    return price_path(spark, sf_dir).select("symbol", "date", F.round(F.log("close") - F.lag(F.log("close")).over(w), 6).alias("value"))
