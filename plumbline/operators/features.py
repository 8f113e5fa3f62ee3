"""Causal features, forward targets and the aligned data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import FeatureConfig
from plumbline.functions import indicators as ind
from plumbline.functions.core import by_symbol, clean, full, safe_divide, trailing


def base_columns(bars: DataFrame) -> DataFrame:
    """The one-bar columns that other windows read."""
    w = by_symbol()
    previous = F.lag("close").over(w)
    out = bars.withColumn("__change", F.col("close") - previous).withColumn("__r1", F.log("close") - F.log(previous)).withColumn("__tr", ind.true_range(previous))
    return out.withColumn("__lv", F.when(F.col("volume") > 0, F.log(F.when(F.col("volume") > 0, F.col("volume")))))


def feature_names(config: FeatureConfig | None = None) -> list[str]:
    c = config or FeatureConfig()
    names = [f"ret_{k}d" for k in c.return_lags] + [f"close_over_sma_{k}" for k in c.sma_windows] + [f"close_over_ema_{k}" for k in c.ema_windows] + [f"roc_{k}" for k in c.momentum_windows] + [f"volatility_{k}" for k in sorted(c.volatility_windows)]
    names += (["volatility_ratio"] if len(c.volatility_windows) > 1 else []) + [f"rsi_{c.rsi_window}", "macd_norm", "macd_hist_norm", "bb_percent_b", "bb_bandwidth", "stoch_k", "stoch_d", "atr_norm", "donchian_position"]
    return names + ([f"volume_z_{k}" for k in c.volume_windows] + [f"obv_slope_{max(c.volume_windows)}"] if c.include_volume_features else [])


def build_features(bars: DataFrame, config: FeatureConfig | None = None) -> DataFrame:
    """bars with one column for each feature; warm-up and non-finite values are NULL."""
    c = config or FeatureConfig()
    w = by_symbol()
    vols = sorted(c.volatility_windows)
    fast, slow, signal = c.macd
    k_window, d_window = c.stochastic
    bands = ind.bollinger("close", *c.bollinger)
    first = {f"ret_{k}d": ind.log_return("close", k) for k in c.return_lags}
    first |= {f"close_over_sma_{k}": safe_divide("close", ind.sma("close", k)) - 1 for k in c.sma_windows}
    first |= {f"close_over_ema_{k}": safe_divide("close", ind.ema("close", k)) - 1 for k in c.ema_windows}
    first |= {f"roc_{k}": ind.roc("close", k) for k in c.momentum_windows}
    first |= {f"volatility_{k}": ind.realised_volatility("__r1", k) for k in vols}
    first |= {f"rsi_{c.rsi_window}": ind.rsi("__change", c.rsi_window), "__macd": ind.macd_line("close", fast, slow), "bb_percent_b": bands["bb_percent_b"], "bb_bandwidth": bands["bb_bandwidth"], "stoch_k": ind.stochastic_k(k_window), "atr_norm": safe_divide(ind.atr("__tr", c.atr_window), "close"), "donchian_position": ind.donchian_position(c.bollinger[0]), "__obv": ind.obv("__change")}
    if c.include_volume_features:
        first |= {f"volume_z_{k}": safe_divide(F.col("__lv") - full(F.avg("__lv"), "__lv", k, trailing(k)), full(F.stddev_samp("__lv"), "__lv", k, trailing(k))) for k in c.volume_windows}
    out = base_columns(bars).withColumns(first)
    second = {"macd_norm": safe_divide("__macd", "close"), "macd_hist_norm": safe_divide(F.col("__macd") - ind.ema("__macd", signal), "close"), "stoch_d": ind.sma("stoch_k", d_window)}
    if len(vols) > 1:
        second["volatility_ratio"] = safe_divide(f"volatility_{vols[0]}", f"volatility_{vols[-1]}")
    if c.include_volume_features:
        m = max(c.volume_windows)
        second[f"obv_slope_{m}"] = safe_divide(F.col("__obv") - F.lag("__obv", m).over(w), full(F.avg("volume"), "volume", m, trailing(m)) * m)
    out = out.withColumns(second)
    names = feature_names(c)
    return out.select(*bars.columns, *[clean(n).alias(n) for n in names])


def build_targets(bars: DataFrame, horizon: int = 1, neutral_band: float = 0.0) -> DataFrame:
    """bars with forward_return and direction (1, 0, or NULL inside the neutral band)."""
    forward = F.log(F.lead("close", horizon).over(by_symbol())) - F.log("close")
    out = bars.withColumn("forward_return", forward)
    direction = F.when(F.col("forward_return").isNull(), None)
    if neutral_band > 0:
        direction = direction.when(F.abs("forward_return") <= neutral_band, None)
    return out.withColumn("direction", direction.when(F.col("forward_return") > 0, 1.0).otherwise(0.0))


def build_dataset(bars: DataFrame, config: FeatureConfig | None = None, horizon: int = 1) -> DataFrame:
    """Rows with all features and a forward return, with their position pos (from 0) in the symbol."""
    c = config or FeatureConfig()
    names = feature_names(c)
    rows = build_targets(build_features(bars, c), horizon).dropna(subset=[*names, "forward_return"])
    return rows.select("symbol", "date", (F.row_number().over(by_symbol()) - 1).alias("pos"), *names, "forward_return", "direction", "close")


def slice_positions(dataset: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows with start <= pos < stop."""
    return dataset.where((F.col("pos") >= start) & (F.col("pos") < stop))


def target(classification: bool) -> str:
    return "direction" if classification else "forward_return"
