"""A synthetic market: a persistent chain of regimes, clustered volatility, fat tails, and a planted edge.

The model of a bar t, for a symbol in regime s:
  h(t) = 1 - a - b + (a z(t-1)^2 + b) h(t-1), from h = 1 and z = 0 before the first bar
  volatility(t) = vol(s) / sqrt(252) * sqrt(h(t))
  mean(t) = drift(s) / 252 + ar1 * r(t-1) + reversion * (r(t-5) + ... + r(t-1))
  r(t) = mean(t) + volatility(t) z(t), z of unit variance
A task simulates many symbols at once: a state is a vector over symbols, and time is
the only loop. Each symbol draws from its own seed, whatever others it runs with.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from plumbline.config import SyntheticConfig

SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double, regime int, conditional_mean double, volatility double, log_return double"
#: Fixed values of the model: trading days a year, bars that pull back, weight of a bar's move and spread of its volume.
DAYS, LOOKBACK, MOVE_WEIGHT, VOLUME_NOISE = 252, 5, 0.1, 0.25
NORMALS = ("shock", "gap", "up", "down", "volume")


def draws(seeds: list[int | None], c: SyntheticConfig) -> dict[str, np.ndarray]:
    """(symbols, days) arrays: uniform `leave` and `where` of the chain, normal draws, and `tail`, the divisor that makes a shock a Student's t of unit variance."""
    rngs, shape = [np.random.default_rng(s) for s in seeds], (len(seeds), c.n_days)
    out = {k: np.stack([g.random(c.n_days) for g in rngs]) for k in ("leave", "where")}
    out |= {k: np.stack([g.standard_normal(c.n_days) for g in rngs]) for k in NORMALS}
    if c.fat_tail_df is None:
        out["tail"] = np.ones(shape)
    else:
        out["tail"] = np.sqrt(np.stack([g.chisquare(c.fat_tail_df, c.n_days) for g in rngs]) / (c.fat_tail_df - 2))
    return out


def regime_paths(leave: np.ndarray, where: np.ndarray, persistence: Iterable[float]) -> np.ndarray:
    """The chain starts in its second regime; a bar is left with 1 - persistence, for any of the others alike."""
    stay = np.array(list(persistence))
    path = np.full(leave.shape, min(1, len(stay) - 1))
    hops = 1 + np.floor(where * max(len(stay) - 1, 1)).astype(int)
    for t in range(1, path.shape[1]):
        now = path[:, t - 1]
        path[:, t] = np.where((leave[:, t - 1] > stay[now]) & (len(stay) > 1), (now + hops[:, t - 1]) % len(stay), now)
    return path


def return_paths(path: np.ndarray, z: np.ndarray, c: SyntheticConfig) -> dict[str, np.ndarray]:
    """log_return, conditional_mean and volatility of all symbols."""
    gain = np.column_stack((np.full(len(z), c.garch_beta), c.garch_alpha * z[:, :-1] ** 2 + c.garch_beta))
    heat = np.empty(z.shape)
    level = np.ones(len(z))
    for t in range(z.shape[1]):
        level = heat[:, t] = 1 - c.garch_alpha - c.garch_beta + gain[:, t] * level
    sigma = np.array(c.regime_vols)[path] * np.sqrt(heat / DAYS)
    mean = np.array(c.regime_drifts)[path] / DAYS
    past = np.zeros((LOOKBACK, len(z)))  # the latest returns, newest last
    weight = np.full(LOOKBACK, c.reversion)
    weight[-1] += c.ar1
    for t in range(z.shape[1]):
        mean[:, t] += weight @ past
        past = np.vstack((past[1:], mean[:, t] + sigma[:, t] * z[:, t]))
    return {"log_return": mean + sigma * z, "conditional_mean": mean, "volatility": sigma}


def bars_of(r: np.ndarray, sigma: np.ndarray, d: dict[str, np.ndarray], c: SyntheticConfig) -> dict[str, np.ndarray]:
    """open, high, low, close (4 digits) and volume: a gap from the close before, half-normal wicks beyond the body, and a volume that rises with the move."""
    total = np.cumsum(r, axis=1)
    close = c.initial_price * np.exp(total)
    first = c.initial_price * np.exp(total - r + c.overnight_gap_vol * sigma * d["gap"])
    reach = {k: np.exp(c.intraday_range_mult * sigma * np.abs(d[k])) for k in ("up", "down")}
    body = np.stack((first, close))
    price = np.round(np.stack((first, body.max(axis=0) * reach["up"], body.min(axis=0) / reach["down"], close)), 4)
    surprise = np.abs(r) / np.maximum(sigma, 1e-12) - np.sqrt(2 / np.pi)
    volume = np.round(c.base_volume * np.exp(c.volume_vol_beta * MOVE_WEIGHT * surprise + VOLUME_NOISE * d["volume"]))
    return {"open": price[0], "high": price[[0, 1, 3]].max(axis=0), "low": price[[0, 2, 3]].min(axis=0), "close": price[3], "volume": volume}


def simulate(symbols: list[str], seeds: list[int | None], c: SyntheticConfig) -> pd.DataFrame:
    """Bars and latent columns of the symbols, one after another."""
    d = draws(seeds, c)
    path = regime_paths(d["leave"], d["where"], c.regime_persistence)
    latent = return_paths(path, d["shock"] / d["tail"], c)
    bars = bars_of(latent["log_return"], latent["volatility"], d, c)
    out = pd.DataFrame({"symbol": np.repeat(symbols, c.n_days), "date": np.tile(pd.bdate_range(c.start, periods=c.n_days).date, len(symbols))})
    for name, values in {**bars, "regime": path, **latent}.items():
        out[name] = values.ravel()
    out["log_return"] = np.log(out["close"]).groupby(out["symbol"]).diff()
    return out


def generate_market(spark: SparkSession, config: SyntheticConfig | None = None, symbols: tuple[str, ...] = ("SYN",)) -> DataFrame:
    """Bars with their latent columns; each symbol has its own seed."""
    c = config or SyntheticConfig()
    seeds = spark.createDataFrame([(s, None if c.seed is None else c.seed + i) for i, s in enumerate(symbols)], "symbol string, seed long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                yield simulate(part["symbol"].tolist(), [None if pd.isna(s) else int(s) for s in part["seed"]], c)

    return seeds.mapInPandas(run, SCHEMA)


def generate_ohlcv(spark: SparkSession, config: SyntheticConfig | None = None, symbols: tuple[str, ...] = ("SYN",)) -> DataFrame:
    return generate_market(spark, config, symbols).select("symbol", "date", "open", "high", "low", "close", "volume")


def theoretical_ic(market: DataFrame) -> DataFrame:
    """Correlation of the conditional mean with the realised return: what no forecaster can beat on average."""
    from plumbline.functions.core import guarded_corr

    return market.groupBy("symbol").agg(guarded_corr("conditional_mean", "log_return").alias("ic"))
