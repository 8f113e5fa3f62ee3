"""Technical indicators as window expressions, per symbol in date order. Warm-up is NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.core import PERIODS_PER_YEAR, by_symbol, col, full, running, safe_divide, trailing


def log_return(close: str | Column = "close", periods: int = 1) -> Column:
    if periods < 1:
        raise ValueError("periods must be at least 1")
    c = col(close)
    return F.log(c) - F.log(F.lag(c, periods).over(by_symbol()))


def sma(value: str | Column = "close", window: int = 20) -> Column:
    return full(F.avg(col(value)), value, window, trailing(window))


def _exponential(value: Column, alpha: float, window: int) -> Column:
    """Recursive smoothing seeded by the first value; values older than the frame weigh less than 1e-17."""
    if alpha >= 1:  # a window of one bar keeps the value
        return value
    reach = math.ceil(39.2 / -math.log(1 - alpha))
    held = F.collect_list(value).over(by_symbol().rowsBetween(-reach, 0))
    folded = F.aggregate(held, F.lit(None).cast("double"), lambda acc, x: F.coalesce(acc * (1 - alpha) + x * alpha, x))
    return F.when((F.count(value).over(running()) >= window) & value.isNotNull(), folded)


def _window(window: int) -> int:
    if window < 1:
        raise ValueError("a window has at least one bar")
    return window


def ema(value: str | Column = "close", window: int = 26) -> Column:
    return _exponential(col(value), 2 / (_window(window) + 1), window)


def wilder(value: str | Column, window: int = 14) -> Column:
    return _exponential(col(value), 1 / _window(window), window)


def roc(close: str | Column = "close", window: int = 10) -> Column:
    return safe_divide(col(close), F.lag(col(close), window).over(by_symbol())) - 1


def realised_volatility(one_bar_return: str | Column, window: int = 20, annualise: bool = True) -> Column:
    """Sample deviation of one-bar log returns (a column, since windows do not nest)."""
    return full(F.stddev_samp(col(one_bar_return)), one_bar_return, window, trailing(window)) * (math.sqrt(PERIODS_PER_YEAR) if annualise else 1.0)


def rsi(change: str | Column, window: int = 14) -> Column:
    """From the one-bar change of the close (a column)."""
    d = col(change)
    gain, loss = wilder(F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), window), wilder(F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))), window)
    return F.when(gain.isNull(), None).when((loss == 0) & (gain == 0), 50.0).when(loss == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + safe_divide(gain, loss)))


def macd_line(close: str | Column = "close", fast: int = 12, slow: int = 26) -> Column:
    if not 0 < fast < slow:
        raise ValueError("fast must be positive and below slow")
    return ema(close, fast) - ema(close, slow)


def bollinger(close: str | Column = "close", window: int = 20, k: float = 2.0) -> dict[str, Column]:
    c = col(close)
    mid = sma(c, window)
    dev = full(F.stddev_pop(c), c, window, trailing(window))
    up, low = mid + k * dev, mid - k * dev
    return {"bb_mid": mid, "bb_upper": up, "bb_lower": low, "bb_percent_b": safe_divide(c - low, up - low), "bb_bandwidth": safe_divide(up - low, mid)}


def true_range(previous_close: str | Column, high: str = "high", low: str = "low") -> Column:
    h, lo, p = F.col(high), F.col(low), col(previous_close)
    return F.greatest(h - lo, F.abs(h - p), F.abs(lo - p))


def atr(true_range_column: str | Column, window: int = 14) -> Column:
    return wilder(true_range_column, window)


def _channel(window: int) -> tuple[Column, Column]:
    return full(F.min("low"), "low", window, trailing(window)), full(F.max("high"), "high", window, trailing(window))


def stochastic_k(window: int = 14) -> Column:
    least, most = _channel(window)
    return F.when(most == least, 50.0).otherwise(safe_divide(100.0 * (F.col("close") - least), most - least))


def donchian_position(window: int = 20) -> Column:
    least, most = _channel(window)
    return F.when(most == least, 0.5).otherwise(safe_divide(F.col("close") - least, most - least))


def obv(change: str | Column, volume: str | Column = "volume") -> Column:
    return F.sum(F.coalesce(F.signum(col(change)), F.lit(0.0)) * col(volume)).over(running())
