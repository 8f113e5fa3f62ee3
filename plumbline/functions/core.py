"""Null-safe primitives. NaN never enters the engine: what is undefined is NULL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

PERIODS_PER_YEAR = 252
EPS = 1e-12


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: str | Column) -> Column:
    """NaN and infinities become NULL."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def safe_divide(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(col(a), col(b))


def by_symbol(order: str = "date", key: str = "symbol") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def trailing(n: int, order: str = "date", key: str = "symbol") -> WindowSpec:
    """The current row and the n - 1 before it."""
    return by_symbol(order, key).rowsBetween(-(n - 1), 0)


def running(order: str = "date", key: str = "symbol") -> WindowSpec:
    return by_symbol(order, key).rowsBetween(Window.unboundedPreceding, 0)


def full(agg: Column, value: str | Column, n: int, frame: WindowSpec) -> Column:
    """agg over a frame, NULL unless the frame holds n values."""
    return F.when(F.count(col(value)).over(frame) == n, agg.over(frame))


def guarded_corr(a: str | Column, b: str | Column, least: int = 3) -> Column:
    """Pearson correlation as an aggregate: NULL below `least` pairs or without spread. Never raises."""
    a, b = col(a), col(b)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((F.count(a) >= least) & (sa >= EPS) & (sb >= EPS), F.covar_pop(a, b) / F.nullif(sa * sb, F.lit(0.0)))


def average_rank(value: str | Column, partition: Sequence[str]) -> Column:
    """Rank with ties at their average, 1-based."""
    w = Window.partitionBy(*partition)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, col(value)))
    return F.rank().over(w.orderBy(col(value))) + (ties - 1) / 2.0


def horner(coefficients: Sequence[float], x: Column) -> Column:
    """Polynomial with the highest power first."""
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


#: The rational approximation of the normal quantile (central and tail branches).
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
PPF_LOW = 0.02425


def _ppf(p: Column) -> Column:
    def tail(q: Column) -> Column:
        return bound(q, lambda v: horner(PPF_C, v) / horner((*PPF_D, 1.0), v))

    least = F.lit(1e-300)
    low = tail(F.sqrt(-2.0 * F.log(F.greatest(p, least))))
    high = -tail(F.sqrt(-2.0 * F.log(F.greatest(1.0 - p, least))))
    middle = bound((p - 0.5) * (p - 0.5), lambda r: horner(PPF_A, r) / horner((*PPF_B, 1.0), r)) * (p - 0.5)
    return F.when(p <= 0, F.lit(float("-inf"))).when(p >= 1, F.lit(float("inf"))).when(p < PPF_LOW, low).when(p > 1 - PPF_LOW, high).otherwise(middle)


def normal_ppf(p: str | Column) -> Column:
    """Quantile of the standard normal distribution; infinite at 0 and 1."""
    return bound(p, _ppf)


#: The error function as a power series term count and continued fraction depth; both exact to about 1e-12.
ERF_TERMS, ERF_DEPTH, ERF_SPLIT = 40, 60, 2.5


def bound(x: str | Column, f) -> Column:
    """f of a value that is evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(col(x)), f), F.lit(0))


def _erf(x: Column) -> Column:
    a = F.least(F.abs(x), F.lit(ERF_SPLIT))
    terms = F.aggregate(F.sequence(F.lit(ERF_TERMS), F.lit(1)), F.lit(1.0), lambda acc, k: 1.0 + acc * a * a * 2.0 / (2 * k + 1))
    series = a * (2.0 / 3.141592653589793**0.5) * F.exp(-a * a) * terms
    big = F.greatest(F.abs(x), F.lit(ERF_SPLIT))
    fraction = F.aggregate(F.sequence(F.lit(ERF_DEPTH), F.lit(1)), big, lambda acc, k: big + k / 2.0 / acc)
    tail = 1.0 - F.exp(-big * big) / (fraction * 3.141592653589793**0.5)
    return F.signum(x) * F.when(F.abs(x) < ERF_SPLIT, series).otherwise(tail)


def erf(x: str | Column) -> Column:
    """Error function by its power series below ERF_SPLIT and by a continued fraction beyond; stays in the JVM."""
    return bound(x, _erf)


def normal_cdf(x: str | Column) -> Column:
    return (1.0 + erf(col(x) / 2**0.5)) / 2.0


def fisher_z(observed: str | Column, claimed: str | Column, trials: str | Column) -> Column:
    """z of the gap between two correlations; NULL below 4 trials or outside (-1, 1)."""
    r, r0, n = col(observed), col(claimed), col(trials)
    fine = (n >= 4) & (F.abs(r) < 1) & (F.abs(r0) < 1)
    return F.when(fine, (F.atanh(F.when(fine, r)) - F.atanh(F.when(fine, r0))) * F.sqrt(F.when(fine, n) - 3.0))


def market_of(symbol: str | Column) -> Column:
    return F.when(F.upper(col(symbol)).rlike(r"\.TWO?$"), "TW").otherwise("US")


def horizon_label(days: str | Column) -> Column:
    d = col(days)
    out = None
    for size, unit in ((252, "y"), (21, "mo"), (5, "w")):
        value = F.concat((d / size).cast("int").cast("string"), F.lit(unit))
        out = F.when(d % size == 0, value) if out is None else out.when(d % size == 0, value)
    return out.otherwise(F.concat(d.cast("string"), F.lit("d")))


def age_label(age: str | Column) -> Column:
    return F.when(clean(age).isNull(), "no readable bar").otherwise(F.concat(col(age).cast("int").cast("string"), F.lit("d")))


def format_value(value: str | Column, digits: int = 4, percent: bool = False) -> Column:
    """Text of a number: n/a for NULL, signed infinities, percent with 2 places, thousands with 1."""
    v = col(value)
    shown = F.concat(F.format_number(v * 100, 2), F.lit("%")) if percent else F.when(F.abs(v) >= 1000, F.format_number(v, 1)).otherwise(F.format_string(f"%.{digits}f", v))
    return F.when(v.isNull() | F.isnan(v), "n/a").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf").otherwise(shown)


def range_bar(position: str | Column, width: int = 10) -> Column:
    at = F.least(F.greatest(F.round(col(position) * (width - 1)).cast("int"), F.lit(0)), F.lit(width - 1))
    return F.concat(F.repeat(F.lit("─"), at), F.lit("●"), F.repeat(F.lit("─"), F.lit(width - 1) - at))


def missed_sessions(last_bar: str | Column, reference: str | Column) -> Column:
    """Weekdays strictly between two dates."""
    a, b = F.date_add(col(last_bar), 1), F.date_sub(col(reference), 1)
    return F.when(b >= a, F.size(F.filter(F.sequence(a, F.greatest(a, b)), lambda d: F.weekday(d) < 5))).otherwise(0)


def aligned(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join without the rows that hold a NULL."""
    return a.join(b, list(on), "inner").dropna()


def melt(df: DataFrame, keys: Sequence[str], names: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """One row for each (keys, name)."""
    return df.unpivot(list(keys), [F.col(n).cast("double").alias(n) for n in names], name, value)
