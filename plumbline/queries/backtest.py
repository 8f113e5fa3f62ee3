"""BT and the return-series aggregates, over a moving-average cross on price-path bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.config import BacktestConfig
from plumbline.functions import indicators as ind
from plumbline.functions.core import full, normal_cdf, trailing
from plumbline.operators import backtest as bt
from plumbline.operators import metrics as m
from plumbline.queries.base import ANNUAL, PATH, W, add, rolled, rounded
from plumbline.sources.adapters import price_path

RATE = 2.0 * 1e-4


def signals(spark, sf_dir):
    """Signal +1, -1 or 0: the close against its 20-bar mean."""
    bars = price_path(spark, sf_dir)
    gap = F.round(F.col("close") - ind.sma("close", 20), 6)
    return bars.select("symbol", "date", "close", F.coalesce(F.signum(gap), F.lit(0.0)).alias("signal"))


def backtest(spark, sf_dir, config=None):
    return bt.run_backtest(signals(spark, sf_dir), config)


UPTO = "(partition by symbol order by date rows between unbounded preceding and current row)"
BACKTEST_SQL = PATH + f""",
sig as (select symbol, date, close, coalesce(sign(round(close - ({rolled('avg', 'close', 20)}), 6)), 0.0)::double as signal from bars),
t0 as (select *, coalesce(close / nullif(lag(close) over {W}, 0) - 1, 0.0) as asset_return, row_number() over {W} as rn from sig),
t1 as (select *, coalesce(lag(signal) over {W}, 0.0) as position from t0),
t2 as (select *, abs(position - coalesce(lag(position) over {W}, 0.0)) as trade from t1),
t3 as (select *, trade * {RATE!r} as cost, position * asset_return as gross_return, case when rn = 1 then asset_return - {RATE!r} else asset_return end as benchmark_return from t2),
t4 as (select *, gross_return - cost as strategy_return from t3),
b as (select *, 100000.0 * product(1 + strategy_return) over {UPTO} as equity, 100000.0 * product(1 + benchmark_return) over {UPTO} as benchmark_equity from t4)
"""
DD = "select *, equity / max(equity) over (partition by symbol order by date rows between unbounded preceding and current row) - 1 as dd, benchmark_equity / max(benchmark_equity) over (partition by symbol order by date rows between unbounded preceding and current row) - 1 as bdd from b"


def metric_sql(r: str, dd: str, position: str) -> list[tuple[str, str]]:
    """SQL of each metric of a return column; p_lag is the position a bar before."""
    mean, sd = f"avg({r})", f"stddev_samp({r})"
    c = f"({r} - m)"
    skew, kurt = f"(avg({c} * {c} * {c}) / pow(sqrt(avg({c} * {c})), 3))", f"(avg({c} * {c} * {c} * {c}) / pow(avg({c} * {c}), 2))"
    s = f"({mean} / {sd})"
    annual = f"(case when product(1 + {r}) <= 0 then -1.0 else pow(product(1 + {r}), 252.0 / count({r})) - 1 end)"
    return [
        ("n_periods", f"count({r})::double"),
        ("total_return", f"product(1 + {r}) - 1"),
        ("annualised_return", annual),
        ("annualised_volatility", f"{sd} * {ANNUAL}"),
        ("sharpe", f"{mean} / {sd} * {ANNUAL}"),
        ("sortino", f"{mean} / sqrt(avg(pow(least({r}, 0.0), 2))) * {ANNUAL}"),
        ("max_drawdown", f"min({dd})"),
        ("calmar", f"case when min({dd}) < 0 then {annual} / abs(min({dd})) end"),
        ("hit_rate", f"avg(case when {r} > 0 then 1.0 else 0.0 end)"),
        ("profit_factor", f"sum(greatest({r}, 0.0)) / nullif(-sum(least({r}, 0.0)), 0)"),
        ("psr_z", f"{s} * sqrt(count({r}) - 1) / sqrt(1 - {skew} * {s} + ({kurt} - 1) / 4 * {s} * {s})"),
        ("avg_exposure", f"avg(abs({position}))"),
        ("annual_turnover", f"avg(abs({position} - coalesce(p_lag, 0.0))) * 252"),
        ("time_in_market", f"avg(case when {position} <> 0 then 1.0 else 0.0 end)"),
    ]


METRIC_BASE = BACKTEST_SQL + f""", d as ({DD}), e as (select *, lag(position) over {W} as p_lag, avg(strategy_return) over (partition by symbol) as m from d)"""
ALL = metric_sql("strategy_return", "dd", "position")


def _pick(*names: str) -> str:
    chosen = dict(ALL)
    return METRIC_BASE + " select symbol, " + ", ".join(f"round({chosen[n]}, 6) as {n}" for n in names) + " from e group by symbol"


def _one(name: str, metric: str, column) -> None:
    @add(name, _pick(metric))
    def run(spark, sf_dir):
        rows = backtest(spark, sf_dir).withColumn("__dd", m.drawdown("equity"))
        return rounded(rows.groupBy("symbol").agg(column().alias(metric)))


_one("agg_04_annualised_return", "annualised_return", lambda: m.annualised_return("strategy_return"))
_one("agg_05_annualised_volatility", "annualised_volatility", lambda: m.annualised_volatility("strategy_return"))
_one("agg_06_sharpe", "sharpe", lambda: m.sharpe("strategy_return"))
_one("agg_07_sortino", "sortino", lambda: m.sortino("strategy_return"))
_one("agg_08_max_drawdown", "max_drawdown", lambda: F.min("__dd"))


@add("agg_09_calmar", _pick("calmar"))
def calmar(spark, sf_dir):
    return rounded(m.financial_metrics(backtest(spark, sf_dir), "strategy_return", "equity").select("symbol", "calmar"))


@add("join_09_signal_price_intersection", PATH + ", s as (select symbol, date, sign(close - open) as signal from bars where day(date) % 2 = 0) select b.symbol, b.date, b.close, s.signal::double as signal from bars b join s on b.symbol = s.symbol and b.date = s.date")
def intersection(spark, sf_dir):
    bars = price_path(spark, sf_dir)
    some = bars.where(F.dayofmonth("date") % 2 == 0).select("symbol", "date", F.signum(F.col("close") - F.col("open")).alias("signal"))
    return bt.align_signals(bars, some)


@add("bt_01_simple_returns", BACKTEST_SQL + "select symbol, date, round(asset_return, 8) as asset_return from b")
def simple_returns(spark, sf_dir):
    return rounded(backtest(spark, sf_dir).select("symbol", "date", "asset_return"), 8)


@add("bt_02_trailing_volatility", BACKTEST_SQL + f"select symbol, date, round(({rolled('stddev_samp', 'asset_return', 20)}) * {ANNUAL}, 6) as volatility from b")
def trailing_volatility(spark, sf_dir):
    return rounded(backtest(spark, sf_dir).select("symbol", "date", bt.trailing_volatility().alias("volatility")))


SIZED = BACKTEST_SQL + f""", v as (select *, ({rolled('stddev_samp', 'asset_return', 20)}) * {ANNUAL} as vol, asset_return * 37.0 as raw from b)
select symbol, date, round((case when abs(raw) <= 0.05 then 0.0 else sign(raw) end)::double, 6) as sign,
  round((case when raw > 0.05 then 1.0 else 0.0 end)::double, 6) as long_only,
  round(case when abs(raw) <= 0.05 then 0.0 else greatest(least(raw * 5.0, 1.0), -1.0) end, 6) as proportional,
  round(greatest(case when abs(raw) <= 0.05 then 0.0 else sign(raw) end, 0.0)::double, 6) as no_short,
  round(greatest(least((case when abs(raw) <= 0.05 then 0.0 else sign(raw) end) * coalesce(0.1 / case when vol > 0 then vol end, 0.0), 1.0), -1.0), 6) as vol_target from v"""


@add("bt_03_position_sizing", SIZED)
def sizing(spark, sf_dir):
    rows = backtest(spark, sf_dir).withColumn("vol", bt.trailing_volatility()).withColumn("raw", F.col("asset_return") * 37.0)
    band = {"threshold": 0.05}
    kinds = {"sign": BacktestConfig(**band), "long_only": BacktestConfig(sizing="long_only", **band), "proportional": BacktestConfig(sizing="proportional", scale=5.0, **band), "no_short": BacktestConfig(allow_short=False, **band), "vol_target": BacktestConfig(vol_target=0.1, **band)}
    return rounded(rows.select("symbol", "date", *[bt.target_position("raw", c, "vol").alias(k) for k, c in kinds.items()]))


@add("bt_04_backtest", BACKTEST_SQL + "select symbol, date, position, round(trade, 6) as trade, round(cost, 8) as cost, round(gross_return, 8) as gross_return, round(strategy_return, 8) as strategy_return, round(benchmark_return, 8) as benchmark_return, round(equity, 4) as equity, round(benchmark_equity, 4) as benchmark_equity from b")
def full_backtest(spark, sf_dir):
    return rounded(backtest(spark, sf_dir).select("symbol", "date", "position", "trade", "cost", "gross_return", "strategy_return", "benchmark_return", "equity", "benchmark_equity"), 8, equity=4, benchmark_equity=4)


SHOWN = ("annualised_return", "annualised_volatility", "max_drawdown", "sharpe", "sortino", "total_return")


def wide_metrics(spark, sf_dir):
    rows = backtest(spark, sf_dir)
    a = m.financial_metrics(rows, "strategy_return", "equity", "position")
    b = m.financial_metrics(rows, "benchmark_return", "benchmark_equity")
    return a.select("symbol", *[F.col(n).alias(f"strategy_{n}") for n in SHOWN]).join(b.select("symbol", *[F.col(n).alias(f"benchmark_{n}") for n in SHOWN]), "symbol")


_S, _B = dict(ALL), dict(metric_sql("benchmark_return", "bdd", "position"))


@add("bt_05_summary", METRIC_BASE + " ".join([" , wide as (select symbol, " + ", ".join(f"{_S[n]} as s_{n}, {_B[n]} as b_{n}" for n in SHOWN) + " from e group by symbol)", " union all ".join(f"select symbol, '{n}' as metric, round(s_{n}, 6) as strategy, round(b_{n}, 6) as buy_and_hold from wide" for n in SHOWN)]))
def summary(spark, sf_dir):
    return rounded(bt.summary(wide_metrics(spark, sf_dir), ["symbol"]))


@add("bt_06_total_cost", BACKTEST_SQL + "select symbol, round(sum(cost), 8) as total_cost from b group by symbol")
def total_cost(spark, sf_dir):
    return rounded(backtest(spark, sf_dir).groupBy("symbol").agg(F.sum("cost").alias("total_cost")), 8)


@add("bt_07_excess_sharpe", METRIC_BASE + f" select symbol, round({_S['sharpe']} - {_B['sharpe']}, 6) as excess_sharpe from e group by symbol")
def excess_sharpe(spark, sf_dir):
    return rounded(wide_metrics(spark, sf_dir).select("symbol", bt.excess("strategy_sharpe", "benchmark_sharpe").alias("excess_sharpe")))


#: SQL of the normal distribution function: an error function by a series of 80 terms.
CDF_SQL = "(case when z <= -9 then 0.0 when z >= 9 then 1.0 else 0.5 + 0.3989422804014327 * list_sum(list_transform(range(0, 120), lambda k: pow(-1.0, k) * exp((2 * k + 1) * ln(nullif(abs(z), 0)) - k * ln(2.0) - lgamma(k + 1)) / (2 * k + 1))) * sign(z) end)"


@add("agg_10_probabilistic_sharpe", METRIC_BASE + f" , z as (select symbol, {_S['psr_z']} as z from e group by symbol) select symbol, round({CDF_SQL}, 6) as probabilistic_sharpe from z")
def probabilistic_sharpe(spark, sf_dir):
    return rounded(backtest(spark, sf_dir).groupBy("symbol").agg(m.probabilistic_sharpe("strategy_return").alias("probabilistic_sharpe")))


MANY = tuple(n for n, _ in ALL if n != "psr_z")


@add("agg_13_financial_metrics", METRIC_BASE + f" , g as (select symbol, {', '.join(f'{s} as {n}' for n, s in ALL)} from e group by symbol), z as (select *, psr_z as z from g) select symbol, {', '.join(f'round({n}, 6) as {n}' for n in MANY)}, round({CDF_SQL}, 6) as probabilistic_sharpe from z")
def financial(spark, sf_dir):
    return rounded(m.financial_metrics(backtest(spark, sf_dir), "strategy_return", "equity", "position"))


VARIANTS = (5, 10, 20, 50)


def model_returns(spark, sf_dir):
    """One run for each moving-average window: symbol, date, model, strategy_return, equity."""
    bars = price_path(spark, sf_dir)
    out = None
    for k in VARIANTS:
        gap = F.round(F.col("close") - full(F.avg("close"), "close", k, trailing(k)), 6)
        rows = bt.run_backtest(bars.select("symbol", "date", "close", F.coalesce(F.signum(gap), F.lit(0.0)).alias("signal"))).withColumn("model", F.lit(f"sma_{k}"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _variant(k: int) -> str:
    return f"""select 'sma_{k}' as model, symbol, date, close, coalesce(sign(round(close - ({rolled('avg', 'close', k)}), 6)), 0.0)::double as signal from bars"""


MW = "(partition by model, symbol order by date)"
MODELS_SQL = PATH + f""",
sig as ({' union all '.join(_variant(k) for k in VARIANTS)}),
t0 as (select *, coalesce(close / nullif(lag(close) over {MW}, 0) - 1, 0.0) as asset_return, row_number() over {MW} as rn from sig),
t1 as (select *, coalesce(lag(signal) over {MW}, 0.0) as position from t0),
t2 as (select *, position * asset_return - abs(position - coalesce(lag(position) over {MW}, 0.0)) * {RATE!r} as r from t1),
mm as (select *, avg(r) over (partition by model, symbol) as m from t2),
mo as (select model, symbol, count(r) as n, avg(r) / stddev_samp(r) as s, avg(pow(r - m, 3)) / pow(sqrt(avg(pow(r - m, 2))), 3) as sk, avg(pow(r - m, 4)) / pow(avg(pow(r - m, 2)), 2) as ku from mm group by 1, 2)
"""


def ppf_sql(p: str) -> str:
    """SQL of the normal quantile as polynomials."""
    from plumbline.functions.core import PPF_A, PPF_B, PPF_C, PPF_D

    def poly(cs, x):
        return " + ".join(f"({c!r}) * pow({x}, {len(cs) - 1 - i})" for i, c in enumerate(cs))

    q, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    low, high = f"sqrt(-2.0 * ln({p}))", f"sqrt(-2.0 * ln(1.0 - {p}))"
    return f"(case when {p} < 0.02425 then ({poly(PPF_C, low)}) / ({poly((*PPF_D, 1.0), low)}) when {p} > 0.97575 then -({poly(PPF_C, high)}) / ({poly((*PPF_D, 1.0), high)}) else ({poly(PPF_A, r)}) * {q} / ({poly((*PPF_B, 1.0), r)}) end)"


EXPECTED = f"(s_std * ((1 - 0.5772156649015329) * {ppf_sql('(1 - 1.0 / k)')} + 0.5772156649015329 * {ppf_sql('(1 - 1.0 / (k * 2.718281828459045))')}))"


def trials(spark, sf_dir):
    from pyspark.sql import Window

    per = model_returns(spark, sf_dir).groupBy("model", "symbol").agg(F.count("strategy_return").alias("n"), F.try_divide(F.avg("strategy_return"), F.stddev_samp("strategy_return")).alias("s"), F.skewness("strategy_return").alias("sk"), (F.kurtosis("strategy_return") + 3).alias("ku"))
    w = Window.partitionBy("symbol")
    return per.withColumn("k", F.count("s").over(w)).withColumn("s_std", F.coalesce(F.stddev_samp("s").over(w), F.lit(0.0)))


TRIALS_SQL = MODELS_SQL + ", tr as (select *, count(s) over (partition by symbol)::double as k, coalesce(stddev_samp(s) over (partition by symbol), 0.0) as s_std from mo)"


@add("agg_11_expected_max_sharpe", TRIALS_SQL + f"select distinct symbol, k::bigint as trials, round({EXPECTED}, 6) as expected_max_sharpe from tr")
def expected_max(spark, sf_dir):
    t = trials(spark, sf_dir)
    return rounded(t.select("symbol", F.col("k").alias("trials"), m.expected_max_sharpe("k", "s_std").alias("expected_max_sharpe")).groupBy("symbol", "trials").agg(F.max("expected_max_sharpe").alias("expected_max_sharpe")))


def _deflated(t):
    s = F.col("s")
    inside = 1 - F.col("sk") * s + (F.col("ku") - 1) / 4 * s * s
    z = (s - m.expected_max_sharpe("k", "s_std")) * F.sqrt(F.col("n") - 1) / F.sqrt(F.when(inside > 0, inside))
    return t.select("model", "symbol", normal_cdf(z).alias("deflated_sharpe"))


DEFLATED_SQL = TRIALS_SQL + f", z as (select model, symbol, (s - {EXPECTED}) * sqrt(n - 1) / sqrt(1 - sk * s + (ku - 1) / 4 * s * s) as z from tr)"


@add("agg_14_deflated_sharpe_models", DEFLATED_SQL + f"select model, symbol, round({CDF_SQL}, 6) as deflated_sharpe from z")
def deflated_models(spark, sf_dir):
    return rounded(_deflated(trials(spark, sf_dir)))


@add("agg_12_deflated_sharpe", DEFLATED_SQL + f"select symbol, round({CDF_SQL}, 6) as deflated_sharpe from z where model = 'sma_20'")
def deflated(spark, sf_dir):
    return rounded(_deflated(trials(spark, sf_dir)).where("model = 'sma_20'").select("symbol", "deflated_sharpe"))

