"""PORT, JOIN-01..03 and related queries: sleeves are a momentum strategy on each of five segments with differing calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.core import by_symbol
from plumbline.operators import portfolio as pf
from plumbline.queries.base import ANNUAL, SEGMENTS, W, add, rounded
from plumbline.queries.backtest import metric_sql
from plumbline.sources.adapters import segment_bars


def both(spark, sf_dir):
    """Asset returns, and sleeves that hold the sign of the return before."""
    w = by_symbol()
    a = segment_bars(spark, sf_dir).select("symbol", "date", F.round(F.col("close") / F.lag("close").over(w) - 1, 9).alias("asset"))
    return a.withColumn("ret", F.col("asset") * F.signum(F.lag("asset").over(w))).where("ret is not null")


def sleeves_all(spark, sf_dir):
    return both(spark, sf_dir).select("symbol", "date", "ret")


def assets_all(spark, sf_dir):
    return both(spark, sf_dir).select("symbol", "date", F.col("asset").alias("ret"))


def sleeves(spark, sf_dir):
    return pf.common(sleeves_all(spark, sf_dir))


BASE = SEGMENTS + f""",
as0 as (select symbol, date, round(close / lag(close) over {W} - 1, 9) as asset from bars),
bo as (select * from (select symbol, date, asset, asset * sign(lag(asset) over {W}) as ret from as0) where ret is not null),
ns as (select count(distinct symbol) as n from bo),
cd as (select date from bo group by date having count(distinct symbol) = (select n from ns)),
sl as (select symbol, date, ret, asset from bo where date in (select date from cd)),
we as (select symbol, 1.0 / count(*) over () as weight, sd from (select symbol, stddev_samp(ret) as sd from sl group by symbol)),
pr as (select a.date, a.symbol as sym_a, b.symbol as sym_b, a.ret as ret_a, b.ret as ret_b, a.asset as as_a, b.asset as as_b from sl a join sl b on a.date = b.date),
cv as (select sym_a, sym_b, covar_samp(ret_a, ret_b) as cov, corr(ret_a, ret_b) as corr, covar_samp(as_a, as_b) as acov, corr(as_a, as_b) as acorr from pr group by 1, 2),
wp as (select cv.*, x.weight as w_a, y.weight as w_b from cv join we x on x.symbol = sym_a join we y on y.symbol = sym_b),
wk as (select symbol, (date_trunc('week', date) + interval 6 day)::date as date, product(1 + ret) - 1 as ret, product(1 + asset) - 1 as asset from sl group by 1, 2),
wc as (select a.symbol as sym_a, b.symbol as sym_b, corr(a.ret, b.ret) as corr, corr(a.asset, b.asset) as acorr from wk a join wk b on a.date = b.date group by 1, 2),
po as (select date, sum(ret * weight) as ret from sl join we using (symbol) group by date),
pe as (select *, product(1 + ret) over (order by date rows unbounded preceding) as equity from po),
dd as (select date, ret, equity, equity / max(equity) over (order by date rows unbounded preceding) - 1 as drawdown from pe),
rw as (select date, sym_a, sym_b, count(*) over f as n, covar_samp(ret_a, ret_b) over f as cov, stddev_samp(ret_a) over f as sa, stddev_samp(ret_b) over f as sb from pr
       window f as (partition by sym_a, sym_b order by date rows between 62 preceding and current row)),
rb as (select date, avg(case when sym_a < sym_b then cov / (sa * sb) end) as mean_correlation, pow(sum(case when sym_a = sym_b then x.weight * sa end), 2) / sum(x.weight * y.weight * cov) as effective_bets
       from rw join we x on x.symbol = sym_a join we y on y.symbol = sym_b where n = 63 group by date),
rd as (select rb.*, drawdown from rb join dd using (date)),
ed as (select quantile_cont(drawdown, 1.0 / 3) as q1, quantile_cont(drawdown, 2.0 / 3) as q2 from rd),
rg as (select rd.*, case when drawdown <= q1 then 'deep_drawdown' when drawdown <= q2 then 'mid_drawdown' else 'shallow_drawdown' end as regime from rd, ed),
dv as (select sum(case when sym_a = sym_b then w_a * sqrt(cov) end) / sqrt(sum(w_a * w_b * cov)) as ratio, pow(sum(case when sym_a = sym_b then w_a * sqrt(acov) end), 2) / sum(w_a * w_b * acov) as abets from wp),
rc as (select sym_a as symbol, sum(w_a * w_b * cov) / sum(sum(w_a * w_b * cov)) over () as risk_contribution from wp group by sym_a),
ind as (select sum(weight * mean) / sqrt(sum(pow(weight * sd, 2))) * {ANNUAL} as v from we join (select symbol, avg(ret) as mean from sl group by symbol) using (symbol)),
sv as (select avg(effective_bets) filter (regime = 'deep_drawdown') as md, avg(effective_bets) filter (regime = 'shallow_drawdown') as ms, var_samp(effective_bets) filter (regime = 'deep_drawdown') as vd,
       var_samp(effective_bets) filter (regime = 'shallow_drawdown') as vs, count(*) filter (regime = 'deep_drawdown') as nd, count(*) filter (regime = 'shallow_drawdown') as ns from rg),
sz as (select md, ms, md - ms as gap, (md - ms) / sqrt(vd / greatest(nd / 63.0, 1) + vs / greatest(ns / 63.0, 1)) as z, (md - ms) / sqrt(vd / nd + vs / ns) as zn from sv)
"""


def _simple(name: str, sql: str, places: int = 6):
    def keep(f):
        add(name, BASE + sql)(lambda spark, sf_dir: rounded(f(spark, sf_dir), places))
        return f

    return keep


SEGMENT_NAMES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@_simple("join_01_outer_align", "select date, " + ", ".join(f"round(max(ret) filter (symbol = '{s}'), 9) as \"{s}\"" for s in SEGMENT_NAMES) + " from bo group by date", 9)
def outer_align(spark, sf_dir):
    return sleeves_all(spark, sf_dir).groupBy("date").pivot("symbol", list(SEGMENT_NAMES)).agg(F.first("ret"))


@_simple("join_02_common_calendar", "select date from cd")
def common_calendar(spark, sf_dir):
    return sleeves(spark, sf_dir).select("date").distinct()


@_simple("join_03_align_sleeves", "select symbol, date, round(ret, 9) as ret from sl", 9)
def align(spark, sf_dir):
    return sleeves(spark, sf_dir)


@_simple("port_01_weekly_compounding", "select symbol, date, round(ret, 8) as ret from wk", 8)
def weekly(spark, sf_dir):
    return pf.weekly(sleeves(spark, sf_dir))


@_simple("port_02_sleeve_weights", "select symbol, round(weight, 8) as equal, round((1 / sd) / sum(1 / sd) over (), 8) as inverse_vol from we", 8)
def weights(spark, sf_dir):
    s = sleeves(spark, sf_dir)
    return pf.sleeve_weights(s).withColumnRenamed("weight", "equal").join(pf.sleeve_weights(s, "inverse_vol").withColumnRenamed("weight", "inverse_vol"), "symbol")


@_simple("port_03_diversification_ratio", "select round(ratio, 6) as diversification_ratio from dv")
def diversification_ratio(spark, sf_dir):
    s = sleeves(spark, sf_dir)
    return pf.diversification(pf.covariance(s), pf.sleeve_weights(s)).select("diversification_ratio")


@_simple("port_04_effective_bets", "select round(ratio * ratio, 6) as effective_bets from dv")
def effective_bets(spark, sf_dir):
    s = sleeves(spark, sf_dir)
    return pf.diversification(pf.covariance(s), pf.sleeve_weights(s)).select("effective_bets")


@_simple("port_05_rolling_effective_bets", "select date, round(mean_correlation, 6) as mean_correlation, round(effective_bets, 6) as effective_bets from rb")
def rolling(spark, sf_dir):
    s = sleeves(spark, sf_dir)
    return pf.rolling_bets(s, pf.sleeve_weights(s))


@_simple("port_06_correlation", "select sym_a, sym_b, round(corr, 6) as corr from cv")
def correlation(spark, sf_dir):
    return pf.correlation(sleeves(spark, sf_dir))


@_simple("port_07_covariance", "select sym_a, sym_b, round(cov, 10) as cov from cv", 10)
def covariance(spark, sf_dir):
    return pf.covariance(sleeves(spark, sf_dir))


@_simple("port_08_weekly_correlation", "select sym_a, sym_b, round(corr, 6) as corr from wc")
def weekly_correlation(spark, sf_dir):
    return pf.correlation(pf.weekly(sleeves(spark, sf_dir)))


@_simple("aux_13_weekly_guard", "select count(distinct date)::bigint as n_weeks, count(distinct date) >= 2 as enough from wk")
def weekly_guard(spark, sf_dir):
    return pf.weekly(sleeves(spark, sf_dir)).agg(F.count_distinct("date").alias("n_weeks"), (F.count_distinct("date") >= 2).alias("enough"))


@_simple("port_09_drawdown", "select date, round(drawdown, 8) as drawdown from dd", 8)
def drawdown(spark, sf_dir):
    s = sleeves(spark, sf_dir)
    return pf.drawdown_series(pf.portfolio_returns(s, pf.sleeve_weights(s)))


def _rolling(spark, sf_dir):
    s = sleeves(spark, sf_dir)
    return pf.rolling_bets_with_drawdown(s, pf.sleeve_weights(s))


@_simple("port_10_rolling_bets_drawdown", "select date, round(mean_correlation, 6) as mean_correlation, round(effective_bets, 6) as effective_bets, round(drawdown, 6) as drawdown from rd")
def rolling_drawdown(spark, sf_dir):
    return _rolling(spark, sf_dir)


@_simple("port_11_bets_by_drawdown", "select regime, count(*)::double as n_windows, round(avg(drawdown), 6) as mean_drawdown, round(avg(mean_correlation), 6) as mean_correlation, round(avg(effective_bets), 6) as effective_bets from rg group by regime")
def by_drawdown(spark, sf_dir):
    return pf.bets_by_drawdown(_rolling(spark, sf_dir))


@_simple("aux_09_drawdown_labels", "select distinct regime from rg")
def drawdown_labels(spark, sf_dir):
    return pf.drawdown_bins(_rolling(spark, sf_dir)).select("regime").distinct()


@_simple("aux_10_drawdown_bins", "select date, regime from rg")
def drawdown_bins(spark, sf_dir):
    return pf.drawdown_bins(_rolling(spark, sf_dir)).select("date", "regime")


@_simple("port_12_stress_z", "select round(md, 5) as deep, round(ms, 5) as shallow, round(gap, 5) as gap, round(z, 5) as z, round(zn, 5) as z_naive from sz", 5)
def stress(spark, sf_dir):
    return pf.stress_z(_rolling(spark, sf_dir))


@_simple("port_13_build_portfolio", "select date, round(ret, 10) as ret, round(equity, 10) as equity, round((select count(*) from cd)::double / (select count(distinct date) from bo), 10) as common_fraction from pe", 10)
def build(spark, sf_dir):
    p = pf.build_portfolio(sleeves_all(spark, sf_dir), assets=assets_all(spark, sf_dir))
    return p["returns"].withColumn("__k", F.lit(0)).join(p["common_fraction"].withColumn("__k", F.lit(0)), "__k").select("date", "ret", "equity", "common_fraction")


@_simple("port_14_risk_contributions", "select symbol, round(risk_contribution, 6) as risk_contribution from rc")
def risk(spark, sf_dir):
    s = sleeves(spark, sf_dir)
    return pf.risk_contributions(pf.covariance(s), pf.sleeve_weights(s))


@_simple("port_15_sleeve_table", f"select we.symbol, round(weight, 6) as weight, round(v, 6) as annualised_volatility, round(r, 6) as annualised_return, round(r / nullif(v, 0), 6) as sharpe, round(risk_contribution, 6) as risk_contribution from we join (select symbol, stddev_samp(ret) * {ANNUAL} as v, avg(ret) * 252 as r from sl group by symbol) q using (symbol) join rc using (symbol)")
def sleeve_table(spark, sf_dir):
    s = sleeves(spark, sf_dir)
    return pf.sleeve_table(s, pf.sleeve_weights(s))


@_simple("port_16_sharpe_if_independent", "select round(v, 6) as sharpe_if_independent from ind")
def independent(spark, sf_dir):
    s = sleeves(spark, sf_dir)
    return pf.sharpe_if_independent(s, pf.sleeve_weights(s))


@_simple("port_18_mean_off_diagonal", "select round(avg(corr), 6) as mean_correlation from cv where sym_a < sym_b")
def off_diagonal(spark, sf_dir):
    return pf.mean_off_diagonal(pf.correlation(sleeves(spark, sf_dir)))


@_simple("aux_11_asset_correlation", "select sym_a, sym_b, round(acorr, 6) as corr from cv")
def asset_correlation(spark, sf_dir):
    p = pf.build_portfolio(sleeves_all(spark, sf_dir), assets=assets_all(spark, sf_dir))
    return pf.correlation(p["assets"])


@_simple("aux_12_weekly_asset_correlation", "select sym_a, sym_b, round(acorr, 6) as corr from wc")
def weekly_asset_correlation(spark, sf_dir):
    p = pf.build_portfolio(sleeves_all(spark, sf_dir), assets=assets_all(spark, sf_dir))
    return pf.correlation(pf.weekly(p["assets"]))


METRICS = [(n, s) for n, s in metric_sql("ret", "drawdown", "0") if n not in ("psr_z", "avg_exposure", "annual_turnover", "time_in_market")]
OTHERS = [
    ("n_sleeves", "(select n from ns)::double"),
    ("mean_correlation", "(select avg(corr) from cv where sym_a < sym_b)"),
    ("max_correlation", "(select max(corr) from cv where sym_a < sym_b)"),
    ("min_correlation", "(select min(corr) from cv where sym_a < sym_b)"),
    ("diversification_ratio", "(select ratio from dv)"),
    ("effective_bets", "(select ratio * ratio from dv)"),
    ("common_fraction", "(select count(*) from cd)::double / (select count(distinct date) from bo)"),
    ("rolling_window", "63.0::double"),
    ("n_rolling_windows", "(select count(*) from rd)::double"),
    ("effective_bets_min", "(select min(effective_bets) from rd)"),
    ("effective_bets_deep_drawdown", "(select md from sz)"),
    ("effective_bets_shallow_drawdown", "(select ms from sz)"),
    ("effective_bets_stress_gap", "(select gap from sz)"),
    ("effective_bets_stress_z", "(select z from sz)"),
    ("effective_bets_stress_z_naive", "(select zn from sz)"),
    ("sharpe_if_independent", "(select v from ind)"),
    ("n_weeks", "(select count(distinct date) from wk)::double"),
    ("mean_correlation_weekly", "(select avg(corr) from wc where sym_a < sym_b)"),
    ("mean_asset_correlation", "(select avg(acorr) from cv where sym_a < sym_b)"),
    ("asset_effective_bets", "(select abets from dv)"),
    ("mean_asset_correlation_weekly", "(select avg(acorr) from wc where sym_a < sym_b)"),
    ("sharpe_diversification_gap", f"(select v from ind) - (select avg(ret) / stddev_samp(ret) * {ANNUAL} from dd)"),
    ("sleeve_alignment_gap", "(select avg(corr) from wc where sym_a < sym_b) - (select avg(corr) from cv where sym_a < sym_b)"),
    ("asset_alignment_gap", "(select avg(acorr) from wc where sym_a < sym_b) - (select avg(acorr) from cv where sym_a < sym_b)"),
]


@_simple("port_17_portfolio_metrics", ", dm as (select *, avg(ret) over () as m, 0.0 as p_lag from dd) " + " union all ".join([f"select '{n}' as metric, round({s}, 5) as value from dm" for n, s in METRICS] + [f"select '{n}' as metric, round({s}, 5) as value" for n, s in OTHERS]), 5)
def portfolio_metrics(spark, sf_dir):
    return pf.portfolio_metrics(sleeves_all(spark, sf_dir), assets_all(spark, sf_dir)).where("metric <> 'probabilistic_sharpe'")


@add("aux_14_covariance_weight_validation", "select * from (values ('fine', 'ok'), ('negative weight', 'weights must not be negative'), ('no weight', 'a covariance without a weight'), ('no covariance', 'a weight without a covariance')) t(\"case\", outcome)")
def weight_validation(spark, sf_dir):
    from plumbline.operators import portfolio as pf

    cov = spark.createDataFrame([("A", "A", 1.0), ("A", "B", 0.2), ("B", "A", 0.2), ("B", "B", 1.0)], "sym_a string, sym_b string, cov double")
    cases = {"fine": [("A", 0.5), ("B", 0.5)], "negative weight": [("A", -0.5), ("B", 1.5)], "no weight": [("A", 1.0)], "no covariance": [("A", 0.4), ("B", 0.4), ("C", 0.2)]}
    out = []
    for name, rows in cases.items():
        try:
            pf.diversification(cov, spark.createDataFrame(rows, "symbol string, weight double")).collect()
            out.append((name, "ok"))
        except Exception as e:
            out.append((name, next(x for x in ("weights must not be negative", "a covariance without a weight", "a weight without a covariance") if x in str(e))))
    return spark.createDataFrame(out, "case string, outcome string")
