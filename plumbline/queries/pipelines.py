"""PIPE, AGG-26..28 and related queries: a screen of the moving-average cross over five segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.config import ExperimentConfig
from plumbline.functions import indicators as ind
from plumbline.operators import metrics as m
from plumbline.operators import portfolio as pf
from plumbline.operators import backtest as bt
from plumbline.plans import studies
from plumbline.queries import simulation as qs
from plumbline.queries.base import ANNUAL, SEGMENTS, W, add, rolled, rounded
from plumbline.queries.backtest import DD, metric_sql
from plumbline.queries.simulation import SHIFTS
from plumbline.queries.walkforward import DS, predictions
from plumbline.sources.adapters import price_path, read, segment_bars


def signals(spark, sf_dir):
    bars = segment_bars(spark, sf_dir)
    return bars.select("symbol", "date", "close", F.coalesce(F.signum(F.round(F.col("close") - ind.sma("close", 20), 6)), F.lit(0.0)).alias("signal"))


UPTO = "(partition by symbol order by date rows between unbounded preceding and current row)"
BASE = SEGMENTS + f""",
sig as (select symbol, date, close, coalesce(sign(round(close - ({rolled('avg', 'close', 20)}), 6)), 0.0)::double as signal from bars),
t0 as (select *, coalesce(close / nullif(lag(close) over {W}, 0) - 1, 0.0) as asset_return, row_number() over {W} as rn from sig),
t1 as (select *, coalesce(lag(signal) over {W}, 0.0) as position from t0),
t2 as (select *, abs(position - coalesce(lag(position) over {W}, 0.0)) as trade from t1),
t3 as (select *, position * asset_return - trade * 0.0002 as strategy_return, case when rn = 1 then asset_return - 0.0002 else asset_return end as benchmark_return from t2),
b as (select *, 100000.0 * product(1 + strategy_return) over {UPTO} as equity, 100000.0 * product(1 + benchmark_return) over {UPTO} as benchmark_equity from t3),
d as ({DD}), e as (select *, lag(position) over {W} as p_lag, avg(strategy_return) over (partition by symbol) as m from d),
q as (select symbol, asset_return, signal, (rn - 1)::int as pos, count(*) over (partition by symbol)::int as n from b),
ps as (select * from (values (0, 0), {', '.join(f'({i + 1}, {k})' for i, k in enumerate(SHIFTS))}) v(perm, shift)),
m1 as (select mv.*, q.asset_return from (select symbol, perm, (pos + shift) % n as pos, signal from q, ps) mv join q on q.symbol = mv.symbol and q.pos = mv.pos),
m2 as (select *, coalesce(lag(signal) over (partition by symbol, perm order by pos), 0.0) as p from m1),
m3 as (select *, p * asset_return - abs(p - coalesce(lag(p) over (partition by symbol, perm order by pos), 0.0)) * 0.0002 as r from m2),
nu as (select symbol, perm, avg(r) / stddev_samp(r) * {ANNUAL} as value from m3 group by 1, 2),
pv as (select n.symbol, (1 + sum((n.value >= o.value)::int)) / (1.0::double + count(*)) as p_value from nu n join nu o on o.symbol = n.symbol and o.perm = 0 where n.perm > 0 group by 1),
bm as (select symbol, avg(benchmark_return) / stddev_samp(benchmark_return) * {ANNUAL} as benchmark_sharpe from b group by 1),
me as (select symbol, count(*)::bigint as n_bars, {', '.join(f'{s} as {n}' for n, s in metric_sql('strategy_return', 'dd', 'position') if n != 'psr_z')} from e group by symbol),
s0 as (select me.*, benchmark_sharpe, sharpe - benchmark_sharpe as excess_sharpe, p_value from me join bm using (symbol) join pv using (symbol)),
s1 as (select *, row_number() over (order by p_value, symbol) as pr, count(*) over () as mm from s0),
s2 as (select *, least(min(p_value * mm / pr) over (order by pr desc rows unbounded preceding), 1.0) as q_value, row_number() over (order by excess_sharpe desc nulls last, symbol)::int as rank from s1)
"""
NUM = [c for c in studies.TABLE if c not in ("symbol", "rank", "n_bars")]
TABLE_SQL = "symbol, rank, n_bars, " + ", ".join(f"round({c}, 6) as {c}" for c in NUM)


def screened(spark, sf_dir):
    return studies.screen(signals(spark, sf_dir), SHIFTS)


@add("pipe_04_screen_universe", BASE + f"select {TABLE_SQL} from s2")
def screen(spark, sf_dir):
    return rounded(studies.screen_table(screened(spark, sf_dir)))


@add("pipe_06_screen_table", BASE + f"select {TABLE_SQL} from s2 where true")
def table(spark, sf_dir):
    return rounded(studies.screen_table(studies.ranked(screened(spark, sf_dir))))


@add("pipe_05_survivors", BASE + f"select {TABLE_SQL} from s2 where excess_sharpe > 0 and q_value <= 1.0")
def survivors(spark, sf_dir):
    return rounded(studies.screen_table(studies.survivors(screened(spark, sf_dir), 1.0)))


@add("aux_18_screen_entry_metrics", BASE + "select symbol, round(p_value, 6) as p_value, round(q_value, 6) as q_value, n_bars from s2")
def entries(spark, sf_dir):
    return rounded(screened(spark, sf_dir).select("symbol", "p_value", "q_value", "n_bars"))


@add("aux_19_ranked_entries", BASE + "select symbol, rank from s2")
def ranked(spark, sf_dir):
    return studies.ranked(screened(spark, sf_dir)).select("symbol", "rank")


@add("aux_20_failed_entries", "select c_mktsegment as symbol, 'too few bars' as error from customer where c_custkey in (select min(c_custkey) from customer)")
def failed(spark, sf_dir):
    rows = signals(spark, sf_dir)
    first = read(spark, sf_dir, "customer").agg(F.min_by("c_mktsegment", "c_custkey")).first()[0]
    short = rows.withColumn("rn", F.row_number().over(studies.Window.partitionBy("symbol").orderBy("date"))).where((F.col("symbol") != first) | (F.col("rn") < 8)).drop("rn")
    return studies.failures(studies.screen(short, SHIFTS[:3])).select("symbol", "error")


@add("agg_26_benjamini_hochberg", BASE + "select symbol, round(p_value, 6) as p_value, round(q_value, 6) as q_value from s2")
def fdr(spark, sf_dir):
    return rounded(screened(spark, sf_dir).select("symbol", "p_value", "q_value"))


def _scalar(name: str, sql: str, value, alias: str):
    @add(name, BASE + f"select {sql} as {alias} from s2")
    def run(spark, sf_dir):
        n = screened(spark, sf_dir).where("error is null").count()
        return spark.createDataFrame([(value(max(1, n)),)], f"{alias} double")


_scalar("agg_27_bonferroni", "round(0.05 / count(*), 8)", lambda n: round(m.bonferroni_threshold(n), 8), "threshold")
_scalar("agg_28_expected_false_positives", "round(0.05 * count(*)::double, 8)", lambda n: round(m.expected_false_positives(n), 8), "expected")
_scalar("aux_21_screen_bonferroni", "round(0.1 / count(*), 8)", lambda n: round(m.bonferroni_threshold(n, 0.1), 8), "threshold")
_scalar("aux_22_screen_expected_false_positives", "round(0.1 * count(*)::double, 8)", lambda n: round(m.expected_false_positives(n, 0.1), 8), "expected")

PORT = BASE + """, ns as (select count(distinct symbol) as n from b), cd as (select date from b group by date having count(distinct symbol) = (select n from ns))
select date, round(avg(strategy_return), 8) as ret from b where date in (select date from cd) group by date"""


@add("pipe_07_screen_portfolio", PORT)
def portfolio(spark, sf_dir):
    rows = bt.run_backtest(signals(spark, sf_dir)).select("symbol", "date", F.col("strategy_return").alias("ret"))
    return rounded(pf.build_portfolio(rows)["returns"].select("date", "ret"), 8)


K = "symbol, model"
RUN = DS + f""",
po as (select {K}, date, avg(signal) as signal, max(close) as close from pr group by {K}, date),
t0 as (select *, coalesce(close / nullif(lag(close) over (partition by {K} order by date), 0) - 1, 0.0) as ar, row_number() over (partition by {K} order by date) as rn, case when abs(signal) <= 0 then 0.0 else sign(signal) end::double as tp from po),
t1 as (select *, coalesce(lag(tp) over (partition by {K} order by date), 0.0) as p from t0),
t2 as (select *, p * ar - abs(p - coalesce(lag(p) over (partition by {K} order by date), 0.0)) * 0.0002 as r, case when rn = 1 then ar - 0.0002 else ar end as br from t1),
rs as (select {K}, case when stddev_samp(r) >= 1e-12 then avg(r) / nullif(stddev_samp(r), 0) * {ANNUAL} end as sharpe, product(1 + r) - 1 as total_return, avg(br) / stddev_samp(br) * {ANNUAL} as benchmark_sharpe from t2 group by {K})
"""
CONFIG = ExperimentConfig().with_horizon(5)


@add("pipe_02_run_metrics", RUN + f"select {K}, round(sharpe, 6) as sharpe, round(total_return, 6) as total_return, round(benchmark_sharpe, 6) as benchmark_sharpe, round(sharpe - benchmark_sharpe, 6) as excess_sharpe from rs")
def run_metrics(spark, sf_dir):
    return rounded(studies.run_metrics(predictions(spark, sf_dir), CONFIG).select("symbol", "model", "sharpe", "total_return", "benchmark_sharpe", "excess_sharpe"))


@add("pipe_03_compare_models", RUN + f"select {K}, round(sharpe, 6) as sharpe, row_number() over (partition by symbol order by sharpe desc nulls last, model)::int as rank from rs")
def compare(spark, sf_dir):
    return rounded(studies.compare_models(predictions(spark, sf_dir), CONFIG).select("symbol", "model", "sharpe", "rank"))


@add("pipe_01_run_model")
def run_model(spark, sf_dir):
    return studies.run_metrics(studies.run_model(price_path(spark, sf_dir), "ridge"), ExperimentConfig())


@add("pipe_08_simulation_bundle", f"""with null_part as (select * from ({qs.SIGNALS}{qs.ROTATED}{qs.JUDGED}select symbol, round(observed, 6) as observed, round(p_value, 6) as p_value from su)),
path_part as (select * from ({qs.PATHS}select symbol, {qs.PATH_COLUMNS} from {qs.PATH_ROWS} group by symbol)),
boot_part as (select * from ({qs.BOOT}select symbol, max(point_estimate) as point_estimate, {qs.BOOT_COLUMNS} from bo join {qs.POINT} using (symbol) group by symbol))
select symbol, observed, p_value, round(point_estimate, 6) as point_estimate, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high, round(mean_terminal_return, 6) as mean_terminal_return, round(worst_max_drawdown, 6) as worst_max_drawdown from null_part join path_part using (symbol) join boot_part using (symbol)""")
def bundle(spark, sf_dir):
    parts = studies.simulate(qs.signals(spark, sf_dir))
    out = parts["null"].join(parts["bootstrap"], "symbol").join(parts["paths"], "symbol")
    return rounded(out.select("symbol", "observed", "p_value", "point_estimate", "ci_low", "ci_high", "mean_terminal_return", "worst_max_drawdown"))
