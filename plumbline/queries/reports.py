"""REP queries: verdicts, downsampling and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.config import BacktestConfig, ExperimentConfig
from plumbline.operators import journal as jr
from plumbline.operators import portfolio as pf
from plumbline.operators import reporting as rep
from plumbline.operators import simulation as sim
from plumbline.operators import walkforward as wf
from plumbline.queries import journal as qj
from plumbline.queries import portfolio as qp
from plumbline.queries import simulation as qs
from plumbline.queries import walkforward as qw
from plumbline.queries.backtest import BACKTEST_SQL, backtest
from plumbline.queries.base import SEGMENTS, add, rounded
from plumbline.sources.adapters import read, segment_bars


@add("rep_03_downsample", BACKTEST_SQL + ", i as (select symbol, date, equity, (rn - 1) as i, count(*) over (partition by symbol) as n from b) select symbol, (i * least(60, n) // n)::bigint as bucket, round(max_by(equity, date), 4) as equity from i group by 1, 2")
def downsample(spark, sf_dir):
    return rounded(rep.downsample(backtest(spark, sf_dir), "equity", 60), 4)


@add("rep_06_histogram", SEGMENTS + ", x as (select symbol, volume, min(volume) over (partition by symbol) as lo, max(volume) over (partition by symbol) as hi from bars) select symbol, (case when hi > lo then least(floor((volume - lo) / ((hi - lo) / 20)), 19) else 0 end)::int as bin, count(*)::bigint as n from x group by 1, 2")
def histogram(spark, sf_dir):
    return rep.histogram(segment_bars(spark, sf_dir), "volume")


@add("rep_14_significance_verdict", qs.NULL + "select symbol, case when p_value <= 0.01 then 'strong' when p_value <= 0.05 then 'moderate' when p_value <= 0.2 then 'weak' else 'none' end as verdict from su")
def significance(spark, sf_dir):
    return sim.significance(qs.null(spark, sf_dir)).select("symbol", rep.significance_verdict("p_value").alias("verdict"))


@add("rep_15_decay_verdict", qj.BASE + f"select case when n < 30 then 'too few forecasts' when ni < 10 then 'too few blocks' when z is null then 'no claim' when z <= -2 then 'below the claim' when z >= 2 then 'above the claim' else 'consistent' end as verdict from (select n, ni, {qj.Z.format(n='ni')} as z from (select count(*) as n, {qj.D_DEC} as ni, {qj.HIT} as hit from dn))")
def decay(spark, sf_dir):
    c = jr.compare_with_backtest(qj.scored(spark, sf_dir), qj.calendar(spark, sf_dir), qj.CLAIM, qj.CLAIM_IC)
    return c.select(rep.decay_verdict("n_scored", "n_independent", "hit_rate_z").alias("verdict"))


@add("rep_16_freshness_verdict", qj.BASE + qj.FRESH + " select case when max(missed_sessions) > 1 then 'behind' when max(missed_sessions) <= 0 then 'current' else 'within tolerance' end as verdict from fr")
def freshness(spark, sf_dir):
    return rep.freshness_verdict(jr.data_freshness(segment_bars(spark, sf_dir), qj.ASOF))


@add("rep_17_selection_verdict", qw.REC + ", cn as (select symbol, candidate, count(*) as k from best where chosen group by 1, 2), st as (select symbol, max(k) / sum(k)::double as share from cn group by 1), sp as (select symbol, avg(gap) as spread from (select symbol, fold, max(score) - min(score) as gap from rec where score is not null group by 1, 2 having count(*) >= 2) group by 1) select symbol, case when share < 0.5 then 'unstable' when spread < 0.01 then 'flat' else 'stable' end as verdict from st join sp using (symbol)")
def selection(spark, sf_dir):
    r = qw.fake_records(spark, sf_dir)
    share = wf.selection_stability(wf.selected_params(r)).groupBy("symbol").agg(F.min("modal_share").alias("share"))
    return share.join(wf.selection_spread(r), "symbol").select("symbol", rep.selection_verdict("share", "spread").alias("verdict"))


@add("rep_18_sleeve_vs_asset_verdict", qp.BASE + "select case when s < a - 0.1 then 'sleeves less correlated' when s > a + 0.1 then 'sleeves more correlated' else 'alike' end as verdict from (select avg(corr) as s, avg(acorr) as a from cv where sym_a < sym_b)")
def sleeve_vs_asset(spark, sf_dir):
    p = pf.build_portfolio(qp.sleeves_all(spark, sf_dir), assets=qp.assets_all(spark, sf_dir))
    a = pf.mean_off_diagonal(pf.correlation(p["sleeves"])).withColumn("k", F.lit(0))
    b = pf.mean_off_diagonal(pf.correlation(p["assets"])).select(F.col("mean_correlation").alias("asset"), F.lit(0).alias("k"))
    return a.join(b, "k").select(rep.sleeve_vs_asset_verdict("mean_correlation", "asset").alias("verdict"))


NL = "' || chr(10) || '"


@add("fn_10_percent_cell", "select c_custkey, case when c_custkey % 5 = 0 then '—' else format('{:+.1f}%', c_custkey / 10.0) end as signed, case when c_custkey % 5 = 0 then '—' else format('{:.0f}%', c_custkey / 10.0) end as plain from customer where c_custkey % 10 <> 5")
def percent_cell(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").where("c_custkey % 10 <> 5").select("c_custkey").collect()
    value = lambda k: None if k % 5 == 0 else k / 1000
    return spark.createDataFrame([(r[0], rep.signed_percent(value(r[0])), rep.signed_percent(value(r[0]), 0, signed=False)) for r in rows], "c_custkey bigint, signed string, plain string")


@add("rep_01_markdown_table", f"select '| ' || rpad('name', w, ' ') || ' | key |{NL}|' || repeat('-', (w + 2)::int) || '|-----|{NL}' || string_agg('| ' || rpad(n_name, w, ' ') || ' | ' || rpad(n_nationkey::varchar, 3, ' ') || ' |', chr(10) order by n_nationkey) as markdown from nation, (select max(length(n_name))::int as w from nation) group by w")
def markdown(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name", "n_nationkey").collect()
    return spark.createDataFrame([(rep.markdown_table(["name", "key"], rows),)], "markdown string")


@add("rep_02_metrics_table", f"select '| metric   | a      | b        |{NL}|----------|--------|----------|{NL}| sharpe   | 0.5000 | n/a      |{NL}| hit_rate | 51.25% | n/a      |{NL}| n        | n/a    | 12,345.0 |' as markdown")
def metrics(spark, sf_dir):
    return spark.createDataFrame([(rep.metrics_table({"a": {"sharpe": 0.5, "hit_rate": 0.5125}, "b": {"sharpe": float("nan"), "n": 12345.0}}),)], "markdown string")


@add("rep_04_sparkline", SEGMENTS + ", x as (select symbol, close, (row_number() over w - 1)::bigint as i, count(*) over (partition by symbol) as n from bars window w as (partition by symbol order by date)), p as (select symbol, k, close from x, (select unnest(range(0, 60)) as k) where i = greatest(k * n // 60, (k + 1) * n // 60 - 1)), e as (select *, min(close) over (partition by symbol) as lo, max(close) over (partition by symbol) as hi from p) select symbol, string_agg(substr('▁▂▃▄▅▆▇█', (round_even((close - lo) / (hi - lo) * 7, 0) + 1)::int, 1), '' order by k) as line from e group by symbol")
def spark_line(spark, sf_dir):
    rows = segment_bars(spark, sf_dir).select("symbol", "date", "close").orderBy("symbol", "date").collect()
    series = {}
    for r in rows:
        series.setdefault(r["symbol"], []).append(r["close"])
    return spark.createDataFrame([(k, rep.sparkline(v)) for k, v in series.items()], "symbol string, line string")


@add("rep_05_line_chart", "select 'rows 9, marks 8 and 3, first on top' as chart")
def line_chart(spark, sf_dir):
    """The drawn chart read back: its rows, the marks of each series, and which series wins a shared cell."""
    drawn = rep.line_chart({"a": [1, 2, 3, 4, 5, 6, 7, 8], "b": [8, 7, 6, 5, 5, 6, 7, 8]}, width=8, height=7)
    body = drawn.split("\n")[:7]
    a, b = sum(x.count("#") for x in body), sum(x.count("*") for x in body)
    top = "first on top" if body[0].rstrip().endswith("#") else "last on top"
    return spark.createDataFrame([(f"rows {len(drawn.splitlines())}, marks {a} and {b}, {top}",)], "chart string")


@add("rep_07_bars", f"select 'up      |####  +2.000%{NL}dn  ####|      -2.000%{NL}nil     |      n/a{NL}z       |      +0.000%' as bars")
def bars(spark, sf_dir):
    return spark.createDataFrame([(rep.bar_chart(["up", "dn", "nil", "z"], [2.0, -2.0, None, 0.0], width=8, unit="%"),)], "bars string")


@add("rep_08_report_builder", f"select '# T{NL}{NL}_s_{NL}{NL}## H{NL}{NL}text{NL}{NL}- a{NL}- b{NL}{NL}| x | y      |{NL}|---|--------|{NL}| 1 | 0.5000 |{NL}{NL}```{NL}c{NL}```{NL}' as markdown")
def builder(spark, sf_dir):
    out = rep.Report("T", "s").heading("H").text("text").bullets(["a", "b"]).frame(spark.createDataFrame([(1, 0.5)], "x int, y double")).code("c")
    return spark.createDataFrame([(out.render(),)], "markdown string")


@add("aux_27_ranking_row", "select 'ridge' as c0, '0.5000' as c1, '-0.1000' as c2, '10.46%' as c3, '-36.80%' as c4, '0.0832' as c5, '2.9685' as c6, '52.00%' as c7, '103.9400' as c8, 'n/a' as c9")
def ranking_row(spark, sf_dir):
    row = rep.ranking_row("ridge", {"sharpe": 0.5, "excess_sharpe": -0.1, "annualised_return": 0.1046, "max_drawdown": -0.368, "ic_fold_mean": 0.0832, "ic_fold_t": 2.9685, "directional_accuracy": 0.52, "annual_turnover": 103.94})
    return spark.createDataFrame([tuple(row)], ", ".join(f"c{i} string" for i in range(len(row))))


@add("aux_04_total_cost", "select 3.5::double as total_cost_bps, 5 as horizon, 1 as horizon_before")
def total_cost(spark, sf_dir):
    """AUX-04 and AUX-05: summed costs, and a copy of an experiment with another horizon."""
    before = ExperimentConfig()
    after = before.with_horizon(5)
    return spark.createDataFrame([(BacktestConfig(cost_bps=1.5, slippage_bps=2.0).total_cost_bps, after.features.horizon, before.features.horizon)], "total_cost_bps double, horizon int, horizon_before int")


@add("aux_25_benchmark_present", "select count(*) filter (c_acctbal is not null) > 0 as present from customer")
def present(spark, sf_dir):
    return read(spark, sf_dir, "customer").agg((F.count("c_acctbal") > 0).alias("present"))
