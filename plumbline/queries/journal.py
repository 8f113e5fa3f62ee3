"""JRN, JOIN-06..08, AGG-29 and SRC-13..16 queries: forecasts of two deterministic models every third bar of five segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.config import BacktestConfig

from plumbline.functions import indicators as ind
from plumbline.functions.core import age_label, by_symbol as order_of
from plumbline.operators import features as fea
from plumbline.operators import journal as jr
from plumbline.queries.base import SEGMENTS, W, add, rounded
from plumbline.queries.walkforward import DS, corr_sql, light
from plumbline.sources.adapters import price_path, segment_bars
from plumbline.sources.scratch import new_folder

H = 5


def journal(spark, sf_dir):
    bars = segment_bars(spark, sf_dir)
    w = order_of()
    rows = bars.withColumn("rn", F.row_number().over(w)).withColumn("last", F.round(F.col("close") / F.lag("close").over(w) - 1, 9)).where("last is not null and rn % 3 = 0")
    models = F.inline(F.array(*[F.struct(F.lit(n).alias("model"), (F.col("last") * k).alias("signal")) for n, k in (("momentum", 1.0), ("reversion", -1.0))]))
    out = rows.select(F.col("date").alias("asof_date"), "symbol", "close", models)
    return out.select("asof_date", "symbol", "model", F.lit(H).alias("horizon"), "signal", F.when(F.abs("signal") < 0.002, 0.0).otherwise(F.signum("signal")).alias("position"), "close")


def scored(spark, sf_dir):
    return jr.score(journal(spark, sf_dir), segment_bars(spark, sf_dir))


def calendar(spark, sf_dir):
    return jr.trading_calendar(segment_bars(spark, sf_dir))


BASE = SEGMENTS + f""",
nb as (select *, row_number() over {W} as rn, round(close / lag(close) over {W} - 1, 9) as last from bars),
jj as (select date as asof_date, symbol, model, {H} as horizon, last * k as signal, case when abs(last * k) < 0.002 then 0.0 else sign(last * k) end::double as position, close
       from nb, (values ('momentum', 1.0::double), ('reversion', -1.0::double)) m(model, k) where last is not null and rn % 3 = 0),
j1 as (select jj.*, abs(position - coalesce(lag(position) over (partition by jj.symbol, model order by asof_date), 0.0)) as turnover, n0.rn as pos, n0.close as c0,
              row_number() over (partition by jj.symbol, model order by asof_date) as jn from jj join nb n0 on n0.symbol = jj.symbol and n0.date = asof_date),
j2 as (select j1.*, turnover * 0.0002 as cost, case when jn = 1 then 1.0 else pos - lag(pos) over (partition by j1.symbol, model order by asof_date) end::double as sessions_held, ln(n1.close) - ln(c0) as realised_return
       from j1 left join nb n1 on n1.symbol = j1.symbol and n1.rn = pos + {H}),
sc as (select *, position * realised_return - cost as pnl from j2),
dn as (select * from sc where realised_return is not null),
cal as (select date, row_number() over (order by date) as crn from (select distinct date from bars)),
de as (select dn.*, crn from dn join cal on date = asof_date)
"""
HIT = "avg(case when position <> 0 then (sign(position) = sign(realised_return))::int::double end)"
IC = "(select avg(ic) from (select {k}symbol, " + corr_sql("signal", "realised_return") + " as ic from dn group by {k}symbol))"


def _simple(name: str, sql: str, places: int = 6):
    def keep(f):
        add(name, BASE + sql)(lambda spark, sf_dir: rounded(f(spark, sf_dir), places))
        return f

    return keep


@_simple("src_13_journal_scan", "select asof_date, symbol, model, horizon, round(signal, 9) as signal, position, close from jj", 9)
def scan(spark, sf_dir):
    """The journal written as CSV, its columns in another order in the later half, and read again."""
    rows, path = journal(spark, sf_dir), f"{new_folder(spark, 'journal')}.csv"
    early = F.dayofmonth("asof_date") <= 15
    jr.save_journal(rows.where(early), f"{path}/early.csv")
    jr.save_journal(rows.where(~early).select(*reversed(rows.columns)), f"{path}/late.csv")
    return jr.load_journal(spark, f"{path}/early.csv").unionByName(jr.load_journal(spark, f"{path}/late.csv"))


@_simple("src_14_idempotent_append", "select asof_date, symbol, model, horizon, round(signal, 9) as signal, position, close from jj", 9)
def appended(spark, sf_dir):
    rows = journal(spark, sf_dir)
    first = rows.where(F.dayofmonth("asof_date") <= 15)
    return jr.append(jr.append(first, rows), rows)


@_simple("src_15_append_only_guard", "select * from (values ('grown', true), ('same', true), ('from nothing', true), ('a row gone', (select count(*) = 0 from (select * from jj except all select * from jj where asof_date > (select min(asof_date) from jj)))), ('a row changed', (select count(*) = 0 from (select asof_date, symbol, model, position from jj except all select asof_date, symbol, model, position + 1 from jj)))) t(\"case\", append_only)")
def append_only(spark, sf_dir):
    rows = journal(spark, sf_dir)
    first = rows.agg(F.min("asof_date")).first()[0]
    cases = {"grown": (rows.where(F.dayofmonth("asof_date") <= 15), rows), "same": (rows, rows), "from nothing": (rows.where("false"), rows), "a row gone": (rows, rows.where(F.col("asof_date") > first)), "a row changed": (rows, rows.withColumn("position", F.col("position") + 1))}
    return spark.createDataFrame([(k, jr.is_append_only(a, b)) for k, (a, b) in cases.items()], "case string, append_only boolean")


@_simple("aux_26_forecast_row", "select strftime(asof_date, '%Y-%m-%d') as asof_date, symbol, model, horizon, round(signal, 9) as signal, position, close from jj", 9)
def forecast_row(spark, sf_dir):
    return jr.forecast_row(journal(spark, sf_dir))


@_simple("src_16_rows_added", "select count(*)::bigint as added from jj where day(asof_date) > 15")
def added(spark, sf_dir):
    rows = journal(spark, sf_dir)
    return spark.createDataFrame([(jr.rows_added(rows.where(F.dayofmonth("asof_date") <= 15), rows),)], "added bigint")


@_simple("join_06_matured_return", "select asof_date, symbol, model, round(realised_return, 8) as realised_return from sc", 8)
def matured(spark, sf_dir):
    return jr.realised(journal(spark, sf_dir), segment_bars(spark, sf_dir)).select("asof_date", "symbol", "model", "realised_return")


@_simple("join_07_sessions_held", "select asof_date, symbol, model, sessions_held from sc")
def held(spark, sf_dir):
    return jr.sessions_held(journal(spark, sf_dir), segment_bars(spark, sf_dir)).select("asof_date", "symbol", "model", "sessions_held")


@_simple("join_08_trading_calendar", "select date from cal")
def trading_calendar(spark, sf_dir):
    return calendar(spark, sf_dir)


@_simple("jrn_03_score_journal", "select asof_date, symbol, model, horizon, position, round(turnover, 6) as turnover, round(cost, 8) as cost, sessions_held, round(realised_return, 8) as realised_return, round(pnl, 8) as pnl from sc", 8)
def score_journal(spark, sf_dir):
    return scored(spark, sf_dir).select("asof_date", "symbol", "model", "horizon", "position", "turnover", "cost", "sessions_held", "realised_return", "pnl")


TURN = "sum(turnover) / nullif(sum(sessions_held), 0) * 252"


@_simple("jrn_04_live_metrics", f"select (select count(*) from sc where realised_return is null)::double as n_pending, count(*)::double as n_scored, round({HIT}, 6) as hit_rate, round({IC.format(k='')}, 6) as live_ic, round({corr_sql('signal', 'realised_return')}, 6) as live_ic_pooled, round(avg(pnl), 6) as mean_pnl, round(sum(pnl), 6) as total_pnl, round(avg(pnl) / stddev_samp(pnl) * sqrt(252.0 / {H}), 6) as live_sharpe, round({TURN}, 6) as annual_turnover, count(distinct symbol)::double as n_symbols, (max(asof_date) - min(asof_date))::double as span_days, round((select avg(t) from (select {TURN} as t from sc group by symbol)), 6) as live_annual_turnover from dn")
def live_metrics(spark, sf_dir):
    return jr.live_metrics(scored(spark, sf_dir))


@_simple("jrn_05_by_symbol", f"select symbol, count(*)::bigint as n, round({HIT}, 6) as hit_rate, round(avg(pnl), 6) as mean_pnl, round(sum(pnl), 6) as total_pnl from dn where position <> 0 group by symbol")
def by_symbol(spark, sf_dir):
    return jr.by_symbol(jr.scored_rows(scored(spark, sf_dir)))


@_simple("jrn_06_annualised_turnover", f"select model, round({TURN}, 6) as turnover from sc group by model")
def turnover(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("model").agg(jr.annualised_turnover(()).alias("turnover"))


@_simple("jrn_07_live_annual_turnover", f"select round(avg(t), 6) as live_annual_turnover from (select {TURN} as t from sc group by symbol)")
def live_turnover(spark, sf_dir):
    return jr.live_turnover(scored(spark, sf_dir))


@_simple("jrn_08_live_sharpe", f"select model, round(avg(pnl) / stddev_samp(pnl) * sqrt(252.0 / {H}), 6) as live_sharpe from dn group by model")
def live_sharpe(spark, sf_dir):
    return jr.scored_rows(scored(spark, sf_dir)).groupBy("model").agg(jr.live_sharpe().alias("live_sharpe"))


BLOCKS = "(select count(distinct (crn - lo) // {h}) from {src}, (select min(crn) as lo from {src} {where}) {where})::double"
D_ALL, D_DEC = BLOCKS.format(h=H, src="de", where=""), BLOCKS.format(h=H, src="de", where="where position <> 0")


@_simple("agg_29_independent_blocks", f"select {D_ALL} as n_independent")
def blocks(spark, sf_dir):
    return jr.independent_blocks(jr.scored_rows(scored(spark, sf_dir)), calendar(spark, sf_dir))


CLAIM, CLAIM_IC = 0.52, 0.03
Z = f"(hit - {CLAIM}) / sqrt({CLAIM * (1 - CLAIM)!r} / {{n}})"
FZ = f"case when {{n}} >= 4 and abs(ic) < 1 then (atanh(ic) - atanh({CLAIM_IC})) * sqrt({{n}} - 3) end"
COMPARED = f"round(n::double, 6) as n_scored, nd::double as n_decided, ni::double as n_independent, nii::double as n_independent_ic, {CLAIM}::double as backtest_directional_accuracy, round(hit, 6) as live_hit_rate, round(hit - {CLAIM}, 6) as hit_rate_gap, {CLAIM_IC}::double as backtest_ic, round(ic, 6) as live_ic, round(ic - {CLAIM_IC}, 6) as ic_gap, round({FZ.format(n='n')}, 6) as ic_z_naive, round({FZ.format(n='nii')}, 6) as ic_z, round({Z.format(n='nd')}, 6) as hit_rate_z_naive, round({Z.format(n='ni')}, 6) as hit_rate_z"


@_simple("jrn_09_live_vs_backtest", f"select {COMPARED} from (select count(*) as n, count(*) filter (position <> 0) as nd, {D_DEC} as ni, {D_ALL} as nii, {HIT} as hit, {IC.format(k='')} as ic from dn)")
def versus_backtest(spark, sf_dir):
    return jr.compare_with_backtest(scored(spark, sf_dir), calendar(spark, sf_dir), CLAIM, CLAIM_IC)


@_simple("jrn_10_versus_always_long", f""", q as (select *, sign(position) = sign(realised_return) as m, realised_return > 0 as l from de where position <> 0),
qa as (select count(*)::double as n_decided, avg(m::int::double) as live_hit_rate, avg(l::int::double) as always_long_hit_rate, count(*) filter (position < 0)::double as n_short, count(*) filter (m and not l)::double as b, count(*) filter (l and not m)::double as c from q),
qd as (select * from q where m <> l), qb as (select count(distinct (crn - (select min(crn) from qd)) // {H})::double as ni from qd),
qp as (select sum(pnl) as live_pnl, sum(realised_return) as always_long_pnl, avg(pnl - realised_return) / stddev_samp(pnl - realised_return) as drift, count(*) as n from dn)
select n_decided, round(live_hit_rate, 6) as live_hit_rate, round(always_long_hit_rate, 6) as always_long_hit_rate, round(live_hit_rate - always_long_hit_rate, 6) as hit_rate_gap, n_short, b + c as n_discordant, ni as n_independent_discordant,
round((b - c) / (b + c) * sqrt(ni), 6) as skill_z, round((b - c) / (b + c) * sqrt(b + c), 6) as skill_z_naive, round(live_pnl, 6) as live_pnl, round(always_long_pnl, 6) as always_long_pnl, round(live_pnl - always_long_pnl, 6) as pnl_gap,
{D_ALL} as n_independent_pnl, round(drift * sqrt({D_ALL}), 6) as pnl_gap_z, round(drift * sqrt(n), 6) as pnl_gap_z_naive from qa, qb, qp""")
def versus_long(spark, sf_dir):
    return jr.compare_with_always_long(scored(spark, sf_dir), calendar(spark, sf_dir))


ROLL = f""", pd as (select asof_date, count(*) as k from dn group by 1), cu as (select asof_date, sum(k) over (order by asof_date) as upto, sum(k) over (order by asof_date) - k as before from pd),
sp as (select e.asof_date as window_end, max(s.asof_date) as window_start from cu e join cu s on s.before <= e.upto - 30 and s.asof_date <= e.asof_date where e.upto >= 30 group by 1),
ro as (select window_end, de.* from de join sp on de.asof_date >= window_start and de.asof_date <= window_end),
ric as (select window_end, avg(ic) as ic from (select window_end, symbol, {corr_sql('signal', 'realised_return')} as ic from ro group by 1, 2) group by 1),
rlo as (select ro.*, min(crn) over (partition by window_end) as lo, min(case when position <> 0 then crn end) over (partition by window_end) as lod from ro),
rm as (select window_end, count(*) as n, count(*) filter (position <> 0) as nd, count(distinct case when position <> 0 then (crn - lod) // {H} end) as ni, count(distinct (crn - lo) // {H}) as nii, {HIT} as hit from rlo group by 1)
"""


@_simple("jrn_11_rolling_comparison", ROLL + f"select window_end as asof_date, {COMPARED} from rm join ric using (window_end)")
def rolling(spark, sf_dir):
    return jr.rolling_compare(scored(spark, sf_dir), calendar(spark, sf_dir), CLAIM, CLAIM_IC)


@_simple("jrn_12_decided_rows", "select asof_date, symbol, model, position from dn where position <> 0")
def decided(spark, sf_dir):
    return jr.decided(jr.scored_rows(scored(spark, sf_dir))).select("asof_date", "symbol", "model", "position")


ASOF = "2001-08-03"
FRESH = f", lb as (select symbol, max(date) as last_bar from bars group by symbol), fr as (select symbol, last_bar, (date '{ASOF}' - last_bar)::double as age_days, len(list_filter(generate_series(last_bar + interval 1 day, timestamp '{ASOF}' - interval 1 day, interval 1 day), lambda d: isodow(d) <= 5))::double as missed_sessions from lb)"


@_simple("jrn_13_data_freshness", FRESH + " select symbol, last_bar, age_days, missed_sessions, missed_sessions > 1 as stale from fr")
def freshness(spark, sf_dir):
    return jr.data_freshness(segment_bars(spark, sf_dir), ASOF)


@_simple("fn_15_missed_sessions", FRESH + " select symbol, missed_sessions from fr")
def missed(spark, sf_dir):
    return jr.data_freshness(segment_bars(spark, sf_dir), ASOF).select("symbol", "missed_sessions")


@_simple("fn_08_age_label", FRESH + " select symbol, age_days::int::varchar || 'd' as label from fr")
def ages(spark, sf_dir):
    return jr.data_freshness(segment_bars(spark, sf_dir), ASOF).select("symbol", age_label("age_days").alias("label"))


@_simple("cli_09_freshness_line", FRESH + " select symbol, 'newest bar ' || last_bar::varchar || case when missed_sessions > 1 then ' STALE (' || missed_sessions::int::varchar || ' sessions missed)' else '' end as line from fr")
def freshness_line(spark, sf_dir):
    from plumbline.operators.reporting import freshness_line as line

    return line(jr.data_freshness(segment_bars(spark, sf_dir), ASOF))


@_simple("jrn_14_stale_symbols", FRESH + " select symbol from fr where age_days > 2")
def stale(spark, sf_dir):
    return jr.stale_symbols(jr.data_freshness(segment_bars(spark, sf_dir), ASOF), 2)


@_simple("jrn_15_outcome_begun", ", lb as (select symbol, max(date) as last_bar from bars group by symbol) select symbol from lb where ((last_bar + case isodow(last_bar) when 5 then 3 when 6 then 2 else 1 end)::timestamp + interval 16 hour)::timestamp at time zone 'America/New_York' <= timestamptz '2100-01-01 00:00:00+00'")
def begun(spark, sf_dir):
    return jr.outcome_begun(segment_bars(spark, sf_dir), "2100-01-01 00:00:00")


@_simple("jrn_16_last_bar_date", "select symbol, max(date) as last_bar from bars group by symbol")
def last_bars(spark, sf_dir):
    return jr.last_bar(segment_bars(spark, sf_dir))


PEND = ", pe as (select * from sc where realised_return is null), pk as (select asof_date, count(*) as k from pe group by 1), pc as (select asof_date, sum(k) over (order by asof_date) as cum, row_number() over (order by asof_date) as rn from pk)"


@_simple("jrn_17_in_flight", PEND + " select asof_date, symbol, round(signal, 9) as signal, position from pe where asof_date in (select asof_date from pc where rn = 1 or cum <= 8)", 9)
def in_flight(spark, sf_dir):
    return jr.in_flight(jr.pending_rows(scored(spark, sf_dir)), 8)[0]


@_simple("jrn_02_size_position", f", r as (select *, coalesce(close / lag(close) over {W} - 1, 0.0) as ar from bars), v as (select *, case when count(ar) over (partition by symbol order by date rows 19 preceding) = 20 then stddev_samp(ar) over (partition by symbol order by date rows 19 preceding) * sqrt(252) end as vol from r) select j.asof_date, j.symbol, round(greatest(least(sign(signal) * coalesce(0.1 / case when vol > 0 then vol end, 0.0), 1.0), -1.0)::double, 6) as position from jj j join v on v.symbol = j.symbol and v.date = j.asof_date where model = 'momentum'")
def size_position(spark, sf_dir):
    rows = journal(spark, sf_dir).where("model = 'momentum'").select("symbol", "asof_date", "signal")
    return jr.size_last(segment_bars(spark, sf_dir), rows, BacktestConfig(vol_target=0.1)).select("asof_date", "symbol", "position")


@add("jrn_01b_record_one_feature", DS + ", st as (select symbol, avg(ret_1d) as mx, stddev_pop(ret_1d) as sx, avg(forward_return) as my, stddev_pop(forward_return) as sy, covar_pop(ret_1d, forward_return) as c, count(*) as n from ds group by 1), la as (select symbol, max(date) as date from bars group by 1), sg as (select t.symbol, t.date, t.close, my + sy * ((t.ret_1d - mx) / sx) * (n * c / (sx * sy)) / (n + 50.0) as signal from tt t join la on la.symbol = t.symbol and la.date = t.date join st on st.symbol = t.symbol) select date as asof_date, symbol, 'ridge' as model, 5 as horizon, round(signal, 8) as signal, sign(signal)::double as position, close from sg")
def record_one(spark, sf_dir):
    """Ridge on one feature, fitted on all labelled rows, forecasting each symbol's last bar."""
    bars = price_path(spark, sf_dir)
    last = bars.withColumn("ret_1d", F.round(ind.log_return("close", 1), 9)).withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where("rn = 1")
    return rounded(jr.record(light(spark, sf_dir), last, "ridge", ["ret_1d"], H, bars), 8)


@add("jrn_01_record_forecasts")
def record(spark, sf_dir):
    bars = price_path(spark, sf_dir)
    features = fea.build_features(bars)
    names = fea.feature_names()
    last = features.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where("rn = 1")
    return jr.record(fea.build_dataset(bars), last, "ridge", names, 1, bars)


