"""WAT, JOIN-04, JOIN-05 and related queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.core import by_symbol, range_bar
from plumbline.operators import watch as wt
from plumbline.queries.base import ANNUAL, SEGMENTS, W, add, rounded
from plumbline.sources.adapters import segment_bars

LEADERS, FOLLOWERS = ("AUTOMOBILE", "BUILDING"), ("FURNITURE", "HOUSEHOLD", "MACHINERY")


def _f(a: int, b: str) -> str:
    return f"(partition by symbol order by date rows between {a} preceding and {b})"


NOW, BEFORE = "current row", "1 preceding"
SNAP = SEGMENTS + f""",
s0 as (select *, count(*) over {W} as n, close / lag(close) over {W} - 1 as r, ln(close) - ln(lag(close) over {W}) as l, row_number() over (partition by symbol order by date desc) as rk from bars),
s1 as (select *, case when count(l) over {_f(19, NOW)} = 20 then stddev_samp(l) over {_f(19, NOW)} * {ANNUAL} end as volatility from s0),
s2 as (select *, {', '.join(f'close / lag(close, {k}) over {W} - 1 as ret_{k}' for k in wt.RETURN_WINDOWS)}, {', '.join(f'case when n >= {k} then close / avg(close) over {_f(k - 1, NOW)} - 1 end as ma_gap_{k}' for k in wt.MEAN_WINDOWS)},
   max(close) over {_f(251, NOW)} as high_52w, min(close) over {_f(251, NOW)} as low_52w, case when count(r) over {_f(60, BEFORE)} >= 20 then stddev_samp(r) over {_f(60, BEFORE)} end as spread,
   list(r) filter (r is not null) over {_f(252, BEFORE)} as past, list(volatility) filter (volatility is not null) over {_f(755, NOW)} as vols, case when n > 20 then avg(volume) over {_f(20, BEFORE)} end as busy from s1),
s3 as (select *, (select max_by(b.close, b.date) from bars b where b.symbol = s2.symbol and year(b.date) < year(s2.date)) as py from s2 where rk = 1),
sn as (select symbol, date, close, {', '.join(f'ret_{k}' for k in wt.RETURN_WINDOWS)}, close / py - 1 as ytd, high_52w, low_52w, (close - low_52w) / nullif(high_52w - low_52w, 0) as range_position, {', '.join(f'ma_gap_{k}' for k in wt.MEAN_WINDOWS)}, volatility,
   len(list_filter(vols, lambda v: v <= volatility))::double / nullif(len(vols), 0) as volatility_percentile, r / nullif(spread, 0) as move_z, len(list_filter(past, lambda v: abs(v) >= abs(r)))::bigint as similar_moves, volume / nullif(busy, 0) as volume_ratio from s3)
"""
SHOWN = [*[f"ret_{k}" for k in wt.RETURN_WINDOWS], "ytd", "high_52w", "low_52w", "range_position", *[f"ma_gap_{k}" for k in wt.MEAN_WINDOWS], "volatility", "volatility_percentile", "move_z", "volume_ratio"]


@add("wat_01_snapshot", SNAP + f"select symbol, date, close, similar_moves, {', '.join(f'round({c}, 6) as {c}' for c in SHOWN)} from sn")
def snapshot(spark, sf_dir):
    return rounded(wt.snapshot(segment_bars(spark, sf_dir)))


@add("wat_02_trailing_return", SEGMENTS + f"select symbol, date, {', '.join(f'round(close / lag(close, {k}) over {W} - 1, 8) as ret_{k}' for k in wt.RETURN_WINDOWS)} from bars")
def trailing(spark, sf_dir):
    return rounded(segment_bars(spark, sf_dir).select("symbol", "date", *[(F.col("close") / F.lag("close", k).over(by_symbol()) - 1).alias(f"ret_{k}") for k in wt.RETURN_WINDOWS]), 8)


@add("wat_03_flags", SNAP + "select symbol, 'unusual_move' as flag from sn where abs(move_z) >= 2 union all select symbol, 'high_52w' from sn where close >= high_52w union all select symbol, 'low_52w' from sn where close <= low_52w and close < high_52w union all select symbol, 'heavy_volume' from sn where volume_ratio >= 2 union all select symbol, 'high_volatility' from sn where volatility_percentile >= 0.9")
def flags(spark, sf_dir):
    return wt.flags(wt.snapshot(segment_bars(spark, sf_dir)))


@add("fn_11_range_bar", SNAP + "select symbol, repeat('─', least(greatest(round(range_position * 9), 0), 9)::int) || '●' || repeat('─', 9 - least(greatest(round(range_position * 9), 0), 9)::int) as bar from sn")
def bars_text(spark, sf_dir):
    return wt.snapshot(segment_bars(spark, sf_dir)).select("symbol", range_bar("range_position").alias("bar"))


LINKS = SEGMENTS + f""",
le as (select * from (select symbol as leader, date as ld, close / lag(close) over {W} - 1 as leader_return from bars where symbol in {LEADERS}) where leader_return is not null),
fo as (select * from (select symbol as follower, date, open / lag(close) over {W} - 1 as gap, close / open - 1 as intraday from bars where symbol in {FOLLOWERS}) where gap is not null),
pa as (select f.*, l.leader, l.leader_return from (select fo.*, ls.leader as want from fo, (select distinct leader from le) ls) f asof join le l on f.want = l.leader and f.date > l.ld),
rk as (select *, row_number() over (partition by leader, follower order by date desc) as k from pa),
ft as (select leader, follower, count(*)::bigint as n, covar_samp(leader_return, gap) / nullif(var_samp(leader_return), 0) as slope, corr(leader_return, gap) as correlation, corr(leader_return, intraday) as intraday_correlation from rk where k > 1 and k <= 253 group by 1, 2 having count(*) >= 30)
"""


def links(spark, sf_dir):
    bars = segment_bars(spark, sf_dir)
    return wt.overnight_links(bars.where(F.col("symbol").isin(*LEADERS)), bars.where(F.col("symbol").isin(*FOLLOWERS)))


@add("join_04_overnight_asof", LINKS + "select rk.leader, rk.follower, date, round(leader_return, 6) as leader_return, round(gap, 6) as gap, round(intraday, 6) as intraday, n, round(correlation, 6) as correlation, round(intraday_correlation, 6) as intraday_correlation, round(slope, 6) as slope, round(slope * leader_return, 6) as expected_gap from rk join ft on rk.leader = ft.leader and rk.follower = ft.follower where k = 1")
def overnight(spark, sf_dir):
    return rounded(links(spark, sf_dir))


@add("wat_04_expected_gap", LINKS + "select rk.leader, rk.follower, round(slope * leader_return, 6) as expected_gap from rk join ft on rk.leader = ft.leader and rk.follower = ft.follower where k = 1")
def expected_gap(spark, sf_dir):
    return rounded(links(spark, sf_dir).select("leader", "follower", "expected_gap"))


NOTES = [("1997-03-15", "BUILDING; FURNITURE", "demand", "orders rise"), ("1998-06-01", "MACHINERY;", "supply", "plant halts"), ("2001-01-01", "BUILDING", "late", "after the last bar"), ("1997-05-05", "NOWHERE;AUTOMOBILE", "mixed", "one unknown")]


def notes(spark):
    from plumbline.sources.ingest import load_notes

    return load_notes(spark.createDataFrame(NOTES, "date string, symbols string, category string, note string"))


VALUES = ", ".join(f"(date '{d}', '{s}', '{c}', '{n}')" for d, s, c, n in NOTES)


@add("src_12_notes", f"select * from (values {VALUES}) t(date, symbols, category, note)")
def scan_notes(spark, sf_dir):
    return notes(spark)


@add("join_05_note_followup", SEGMENTS + f""", nt as (select date, trim(unnest(string_split(symbols, ';'))) as symbol, category, note from (values {VALUES}) t(date, symbols, category, note)),
ah as (select symbol, date as bd, lead(close, 5) over {W} / close - 1 as ret_5, lead(close, 20) over {W} / close - 1 as ret_20 from bars)
select nt.date, nt.symbol, category, note, round(ret_5, 8) as ret_5, round(ret_20, 8) as ret_20 from (select * from nt where symbol <> '') nt asof left join ah on nt.symbol = ah.symbol and nt.date >= ah.bd""")
def followups(spark, sf_dir):
    return rounded(wt.note_followups(notes(spark), segment_bars(spark, sf_dir)), 8)
