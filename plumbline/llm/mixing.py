"""Operator 4: mixing sources to target weights by a time-varying curriculum.

Only DataFrame functions run here. Each source has a weight and a schedule: a
piecewise-linear weight over training time 0..1. The source's demand for tokens
up to time t is its target times the normalised integral of its schedule. The
documents of a source stand in a fixed pseudo-random order (md5 of doc_id); the
middle of a document, counted in the source's tokens (a second epoch follows the
first), is put into the inverse of the demand, which gives its training
position. Sorting all rows by position by range gives the training order.

Scale: the running count of tokens within a source is made of two parts, sums
for each (source, first three hex digits of md5) and a window inside such a
bucket; so a source with a third of all rows is spread over 4,096 buckets. The
window and the join with the buckets' starts share one exchange of the rows, and
the range sort is the other. The only table on one task has a row for each source.

Defined cases: null or empty text has size 0 and gets no position; very long texts
are one document whose middle decides; a null source is a source of its own, last
in order; null doc_ids sort first; rows of one doc_id are ordered by size, then by
a hash of the text, so ties do not depend on arrival; repeated rows are rows of
their own; an empty table gives no rows; extra columns are carried by curriculum(),
whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating, and the weight over time of each such class as (time, level) knots.
WEIGHTS = (3, 1, 2)
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
SHARE = 1.5
MAX_REPEAT = 2


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null counts as none."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1)
    n = F.size(parts)
    return (n - F.when(F.element_at(parts, 1) == "", 1).otherwise(0) - F.when((n > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("bigint")


def _invert(y: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which the normalised integral of a piecewise-linear schedule reaches y (0..1)."""
    area, cum = 0.0, []
    for (t0, r0), (t1, r1) in zip(knots, knots[1:]):
        cum.append(area)
        area += (r0 + r1) / 2 * (t1 - t0)
    if area <= 0:
        raise ValueError("a schedule needs a positive integral")
    out: Column | None = None
    for ((t0, r0), (t1, r1)), start in zip(zip(knots, knots[1:]), cum):
        part = (r0 + r1) / 2 * (t1 - t0)
        need = F.greatest(y * area - start, F.lit(0.0))
        slope = (r1 - r0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(r0 * r0) + 2 * slope * need, F.lit(0.0)))
        at = F.lit(t0) + F.coalesce(F.try_divide(2 * need, F.lit(r0) + root), F.lit(0.0))
        at = F.least(at, F.lit(t1))
        out = F.when(y * area <= start + part, at) if out is None else out.when(y * area <= start + part, at)
    return out.otherwise(F.lit(float(knots[-1][0])))


def _targets(sizes: DataFrame, weights: Sequence[int], share: float, max_repeat: float) -> DataFrame:
    """Targets by water-filling, one row for each source: group, source_size, class, target. sizes: group, source, source_size."""
    k = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("class", (F.row_number().over(order) - 1) % k)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), F.col("class") + 1)).withColumn("cap", F.col("source_size") * float(max_repeat))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    ranked = ranked.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    fits = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(everything)
    ranked = ranked.withColumn("fit", fits)
    target = F.when(F.col("fit").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("fit") * F.col("weight")))
    return ranked.select("group", "source_size", "class", target.alias("target"))


def positions(docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, share: float = SHARE, max_repeat: int = MAX_REPEAT, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """For each row: row (a struct of the columns `carry`), size, source_size, target and positions (array of training times, one for each time that the mix takes the row)."""
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        "source",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("group"),
        F.col("doc_id").alias("id"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"),
        F.xxhash64("text").alias("text_key"),
        word_count(F.col("text")).alias("size"),
    ).withColumn("bucket", F.substring("key", 1, 3))
    buckets = sized.groupBy("group", "bucket").agg(F.max("source").alias("source"), F.sum("size").alias("bucket_size"))
    sizes = buckets.groupBy("group").agg(F.max("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    targets = _targets(sizes, weights, share, max_repeat)
    earlier = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("group", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("start")).join(targets, "group")
    within = Window.partitionBy("group", "bucket").orderBy("key", "id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.select("row", "group", "bucket", "size", F.coalesce(F.sum("size").over(within), F.lit(0)).alias("before")).join(starts, ["group", "bucket"])
    middle = F.col("start") + F.col("before") + F.col("size") / 2.0
    wanted = F.array(*[middle + F.col("source_size") * e for e in range(int(max_repeat))])
    placed = placed.withColumn("wanted", F.filter(wanted, lambda x: (x < F.col("target")) & (F.col("size") > 0)))

    def time_of(x: Column) -> Column:
        y = F.coalesce(F.try_divide(x, F.col("target")), F.lit(0.0))
        out: Column | None = None
        for i, knots in enumerate(schedules):
            out = F.when(F.col("class") == i, _invert(y, knots)) if out is None else out.when(F.col("class") == i, _invert(y, knots))
        return out

    return placed.select("row", "size", "source_size", "target", F.transform("wanted", time_of).alias("positions"))


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The documents in training order: each row as often as the mix takes it, all columns kept, sorted by position, then doc_id, by range over all partitions."""
    placed = positions(docs, carry=docs.columns, **options).select("row", F.explode("positions").alias("position"))
    return placed.orderBy("position", "row.doc_id").select("row.*")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = positions(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    placed = placed.withColumn("first", F.get("positions", F.lit(0))).orderBy(F.col("first").asc_nulls_last(), "row.doc_id")
    return placed.select("row.doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.size("positions")).alias("taken"), F.round("first", 6).alias("first_position"))


ORACLE = r"""
with sized as (
  select doc_id, source, md5(coalesce(doc_id::varchar, '')) as h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents),
sizes as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (select *, (row_number() over (order by source nulls last) - 1) % 3 as cls from sizes),
weighed as (select *, [3, 1, 2][cls + 1] as w, source_size * 2.0 as cap from ranked),
ratios as (select *, cap / w as ratio from weighed),
levels as (
  select *, (sum(source_size) over () * 1.5 - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
            / sum(w) over (order by ratio, source nulls last rows between current row and unbounded following) as lev,
         row_number() over (order by ratio, source nulls last) as rk
  from ratios),
fit as (select min_by(lev, rk) filter (lev <= ratio) as lev from levels),
targets as (select source, source_size, cls, case when fit.lev is null then cap else least(cap, fit.lev * w) end as target from levels, fit),
placed as (
  select s.doc_id, s.size, t.source_size, t.target, t.cls,
         coalesce(sum(s.size) over (partition by s.source order by s.h, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0) + s.size / 2.0 as mid
  from sized s join targets t on s.source is not distinct from t.source),
taken as (
  select *, case when size > 0 and mid < target then 1 else 0 end as a, case when size > 0 and mid + source_size < target then 1 else 0 end as b, mid / nullif(target, 0) as y from placed)
select doc_id, size, source_size, round(target, 6) as target, (size * (a + b))::bigint as taken,
       round(case when a = 0 then null
            when cls = 0 then 2 * y / (1.5 + sqrt(2.25 - 2 * y))
            when cls = 1 then y
            when y <= 0.375 then 2 * y / (0.5 + sqrt(0.25 + 2 * y))
            else 0.5 + 2 * (y - 0.375) / (1.0 + sqrt(1.0 + 2 * (y - 0.375))) end, 6) as first_position
from taken
"""
