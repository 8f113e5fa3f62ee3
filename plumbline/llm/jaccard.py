"""Operator 10: n-gram Jaccard join by parity sketches.

A document's set is its distinct word 4-grams as 64-bit hashes. Two sets link
when 100 * |intersection| >= 85 * |union| (both by default), which bounds their symmetric difference
by t (from their sizes). Sets are put into size bands (powers of two; a set near a
band's upper edge also takes part in the next band). In a band the hash range is
cut into parts, and every part of a set has a parity sketch: the XOR of one-hot
vectors of its hashes, so that the Hamming distance of two sketches never
exceeds the symmetric difference. Each differing hash spoils one part at most, so
of any t + 1 parts one is equal in both sets; a set therefore publishes its
first t + 1 parts in an order that depends on their content alone, and
the smallest common part is among them for both (a set with fewer parts also
publishes its first t + 1 hashes). Parts of a passage that many documents share come
last in that order (hot keys, told by a bit filter that is the same for
all), so such a passage makes few candidates.

Sets that share a published key are candidates. Each is first verified against the
hub (smallest set) of each of its keys, a number of pairs linear in the keys; a
hub's rows are dealt out STAR_ROWS at a time. Copies are joined by that. What is left
are keys whose other sets still stand apart: these sets form clusters, the
cluster's largest joined group and the rest are cut into blocks, and each pair of
blocks with a part of the rest is one unit of work: Hamming distances of
sketches discard pairs, what is left is verified exactly unless it is
connected already. Only links that join something are emitted, so thousands of
copies give thousands of rows, not millions.

Equal sets are one node from the start; where an eighth or more of the sets are
described by several tasks, a table with each of them once replaces the
descriptions. Keys and hubs are counted and joined a slice at a time, so that
shuffles hold a slice of them. Memory: one pair of blocks, one hub, or
one document. The only broadcasts are bit filters of fixed size, two at once at most.

Defined cases: null or empty text has n_shingles 0 and links with nothing; fewer
words than a shingle has are one shingle; very long texts are one set like any other;
null doc_ids count as documents but are never a component_id unless all of the
component's are null; the smallest doc_id names a component whatever ties there
are; repeated rows share a set and each get a row; an empty table gives no rows;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import BitFilter, components, forget, fresh, groups, in_slices, mix64, pieces, prefix_hash, slices_of, small_batches, span_hash, stored, words, written

WORDS, PERCENT = 4, 85
#: Hashes in a block, and rows of a hub that go to one task.
BLOCK_HASHES, STAR_ROWS = 1 << 14, 64
#: A key of this many sets is hot; where more than HOT_KEYS keys are, the limit doubles. This decides the order of keys alone, never a result.
HOT_SETS, HOT_KEYS = 64, 1 << 23
FILTER_BITS = 27


def difference_bound(a, b, percent: int = PERCENT):
    """Largest symmetric difference of sets of sizes a and b that link (exact in integers)."""
    both = a + b
    return both - 2 * (-(-(percent * both) // (100 + percent)))


def reach(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """(largest size that may link with size n, largest symmetric difference with any such size)."""
    top = 100 * n // percent
    return top, max(int(difference_bound(n, top, percent)), int(difference_bound(n, top - 1, percent)) if top > n else 0)


def shingle_sets(column: pa.Array, size: int = WORDS) -> Iterator[np.ndarray]:
    """For each text, its sorted distinct shingle hashes."""
    for first, end, data, off in pieces(column):
        starts, ends, before = words(data, off)
        h = span_hash(prefix_hash(data, lower=True), starts, ends)
        if len(h) >= size:
            g = mix64(h[: len(h) - size + 1])
            for k in range(1, size):
                g = mix64(g + h[k : len(h) - size + 1 + k])
        else:
            g = h[:0]
        for i in range(end - first):
            a, b = before[i], before[i + 1]
            if b - a >= size:
                yield np.unique(g[a : b - size + 1])
            elif b > a:
                short = np.array([b - a], dtype=np.uint64)
                for x in h[a:b]:
                    short = mix64(mix64(short) + x)
                yield short
            else:
                yield h[:0]


def set_id(u: np.ndarray) -> int:
    """64-bit identity of a set, as a signed integer."""
    return int(mix64(np.array([mix64(u).sum(dtype=np.uint64) + np.uint64(len(u))], dtype=np.uint64)).view(np.int64)[0])


def part_keys(u: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, int]]:
    """For each of the set's one or two bands: its parts' keys, the largest parts first and then by content, and how many of them it publishes."""
    n = len(u)
    if n == 0:
        return
    top, t = reach(n, percent)
    for band in sorted({n.bit_length() - 1, top.bit_length() - 1}):
        parts = np.uint64(-(-((2 << band) - 1) * (100 - percent) * 17 // (15 * percent)) + 1)  # somewhat more than t; a fifth of the hashes at 85 percent
        part = ((u >> np.uint64(32)) * parts) >> np.uint64(32)
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        parity = np.bitwise_xor.reduceat(mix64(u ^ np.uint64(0xA5A5A5A5)), at)
        key = mix64(parity + mix64(part[at] + np.uint64((band + 1) << 40)))
        count = np.minimum(np.diff(at, append=n), 63).astype(np.uint64)
        key = key[np.argsort(((np.uint64(63) - count) << np.uint64(58)) | (key >> np.uint64(6)), kind="stable")]
        if len(at) < t + 1:
            yield np.concatenate((key, mix64(u[: t + 1] ^ np.uint64(0x5EED0000 + band)))), len(at) + t + 1
        else:
            yield key, t + 1


def published(u: np.ndarray, percent: int = PERCENT, hot: np.ndarray | None = None) -> np.ndarray:
    """Keys that a set publishes: in each band the first of its parts, those among `hot` last."""
    out = [k[np.argsort(np.isin(k, hot), kind="stable")][:n] if hot is not None else k[:n] for k, n in part_keys(u, percent)]
    return np.concatenate(out) if out else u


def _describe(batches: Iterable[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """doc_id, n, sid, and of a set that the task has not seen: its keys band by band, and for each band its numbers of keys and of published ones; the task."""
    seen: set[int] = set()
    task = TaskContext.get().partitionId()
    for b in batches:
        n, sids, keys, bands, held, first = [], [], [], [], 0, 0
        for i, u in enumerate(shingle_sets(b.column(1), size)):
            sid = set_id(u) if len(u) else None
            n.append(len(u))
            sids.append(sid)
            new = sid is not None and sid not in seen
            if new and len(seen) < 1 << 20:
                seen.add(sid)
            own = list(part_keys(u, percent)) if new else []
            keys.append(np.concatenate([k for k, _ in own]) if own else u[:0])
            bands.append([x for k, t in own for x in (len(k), t)])
            held += len(keys[-1])
            if held > 1 << 18 or i + 1 == b.num_rows:
                flat = pa.array(np.concatenate(keys).view(np.int64))
                at = pa.array(np.cumsum([0] + [len(k) for k in keys]), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(n)), pa.array(n, pa.int64()), pa.array(sids, pa.int64()), pa.ListArray.from_arrays(at, flat), pa.array(bands, pa.list_(pa.int32())), pa.array([task] * len(n), pa.int32())], names=["doc_id", "n", "sid", "keys", "bands", "task"])
                n, sids, keys, bands, held, first = [], [], [], [], 0, i + 1


def described_once(described: DataFrame, path: str) -> tuple[DataFrame, str]:
    """(sid, keys, bands) of each set, and the path that holds it: where an eighth or more are described again by other tasks, a table of its own, which leaves out all but the first task's but for a few that the bit filter lets pass."""
    spark = described.sparkSession
    rows = described.where("sid is not null and size(bands) > 0")
    first = rows.groupBy("sid").agg(F.min("task").alias("task"), F.count("*").alias("rows"))
    count = first.agg(F.count("*").alias("sets"), F.sum("rows").alias("rows")).first()
    if not count["sets"] or 8 * (count["rows"] - count["sets"]) < count["sets"]:
        return rows.select("sid", "keys", "bands"), path
    keep = BitFilter.build(first.select(F.xxhash64("sid", "task").alias("own")), "own", FILTER_BITS)

    def once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep.contains(b.column("own").to_numpy().view(np.uint64)))).select(["sid", "keys", "bands"])

    out = stored(rows.select("sid", "keys", "bands", F.xxhash64("sid", "task").alias("own")).mapInArrow(once, "sid bigint, keys array<bigint>, bands array<int>"), "once")
    forget(spark, path)
    return out


def _publish(batches: Iterable[pa.RecordBatch], shared: BitFilter, hot: BitFilter) -> Iterator[pa.RecordBatch]:
    """(key, sid): of the first keys of each band, with hot ones last, those that another set may hold."""
    for b in batches:
        flat = b.column("keys").flatten().to_numpy().view(np.uint64)
        if not len(flat):
            continue
        sizes = b.column("bands").flatten().to_numpy().reshape(-1, 2)
        row = np.repeat(np.arange(b.num_rows), b.column("bands").value_lengths().fill_null(0).to_numpy() // 2)
        band = np.repeat(np.arange(len(sizes)), sizes[:, 0])
        order = np.lexsort((hot.contains(flat), band))  # stable: content order stays within a band
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes[:, 0]) - sizes[:, 0], sizes[:, 0])
        take = order[place < sizes[band, 1]]
        take = take[shared.contains(flat[take])]
        sid = b.column("sid").to_numpy(zero_copy_only=False)[row[band[take]]]
        yield pa.RecordBatch.from_arrays([pa.array(flat[take].view(np.int64)), pa.array(sid.astype(np.int64))], names=["key", "sid"])


def links(sids: np.ndarray, sets: list[np.ndarray], roots: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Verified links between sets of different roots, as far as they join something."""
    n = len(sets)
    size = np.array([len(u) for u in sets])
    order = np.argsort(size, kind="stable")
    size, group = size[order], np.unique(roots, return_inverse=True)[1][order]
    out: list[tuple[int, int]] = []
    at = 0
    while at < n:  # sets of about one size, and those that they may link with, have sketches of one width
        stop = int(np.searchsorted(size, 2 * size[at]))
        last = int(np.searchsorted(size, 100 * size[stop - 1] // percent, side="right"))
        bits = min(-(-int(size[last - 1]) * 13 // 64) * 64, 1 << 16) if last - at > 8 else 0
        sketch = np.zeros((last - at if bits else 0, bits // 64), dtype=np.uint64)
        for k in range(len(sketch)):
            odd = np.bincount((mix64(sets[order[at + k]]) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
            sketch[k] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
        for k in range(at, stop):
            near = np.arange(k + 1, np.searchsorted(size, 100 * size[k] // percent, side="right"))
            near = near[group[near] != group[k]]
            if bits and len(near):
                far = np.bitwise_count(sketch[near - at] ^ sketch[k - at]).sum(axis=1, dtype=np.int64)
                near = near[far <= difference_bound(size[k], size[near], percent)]
            for m in near:
                if group[m] == group[k]:
                    continue
                i, j = order[k], order[m]
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (size[k] + size[m] - common):
                    group[group == group[m]] = group[k]
                    out.append((int(sids[i]), int(sids[j])))
        at = stop
    return out


def _verify(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of each pair of blocks."""
    found: list[tuple[int, int]] = []
    for group in groups(batches, ["cluster", "bi", "bj"]):
        sids, at = np.unique(group.column("sid").to_numpy(), return_index=True)
        roots = group.column("root").to_numpy()[at]
        if len(sids) > 1 and (roots != roots[0]).any():
            sets = [np.frombuffer(group.column("hashes")[int(i)].as_py(), dtype=np.uint64) for i in at]
            found += links(sids, sets, roots, percent)
        if len(found) > 50_000:
            yield _pairs(found)
            found = []
    yield _pairs(found)


def _stars(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between a hub, which comes first of its rows, and the others, which stream past it."""
    hub, own, salt = None, None, None
    for b in batches:
        ids, salts, kinds, sids, blobs = (b.column(c) for c in ("hub", "salt", "kind", "sid", "hashes"))
        found = []
        for i, (h, s, kind, sid) in enumerate(zip(ids.to_numpy(), salts.to_numpy(), kinds.to_numpy(), sids.to_numpy())):
            u = np.frombuffer(blobs[i].as_buffer(), dtype=np.uint64)
            if kind == 0:
                hub, salt, own = h, s, u
            elif h == hub and s == salt and sid != hub:
                most = min(len(u), len(own))
                if 100 * most >= percent * max(len(u), len(own)):
                    common = len(np.intersect1d(u, own, assume_unique=True))
                    if 100 * common >= percent * (len(u) + len(own) - common):
                        found.append((int(h), int(sid)))
        yield _pairs(found)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])


def shared_keys(sets: DataFrame, slices: int = 1) -> DataFrame:
    """(key, sid): published keys that another set may hold. sets: sid, keys, bands."""
    count = lambda keys: keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")  # noqa: E731  a set described by two tasks counts twice: that spares less, and loses nothing
    ends, paths = in_slices(sets.select(F.explode("keys").alias("key")), "key", slices, count, "shared-keys")
    shared = BitFilter.build(ends, "key", FILTER_BITS)
    limit, above = HOT_SETS, ends.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).count().collect()  # a row for each power of two
    while sum(r["count"] for r in above if 2 ** r["size"] >= limit) > HOT_KEYS:
        limit *= 2
    hot = BitFilter.build(ends.where(F.floor(F.log2("n")) >= int(np.log2(limit))), "key", FILTER_BITS)
    for path in paths:
        forget(sets.sparkSession, path)
    return sets.mapInArrow(partial(_publish, shared=shared, hot=hot), "key bigint, sid bigint")


def similar_groups(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs: sets of `size` words link from `percent` (50 at least) of their union on."""
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described, described_at = stored(rows.mapInArrow(partial(_describe, size=size, percent=percent), "doc_id bigint, n bigint, sid bigint, keys array<bigint>, bands array<int>, task int"), "described")
    info = written(described.select("doc_id", "n", "sid"), "sets")
    lowest = -(1 << 63)
    reps = info.where("sid is not null").groupBy("sid").agg(F.min(F.coalesce("doc_id", F.lit(lowest))).alias("rep"), F.min("doc_id").alias("low_id"), F.max("n").alias("n"))

    once, once_at = described_once(described, described_at)
    keyed, keyed_at = stored(shared_keys(once, slices_of(spark, once_at)), "keys")
    forget(spark, once_at, shuffles=True)

    def hubs(keyed: DataFrame) -> DataFrame:
        ends = keyed.groupBy("key").agg(F.min("sid").alias("hub"), F.max("sid").alias("high")).where("hub <> high").select(F.col("key").alias("of"), "hub")
        return keyed.join(ends, F.col("key") == F.col("of")).select("key", "sid", "hub")

    stars, stars_at = in_slices(keyed, "key", slices_of(spark, keyed_at), hubs, "stars")
    forget(spark, keyed_at)

    members = stars.select(F.col("sid").alias("member")).distinct().join(reps, F.col("member") == F.col("sid")).select("sid", "rep", "n")
    wanted = BitFilter.build(members, "rep", FILTER_BITS)

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).fill_null(lowest)
            keep = np.flatnonzero(wanted.contains(ids.to_numpy().view(np.uint64)))
            part = b.take(pa.array(keep))
            ids, held, total, first = ids.take(pa.array(keep)), [], 0, 0
            for i, u in enumerate(shingle_sets(part.column(1), size)):
                held.append(u)
                total += len(u)
                if total > 1 << 18 or i + 1 == part.num_rows:
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(held)), pa.array([set_id(x) if len(x) else None for x in held], pa.int64()), pa.array([x.tobytes() for x in held], pa.binary())], names=["id", "own", "hashes"])
                    first, held, total = i + 1, [], 0

    sets = rows.mapInArrow(fetch, "id bigint, own bigint, hashes binary")
    sets = sets.join(members, (F.col("id") == F.col("rep")) & (F.col("own") == F.col("sid"))).select(F.col("sid").alias("set"), "hashes", "n")
    sets, sets_at = stored(sets, "hashes")

    # every set against the hub of each of its keys
    def against_hubs(stars: DataFrame) -> DataFrame:
        spokes = stars.select("sid", "hub").distinct()
        fans = spokes.groupBy("hub").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("fans"))
        first = fans.join(sets, F.col("hub") == F.col("set")).select("hub", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("hub").alias("sid"), "hashes")
        rest = spokes.join(fans.withColumnRenamed("hub", "of"), F.col("hub") == F.col("of")).join(sets, F.col("sid") == F.col("set")).select("hub", F.pmod(F.xxhash64("sid"), "fans").cast("int").alias("salt"), F.lit(1).alias("kind"), "sid", "hashes")
        met = first.unionByName(rest).repartition(n, "hub", "salt").sortWithinPartitions("hub", "salt", "kind")
        return met.mapInArrow(partial(_stars, percent=percent), "a bigint, b bigint")

    found, found_at = in_slices(stars.where("sid <> hub"), "hub", slices_of(spark, sets_at), against_hubs, "found")
    joined = written(components(found), "joined")

    # keys whose sets, without the hub, still stand apart: their sets in clusters, and blocks of a cluster against each other
    rooted = stars.where("sid <> hub").join(joined, F.col("sid") == F.col("node"), "left").select("key", "sid", F.coalesce("component", "sid").alias("root"))
    apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(F.col("key").alias("of"), "low")
    open_, open_at = stored(rooted.join(apart, F.col("key") == F.col("of")).select("sid", "root", "low").distinct(), "apart")
    near = components(open_.select(F.col("root").alias("a"), F.col("low").alias("b")))
    placed = open_.select("sid", "root").distinct().join(near, F.col("root") == F.col("node")).join(sets, F.col("sid") == F.col("set")).select("sid", "root", F.col("component").alias("cluster"), "n", "hashes")
    by_root = placed.groupBy("cluster", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("total"))
    sizes = by_root.groupBy("cluster").agg(F.max(F.struct("rows", "root", "total")).alias("main"), F.sum("total").alias("total"))
    blocks = lambda x: F.ceil(x / BLOCK_HASHES).cast("int")
    sizes = sizes.select(F.col("cluster").alias("in"), F.col("main.root").alias("main"), blocks(F.col("main.total")).alias("m"), blocks(F.col("total") - F.col("main.total")).alias("r"))
    dealt = placed.drop("n").join(sizes, F.col("cluster") == F.col("in")).withColumn("block", F.when(F.col("root") == F.col("main"), F.col("r") + F.pmod(F.xxhash64("sid"), "m")).otherwise(F.pmod(F.xxhash64("sid"), "r")).cast("int"))
    others = F.when(F.col("root") == F.col("main"), F.sequence(F.lit(0), F.col("r") - 1)).otherwise(F.sequence(F.lit(0), F.col("r") + F.col("m") - 1))
    dealt = dealt.withColumn("other", F.explode(others)).select("cluster", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "sid", "root", "hashes")
    late = dealt.repartition(n, "cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj").mapInArrow(partial(_verify, percent=percent), "a bigint, b bigint")
    late = written(late, "late")
    if not late.isEmpty():
        old = joined.select(F.col("node").alias("x"), F.col("component").alias("y"))
        a = late.join(old, F.col("a") == F.col("x"), "left").select(F.coalesce("y", "a").alias("a"), "b")
        over = written(components(a.join(old, F.col("b") == F.col("x"), "left").select("a", F.coalesce("y", "b").alias("b"))), "joined")
        moved = over.select(F.col("node").alias("x"), F.col("component").alias("y"))
        kept = joined.join(moved, F.col("component") == F.col("x"), "left").select("node", F.coalesce("y", "component").alias("component"))
        joined = kept.unionByName(moved.join(joined, F.col("x") == F.col("node"), "left_anti").select(F.col("x").alias("node"), F.col("y").alias("component")))
    for at in (*stars_at, *found_at, open_at, sets_at):
        forget(spark, at)

    # a large family is a hot key: its least doc_id is a table of its own, so that the join with it can be split
    family = reps.join(joined, F.col("sid") == F.col("node")).select(F.col("sid").alias("of"), "low_id", "component")
    lows = written(family.groupBy("component").agg(F.min("low_id").alias("component_id")), "lows")
    alone = reps.join(joined, F.col("sid") == F.col("node"), "left_anti").select(F.col("sid").alias("of"), F.col("low_id").alias("component_id"))
    names = family.join(lows, "component").select("of", "component_id").unionByName(alone)
    linked = info.where("sid is not null").join(names, F.col("sid") == F.col("of")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(info.where("sid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def first_of_each_group(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, without near copies: of each group the smallest doc_id stays.

    A doc_id that is not the smallest of its group goes with all its rows; rows
    equal in doc_id and text stay once; null doc_ids stay.
    """
    near = similar_groups(docs.select("doc_id", "text"), size, percent)
    gone = near.where(F.col("doc_id") > F.col("component_id")).select("doc_id").distinct()
    same = F.col("l.doc_id") == F.col("r.doc_id")
    kept = docs.alias("l").join(gone.alias("r"), same, "left_anti")
    again = kept.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    if again.isEmpty():
        return kept
    twice = kept.alias("l").join(again.alias("r"), same, "left_semi")
    first, rank = Window.partitionBy("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy("doc_id"), fresh(docs, "rank")
    twice = twice.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(rank)
    return kept.alias("l").join(again.alias("r"), same, "left_anti").unionByName(twice)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
