"""Operator 5: reversible incremental line deduplication.

State is an exact reference-count table (line key -> number of distinct
documents that hold it) kept in shards by key, and for each shard a cuckoo filter
of the keys whose count has reached the limit. Inserting documents adds counts
and puts keys that cross the limit into their shard's filter; deleting documents
subtracts counts and takes keys that fall below it out again, which a cuckoo
filter (unlike a Bloom filter) allows. To drop lines, the lines of the documents
probe the filter of their shard; what passes is checked against the exact table.

Scale: shards grow in number with the keys above the limit (KEYS_PER_SHARD
each), so a filter has a bounded size; lines meet their filter by a shuffle of
(shard, salt), and stream past it; a shard has as many salts as its lines ask for
(LINES_PER_TASK, from the exact counts), so a line that every document has is spread
over many tasks and no group is ever held in memory.
Counts are pre-aggregated before each exchange; the exact check is a semi join that
can be split; text moves once, by doc_id.

Defined cases: null or empty text is one empty line; empty keys are never
dropped; very long texts and lines are taken whole; a null doc_id is one document;
repeated rows count a document once and each get a row, whatever their order;
an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import mix64, small_batches, text_array, WHITESPACE, written

MIN_DOCS = 10
KEYS_PER_SHARD = 50_000
LINES_PER_TASK = 500_000


class CuckooFilter:
    """Cuckoo filter of 16-bit fingerprints, four to a bucket, for pairs of 64-bit hashes; supports insertion and deletion."""

    SLOTS = 4
    KICKS = 500

    def __init__(self, capacity: int):
        buckets = 1
        while buckets * self.SLOTS * 0.85 < max(1, capacity):
            buckets *= 2
        self.table = np.zeros((buckets, self.SLOTS), dtype=np.uint16)
        self.n = 0

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls(0)
        out.table = np.frombuffer(data, dtype=np.uint16).reshape(-1, cls.SLOTS).copy()
        out.n = int(np.count_nonzero(out.table))
        return out

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        finger = (k2.astype(np.uint64) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = mix64(k1.astype(np.uint64)) & mask
        return finger, first.astype(np.int64), ((first ^ mix64(finger.astype(np.uint64))) & mask).astype(np.int64)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        finger, a, b = self._places(k1, k2)
        return ((self.table[a] == finger[:, None]) | (self.table[b] == finger[:, None])).any(axis=1)

    def insert(self, k1: int, k2: int) -> None:
        finger, a, b = (int(x[0]) for x in self._places(np.array([k1], np.uint64), np.array([k2], np.uint64)))
        if self._put(finger, a) or self._put(finger, b):
            self.n += 1
            return
        mask, at = len(self.table) - 1, a
        for kick in range(self.KICKS):
            slot = kick % self.SLOTS
            finger, self.table[at, slot] = int(self.table[at, slot]), finger
            at = (at ^ int(mix64(np.array([finger], np.uint64))[0])) & mask
            if self._put(finger, at):
                self.n += 1
                return
        raise OverflowError("the cuckoo filter is full: build it with a larger capacity")

    def _put(self, finger: int, at: int) -> bool:
        free = np.flatnonzero(self.table[at] == 0)
        if len(free):
            self.table[at, free[0]] = finger
        return bool(len(free))

    def delete(self, k1: int, k2: int) -> bool:
        finger, a, b = (int(x[0]) for x in self._places(np.array([k1], np.uint64), np.array([k2], np.uint64)))
        for at in (a, b):
            have = np.flatnonzero(self.table[at] == finger)
            if len(have):
                self.table[at, have[0]] = 0
                self.n -= 1
                return True
        return False


def line_keys(text: bytes) -> list[bytes]:
    return [x.strip(WHITESPACE).lower() for x in text.split(b"\n")]


def _hash(key: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(key)
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def _emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, off = text_array(b.column(1))
        data, rows, keys = raw.tobytes(), [], []
        for i in range(b.num_rows):
            found = {_hash(k) for k in line_keys(data[off[i] : off[i + 1]]) if k}
            rows.append(np.full(len(found), i))
            keys += found
        at = np.concatenate(rows) if rows else np.zeros(0, int)
        k = np.array(keys, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(k[:, 0]), pa.array(k[:, 1])], names=["doc_id", "k1", "k2"])


def document_lines(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2: the distinct line keys of each row."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_emit, "doc_id bigint, k1 bigint, k2 bigint")


def count_references(docs: DataFrame) -> DataFrame:
    """The reference-count table of these documents: k1, k2, refs."""
    counts = document_lines(docs).groupBy("k1", "k2").agg(F.count_distinct("doc_id").alias("n"), F.max(F.col("doc_id").isNull().cast("int")).alias("z"))
    return counts.select("k1", "k2", (F.col("n") + F.col("z")).cast("bigint").alias("refs"))


def insert(table: DataFrame, docs: DataFrame) -> DataFrame:
    """The table after inserting documents that are not in it yet."""
    return table.unionByName(count_references(docs)).groupBy("k1", "k2").agg(F.sum("refs").alias("refs"))


def delete(table: DataFrame, docs: DataFrame) -> DataFrame:
    """The table after deleting documents that are in it."""
    less = count_references(docs).withColumn("refs", -F.col("refs"))
    return table.unionByName(less).groupBy("k1", "k2").agg(F.sum("refs").alias("refs")).where("refs > 0")


def _shard(n: int):
    return F.pmod(F.xxhash64("k1"), F.lit(n)).cast("int").alias("shard")


def build_filters(table: DataFrame, shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """shard, filter: a cuckoo filter of each shard's keys at or above the limit."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = list(zip(pdf["k1"].to_numpy().view(np.uint64).tolist(), pdf["k2"].to_numpy().view(np.uint64).tolist()))
        capacity = len(keys)
        while True:
            out = CuckooFilter(capacity)
            try:
                for a, b in keys:
                    out.insert(a, b)
                break
            except OverflowError:  # too many keys in two buckets: a larger table parts them
                capacity *= 2
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "filter": [out.to_bytes()]})

    return table.where(F.col("refs") >= min_docs).select(_shard(shards), "k1", "k2").groupBy("shard").applyInPandas(build, "shard int, filter binary")


def update_filters(filters: DataFrame, before: DataFrame, after: DataFrame, shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """The filters after an insertion or deletion: only the keys that crossed the limit are put in or taken out.

    A shard that overflows is built anew, larger, from the exact table.
    """
    up = after.where(F.col("refs") >= min_docs).select("k1", "k2")
    down = before.where(F.col("refs") >= min_docs).select("k1", "k2")
    moves = up.join(down, ["k1", "k2"], "left_anti").withColumn("step", F.lit(1)).unionByName(down.join(up, ["k1", "k2"], "left_anti").withColumn("step", F.lit(-1)))

    def apply(old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        shard = int((old if len(old) else change)["shard"].iloc[0])
        out = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter(4 * len(change))
        change = change.sort_values("step")
        try:
            for a, b, s in zip(change["k1"].to_numpy().view(np.uint64), change["k2"].to_numpy().view(np.uint64), change["step"]):
                out.insert(int(a), int(b)) if s > 0 else out.delete(int(a), int(b))
        except OverflowError:
            return pd.DataFrame({"shard": [shard], "filter": [None]})
        return pd.DataFrame({"shard": [shard], "filter": [out.to_bytes()]})

    moved = filters.groupBy("shard").cogroup(moves.select(_shard(shards), "k1", "k2", "step").groupBy("shard")).applyInPandas(apply, "shard int, filter binary")
    moved = written(moved, "line-filters")
    full = after.join(moved.where("filter is null").select("shard"), _shard(shards) == F.col("shard"), "left_semi")
    return moved.where("filter is not null").unionByName(build_filters(full, shards, min_docs))


def salts_of(table: DataFrame, shards: int, lines_per_task: int = LINES_PER_TASK) -> DataFrame:
    """of, salts: the number of tasks that the lines of each shard ask for."""
    sizes = table.groupBy(_shard(shards)).agg(F.sum("refs").alias("lines"))
    return sizes.select(F.col("shard").alias("of"), F.ceil(F.col("lines") / lines_per_task).cast("int").alias("salts"))


def probe(lines: DataFrame, filters: DataFrame, salts: DataFrame, shards: int) -> DataFrame:
    """The lines (doc_id, k1, k2) that their shard's filter may hold. salts: of salts_of()."""
    same = F.col("shard") == F.col("of")
    salt = F.pmod(F.xxhash64("doc_id", "k2"), "salts").cast("int").alias("salt")
    own = filters.join(salts, same)
    keyed = lines.select(_shard(shards), "doc_id", "k1", "k2").join(own.select("of", "salts"), same).select("shard", salt, F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("filter"), "doc_id", "k1", "k2")
    null = F.lit(None).cast("bigint")
    spread = own.select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "filter", null.alias("doc_id"), null.alias("k1"), null.alias("k2"))

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = None, None
        for b in batches:
            shard, kind = b.column("shard").to_numpy(), b.column("kind").to_numpy()
            hit = np.zeros(b.num_rows, dtype=bool)
            k1, k2 = (b.column(c).fill_null(0).to_numpy().view(np.uint64) for c in ("k1", "k2"))
            edges = np.flatnonzero(np.diff(shard, prepend=shard[:1] - 1) | (kind == 0)) if b.num_rows else []
            for i, j in zip(edges, [*edges[1:], b.num_rows]):
                if kind[i] == 0:
                    own, at = CuckooFilter.from_bytes(b.column("filter")[int(i)].as_py()), shard[i]
                    i += 1
                if own is not None and at == shard[i - 1 if i == j else i] and i < j:
                    hit[i:j] = own.contains(k1[i:j], k2[i:j])
            keep = pa.array(np.flatnonzero(hit))
            yield pa.RecordBatch.from_arrays([b.column(c).take(keep) for c in ("doc_id", "k1", "k2")], names=["doc_id", "k1", "k2"])

    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.unionByName(keyed).repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(stream, "doc_id bigint, k1 bigint, k2 bigint")


def _rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, off = text_array(b.column("text"))
        data, drops = raw.tobytes(), b.column("drops")
        n_lines, n_dropped, digest, kept = [], [], [], []
        for i in range(b.num_rows):
            text, lines = data[off[i] : off[i + 1]], None
            n, gone = text.count(b"\n") + 1, 0
            if drops[i].is_valid:
                hot = {(x["k1"], x["k2"]) for x in drops[i].as_py()}
                lines = [x for x, k in zip(text.split(b"\n"), line_keys(text)) if not k or _hash(k) not in hot]
                gone, text = n - len(lines), b"\n".join(lines)
            n_lines.append(n)
            n_dropped.append(gone)
            digest.append(hashlib.sha256(text).hexdigest())
            kept.append(text)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"])


def drop_lines(docs: DataFrame, table: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """A row for each row of docs: doc_id, n_lines, n_dropped, kept_sha256, kept_text."""
    small_batches(docs.sparkSession)
    table = written(table, "line-refs")
    hot = table.where(F.col("refs") >= min_docs)
    shards = max(16, -(-hot.count() // KEYS_PER_SHARD))
    filters = written(build_filters(table, shards, min_docs), "line-filters")
    maybe = probe(document_lines(docs), filters, salts_of(table, shards), shards)
    sure = maybe.join(hot, ["k1", "k2"], "left_semi")
    drops = sure.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("drops"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = rows.alias("l").join(drops.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")), "left").select("l.doc_id", "l.text", "r.drops")
    return joined.mapInArrow(_rewrite, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string, kept_text string")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_lines(docs, count_references(docs)).drop("kept_text")


ORACLE = r"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from docs),
keyed as (
  select doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
hot as (select k from keyed where k <> '' group by k having count(distinct doc_id) >= 10),
marked as (select keyed.*, hot.k is not null as gone from keyed left join hot on keyed.k = hot.k)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
