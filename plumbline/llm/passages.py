"""Operator 7: suffix-array deduplication of repeated byte strings.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else.
Each window of LENGTH bytes has one anchor: the leftmost of the least hashes of
its GRAM-byte strings. Windows that are equal have equal anchors, so windows are
dealt into shards by anchor; a segment is a maximal run of windows of one text that
share an anchor occurrence. Segments that occur twice are repeated as a whole;
segments of one anchor that differ are sorted by their suffixes, a shard at a
time (suffixes.InducedSorter: external induced sorting over files, which takes
shards far larger than its memory), and windows whose common prefix with a
neighbour reaches LENGTH are repeated. Everything else is unique and never
leaves its scan. An anchor with more than HOT_KINDS different segments (the edge
of a passage that very many documents share) would be one shard's work; its
windows are counted one by one instead, each under its own hash, in any task.

Scale: three scans of the texts (four with crowded anchors); what moves are two
hashes for each anchor (about one in 80 bytes), the distinct segments of anchors
that differ, the repeated spans, and the text once, by document, for the
rewriting. Equal segments are one row before they are sorted, so thousands of
copies cost what one does. Bit filters of fixed size spare work; exact joins
follow them.

Defined cases: null or empty text has 0 bytes; texts shorter than LENGTH keep all;
very long texts (over STRETCH_BYTES) are looked at in overlapping stretches;
repeated rows are copies of each other, and of equal strings each one goes, whatever
their order; a null doc_id is kept apart by its text; an empty table gives no rows;
extra columns are ignored, whatever their names. Bytes that are left may not be
valid UTF-8, so they are returned as binary.
"""

from __future__ import annotations

import hashlib
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import BitFilter, mix64, pieces, prefix_hash, rolling_hash, small_batches, span_hash, text_array, written
from plumbline.llm.suffixes import InducedSorter, Run

LENGTH, GRAM = 200, 40
SHARD_BYTES = 2 << 20
#: An anchor with more distinct segments than this is dealt out by single windows.
HOT_KINDS = 8192
#: Longer texts are looked at in stretches; positions within one have 26 bits.
STRETCH_BYTES = 8 << 20
FILTER_BITS = 27
SEPARATOR = 0xFF  # never a byte of UTF-8


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    n = len(x) - width + 1
    pad = -len(x) % width
    full = np.append(x, np.full(pad, np.iinfo(x.dtype).max, dtype=x.dtype)).reshape(-1, width)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def _stretches(data: np.ndarray, off: np.ndarray, length: int, gram: int, longest: int) -> tuple[np.ndarray, ...]:
    """segments() of stretches that share length - 1 bytes, so that each window is in one of them. A segment cut by a border is two of one anchor, which are sorted like any others that differ."""
    step, parts = longest - length + 1, []
    for at in range(0, len(data) - length + 1, step):
        end = min(at + longest, len(data))
        inner = off[(off > at) & (off < end)] - at
        row, a, b, anchor, own = segments(data[at:end], np.concatenate(([0], inner, [end - at])), length, gram, longest)
        parts.append((row + np.searchsorted(off, at, side="right") - 1, a + at, b + at, anchor, own))
    return tuple(np.concatenate(p) for p in zip(*parts))


def segments(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM, longest: int = STRETCH_BYTES) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor hash, segment hash) of the segments of a piece; windows by their start in the piece. longest: at most 2^26, at least `length`."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    if len(data) > longest:
        return _stretches(data, off, length, gram, longest)
    prefix = prefix_hash(data)
    h = rolling_hash(prefix, gram)
    h &= ~np.uint64((1 << 26) - 1)
    h |= np.arange(len(h), dtype=np.uint64)
    anchor = sliding_least(h, length - gram + 1)
    inside = np.ones(len(anchor), dtype=bool)
    for end in off[1:-1]:
        inside[max(0, end - length + 1) : end] = False
    change = np.empty(len(anchor), dtype=bool)
    change[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=change[1:])
    change[1:] |= inside[1:] != inside[:-1]
    edge = np.flatnonzero(change)
    keep = inside[edge]
    a, b = edge[keep], np.append(edge[1:], len(anchor))[keep] - 1
    m = (anchor[a] & np.uint64((1 << 26) - 1)).astype(np.int64)
    own = mix64(span_hash(prefix, a, b + length) + (m - a).astype(np.uint64))
    return np.searchsorted(off, a, side="right") - 1, a, b, span_hash(prefix, m, m + gram), own


def _scan(docs: DataFrame, emit, schema: str) -> DataFrame:
    """Run emit(ids, keys, row, first, last, anchor, segment, data, off) over pieces."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, end, data, off in pieces(b.column("text")):
                out = emit(b.column("doc_id").slice(start, end - start), b.column("text_key").slice(start, end - start), data, off, *segments(data, off))
                if out is not None and out.num_rows:
                    yield out

    return docs.mapInArrow(scan, schema)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class _Shard:
    """The segments of a shard, in files: their bytes with a separator after each, and their keys and sizes."""

    def __init__(self):
        self.folder = tempfile.mkdtemp(prefix="shard-")
        self.text = open(f"{self.folder}/text", "wb")
        self.keys = Run(f"{self.folder}/keys", np.dtype([("anchor", np.int64), ("segment", np.int64), ("begin", np.int64), ("size", np.int64)]))
        self.n = 0

    def add(self, part: pa.RecordBatch) -> None:
        raw, off = text_array(part.column("bytes"))
        size = np.diff(off)
        own = np.empty(len(size), dtype=self.keys.dtype)
        own["anchor"], own["segment"], own["size"] = part.column("anchor").to_numpy(), part.column("segment").to_numpy(), size
        at = np.cumsum(size + 1)
        own["begin"] = self.n + at - size - 1
        text = np.full(int(at[-1]), SEPARATOR, dtype=np.uint8)
        solid = np.ones(len(text), dtype=bool)
        solid[at - 1] = False
        text[solid] = raw[off[0] : off[-1]]
        text.tofile(self.text)
        self.keys.append(own)
        self.n += len(text)

    def repeated(self) -> Iterator[pa.RecordBatch]:
        """Runs of windows that repeat: anchor, segment, first, last (by window within the segment)."""
        self.text.close()
        twice = np.memmap(f"{self.folder}/twice", dtype=bool, mode="w+", shape=(self.n,))
        sorter, before = InducedSorter(f"{self.folder}/text", LENGTH, self.folder), None
        sorter.sort()
        for at, lcp in sorter.suffixes():
            long = lcp >= LENGTH
            if long[0] and before is not None:
                twice[before] = True
            before = at[-1]
            long[:-1] |= long[1:]
            twice[at[long]] = True
        for keys in self.keys.chunks():
            base = keys["begin"][0]
            edge = np.zeros(int(keys["begin"][-1] + keys["size"][-1] - base) + 2, dtype=np.int8)
            whole = keys[keys["size"] >= LENGTH]
            edge[whole["begin"] - base] = 1
            edge[whole["begin"] + whole["size"] - LENGTH + 1 - base] -= 1
            here = (np.cumsum(edge, dtype=np.int8)[:-1] > 0) & np.append(twice[base : base + len(edge) - 2], False)  # a window with a separator is none
            edge = np.diff(np.concatenate(([0], here.astype(np.int8), [0])))
            first, last = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) - 1
            own = keys[np.searchsorted(keys["begin"] - base, first, side="right") - 1]
            yield pa.RecordBatch.from_arrays([pa.array(own["anchor"]), pa.array(own["segment"]), pa.array(first + base - own["begin"]), pa.array(last + base - own["begin"])], names=["anchor", "segment", "first", "last"])
        sorter.close()

    def close(self) -> None:
        self.text.close()
        shutil.rmtree(self.folder, ignore_errors=True)


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_Shard.repeated of each shard of batches sorted by shard, which are written to its files as they come."""
    shard, number = None, None
    try:
        for b in batches:
            if not b.num_rows:
                continue
            numbers = b.column("shard").to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1])))
            for i, j in zip(edges.tolist(), [*edges[1:].tolist(), b.num_rows]):
                if shard is None or numbers[i] != number:
                    if shard is not None:
                        yield from shard.repeated()
                        shard.close()
                    shard, number = _Shard(), numbers[i]
                shard.add(b.slice(i, j - i))
        if shard is not None:
            yield from shard.repeated()
    finally:
        if shard is not None:
            shard.close()


def _windows(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the segment, start, hash) of each window of the segments."""
    n = b - a + 1
    index = np.repeat(np.arange(len(a)), n)
    start = a[index] + np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n)
    return index, start, span_hash(prefix_hash(data), start, start + LENGTH)


def repeated_spans(docs: DataFrame, hot_kinds: int = HOT_KINDS) -> DataFrame:
    """doc_id, text_key, first, last: runs of repeated windows of each text. docs: doc_id, text_key, text."""
    spark = docs.sparkSession
    small_batches(spark)
    keys = _scan(docs, lambda ids, tk, data, off, row, a, b, h, s: pa.RecordBatch.from_arrays([_signed(h), _signed(s)], names=["anchor", "segment"]), "anchor bigint, segment bigint")
    counts = keys.groupBy("anchor", "segment").agg(F.count("*").alias("n"))
    kinds = counts.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    of = counts.join(kinds, "anchor").select("anchor", "segment", "n", "kinds")
    of = written(of, "segments")
    crowded = of.where(F.col("kinds") > hot_kinds).select("anchor").distinct()
    any_hot = not crowded.isEmpty()
    hot = BitFilter.build(crowded, "anchor", FILTER_BITS) if any_hot else None
    mixed = of.where(F.col("kinds").between(2, hot_kinds))
    may_differ = BitFilter.build(mixed, "segment", FILTER_BITS)

    def cold(h):
        return ~hot.contains(h) if any_hot else np.ones(len(h), dtype=bool)

    def texts(ids, tk, data, off, row, a, b, h, s):
        hit = np.flatnonzero(may_differ.contains(s) & cold(h))
        _, one = np.unique(s[hit], return_index=True)
        hit = hit[one]
        raw = data.tobytes()
        return pa.RecordBatch.from_arrays([_signed(h[hit]), _signed(s[hit]), pa.array([raw[i : j + LENGTH] for i, j in zip(a[hit], b[hit])], pa.binary())], names=["anchor", "segment", "bytes"])

    found = _scan(docs, texts, "anchor bigint, segment bigint, bytes binary").join(mixed.select("anchor", "segment"), ["anchor", "segment"], "left_semi")
    distinct = written(found.groupBy("anchor", "segment").agg(F.max("bytes").alias("bytes")), "segment-texts")
    total = distinct.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sharded = distinct.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).repartition(n, "shard").sortWithinPartitions("shard")
    parts = sharded.select("shard", "anchor", "segment", "bytes").mapInArrow(_repeated, "anchor bigint, segment bigint, first bigint, last bigint")
    whole = of.where("n > 1").select("anchor", "segment")
    parts = written(parts.join(whole, ["anchor", "segment"], "left_anti"), "segment-parts")
    all_of = (F.lit(0).cast("bigint").alias("first"), F.lit(-1).cast("bigint").alias("last"))
    spans = whole.select("anchor", "segment", *all_of).unionByName(parts)
    if any_hot:

        def windows(ids, tk, data, off, row, a, b, h, s):
            hit = np.flatnonzero(hot.contains(h))
            seen, n = np.unique(_windows(data, a[hit], b[hit])[2], return_counts=True)
            return pa.RecordBatch.from_arrays([_signed(seen), pa.array(n.astype(np.int64))], names=["window", "n"])

        again = _scan(docs, windows, "window bigint, n bigint").groupBy("window").agg(F.sum("n").alias("n")).where("n > 1")
        again = written(again.select(F.col("window").alias("anchor"), F.col("window").alias("segment"), *all_of), "windows")
        spans = spans.unionByName(again)
    may_repeat = BitFilter.build(spans, "segment", FILTER_BITS)

    def places(ids, tk, data, off, row, a, b, h, s):
        if any_hot:  # windows of crowded anchors are segments of their own
            of_hot, of_cold = np.flatnonzero(~cold(h)), np.flatnonzero(cold(h))
            index, start, w = _windows(data, a[of_hot], b[of_hot])
            row = np.concatenate((row[of_cold], row[of_hot][index]))
            a, b, h, s = np.concatenate((a[of_cold], start)), np.concatenate((b[of_cold], start)), np.concatenate((h[of_cold], w)), np.concatenate((s[of_cold], w))
        hit = np.flatnonzero(may_repeat.contains(s))
        at = pa.array(row[hit])
        return pa.RecordBatch.from_arrays([ids.take(at), tk.take(at), pa.array(a[hit] - off[row[hit]]), pa.array(b[hit] - off[row[hit]]), _signed(h[hit]), _signed(s[hit])], names=["doc_id", "text_key", "a", "b", "anchor", "segment"])

    placed = _scan(docs, places, "doc_id bigint, text_key bigint, a bigint, b bigint, anchor bigint, segment bigint")
    return placed.join(spans, ["anchor", "segment"]).select("doc_id", "text_key", (F.col("a") + F.col("first")).alias("first"), F.when(F.col("last") < 0, F.col("b")).otherwise(F.col("a") + F.col("last")).alias("last"))


def _rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, off = text_array(b.column("text"))
        data, spans = raw.tobytes(), b.column("spans")
        sizes, removed, runs, digest, kept = [], [], [], [], []
        values = spans.flatten()
        first, last = (values.field(i).to_numpy() for i in (0, 1))
        edge = np.concatenate(([0], np.cumsum(spans.value_lengths().fill_null(0).to_numpy())))
        for i in range(b.num_rows):
            text, gone, n = data[off[i] : off[i + 1]], 0, 0
            size = len(text)
            if edge[i + 1] > edge[i]:
                f, z = first[edge[i] : edge[i + 1]], last[edge[i] : edge[i + 1]] + LENGTH
                order = np.argsort(f, kind="stable")
                f, z = f[order], np.maximum.accumulate(z[order])
                new = np.concatenate(([True], f[1:] > z[:-1]))
                f, z = f[new], z[np.append(np.flatnonzero(new)[1:] - 1, len(z) - 1)]
                gone, n = int((z - f).sum()), len(f)
                text = b"".join(text[x:y] for x, y in zip([0, *z], [*f, size]))
            sizes.append(size)
            removed.append(gone)
            runs.append(n)
            digest.append(hashlib.sha256(text).hexdigest())
            kept.append(text)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, hot_kinds: int = HOT_KINDS) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary)."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text"))
    spans = repeated_spans(rows, hot_kinds).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_key") == F.col("r.text_key"))
    joined = rows.alias("l").join(spans.alias("r"), same, "left").select("l.doc_id", "l.text", "r.spans")
    return joined.mapInArrow(_rewrite, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("kept")
