"""Operator 9: benchmark decontamination.

Words are lower-cased and stripped of punctuation at both ends. Every three
consecutive words of a test item are a seed. A first scan counts how many
documents hold each seed; a seed is rare if no more than RARE_FACTOR times the upper
quartile of its own item's seeds have it, so that at least three quarters of
an item's seeds are kept whatever the size of the corpus (an item that a third of
the corpus quotes keeps its seeds too). A second scan cuts the passage around
rare seeds out of each document, as far as the length of the items asks for;
passages meet items by an equi-join on the seed, and Smith-Waterman alignment over
words scores each pair of passage and item. The score is the alignment's share
of the best possible, so edited and paraphrased copies keep most of it.

Scale: texts never shuffle; the scans use bit filters of fixed size (one for each
power of two of item lengths) that only spare work, exact joins follow; only counts
of seeds and passages with rare seeds move. Alignment runs over batches of pairs of
bounded size.

Defined cases: null and empty texts hold nothing; an item with fewer than three
words has no seeds and matches nothing; very long texts are searched whole;
repeated documents or items give one row for each pair of ids, the best score and,
of equal ones, the last end; null ids are ids; empty tables give no rows; extra
columns are ignored by leaks() and kept by clean(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import BitFilter, mix64, pieces, prefix_hash, small_batches, span_hash, words, written

SEED_WORDS = 3
RARE_FACTOR = 4.0
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE, MIN_MATCHED = 0.4, 6
#: Items are dealt into classes by length, powers of two from this one on; a passage reaches twice a class's length beyond its seeds.
LEAST_CLASS = 6
FILTER_BITS = 24
BATCH_CELLS = 1 << 20

_EDGE = np.zeros(256, dtype=bool)
_EDGE[list(b".,;:!?\"'()[]{}<>*#%&$|-_/\\~`^+=@")] = True


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, number of words before each text) without punctuation at the ends; a word of punctuation alone stays as it is."""
    starts, ends, before = words(data, off)
    accent = np.flatnonzero(data[:-1] == 0xC3) + 1
    accent = accent[(data[accent] >= 0x80) & (data[accent] <= 0x9E) & (data[accent] != 0x97)]
    if len(accent):
        data = data.copy()
        data[accent] += 0x20  # capital letters of Latin-1 in UTF-8
    s, e = starts.copy(), ends.copy()
    for side in (s, e):  # few words have much punctuation: a byte at a time, then what is left word by word
        at, step = (0, 1) if side is s else (-1, -1)
        live = np.flatnonzero(_EDGE[data[side + at]])
        for _ in range(8):
            side[live] += step
            live = live[e[live] > s[live]]
            live = live[_EDGE[data[side[live] + at]]]
        for i in live:
            solid = np.flatnonzero(~_EDGE[data[s[i] : e[i]]])
            s[i], e[i] = (s[i] + solid[0], s[i] + solid[-1] + 1) if len(solid) else (e[i], e[i])
    bare = e <= s
    s[bare], e[bare] = starts[bare], ends[bare]
    return span_hash(prefix_hash(data, lower=True), s, e), before


def seeds(h: np.ndarray) -> np.ndarray:
    """Hash of the SEED_WORDS words that start at each word; shorter by SEED_WORDS - 1."""
    n = len(h) - SEED_WORDS + 1
    if n <= 0:
        return h[:0]
    g = mix64(h[:n])
    for k in range(1, SEED_WORDS):
        g = mix64(g + h[k : n + k])
    return g


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of pairs, and the passage word at which each best alignment ends. Pairs run side by side in arrays."""
    n = len(passages)
    score, end = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    order = sorted(range(n), key=lambda i: (len(passages[i]), len(items[i])))
    at = 0
    while at < n:
        size, width = 1, len(items[order[at]])
        while at + size < n and (size + 1) * max(width, len(items[order[at + size]])) <= 1 << 15 and size * len(passages[order[at + size]]) <= BATCH_CELLS:
            width = max(width, len(items[order[at + size]]))
            size += 1
        rows = order[at : at + size]
        at += size
        height = max(len(passages[i]) for i in rows)
        item, known = np.zeros((size, width), dtype=np.uint64), np.zeros((size, width), dtype=bool)
        text, real = np.zeros((size, height), dtype=np.uint64), np.zeros((size, height), dtype=bool)
        for k, i in enumerate(rows):
            item[k, : len(items[i])], known[k, : len(items[i])] = items[i], True
            text[k, : len(passages[i])], real[k, : len(passages[i])] = passages[i], True
        ramp = np.arange(width, dtype=np.int32) * -GAP
        last, best, where = np.zeros((size, width + 1), dtype=np.int32), np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int64)
        for j in range(height):
            same = (item == text[:, j : j + 1]) & known & real[:, j : j + 1]
            cell = np.maximum(last[:, :-1] + np.where(same, MATCH, MISMATCH), last[:, 1:] + GAP)
            np.maximum(cell, 0, out=cell)
            cell = (np.maximum.accumulate(cell + ramp, axis=1) - ramp).astype(np.int32)
            last[:, 1:] = cell
            top = np.where(known, cell, 0).max(axis=1)
            better = (top > best) & real[:, j]
            best[better], where[better] = top[better], j
        score[rows], end[rows] = best, where
    return score, end


def _item_words(benchmark: DataFrame) -> DataFrame:
    """item_id, words (binary of uint64), n, seeds of each item."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs, n, s = [], [], []
            for first, end, data, off in pieces(b.column(1)):
                h, before = tokens(data, off)
                for i in range(end - first):
                    own = h[before[i] : before[i + 1]]
                    blobs.append(own.tobytes())
                    n.append(len(own))
                    s.append(np.unique(seeds(own)).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blobs, pa.binary()), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.int64()))], names=["item_id", "item", "n", "seeds"])

    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(emit, "item_id bigint, item binary, n bigint, seeds array<bigint>").where(F.col("n") >= SEED_WORDS)


def seed_documents(docs: DataFrame, wanted: BitFilter) -> DataFrame:
    """seed, docs: number of rows that hold each seed that the filter passes."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for first, end, data, off in pieces(b.column(0)):
                h, before = tokens(data, off)
                g = seeds(h)
                hit = np.flatnonzero(wanted.contains(g))
                row = np.searchsorted(before, hit, side="right") - 1
                inside = hit + SEED_WORDS <= before[row + 1]
                row, own = row[inside], g[hit[inside]]
                order = np.lexsort((own, row))
                row, own = row[order], own[order]
                new = np.ones(len(own), dtype=bool)
                new[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
                out.append(own[new])
            found, count = np.unique(np.concatenate(out) if out else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count.astype(np.int64))], names=["seed", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(emit, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("docs"))


def cut_passages(docs: DataFrame, wanted: dict[int, BitFilter]) -> DataFrame:
    """doc_id, class, passage (id), start (word), words (binary), seeds: for each class of items, runs of words around the seeds that its filter passes."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, kinds, start, blobs, held, ids = [], [], [], [], [], []
            for first, end, data, off in pieces(b.column(1)):
                h, before = tokens(data, off)
                g = seeds(h)
                for kind, of_kind in wanted.items():
                    pad = 2 << kind
                    hit = np.flatnonzero(of_kind.contains(g))
                    row = np.searchsorted(before, hit, side="right") - 1
                    inside = hit + SEED_WORDS <= before[row + 1]
                    hit, row = hit[inside], row[inside]
                    if not len(hit):
                        continue
                    edge = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (hit[1:] - hit[:-1] > pad))))
                    for i, j in zip(edge, [*edge[1:], len(hit)]):
                        r = row[i]
                        a, z = max(hit[i] - pad, before[r]), min(hit[j - 1] + SEED_WORDS + pad, before[r + 1])
                        rows.append(first + r)
                        kinds.append(kind)
                        start.append(a - before[r])
                        blobs.append(h[a:z].tobytes())
                        held.append(np.unique(g[hit[i:j]]).view(np.int64).tolist())
                        ids.append(int(mix64(h[a:z]).sum(dtype=np.uint64).view(np.int64)))
            doc = b.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, pa.array(kinds, pa.int32()), pa.array(ids, pa.int64()), pa.array(start, pa.int64()), pa.array(blobs, pa.binary()), pa.array(held, pa.list_(pa.int64()))], names=["doc_id", "class", "passage", "start", "words", "seeds"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(emit, "doc_id bigint, class int, passage bigint, start bigint, words binary, seeds array<bigint>")


def _score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        step = 2048
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            text = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in part.column("words")]
            item = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in part.column("item")]
            score, end = align(text, item)
            share = score / (MATCH * np.array([len(x) for x in item]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("item_id"), pa.array(share), pa.array(score), pa.array(part.column("start").to_numpy() + end), pa.array([len(x) for x in item], pa.int64())], names=["doc_id", "item_id", "similarity", "score", "end_word", "n"])


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, min_matched: int = MIN_MATCHED) -> DataFrame:
    """doc_id, item_id, similarity, end_word of each document that holds a copy of an item, edited or not."""
    small_batches(docs.sparkSession)
    length = F.greatest(F.lit(LEAST_CLASS), F.ceil(F.log2("n")).cast("int")).alias("class")
    items = written(_item_words(benchmark).select("*", length), "items")
    of = items.select("item_id", "class", F.explode("seeds").alias("seed"))
    counts = seed_documents(docs, BitFilter.build(of, "seed", FILTER_BITS))
    counted = of.join(counts, "seed", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    usual = counted.groupBy(F.col("item_id").alias("of_item")).agg(F.percentile("docs", 0.75).alias("usual"))
    same = F.col("item_id").eqNullSafe(F.col("of_item"))
    rare = counted.join(usual, same).where(F.col("docs") <= F.greatest(F.lit(1.0), F.col("usual")) * RARE_FACTOR).select("item_id", "class", "seed")
    rare = written(rare.distinct(), "seeds")
    kinds = sorted(r["class"] for r in items.select("class").distinct().collect())  # at most one for each power of two
    passages = written(cut_passages(docs, {k: BitFilter.build(rare.where(F.col("class") == k), "seed", FILTER_BITS) for k in kinds}), "passages")
    met = passages.select("doc_id", "class", "passage", "start", F.explode("seeds").alias("seed")).join(rare, ["class", "seed"]).select("doc_id", "class", "passage", "start", "item_id").distinct()
    null_safe = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    place = (F.col("m.class") == F.col("p.class")) & (F.col("m.passage") == F.col("p.passage")) & (F.col("m.start") == F.col("p.start"))
    pairs = met.alias("m").join(passages.dropDuplicates(["doc_id", "class", "passage", "start"]).alias("p"), null_safe("m.doc_id", "p.doc_id") & place)
    pairs = pairs.select("m.doc_id", "m.item_id", "p.words", "m.start").alias("m").join(items.alias("i"), null_safe("m.item_id", "i.item_id")).select("m.doc_id", "m.item_id", "m.words", "m.start", "i.item")
    scored = pairs.mapInArrow(_score, "doc_id bigint, item_id bigint, similarity double, score bigint, end_word bigint, n bigint")
    found = scored.where((F.col("similarity") >= min_score) & (F.col("score") >= MATCH * F.least(F.lit(min_matched), "n")))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", "end_word")).alias("b"))
    return best.select("doc_id", "item_id", F.round("b.similarity", 6).alias("similarity"), F.col("b.end_word").alias("end_word"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    found = leaks(docs.select("doc_id", "text"), benchmark).select("doc_id").distinct()
    return docs.alias("l").join(found.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
