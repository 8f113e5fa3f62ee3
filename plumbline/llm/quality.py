"""Operator 1: quality classifier.

Statistics of each whole text go through histogram gradient-boosted trees. The
trees are fitted with numpy on the driver, on at most MAX_TRAIN_ROWS labelled
documents (those with the smallest hashes of doc_id among the labels that may be
learned from; this bound is a documented parameter), then flattened into five
arrays. Scoring is a map over the documents: per batch, all rows walk down each
tree together by array indexing.

Scale: no text is shuffled; the sample of label ids (bounded by MAX_TRAIN_ROWS)
and the trees (bounded by ROUNDS and DEPTH) are all that is broadcast.

Defined cases: null text counts as empty and gets a score; a null quality is no
label; repeated labels of a doc_id are averaged (1 if at least half); repeated
documents are scored each, and for learning the least text of a doc_id counts; of
labels above the bound those with the least hash are taken; very long texts
are measured whole; without labels of both classes every score is the
mean label, or 0.5; an empty table gives no rows; doc_id, lang, source and labels are
never features; extra columns are ignored or kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plumbline.llm.common import fresh, mix64, pieces, prefix_hash, small_batches, span_hash, words

MAX_TRAIN_ROWS = 20_000
ROUNDS, DEPTH, RATE, BINS, MIN_LEAF, RIDGE = 80, 4, 0.1, 64, 10, 1.0
CUT = 0.7
FOLDS, HELD_OUT_FOLD = 4, 2

#: Byte classes that are counted; letters by case are ASCII.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&<>", "bar": b"|", "bang": b"!?", "stop": b".", "comma": b",;", "mark": b"@/:=\"'()[]{}_-+~\\^`"}
FEATURES = ("log_bytes", "log_words", "word_bytes", "word_spread", "non_ascii", "capitals", "log_lines", "words_per_line", "repeated_lines", "distinct_words", "repeated_triples", "top_word", *CLASSES)


def _per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[off]).astype(np.float64)


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in each row, and the largest number of times that one occurs."""
    key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    if not len(key):
        return np.zeros(n), np.zeros(n)
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    owner = (key[at] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, owner, np.diff(at, append=len(key)))
    return np.bincount(owner, minlength=n).astype(np.float64), most


def statistics(column: pa.Array) -> np.ndarray:
    """(rows, features) of a string column."""
    out = np.zeros((len(column), len(FEATURES)))
    classes = []
    for members in CLASSES.values():
        table = np.zeros(256, dtype=bool)
        table[list(members)] = True
        classes.append(table)
    for first, end, data, off in pieces(column):
        n = end - first
        starts, ends, before = words(data, off)
        row = np.repeat(np.arange(n), np.diff(before))
        prefix = prefix_hash(data, lower=True)
        h = span_hash(prefix, starts, ends)
        n_words, n_bytes = np.diff(before).astype(np.float64), np.diff(off).astype(np.float64)
        per_word, per_byte = np.maximum(n_words, 1), np.maximum(n_bytes, 1)
        size = (ends - starts).astype(np.float64)
        mean = np.bincount(row, size, n) / per_word
        spread = np.sqrt(np.maximum(np.bincount(row, size * size, n) / per_word - mean * mean, 0))
        breaks = np.flatnonzero(data == 10)
        line_row = np.concatenate((np.arange(n), np.searchsorted(off, breaks, side="right") - 1))
        line_at = np.concatenate((off[:-1], breaks + 1))
        order = np.lexsort((line_at, line_row))
        line_row, line_at = line_row[order], line_at[order]
        close = np.append(line_at[1:] - 1, len(data))
        last = np.append(line_row[1:] != line_row[:-1], True)
        close[last] = off[line_row[last] + 1]
        solid = close > line_at
        n_lines = np.maximum(np.bincount(line_row[solid], minlength=n), 1).astype(np.float64)
        lines, _ = _distinct(line_row[solid], span_hash(prefix, line_at[solid], close[solid]), n)
        distinct, most = _distinct(row, h, n)
        same = row[2:] == row[:-2] if len(row) > 2 else np.zeros(0, bool)
        triple = mix64(mix64(mix64(h[:-2]) + h[1:-1]) + h[2:])[same] if len(h) > 2 else np.zeros(0, np.uint64)
        triples, _ = _distinct(row[2:][same] if len(row) > 2 else row[:0], triple, n)
        n_triples = np.maximum(n_words - 2, 1)
        part = out[first:end]
        capital = classes[0][data[starts]] if len(starts) else np.zeros(0, bool)
        part[:, 0], part[:, 1], part[:, 2], part[:, 3] = np.log1p(n_bytes), np.log1p(n_words), mean, spread
        part[:, 4] = _per_text(data >= 128, off) / per_byte
        part[:, 5] = np.bincount(row, capital, n) / per_word
        part[:, 6], part[:, 7], part[:, 8] = np.log1p(n_lines), n_words / n_lines, 1 - np.maximum(lines, 1) / n_lines
        part[:, 9], part[:, 10], part[:, 11] = distinct / per_word, np.where(n_words > 2, 1 - triples / n_triples, 0), most / per_word
        for j, table in enumerate(classes):
            part[:, 12 + j] = _per_text(table[data], off) / per_word
    return out


@dataclass(frozen=True)
class FlatTrees:
    """All trees in five arrays; node i of a tree goes to left[i] if value <= threshold[i], else right[i]; leaves point to themselves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> FlatTrees:
    """Boosting for the logistic loss over binned features; deterministic."""
    n, width = x.shape
    mean = float(np.mean(y)) if n else 0.5
    none = np.zeros(0)
    if n == 0 or mean in (0.0, 1.0):
        p = min(max(mean, 1e-6), 1 - 1e-6)
        return FlatTrees(none.astype(int), none.astype(int), none, none.astype(int), none.astype(int), none, float(np.log(p / (1 - p))), 0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    flat = code + np.arange(width) * bins
    start = float(np.log(mean / (1 - mean)))
    raw = np.full(n, start)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, 0), (threshold, 0.0), (left, len(left)), (right, len(right)), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        roots.append(node())
        slot, open_ = np.zeros(n, dtype=np.int64), [roots[-1]]
        for _ in range(depth):
            k = len(open_)
            live = slot >= 0
            index = (slot[live, None] * (width * bins) + flat[live]).ravel()
            shape = (k, width, bins)
            sums = [np.bincount(index, np.repeat(v[live], width), k * width * bins).reshape(shape).cumsum(axis=2) for v in (g, h, np.ones(n))]
            all_g, all_h, all_n = (s[:, :1, -1:] for s in sums)
            gl, hl, nl = sums
            gain = gl**2 / (hl + RIDGE) + (all_g - gl) ** 2 / (all_h - hl + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(nl < MIN_LEAF) | (all_n - nl < MIN_LEAF)] = -np.inf
            best = gain.reshape(k, -1).argmax(axis=1)
            to, after = np.full((k, 2), -1), []
            split = np.zeros((k, 2), dtype=np.int64)
            for i, at in enumerate(open_):
                j, b = divmod(int(best[i]), bins)
                if not gain[i, j, b] > 1e-9 or b >= len(cuts[j]):
                    continue
                feature[at], threshold[at] = j, float(cuts[j][b])
                left[at], right[at] = node(), node()
                to[i] = len(after), len(after) + 1
                after += [left[at], right[at]]
                split[i] = j, b
                for side, child in enumerate((left[at], right[at])):
                    sg, sh = (gl[i, j, b], hl[i, j, b]) if side == 0 else ((all_g - gl)[i, j, b], (all_h - hl)[i, j, b])
                    value[child] = rate * sg / (sh + RIDGE)
            s = np.where(live, slot, 0)
            above = code[np.arange(n), split[s, 0]] > split[s, 1]
            moved = to[s, above.astype(int)]
            slot, open_ = np.where(live, moved, -1), after
            if not after:
                break
        part = FlatTrees(np.array(roots[-1:]), *map(np.array, (feature, threshold, left, right, value)), 0.0, depth)
        raw += part.raw(x)
    return FlatTrees(np.array(roots), *map(np.array, (feature, threshold, left, right, value)), start, depth)


def fold_of(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> FlatTrees:
    """Fit on the labelled documents of all folds but the held-out one."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold_of() != HELD_OUT_FOLD))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("__label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("text", "__label", "doc_id")

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(0))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([flat, b.column(1), b.column(2)], names=["x", "y", "doc_id"])

    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "__label")).alias("r")).select("r.text", "r.__label", "doc_id")  # repeated documents count once, so the bound holds for rows too
    got = rows.mapInArrow(measure, "x array<double>, y double, doc_id bigint").toPandas()
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, ids = np.stack(got["x"].to_numpy()), got["doc_id"].to_numpy()
    order = np.lexsort((*x.T[::-1], ids))  # by doc_id, then by features: the fit must not depend on the order of arrival
    return fit(x[order], got["y"].to_numpy()[order])


def score_documents(docs: DataFrame, model: FlatTrees, carry: Sequence[str], name: str = "__score") -> DataFrame:
    """The columns `carry` and the score (double, under `name`) of every row."""
    small_batches(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name in carry]
    schema = StructType([StructField("row", StructType(fields)), StructField("score", DoubleType())])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(model.score(statistics(b.column(0))))], names=["row", "score"])

    rows = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{f.name}`") for f in fields]).alias("row"))
    return rows.mapInArrow(score, schema).select("row.*", F.col("score").alias(name))


def accepted(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs, all columns, that the classifier accepts."""
    name = fresh(docs, "score")
    return score_documents(docs, train(docs.select("doc_id", "text"), labels), docs.columns, name).where(F.col(name) >= cut).drop(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs, model, ["doc_id"])
    return scored.select("doc_id", (fold_of() == HELD_OUT_FOLD).alias("held_out"), F.col("__score").alias("score"), F.when(F.col("__score") >= CUT, 1).otherwise(0).alias("predicted"))
