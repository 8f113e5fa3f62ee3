"""Operator 6: token counts of a unigram vocabulary by dynamic programming shared in a trie.

A text's pre-tokens are its words, each with the word mark in front. The
distinct pre-tokens of a batch go into a trie, level by level: a node is a
distinct prefix, found by its hash. The forward score of a node (least cost to
write the prefix in pieces, ties going to fewer pieces) is computed once for all
pre-tokens that share it; the number of pieces is stored at the terminal nodes,
and a text's count is the sum over its words. A byte that no piece covers is one
token, dearer than any piece.

The vocabulary is a public file of pieces in order of rank (never trained here);
a piece of rank r costs ln(r + 2), in millionths, so that frequent pieces are
cheap. Its path is a parameter. Costs and counts are two arrays of 64 bits, exact for
words of up to a hundred gigabytes.

Scale: a map over the documents; no shuffle. A task remembers the counts of at
most CACHE_WORDS distinct pre-tokens and starts again beyond that, which changes
its speed alone. The vocabulary (tens of thousands of pieces) is shipped to the
workers. A word of more than CHAIN_BYTES is a chain of the trie and walked alone,
in time linear in its bytes.

Defined cases: null or empty text has 0 words and 0 tokens; a null doc_id stays
null; ways of equal cost go to the one with fewer tokens; repeated rows get a row
each; an empty table gives no rows; extra columns are ignored, whatever their names.
Very long texts and single words of megabytes are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import pieces, prefix_hash, small_batches, span_hash, words

MARK = "▁"
CACHE_WORDS = 1 << 20
#: Words of more bytes are walked alone, WINDOW bytes at a time.
CHAIN_BYTES, WINDOW = 256, 1 << 16
#: Where the public vocabulary files of the query lie, unless the session names another file.
VOCABULARY_SETTING, QUERY_VOCABULARY = "plumbline.vocabulary", "/opt/tokenizers/piece_bpe_32k.model"
_FAR = np.int64(1) << np.int64(62)


@dataclass(frozen=True)
class Vocabulary:
    """Hash tables of the pieces' costs: inside a word, and at its start after the mark; the mark alone as (cost, tokens)."""

    inner: tuple[np.ndarray, np.ndarray]
    start: tuple[np.ndarray, np.ndarray]
    inner_lengths: tuple[int, ...]
    start_lengths: tuple[int, ...]
    mark: tuple[int, int]
    byte: int

    @classmethod
    def from_pieces(cls, ranked: list[str]) -> Vocabulary:
        cost: dict[str, int] = {}
        for r, p in enumerate(ranked):
            if p:
                cost.setdefault(p, int(round(np.log(r + 2.0) * 1e6)))
        byte = int(round((np.log(len(ranked) + 2.0) + 1) * 1e6))
        inner = {p.encode(): c for p, c in cost.items() if MARK not in p}
        start = {p[1:].encode(): c for p, c in cost.items() if p[0] == MARK and len(p) > 1 and MARK not in p[1:]}
        mark = (cost[MARK], 1) if MARK in cost else (3 * byte, 3)
        return cls(_table(inner), _table(start), tuple(sorted({len(p) for p in inner})), tuple(sorted({len(p) for p in start})), mark, byte)

    @property
    def reach(self) -> int:
        """Bytes of the longest piece inside a word."""
        return max(self.inner_lengths[-1:] + (1,))


def _table(costs: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing: hashes and costs in 2^k slots."""
    size = 1 << max(4, (4 * len(costs)).bit_length())
    keys, values = np.zeros(size, dtype=np.uint64), np.full(size, _FAR)
    for p, c in costs.items():
        data = np.frombuffer(p, dtype=np.uint8)
        h = span_hash(prefix_hash(data), np.array([0]), np.array([len(data)]))[0]
        at = int(h) & (size - 1)
        while keys[at]:
            at = (at + 1) & (size - 1)
        keys[at], values[at] = h, c
    return keys, values


def _look(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
    keys, values = table
    mask = np.uint64(len(keys) - 1)
    at = h & mask
    found = keys[at]
    out = np.where(found == h, values[at], _FAR)
    open_ = np.flatnonzero((found != h) & (found != 0))
    while len(open_):
        at[open_] = (at[open_] + np.uint64(1)) & mask
        found = keys[at[open_]]
        hit = found == h[open_]
        out[open_[hit]] = values[at[open_[hit]]]
        open_ = open_[~hit & (found != 0)]
    return out


def load_vocabulary(path: str) -> Vocabulary:
    """Pieces of a sentencepiece model, without its control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ranked = sorted(own, key=lambda i: (-model.get_score(i), i))
    return Vocabulary.from_pieces([model.id_to_piece(i) for i in ranked])


class Forward:
    """Least cost of each trie node of a depth, and the fewest tokens among the ways of that cost."""

    def __init__(self, cost: np.ndarray, tokens: np.ndarray):
        self.cost, self.tokens = cost, tokens

    def offer(self, cost: np.ndarray, tokens: np.ndarray | int, valid: np.ndarray) -> None:
        better = valid & ((cost < self.cost) | ((cost == self.cost) & (tokens < self.tokens)))
        self.cost, self.tokens = np.where(better, cost, self.cost), np.where(better, tokens, self.tokens)


def trie_counts(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Number of tokens of each distinct word bytes[start:end], given the prefix hashes of the bytes."""
    length = ends - starts
    order = np.argsort(length, kind="stable")
    starts, sorted_length = starts[order], length[order]
    n, out = len(starts), np.zeros(len(starts), dtype=np.int64)
    nodes: list[np.ndarray | None] = [np.zeros(n, dtype=np.int64)]
    scores: list[Forward | None] = [Forward(np.array([v.mark[0]], dtype=np.int64), np.array([v.mark[1]], dtype=np.int64))]
    for depth in range(1, int(sorted_length[-1]) + 1 if n else 1):
        first = int(np.searchsorted(sorted_length, depth))
        whole, lead, inverse = np.unique(span_hash(prefix, starts[first:], starts[first:] + depth), return_index=True, return_inverse=True)
        lead_at, parent = starts[first:][lead], scores[depth - 1]
        at = nodes[depth - 1][first:][lead]
        best = Forward(parent.cost[at] + v.byte, parent.tokens[at] + 1)
        for k in v.inner_lengths:
            if k > depth:
                break
            piece = _look(v.inner, whole if k == depth else span_hash(prefix, lead_at + depth - k, lead_at + depth))
            at, before = nodes[depth - k][first:][lead], scores[depth - k]
            best.offer(before.cost[at] + piece, before.tokens[at] + 1, piece < _FAR)
        if depth in v.start_lengths:
            piece = _look(v.start, whole)
            best.offer(piece, 1, piece < _FAR)
        node = np.full(n, -1, dtype=np.int64)
        node[first:] = inverse
        nodes.append(node)
        scores.append(best)
        if depth >= v.reach:
            nodes[depth - v.reach] = scores[depth - v.reach] = None
        last = int(np.searchsorted(sorted_length, depth, side="right"))
        out[order[first:last]] = best.tokens[node[first:last]]
    return out


def chain_count(prefix: np.ndarray, start: int, end: int, v: Vocabulary) -> int:
    """trie_counts of one long word, whose trie is a chain: the pieces that end in a window are looked up together, and only the last `reach` scores go on to the next."""
    cost, tokens = [v.mark[0]], [v.mark[1]]
    for at in range(start, end, WINDOW):
        stop = min(at + WINDOW, end)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in v.inner_lengths:
            last = np.arange(max(at + 1, start + k), stop + 1)
            piece = _look(v.inner, span_hash(prefix, last - k, last))
            hit = np.flatnonzero(piece < _FAR)
            found.append((last[hit], np.full(len(hit), k), piece[hit]))
        close, size, price = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 3
        order = np.argsort(close, kind="stable")
        close, size, price = close[order].tolist(), size[order].tolist(), price[order].tolist()
        whole = {start + k: int(_look(v.start, span_hash(prefix, np.array([start]), np.array([start + k])))[0]) for k in v.start_lengths if at == start and k <= stop - start}
        j, n = 0, len(close)
        for here in range(at + 1, stop + 1):
            best = (cost[-1] + v.byte, tokens[-1] + 1)
            while j < n and close[j] == here:
                option = (cost[-size[j]] + price[j], tokens[-size[j]] + 1)
                if option < best:
                    best = option
                j += 1
            if here in whole and (whole[here], 1) < best:
                best = (whole[here], 1)
            cost.append(best[0])
            tokens.append(best[1])
        cost, tokens = cost[-v.reach :], tokens[-v.reach :]
    return tokens[-1]


class Counter:
    """Counts of words, remembered across batches up to a bound."""

    def __init__(self, vocabulary: Vocabulary, limit: int = CACHE_WORDS):
        self.vocabulary, self.limit = vocabulary, limit
        self.keys, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def count(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, tokens) of each text of a piece."""
        starts, ends, before = words(data, off)
        prefix = prefix_hash(data)
        unique, first, inverse = np.unique(span_hash(prefix, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        known = self.keys[at] == unique if len(self.keys) else np.zeros(len(unique), dtype=bool)
        tokens = np.zeros(len(unique), dtype=np.int64)
        tokens[known] = self.counts[at[known]] if len(self.keys) else 0
        new = first[~known]
        long = ends[new] - starts[new] > CHAIN_BYTES
        fresh = np.zeros(len(new), dtype=np.int64)
        fresh[~long] = trie_counts(prefix, starts[new[~long]], ends[new[~long]], self.vocabulary)
        fresh[long] = [chain_count(prefix, int(starts[i]), int(ends[i]), self.vocabulary) for i in new[long]]
        tokens[~known] = fresh
        if len(self.keys) + len(new) > self.limit:
            self.keys, self.counts = unique[: self.limit], tokens[: self.limit]
        elif len(new):
            keys = np.concatenate((self.keys, unique[~known]))
            order = np.argsort(keys, kind="stable")
            self.keys, self.counts = keys[order], np.concatenate((self.counts, tokens[~known]))[order]
        total = np.concatenate(([0], np.cumsum(tokens[inverse])))
        return np.diff(before), np.diff(total[before])


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_words, n_tokens for each row of docs."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for b in batches:
            n_words, n_tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, off in pieces(b.column(1)):
                w, t = counter.count(data, off)
                n_words.append(w)
                n_tokens.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_tokens))], names=["doc_id", "n_words", "n_tokens"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(emit, "doc_id bigint, n_words bigint, n_tokens bigint")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = load_vocabulary(spark.conf.get(VOCABULARY_SETTING, QUERY_VOCABULARY))
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary)
