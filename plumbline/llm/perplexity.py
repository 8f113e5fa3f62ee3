"""Operator 8: language-model scoring with a log-frequency Bloom filter.

The training documents' words and word pairs are counted by hash range on the
executors. Each pair's count is quantised on a logarithmic scale, and the pair is
put into a Bloom filter once for each level up to its own (so a lookup probes level
1, 2, ... until one is missing). The filter lies in slabs, one for each range of
hashes; a slab has as many bits as its entries need (BITS_PER_ENTRY or more), and
the number of slabs grows with the data, so that no pair is left out at any size.

Probability of a word w after v, with exact unigram counts c, N tokens and V words:
  P1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))
  P(w | history) = l * f(v, w) / c(v) + (1 - l) P1(w)
f being the filter's (rounded down) count; l depends on the history alone: on how
many of the last WINDOW pairs were found although chance would not explain them
(CONFIDENCE). Up to the filter's false positives the probabilities after a
history sum to one at most.

Scale: documents are dealt into buckets of about BUCKET_BYTES of text (one shuffle
of the text, used twice). Counts travel through a tree of exchanges: a bucket cuts
its distinct words and pairs by the first digit of their hashes (FAN digits) and
sends one compressed block for each; the FAN buckets next to each other meet in a
node for each digit, which adds up equal keys, cuts by the next digit and sends on,
and so forth, until one node holds all of a range of hashes. There the words' totals
and the pairs' slab are made, and answers go back the same way. A node gets FAN
messages whatever the size of the data, the number of messages grows with the
data (times the levels, log FAN of the buckets), and a key that every document
holds reaches a node FAN times at most. A slab lives only in the task that probes
it; nothing is broadcast and no machine holds a dictionary.

Defined cases: null or empty text is one end token; repeated rows count and are
scored as often as they occur, and rows equal in doc_id and text share a bucket;
a null doc_id belongs to fold crc32('') mod 5; a very long text is a bucket's load
of its own; without training text all probabilities come from 0.5 / (0.5 (V + 1));
an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import mix64, pieces, prefix_hash, small_batches, span_hash, words

FOLDS, HELD_OUT_FOLD = 5, 1
PROBES, BITS_PER_ENTRY = 4, 32
WINDOW, CHANCE = 6, 0.05
CONFIDENCE = np.array([0.02, 0.15, 0.5, 0.8, 0.9, 0.95, 0.97])
#: Text in a bucket, and the binary logarithm of FAN, the number of nodes that a node sends to.
BUCKET_BYTES, FAN_BITS = 8 << 20, 8
END = np.uint64(0xE0DE0DE0DE0DE0D1)
#: The levels of counts.
LEVELS = np.unique(np.round(np.sqrt(2.0) ** np.arange(80)).astype(np.int64))


def level_of(count: np.ndarray) -> np.ndarray:
    """Quantised count: the number of levels that are at most count."""
    return np.searchsorted(LEVELS, count, side="right")


# ---------------------------------------------------------------- blocks of sorted hashes


def pack(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as compressed differences."""
    d = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, 8).T.tobytes()) if len(d) else b""


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype=np.uint64)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel().cumsum(dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()) if len(counts) else b""


def unpack_counts(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype=np.int64)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel()


def _sum_sorted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


# ---------------------------------------------------------------- tokens


def token_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the words of each text and its end token."""
    starts, ends, before = words(data, off)
    h = span_hash(prefix_hash(data, lower=True), starts, ends)
    n = np.diff(before) + 1
    at = np.concatenate(([0], np.cumsum(n)))
    out = np.full(at[-1], END, dtype=np.uint64)
    body = np.ones(at[-1], dtype=bool)
    body[at[1:] - 1] = False
    out[body] = h
    return out, at


def pair_hashes(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of (previous, token) for each token, 48 bits of it; the first token of a text follows the end token."""
    previous = np.empty_like(tokens)
    previous[1:] = tokens[:-1]
    previous[at[:-1]] = END
    return mix64(mix64(previous) + tokens) & np.uint64(0xFFFFFFFFFFFF0000)


# ---------------------------------------------------------------- the filter


class LogBloom:
    """Log-frequency Bloom filter over slabs: the top bits of a hash choose the slab, its probes stay inside."""

    def __init__(self, bits: np.ndarray, slab_bits: int, filter_bits: int):
        self.bits, self.slab_bits, self.filter_bits = bits, slab_bits, filter_bits

    @staticmethod
    def places(h: np.ndarray, level: int, width: int) -> list[np.ndarray]:
        """Positions of a (hash, level) within a slab of 2^width bits."""
        x = mix64(h ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        step = (x >> np.uint64(33)) | np.uint64(1)
        return [(x + np.uint64(i) * step) & np.uint64((1 << width) - 1) for i in range(PROBES)]

    @classmethod
    def slab(cls, keys: np.ndarray, counts: np.ndarray, width: int = 3) -> np.ndarray:
        """The bits of a slab: 2^width, or as many more as its entries need."""
        level = level_of(counts)
        keys, level = keys[level > 0], level[level > 0]
        while (1 << width) < int(level.sum()) * BITS_PER_ENTRY:
            width += 1
        bits = np.zeros(1 << (width - 3), dtype=np.uint8)
        for q in range(1, int(level.max()) + 1 if len(level) else 1):
            own = keys[level >= q]
            for p in cls.places(own, q, width):
                np.bitwise_or.at(bits, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
        return bits

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> LogBloom:
        """One slab that holds all keys of a count."""
        bits = cls.slab(keys, counts)
        return cls(bits, 0, len(bits).bit_length() + 2)

    def count(self, h: np.ndarray) -> np.ndarray:
        """Counts, rounded down to a level; 0 for what the filter does not hold."""
        out = np.zeros(len(h), dtype=np.int64)
        width = self.filter_bits - self.slab_bits
        at, own = np.arange(len(h)), h
        for q in range(1, len(LEVELS) + 1):
            base = (own >> np.uint64(64 - self.slab_bits)) << np.uint64(width) if self.slab_bits else np.zeros_like(own)
            keep = np.ones(len(own), dtype=bool)
            for p in self.places(own, q, width):
                p = base + p
                hit = (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
                keep &= hit
            at, own = at[keep], own[keep]
            if not len(at):
                break
            out[at] = LEVELS[q - 1]
        return out


def confidence(surprising: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Weight of the pair model for each token, from the surprising pairs among the WINDOW before it in its text."""
    total = np.zeros(len(surprising) + 1, dtype=np.int64)
    np.cumsum(surprising, out=total[1:])
    here = np.arange(len(surprising))
    start = np.repeat(at[:-1], np.diff(at))
    return CONFIDENCE[total[here] - total[np.maximum(here - WINDOW, start)]]


def train_mask(held: pa.Array) -> np.ndarray:
    return ~held.to_numpy(zero_copy_only=False).astype(bool)


# ---------------------------------------------------------------- the exchange

MESSAGE = "node bigint, source bigint, digit int, words binary, word_counts binary, pairs binary, pair_counts binary"
ANSWER = "node bigint, digit int, word_totals binary, pair_counts binary, n_tokens bigint, n_words bigint"


def _split(keys: np.ndarray, prefix: int, level: int, fan_bits: int) -> np.ndarray:
    """Where sorted keys that share the digits of `prefix` are cut by their next digit."""
    return np.searchsorted(keys, ((np.uint64(prefix) << np.uint64(fan_bits)) + np.arange(1, 1 << fan_bits, dtype=np.uint64)) << np.uint64(64 - fan_bits * (level + 1)))


def _messages(source: int, level: int, fan_bits: int, words: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """Rows from a node of a level to the nodes of the next, one for each digit."""
    done, fan = fan_bits * level, 1 << fan_bits
    above, prefix = source >> done, source & ((1 << done) - 1)
    nodes = [((above >> fan_bits) << (done + fan_bits)) | (prefix << fan_bits) | d for d in range(fan)]
    columns = []
    for keys, counts in (words, pairs):
        cut = _split(keys, prefix, level, fan_bits)
        columns += [pa.array([pack(x) for x in np.split(keys, cut)], pa.binary()), pa.array([pack_counts(x) for x in np.split(counts, cut)], pa.binary())]
    return pa.table([pa.array(nodes, pa.int64()), pa.array([source] * fan, pa.int64()), pa.array(range(fan), pa.int32()), *columns], names=["node", "source", "digit", "words", "word_counts", "pairs", "pair_counts"])


def _read(group: pa.Table, keys: str, counts: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The keys that each message asks for, and all of them with their counts added up."""
    asked = [unpack(x.as_py()) for x in group.column(keys)]
    return asked, *_sum_sorted(np.concatenate(asked), np.concatenate([unpack_counts(x.as_py()) for x in group.column(counts)]))


def pass_on(level: int, fan_bits: int):
    """Add up the messages to a node of a level and send them to the next."""

    def send(group: pa.Table) -> pa.Table:
        return _messages(group.column("node")[0].as_py(), level, fan_bits, _read(group, "words", "word_counts")[1:], _read(group, "pairs", "pair_counts")[1:])

    return send


def _answers(group: pa.Table, values: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]], n_tokens: int, n_words: int) -> pa.Table:
    """Answers to the senders of a node's messages, each in the order of the keys that it sent."""
    columns = [pa.array([pack_counts(have[np.searchsorted(keys, k)]) for k in asked], pa.binary()) for asked, keys, have in values]
    n = group.num_rows
    return pa.table([group.column("source"), group.column("digit"), *columns, pa.array([n_tokens] * n, pa.int64()), pa.array([n_words] * n, pa.int64())], names=["node", "digit", "word_totals", "pair_counts", "n_tokens", "n_words"])


def answer(group: pa.Table) -> pa.Table:
    """At the last level: exact totals of words, and what the node's slab of the filter holds of the pairs."""
    asked, keys, total = _read(group, "words", "word_counts")
    of_pairs, pairs, counts = _read(group, "pairs", "pair_counts")
    held = LogBloom.of(pairs, counts).count(pairs)
    return _answers(group, [(asked, keys, total), (of_pairs, pairs, held)], int(total.sum()), int((total > 0).sum()))


def _joined(told: pa.Table) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Word totals, pair counts, training tokens and distinct training words of all digits."""
    told = told.sort_by("digit")
    values = [np.concatenate([unpack_counts(x.as_py()) for x in told.column(c)]) for c in ("word_totals", "pair_counts")]
    return *values, *(int(np.sum(told.column(c).to_numpy())) for c in ("n_tokens", "n_words"))


def pass_back(group: pa.Table, told: pa.Table) -> pa.Table:
    """Take a node's answers apart again for the senders of its messages."""
    asked, keys, _ = _read(group, "words", "word_counts")
    of_pairs, pairs, _ = _read(group, "pairs", "pair_counts")
    total, held, n_tokens, n_words = _joined(told)
    return _answers(group, [(asked, keys, total), (of_pairs, pairs, held)], n_tokens, n_words)


# ---------------------------------------------------------------- scoring


def _tokenised(group: pa.Table):
    for b in group.combine_chunks().to_batches():
        for first, end, data, off in pieces(b.column("text")):
            yield b.column("doc_id").slice(first, end - first), b.column("held_out").slice(first, end - first), *token_hashes(data, off)


def ask(fan_bits: int):
    """A bucket's distinct words and pairs with their training counts."""

    def send(group: pa.Table) -> pa.Table:
        words_found, pairs_found = [], []
        for _, held_out, t, at in _tokenised(group):
            use = np.repeat(train_mask(held_out), np.diff(at)).astype(np.int64)
            words_found.append(_sum_sorted(t, use))
            pairs_found.append(_sum_sorted(pair_hashes(t, at), use))
        own = [_sum_sorted(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])) for found in (words_found, pairs_found)]
        return _messages(group.column("bucket")[0].as_py(), 0, fan_bits, *own)

    return send


def score(texts: pa.Table, told: pa.Table) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    read = list(_tokenised(texts))
    if not read:
        return schema.empty_table()
    total, held, n_train, vocabulary = _joined(told)
    keys = np.unique(np.concatenate([np.unique(t) for _, _, t, _ in read]))
    pairs = np.unique(np.concatenate([np.unique(pair_hashes(t, at)) for _, _, t, at in read]))
    unigram = (total + 0.5) / (n_train + 0.5 * (vocabulary + 1))
    log_unigram = np.log10(unigram)
    end = int(np.searchsorted(keys, END))
    out = []
    for ids, held_out, t, at in read:
        index = np.searchsorted(keys, t)
        pair = held[np.searchsorted(pairs, pair_hashes(t, at))]
        before = np.empty_like(index)
        before[1:] = index[:-1]
        before[at[:-1]] = end
        history = total[before].astype(np.float64)
        chance = history * total[index] / max(n_train, 1)
        share = np.where(history > 0, confidence((pair > 0) & (chance < CHANCE), at), 0.0)
        p = (1 - share) * unigram[index] + share * np.minimum(pair / np.maximum(history, 1), 1.0)
        cut, n = at[:-1], np.diff(at)
        figures = (n, np.add.reduceat((total[index] > 0).astype(np.int64), cut), np.full(len(n), n_train), np.add.reduceat(log_unigram[index], cut), np.add.reduceat(np.log10(p), cut))
        out.append(pa.RecordBatch.from_arrays([ids, held_out, *map(pa.array, figures)], schema=schema))
    return pa.Table.from_batches(out, schema=schema)


def score_documents(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, fan_bits: int = FAN_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    small_batches(docs.sparkSession)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    text = F.col("text").cast("string")
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    levels = max(1, -(-(buckets - 1).bit_length() // fan_bits))
    home = F.xxhash64("doc_id", text)  # rows without a doc_id are spread by their texts
    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), (fold == HELD_OUT_FOLD).alias("held_out"), F.pmod(home, F.lit(buckets)).cast("bigint").alias("bucket"))
    messages = [dealt.groupBy("bucket").applyInArrow(ask(fan_bits), MESSAGE)]
    for level in range(1, levels):
        messages.append(messages[-1].groupBy("node").applyInArrow(pass_on(level, fan_bits), MESSAGE))
    told = messages[-1].groupBy("node").applyInArrow(answer, ANSWER)
    for sent in reversed(messages[:-1]):
        told = sent.groupBy("node").cogroup(told.groupBy("node")).applyInArrow(pass_back, ANSWER)
    return dealt.groupBy("bucket").cogroup(told.groupBy("node")).applyInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
