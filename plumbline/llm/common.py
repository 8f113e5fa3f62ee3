"""Helpers shared by the training-data operators.

Texts reach Python as Arrow batches; the numpy kernels here work on the raw
UTF-8 bytes of a few megabytes at a time, so that memory depends on the piece
(or the one longest document), never on the partition.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.scratch import brief_shuffles, forget, new_folder

#: The ASCII white space that separates words, [\x20\x09-\x0D].
WHITESPACE = b" \t\n\x0b\x0c\r"
PIECE_BYTES = 1 << 20
ROWS_PER_BATCH, BYTES_PER_BATCH = 1000, 32 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[list(WHITESPACE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE_LOWER = _TABLE[LOWER]
_POWERS: dict[int, np.ndarray] = {}


# ---------------------------------------------------------------- shared storage


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut lineage: write a table in the shared folder and read it back; also its path, for forget()."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with brief_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name)[0]


#: A stored table is worked through in one slice for each SLICE_BYTES of it, up to MOST_SLICES.
SLICE_BYTES, MOST_SLICES = 64 << 20, 8


def slices_of(spark: SparkSession, path: str) -> int:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return int(max(1, min(MOST_SLICES, held // SLICE_BYTES)))


def in_slices(df: DataFrame, column: str, n: int, plan: Callable[[DataFrame], DataFrame], name: str) -> tuple[DataFrame, list[str]]:
    """plan(df) as stored tables, from an n-th of the values of a mixed bigint column at a time, so that shuffles hold an n-th of the rows; also the paths. plan must not bring different values together."""
    made = [stored(plan(df.where(F.pmod(F.col(column), F.lit(n)) == i) if n > 1 else df), name) for i in range(n)]
    paths = [path for _, path in made]
    return df.sparkSession.read.schema(made[0][0].schema).parquet(*paths), paths


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and the bytes that a Python worker gets at once. Plans take these settings up when they run, so they stay set in the session; tighter ones of the caller's are kept."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH)):
        now = re.fullmatch(r"(\d+)[bB]?", spark.conf.get(key, None) or "")
        if now is None or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


# ---------------------------------------------------------------- hashing


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, PIECE_BYTES + 4096), base, dtype=np.uint64)
        p[0] = 1
        have = np.multiply.accumulate(p)
        if len(have) <= 4 * PIECE_BYTES:
            _POWERS[base] = have
    return have


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums of a polynomial hash over bytes; see span_hash."""
    v = (_TABLE_LOWER if lower else _TABLE)[data]
    v *= _powers(_BASE, len(data))[: len(data)]
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(v, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each bytes[start:end]; equal bytes give equal hashes wherever they stand."""
    inverse = _powers(_INVERSE, len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def rolling_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` bytes, cheaper than span_hash; only its high bits are well mixed."""
    n = len(prefix) - width
    out = prefix[width:] - prefix[:n]
    out *= _powers(_INVERSE, n)[:n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


# ---------------------------------------------------------------- text pieces


def text_array(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw, off


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about `limit` bytes; a longer text is a piece of its own."""
    raw, off = text_array(column)
    n, at = len(off) - 1, 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, raw[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number of words before each text) of the words of a piece; no word crosses texts."""
    solid = ~SPACE[data]
    begin, close = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    close[:-1] &= ~solid[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin[inner] |= solid[inner]
    close[inner - 1] |= solid[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(close) + 1
    return starts, ends, np.searchsorted(starts, off)


# ---------------------------------------------------------------- fixed-size bit filter


class BitFilter:
    """Bloom filter of a fixed number of bits, built by blocks on the executors; its size never grows with the data.

    It only spares work: an exact join always follows it.
    """

    def __init__(self, bits: np.ndarray, log2_bits: int, probes: int = 3):
        self.bits, self.log2_bits, self.probes = bits, log2_bits, probes

    @staticmethod
    def positions(h: np.ndarray, log2_bits: int, probes: int) -> np.ndarray:
        """(probes, n) bit positions; all probes of a key stay in one block of 2^16 bits."""
        h = mix64(h.astype(np.uint64) + np.uint64(0x1234567))
        block = (h >> np.uint64(64 - (log2_bits - 16))) << np.uint64(16) if log2_bits > 16 else np.zeros_like(h)
        low, step = h & np.uint64(0xFFFF), (h >> np.uint64(16)) | np.uint64(1)
        return np.stack([block + ((low + np.uint64(i) * step) & np.uint64(0xFFFF)) for i in range(probes)])

    def contains(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for p in self.positions(h, self.log2_bits, self.probes):
            out &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out

    @classmethod
    def build(cls, keys: DataFrame, column: str, log2_bits: int = 26, probes: int = 3) -> BitFilter:
        """keys: a DataFrame with a bigint column. The driver gets 2^log2_bits bits, whatever the number of keys."""
        per_slab = 20  # bits of position within a slab of 2^20 bits = 128 KB

        def positions(batches):
            for b in batches:
                h = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                p = np.unique(cls.positions(h, log2_bits, probes).ravel())
                yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(per_slab)).astype(np.int32)), pa.array((p & np.uint64((1 << per_slab) - 1)).astype(np.int32))], names=["slab", "pos"])

        def slabs(batches):
            found: dict[int, np.ndarray] = {}
            for b in batches:
                slab, pos = b.column(0).to_numpy(), b.column(1).to_numpy()
                for s in np.unique(slab):
                    bits = found.setdefault(int(s), np.zeros(1 << (per_slab - 3), dtype=np.uint8))
                    p = pos[slab == s]
                    np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
            for s, bits in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["slab", "bits"])

        n = max(1, min(16, 1 << max(0, log2_bits - per_slab)))
        with brief_shuffles(keys.sparkSession):
            rows = keys.select(F.col(column).cast("bigint").alias("k")).where("k is not null").mapInArrow(positions, "slab int, pos int").distinct().repartition(n, "slab").mapInArrow(slabs, "slab int, bits binary").collect()  # one row for each slab: 2^log2_bits bits in all
        out = np.zeros(1 << (log2_bits - 3), dtype=np.uint8)
        size = 1 << (per_slab - 3)
        for row in rows:
            at = row["slab"] * size
            got = np.frombuffer(zlib.decompress(row["bits"]), dtype=np.uint8)[: len(out) - at]
            out[at : at + len(got)] |= got
        return cls(out, log2_bits, probes)


# ---------------------------------------------------------------- runs of equal keys


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of sorted batches."""
    rest: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in keys]
        cut = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        cut[0] = last is None or any(c[0] != x for c, x in zip(cols, last))
        edges = np.flatnonzero(cut)
        if rest and len(edges):
            rest.append(b.slice(0, edges[0]))
            yield pa.Table.from_batches(rest)
            rest = []
        if not len(edges):
            rest.append(b)
        for i, j in zip(edges, [*edges[1:], None]):
            if j is None:
                rest = [b.slice(i)]
            else:
                yield pa.Table.from_batches([b.slice(i, j - i)])
        last = [c[-1] for c in cols]
    if rest:
        yield pa.Table.from_batches(rest)


# ---------------------------------------------------------------- connected components

CONTRACT_EDGES = 1 << 18


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace runs of CONTRACT_EDGES edges by stars with the same components: each node and the least node it reaches within the run."""

    def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
        while len(a):
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while (root[root] != root).any():
                root = root[root]
            open_ = root[a] != root[b]
            a, b = a[open_], b[open_]
        hung = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[hung]), pa.array(nodes[root[hung]])], names=["u", "v"])

    us, vs, held = [], [], 0
    for x in batches:
        us.append(x.column(0).to_numpy())
        vs.append(x.column(1).to_numpy())
        held += x.num_rows
        if held >= CONTRACT_EDGES:
            yield stars(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [], [], 0
    if held:
        yield stars(np.concatenate(us), np.concatenate(vs))


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    edges: bigint columns a, b. The edges of each task are contracted first, then
    stars are contracted by turns: in each round the neighbours of a node are hung
    below the smallest of them; every round is a stored table that replaces the one
    before, and a hub's edges are a join that can be split.
    """
    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, path = stored(pairs.mapInArrow(_contract, "u bigint, v bigint"), "edges")
    mark = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    state = e.agg(*mark).first()
    for _ in range(rounds if state[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        hung = large.join(low, F.col("u") == F.col("x"))
        small = hung.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()
        after, new = stored(small, "edges")
        now = after.agg(*mark).first()
        forget(spark, path)
        e, path = after, new
        if now == state:
            break
        state = now
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
