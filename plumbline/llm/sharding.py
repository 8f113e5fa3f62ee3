"""Operator 3: sharding by a permutation-filled lookup table.

Each shard orders the slots of a prime-sized table by its own permutation
(offset and skip from hashes of its name); the shards take turns in claiming the
first slot of their order that is still free, until the table is full. A row's
shard is the table's entry at hash(key) mod size. Adding or removing a shard
moves about 1/shards of the rows and little else.

Scale: the table has TABLE_SIZE rows whatever the data are, so it is broadcast;
placing is a map over the rows without a shuffle. write_shards() moves each row
once, a shard split over as many tasks as its rows ask for (ROWS_PER_TASK), by
a salt from the whole row, so that rows of one key are spread too.

Defined cases: a null key is placed like the empty string; equal keys share a
shard, whatever their rows' order; texts are not looked at, so null, empty and very
long ones are placed like others; repeated rows are placed each; an empty table
gives no rows; columns named slot or shard that the input has are replaced, other
extra columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import fresh

SHARDS = 64
TABLE_SIZE = 65537
ROWS_PER_TASK = 200_000


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The filled table: entry i is the index of the shard that owns slot i."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table's size must be a prime of at least the number of shards")
    prefer = []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        prefer.append([int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1])
    owner, left = [-1] * size, size
    while True:
        for i, turn in enumerate(prefer):
            while owner[turn[0]] >= 0:
                turn[0] = (turn[0] + turn[1]) % size
            owner[turn[0]] = i
            left -= 1
            if not left:
                return owner


def assign_shards(docs: DataFrame, key: str = "doc_id", shards: Sequence[str] | int = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """docs with slot (int) and shard (int)."""
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    owner = lookup_table(names, size)
    table = docs.sparkSession.createDataFrame(list(enumerate(owner)), "slot int, shard int")
    slot = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), F.lit(size)).cast("int")
    kept = [F.col(f"l.`{c}`") for c in docs.columns if c.lower() not in ("slot", "shard")]
    placed = docs.withColumn("slot", slot)
    return placed.alias("l").join(F.broadcast(table).alias("r"), F.col("l.slot") == F.col("r.slot")).select(*kept, "l.slot", "r.shard")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: Sequence[str] | int = SHARDS, size: int = TABLE_SIZE, rows_per_task: int = ROWS_PER_TASK) -> None:
    """Write the rows as Parquet, a folder for each shard, in files of about rows_per_task rows."""
    placed = assign_shards(docs, key, shards, size)
    names = shards if isinstance(shards, int) else len(shards)
    tasks = max(1, -(-docs.count() // (names * rows_per_task)))
    salt = fresh(placed, "salt")
    own = [F.col(f"`{f.name}`") for f in placed.schema.fields if "map<" not in f.dataType.simpleString()]
    placed = placed.withColumn(salt, F.pmod(F.xxhash64(*own), F.lit(tasks)))
    placed.repartition(max(1, names * tasks), "shard", salt).drop(salt).write.partitionBy("shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    return assign_shards(docs)
