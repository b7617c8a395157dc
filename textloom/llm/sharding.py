"""Placement of documents on shards by a permutation-filled lookup table.

Every shard has a preference order over the SLOTS places of a table, SLOTS a prime: a start and a step, both from
hashes of its name, walk through all places once.  The shards take turns; each claims the first place of
its order that is free.  The table is full after SLOTS claims, shards differ by at most one place, and a
shard that is added or taken away moves little else.  A document's place is its MD5 modulo SLOTS, and a broadcast of the
table - SLOTS rows, whatever the input - gives its shard.

A null doc_id is placed as the empty text; repeated ids come to the same shard; an empty table gives an empty
result.  Columns of the input that are named slot or shard, in any case, are replaced; all others, and texts
of any length, are only carried.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import fresh, read

SLOTS, SHARDS = 65537, 64


def _hash(kind: str, name: str) -> int:
    return int.from_bytes(hashlib.md5(f"{kind}:{name}".encode()).digest()[:8], "big")


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """For each place the position in names of its shard."""
    if not names or len(set(names)) < len(names) or slots < len(names):
        raise ValueError("shards need distinct names and a place each")
    at = [_hash("start", n) % slots for n in names]
    step = [_hash("step", n) % (slots - 1) + 1 for n in names]
    table, left = [-1] * slots, slots
    while True:
        for k in range(len(names)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                return table


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def place(spark: SparkSession, docs: DataFrame, names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """docs with slot and shard."""
    names = names or shard_names()
    mine, shard = fresh("slot"), fresh("shard")
    filled = lookup_table(names, slots)
    table = spark.createDataFrame(pa.table({mine: pa.array(range(slots), pa.int32()), shard: pa.array(filled, pa.int64())}))
    kept = [c for c in docs.columns if c.lower() not in ("slot", "shard")]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    slot = (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % slots).cast("int")
    out = docs.select(*kept, slot.alias("slot")).join(F.broadcast(table), F.col("slot") == F.col(mine))
    return out.select(*kept, F.col("slot").cast("long").alias("slot"), F.col(shard).alias("shard"))


def write_shards(docs: DataFrame, path: str) -> None:
    """One folder for each shard; the rows of a shard are spread over tasks by their place."""
    docs.repartition("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(spark, read(spark, sf_dir, "documents"))
