"""Sharding by jump consistent hashing: a stable key chooses its shard without a table of the ring.

Adding the shard number n moves only the rows whose new shard is n, an n-th part plus one of all.

Defined results: a null text has no bytes; rows with a null key share the shard of a fixed key; repeated
keys share a shard and get slots of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one (shard, salt) group are numbered by one task; their expected number stays below this.
GROUP_ROWS = 10_000

# Fixed value: the multiplier of the published jump hash.
_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, all keys advanced together until the last one has jumped past the end."""
    key = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(key), np.int64)
    todo, at = np.arange(len(key)), np.zeros(len(key), np.int64)
    while len(todo):
        shard[todo] = at
        key[todo] = key[todo] * _STEP + np.uint64(1)
        draw = (key[todo] >> np.uint64(33)).astype(np.float64) + 1
        at = np.floor((at + 1) * (2147483648.0 / draw)).astype(np.int64)
        inside = at < shards
        todo, at = todo[inside], at[inside]
    return shard


def jump_shard(key: Column, shards: int) -> Column:
    """Column form; the key's hash depends on its value alone. A null key counts as hash 0."""

    @F.pandas_udf("int")
    def shard(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(hashes.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return shard(F.when(key.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(key)))


def shard_rows(rows: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, checksum, shard and gapless slot of every row, and the shard it has with one more.

    Slots are numbered inside salted groups of a bounded expected size; one small row per group carries
    the first slot. Their order is by salt and key.
    """
    total = rows.count()
    salts = max(1, -(-total // (shards * GROUP_ROWS)))
    body = F.coalesce(F.col(text), F.lit(""))
    placed = rows.select(
        F.col(key).alias("key"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc")
    ).select(
        "*",
        jump_shard(F.col("key"), shards).alias("shard"),
        jump_shard(F.col("key"), shards + 1).alias("grown"),
        F.pmod(F.xxhash64("key", "crc", F.lit(7)), F.lit(salts)).alias("salt"),
    )
    counts = placed.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = counts.selectExpr(
        "shard", "salt", "sum(n) OVER (PARTITION BY shard ORDER BY salt) - n AS first"
    )
    numbered = placed.selectExpr("*", "row_number() OVER (PARTITION BY shard, salt ORDER BY key, crc, size) - 1 AS place")
    return numbered.join(before, ["shard", "salt"]).select(
        "key", "size", "crc", "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), "grown"
    )
