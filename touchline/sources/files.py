"""Replay files and archived objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.payload import decode_shards


#: Names of replay files and of feature shards; other files below a folder are never opened.
REPLAY_FILES, SHARD_FILES = "*.[hH][bB][rR]2", "*.f32.gz"


def read_binary(spark: SparkSession, root: str, names: str = "*") -> DataFrame:
    """Every file below ``root`` whose name fits the pattern, with its content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)


def discover_replays(spark: SparkSession, root: str, *, content: bool = False) -> DataFrame:
    """Replay files below a folder with size and SHA-256 (SRC-01)."""
    found = read_binary(spark, root, REPLAY_FILES)
    kept = [F.col("content")] if content else []
    return found.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
        "modificationTime",
        *kept,
    )


def archived_objects(spark: SparkSession, root: str) -> DataFrame:
    """Stored objects with their recomputed hash, keyed by the path below ``root``."""
    prefix = F.lit(root.rstrip("/") + "/")
    return read_binary(spark, root).select(
        F.element_at(F.split("path", prefix), -1).alias("archive_path"),
        "length",
        F.sha2("content", 256).alias("content_sha256"),
    )


def read_shards(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the feature shards below a folder (SRC-05)."""
    return decode_shards(read_binary(spark, root, SHARD_FILES))


def read_ledger(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The appended ledger tables of a folder (SRC-06)."""
    names = ("source_files", "raw_replays", "replay_processing", "replay_analysis_versions", "runtime_events")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
