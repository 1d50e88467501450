"""Writing results: publishing, registration, ledgers, shards, logs, CSV."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from touchline.operators.audits import archive_path
from touchline.operators.ledger import latest_per_key


def publish_json(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Replace a published JSON table; rows are range sorted, so a second run writes the same lines (SNK-01)."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def publish_tables(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], root: str) -> int:
    """Publish several tables as one version, and return its number (SNK-01).

    ``tables``: name to (rows, order of the lines). Every table is written under the next number; readers see
    that version when its commit row is written after all of them. A run that stops before that leaves a
    number that the next run writes anew. One writer at a time.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    number = published_version(spark, root) + 1
    for name, (rows, order) in tables.items():
        publish_json(rows, f"{root}/version-{number}/{name}", order)
    spark.range(1).select(F.lit(number).cast("long").alias("version")).write.mode("overwrite").parquet(f"{root}/commits/n={number}")
    return number


def published_version(spark: SparkSession, root: str) -> int:
    """Number of the last published version, 0 before the first."""
    spark.createDataFrame([], "version long").write.mode("ignore").parquet(f"{root}/commits/n=0")
    return spark.read.schema("version long").parquet(f"{root}/commits").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def read_published(spark: SparkSession, root: str, name: str, schema: StructType, version: int | None = None) -> DataFrame:
    """A table of the last published version, or of a given one."""
    number = published_version(spark, root) if version is None else version
    return spark.read.schema(schema).json(f"{root}/version-{number}/{name}")


def new_objects(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Contents that are not registered yet, one row each, with their content address (SNK-02)."""
    fresh = files.join(registry.select("sha256"), "sha256", "left_anti")
    return fresh.groupBy("sha256").agg(F.min("size_bytes").alias("size_bytes")).select(
        "sha256", archive_path(F.col("sha256")).alias("archive_path"), "size_bytes"
    )


def register_objects(files: DataFrame, registry: DataFrame, path: str) -> None:
    """Append new contents to the registry table (SNK-02)."""
    new_objects(files, registry).write.mode("append").parquet(path)


def append_states(rows: DataFrame, path: str) -> None:
    """Append ledger rows; readers take the newest per key, so nothing is rewritten (SNK-03)."""
    rows.write.mode("append").parquet(path)


def read_states(rows: DataFrame, keys: Sequence[str], order: str = "updated_at") -> DataFrame:
    """The current ledger from an appended one (SNK-03)."""
    return latest_per_key(rows, list(keys), order)


def write_shards(examples: DataFrame, path: str) -> None:
    """Feature shards by split; rows are spread over files by replay and frame, so no replay is one file
    of its own (SNK-04)."""
    examples.write.mode("overwrite").partitionBy("split").parquet(path)


def shard_index(examples: DataFrame) -> DataFrame:
    """Rows, replays and players per split (SNK-04). Distinct counts are two-step and so stay spread."""
    return examples.groupBy("split").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_distinct("replay").alias("replays"),
        F.count_distinct("player").alias("players"),
    )


def append_log(rows: DataFrame, path: str) -> None:
    """Append-only event log or generation ledger (SNK-05)."""
    rows.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Player table as CSV with a header and every field quoted (SNK-06)."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True)
