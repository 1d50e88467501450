"""Continuous forms of ingest, activity and throughput."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from touchline.functions.payload import payload_probe
from touchline.functions.scalars import header_probe
from touchline.operators.audits import archive_path
from touchline.session import materialize
from touchline.sources.files import REPLAY_FILES


def watch_replays(spark: SparkSession, root: str) -> DataFrame:
    """Arriving replay files (STR-01). The source remembers what it has seen, so nothing is read twice."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    source = spark.readStream.format("binaryFile").schema(schema)
    return source.option("recursiveFileLookup", True).option("pathGlobFilter", REPLAY_FILES).load(root).select(
        "path", "modificationTime", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content"
    )


def unique_contents(files: DataFrame, *, delay: str | None = None) -> DataFrame:
    """Drop contents seen before (STR-02).

    With ``delay`` the state is bounded by a watermark on the file time; without it the state holds every
    hash, so the registry form (:func:`ingest`) is the default for endless streams.
    """
    if delay is None:
        return files.dropDuplicates(["sha256"])
    return files.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["sha256"])


def probe(files: DataFrame) -> DataFrame:
    """Processing rows of new files: header, payload size, status."""
    fields = header_probe(F.col("content"), F.col("size_bytes"))
    headed = files.select("sha256", "path", "size_bytes", "content", *[c.alias(n) for n, c in fields.items()])
    payload = F.when(F.col("error").isNull(), payload_probe(F.col("content")))
    probed = headed.withColumn("_payload", payload)
    error = F.coalesce("error", "_payload.error")
    return probed.select(
        "sha256",
        "path",
        "size_bytes",
        F.when(error.isNull(), "ok").otherwise("failed").alias("status"),
        "version",
        "total_frames",
        "duration_seconds",
        F.col("_payload.size").alias("decompressed_bytes"),
        error.alias("error"),
    )


_REGISTRY = "sha256 string, archive_path string, size_bytes long, path string"
_PROCESSING = (
    "sha256 string, path string, status string, version long, total_frames long, duration_seconds double, decompressed_bytes long, "
    "error string, updated_at timestamp"
)


def _commit(spark: SparkSession, registry_path: str, number: int) -> None:
    """The row that makes both tables' folders of a batch visible."""
    spark.range(1).select(F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{registry_path}/_commits/n={number}")


def read_ingested(spark: SparkSession, registry_path: str, processing_path: str) -> tuple[DataFrame, DataFrame]:
    """Registered contents and their processing rows, of committed batches only."""

    def rows(path: str, schema: str) -> DataFrame:
        # an empty folder of its own, so that there is something to read before the first batch
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch=-1")
        return spark.read.schema(f"{schema}, batch long").parquet(path)

    commits = f"{registry_path}/_commits"
    spark.createDataFrame([], "batch long").write.mode("ignore").parquet(f"{commits}/n=-1")
    done = spark.read.schema("batch long").parquet(commits).select("batch")
    tables = rows(registry_path, _REGISTRY), rows(processing_path, _PROCESSING)
    return tuple(t.join(done, "batch", "left_semi").drop("batch") for t in tables)


def ingest(files: DataFrame, registry_path: str, processing_path: str, checkpoint: str) -> StreamingQuery:
    """Register new contents and append their processing rows, batch by batch (STR-02, STR-03).

    Every file is probed where it is read, so contents are never shuffled; what is chosen by hash and first
    path afterwards are the small rows of the probe. Both tables are written under the batch's number and
    become visible together by its commit row. A batch that failed anywhere before that is repeated and
    overwrites its own folders, so it leaves the same rows.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        probed = materialize(probe(batch))
        known = read_ingested(spark, registry_path, processing_path)[0].select("sha256")
        chosen = probed.groupBy("sha256").agg(F.min("path").alias("path")).join(known, "sha256", "left_anti")
        # a path is one file, but a stream may bring it twice in a batch
        first = materialize(probed.join(chosen, ["sha256", "path"], "left_semi").dropDuplicates(["sha256"]))
        registered = first.select("sha256", archive_path(F.col("sha256")).alias("archive_path"), "size_bytes", "path")
        registered.write.mode("overwrite").parquet(f"{registry_path}/batch={number}")
        processed = first.drop("size_bytes").withColumn("updated_at", F.current_timestamp())
        processed.write.mode("overwrite").parquet(f"{processing_path}/batch={number}")
        _commit(spark, registry_path, number)

    return (
        files.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def watch_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given Parquet tables as a stream: a single file or a folder of part files."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema)
    files = [unquote(f).split("/") for f in table.inputFiles()]
    if len(files) == 1 and files[0][-1] == f"{name}.parquet" != files[0][-2]:
        # a stream reads folders: the file is picked out of its own
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.parquet(path)


def hourly_counts(events: DataFrame, delay: str | None = "1 hour") -> DataFrame:
    """Events per hour, final once the watermark has passed (STR-04)."""
    return _counts(events, delay, F.window("created_at", "1 hour"))


def sliding_throughput(events: DataFrame, delay: str | None = "5 minutes") -> DataFrame:
    """Events per minute over five minutes, every minute (STR-05)."""
    counted = _counts(events, delay, F.window("created_at", "5 minutes", "1 minute"))
    return counted.withColumn("per_minute", F.col("n") / 5.0)


def counts_by_kind(events: DataFrame, delay: str | None = "60 minutes") -> DataFrame:
    """Events per kind over an hour, every five minutes (STR-06)."""
    return _counts(events, delay, F.window("created_at", "60 minutes", "5 minutes"), "event_type")


def _counts(events: DataFrame, delay: str | None, window, *keys: str) -> DataFrame:
    """Without ``delay`` no event is ever late and the state holds every window."""
    timed = events if delay is None else events.withWatermark("created_at", delay)
    counted = timed.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that is there now into a Parquet table and return it.

    Only what is final is written: windows that end behind the watermark are missing.
    """
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/log")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def run_to_latest(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Run an aggregated stream over all that is there now; every key with its latest row, open windows too.

    Each batch writes the rows it changed to its own folder, which a repeated batch overwrites; the latest
    row of a key is taken when the table is read.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{folder}/log")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    written = stream.sparkSession.read.schema(f"{_ddl(stream)}, batch long").parquet(f"{folder}/out")
    values = F.struct(*[c for c in stream.columns if c not in keys])
    latest = written.groupBy(*keys).agg(F.max_by(values, "batch").alias("_latest"))
    return latest.select(*keys, "_latest.*").select(*stream.columns)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
