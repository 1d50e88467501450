"""Streams over given tables: tables of several files, and results of a bounded run."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_touches import SCHEMA, random_events, sequential
from touchline.streaming import jobs
from touchline.streaming.touch_chain import run_touches
from touchline.workload import ENTRIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def several(spark, tmp_path_factory):
    """Events and documents of the smallest scale as Spark writes them, in five part files each."""
    folder = str(tmp_path_factory.mktemp("several"))
    for name in ("events", "documents"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").repartition(5).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_a_table_of_part_files_is_read_whole(spark, several, folder):
    for i, at in enumerate((several, f"{several}/", FOLDER)):
        out = jobs.run_to_table(jobs.watch_table(spark, at, "events").select("event_id"), f"{folder}/{i}")
        assert out.count() == spark.read.parquet(f"{FOLDER}/events.parquet").count()


@pytest.mark.parametrize("name", ["stream_hourly_activity", "stream_unique_contents"])
def test_queries_on_part_files(spark, several, name):
    rows = lambda at: sorted(map(tuple, ENTRIES[name].run(spark, at).collect()))
    assert rows(several) == rows(FOLDER) != []


def test_latest_counts_over_several_batches(spark, several, folder):
    """A file a batch: events far behind the last window count too, and no window is left out."""
    raw = spark.read.parquet(f"{several}/events.parquet")
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{several}/events.parquet")
    timed = stream.select(F.col("ts").cast("timestamp").alias("created_at"))
    out = jobs.run_to_latest(jobs.hourly_counts(timed, None), ["start", "end"], f"{folder}/run")
    got = sorted((r.start, r.n) for r in out.collect())
    want = raw.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("start")).count().collect()
    assert got == sorted(map(tuple, want))


@pytest.mark.parametrize("name", ["stream_hourly_activity", "stream_sliding_throughput", "stream_counts_by_kind"])
def test_the_last_windows_are_there(spark, name):
    last = duckdb.sql(f"SELECT max(ts) FROM '{FOLDER}/events.parquet'").fetchall()[0][0]
    rows = ENTRIES[f"{name}_whole"].run(spark, FOLDER).collect()
    assert max(dt.datetime.fromisoformat(r.end) for r in rows) > last
    assert {tuple(r) for r in ENTRIES[name].run(spark, FOLDER).collect()} < {tuple(r) for r in rows}


@pytest.mark.parametrize("cuts", [[0, 150], [0, 60, 100, 150], [100, 150, 0, 40, 40, 100]])
def test_touches_do_not_depend_on_batches(spark, folder, cuts):
    """In order, in one piece, and with whole files that come late: every touch, the open ones too."""
    rows = random_events(2, n=150)
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = list(zip(cuts, cuts[1:])) if cuts == sorted(cuts) else list(zip(cuts[::2], cuts[1::2]))
    for i, (low, high) in enumerate(pairs):
        df.filter((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.parquet(f"{folder}/in/{i}")
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        got = run_touches(stream, f"{folder}/run")  # a batch each, the log and the kept rows go on
    want = {t["seq"]: (t["outcome"], t["next"]) for t in sequential(rows)[0]}
    assert sorted((r.seq, (r.outcome, r.next_player)) for r in got.collect()) == sorted(want.items())
    stops = [r[1] for r in rows if r[3] in ("goal", "reset")]
    assert max(want) > max(stops)
