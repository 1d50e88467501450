"""Readers, sinks and streaming ingest on small files."""

import gzip
import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions.payload import SHARD_COLUMNS, payload_probe
from touchline.operators import audits as A
from touchline.operators import ingest as I
from touchline.operators import players as P
from touchline.sources import artifacts, exports, files, sinks
from touchline.streaming import jobs


def replay_bytes(frames=600, payload=b"x" * 5000, magic=b"HBR2", version=3):
    packer = zlib.compressobj(9, zlib.DEFLATED, -zlib.MAX_WBITS)
    return struct.pack(">4sII", magic, version, frames) + packer.compress(payload) + packer.flush()


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as handle:
        handle.write(data if isinstance(data, bytes) else data.encode())


def test_discovery_and_duplicates(spark, folder):
    put(f"{folder}/a/one.hbr2", replay_bytes())
    put(f"{folder}/b/Two.HBR2", replay_bytes())
    put(f"{folder}/b/three.hbr2", replay_bytes(frames=60))
    put(f"{folder}/b/notes.txt", b"no")
    found = files.discover_replays(spark, folder)
    assert found.count() == 3
    groups = I.content_groups(found)
    copies = {os.path.basename(r.path): r.copies for r in groups.collect()}
    assert copies == {"one.hbr2": 2, "three.hbr2": 1}
    assert [os.path.basename(r.path) for r in I.duplicate_paths(found, groups).collect()] == ["Two.HBR2"]


@pytest.mark.parametrize(
    "data,error,size",
    [
        (replay_bytes(), None, 5000),
        (replay_bytes()[:-3], "deflate_error:incomplete_stream", None),
        (replay_bytes() + b"zz", "deflate_trailing_data", None),
        (replay_bytes(payload=b"y" * 3_000_000), None, 3_000_000),
    ],
)
def test_payload_probe(spark, data, error, size):
    row = spark.createDataFrame([(bytearray(data),)], "content binary").select(payload_probe(F.col("content")).alias("p")).first()
    assert (row.p.error, row.p.size) == (error, size)


def test_exports_of_any_nesting(spark, folder):
    report = "**MATCH REPORT SCRIM #20260924T221227749-R2**\n**Red Team** 3 - 2 Blue Team\nPossession: 52.34% | 47.66%"
    flat = {
        "channel": {"id": 7},
        "messages": [
            {"id": "m1", "timestamp": "2026-09-24T22:12:27+02:00", "content": report,
             "attachments": [{"fileName": "a.hbr2", "fileSizeBytes": 0}, {"fileName": "b.hbr2", "size": "4"}, {"fileName": 5}]},
            {"id": "m2", "content": "hello"},
        ],
    }
    deep = {"dump": [{"channelId": 9, "threads": {"x": {"messages": [{"messageId": 33, "content": None, "attachments": [{"name": "C.HBR2"}]}]}}}]}
    put(f"{folder}/flat.json", b"\xef\xbb\xbf" + json.dumps(flat).encode())
    put(f"{folder}/sub/deep.json", json.dumps(deep))
    put(f"{folder}/broken.json", '{"messages": [')
    reports, failures = exports.read_reports(spark, folder)
    got = {r.message_id: r for r in reports.collect()}
    assert set(got) == {"m1", "33"}
    first = got["m1"]
    assert (first.channel_id, first.report_id, first.red_score, first.blue_score) == ("7", "20260924T221227749-R2", 3, 2)
    assert (first.possession_red, first.possession_blue) == (52.34, 47.66)
    assert [(a.file_name, a.size_bytes) for a in first.attachments] == [("a.hbr2", 0)]
    assert got["33"].channel_id == "9" and got["33"].report_id is None
    assert [os.path.basename(r.source) for r in failures.collect()] == ["broken.json"]


def artifact(name, near, close, kicks, **extra):
    player = {"id": 3, "name": name, "teamId": 1, "samples": 600, "averageX": 1.0, "nearestBallSamples": near, "closeBallSamples": close, "kickEvents": kicks}
    sparse = {"touchColumns": ["frame", "playerId", "ballX"], "touches": [[5, 3, 1.5], [9, 4, None]]}
    return {"schemaVersion": 4, "totalFrames": 3600, "simulation": {"sampleEveryTicks": 6}, "players": [player], "sparseEvents": sparse, **extra}


def test_artifacts_to_player_totals(spark, folder):
    put(f"{folder}/m1.json", json.dumps(artifact(" Alice ", 120, 60, 12)))
    put(f"{folder}/m2.json", json.dumps(artifact("alice", 180, 90, 18)))
    put(f"{folder}/m3.json", json.dumps(artifact("alice", 700, 90, 18)))
    put(f"{folder}/m4.json", json.dumps({**artifact("alice", 1, 1, 1), "schemaVersion": 2}))
    put(f"{folder}/_index.json", json.dumps(artifact("alice", 1, 1, 1)))
    put(f"{folder}/m5.json", "{broken")
    read = artifacts.read_artifacts(spark, folder)
    assert sorted(r.match_id for r in read.select("match_id").collect()) == ["m1", "m2", "m3"]
    rows = artifacts.player_rows(P.valid_artifacts(artifacts.with_player_columns(read)))
    row = P.career_rates(P.career_totals(rows)).first()
    assert (row.matches, row.active_minutes, row.kick_events) == (2, 2.0, 30)
    assert (row.nearest_ball_pct, row.close_ball_pct, row.player_id) == (25.0, 12.5, "name:alice")
    events = artifacts.sparse_events(read.filter("match_id = 'm1'"), "touches").orderBy("seq").collect()
    assert [(e.frame, e.playerId, e.ballX, e.outcome) for e in events] == [(5, 3, 1.5, None), (9, 4, None, None)]


FAULTS = {
    "null counter": ('"kickEvents": 12', '"kickEvents": null'),
    "true as counter": ('"kickEvents": 12', '"kickEvents": true'),
    "text as counter": ('"kickEvents": 12', '"kickEvents": "12"'),
    "fraction as counter": ('"kickEvents": 12', '"kickEvents": 12.0'),
    "number as name": ('"name": "bob"', '"name": 5'),
    "null player": ('"players": [', '"players": [null, '),
    "number as player": ('"players": [', '"players": [3, '),
    "players of another type": ('"players": [', '"players": {"a": ['),
    "true as version": ('"schemaVersion": 4', '"schemaVersion": true'),
    "text in sparse rows": ("[5, 3, 1.5]", '[5, "3", 1.5]'),
    "array as root": ('{"schemaVersion"', '[{"schemaVersion"'),
}


@pytest.mark.parametrize("columns", [["match_id"], ["match_id", "totalFrames"], ["match_id", "players", "sparseEvents"]])
def test_a_wrong_type_drops_the_document_whatever_is_asked_for(spark, columns):
    whole = json.dumps(artifact("bob", 1, 1, 12))
    texts = [("good", whole), ("null name", whole.replace('"bob"', "null")), ("no players", whole.replace('"players"', '"others"'))]
    for name, (old, new) in FAULTS.items():
        text = whole.replace(old, new)
        assert text != whole
        texts.append((name, text + {"[{": "]", '{"a': "}"}.get(new[:2], "") if name != "players of another type" else text.replace("}], ", "}]}, ")))
    read = artifacts.parsed_artifacts(spark.createDataFrame([*texts, (None, None), ("empty", "")], "match_id string, text string"))
    assert sorted(r.match_id for r in read.select(*columns).collect()) == ["good", "no players", "null name"]


def test_shards(spark, folder):
    width = len(SHARD_COLUMNS)
    assert width == 39
    table = np.arange(3 * width, dtype="<f4").reshape(3, width)
    put(f"{folder}/a.f32.gz", gzip.compress(table.tobytes()))
    put(f"{folder}/b.f32.gz", gzip.compress(table.tobytes()[:-4]))
    put(f"{folder}/c.f32.gz", b"nonsense")
    rows = files.read_shards(spark, folder).collect()
    good = sorted((r.frame, r.kick) for r in rows if r.error is None)
    assert good == [(0.0, 38.0), (39.0, 77.0), (78.0, 116.0)]
    assert sorted(r.error.split(":")[0] for r in rows if r.error) == ["gzip", "row_width"]


def test_publish_twice_gives_same_lines(spark, folder):
    df = spark.range(50).select((F.col("id") * 7 % 50).alias("id"), F.lit("x").alias("v"))

    def lines():
        sinks.publish_json(df, f"{folder}/out", ["id"])
        return [r.value for r in spark.read.text(f"{folder}/out").collect()]

    assert sorted(lines()) == sorted(lines()) and len(lines()) == 50


def test_ledger_append_and_csv(spark, folder):
    early = spark.createDataFrame([("a", "pending", 1), ("b", "ok", 1)], "sha256 string, status string, updated_at int")
    late = spark.createDataFrame([("a", "ok", 2)], early.schema)
    sinks.append_states(early, f"{folder}/ledger")
    sinks.append_states(late, f"{folder}/ledger")
    now = sinks.read_states(spark.read.parquet(f"{folder}/ledger"), ["sha256"])
    assert {r.sha256: r.status for r in now.collect()} == {"a": "ok", "b": "ok"}
    sinks.write_csv(now.orderBy("sha256").coalesce(1), f"{folder}/csv")
    text = [r.value for r in spark.read.text(f"{folder}/csv").collect()]
    assert text[0] == '"sha256","status","updated_at"' and '"a","ok","2"' in text


def test_shard_sink_and_index(spark, folder):
    rows = spark.createDataFrame([("r1", 1, "train"), ("r1", 2, "train"), ("r2", 1, "holdout")], "replay string, player int, split string")
    sinks.write_shards(rows, f"{folder}/shards")
    back = spark.read.parquet(f"{folder}/shards")
    assert {r.split: (r.samples, r.replays) for r in sinks.shard_index(back).collect()} == {"train": (2, 1), "holdout": (1, 1)}


def test_archive_audit_on_files(spark, folder):
    data = replay_bytes()
    put(f"{folder}/raw/x.hbr2", data)
    sha = files.discover_replays(spark, f"{folder}/raw").first().sha256
    stored = f"{sha[:2]}/{sha[2:4]}/{sha}.hbr2"
    put(f"{folder}/archive/{stored}", data)
    registry = spark.createDataFrame([(sha, stored, len(data)), ("0" * 64, f"00/00/{'0' * 64}.hbr2", 4)], "sha256 string, archive_path string, size_bytes long")
    found = A.audit_archive(registry, files.archived_objects(spark, f"{folder}/archive")).collect()
    assert [(r.subject[0], r.check) for r in found] == [("0", "archive_missing")]


def test_streaming_ingest_is_incremental(spark, folder):
    put(f"{folder}/in/a.hbr2", replay_bytes())
    put(f"{folder}/in/copy.hbr2", replay_bytes())
    put(f"{folder}/in/bad.hbr2", b"HBR2")

    def run():
        query = jobs.ingest(jobs.watch_replays(spark, f"{folder}/in"), f"{folder}/registry", f"{folder}/processing", f"{folder}/log")
        query.awaitTermination()
        return jobs.read_ingested(spark, f"{folder}/registry", f"{folder}/processing")[1]

    first = run()
    assert {r.status: r["count"] for r in first.groupBy("status").count().collect()} == {"ok": 1, "failed": 1}
    assert first.filter("status = 'failed'").first().error == "truncated_header"
    assert run().count() == 2
    put(f"{folder}/in/again.hbr2", replay_bytes())
    put(f"{folder}/in/new.hbr2", replay_bytes(frames=1200))
    assert run().filter("status = 'ok'").count() == 2
    assert jobs.read_ingested(spark, f"{folder}/registry", f"{folder}/processing")[0].count() == 3


def test_a_batch_stopped_between_its_writes_is_repeated(spark, folder, monkeypatch):
    put(f"{folder}/in/a.hbr2", replay_bytes())
    put(f"{folder}/in/copy.hbr2", replay_bytes())
    put(f"{folder}/in/b.hbr2", replay_bytes(frames=1200))

    def run():
        jobs.ingest(jobs.watch_replays(spark, f"{folder}/in"), f"{folder}/registry", f"{folder}/processing", f"{folder}/log").awaitTermination()

    def stop(*_):
        raise RuntimeError("stopped before the commit")

    rows = lambda: [sorted(r["sha256"] for r in t.collect()) for t in jobs.read_ingested(spark, f"{folder}/registry", f"{folder}/processing")]
    with monkeypatch.context() as patch:
        patch.setattr(jobs, "_commit", stop)
        with pytest.raises(Exception, match="stopped before the commit"):
            run()
    assert rows() == [[], []]
    run()
    registry, processing = rows()
    assert registry == processing and len(set(registry)) == len(registry) == 2
