"""Streaming jobs, readers and models over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from touchline import adapters
from touchline.functions.payload import payload_probe
from touchline.functions.scalars import holdout_bucket
from touchline.operators import evaluation as E
from touchline.operators import learning as M
from touchline.operators.rows import attach
from touchline.session import shared_folder
from touchline.sources import exports
from touchline.streaming import jobs
from touchline.streaming.touch_chain import run_touches, stream_touches
from touchline.workload.match_events import EVENTS_SQL
from touchline.workload.pitch_positions import POSITIONS_SQL
from touchline.workload.registry import query


def _log_stream(spark, folder):
    return adapters.runtime_event_columns(jobs.watch_table(spark, folder, "events"))


def _stamps(df):
    return [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")]


LOG_SQL = """e AS (SELECT ts, CASE event_type WHEN 'click' THEN 'replay_archived' WHEN 'view' THEN 'replay_duplicate' WHEN 'error' THEN 'replay_failed'
  WHEN 'signup' THEN 'replay_disappeared' ELSE 'replay_analyzed' END AS event_type FROM events)"""


@query(
    "stream_hourly_activity", "STR-04",
    f"""WITH {LOG_SQL}, w AS (SELECT date_trunc('hour', ts) AS s, count(*) AS n FROM e GROUP BY 1)
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS "start", strftime(s + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", n FROM w
    WHERE s + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM e) - INTERVAL 1 HOUR""",
)
def stream_hourly_activity(spark, folder):
    out = jobs.run_to_table(jobs.hourly_counts(_log_stream(spark, folder)), shared_folder(spark, "hourly"))
    return out.select(*_stamps(out), "n")


@query(
    "stream_sliding_throughput", "STR-05",
    f"""WITH {LOG_SQL}, w AS (SELECT date_trunc('minute', ts) - to_minutes(CAST(i AS INTEGER)) AS s, count(*) AS n FROM e CROSS JOIN range(5) r(i) GROUP BY 1)
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS "start", strftime(s + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", n, n / 5.0 AS per_minute FROM w
    WHERE s + INTERVAL 5 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) FROM e) - INTERVAL 5 MINUTE""",
)
def stream_sliding_throughput(spark, folder):
    out = jobs.run_to_table(jobs.sliding_throughput(_log_stream(spark, folder)), shared_folder(spark, "sliding"))
    return out.select(*_stamps(out), "n", "per_minute")


@query(
    "stream_counts_by_kind", "STR-06",
    f"""WITH {LOG_SQL}, w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(CAST(i * 5 AS INTEGER)) AS s, event_type, count(*) AS n FROM e CROSS JOIN range(12) r(i) GROUP BY 1, 2)
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS "start", strftime(s + INTERVAL 60 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", event_type, n FROM w
    WHERE s + INTERVAL 60 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) FROM e) - INTERVAL 60 MINUTE""",
)
def stream_counts_by_kind(spark, folder):
    out = jobs.run_to_table(jobs.counts_by_kind(_log_stream(spark, folder)), shared_folder(spark, "kinds"))
    return out.select(*_stamps(out), "event_type", "n")


# The three queries above write what is final; these write every window of the given tables.


@query(
    "stream_hourly_activity_whole", "STR-04",
    f"""WITH {LOG_SQL}, w AS (SELECT date_trunc('hour', ts) AS s, count(*) AS n FROM e GROUP BY 1)
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS "start", strftime(s + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", n FROM w""",
)
def stream_hourly_activity_whole(spark, folder):
    counts = jobs.hourly_counts(_log_stream(spark, folder), None)
    out = jobs.run_to_latest(counts, ["start", "end"], shared_folder(spark, "hourly"))
    return out.select(*_stamps(out), "n")


@query(
    "stream_sliding_throughput_whole", "STR-05",
    f"""WITH {LOG_SQL}, w AS (SELECT date_trunc('minute', ts) - to_minutes(CAST(i AS INTEGER)) AS s, count(*) AS n FROM e CROSS JOIN range(5) r(i) GROUP BY 1)
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS "start", strftime(s + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", n, n / 5.0 AS per_minute FROM w""",
)
def stream_sliding_throughput_whole(spark, folder):
    counts = jobs.sliding_throughput(_log_stream(spark, folder), None)
    out = jobs.run_to_latest(counts, ["start", "end"], shared_folder(spark, "sliding"))
    return out.select(*_stamps(out), "n", "per_minute")


@query(
    "stream_counts_by_kind_whole", "STR-06",
    f"""WITH {LOG_SQL}, w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(CAST(i * 5 AS INTEGER)) AS s, event_type, count(*) AS n FROM e CROSS JOIN range(12) r(i) GROUP BY 1, 2)
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS "start", strftime(s + INTERVAL 60 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", event_type, n FROM w""",
)
def stream_counts_by_kind_whole(spark, folder):
    counts = jobs.counts_by_kind(_log_stream(spark, folder), None)
    out = jobs.run_to_latest(counts, ["start", "end", "event_type"], shared_folder(spark, "kinds"))
    return out.select(*_stamps(out), "event_type", "n")


@query(
    "stream_touch_transitions", "STR-07",
    f"""WITH {EVENTS_SQL}, last AS (SELECT replay, max(seq) FILTER (kind IN ('goal', 'reset')) AS stop FROM seg GROUP BY replay)
    SELECT replay, seq, player, outcome, next_player, round(progression, 4) AS progression FROM touches JOIN last USING (replay)
    WHERE next_player IS NOT NULL OR seq < stop""",
)
def stream_touch_transitions(spark, folder):
    events = adapters.event_columns(jobs.watch_table(spark, folder, "events"))
    out = jobs.run_to_table(stream_touches(events), shared_folder(spark, "touches"))
    return out.filter(F.col("late") == 0).select(
        "replay", "seq", "player", "outcome", "next_player", F.round("progression", 4).alias("progression")
    )


@query(
    "stream_touch_transitions_whole", "STR-07",
    f"""WITH {EVENTS_SQL} SELECT replay, seq, player, outcome, next_player, round(progression, 4) AS progression FROM touches""",
)
def stream_touch_transitions_whole(spark, folder):
    out = run_touches(adapters.event_columns(jobs.watch_table(spark, folder, "events")), shared_folder(spark, "touches"))
    return out.select("replay", "seq", "player", "outcome", "next_player", F.round("progression", 4).alias("progression"))


@query(
    "stream_unique_contents", "STR-02",
    "SELECT sha256(text) AS sha256 FROM documents GROUP BY 1",
)
def stream_unique_contents(spark, folder):
    documents = jobs.watch_table(spark, folder, "documents").select(F.sha2("text", 256).alias("sha256"))
    return jobs.run_to_table(jobs.unique_contents(documents), shared_folder(spark, "unique"))


@query(
    "temporal_feature_stack", "WIN-09",
    f"""WITH {POSITIONS_SQL}, w AS (SELECT replay, player, frame, x, y, lag(x) OVER o AS x1, lag(y) OVER o AS y1, lag(x, 2) OVER o AS x2, lag(y, 2) OVER o AS y2 FROM st
      WINDOW o AS (PARTITION BY replay, player ORDER BY frame))
    SELECT replay, player, frame, round(coalesce(x2, x1, x), 6) AS f0, round(coalesce(y2, y1, y), 6) AS f1, round(coalesce(x1, x), 6) AS f2, round(coalesce(y1, y), 6) AS f3,
      round(x, 6) AS f4, round(y, 6) AS f5 FROM w""",
)
def temporal_feature_stack(spark, folder):
    rows = M.temporal_features(adapters.states(spark, folder), ["x", "y"], window=3)
    return rows.select("replay", "player", "frame", *[F.round(F.col("temporal_features")[i], 6).alias(f"f{i}") for i in range(6)])


@query("imitation_models", "ML-02 ML-03 AGG-19")
def imitation_models(spark, folder):
    samples = adapters.vector_samples(spark, folder)
    held = holdout_bucket(F.sha2(F.col("sample_id").cast("string"), 256), 5) == 0
    models = M.train(samples.filter(~held), "features", width=64)
    scored = M.score(models, samples.filter(held), "features")
    return E.evaluate(scored.withColumn("kick", F.col("kick").cast("double")))


@query(
    "imitation_basis", "ML-02 ML-03 AGG-18 AGG-19",
    """WITH s AS (SELECT label % 9 AS d, vec_id % 30 = 0 AS k, embedding AS e,
      CAST('0x' || substr(sha256('holdout-v1:' || sha256(CAST(vec_id AS VARCHAR))), 1, 16) AS UBIGINT) % 5 = 0 AS held FROM embeddings),
    m AS (SELECT i - 1 AS position, avg(v) AS mean, sqrt(greatest(var_pop(v), 1e-8)) AS std
      FROM (SELECT unnest(range(1, len(e) + 1)) AS i, CAST(unnest(e) AS DOUBLE) AS v FROM s WHERE NOT held) GROUP BY i),
    h AS (SELECT count(*) AS samples, count(*) FILTER (k) AS kick_positive, count(*) FILTER (NOT k) AS kick_negative,
      (SELECT max(n) FROM (SELECT count(*) AS n FROM s WHERE held GROUP BY d)) / count(*) AS majority FROM s WHERE held)
    SELECT position, round(mean, 6) AS mean, round(CASE WHEN std < 1e-4 THEN 1 ELSE std END, 6) AS std, samples, kick_positive, kick_negative, round(majority, 6) AS majority_direction_accuracy FROM m CROSS JOIN h""",
)
def imitation_basis(spark, folder):
    """What a trained model has apart from its weights: the scaling of each feature, and the held-out rows that it was scored on."""
    samples = adapters.vector_samples(spark, folder)
    held = holdout_bucket(F.sha2(F.col("sample_id").cast("string"), 256), 5) == 0
    models = M.train(samples.filter(~held), "features", width=64, epochs=1)
    scored = M.score(models, samples.filter(held), "features").withColumn("kick", F.col("kick").cast("double"))
    scaling = spark.createDataFrame(list(zip(range(len(models.mean)), models.mean, models.std, strict=True)), "position long, mean double, std double")
    basis = E.evaluate(scored).select(
        "samples", (F.col("tp") + F.col("fn")).alias("kick_positive"), (F.col("fp") + F.col("tn")).alias("kick_negative"),
        F.round("majority_direction_accuracy", 6).alias("majority_direction_accuracy"),
    )
    return attach(scaling.select("position", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")), basis)


@query("scored_samples", "ML-03")
def scored_samples(spark, folder):
    samples = adapters.vector_samples(spark, folder)
    models = M.train(samples, "features", width=64, epochs=15)
    scored = M.score(models, samples, "features", ball_distance=(F.col("sample_id") % 40).cast("double"))
    return scored.select(
        "sample_id", "direction_predicted", F.round("direction_confidence", 4).alias("direction_confidence"),
        F.round("kick_probability", 4).alias("kick_probability"), F.col("kick_predicted").cast("int").alias("kick_predicted"),
    )


# Weights by rule: 64 inputs, 16 hidden units, nine directions, one kick.
NETWORK_SQL = """
s AS (SELECT vec_id AS sample_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
h AS (SELECT sample_id, list_transform(range(16), lambda j: greatest(0.0::DOUBLE, list_sum(list_transform(range(64), lambda i: x[i + 1] * ((i * 7 + j * 13) % 17 - 8) / 4.0::DOUBLE))
  + (j % 5 - 2) / 10.0::DOUBLE)) AS h FROM s),
o AS (SELECT sample_id, list_transform(range(9), lambda d: list_sum(list_transform(range(16), lambda j: h[j + 1] * ((j * 5 + d * 3) % 11 - 5) / 10.0::DOUBLE)) + d / 100.0::DOUBLE) AS z,
  list_sum(list_transform(range(16), lambda j: h[j + 1] * ((j * 3) % 7 - 3) / 10.0::DOUBLE)) - 1 AS k FROM h)
"""


def _network():
    i, j, d = np.arange(64)[:, None], np.arange(16), np.arange(9)
    hidden = (((i * 7 + j * 13) % 17 - 8) / 4.0, (j % 5 - 2) / 10.0)
    return M.Network((hidden,), (((j[:, None] * 5 + d * 3) % 11 - 5) / 10.0, d / 100.0), ((((j * 3) % 7 - 3) / 10.0)[:, None], np.array([-1.0])))


@query(
    "network_scores", "ML-03",
    f"""WITH {NETWORK_SQL} SELECT sample_id, list_position(z, list_max(z)) - 1 AS direction_predicted,
      round(1 / list_sum(list_transform(z, lambda v: exp(v - list_max(z)))), 4) AS direction_confidence, round(1 / (1 + exp(-k)), 4) AS kick_probability,
      CAST(1 / (1 + exp(-k)) >= 0.5 AND sample_id % 40 <= 31 AS INTEGER) AS kick_predicted FROM o""",
)
def network_scores(spark, folder):
    samples = adapters.vector_samples(spark, folder)
    scored = M.score_with(_network(), samples, "features", ball_distance=(F.col("sample_id") % 40).cast("double"))
    return scored.select(
        "sample_id", "direction_predicted", F.round("direction_confidence", 4).alias("direction_confidence"),
        F.round("kick_probability", 4).alias("kick_probability"), F.col("kick_predicted").cast("int").alias("kick_predicted"),
    )


# Headers as in `replay_header_probe`; those of whole length are followed by one empty last block, except every fifth.
INGEST_SQL = """
c AS (
  SELECT o_orderkey AS k, o_orderkey % 19 = 2 AS short, CASE WHEN o_orderkey % 11 = 3 THEN '41424344' ELSE '48425232' END || printf('%08X', CASE WHEN o_orderkey % 13 = 5 THEN 2 ELSE 3 END)
    || printf('%08X', CASE WHEN o_orderkey % 17 = 7 THEN 0 ELSE o_orderkey * 37 % 100000 END) AS whole, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '010000FFFF' END AS body FROM orders
),
f AS (SELECT *, sha256(unhex(CASE WHEN short THEN substr(whole, 1, 14) ELSE whole || body END)) AS sha256 FROM c),
g AS (SELECT *, CASE WHEN short THEN 'truncated_header' WHEN k % 11 = 3 THEN 'invalid_magic' WHEN k % 13 = 5 THEN 'unsupported_version:2'
    WHEN k % 17 = 7 OR k * 37 % 100000 = 0 THEN 'invalid_total_frames' WHEN body = '' THEN 'deflate_error:incomplete_stream' END AS error FROM f)
"""


@query(
    "incremental_ingest", "STR-01 STR-03 STR-02",
    f"""WITH {INGEST_SQL} SELECT DISTINCT sha256, CASE WHEN error IS NULL THEN 'ok' ELSE 'failed' END AS status, error, CASE WHEN NOT short THEN CASE WHEN k % 17 = 7 THEN 0 ELSE k * 37 % 100000 END END AS total_frames,
      CASE WHEN error IS NULL THEN 0 END AS decompressed_bytes, substr(sha256, 1, 2) || '/' || substr(sha256, 3, 2) || '/' || sha256 || '.hbr2' AS archive_path FROM g""",
)
def incremental_ingest(spark, folder):
    key = F.col("file_id")
    whole = F.when((F.col("length") < 12) | (key % 5 == 0), F.col("content")).otherwise(F.concat("content", F.unhex(F.lit("010000FFFF"))))
    contents = adapters.replay_contents(spark, folder).select(key, whole.alias("content"))
    # every seventh file lies in a second folder too
    copies = F.when(key % 7 == 0, F.array(F.lit("in"), F.lit("copy"))).otherwise(F.array(F.lit("in")))
    arrived = contents.withColumn("_at", F.explode(copies)).select(
        F.concat_ws("/", "_at", key.cast("string")).alias("path"), F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content"
    )
    root = shared_folder(spark, "ingest")
    arrived.repartition(8, "path").write.parquet(f"{root}/arrived")
    stream = spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", 3).parquet(f"{root}/arrived")
    jobs.ingest(stream, f"{root}/registry", f"{root}/processing", f"{root}/log").awaitTermination()
    registry, processing = jobs.read_ingested(spark, f"{root}/registry", f"{root}/processing")
    return processing.join(registry, "sha256").select("sha256", "status", "error", "total_frames", "decompressed_bytes", "archive_path")


@query(
    "export_messages", "SRC-02",
    """SELECT 'c' || conv_id AS channel_id, conv_id || '-' || turn AS message_id, text AS content FROM conversations WHERE text <> ''""",
)
def export_messages(spark, folder):
    turns = adapters.table(spark, folder, "conversations")
    # Each turn becomes a small export document, nested differently by turn.
    message = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("content"))
    channel = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    flat = F.to_json(F.struct(F.struct(channel.alias("id")).alias("channel"), F.array(message).alias("messages")))
    deep = F.to_json(
        F.struct(channel.alias("channelId"), F.array(F.struct(F.array(message).alias("messages"))).alias("threads"))
    )
    files = turns.select(
        F.concat_ws("/", "conv_id", "turn").alias("path"),
        F.when(F.col("turn") % 2 == 0, flat).otherwise(deep).cast("binary").alias("content"),
    )
    return exports.message_columns(exports.read_messages(files)).select("channel_id", "message_id", "content").filter("content <> ''")


@query(
    "payload_probe", "PRJ-02",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'deflate_error:incomplete_stream' WHEN doc_id % 3 = 1 THEN 'deflate_trailing_data' END AS error, CASE WHEN doc_id % 3 = 2 THEN strlen(text) END AS size FROM documents",
)
def payload_sizes(spark, folder):
    # Stored (uncompressed) DEFLATE blocks: a last-block marker, two lengths and up to 65535 bytes each.
    body, most = F.col("text").cast("binary"), 65535
    little = lambda n: F.concat(F.lpad(F.hex(n % 256), 2, "0"), F.lpad(F.hex(F.floor(n / 256)), 2, "0"))
    last = F.greatest(F.ceil(F.octet_length("text") / most) - 1, F.lit(0)).cast("int")

    def block(i):
        part = F.substring(body, i * most + 1, F.lit(most))
        size = F.octet_length(part)
        return F.concat(F.when(i == last, "01").otherwise("00"), little(size), little(most - size), F.hex(part))

    blocks = F.array_join(F.transform(F.sequence(F.lit(0), last), block), "")
    cut = F.when(F.col("doc_id") % 3 == 0, F.substring(blocks, 1, 6)).when(
        F.col("doc_id") % 3 == 1, F.concat(blocks, F.lit("00"))
    ).otherwise(blocks)
    head = F.concat(F.hex(F.lit("HBR2")), F.lit("0000000300000258"))
    rows = adapters.table(spark, folder, "documents").select("doc_id", F.unhex(F.concat(head, cut)).alias("content"))
    probed = rows.withColumn("_p", payload_probe(F.col("content")))
    return probed.select("doc_id", F.col("_p.error").alias("error"), F.col("_p.size").alias("size"))
