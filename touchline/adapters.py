"""The given tables read as match-analytics tables.

Each adapter is one DataFrame expression over whole tables, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.scalars import REPLAY_MAGIC


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Match events: one replay per day, ordered by the event id."""
    return event_columns(table(spark, folder, "events"))


def event_columns(raw: DataFrame) -> DataFrame:
    """Match events from rows of the event table, at rest or arriving."""
    k = F.get_json_object("props", "$.k").cast("int")
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    player = F.col("user_id") % 9
    kind = (
        F.when(F.col("event_type").isin("click", "view", "signup"), "contact")
        .when(F.col("event_type") == "purchase", "kick")
        .when(k < 25, "goal")
        .when(k >= 90, "reset")
        .otherwise("input")
    )
    return raw.select(
        F.date_format("ts", "yyyy-MM-dd").alias("replay"),
        F.col("event_id").alias("seq"),
        F.floor(seconds / 30).cast("int").alias("frame"),
        kind.alias("kind"),
        player.alias("player"),
        F.when(player == 8, 0).otherwise(player % 2 + 1).cast("int").alias("team"),
        F.round(F.col("value") - 245, 2).alias("ball_x"),
        (k - 50).cast("double").alias("ball_y"),
        F.when(k < 90, k.cast("double")).alias("pressure_distance"),
        F.when(kind == "goal", F.col("event_id") % 2 + 1).cast("int").alias("goal_team"),
        (k % 3 - 1).alias("dir_x"),
        (F.floor(k / 3) % 3 - 1).cast("int").alias("dir_y"),
    )


def _count_if(condition: Column, value: Column | str = "l_linenumber") -> Column:
    return F.sum(F.when(condition, F.col(value) if isinstance(value, str) else value).otherwise(0)).cast("long")


def player_match(spark: SparkSession, folder: str) -> DataFrame:
    """One row per match, team and player with the counters of an analysed replay.

    Most rows are alone in their group, so the lines move as they are, fewer bytes than their sums.
    """
    li = table(spark, folder, "lineitem").withColumn("match_id", F.floor(F.col("l_orderkey") / 8)).repartition("match_id")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    rows = li.groupBy(
        "match_id",
        (F.col("l_suppkey") % 2 + 1).cast("int").alias("team"),
        F.col("l_suppkey").alias("player"),
    ).agg(
        F.sum(F.col("l_quantity") * 20).cast("long").alias("samples"),
        F.round(F.avg(F.floor(F.col("l_extendedprice") / 100)) - 200, 6).alias("average_x"),
        _count_if(flag == "A", F.col("l_quantity") * 10).alias("nearest_ball_samples"),
        _count_if(status == "F", F.col("l_quantity") * 5).alias("close_ball_samples"),
        F.sum(F.col("l_linenumber") * 3).cast("long").alias("input_events"),
        F.sum("l_linenumber").cast("long").alias("kick_events"),
        _count_if(F.col("l_tax") > 0.04).alias("kick_pressed_inputs"),
        F.sum(F.col("l_linenumber") * 2).cast("long").alias("touches"),
        _count_if(flag == "R").alias("self_retouches"),
        _count_if(flag == "A").alias("team_touch_transfers_out"),
        _count_if(flag == "N").alias("turnovers"),
        _count_if(status == "O").alias("recoveries"),
        _count_if(F.col("l_discount") > 0.045).alias("pressured_transitions"),
        _count_if((F.col("l_discount") > 0.045) & (flag != "N")).alias("retained_under_pressure"),
        F.sum("l_linenumber").cast("long").alias("touch_progression_events"),
        (F.sum(F.floor(F.col("l_extendedprice") / 100) % 97 - 40) / 4).alias("touch_progression_sum"),
        _count_if(F.col("l_tax") > 0.075, F.lit(1)).alias("touch_goals"),
        _count_if((F.col("l_tax") > 0.065) & (F.col("l_tax") < 0.075), F.lit(1)).alias("touch_assists"),
    )
    match, player = F.col("match_id"), F.col("player")
    return rows.withColumns(
        {
            "schema_version": F.when(match % 5 == 0, 3).otherwise(4),
            "total_frames": (match % 10) * 1200 + 1200,
            "sample_every_ticks": F.lit(6),
            "auth_hash": F.when(player % 4 == 0, F.concat(F.lit("a"), player.cast("string"))),
            "name": F.when(match % 3 == 0, F.concat(F.lit("  player   "), player.cast("string"), F.lit(" "))).otherwise(
                F.concat(F.lit("Player "), player.cast("string"))
            ),
            # the older counters of version 3 replays
            "inferred_retained_chains": F.col("self_retouches"),
            "inferred_lost_chains": F.col("turnovers"),
            "inferred_recoveries": F.col("recoveries"),
            "inferred_goals": F.col("touch_goals"),
            "inferred_assists": F.col("touch_assists"),
            "progression_events": F.col("touch_progression_events"),
            "progression_sum": F.col("touch_progression_sum"),
        }
    )


def states(spark: SparkSession, folder: str) -> DataFrame:
    """Sampled positions: one row per replay, frame and player; every tenth player watches."""
    li = table(spark, folder, "lineitem")
    player = F.col("l_suppkey")
    return li.groupBy(
        F.floor(F.col("l_orderkey") / 8).alias("replay"),
        ((F.col("l_linenumber") % 3) * 6).cast("int").alias("frame"),
        player.alias("player"),
        F.when(player % 10 == 9, 0).otherwise(player % 2 + 1).cast("int").alias("team"),
    ).agg(
        F.round(F.avg(F.floor(F.col("l_extendedprice") / 100)) - 250, 6).alias("x"),
        F.round(F.avg("l_quantity") * 8 - 200, 6).alias("y"),
        F.round(F.avg(F.rint(F.col("l_discount") * 100)) - 5, 6).alias("vx"),
        F.round(F.avg(F.rint(F.col("l_tax") * 100)) - 4, 6).alias("vy"),
    )


def balls(spark: SparkSession, folder: str) -> DataFrame:
    """Sampled ball: one row per replay and frame."""
    li = table(spark, folder, "lineitem")
    return li.groupBy(
        F.floor(F.col("l_orderkey") / 8).alias("replay"),
        ((F.col("l_linenumber") % 3) * 6).cast("int").alias("frame"),
    ).agg(
        F.round(F.avg(F.floor(F.col("l_extendedprice") / 100)) - 250, 6).alias("x"),
        F.round(F.avg("l_quantity") * 8 - 200, 6).alias("y"),
        F.round(F.avg(F.rint(F.col("l_discount") * 100)) - 5, 6).alias("vx"),
        F.round(F.avg(F.rint(F.col("l_tax") * 100)) - 4, 6).alias("vy"),
    )


def inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Input changes: one row per replay, player and frame."""
    li = table(spark, folder, "lineitem")
    quantity = F.col("quantity").cast("int")
    lines = li.select(
        F.floor(F.col("l_orderkey") / 8).alias("replay"),
        F.col("l_suppkey").alias("player"),
        ((F.col("l_linenumber") % 7) * 2).cast("int").alias("frame"),
        "l_quantity",
        "l_tax",
    )
    # few lines share a frame, so they move as they are, dealt as the records of players are
    return (
        lines.repartition("replay", "player")
        .groupBy("replay", "player", "frame")
        .agg(F.max("l_quantity").alias("quantity"), F.max("l_tax").alias("tax"))
        .select(
            "replay",
            "player",
            "frame",
            (quantity % 3 - 1).alias("dir_x"),
            (F.floor(quantity / 3) % 3 - 1).cast("int").alias("dir_y"),
            F.when(F.col("tax") > 0.065, 1).otherwise(0).alias("kick"),
        )
    )


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Source files with content hashes; copies of a document are true duplicates."""
    return table(spark, folder, "documents").select(
        F.concat(F.lit("src/"), F.col("doc_id").cast("string")).alias("path"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.sha2("text", 256).alias("sha256"),
        F.col("source"),
    )


def _stem() -> Column:
    key = F.col("o_custkey")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.concat(
        two(key % 28 + 1), F.lit("-"), F.date_format("o_orderdate", "MM-yyyy"),
        F.lit("-"), two(key % 4), F.lit("h"), two(key % 60), F.lit("-r"), (key % 20).cast("string"),
    )


def replay_files(spark: SparkSession, folder: str) -> DataFrame:
    """The replay files of matching: an even order is a file, an odd one is a report."""
    return all_replay_files(spark, folder).filter(F.col("order_no") % 2 == 0).drop("order_no")


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """The reports of matching, from the orders that are no replay files."""
    return all_reports(spark, folder).filter(F.col("order_no") % 2 == 1).drop("order_no")


def all_replay_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as a unique replay file whose name carries a local time and often a hash."""
    o = table(spark, folder, "orders")
    sha = F.sha2(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")), 256)
    hashed = F.floor(F.col("o_orderkey") / 2) % 2 == 1
    name = F.concat(
        _stem(), F.when(hashed, F.concat(F.lit("-"), F.substring(sha, 1, 8))).otherwise(""), F.lit(".hbr2")
    )
    return o.select(
        sha.alias("sha256"),
        F.concat(F.lit("export/"), F.col("o_orderkey").cast("string"), F.lit("/"), name).alias("path"),
        name.alias("file_name"),
        (F.col("o_orderkey") % 3).alias("size_bytes"),
        F.col("o_orderkey").alias("order_no"),
    )


def all_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as a chat report with one or two attachments and a time near the replay's."""
    o = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    turn = F.floor(key / 2)
    seconds = F.element_at(F.array(*[F.lit(s) for s in (0, 45, 200, 4000)]), (turn % 4 + 1).cast("int"))
    at = F.to_timestamp(F.regexp_replace(_stem(), r"^(\d{2})-(\d{2})-(\d{4})-(\d{2})h(\d{2}).*$", "$3-$2-$1 $4:$5:00"))
    stamp = F.timestamp_seconds(F.unix_timestamp(at) + seconds)
    hashed = F.concat(_stem(), F.lit("-abcdef"), F.lit(".hbr2"))
    plain = F.concat(_stem(), F.lit(".hbr2"))
    attach = lambda name: F.struct(
        name.alias("file_name"), F.lit(None).cast("string").alias("url"), (key % 3).alias("size_bytes")
    )
    main = F.when(turn % 7 == 0, hashed).otherwise(plain)
    extra = F.concat(F.lit("notes-"), key.cast("string"), F.lit(".txt"))
    content = F.concat(
        F.lit("Match report SCRIM #R"), key.cast("string"),
        F.lit(" **Red Team** "), (key % 7).cast("string"), F.lit(" - "), (key % 5).cast("string"), F.lit(" Blue Team"),
        F.lit(" Possession: "), (key % 100).cast("string"), F.lit(".25% x "), (100 - key % 100).cast("string"), F.lit("%"),
    )
    return o.select(
        F.concat(F.lit("m"), F.lpad(key.cast("string"), 12, "0")).alias("message_id"),
        F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")).alias("timestamp"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 5).cast("string")).alias("channel_id"),
        F.when(turn % 13 == 0, F.lit("lobby talk")).otherwise(content).alias("content"),
        F.when(turn % 11 == 0, F.array(attach(extra), attach(main))).otherwise(F.array(attach(main))).alias("attachments"),
        key.alias("order_no"),
    )


def replay_contents(spark: SparkSession, folder: str) -> DataFrame:
    """Replay headers as bytes, some of them broken in each of the ways a header can be."""
    key = F.col("o_orderkey")
    word = lambda n: F.lpad(F.hex(n), 8, "0")
    magic = F.when(key % 11 == 3, F.lit("ABCD")).otherwise(F.lit(REPLAY_MAGIC))
    version = F.when(key % 13 == 5, 2).otherwise(3)
    frames = F.when(key % 17 == 7, 0).otherwise(key * 37 % 100000)
    whole = F.unhex(F.concat(F.hex(magic), word(version), word(frames)))
    content = F.when(key % 19 == 2, F.substring(whole, 1, 7)).otherwise(whole)
    return table(spark, folder, "orders").select(
        key.alias("file_id"), content.alias("content"), F.octet_length(content).cast("long").alias("length")
    )


def ledger(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Registry, processing states and versioned analysis states of replays."""
    o = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    sha = F.sha2(key.cast("string"), 256)
    raw = o.select(
        sha.alias("sha256"),
        key.alias("replay_no"),
        (key % 5000 + 100).alias("size_bytes"),
        F.col("o_orderdate").alias("first_archived_at"),
    )
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "failed")
    processing = o.filter(F.col("o_orderstatus") != "P").select(
        sha.alias("sha256"),
        status.alias("status"),
        (key % 36000).alias("total_frames"),
        ((key % 36000) / 60).alias("duration_seconds"),
        F.timestamp_seconds(F.unix_timestamp("o_orderdate") + key % 86400).alias("updated_at"),
    )
    version = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "v1").otherwise("v2")
    analysis = o.filter((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "5-LOW")).select(
        sha.alias("sha256"),
        version.alias("analyzer_version"),
        F.when(key % 10 < 7, "ok").when(key % 10 < 9, "failed").otherwise("retry").alias("status"),
        (key % 12).alias("player_count"),
        (key % 900).alias("sampled_state_count"),
        (key % 5000).alias("tick_count"),
        (key % 77).alias("raw_event_count"),
        F.timestamp_seconds(F.unix_timestamp("o_orderdate") + key % 86400).alias("updated_at"),
    )
    sources = o.select(
        F.concat(F.lit("src/"), key.cast("string")).alias("source_path"),
        F.when(key % 9 == 0, "failed").when(key % 4 == 0, "duplicate").otherwise("archived").alias("status"),
        F.when(key % 9 == 0, F.concat(F.lit("read_failed:"), (key % 3).cast("string"))).alias("error"),
        F.col("o_orderdate").alias("last_seen_at"),
    )
    return {"raw": raw, "processing": processing, "analysis": analysis, "sources": sources}


def runtime_events(spark: SparkSession, folder: str) -> DataFrame:
    """Operational event log."""
    return runtime_event_columns(table(spark, folder, "events"))


def runtime_event_columns(raw: DataFrame) -> DataFrame:
    """Operational events from rows of the event table, at rest or arriving."""
    kind = (
        F.when(F.col("event_type") == "click", "replay_archived")
        .when(F.col("event_type") == "view", "replay_duplicate")
        .when(F.col("event_type") == "error", "replay_failed")
        .when(F.col("event_type") == "signup", "replay_disappeared")
        .otherwise("replay_analyzed")
    )
    return raw.select(
        F.col("event_id"), kind.alias("event_type"), F.col("ts").cast("timestamp").alias("created_at")
    )


def replay_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Analysis headers of replays with gaps of every kind."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.sha2(key.cast("string"), 256).alias("replay_sha256"),
        F.when(key % 23 != 0, F.when(key % 7 == 0, 3).otherwise(4)).alias("schema_version"),
        F.when(key % 29 != 0, key * 13 % 20000 - 50).alias("total_frames"),
        F.when(key % 31 != 0, key % 9 * 100).alias("sampled_states"),
        F.when(key % 37 != 0, key % 13).alias("players"),
        F.when(key % 41 != 0, key % 8 * 5).alias("touches"),
        (key * 13 % 20000 - 50 - key % 3).alias("frames_advanced"),
    )


def replay_players(spark: SparkSession, folder: str) -> DataFrame:
    """Players inside replays, with identities of the skill leaderboard."""
    li = table(spark, folder, "lineitem")
    player = F.col("l_suppkey")
    return li.groupBy(F.col("l_orderkey"), player.alias("replay_player_id")).agg(
        F.sum("l_quantity").cast("long").alias("samples"), F.max("l_linenumber").alias("_n")
    ).select(
        F.sha2(F.col("l_orderkey").cast("string"), 256).alias("replay_sha256"),
        (F.col("replay_player_id") - 1).alias("replay_player_id"),
        F.expr(
            "CASE WHEN replay_player_id % 4 = 0 THEN concat('auth:a', replay_player_id) "
            "ELSE concat('name:player ', replay_player_id) END"
        ).alias("identity"),
        (F.col("_n") % 4).alias("team"),
        "samples",
    )


def quality_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Match-quality evidence: orders with their customers, nullable and sometimes impossible values."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    key, cust = F.col("o_orderkey"), F.col("c_custkey")
    hundredths = lambda col, m: (col % m) / F.lit(100.0)
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        key.alias("match_no"),
        F.when(key % 101 != 0, key % 53 != 0).alias("replay_valid"),
        F.when(key % 11 != 0, (key * 7 % 600 - F.when(key % 211 == 0, 1000).otherwise(0)).cast("double")).alias("duration_seconds"),
        F.when(key % 13 != 0, F.when(key % 3 == 0, 6).otherwise(8)).alias("expected_player_count"),
        F.when(key % 17 != 0, (cust % 4 + 5).cast("int")).alias("observed_player_count"),
        F.when(key % 19 != 0, F.greatest(F.lit(0), key % 8 - 4).cast("int")).alias("disconnect_count"),
        F.when(key % 23 != 0, hundredths(cust * 3, 104)).alias("activity_ratio"),
        F.when(key % 29 != 0, hundredths(key * 31, 101)).alias("parser_completeness"),
        F.when(key % 31 != 0, F.col("c_nationkey") % 6 != 0).alias("stadium_supported"),
        F.when(key % 37 != 0, F.col("c_mktsegment") != "MACHINERY").alias("has_reliable_player_identities"),
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Model generations per lineage with holdout metrics, some incomplete or out of range."""
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        F.col("p_brand").alias("lineage"),
        key.alias("generation"),
        ((key * 53 % 997 + 300) / F.lit(1300.0)).alias("direction_accuracy"),
        F.when(key % 41 != 0, (key * 37 % 991 + F.when(key % 43 == 0, 1000).otherwise(0)) / F.lit(1000.0)).alias("joint_accuracy"),
        ((F.col("p_size") * 19 % 101) / F.lit(101.0)).alias("kick_f1"),
        F.when(key % 47 != 0, key % 500 + 1).alias("samples"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Scored samples: labelled documents as kicks with a probability and two direction classes."""
    labels, documents = table(spark, folder, "labels"), table(spark, folder, "documents")
    key = F.col("doc_id")
    return labels.join(documents.select("doc_id", "n_chars", "source"), "doc_id").select(
        key,
        F.col("source").alias("role"),
        (key % 9).cast("int").alias("direction"),
        F.when(F.col("n_chars") % 3 == 0, (key + 1) % 9).otherwise(key % 9).cast("int").alias("direction_predicted"),
        F.col("quality").alias("kick"),
        ((F.col("n_chars") % 100) / F.lit(100.0)).alias("kick_probability"),
    )


def vector_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Feature vectors with a direction class and a rare kick."""
    key = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        key.alias("sample_id"),
        F.col("embedding").alias("features"),
        (F.col("label") % 9).cast("int").alias("direction"),
        F.when(key % 30 == 0, 1).otherwise(0).alias("kick"),
    )


def shard_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Index rows of feature shards, with faults of every audited kind."""
    key = F.col("o_orderkey")
    selected = key % 4 + 1
    skipped = key % 7
    samples = key % 211
    return table(spark, folder, "orders").select(
        F.sha2(F.floor(key / F.when(key % 97 == 1, 2).otherwise(1)).cast("string"), 256).alias("replay_sha256"),
        F.when(key % 10 == 0, "holdout").otherwise("train").alias("split"),
        F.when(key % 89 == 0, "stale").when(key % 2 == 0, "ok").otherwise("cached").alias("status"),
        samples.alias("samples"),
        (samples + skipped + F.when(key % 83 == 0, 1).otherwise(0)).alias("selected_state_samples"),
        skipped.alias("skipped_unknown_input"),
        selected.alias("selected_players_requested"),
        (selected + F.when(key % 79 == 0, 1).otherwise(-(key % 2))).alias("selected_players_seen"),
        (key % 9000 + 100).alias("total_frames"),
        (key % 9000 + 100 - F.when(key % 73 == 0, 5).otherwise(1)).alias("frames_advanced"),
        (key % 3001).alias("compressed_bytes"),
    )


def published_leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    """A published leaderboard with wrong values, duplicates and rows out of order."""
    key = F.col("c_custkey")
    z = F.round(2.5 - key / F.lit(400.0) % 5.2, 4)
    return table(spark, folder, "customer").select(
        key.alias("row_no"),
        F.when(key % 61 == 0, F.concat(F.col("c_name"), F.lit(" "))).when(key % 97 == 5, "Customer#x").otherwise(F.col("c_name")).alias("player_id"),
        F.element_at(F.array(*[F.lit(r) for r in ("defender", "midfield", "forward", "unknown", "keeper")]), (F.col("c_nationkey") % 5 + 1)).alias("role"),
        (key % 50).alias("matches"),
        (F.col("c_acctbal") / 10).alias("minutes"),
        z.alias("overall_z"),
        (F.least(F.greatest(50 + 10 * z, F.lit(20.0)), F.lit(80.0)) + F.when(key % 71 == 0, 1).otherwise(0)).alias("rating"),
        ((key % 40) / F.lit(10.0) - F.when(key % 67 == 0, 9).otherwise(0)).alias("rating_uncertainty"),
        ((key % 220) / F.lit(100.0) - 1.05).alias("average_teammate_context"),
        (1.05 - (key % 210) / F.lit(100.0)).alias("average_opponent_context"),
    )
