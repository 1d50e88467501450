"""Touch transitions of live matches.

``stream_touches`` keeps state per replay and gives a touch out once it is settled; a batch of a replay is one
task. ``run_touches`` runs the batch chain over the stretches that a batch changes and gives every touch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from touchline.operators import touches as T
from touchline.operators.touches import GOAL, GOAL_WINDOW, OPPONENT, SELF_RETOUCH, TEAMMATE, TOUCH_GAP, UNRESOLVED

OUTPUT = "replay string, seq long, frame int, player long, team int, outcome int, next_player long, progression double, late long"
# What a replay remembers: the last row handled, the last contact and the last open touch.
STATE = (
    "last_seq long, contact_player long, contact_frame int, "
    "touch_seq long, touch_frame int, touch_player long, touch_team int, touch_x double"
)
_NONE = (-1, None, None, None, None, None, None, None)


def _handle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last_seq, c_player, c_frame, *touch = state.get if state.exists else _NONE
    rows = pd.concat(list(frames)).sort_values("seq")
    late = int((rows["seq"] <= last_seq).sum())
    out: list[tuple] = []

    def close(outcome: int, player=None, progression=None) -> None:
        if touch[0] is not None:
            out.append((key[0], touch[0], touch[1], touch[2], touch[3], outcome, player, progression, 0))

    for row in rows[rows["seq"] > last_seq].itertuples():
        last_seq = row.seq
        if row.kind in ("goal", "reset"):
            scored = (
                row.kind == "goal" and touch[0] is not None and touch[3] == row.goal_team
                and row.frame - touch[1] <= GOAL_WINDOW
            )
            close(GOAL if scored else UNRESOLVED)
            c_player = c_frame = None
            touch = [None] * 5
            continue
        again = c_player == row.player and c_frame is not None and row.frame - c_frame <= TOUCH_GAP
        c_player, c_frame = row.player, row.frame
        if again or row.team not in (1, 2):
            continue
        if touch[0] is not None:
            forward = 1.0 if touch[3] == 1 else -1.0
            kind = SELF_RETOUCH if touch[2] == row.player else TEAMMATE if touch[3] == row.team else OPPONENT
            close(kind, row.player, forward * (row.ball_x - touch[4]))
        touch = [row.seq, row.frame, row.player, row.team, row.ball_x]
    state.update((int(last_seq), c_player, c_frame, *touch))
    if late:
        out.append((key[0], None, None, None, None, None, None, None, late))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])
    yield frame.astype({c: "Int64" for c in ("seq", "frame", "player", "team", "outcome", "next_player", "late")})


def stream_touches(events: DataFrame) -> DataFrame:
    """Touches with their outcome as soon as it is known (STR-07).

    Only contacts and resets reach the state. Rows of a batch are ordered by seq; a row behind one that was
    handled in an earlier batch is late: it is dropped, and a row with only ``late`` set counts it. The touch
    that is open at the end of the stream stays in the state.
    """
    rows = events.filter(F.col("kind").isin("contact", "goal", "reset")).select(
        "replay", "seq", "frame", "kind", "player", "team", "ball_x", "goal_team"
    )
    return rows.groupBy("replay").applyInPandasWithState(
        _handle, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
    )


# A goal or reset ends a stretch; a replay without one is open from its start.
_BORDER = "kind IN ('goal', 'reset')"
_START = -(1 << 63)


def _touched(first: DataFrame) -> DataFrame:
    """The replays of a batch with the begin of their open stretch; late ones have a row before it."""
    low = F.coalesce("low", F.lit(_START))
    return first.select("replay", F.col("first").cast("long").alias("first"), low.alias("low"), (F.col("first") < low).alias("late"))


def run_touches(events: DataFrame, folder: str) -> DataFrame:
    """Every touch of all that is there now, as the batch chain has it, however rows fall into batches (STR-07).

    A stretch begins behind a goal or reset, and nothing before it has a part in its touches. Between batches
    only open stretches are carried: each replay's rows from its last goal or reset on. A batch adds its rows to
    them, runs the chain over every replay it touches and replaces the touches from there, so its cost follows
    its rows and the open stretches, not the past. All rows are kept too, but they are read only for replays
    with a row before their open stretch: such a late row reopens its stretch and those behind it. Touches that
    are still open have the outcome of the rows so far.
    """
    needed = events.filter(F.col("kind").isin("contact", "goal", "reset")).select(*T._CHAIN_COLUMNS)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in needed.schema)
    replay = f"replay {needed.schema['replay'].dataType.simpleString()}"
    out_schema = (
        f"{replay}, seq {needed.schema['seq'].dataType.simpleString()}, "
        f"player {needed.schema['player'].dataType.simpleString()}, outcome int, "
        f"next_player {needed.schema['player'].dataType.simpleString()}, progression double, batch long"
    )
    from_schema = f"{replay}, low long, batch long"

    def written(spark: SparkSession, name: str, schema: str, number: int) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{folder}/{name}/batch={number}")

    def handle(batch: DataFrame, number: int) -> None:
        # folders are overwritten, so what a batch that is repeated left before counts once
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        new = written(spark, "rows", columns, number)
        carried_schema = f"{columns}, low long"
        carried = written(spark, "carried", carried_schema, number - 1) if number else spark.createDataFrame([], carried_schema)
        first = new.groupBy("replay").agg(F.min("seq").alias("first"))
        lows = carried.groupBy("replay").agg(F.max("low").alias("low"))
        _touched(first.join(lows, "replay", "left")).write.mode("overwrite").parquet(f"{folder}/touched/batch={number}")
        touched = written(spark, "touched", f"{replay}, first long, low long, late boolean", number)
        late = touched.filter("late").select("replay", "first")
        changed = carried.drop("low").unionByName(new).join(touched.filter("NOT late").select("replay", "low"), "replay")
        if not late.isEmpty():
            kept = spark.read.schema(f"{columns}, batch long").parquet(f"{folder}/rows").filter(F.col("batch") <= number).drop("batch")
            before = kept.filter(_BORDER).join(late, "replay").filter("seq < first").groupBy("replay").agg(F.max("seq").alias("low"))
            reopened = late.join(before, "replay", "left").select("replay", F.coalesce("low", F.lit(_START)).alias("low"))
            changed = changed.unionByName(kept.join(reopened, "replay").filter("seq >= low"))
        changed.write.mode("overwrite").parquet(f"{folder}/changed/batch={number}")
        changed = written(spark, "changed", carried_schema, number)
        changed.select("replay", "low").distinct().write.mode("overwrite").parquet(f"{folder}/from/batch={number}")
        found = T.touch_outcomes(T.resolve_chain(T.chain_events(changed.select(*T._CHAIN_COLUMNS))))
        found.select("replay", "seq", "player", "outcome", "next_player", "progression").write.mode("overwrite").parquet(
            f"{folder}/out/batch={number}"
        )
        ends = changed.groupBy("replay").agg(F.coalesce(F.max(F.when(F.expr(_BORDER), F.col("seq"))), F.max("low")).alias("low"))
        still = changed.drop("low").join(ends, "replay").filter("seq >= low")
        others = carried.join(touched.select("replay"), "replay", "left_anti")
        others.unionByName(still).select(*carried.columns).write.mode("overwrite").parquet(f"{folder}/carried/batch={number}")

    query = (
        needed.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{folder}/log")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark = events.sparkSession
    found = spark.read.schema(out_schema).parquet(f"{folder}/out")
    # a touch stands unless a later batch began at or before it
    starts = spark.read.schema(from_schema).parquet(f"{folder}/from").groupBy("replay").agg(
        F.collect_list(F.struct(F.col("batch").alias("b"), "low")).alias("starts")
    )
    replaced = F.exists("starts", lambda x: (x["b"] > F.col("batch")) & (x["low"] <= F.col("seq")))
    return found.join(starts, "replay").filter(~replaced).drop("starts", "batch")
