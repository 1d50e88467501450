"""Analysis artifacts: one JSON document per replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.native_types import field, has_native_type
from touchline.session import computed_once

# JSON field of every column of a player row.
COUNT_FIELDS = {
    "samples": "samples",
    "nearestBallSamples": "nearest_ball_samples",
    "closeBallSamples": "close_ball_samples",
    "inputEvents": "input_events",
    "kickEvents": "kick_events",
    "kickPressedInputs": "kick_pressed_inputs",
    "touches": "touches",
    "selfRetouches": "self_retouches",
    "teamTouchTransfersOut": "team_touch_transfers_out",
    "turnovers": "turnovers",
    "recoveries": "recoveries",
    "pressuredTransitions": "pressured_transitions",
    "retainedUnderPressure": "retained_under_pressure",
    "touchProgressionEvents": "touch_progression_events",
    "touchGoals": "touch_goals",
    "touchAssists": "touch_assists",
    "inferredRetainedChains": "inferred_retained_chains",
    "inferredLostChains": "inferred_lost_chains",
    "inferredRecoveries": "inferred_recoveries",
    "inferredGoals": "inferred_goals",
    "inferredAssists": "inferred_assists",
    "progressionEvents": "progression_events",
}
SUM_FIELDS = {"touchProgressionSum": "touch_progression_sum", "progressionSum": "progression_sum"}

_LONG, _DOUBLE, _TEXT = T.LongType(), T.DoubleType(), T.StringType()


def _struct(nullable: bool = True, **fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t in fields.items()])


# The fields of an artifact. A counter may be absent, but a written null is none.
PLAYER_SCHEMA = T.StructType(
    [
        *_struct(id=_LONG, name=_TEXT, authHash=_TEXT, teamId=_LONG, averageX=_DOUBLE, averageY=_DOUBLE).fields,
        *_struct(False, **{n: _LONG for n in COUNT_FIELDS}, **{n: _DOUBLE for n in SUM_FIELDS}).fields,
    ]
)
_ROWS = T.ArrayType(T.ArrayType(_DOUBLE))
_NAMES = T.ArrayType(_TEXT)
ARTIFACT_SCHEMA = _struct(
    schemaVersion=_LONG,
    totalFrames=_LONG,
    simulation=_struct(sampleEveryTicks=_LONG, sampledStateCount=_LONG, framesAdvanced=_LONG),
    featureSummary=_struct(touches=_LONG),
    sparseEvents=_struct(
        touchColumns=_NAMES, kickColumns=_NAMES, goalColumns=_NAMES, touches=_ROWS, kicks=_ROWS, goals=_ROWS
    ),
    players=T.ArrayType(PLAYER_SCHEMA, containsNull=False),
)
# The versions of artifacts that are read.
VERSIONS = (3, 4)

#: The file stem; of files in a folder per match, as partitioned writes make them, the folder's.
_STEM = r"(?:match_id=([^/]+)/[^/]*|([^/]+?)(?:\.[^./]*)?)$"


def artifact_texts(spark: SparkSession, root: str, names: str = "[!_]*.json") -> DataFrame:
    """(match_id, text) of every file below a folder; names that start with ``_`` are no artifacts."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", names).text(root)
    path = F.col("_metadata.file_path")
    return raw.select(F.coalesce(F.nullif(F.regexp_extract(path, _STEM, 1), F.lit("")), F.regexp_extract(path, _STEM, 2)).alias("match_id"), F.col("value").alias("text"))


def parsed_artifacts(texts: DataFrame) -> DataFrame:
    """The artifacts among (match_id, text): a document each and the columns of ``ARTIFACT_SCHEMA`` (SRC-03).

    Text that is no JSON, other roots than objects, other versions than 3 and 4, and documents with a declared
    value of a wrong native type anywhere are dropped whole, whichever columns are asked for.
    """
    documents = computed_once(texts, document=F.try_parse_json("text")).select("match_id", "document")
    version = F.when(F.schema_of_variant(field(F.col("document"), "schemaVersion")) == "BIGINT", F.try_variant_get("document", "$.schemaVersion", "bigint"))
    kept = documents.where(F.col("document").isNotNull() & version.isin(*VERSIONS)).where(has_native_type(F.col("document"), ARTIFACT_SCHEMA, nullable=False))
    typed = [F.try_variant_get("document", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in ARTIFACT_SCHEMA.fields]
    return kept.select("match_id", "document", *typed)


def read_artifacts(spark: SparkSession, root: str, names: str = "[!_]*.json") -> DataFrame:
    """Readable artifacts of schema 3 and 4 below a folder, with the file stem as ``match_id`` (SRC-03)."""
    return parsed_artifacts(artifact_texts(spark, root, names))


def with_player_columns(artifacts: DataFrame) -> DataFrame:
    """Artifacts whose players carry the column names of the operators; absent counters are 0.

    A written null, a wrong type or a null player never gets here: the reader drops those documents.
    """
    zero, nothing = F.lit(0).cast("long"), F.lit(0.0)
    rename = lambda p: F.struct(
        p["id"].alias("player"),
        p["name"].alias("name"),
        p["authHash"].alias("auth_hash"),
        F.coalesce(p["teamId"], zero).alias("team"),
        p["averageX"].alias("average_x"),
        *[F.coalesce(p[n], zero).alias(c) for n, c in COUNT_FIELDS.items()],
        *[F.coalesce(p[n], nothing).alias(c) for n, c in SUM_FIELDS.items()],
    )
    return artifacts.select(
        "match_id",
        F.col("schemaVersion").alias("schema_version"),
        F.coalesce("totalFrames", zero).alias("total_frames"),
        F.col("simulation.sampleEveryTicks").alias("sample_every_ticks"),
        F.transform("players", rename).alias("players"),
    )


def player_rows(artifacts: DataFrame) -> DataFrame:
    """One row per player of every artifact."""
    return artifacts.select(
        "match_id", "schema_version", "total_frames", "sample_every_ticks", F.inline("players")
    )


def sparse_events(artifacts: DataFrame, kind: str) -> DataFrame:
    """Positional event rows of an artifact as typed columns (SRC-04). ``kind``: touches, kicks or goals.

    Columns are found by the names that the artifact declares, not by position alone.
    """
    # Declared columns of the positional rows.
    columns = {
        "touches": ("touchColumns", ["frame", "playerId", "teamId", "ballX", "ballY", "pressureDistance", "underPressure", "outcome", "nextPlayerId", "progression"]),
        "kicks": ("kickColumns", ["frame", "playerId", "teamId", "ballX", "ballY", "pressureDistance", "underPressure", "outcome", "nextPlayerId"]),
        "goals": ("goalColumns", ["frame", "teamId", "scorerPlayerId", "assistPlayerId"]),
    }
    declared, names = columns[kind]
    whole = {"frame", "playerId", "teamId", "underPressure", "outcome", "nextPlayerId", "scorerPlayerId", "assistPlayerId"}
    rows = artifacts.select(
        "match_id", F.col(f"sparseEvents.{declared}").alias("_names"), F.posexplode(f"sparseEvents.{kind}").alias("seq", "_row")
    )

    def field(name: str):
        at = F.array_position("_names", name).cast("int")
        value = F.when(at > 0, F.try_element_at("_row", at))
        return (value.cast("long") if name in whole else value).alias(name)

    return rows.select("match_id", "seq", *[field(n) for n in names])
