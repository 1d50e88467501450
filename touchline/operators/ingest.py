"""Inventory, canonical matches and the import manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import canonical_match_id, header_probe, looks_like_match_report, report_fields
from touchline.operators.rows import attach


def content_groups(files: DataFrame) -> DataFrame:
    """Per content hash: the first path, the number of copies and their size (AGG-01).

    Paths order by their case-folded form. One minimum per hash: a content copied very often stays cheap.
    """
    return files.groupBy("sha256").agg(
        F.min(F.struct(F.lower("path").alias("_p"), "path", "size_bytes")).alias("_first"),
        F.count(F.lit(1)).alias("copies"),
    ).select("sha256", "_first.path", "_first.size_bytes", "copies")


def duplicate_paths(files: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per copy that is not the first of its content."""
    first = groups.filter("copies > 1").select("sha256", F.col("path").alias("first_path"))
    return files.join(first, "sha256").filter(F.col("path") != F.col("first_path")).select(
        "sha256", "first_path", "path"
    )


def probe_headers(contents: DataFrame) -> DataFrame:
    """Header fields and the reason why a file is not accepted (PRJ-01)."""
    fields = header_probe(F.col("content"), F.col("length"))
    return contents.select(*[c for c in contents.columns if c != "content"], *[c.alias(n) for n, c in fields.items()])


def normalize_attachments(messages: DataFrame) -> DataFrame:
    """Clean attachment structs (PRJ-05).

    Input attachments are arrays of VARIANT objects. The first defined alias wins for name and size; a
    wrongly typed name, size or address drops the attachment; size 0 stays.
    """
    names, sizes = ("fileName", "filename", "name", "file_name"), ("fileSizeBytes", "size", "size_bytes")

    def first_defined(a, keys):
        found = [F.try_variant_get(a, f"$.{k}", "variant") for k in keys]
        return F.coalesce(*[F.when(~F.is_variant_null(v), v) for v in found])

    def clean(a):
        name, size = first_defined(a, names), first_defined(a, sizes)
        url = F.try_variant_get(a, "$.url", "variant")
        kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
        text = lambda v: F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))
        number = F.when(kind(size) == "BIGINT", F.try_variant_get(size, "$", "bigint"))
        name_ok = F.length(F.trim(text(name))) > 0
        size_ok = (kind(size) == "VOID") | (number >= 0)
        url_ok = (kind(url) == "VOID") | (text(url) == "") | (F.length(F.trim(text(url))) > 0)
        return F.when(
            F.coalesce(name_ok, F.lit(False)) & F.coalesce(size_ok, F.lit(False)) & F.coalesce(url_ok, F.lit(False)),
            F.struct(
                text(name).alias("file_name"),
                F.when(text(url) != "", text(url)).alias("url"),
                number.alias("size_bytes"),
            ),
        )

    return messages.withColumn("attachments", F.array_compact(F.transform("attachments", clean)))


def parse_reports(messages: DataFrame) -> DataFrame:
    """Keep messages that look like match reports and read their fields (PRJ-03, PRJ-04).

    The names as written count if the reader kept them, else those of the clean attachments.
    """
    raw = "attachment_names" in messages.columns
    names = F.col("attachment_names") if raw else F.transform("attachments", lambda a: a["file_name"])
    kept = messages.filter(looks_like_match_report(F.col("content"), names))
    return kept.select("*", *[c.alias(n) for n, c in report_fields(F.col("content")).items()])


def canonical_matches(matches: DataFrame, replays: DataFrame, reports: DataFrame) -> DataFrame:
    """Published match rows: match, replay and, where present, its report (JON-05, PRJ-16)."""
    joined = matches.join(replays.select(F.col("sha256").alias("replay_sha256"), "size_bytes"), "replay_sha256").join(
        reports.drop("attachments"), "message_id", "left"
    )
    return joined.select(
        F.lit(1).alias("schema_version"),
        canonical_match_id(F.col("report_id"), F.col("replay_sha256")).alias("match_id"),
        "replay_sha256",
        F.col("replay_path").alias("replay_source_path"),
        F.col("message_id").alias("source_message_id"),
        F.col("confidence").alias("match_confidence"),
        F.col("reasons").alias("match_reasons"),
        "red_score",
        "blue_score",
        "possession_red",
        "possession_blue",
    )


def unmatched(matches: DataFrame, replays: DataFrame, reports: DataFrame) -> DataFrame:
    """Replays and reports without a partner (JON-04): (side, key)."""
    lonely_replays = replays.join(matches.select(F.col("replay_sha256").alias("sha256")), "sha256", "left_anti")
    lonely_reports = reports.join(matches.select("message_id"), "message_id", "left_anti")
    return lonely_replays.select(F.lit("replay").alias("side"), F.col("path").alias("key")).unionByName(
        lonely_reports.select(F.lit("report").alias("side"), F.col("message_id").alias("key"))
    )


def import_manifest(files: DataFrame, groups: DataFrame, reports: DataFrame, matches: DataFrame, lonely: DataFrame, failures: DataFrame) -> DataFrame:
    """One row of import counts (AGG-02)."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    sides = lonely.agg(
        F.count_if(F.col("side") == "replay").alias("unmatched_replays"),
        F.count_if(F.col("side") == "report").alias("unmatched_reports"),
    )
    row = attach(
        one(files, "replay_count"),
        one(groups, "unique_replay_count"),
        one(reports, "report_count"),
        one(matches, "match_count"),
        sides,
        one(failures, "failures"),
    )
    return row.withColumn("duplicate_replay_count", F.col("replay_count") - F.col("unique_replay_count"))


def failure_triage(failures: DataFrame, known_stages: list[str]) -> DataFrame:
    """Failures per stage; unknown stages together as ``other_stage`` (AGG-17)."""
    stage = F.when(F.col("stage").isin(known_stages), F.col("stage")).otherwise("other_stage")
    return failures.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("failures"))
