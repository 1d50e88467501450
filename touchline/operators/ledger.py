"""Queues, states, rates and activity of the processing ledger. Every look-back takes an explicit time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.rows import attach


def latest_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of every key (WIN-11, SNK-03).

    One maximum per key instead of a sort: a key that was written very often is combined before the
    shuffle. Rows of equal time are told apart by their whole content.
    """
    rest = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_row")).select(*keys, "_row.*").select(
        *rows.columns
    )


def unprocessed(raw: DataFrame, processing: DataFrame, limit: int = 100) -> DataFrame:
    """Replays without a processing row, oldest first (JON-06)."""
    return (
        raw.join(processing.select("sha256"), "sha256", "left_anti")
        .orderBy("first_archived_at", "sha256")
        .limit(limit)
    )


def unanalyzed(raw: DataFrame, processing: DataFrame, analysis: DataFrame, version: str, limit: int = 100) -> DataFrame:
    """Processed replays that lack an analysis of this version or wait for a retry (JON-07)."""
    done = analysis.filter((F.col("analyzer_version") == version) & (F.col("status") != "retry")).select("sha256")
    return (
        raw.join(processing.filter("status = 'ok'").select("sha256"), "sha256", "left_semi")
        .join(done, "sha256", "left_anti")
        .orderBy("first_archived_at", "sha256")
        .limit(limit)
    )


def latest_replays(raw: DataFrame, processing: DataFrame, analysis: DataFrame, version: str, limit: int = 80) -> DataFrame:
    """The latest replays with both states, ``pending`` where there is none (JON-08)."""
    p = processing.select("sha256", F.col("status").alias("_p"), F.col("updated_at").alias("_pt"))
    a = analysis.filter(F.col("analyzer_version") == version).select(
        "sha256", F.col("status").alias("_a"), "player_count", "sampled_state_count", "tick_count", "raw_event_count",
        F.col("updated_at").alias("_at"),
    )
    return (
        raw.join(p, "sha256", "left")
        .join(a, "sha256", "left")
        .orderBy(F.desc(F.coalesce("_at", "_pt", F.col("first_archived_at").cast("timestamp"))), "sha256")
        .limit(limit)
        .select(
            F.substring("sha256", 1, 12).alias("id"),
            F.coalesce("_p", F.lit("pending")).alias("processing"),
            F.coalesce("_a", F.lit("pending")).alias("status"),
            "player_count", "sampled_state_count", "tick_count", "raw_event_count",
            F.col("_at").alias("updated_at"),
        )
    )


def status_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows per state (AGG-11)."""
    return rows.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"))


def _count(condition: Column | None, name: str) -> Column:
    return (F.count(F.lit(1)) if condition is None else F.count_if(condition)).alias(name)


def recent_rate(rows: DataFrame, as_of: Column, name: str) -> DataFrame:
    """Rows per minute over the last five minutes, at most five and at least one minute long (AGG-13)."""
    recent = rows.filter(
        (F.col("updated_at") >= as_of - F.expr("INTERVAL 5 MINUTES")) & (F.col("updated_at") <= as_of)
    )
    elapsed = (F.unix_micros(as_of) - F.unix_micros(F.min("updated_at"))) / 60_000_000
    rate = F.count(F.lit(1)) / F.least(F.lit(5.0), F.greatest(F.lit(1.0), elapsed))
    return recent.agg(F.bround(F.coalesce(rate, F.lit(0.0)), 3).alias(name))


def status_snapshot(tables: dict[str, DataFrame], version: str, as_of: Column) -> DataFrame:
    """One row of counts, totals, rates and progress (AGG-11, AGG-12, AGG-13, AGG-14)."""
    current = tables["analysis"].filter(F.col("analyzer_version") == version)
    status = F.col("status")
    ok = status == "ok"
    total = lambda c, name: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(name)
    row = attach(
        tables["raw"].agg(_count(None, "raw_unique_replays")),
        tables["sources"].agg(
            _count(status == "archived", "source_archived"),
            _count(status == "duplicate", "source_duplicates"),
            _count(status == "failed", "source_failed"),
        ),
        tables["processing"].agg(
            _count(None, "_processed"),
            _count(ok, "processing_ok"),
            _count(status == "failed", "processing_failed"),
            total("total_frames", "total_frames_probed"),
            total("duration_seconds", "duration_seconds_probed"),
        ),
        current.agg(
            _count(ok, "analysis_ok"),
            _count(status == "failed", "analysis_failed"),
            total("sampled_state_count", "analysis_sampled_states"),
            total("raw_event_count", "analysis_raw_events"),
            total("tick_count", "analysis_ticks_reconstructed"),
        ),
        recent_rate(tables["processing"], as_of, "probe_rate_per_minute_5m"),
        recent_rate(current, as_of, "analysis_rate_per_minute_5m"),
    )
    c = F.col
    zero = F.lit(0)
    row = row.withColumns(
        {
            "processing_pending": F.greatest(zero, c("raw_unique_replays") - c("_processed")),
            "analysis_pending": F.greatest(zero, c("processing_ok") - c("analysis_ok") - c("analysis_failed")),
        }
    ).drop("_processed")
    return with_progress(row)


def with_progress(row: DataFrame) -> DataFrame:
    """Progress, remaining minutes and completion of a snapshot (AGG-14)."""
    c = F.col

    def remaining(kind: str) -> Column:
        pending, rate = c(f"{kind[0]}"), c(f"{kind[1]}")
        return F.when((pending > 0) & (rate > 0), F.bround(pending / rate, 1))

    percent = lambda done: F.when(c("raw_unique_replays") > 0, F.bround(100.0 * c(done) / c("raw_unique_replays"), 2)).otherwise(0.0)
    return row.withColumns(
        {
            "duration_hours_probed": F.bround(c("duration_seconds_probed") / 3600.0, 2),
            "estimated_probe_minutes_remaining": remaining(("processing_pending", "probe_rate_per_minute_5m")),
            "estimated_analysis_minutes_remaining": remaining(("analysis_pending", "analysis_rate_per_minute_5m")),
            "processing_progress_percent": percent("processing_ok"),
            "analysis_progress_percent": percent("analysis_ok"),
            "analysis_complete": (c("raw_unique_replays") > 0)
            & (c("analysis_ok") == c("raw_unique_replays"))
            & (c("analysis_failed") == 0),
        }
    )


def snapshot_violations(row: DataFrame, subject: Column | None = None) -> DataFrame:
    """Incoherent numbers in a status snapshot (FLT-11)."""
    from touchline.operators.audits import violations

    c = F.col
    counts = [
        "raw_unique_replays", "processing_ok", "processing_failed", "processing_pending",
        "analysis_ok", "analysis_failed", "analysis_pending",
    ]
    rules = {f"negative:{n}": c(n).isNull() | (c(n) < 0) for n in counts}
    for n in ("duration_seconds_probed", "probe_rate_per_minute_5m", "analysis_rate_per_minute_5m"):
        rules[f"negative:{n}"] = c(n).isNull() | F.isnan(c(n).cast("double")) | (c(n) < 0)
    rules["processing_counts_exceed_raw"] = (
        c("processing_ok") + c("processing_failed") + c("processing_pending") > c("raw_unique_replays")
    )
    rules["analysis_counts_exceed_processing_ok"] = (
        c("analysis_ok") + c("analysis_failed") + c("analysis_pending") > c("processing_ok")
    )
    return violations(row, F.lit("status") if subject is None else subject, rules)


def hourly_activity(analysis: DataFrame, version: str, as_of: Column) -> DataFrame:
    """Finished analyses per hour over 24 hours, hours without any as 0 (AGG-15)."""
    this_hour = F.date_trunc("hour", as_of)
    spark = analysis.sparkSession
    hours = spark.range(24).select(
        (F.timestamp_seconds(F.unix_timestamp(this_hour) - F.col("id") * 3600)).alias("hour")
    )
    counts = (
        analysis.filter(
            (F.col("analyzer_version") == version)
            & (F.col("status") == "ok")
            & (F.col("updated_at") >= as_of - F.expr("INTERVAL 23 HOURS"))
        )
        .groupBy(F.date_trunc("hour", "updated_at").alias("hour"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return hours.join(counts, "hour", "left").select("hour", F.coalesce("_n", F.lit(0)).alias("count"))


def latest_failures(sources: DataFrame, limit: int = 5) -> DataFrame:
    """The newest failed sources (TOP-04)."""
    return (
        sources.filter("status = 'failed'")
        .orderBy(F.desc("last_seen_at"), "source_path")
        .limit(limit)
        .select("source_path", "error", "last_seen_at")
    )


def first_issues(issues: DataFrame, limit: int = 100) -> DataFrame:
    """The first issues with the total and a flag that tells whether there are more (TOP-04)."""
    total = issues.agg(F.count(F.lit(1)).alias("total"))
    shown = issues.orderBy(*[F.asc(c) for c in issues.columns]).limit(limit)
    return attach(shown, total).withColumn("truncated", F.col("total") > limit)


def migrate_versions(legacy: DataFrame, versions: DataFrame, default_version: str = "legacy") -> DataFrame:
    """Add legacy analyses to the versioned table unless the key is there already (SET-04)."""
    keyed = legacy.withColumn("analyzer_version", F.coalesce("analyzer_version", F.lit(default_version)))
    new = keyed.join(versions.select("sha256", "analyzer_version"), ["sha256", "analyzer_version"], "left_anti")
    return versions.unionByName(new.select(*versions.columns))


def recent_event_counts(events: DataFrame, as_of: Column, kinds: list[str]) -> DataFrame:
    """Events per kind over the last hour, 0 for kinds that did not occur (AGG-11)."""
    spark = events.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in kinds])).alias("event_type"))
    counts = (
        events.filter((F.col("created_at") >= as_of - F.expr("INTERVAL 60 MINUTES")) & (F.col("created_at") <= as_of))
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return wanted.join(counts, "event_type", "left").select("event_type", F.coalesce("_n", F.lit(0)).alias("n"))
