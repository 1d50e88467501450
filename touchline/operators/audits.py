"""Checks of published tables. Every audit returns rows (subject, check, detail); none means clean."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import composite_score, fold_case, holdout_bucket, tuned_variant
from touchline.operators.gates import snapshot_issues
from touchline.operators.rows import attach
from touchline.operators.sequences import look_around, rank_within
from touchline.operators.skill import DIMENSIONS
from touchline.session import materialize

SHA256_PATTERN = r"^[0-9a-f]{64}$"
# Roles of a leaderboard, range of a dimension mean, tolerance of re-derived numbers.
ROLES = ("defender", "midfield", "forward", "unknown")
Z_LIMIT = 3.25
TOLERANCE = 1e-12
#: Digests that make one of the next level of a hash tree.
TREE_FAN_OUT = 1024
DIRECTIONS = 9


def violations(df: DataFrame, subject: Column, rules: Mapping[str, Column], detail: Column | None = None) -> DataFrame:
    """One row per broken rule; all rules are checked in one pass (AUD-01)."""
    text = (detail if detail is not None else F.lit("")).cast("string")
    found = F.array_compact(
        F.array(*[F.when(broken, F.struct(F.lit(name).alias("check"), text.alias("detail"))) for name, broken in rules.items()])
    )
    return df.select(subject.cast("string").alias("subject"), F.inline(found))


def receipt(found: DataFrame) -> DataFrame:
    """One row: clean or not and how many violations."""
    return found.agg(F.count(F.lit(1)).alias("violations")).withColumn("ok", F.col("violations") == 0)


def violations_by_check(found: DataFrame) -> DataFrame:
    return found.groupBy("check").agg(F.count(F.lit(1)).alias("n"))


def duplicates(df: DataFrame, keys: Sequence[str], check: str) -> DataFrame:
    """A violation for every key that occurs more than once."""
    again = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return again.select(
        F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("subject"),
        F.lit(check).alias("check"),
        F.col("_n").cast("string").alias("detail"),
    )


def out_of_order(
    df: DataFrame, position: str, subject: Column, key: Column, check: str, *,
    keys: Sequence[str] = (), descending: bool = True, strict: bool = False, parts: int | None = None,
) -> DataFrame:
    """A violation for every row whose order key passes that of the row before it (with ``strict`` also for equal ones).

    ``keys``: each of their values is a sequence of its own.
    """
    seen = look_around(df, list(keys), position, before={"_prev": F.struct(position, key.alias("_key"))}, parts=parts)
    wrong = key > F.col("_prev._key") if descending else key < F.col("_prev._key")
    if strict:
        wrong = wrong | (key == F.col("_prev._key"))
    return violations(seen, subject, {check: wrong})


# ---- contract rules (AUD-01) ----------------------------------------------------------------------


def not_native(value: Column, kind: str) -> Column:
    """A VARIANT value that is not of the native type ``integer``, ``number``, ``string`` or ``boolean``."""
    accepted = {
        "integer": ("BIGINT",),
        "number": ("BIGINT", "DOUBLE", "DECIMAL"),
        "string": ("STRING",),
        "boolean": ("BOOLEAN",),
    }[kind]
    found = F.regexp_extract(F.schema_of_variant(value), r"^([A-Z]+)", 1)
    return F.coalesce(~found.isin(*accepted), F.lit(True))


def not_in_range(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null, not finite, or outside the limits."""
    number = value.cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    if low is not None:
        bad = bad | (number < low)
    if high is not None:
        bad = bad | (number > high)
    return F.coalesce(bad, F.lit(True))


def not_clean(text: Column) -> Column:
    """Null, empty or with surrounding white space."""
    return F.coalesce((text != F.trim(text)) | (text == ""), F.lit(True))


def not_sha256(text: Column) -> Column:
    return F.coalesce(~text.rlike(SHA256_PATTERN), F.lit(True))


def not_close(value: Column, expected: Column, tolerance: float = TOLERANCE) -> Column:
    return F.coalesce(F.abs(value - expected) > tolerance, F.lit(True))


# ---- audits of single tables -----------------------------------------------------------------------


def audit_leaderboard(
    rows: DataFrame, *, min_matches: int = 1, min_minutes: float = 0.0, dimensions: bool = True, parts: int | None = None
) -> DataFrame:
    """Ranges, rating arithmetic, unique players and order of a leaderboard (AUD-02).

    ``row_no`` is the published position.
    """
    c = F.col
    expected = F.least(F.greatest(50.0 + 10.0 * c("overall_z"), F.lit(20.0)), F.lit(80.0))
    rules = {
        "player_id": not_clean(c("player_id")),
        "role": F.coalesce(~c("role").isin(*ROLES), F.lit(True)),
        "matches": not_in_range(c("matches"), max(1, min_matches)),
        "minutes": not_in_range(c("minutes"), max(0.0, min_minutes)),
        "rating": not_in_range(c("rating"), 20, 80),
        "rating_uncertainty": not_in_range(c("rating_uncertainty"), 0),
        "overall_z": not_in_range(c("overall_z"), -Z_LIMIT, Z_LIMIT),
        "average_teammate_context": not_in_range(c("average_teammate_context"), -1, 1),
        "average_opponent_context": not_in_range(c("average_opponent_context"), -1, 1),
        "rating_inconsistent": not_close(c("rating"), expected, 1e-9),
    }
    if dimensions:
        for d in DIMENSIONS:
            field = c("dimensions")[d]
            rules[f"{d}.mean"] = not_in_range(field["mean"], -Z_LIMIT, Z_LIMIT)
            rules[f"{d}.uncertainty"] = not_in_range(field["uncertainty"], 0)
            rules[f"{d}.effective_weight"] = not_in_range(field["effective_weight"], 0)
    order = F.struct("rating", -F.col("rating_uncertainty"), "matches")
    return (
        violations(rows, c("player_id"), rules)
        .unionByName(duplicates(rows, ["player_id"], "duplicate_player_id"))
        .unionByName(out_of_order(rows, "row_no", c("player_id"), order, "not_in_rating_order", parts=parts))
    )


def audit_manifest_replays(
    entries: DataFrame, *, modulus: int = 10, bucket: int = 0, salt: str = "holdout-v1:", raw_root: str = "raw"
) -> DataFrame:
    """Provenance, duration, weight and split of manifest replays (AUD-03)."""
    c = F.col
    sha = c("replay_sha256")
    path = F.concat_ws("/", F.lit(raw_root), F.substring(sha, 1, 2), F.substring(sha, 3, 2), F.concat(sha, F.lit(".hbr2")))
    held = holdout_bucket(sha, modulus, salt) == bucket
    rules = {
        "replay_sha256": not_sha256(sha),
        "raw_path": F.coalesce(c("raw_path") != path, F.lit(True)),
        "analysis_path": F.coalesce(~c("analysis_path").endswith(F.concat(F.lit("/"), sha, F.lit(".json"))), F.lit(True)),
        "total_frames": not_in_range(c("total_frames"), 1),
        "duration_seconds": not_close(c("duration_seconds"), F.bround(c("total_frames") / 60.0, 3), 1e-9),
        "selected_player_count": not_in_range(c("selected_player_count"), 1),
        "example_weight": not_in_range(c("example_weight"), 0.25, 2.0),
        "wrong_split": F.coalesce(held != (c("split") == "holdout"), F.lit(True)),
    }
    return violations(entries, sha, rules).unionByName(
        duplicates(entries, ["replay_sha256"], "duplicate_replay")
    )


def audit_shard_index(entries: DataFrame, totals: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Sample accounting, completeness and totals of a shard index (AUD-04).

    ``totals`` has one row per split; ``meta`` (optional) holds the shards' own records of the same fields.
    """
    c = F.col
    rules = {
        "samples_nonpositive": c("samples") <= 0,
        "sample_accounting": ~c("selected_state_samples").eqNullSafe(c("samples") + c("skipped_unknown_input")),
        "selected_players_seen_exceeds_requested": c("selected_players_seen") > c("selected_players_requested"),
        "incomplete_reconstruction": (c("total_frames") > 0) & (c("frames_advanced") < c("total_frames") - 1),
        "compressed_bytes_nonpositive": c("compressed_bytes") <= 0,
        "index_status": F.coalesce(~c("status").isin("ok", "cached"), F.lit(True)),
    }
    found = violations(entries, c("replay_sha256"), rules).unionByName(
        duplicates(entries, ["replay_sha256"], "duplicate_replay")
    )
    if meta is not None:
        fields = [f for f in meta.columns if f not in ("replay_sha256", "status")]
        theirs = meta.select("replay_sha256", *[c(f).alias(f"_m_{f}") for f in fields])
        both = entries.join(theirs.withColumn("_m_known", F.lit(True)), "replay_sha256", "left")
        known = c("_m_known").isNotNull()
        rules = {f"index_meta_mismatch:{f}": known & ~c(f).eqNullSafe(c(f"_m_{f}")) for f in fields}
        found = found.unionByName(violations(both, c("replay_sha256"), {"shard_record_missing": ~known, **rules}))
    summed = entries.groupBy("split").agg(
        F.count(F.lit(1)).alias("_successful_replays"),
        *[
            F.sum(f).alias(f"_{f}")
            for f in ("samples", "compressed_bytes", "selected_players_seen", "skipped_unknown_input")
        ],
    )
    both = totals.join(summed, "split", "left")
    checks = ["successful_replays", "samples", "compressed_bytes", "selected_players_seen", "skipped_unknown_input"]
    rules = {f"total:{f}": ~c(f).eqNullSafe(F.coalesce(c(f"_{f}"), F.lit(0))) for f in checks}
    rules["total:requested"] = c("requested_replays") != c("successful_replays") + c("failed_replays")
    return found.unionByName(violations(both, c("split"), rules))


def audit_shard_bundle(entries: DataFrame, settings: DataFrame) -> DataFrame:
    """Split labels, settings shared by the splits, duplicates and leakage (AUD-05, SET-02)."""
    c = F.col
    labels = violations(
        settings, c("split"), {"split_label": F.coalesce(~c("split").isin("train", "holdout"), F.lit(True))}
    )
    shared = [f for f in settings.columns if f != "split"]
    differing = settings.agg(*[(F.count_distinct(f) > 1).alias(f) for f in shared])
    settings_found = violations(differing, F.lit("bundle"), {f"setting_differs:{f}": c(f) for f in shared})
    twice = duplicates(entries, ["split", "replay_sha256"], "duplicate_replay")
    side = lambda s: entries.filter(c("split") == s).select("replay_sha256")
    leaked = violations(side("train").intersect(side("holdout")), c("replay_sha256"), {"cross_split_leakage": F.lit(True)})
    return labels.unionByName(settings_found).unionByName(twice).unionByName(leaked)


def archive_path(sha: Column) -> Column:
    """Content address of an archived replay: ``aa/bb/<sha>.hbr2`` (SNK-02)."""
    return F.concat_ws("/", F.substring(sha, 1, 2), F.substring(sha, 3, 2), F.concat(sha, F.lit(".hbr2")))


def audit_archive(registry: DataFrame, objects: DataFrame) -> DataFrame:
    """Registry rows against stored objects (AUD-06).

    ``registry``: sha256, archive_path, size_bytes; ``objects``: archive_path, length, content_sha256
    (recomputed from the content).
    """
    c = F.col
    both = registry.join(objects, "archive_path", "left")
    there = c("length").isNotNull()
    rules = {
        "content_address_path_mismatch": c("archive_path") != archive_path(c("sha256")),
        "archive_missing": ~there,
        "size_mismatch": there & (c("length") != c("size_bytes")),
        "sha256_mismatch": there & (c("content_sha256") != c("sha256")),
    }
    return violations(both, c("sha256"), rules)


def audit_metrics(blocks: DataFrame, subject: Column) -> DataFrame:
    """Published metrics re-derived from their confusion counts (AUD-07)."""
    c = F.col
    tp, fp, fn, tn = (c(n) for n in ("tp", "fp", "fn", "tn"))
    one = F.lit(1)
    precision, recall = tp / F.greatest(one, tp + fp), tp / F.greatest(one, tp + fn)
    f1 = 2.0 * precision * recall / F.greatest(F.lit(1e-12), precision + recall)
    expected = {
        "kick_precision": precision,
        "kick_recall": recall,
        "kick_f1": f1,
        "kick_true_rate": (tp + fn) / c("samples"),
        "kick_predicted_rate": (tp + fp) / c("samples"),
        "always_no_kick_accuracy": (tn + fp) / c("samples"),
    }
    rules = {"confusion_does_not_sum_to_samples": tp + fp + fn + tn != c("samples")}
    rules.update({f"{name}_inconsistent": not_close(c(name), value) for name, value in expected.items()})
    rules.update({f"{name}_range": not_in_range(c(name), 0, 1) for name in expected})
    return violations(blocks, subject, rules)


def audit_training(blocks: DataFrame, subject: Column) -> DataFrame:
    """Published training settings and label statistics against their own counts (AUD-07)."""
    c = F.col
    counts = c("direction_counts")
    nine = F.coalesce(F.size(counts) == DIRECTIONS, F.lit(False))
    whole = nine & F.coalesce(F.forall(counts, lambda n: F.coalesce(n >= 0, F.lit(False))), F.lit(False))
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda total, n: total + n)
    least = {"epochs": 1, "batch_size": 1, "learning_rate": 0, "l2": 0, "train_replays": 1, "holdout_replays": 1, "samples": 1, "kick_positive": 0, "kick_negative": 0}
    rules = {f"{name}_range": not_in_range(c(name), low) for name, low in least.items()}
    rules |= {
        "seed_missing": c("seed").isNull(),
        "calibrated_kick_threshold_range": not_in_range(c("calibrated_kick_threshold"), 0, 1),
        "direction_counts_not_nine": ~nine,
        "direction_counts_invalid": nine & ~whole,
        "direction_counts_do_not_sum_to_samples": whole & ~(total.eqNullSafe(c("samples"))),
        "kick_counts_do_not_sum_to_samples": ~(c("kick_positive") + c("kick_negative")).eqNullSafe(c("samples")),
        "kick_positive_rate_range": not_in_range(c("kick_positive_rate"), 0, 1),
        "kick_positive_rate_inconsistent": not_close(c("kick_positive_rate"), c("kick_positive") / F.greatest(F.lit(1), c("samples"))),
        "kick_positive_weight_range": not_in_range(c("kick_positive_weight"), 1, 25),
    }
    return violations(blocks, subject, rules)


def audit_import_manifest(row: DataFrame) -> DataFrame:
    """Arithmetic of an import manifest (AUD-08)."""
    c = F.col
    counts = ["replay_count", "unique_replay_count", "duplicate_replay_count", "report_count", "match_count"]
    rules = {f"negative:{n}": not_in_range(c(n), 0) for n in counts}
    rules["replay_counts"] = c("replay_count") != c("unique_replay_count") + c("duplicate_replay_count")
    rules["matches_exceed_replays"] = c("match_count") > c("unique_replay_count")
    rules["matches_exceed_reports"] = c("match_count") > c("report_count")
    rules["unmatched_reports"] = c("unmatched_reports") != c("report_count") - c("match_count")
    rules["unmatched_replays"] = c("unmatched_replays") > c("unique_replay_count") - c("match_count")
    return violations(row, F.lit("import_manifest"), rules)


def receipt_digest(files: DataFrame, totals: DataFrame) -> DataFrame:
    """Self digest of a receipt, one row: SHA-256 of its canonical JSON (keys sorted, no blanks).

    The files stand in it by the root of their tree in the order of ``position``.
    """
    root = ordered_root(files, ["position"], ["path", "kind", "size_bytes", "sha256"]).select(F.col("root").alias("files_root"))
    fields = ["discord_json_count", "file_count", "files_root", "hbr2_count", "total_size_bytes"]
    return attach(totals, root).select(F.sha2(F.to_json(F.struct(*fields)), 256).alias("receipt_sha256"))


def audit_receipt_order(files: DataFrame, claimed: DataFrame, *, parts: int | None = None) -> DataFrame:
    """Canonical order of a receipt's files (``position``) and its self digest (AUD-09), one violation each."""
    path = F.col("path")
    wrong = out_of_order(files, "position", path, F.struct(fold_case(path).alias("folded"), path.alias("path")), "files_not_canonically_ordered", descending=False, parts=parts)
    ordered = wrong.groupBy(F.lit("receipt").alias("subject"), "check").agg(F.count(F.lit(1)).cast("string").alias("detail"))
    actual = receipt_digest(files, claimed.drop("receipt_sha256")).withColumnRenamed("receipt_sha256", "_actual")
    digest = violations(attach(claimed, actual), F.lit("receipt"), {"receipt_self_digest_mismatch": ~F.col("receipt_sha256").eqNullSafe(F.col("_actual"))})
    return ordered.unionByName(digest)


def audit_source_receipt(files: DataFrame, claimed: DataFrame) -> DataFrame:
    """Kinds, hashes, unique paths and totals of a source receipt (AUD-09)."""
    c = F.col
    path = c("path")
    steps = F.split(path, "/")
    bad_path = F.coalesce(
        (path == "") | path.contains("\\") | path.startswith("/") | F.exists(steps, lambda p: p.isin("", ".", "..")),
        F.lit(True),
    )
    rules = {
        "invalid_file_path": bad_path,
        "invalid_file_kind": F.coalesce(~c("kind").isin("hbr2", "discord_json"), F.lit(True)),
        "file_kind_path_mismatch": ((c("kind") == "hbr2") & ~F.lower(path).endswith(".hbr2"))
        | ((c("kind") == "discord_json") & ~path.endswith(".json")),
        "invalid_file_size": not_in_range(c("size_bytes"), 0),
        "invalid_file_sha256": not_sha256(c("sha256")),
    }
    found = violations(files, path, rules).unionByName(duplicates(files, ["path"], "duplicate_file_path"))
    actual = files.agg(
        F.count(F.lit(1)).alias("_file_count"),
        F.count_if(c("kind") == "hbr2").alias("_hbr2_count"),
        F.count_if(c("kind") == "discord_json").alias("_discord_json_count"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("_total_size_bytes"),
    )
    totals = ["file_count", "hbr2_count", "discord_json_count", "total_size_bytes"]
    both = attach(claimed, actual)
    return found.unionByName(
        violations(both, F.lit("receipt"), {f"{t}_mismatch": ~c(t).eqNullSafe(c(f"_{t}")) for t in totals})
    )


def audit_generations(runs: DataFrame) -> DataFrame:
    """Recorded runs against what their generation number prescribes (AUD-10).

    ``runs``: experiment_id, generation, hyper-parameters, seed, metrics and champion score.
    """
    c = F.col
    expected = tuned_variant(c("generation"))
    exact = ("hidden_dim", "epochs", "batch_size", "seed")
    rules = {f"{n}_mismatch": ~c(n).eqNullSafe(expected[n]) for n in exact}
    rules["learning_rate_mismatch"] = not_close(c("learning_rate"), expected["learning_rate"])
    rules["experiment_id_mismatch"] = ~c("experiment_id").eqNullSafe(
        F.concat(F.lit("gen-"), F.lpad(c("generation").cast("string"), F.greatest(F.lit(4), F.length(c("generation").cast("string"))), F.lit("0")))
    )
    rules["champion_score_mismatch"] = not_close(c("score"), composite_score(c("joint_accuracy"), c("kick_f1")))
    metric = F.array_compact(F.array(*snapshot_issues("", "champion.metrics")))
    rules["champion_metrics_invalid"] = F.size(metric) > 0
    return violations(runs, c("experiment_id"), rules)


def finalization_state(snapshot: DataFrame, completion: DataFrame) -> DataFrame:
    """Whether an analysis may be finalised, or is finalised already (AUD-11).

    ``completion`` has at most one row: the last completion record of the version.
    """
    last = completion.agg(
        F.max(F.struct("raw_unique_replays", "analysis_ok", "analysis_ticks_reconstructed")).alias("_last")
    )
    return _finalization(attach(snapshot, last), [])


def finalization_states(snapshots: DataFrame, completions: DataFrame, version: str) -> DataFrame:
    """The same for many versions at once: snapshots and completion records by ``version``."""
    last = completions.groupBy(version).agg(F.max(F.struct("raw_unique_replays", "analysis_ok", "analysis_ticks_reconstructed")).alias("_last"))
    return _finalization(snapshots.join(last, version, "left"), [version])


def _finalization(joined: DataFrame, keys: list[str]) -> DataFrame:
    c = F.col
    complete = (
        (c("raw_unique_replays") > 0)
        & (c("analysis_ok") == c("raw_unique_replays"))
        & (c("analysis_failed") == 0)
        & (c("processing_failed") == 0)
    )
    same = F.coalesce(
        (c("_last.raw_unique_replays") == c("raw_unique_replays"))
        & (c("_last.analysis_ok") == c("analysis_ok"))
        & (c("_last.analysis_ticks_reconstructed") == c("analysis_ticks_reconstructed")),
        F.lit(False),
    )
    return joined.select(
        *keys,
        complete.alias("ready"),
        (complete & same).alias("already_finalized"),
        (complete & ~same).alias("finalize_now"),
    )


# ---- comparisons of two tables ----------------------------------------------------------------------


def inventory_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Missing, unexpected and changed files by path (JON-18)."""
    c = F.col
    mine = expected.select("path", c("size_bytes").alias("_s"), c("sha256").alias("_h"))
    theirs = actual.select("path", c("size_bytes").alias("_as"), c("sha256").alias("_ah"))
    both = mine.join(theirs, "path", "full_outer")
    change = (
        F.when(c("_ah").isNull(), "missing")
        .when(c("_h").isNull(), "unexpected")
        .when(~c("_s").eqNullSafe(c("_as")) | ~c("_h").eqNullSafe(c("_ah")), "changed")
    )
    return both.select("path", change.alias("change")).filter(c("change").isNotNull())


def training_chain(manifest: DataFrame, requested: DataFrame, copied: Sequence[str]) -> DataFrame:
    """Manifest rows against the shard index: missing, unexpected and differing rows (JON-19).

    ``requested``: split, replay_sha256, status (success or failure) and the copied fields.
    """
    c = F.col
    keys = ["split", "replay_sha256"]
    mine = manifest.select(*keys, F.lit(True).alias("_here"), *[c(f).alias(f"_m_{f}") for f in copied])
    theirs = requested.select(*keys, "status", *[c(f).alias(f"_s_{f}") for f in copied])
    both = mine.join(theirs, keys, "full_outer")
    done = c("_here") & (c("status") == "success")
    rules = {
        "missing_requested_replay": c("status").isNull(),
        "unexpected_requested_replay": c("_here").isNull(),
        **{
            f"manifest_shard_field_mismatch:{f}": F.coalesce(done, F.lit(False)) & ~c(f"_m_{f}").eqNullSafe(c(f"_s_{f}"))
            for f in copied
        },
    }
    return violations(both, F.concat_ws(":", *keys), rules)


def manifest_differences(published: DataFrame, recomputed: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """A published manifest against what its sources give now: missing and unexpected rows and each differing field (JON-20)."""
    c = F.col
    mine = published.select(key, F.lit(True).alias("_published"), *[c(f).alias(f"_p_{f}") for f in fields])
    again = recomputed.select(key, F.lit(True).alias("_again"), *[c(f).alias(f"_r_{f}") for f in fields])
    both = mine.join(again, key, "full_outer")
    rules = {
        "not_published": c("_published").isNull(),
        "not_in_sources": c("_again").isNull(),
        **{f"differs:{f}": c("_published") & c("_again") & ~c(f"_p_{f}").eqNullSafe(c(f"_r_{f}")) for f in fields},
    }
    return violations(both, c(key), rules)


def recomputation_check(published: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows that only one of two tables holds (JON-20)."""
    columns = published.columns
    again = recomputed.select(*columns)
    return (
        published.exceptAll(again)
        .withColumn("side", F.lit("published_only"))
        .unionByName(again.exceptAll(published).withColumn("side", F.lit("recomputed_only")))
    )


def snapshot_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows that differ between two snapshots (SET-03)."""
    gone = before.exceptAll(after).select(key, F.lit(-1).alias("_d"))
    new = after.exceptAll(before).select(key, F.lit(1).alias("_d"))
    sides = gone.unionByName(new).groupBy(key).agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    change = F.when(F.col("_lo") != F.col("_hi"), "changed").when(F.col("_hi") == 1, "added").otherwise("removed")
    return sides.select(key, change.alias("change"))


def ordered_root(rows: DataFrame, order: Sequence[str], columns: Sequence[str], *, fan_out: int = TREE_FAN_OUT) -> DataFrame:
    """Root of a hash tree over rows in their order (AGG-22): one row, rows and root; no row for an empty table.

    Leaves are digests of the rows, ranked in range parts. Every ``fan_out`` digests in order make one of the
    next level, until one is left, so a task never holds more than ``fan_out`` of them. Unlike
    :func:`inventory_digest` it changes when two rows change places. ``order`` must be total.
    """
    leaves = rows.select(*order, F.sha2(_written(columns), 256).alias("digest"))
    level = materialize(rank_within(leaves, [], [F.col(c) for c in order], rank="at").select("at", "digest"))
    n = level.count()
    size = n
    while size > 1:
        group = F.ceil(F.col("at") / fan_out)
        level = level.groupBy(group.alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("x")).select("at", F.sha2(F.array_join("x.digest", ""), 256).alias("digest"))
        size = -(-size // fan_out)
    return level.select(F.lit(n).cast("long").alias("rows"), F.col("digest").alias("root"))


def _written(columns: Sequence[str]) -> Column:
    """The fields of a row as one text: each with its length before it, null without one."""
    text = lambda c: F.col(c).cast("string")
    return F.concat(*[F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns])


def inventory_digest(rows: DataFrame, columns: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """Digest of the content of a table, whatever the order of its rows (AGG-22).

    Row digests are added up and xored, so the work is one partial aggregate and no row list is ever
    gathered. The published form names count, sum and xor through one SHA-256. A field is written with its
    length before it and null without one, so no value can be taken for a separator or for null.
    """
    number = F.conv(F.substring(F.sha2(_written(columns), 256), 1, 15), 16, 10).cast("long")
    grouped = rows.select(*key, number.alias("_n")).groupBy(*key)
    parts = grouped.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("_n").cast("decimal(38,0)")).alias("_sum"),
        F.bit_xor("_n").alias("_xor"),
    )
    text = F.concat_ws("|", F.col("rows").cast("string"), F.col("_sum").cast("string"), F.col("_xor").cast("string"))
    return parts.select(*key, "rows", F.sha2(text, 256).alias("digest"))


def arena_rollup(entries: DataFrame, matches: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows per split and stadium, goal difference and missing episodes of a self-play run (AGG-23)."""
    gaps = expected.join(entries.select("episode"), "episode", "left_anti").agg(F.count(F.lit(1)).alias("missing_episodes"))
    goals = matches.agg(F.sum(F.col("model_goals") - F.col("tactical_goals")).alias("arena_goal_difference"))
    wrong = F.when(F.col("episode") % 6 == 4, "validation").when(F.col("episode") % 6 == 5, "test").otherwise("train")
    splits = entries.groupBy("split").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.sum("rows").alias("rows"),
        F.count_if(F.col("stadium") == "Classic").alias("classic"),
        F.count_if(F.col("stadium") == "BFF").alias("bff"),
        F.count_if(F.col("split") != wrong).alias("misplaced"),
    )
    return attach(splits, gaps, goals)
