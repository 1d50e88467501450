"""Audit of a published training manifest: header, selection, replays and members, in their published order (AUD-03).

The lists of a manifest are flat tables with the place of each row, so none of them is gathered: orders are
looked at across range parts, memberships are anti-joins, and counts are partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.audits import duplicates, not_clean, not_close, not_in_range, not_sha256, out_of_order, violations
from touchline.operators.rows import attach


def audit_selection(selected: DataFrame) -> DataFrame:
    """Selected players: score arithmetic, ranges, unique ids, best first.

    Columns: position (unique), player_id, role, rating, rating_uncertainty, conservative_score, matches, minutes.
    """
    c = F.col
    rules = {
        "selection.player_id": not_clean(c("player_id")),
        "selection.role": not_clean(c("role")),
        "selection.rating": not_in_range(c("rating")),
        "selection.rating_uncertainty": not_in_range(c("rating_uncertainty"), 0),
        "selection.conservative_score": not_close(c("conservative_score"), c("rating") - c("rating_uncertainty"), 1e-9),
        "selection.matches": not_in_range(c("matches"), 0),
        "selection.minutes": not_in_range(c("minutes"), 0),
    }
    order = F.struct("conservative_score", "rating", "matches")
    return (
        violations(selected, c("player_id"), rules)
        .unionByName(duplicates(selected, ["player_id"], "selection.duplicate_player"))
        .unionByName(out_of_order(selected, "position", c("player_id"), order, "selection.not_in_order"))
    )


def _audit_few_members(members: DataFrame, selected: DataFrame, rules: dict[str, Column], order: Column) -> DataFrame:
    """All rules on single members in one pass over rows that are dealt by replay, a replay's in one task."""
    own = Window.partitionBy("replay_sha256").orderBy("position")
    same = Window.partitionBy("replay_sha256", "replay_player_id").orderBy("position")
    copies = F.count(F.lit(1)).over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = members.withColumns({"_prev": F.lag(order).over(own), "_again": F.row_number().over(same), "_copies": copies})
    known = selected.select(F.col("player_id").alias("identity"), F.lit(True).alias("_known")).distinct()
    met = marked.join(known, "identity", "left")

    def found(broken: Column, check: str, detail: Column, *subject: str) -> Column:
        text = F.concat_ws("|", *[F.col(s).cast("string") for s in subject]) if len(subject) > 1 else F.col(subject[0]).cast("string")
        return F.when(broken, F.struct(text.alias("subject"), F.lit(check).alias("check"), detail.cast("string").alias("detail")))

    sha, who = "replay_sha256", F.col("identity")
    return met.select(F.inline(F.array_compact(F.array(
        *[found(broken, name, who, sha) for name, broken in rules.items()],
        found(F.col("_known").isNull(), "members.unselected", who, sha),
        found((F.col("_again") == 1) & (F.col("_copies") > 1), "members.repeated_id", F.col("_copies"), sha, "replay_player_id"),
        found(order < F.col("_prev"), "members.not_in_order", F.lit(""), sha),
    ))))


def audit_members(members: DataFrame, entries: DataFrame, selected: DataFrame, *, few: bool = False) -> DataFrame:
    """Players of the manifest's replays: selected, counted, one row an id, ordered by id and identity.

    ``members``: replay_sha256, position (unique in its replay), replay_player_id, identity, samples.
    ``entries``: replay_sha256, selected_player_count. A replay without members and members without a replay
    both break the count. With ``few`` every replay has so few members that they stay together, and rows that are
    dealt by ``replay_sha256`` do not move again; without, a replay may have any number.
    """
    c = F.col
    rules = {
        "members.identity": not_clean(c("identity")),
        "members.replay_player_id": not_in_range(c("replay_player_id"), 0),
        "members.samples": not_in_range(c("samples"), 1),
    }
    counted = members.groupBy("replay_sha256").agg(F.count(F.lit(1)).alias("_n"))
    both = entries.select("replay_sha256", "selected_player_count").join(counted, "replay_sha256", "full_outer")
    miscounted = violations(both, c("replay_sha256"), {"members.count": ~c("selected_player_count").eqNullSafe(c("_n"))})
    order = F.struct("replay_player_id", "identity")
    if few:
        return _audit_few_members(members, selected, rules, order).unionByName(miscounted)
    strangers = members.join(selected.select(c("player_id").alias("identity")), "identity", "left_anti")
    return (
        violations(members, c("replay_sha256"), rules, c("identity"))
        .unionByName(violations(strangers, c("replay_sha256"), {"members.unselected": F.lit(True)}, c("identity")))
        .unionByName(miscounted)
        .unionByName(duplicates(members, ["replay_sha256", "replay_player_id"], "members.repeated_id"))
        .unionByName(out_of_order(members, "position", c("replay_sha256"), order, "members.not_in_order", keys=["replay_sha256"], descending=False))
    )


def audit_replay_order(entries: DataFrame) -> DataFrame:
    """Replays ascend strictly by hash inside their split. Columns: split, position (unique in its split), replay_sha256."""
    key = F.col("replay_sha256")
    return out_of_order(entries.select("split", "position", key), "position", key, key, "replays.not_in_order", keys=["split"], descending=False, strict=True)


def audit_header(headers: DataFrame, entries: DataFrame, selected: DataFrame) -> DataFrame:
    """Settings of a manifest, and its published counts against its lists.

    ``headers``: one row per published header: manifest, analysis_version, generated_at, analysis_root, raw_root,
    leaderboard_sha256, leaderboard_size_bytes, the settings of the selection and the counts. The lists are counted once.
    """
    c = F.col
    lists = entries.agg(F.count_if(c("split") == "train").alias("_train"), F.count_if(c("split") == "holdout").alias("_holdout"))
    h = attach(headers, lists, selected.agg(F.count(F.lit(1)).alias("_selected")))
    zone = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
    climbs = lambda path: F.array_contains(F.split(c(path), "/"), "..")
    rules = {
        "analysis_version": not_clean(c("analysis_version")) | c("analysis_version").rlike(r"[/\\]"),
        "generated_at": F.coalesce(~c("generated_at").rlike(zone) | c("generated_at").try_cast("timestamp").isNull(), F.lit(True)),
        "analysis_root": not_clean(c("analysis_root")) | climbs("analysis_root"),
        "raw_root": not_clean(c("raw_root")) | climbs("raw_root"),
        "leaderboard_sha256": not_sha256(c("leaderboard_sha256")),
        "leaderboard_size_bytes": not_in_range(c("leaderboard_size_bytes"), 1),
        "top_fraction_per_role": not_in_range(c("top_fraction_per_role"), 0, 1),
        "min_players_per_role": not_in_range(c("min_players_per_role"), 1),
        "min_matches": not_in_range(c("min_matches"), 1),
        "min_minutes": not_in_range(c("min_minutes"), 0),
        "max_uncertainty": not_in_range(c("max_uncertainty"), 0),
        "holdout_modulus": not_in_range(c("holdout_modulus"), 2),
        "holdout_bucket": not_in_range(c("holdout_bucket"), 0) | F.coalesce(c("holdout_bucket") >= c("holdout_modulus"), F.lit(True)),
        "rejected_exceeds_scanned": F.coalesce(c("quality_rejected") > c("analysis_files_scanned"), F.lit(True)),
        "published_exceeds_scanned": F.coalesce(c("_train") + c("_holdout") > c("analysis_files_scanned"), F.lit(True)),
        "selected_player_count": ~c("selected_player_count").eqNullSafe(c("_selected")),
        "train_replay_count": ~c("train_replay_count").eqNullSafe(c("_train")),
        "holdout_replay_count": ~c("holdout_replay_count").eqNullSafe(c("_holdout")),
    }
    return violations(h, c("manifest"), {f"header.{name}": broken for name, broken in rules.items()})


def audit_manifest_lists(headers: DataFrame, selected: DataFrame, entries: DataFrame, members: DataFrame) -> DataFrame:
    """All rules on what a manifest says of itself; :func:`~touchline.operators.audits.audit_manifest_replays` has those on single replays."""
    return (
        audit_header(headers, entries, selected)
        .unionByName(audit_selection(selected))
        .unionByName(audit_replay_order(entries))
        .unionByName(audit_members(members, entries, selected))
    )
