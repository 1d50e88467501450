"""Match quality: a score from the evidence that is known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bad(value: Column, low: float | None = None, high: float | None = None) -> Column:
    wrong = F.isnan(value.cast("double")) | (F.abs(value.cast("double")) == float("inf"))
    if low is not None:
        wrong = wrong | (value < low)
    if high is not None:
        wrong = wrong | (value > high)
    return F.coalesce(wrong, F.lit(False))


def assess_matches(evidence: DataFrame) -> DataFrame:
    """Tier, weight, reasons and missing evidence of every match (FLT-03).

    Evidence columns are nullable; unknown is never taken for good. Impossible values reject the match.
    """
    c = F.col
    invalid = F.array_sort(
        F.array_compact(
            F.array(
                F.when(c("replay_valid").isNull(), "invalid_replay_valid"),
                F.when(_bad(c("duration_seconds"), 0), "invalid_duration_seconds"),
                F.when(_bad(c("expected_player_count"), 1), "invalid_expected_player_count"),
                F.when(_bad(c("observed_player_count"), 0), "invalid_observed_player_count"),
                F.when(_bad(c("disconnect_count"), 0), "invalid_disconnect_count"),
                F.when(_bad(c("activity_ratio"), 0, 1), "invalid_activity_ratio"),
                F.when(_bad(c("parser_completeness"), 0, 1), "invalid_parser_completeness"),
            )
        )
    )
    counted = c("expected_player_count").isNotNull() & c("observed_player_count").isNotNull()
    observed, expected = c("observed_player_count"), c("expected_player_count")
    # Each rule is (condition, reason, change of the score); the first that holds in a group counts.
    rules = [
        [(c("duration_seconds") < 60, "very_short_match", -0.30), (c("duration_seconds") >= 240, "meaningful_duration", 0.10)],
        [
            (counted & (observed < expected), "incomplete_player_count", -0.20),
            (counted & (observed > expected), "excess_player_count", -0.20),
            (counted, "expected_player_count_present", 0.05),
        ],
        [
            (c("disconnect_count") > 0, "disconnects_present", -F.least(F.lit(0.25), c("disconnect_count") * 0.08)),
            (c("disconnect_count") == 0, "no_detected_disconnects", 0.05),
        ],
        [(c("activity_ratio") < 0.5, "low_activity", -0.20), (c("activity_ratio") >= 0.8, "healthy_activity", 0.05)],
        [
            (c("parser_completeness") < 0.8, "low_parser_completeness", -0.30),
            (c("parser_completeness") >= 0.98, "high_parser_completeness", 0.10),
        ],
        [(~c("stadium_supported"), "unsupported_stadium", -0.20)],
        [(~c("has_reliable_player_identities"), "uncertain_player_identity", -0.10)],
    ]

    def chosen(group, pick, default):
        out = None
        for rule in group:
            value = pick(rule)
            value = value if isinstance(value, Column) else F.lit(value)
            out = F.when(rule[0], value) if out is None else out.when(rule[0], value)
        return out.otherwise(default) if default is not None else out

    score = reduce(lambda a, b: a + b, [chosen(g, lambda r: r[2], F.lit(0.0)) for g in rules], F.lit(0.5))
    reasons = F.array_compact(F.array(*[chosen(g, lambda r: r[1], None) for g in rules]))
    missing = F.array_sort(
        F.array_compact(
            F.array(
                F.when(c("duration_seconds").isNull(), "duration_seconds"),
                F.when(~counted, "player_count"),
                F.when(c("disconnect_count").isNull(), "disconnect_count"),
                F.when(c("activity_ratio").isNull(), "activity_ratio"),
                F.when(c("parser_completeness").isNull(), "parser_completeness"),
                F.when(c("stadium_supported").isNull(), "stadium_supported"),
                F.when(c("has_reliable_player_identities").isNull(), "player_identity_confidence"),
            )
        )
    )
    none = F.array().cast("array<string>")
    judged = evidence.withColumns(
        {
            "_invalid": invalid,
            "_score": F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)),
            "_reasons": reasons,
            "_missing": missing,
        }
    )
    rejected = F.size("_invalid") > 0
    unusable = rejected | ~c("replay_valid")
    tier = (
        F.when(unusable | (c("_score") < 0.25), "rejected")
        .when(c("_score") < 0.45, "bronze")
        .when(c("_score") < 0.65, "silver")
        .when((c("_score") < 0.85) | (F.size("_missing") > 0), "gold")
        .otherwise("elite")
    )
    capped = (c("_score") >= 0.85) & (F.size("_missing") > 0)
    shown = (
        F.when(rejected, c("_invalid"))
        .when(unusable, F.array(F.lit("invalid_replay")))
        .when(capped, F.concat(c("_reasons"), F.array(F.lit("elite_capped_by_missing_evidence"))))
        .otherwise(c("_reasons"))
    )
    return judged.select(
        *evidence.columns,
        tier.alias("tier"),
        F.when(unusable, 0.0).otherwise(F.bround("_score", 4)).alias("weight"),
        shown.alias("reasons"),
        F.when(unusable, none).otherwise(c("_missing")).alias("missing_evidence"),
    )
