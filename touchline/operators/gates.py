"""Decisions on models: promotion, challenger gate, champion lineage, evidence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.scalars import composite_score
from touchline.operators.sequences import look_around
from touchline.session import computed_once, materialize

# Policy of the promotion and of the offline gate.
MINIMUM_GAMES, MINIMUM_LOWER_BOUND, MINIMUM_PASS_RATE = 500, 0.51, 0.98
MINIMUM_IMPROVEMENT, DIRECTION_SLACK, KICK_SLACK = 0.001, 0.02, 0.05
RATES = ("direction_accuracy", "joint_accuracy", "kick_f1")
# Generations of a lineage that one row folds at a time.
FOLD_ROWS = 1_000


def analysis_status(rows: DataFrame) -> DataFrame:
    """An analysis is complete only if it advanced through all frames but the last (FLT-06)."""
    short = (F.col("total_frames") > 0) & (F.col("frames_advanced") < F.greatest(F.col("total_frames") - 1, F.lit(0)))
    reason = F.format_string("incomplete_state_reconstruction:%d/%d", "frames_advanced", "total_frames")
    return rows.withColumns(
        {"status": F.when(short, "failed").otherwise("ok"), "error": F.when(short, reason)}
    )


def decide_promotions(evidence: DataFrame, *, allow_critical: bool = False) -> DataFrame:
    """Promote or reject with reasons (FLT-08).

    Columns: games, score_rate_lower_bound, scenarios_passed, scenarios_total, regressions
    array<struct<scenario, severity>>, reproducible.
    """
    c = F.col
    rate = c("scenarios_passed") / c("scenarios_total")
    critical = F.filter("regressions", lambda r: F.lower(r["severity"]) == "critical")
    failures = F.array_compact(
        F.array(
            F.when(c("games") < MINIMUM_GAMES, F.format_string(f"insufficient_games:%d<{MINIMUM_GAMES}", c("games"))),
            F.when(
                c("score_rate_lower_bound") < MINIMUM_LOWER_BOUND,
                F.format_string(
                    f"head_to_head_confidence_gate_failed:%.4f<{MINIMUM_LOWER_BOUND:.4f}", c("score_rate_lower_bound")
                ),
            ),
            F.when(c("scenarios_total") <= 0, "no_frozen_scenarios").when(
                rate < MINIMUM_PASS_RATE, F.format_string(f"scenario_pass_rate_failed:%.4f<{MINIMUM_PASS_RATE:.4f}", rate)
            ),
            F.when(
                (F.size(critical) > 0) & F.lit(not allow_critical),
                F.concat(F.lit("critical_regressions:"), F.array_join(F.transform(critical, lambda r: r["scenario"]), ",")),
            ),
            F.when(~c("reproducible"), "run_not_reproducible"),
        )
    )
    passed = F.array(
        *[
            F.lit(t)
            for t in (
                "head_to_head_gate_passed", "frozen_scenarios_passed", "no_blocking_regressions", "run_reproducible",
            )
        ]
    )
    return evidence.withColumn("_failures", failures).select(
        *evidence.columns,
        (F.size("_failures") == 0).alias("promote"),
        F.when(F.size("_failures") == 0, passed).otherwise(F.col("_failures")).alias("reasons"),
    )


def snapshot_issues(prefix: str, label: str) -> list[Column]:
    """What is wrong with a metric snapshot; null where a field is fine."""
    issues = []
    for field in RATES:
        value = F.col(f"{prefix}{field}")
        issues.append(
            F.when(value.isNull(), f"missing_{label}.{field}")
            .when(F.isnan(value) | (F.abs(value) == float("inf")), f"invalid_{label}.{field}:non_finite")
            .when(value < 0.0, f"invalid_{label}.{field}:below_minimum")
            .when(value > 1.0, f"invalid_{label}.{field}:above_maximum")
        )
    samples = F.col(f"{prefix}samples")
    issues.append(
        F.when(samples.isNull(), f"missing_{label}.samples")
        .when(samples != F.floor(samples), f"invalid_{label}.samples:not_integer")
        .when(samples < 1, f"invalid_{label}.samples:below_minimum")
    )
    return issues


def gate_candidates(pairs: DataFrame) -> DataFrame:
    """Candidate against champion on the frozen holdout; unusable evidence never promotes (FLT-09).

    Columns ``candidate_*`` and ``champion_*`` for the three rates and samples.
    """
    c = F.col
    issues = F.array_compact(
        F.array(*snapshot_issues("candidate_", "candidate"), *snapshot_issues("champion_", "champion"))
    )
    new = composite_score(c("candidate_joint_accuracy"), c("candidate_kick_f1"))
    old = composite_score(c("champion_joint_accuracy"), c("champion_kick_f1"))
    improved = new >= old + MINIMUM_IMPROVEMENT
    direction = c("candidate_direction_accuracy") < c("champion_direction_accuracy") - DIRECTION_SLACK
    kick = c("candidate_kick_f1") < c("champion_kick_f1") - KICK_SLACK
    usable = F.size("_issues") == 0
    promote = usable & improved & ~direction & ~kick
    short = F.format_string("insufficient_improvement:%.6f<%.6f", new, old + MINIMUM_IMPROVEMENT)
    reasons = F.array_compact(
        F.array(
            F.when(promote, "offline_holdout_gate_passed"),
            F.when(~improved, short),
            F.when(direction, "direction_accuracy_regression"),
            F.when(kick, "kick_f1_regression"),
        )
    )
    return pairs.withColumn("_issues", issues).select(
        *pairs.columns,
        promote.alias("promote"),
        F.when(usable, new).alias("candidate_score"),
        F.when(usable, old).alias("champion_score"),
        F.when(usable, new - old).alias("improvement"),
        F.when(usable, reasons).otherwise(F.col("_issues")).alias("reasons"),
    )


_RUN = ["generation", "direction_accuracy", "joint_accuracy", "kick_f1", "samples"]


def _beats(new: Column, old: Column) -> Column:
    better = composite_score(new["joint_accuracy"], new["kick_f1"]) >= (
        composite_score(old["joint_accuracy"], old["kick_f1"]) + MINIMUM_IMPROVEMENT
    )
    return (
        better
        & (new["direction_accuracy"] >= old["direction_accuracy"] - DIRECTION_SLACK)
        & (new["kick_f1"] >= old["kick_f1"] - KICK_SLACK)
    )


def usable_runs(runs: DataFrame) -> DataFrame:
    """Runs whose metrics are complete and in range."""
    return runs.filter(F.size(F.array_compact(F.array(*snapshot_issues("", "run")))) == 0)


def champions(runs: DataFrame, *, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """The champions of every lineage in order of generation (WIN-10).

    ``runs``: lineage, generation and metrics. A lineage starts with its first usable run and changes only
    when a later run passes the gate. The fold is sequential but carries one run: the next ``fold_rows``
    generations of every lineage are folded in a row each, and of the rest only runs that lift the new
    champion's score are kept, since no other can ever pass.
    """
    rows = usable_runs(runs).select("lineage", F.struct(*_RUN).alias("run"))
    current = rows.groupBy("lineage").agg(F.min_by("run", F.col("run.generation")).alias("champion"))
    out, left = current, rows

    def ahead(candidates: DataFrame, reigning: DataFrame) -> DataFrame:
        joined = candidates.join(reigning, "lineage")
        run, champion = F.col("run"), F.col("champion")
        higher = composite_score(run["joint_accuracy"], run["kick_f1"]) >= (
            composite_score(champion["joint_accuracy"], champion["kick_f1"]) + MINIMUM_IMPROVEMENT
        )
        return joined.filter((run["generation"] > champion["generation"]) & higher).select("lineage", "run")

    fold = F.aggregate(
        F.sort_array(F.collect_list("run")),
        F.array(F.first("champion")),
        lambda chain, run: F.when(
            (run["generation"] > F.element_at(chain, -1)["generation"]) & _beats(run, F.element_at(chain, -1)),
            F.concat(chain, F.array(run)),
        ).otherwise(chain),
    )
    by_generation = Window.partitionBy("lineage").orderBy("run.generation")
    while not (left := materialize(ahead(left, current))).isEmpty():
        chunk = left.withColumn("_n", F.rank().over(by_generation)).filter(F.col("_n") <= fold_rows)
        chains = materialize(
            chunk.join(current, "lineage").groupBy("lineage").agg(fold.alias("chain"), F.max("run.generation").alias("_upto"))
        )
        out = out.unionByName(chains.select("lineage", F.explode(F.filter("chain", lambda run, i: i > 0)).alias("champion")))
        reached = chains.select("lineage", F.element_at("chain", -1).alias("champion"))
        current = materialize(reached.unionByName(current.join(reached.select("lineage"), "lineage", "left_anti")))
        left = left.join(chains.select("lineage", "_upto"), "lineage").filter(F.col("run.generation") > F.col("_upto")).select("lineage", "run")
    return out.select("lineage", "champion.*")


def lineage(runs: DataFrame, *, parts: int | None = None, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Every run with the champion it challenged, the decision and its status (WIN-10)."""
    reigning = champions(runs, fold_rows=fold_rows).select("lineage", "generation", F.lit(True).alias("_crowned"))
    marked = runs.join(reigning, ["lineage", "generation"], "left")
    parent = F.when(F.col("_crowned"), F.struct("generation", *RATES, "samples"))
    seen = look_around(marked, ["lineage"], "generation", before={"_parent": parent}, parts=parts)
    pairs = seen.select(
        "lineage",
        "generation",
        F.col("_parent.generation").alias("parent_generation"),
        *[F.col(f).alias(f"candidate_{f}") for f in (*RATES, "samples")],
        *[F.col(f"_parent.{f}").alias(f"champion_{f}") for f in (*RATES, "samples")],
    )
    judged = gate_candidates(pairs)
    return judged.withColumn(
        "status",
        F.when(F.col("parent_generation").isNull(), "founding")
        .when(F.col("promote"), "promoted_offline")
        .otherwise("rejected_offline"),
    )


def failure_inventory(judged: DataFrame) -> DataFrame:
    """Rejected candidates with their reasons (ML-04)."""
    return judged.filter(F.col("status") == "rejected_offline").select(
        "lineage", "generation", "parent_generation", "candidate_score", "champion_score", "improvement", "reasons",
        F.lit("continue_with_next_bounded_experiment").alias("next_action"),
    )


# What the strictest gate asks of an evidence document.
GATE_ROLES = ("gk", "dm", "am", "st")
GATE_SPLIT_FIELDS = ("samples", "direction_accuracy", "kick_f1", "kick_true_rate", "kick_predicted_rate")


def gate_evidence_issues(documents: DataFrame, column: str = "document", split: str = "final_holdout") -> DataFrame:
    """Everything a VARIANT evidence document lacks for the strictest gate (FLT-10)."""
    rows = computed_once(documents, _document=F.col(column))
    at = lambda path: F.try_variant_get("_document", f"$.{path}", "variant")
    is_object = lambda path: F.coalesce(F.schema_of_variant(at(path)).startswith("OBJECT"), F.lit(False))
    absent = lambda path: at(path).isNull()
    need = lambda inside, path: F.when(inside & absent(path), f"missing_{path}")
    held = is_object(split)
    frozen, source = "training.frozen_holdout_used_for_selection", "training.kick_threshold_source"
    is_false = F.coalesce(~F.try_variant_get("_document", f"$.{frozen}", "boolean"), F.lit(False))
    validated = F.coalesce(F.try_variant_get("_document", f"$.{source}", "string") == "validation_only", F.lit(False))
    issues = [
        F.when(~is_object("training"), "missing_training"),
        F.when(absent(frozen), f"missing_{frozen}").when(~is_false, f"{frozen}_must_be_false"),
        F.when(absent(source), f"missing_{source}").when(~validated, f"{source}_must_be_validation_only"),
        F.when(~is_object("final_validation"), "missing_final_validation").when(
            absent("final_validation.direction_accuracy"), "missing_final_validation.direction_accuracy"
        ),
        F.when(~held, f"missing_{split}"),
        *[need(held, f"{split}.{f}") for f in GATE_SPLIT_FIELDS],
    ]

    def with_baseline(inside: Column, path: str) -> Column:
        base = f"{path}.baselines"
        return F.when(inside & ~is_object(base), f"missing_{base}").when(
            inside & absent(f"{base}.majority_direction_accuracy"), f"missing_{base}.majority_direction_accuracy"
        )

    issues.append(with_baseline(held, split))
    issues.append(F.when(held & ~is_object(f"{split}.by_role"), f"missing_{split}.by_role"))
    for role in GATE_ROLES:
        path = f"{split}.by_role.{role}"
        issues.append(F.when(held & ~is_object(path), f"missing_{path}"))
        issues.append(need(is_object(path), f"{path}.direction_accuracy"))
        issues.append(with_baseline(is_object(path), path))
    return rows.withColumn("issues", F.array_compact(F.array(*issues))).drop("_document")
