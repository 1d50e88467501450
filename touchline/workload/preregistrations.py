"""Generation states and preregistrations written as documents from the given runs, each rule broken in some."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline import adapters
from touchline.functions.scalars import tuned_variant
from touchline.operators import preregistration as R
from touchline.session import computed_once, spread
from touchline.workload.registry import query
from touchline.workload.table_audits import _checks

_ID = "'gen-' || printf('%04d', g)"
_RUN_ROWS = "r AS (SELECT p_partkey AS g, p_size FROM part)"

# Which generations break a rule: every one that the number divides.
_BROKEN = {
    "schema_mismatch": 11, "generation_mismatch": 13, "manifest_sha256_mismatch": 17, "parent_champion_mismatch": 19, "train_index_mismatch": 23,
    "holdout_not_frozen": 29, "max_epochs_mismatch": 31, "no_external_ai_calls_required": 37, "paper_or_offline_only_required": 41,
    "max_hidden_dim_mismatch": 43, "hyperparameters_mismatch": 47, "seed_mismatch": 53, "generation_invalid": 59, "experiment_id_mismatch": 61,
    "sha256_mismatch": 67, "sha256_invalid": 71, "split_invalid": 73, "budget_invalid": 79, "invalid_preregistration:not_object": 83,
    "analysis_version_mismatch": 89, "holdout_index_mismatch": 97,
}


def _where(rule: str) -> str:
    own = f"g % {_BROKEN[rule]} = 0"
    if rule == "invalid_preregistration:not_object":
        return own
    hidden = {"generation_mismatch": ["generation_invalid"], "sha256_mismatch": ["sha256_invalid"]}.get(rule, [])
    if rule in ("train_index_mismatch", "holdout_index_mismatch", "holdout_not_frozen"):
        hidden = ["split_invalid"]
    if rule in ("max_epochs_mismatch", "max_hidden_dim_mismatch", "no_external_ai_calls_required", "paper_or_offline_only_required"):
        hidden = ["budget_invalid"]
    return " AND ".join([own, *[f"g % {_BROKEN[h]} <> 0" for h in [*hidden, "invalid_preregistration:not_object"]]])


@query("preregistration_audit", "AUD-10 PRJ-21", f"WITH {_RUN_ROWS} {_checks('', [(rule, _ID, 'r', _where(rule)) for rule in _BROKEN])}")
def preregistration_audit(spark, folder):
    g = F.col("generation")
    broken = lambda rule: g % _BROKEN[rule] == 0
    unless = lambda rule, good, bad: F.when(broken(rule), bad).otherwise(good)
    settings = tuned_variant(g)
    # decimals are written as text and lose their quotes below, so that they stand in the document as they are
    decimal = lambda value: F.regexp_replace(value.cast("decimal(10,5)").cast("string"), "0+$", "")
    index = lambda side: F.lit(f"shards/{side}/_index.json")
    numbers = {n: decimal(v) if n in ("l2", "learning_rate") else v for n, v in settings.items()}
    numbers["l2"] = unless("hyperparameters_mismatch", numbers["l2"], F.lit("0.3"))
    split = F.struct(
        unless("holdout_index_mismatch", index("holdout"), index("other")).alias("holdout_index"),
        (~broken("holdout_not_frozen")).alias("holdout_is_frozen"),
        unless("train_index_mismatch", index("train"), index("other")).alias("train_index"),
    )
    budget = F.struct(
        unless("max_epochs_mismatch", F.lit(8), F.lit(80)).alias("max_epochs"), unless("max_hidden_dim_mismatch", F.lit(128), F.lit(64)).alias("max_hidden_dim"),
        (~broken("no_external_ai_calls_required")).alias("no_external_ai_calls"), (~broken("paper_or_offline_only_required")).alias("paper_or_offline_only"),
    )
    document = F.struct(
        unless("analysis_version_mismatch", F.lit("v7"), F.lit("v6")).alias("analysis_version"),
        F.when(~broken("budget_invalid"), budget).alias("budget"),
        unless("manifest_sha256_mismatch", F.sha2(F.lit("manifest"), 256), F.lit("0")).alias("dataset_manifest_sha256"),
        unless("experiment_id_mismatch", F.concat(F.lit("gen-"), F.format_string("%04d", g)), F.lit("gen-x")).alias("experiment_id"),
        unless("generation_invalid", unless("generation_mismatch", g, g + 1).cast("string"), F.lit("one")).alias("generation"),
        F.struct(*[numbers[n].alias(n) for n in sorted(numbers)]).alias("hyperparameters"),
        unless("parent_champion_mismatch", F.concat(F.lit("champion-"), (g - 1).cast("string")), F.lit("stranger")).alias("parent_champion"),
        unless("schema_mismatch", F.lit("preregistration-v1"), F.lit("v0")).alias("schema"),
        unless("seed_mismatch", settings["seed"], F.lit(1)).alias("seed"),
        F.when(~broken("split_invalid"), split).alias("split"),
    )
    runs = spread(adapters.runs(spark, folder), "generation")
    runs = computed_once(runs, canonical=F.regexp_replace(F.to_json(document), '"([0-9]+|0[.][0-9]+)"', "$1"))
    canonical = F.col("canonical")
    digest = unless("sha256_mismatch", F.sha2(canonical, 256), F.sha2(F.lit("other"), 256))
    member = unless("sha256_invalid", F.concat(F.lit('"'), digest, F.lit('"')), F.lit("7"))
    # the digest stands first, so the keys of the written document are not in order
    whole = F.concat(F.lit('{ "preregistration_sha256": '), member, F.lit(", "), F.substring(canonical, 2, 1 << 30))
    written = unless("invalid_preregistration:not_object", whole, F.concat(F.lit("["), whole, F.lit("]")))
    rows = runs.select(
        "generation",
        F.parse_json(written).alias("preregistration"),
        F.concat(F.lit("champion-"), (g - 1).cast("string")).alias("parent"),
        F.lit("v7").alias("analysis_version"),
        F.sha2(F.lit("manifest"), 256).alias("manifest_sha256"),
        F.lit("shards").alias("shard_root"),
    )
    subject = F.concat(F.lit("gen-"), F.format_string("%04d", g))
    return R.audit_preregistrations(rows, subject, schema="preregistration-v1").select("subject", "check")


_LABEL = "generation_state.champion.metrics"
_WHOLE = "g % 11 <> 0 AND g % 13 <> 0"
_STATES = [
    ("invalid_generation_state:not_object", "g % 11 = 0"),
    ("generation_state.champion_invalid", "g % 13 = 0 AND g % 11 <> 0"),
    ("generation_state.schema_mismatch", "g % 17 = 0 AND g % 11 <> 0"),
    ("generation_state.analysis_version_mismatch", "g % 19 = 0 AND g % 11 <> 0"),
    ("generation_state.manifest_sha256_invalid", "g % 23 = 0 AND g % 11 <> 0"),
    ("generation_state.manifest_sha256_mismatch", "g % 29 = 0 AND g % 23 <> 0 AND g % 11 <> 0"),
    ("generation_state.champion_id_invalid", f"g % 31 = 0 AND {_WHOLE}"),
    ("generation_state.champion_score_invalid", f"g % 37 = 0 AND {_WHOLE}"),
    ("generation_state.champion_score_mismatch", f"g % 53 = 0 AND g % 37 <> 0 AND g % 41 <> 0 AND g % 43 <> 0 AND g % 47 <> 0 AND {_WHOLE}"),
    (f"missing_{_LABEL}.joint_accuracy", f"g % 41 = 0 AND {_WHOLE}"),
    (f"invalid_{_LABEL}.joint_accuracy:above_maximum", f"g % 43 = 0 AND g % 41 <> 0 AND {_WHOLE}"),
    (f"invalid_{_LABEL}.samples:non_numeric", f"g % 47 = 0 AND {_WHOLE}"),
]


@query("generation_state_audit", "AUD-10 FLT-10", f"WITH {_RUN_ROWS} {_checks('', [(rule, _ID, 'r', where) for rule, where in _STATES])}")
def generation_state_audit(spark, folder):
    g = F.col("generation")
    joint = F.when(g % 41 != 0, F.when(g % 43 == 0, 1.5).otherwise(F.col("rate")))
    number = F.when(g % 53 == 0, 0.0001).otherwise(0.7 * joint + 0.3 * F.col("kick_f1"))
    text = lambda value: F.concat(F.lit('"'), value.cast("string"), F.lit('"'))
    samples = F.when(g % 47 == 0, text(F.lit(9))).otherwise(F.lit("9"))
    score = F.when(g % 37 == 0, F.lit("true")).otherwise(F.coalesce(number, F.lit(0.5)).cast("string"))
    metrics = F.concat(
        F.lit('{"direction_accuracy":0.5,"kick_f1":'), F.col("kick_f1").cast("string"), F.lit(',"samples":'), samples,
        F.when(joint.isNull(), "").otherwise(F.concat(F.lit(',"joint_accuracy":'), joint.cast("string"))), F.lit("}"),
    )
    champion = F.concat(F.lit('{"id":'), text(F.when(g % 31 == 0, " ").otherwise("c")), F.lit(',"metrics":'), metrics, F.lit(',"score":'), score, F.lit("}"))
    manifest = F.when(g % 23 == 0, F.lit("7")).otherwise(text(F.when(g % 29 == 0, "other").otherwise("m")))
    state = F.concat(
        F.lit('{"schema":'), text(F.when(g % 17 == 0, "v0").otherwise("state-v1")), F.lit(',"analysis_version":'), text(F.when(g % 19 == 0, "v6").otherwise("v7")),
        F.lit(',"manifest_sha256":'), manifest, F.lit(',"champion":'), F.when(g % 13 == 0, F.lit("null")).otherwise(champion), F.lit("}"),
    )
    runs = spread(adapters.runs(spark, folder), "generation").withColumn("rate", (g % 100 + 1) / F.lit(128.0))
    rows = runs.select(
        "generation", F.parse_json(F.when(g % 11 == 0, F.lit("[1]")).otherwise(state)).alias("state"), F.lit("v7").alias("analysis_version"), F.lit("m").alias("manifest_sha256")
    )
    subject = F.concat(F.lit("gen-"), F.format_string("%04d", g))
    return R.audit_generation_states(rows, subject, schema="state-v1").select("subject", "check")
