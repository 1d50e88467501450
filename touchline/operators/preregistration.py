"""Generation state and preregistration as nested documents (AUD-10).

Documents are VARIANT values. A rule looks at the type a value was written with before it compares it, and
the self digest is the SHA-256 of the document's canonical JSON without the digest itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.native_types import field, has_native_type, is_object
from touchline.functions.scalars import composite_score, tuned_variant
from touchline.operators.audits import not_close, violations
from touchline.session import computed_once

# Rates of a metric snapshot, the limits of the search budget, tolerance of a score.
RATES = ("direction_accuracy", "joint_accuracy", "kick_f1")
MAX_EPOCHS, MAX_HIDDEN = 8, 128

#: Strings, numbers and what stands between them in JSON.
_TOKENS = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'


def canonical_json(document: Column) -> Column:
    """JSON of a VARIANT with the keys sorted at every depth, without blanks.

    Numbers that were written with an exponent get one of two digits at least (``1e-05``); whole numbers are
    written without a fraction.
    """

    def plain(token: Column) -> Column:
        power = F.regexp_extract(token, r"E-?([0-9]+)$", 1)
        sign = F.when(token.contains("E-"), "-").otherwise("+")
        head = F.regexp_replace(F.regexp_extract(token, "^([^E]*)E", 1), r"\.0$", "")
        number = F.concat(head, F.lit("e"), sign, F.lpad(power, F.greatest(F.lit(2), F.length(power)), "0"))
        return F.when(token.rlike("^-?[0-9.]+E-?[0-9]+$"), number).otherwise(token)

    tokens = F.regexp_extract_all(F.to_json(document), F.lit(_TOKENS), F.lit(0))
    return F.array_join(F.transform(tokens, plain), "")


def self_digest(document: Column, name: str) -> Column:
    """SHA-256 of an object's canonical JSON without its member ``name``."""
    members = F.map_filter(F.try_variant_get(document, "$", "map<string,variant>"), lambda key, _: key != name)
    return F.sha2(canonical_json(F.to_variant_object(members)), 256)


def _text(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _differs_from_text(value: Column, expected: Column) -> Column:
    absent = value.isNull() | F.is_variant_null(value)
    return F.when(absent, expected.isNotNull()).otherwise(~_text(value).eqNullSafe(expected))


def _is_true(value: Column) -> Column:
    return F.coalesce((F.schema_of_variant(value) == "BOOLEAN") & F.try_variant_get(value, "$", "boolean"), F.lit(False))


def _number(value: Column) -> Column:
    written = F.schema_of_variant(value)
    return F.when(written.isin("BIGINT", "DOUBLE") | written.startswith("DECIMAL"), F.try_variant_get(value, "$", "double"))


def _is_number(value: Column, expected: Column | int) -> Column:
    return F.coalesce(_number(value) == F.lit(expected), F.lit(False))


def _metric_values(metrics: Column) -> dict[str, Column]:
    """What :func:`metric_rules` reads of a snapshot of metrics inside a document."""
    values = {"_measured": F.coalesce(is_object(metrics), F.lit(False))}
    for name in (*RATES, "samples"):
        values |= {f"_has_{name}": field(metrics, name).isNotNull(), f"_value_{name}": _number(field(metrics, name))}
    return values


def metric_rules(label: str) -> dict[str, Column]:
    """What is wrong with a snapshot of metrics, from the columns of :func:`_metric_values`."""
    there = F.col("_measured")
    rules = {f"invalid_{label}:not_object": ~there}
    for name in (*RATES, "samples"):
        given, number = F.col(f"_has_{name}"), F.col(f"_value_{name}")
        finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
        rules[f"missing_{label}.{name}"] = there & ~given
        rules[f"invalid_{label}.{name}:non_numeric"] = there & given & number.isNull()
        rules[f"invalid_{label}.{name}:non_finite"] = there & number.isNotNull() & ~finite
        if name == "samples":
            whole = number == F.floor(number)
            rules[f"invalid_{label}.{name}:not_integer"] = there & finite & ~whole
            rules[f"invalid_{label}.{name}:below_minimum"] = there & finite & whole & (number < 1)
        else:
            rules[f"invalid_{label}.{name}:below_minimum"] = there & finite & (number < 0)
            rules[f"invalid_{label}.{name}:above_maximum"] = there & finite & (number > 1)
    return rules


def audit_generation_states(rows: DataFrame, subject: Column, *, schema: str) -> DataFrame:
    """Recorded generation states against the analysis and the manifest they belong to.

    ``rows``: state (VARIANT), analysis_version, manifest_sha256.
    """
    c = F.col
    state = c("_document")
    rows = computed_once(rows, _document=c("state"), _subject=subject)
    rows = computed_once(rows, _there=F.coalesce(is_object(state), F.lit(False)), _champion=field(state, "champion"))
    champion = c("_champion")
    rows = computed_once(rows, _crowned=c("_there") & F.coalesce(is_object(champion), F.lit(False)), _metrics=field(champion, "metrics"), _number=_number(field(champion, "score")))
    there, crowned, metrics, number = c("_there"), c("_crowned"), c("_metrics"), c("_number")
    rows = computed_once(rows, **_metric_values(metrics))
    of_metrics = metric_rules("generation_state.champion.metrics")
    sound = F.lit(True)
    for broken in of_metrics.values():
        sound = sound & ~F.coalesce(broken, F.lit(False))
    manifest = field(state, "manifest_sha256")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    expected = composite_score(c("_value_joint_accuracy"), c("_value_kick_f1"))
    rules = {
        "invalid_generation_state:not_object": ~there,
        "generation_state.schema_mismatch": there & _differs_from_text(field(state, "schema"), F.lit(schema)),
        "generation_state.analysis_version_mismatch": there & _differs_from_text(field(state, "analysis_version"), c("analysis_version")),
        "generation_state.manifest_sha256_invalid": there & _text(manifest).isNull(),
        "generation_state.manifest_sha256_mismatch": there & (_text(manifest) != c("manifest_sha256")),
        "generation_state.champion_invalid": there & ~crowned,
        "generation_state.champion_id_invalid": crowned & (F.coalesce(F.trim(_text(field(champion, "id"))), F.lit("")) == ""),
        "generation_state.champion_score_invalid": crowned & number.isNull(),
        "generation_state.champion_score_non_finite": crowned & number.isNotNull() & ~finite,
        "generation_state.champion_score_mismatch": crowned & finite & sound & not_close(number, expected),
        **{name: crowned & broken for name, broken in of_metrics.items()},
    }
    return violations(rows, c("_subject"), rules)


def audit_preregistrations(rows: DataFrame, subject: Column, *, schema: str) -> DataFrame:
    """Preregistrations against the generation, the parent champion, the frozen split and the search budget.

    ``rows``: preregistration (VARIANT), generation, parent (id of the champion in the state), analysis_version,
    manifest_sha256, shard_root.
    """
    c = F.col
    document = c("_document")
    of = lambda name: field(document, name)
    rows = computed_once(rows, _document=c("preregistration"), _subject=subject, **{f"_due_{n}": v for n, v in tuned_variant(c("generation")).items()})
    rows = computed_once(
        rows, _there=F.coalesce(is_object(document), F.lit(False)), _split=of("split"), _budget=of("budget"), _settings=of("hyperparameters"),
        _stored=_text(of("preregistration_sha256")), _written=F.schema_of_variant(of("generation")),
    )
    there = c("_there")
    expected = {n: c(f"_due_{n}") for n in tuned_variant(c("generation"))}
    number = c("generation").cast("string")
    experiment = F.concat(F.lit("gen-"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), "0"))
    split, budget, settings = c("_split"), c("_budget"), c("_settings")
    rows = computed_once(rows, **{f"_has{n}": F.coalesce(is_object(c(n)), F.lit(False)) & there for n in ("_split", "_budget")})
    has_split, has_budget = c("_has_split"), c("_has_budget")
    shape = T.StructType([T.StructField(n, T.DoubleType(), False) for n in expected])
    same = has_native_type(settings, shape, False) & (F.size(F.try_variant_get(settings, "$", "map<string,variant>")) == len(expected))
    for name, value in expected.items():
        same = same & _is_number(field(settings, name), value)
    written, stored = c("_written"), c("_stored")
    index = lambda side: F.concat(c("shard_root"), F.lit(f"/{side}/_index.json"))
    rules = {
        "invalid_preregistration:not_object": ~there,
        "schema_mismatch": there & _differs_from_text(of("schema"), F.lit(schema)),
        "generation_invalid": there & ~written.eqNullSafe(F.lit("BIGINT")),
        "generation_mismatch": there & (written == "BIGINT") & ~_is_number(of("generation"), c("generation")),
        "experiment_id_mismatch": there & _differs_from_text(of("experiment_id"), experiment),
        "parent_champion_mismatch": there & _differs_from_text(of("parent_champion"), c("parent")),
        "analysis_version_mismatch": there & _differs_from_text(of("analysis_version"), c("analysis_version")),
        "manifest_sha256_mismatch": there & _differs_from_text(of("dataset_manifest_sha256"), c("manifest_sha256")),
        "split_invalid": there & ~has_split,
        "train_index_mismatch": has_split & _differs_from_text(field(split, "train_index"), index("train")),
        "holdout_index_mismatch": has_split & _differs_from_text(field(split, "holdout_index"), index("holdout")),
        "holdout_not_frozen": has_split & ~_is_true(field(split, "holdout_is_frozen")),
        "budget_invalid": there & ~has_budget,
        "paper_or_offline_only_required": has_budget & ~_is_true(field(budget, "paper_or_offline_only")),
        "no_external_ai_calls_required": has_budget & ~_is_true(field(budget, "no_external_ai_calls")),
        "max_epochs_mismatch": has_budget & ~_is_number(field(budget, "max_epochs"), MAX_EPOCHS),
        "max_hidden_dim_mismatch": has_budget & ~_is_number(field(budget, "max_hidden_dim"), MAX_HIDDEN),
        "hyperparameters_mismatch": there & (settings.isNull() | ~F.coalesce(same, F.lit(False))),
        "seed_mismatch": there & ~_is_number(of("seed"), expected["seed"]),
        "sha256_invalid": there & stored.isNull(),
        "sha256_mismatch": there & (stored != self_digest(document, "preregistration_sha256")),
    }
    return violations(rows, c("_subject"), rules)
