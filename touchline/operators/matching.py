"""One-to-one matching of replays and chat reports by greedy confidence, without forming all pairs.

The rule: score every pair, take the best free pair again and again (score descending, then replay hash,
then message id). Forming the pairs would square the size of every popular file name, so the pairs stay
implicit:

* A pair's score depends on how the names agree, on equal sizes and on a time band that the attachment's
  own name and the report's time determine. So replays and reports fall into *families* (kind of
  agreement, name, size or any size); inside a family and score everybody matches everybody.
* Size-blind families also hold pairs of equal size. Those have a higher score, so by the time the family's
  turn comes, no such pair is free any more; the same holds for weaker kinds of agreement.
* Inside a family and score the greedy order pairs the k-th replay with the k-th report. A run of such
  pairs is final as long as nobody in it has a better or earlier choice elsewhere.

Every round makes all final runs at once and at least the best pair overall, then the rest goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.scalars import (
    base_stem,
    file_stem,
    file_suffix,
    fold_case,
    local_seconds,
    replay_time,
    report_time,
    seconds_between,
)
from touchline.operators.sequences import ID_SPAN, running_total
from touchline.session import computed_once, materialize

# Confidence of the kinds of evidence.
EXACT_NAME, HASHED_NAME, SAME_SIZE, CLOSE_TIME, NEAR_TIME = 0.90, 0.84, 0.06, 0.08, 0.03
CLOSE_SECONDS, NEAR_SECONDS = 60, 300
MINIMUM_CONFIDENCE = 0.65


def time_bonus(a: Column, b: Column) -> Column:
    """Bonus of two local times: a minute or five apart."""
    apart = seconds_between(a, b)
    bonus = F.when(apart <= CLOSE_SECONDS, CLOSE_TIME).when(apart <= NEAR_SECONDS, NEAR_TIME).otherwise(0.0)
    return F.coalesce(bonus, F.lit(0.0))


def name_evidence(attachment: Column, replay: Column) -> Column:
    """Reason why an attachment name fits a replay name, null if it does not."""
    a, r = fold_case(attachment), fold_case(replay)
    same_kind = file_suffix(a) == file_suffix(r)
    return (
        F.when(a == r, "exact_attachment_filename")
        .when(same_kind & (file_stem(a) == base_stem(file_stem(r))), "dce_hashed_asset_filename")
        .when(same_kind & (file_stem(r) == base_stem(file_stem(a))), "dce_hashed_attachment_filename")
    )


def pair_evidence(pairs: DataFrame) -> DataFrame:
    """Score and ordered reasons of given pairs: file_name, size_bytes, attachments, timestamp (JON-01).

    The first fitting attachment counts, even if a later one would fit better.
    """
    # names come apart once a row: a lambda computes again whatever it names twice
    own = computed_once(pairs, _own=fold_case(F.col("file_name")))
    own = computed_once(own, _stem=file_stem(F.col("_own")), _suffix=file_suffix(F.col("_own")))
    own = computed_once(own, _base=base_stem(F.col("_stem")))
    same = lambda a: F.coalesce(a["size_bytes"] == F.col("size_bytes"), F.lit(False)).alias("same_size")
    folded = F.transform("attachments", lambda a: F.struct(fold_case(a["file_name"]).alias("name"), same(a)))
    parts = F.transform(folded, lambda a: F.struct(a["name"].alias("name"), file_stem(a["name"]).alias("stem"), file_suffix(a["name"]).alias("suffix"), a["same_size"].alias("same_size")))
    fits = F.transform(
        parts,
        lambda a: F.struct(
            F.when(a["name"] == F.col("_own"), "exact_attachment_filename")
            .when((a["suffix"] == F.col("_suffix")) & (a["stem"] == F.col("_base")), "dce_hashed_asset_filename")
            .when((a["suffix"] == F.col("_suffix")) & (F.col("_stem") == base_stem(a["stem"])), "dce_hashed_attachment_filename")
            .alias("reason"),
            a["same_size"].alias("same_size"),
        ),
    )
    first = F.get(F.filter(fits, lambda f: f["reason"].isNotNull()), F.lit(0))
    bonus = time_bonus(replay_time(F.col("file_name")), report_time(F.col("timestamp")))
    scored = computed_once(own, _fit=first, _bonus=bonus)
    name = F.when(F.col("_fit").isNull(), 0.0).when(
        F.col("_fit.reason") == "exact_attachment_filename", EXACT_NAME
    ).otherwise(HASHED_NAME)
    size = F.when(F.col("_fit.same_size"), SAME_SIZE).otherwise(0.0)
    reasons = F.array_compact(
        F.array(
            F.col("_fit.reason"),
            F.when(F.col("_fit.same_size"), "attachment_size_matches"),
            F.when(F.col("_bonus") == CLOSE_TIME, "timestamp_within_60s").when(
                F.col("_bonus") == NEAR_TIME, "timestamp_within_5m"
            ),
        )
    )
    return scored.withColumns(
        {"score": F.least(name + size + F.col("_bonus"), F.lit(1.0)), "reasons": reasons}
    ).select(*pairs.columns, "score", "reasons")


def _family(kind: str, *parts: Column) -> Column:
    return F.concat_ws("|", F.lit(kind), *parts)


def _hidden_by(attachments: Column, position: Column, name: Column) -> Column:
    """Replay names that an earlier attachment already explains although ``name`` would fit them as well.

    That needs stacked hashes (``a-1f2e3-4d5c6`` before ``a``): replay ``a-1f2e3`` fits the first one.
    """
    earlier = F.transform(F.slice(attachments, 1, position), lambda e: fold_case(e["file_name"]))
    explained = F.transform(earlier, lambda e: F.concat(base_stem(file_stem(e)), file_suffix(e)))
    doubled = F.filter(explained, lambda e: F.concat(base_stem(file_stem(e)), file_suffix(e)) == name)
    return F.array_sort(F.array_distinct(F.filter(doubled, lambda e: e != name)))


def narrowed_families(replays: DataFrame, reports: DataFrame) -> DataFrame:
    """Families of replays for the rare reports with stacked hashes: everybody but the hidden names."""
    several = reports.filter(F.size("attachments") > 1)
    exploded = several.select("attachments", F.posexplode("attachments").alias("_pos", "_a"))
    name = fold_case(F.col("_a.file_name"))
    rare = exploded.select(
        name.alias("_name"), F.col("_a.size_bytes").alias("_size"), _hidden_by(F.col("attachments"), F.col("_pos"), name).alias("_hidden")
    ).filter(F.size("_hidden") > 0)
    known = rare.select("_name", "_hidden", F.explode(F.array(F.col("_size"), F.lit(None).cast("long"))).alias("_size")).distinct()
    own = fold_case(F.col("file_name"))
    key = F.concat(base_stem(file_stem(own)), file_suffix(own))
    met = replays.select("_id", "size_bytes", own.alias("_own"), key.alias("_name")).join(known, "_name")
    fits = ~F.array_contains("_hidden", F.col("_own")) & (F.col("_size").isNull() | (F.col("_size") == F.col("size_bytes")))
    size = F.coalesce(F.col("_size").cast("string"), F.lit("*"))
    return met.filter(fits).select("_id", _family("w", F.col("_name"), size, F.array_join("_hidden", "/")).alias("family"))


def _named(rows: DataFrame, name: Column) -> DataFrame:
    """Add the folded name and the name without its hash, once per row."""
    return rows.withColumn("_name", fold_case(name)).withColumn(
        "_plain", F.concat(base_stem(file_stem(F.col("_name"))), file_suffix(F.col("_name")))
    )


def replay_families(replays: DataFrame, reports: DataFrame, *, by_time: bool) -> DataFrame:
    """Families of every replay: (id, family)."""
    named = _named(replays.select("_id", "file_name", "size_bytes"), F.col("file_name"))
    name, plain = F.col("_name"), F.col("_plain")
    size = F.col("size_bytes").cast("string")
    families = [_family(k, n, s) for k, n in (("x", name), ("y", plain), ("z", name)) for s in (size, F.lit("*"))]
    usual = named.select("_id", F.explode(F.array_compact(F.array(*families))).alias("family"))
    by_name = usual.unionByName(narrowed_families(replays, reports))
    return by_name.unionByName(replay_minutes(replays)) if by_time else by_name


def replay_minutes(replays: DataFrame) -> DataFrame:
    """The family of every replay's minute, where its name has one: (id, family)."""
    at = local_seconds(replay_time(F.col("file_name"))).cast("long").cast("string")
    return replays.select("_id", F.when(at.isNotNull(), _family("t", at)).alias("family")).where("family IS NOT NULL")


def report_minutes(reports: DataFrame, *, minimum: float) -> DataFrame:
    """Families of the minutes around every report, with their score: (id, family, score)."""
    at = local_seconds(report_time(F.col("timestamp")))
    opening, closing = F.ceil((at - NEAR_SECONDS) / 60), F.floor((at + NEAR_SECONDS) / 60)
    minutes = reports.select("_id", at.alias("_at"), F.explode(F.sequence(opening, closing)).alias("_m")).select(
        "_id",
        _family("t", (F.col("_m") * 60).cast("string")).alias("family"),
        F.when(F.abs(F.col("_m") * 60 - F.col("_at")) <= CLOSE_SECONDS, CLOSE_TIME).otherwise(NEAR_TIME).alias("score"),
    )
    return minutes.filter(F.col("score") >= minimum)


def report_families(reports: DataFrame, *, minimum: float, by_time: bool) -> DataFrame:
    """Families of every report with the score a member of them gives: (id, family, score); two attachments may give
    the same row twice."""
    exploded = reports.select("_id", "timestamp", "attachments", F.posexplode("attachments").alias("_pos", "_a"))
    named = _named(exploded, F.col("_a.file_name"))
    name, plain, first = F.col("_name"), F.col("_plain"), F.col("_pos") == 0
    before = F.slice("attachments", 1, F.col("_pos"))
    explained = lambda target: F.exists(before, lambda e: name_evidence(e["file_name"], target).isNotNull())
    facts = named.withColumns(
        {
            "_bonus": time_bonus(replay_time(F.col("_a.file_name")), report_time(F.col("timestamp"))),
            # Only a later attachment can be preceded by one that counts instead of it.
            "_x": first | ~explained(name),
            "_y": first | ~F.exists(before, lambda e: fold_case(e["file_name"]) == name),
            "_z": first | ~explained(plain),
            "_hidden": F.when(~first, F.array_join(_hidden_by(F.col("attachments"), F.col("_pos"), name), "/")),
        }
    )
    size, bonus = F.col("_a.size_bytes"), F.col("_bonus")
    edges = []
    for kind, key, base in (("x", name, EXACT_NAME), ("y", name, HASHED_NAME), ("z", plain, HASHED_NAME)):

        def label(which: Column, kind: str = kind, key: Column = key) -> Column:
            usual = _family(kind, key, which)
            if kind == "y":
                usual = F.when(F.col("_hidden") != "", _family("w", key, which, F.col("_hidden"))).otherwise(usual)
            return usual.alias("family")

        sized = F.struct(
            label(size.cast("string")), F.least(F.lit(base) + F.lit(SAME_SIZE) + bonus, F.lit(1.0)).alias("score")
        )
        blind = F.struct(label(F.lit("*")), (F.lit(base) + bonus).alias("score"))
        open_ = F.col(f"_{kind}")
        edges += [F.when(open_ & size.isNotNull(), sized), F.when(open_, blind)]
    out = facts.select("_id", F.inline(F.array_compact(F.array(*edges))))
    out = out.filter(F.col("score") >= minimum)
    return out.unionByName(report_minutes(reports, minimum=minimum)) if by_time else out


def _with_order(df: DataFrame, key: str) -> DataFrame:
    """Give every row an integer that follows the order of ``key``, wherever the sort put it."""
    return materialize(df.orderBy(key).withColumn("_id", F.monotonically_increasing_id()))


def _choices(offers: DataFrame) -> DataFrame:
    """Per member its best score and the leaders of its two earliest families at that score. ``offers``: _id, score, _first, family."""
    two = offers.groupBy("_id").agg(
        F.slice(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("_s"), "_first", "family"))), 1, 2).alias("_two")
    )
    same = F.filter("_two", lambda o: o["_s"] == F.col("_two")[0]["_s"])
    return two.select(
        "_id", (-F.col("_two")[0]["_s"]).alias("best"), F.transform(same, lambda o: F.struct(o["_first"].alias("_first"), o["family"].alias("family"))).alias("two")
    )


def _dealt(replays: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of equal rank and the choices of both sides, where a family fits a task: both sides are dealt by family
    once, and ranks, leaders and pairs are made where they lie."""
    rows = replays.select("family", F.lit(0).alias("_side"), "_id", F.lit(0.0).alias("score")).unionByName(
        reports.select("family", F.lit(1).alias("_side"), "_id", "score")
    )
    family = Window.partitionBy("family")
    topped = rows.repartition("family").withColumn("_top", F.max("score").over(family))
    replay, leading = F.col("_side") == 0, (F.col("_side") == 1) & (F.col("score") == F.col("_top"))
    by_rank = Window.partitionBy("family", "_side").orderBy("_id")
    zipped = (
        topped.where(replay | leading).withColumn("k", F.row_number().over(by_rank)).groupBy("family", "k")
        .agg(F.max(F.when(replay, F.col("_id"))).alias("replay_id"), F.max(F.when(~replay, F.col("_id"))).alias("report_id"), F.max("score").alias("score"))
        .where("replay_id IS NOT NULL AND report_id IS NOT NULL")
    )
    led = topped.withColumns({"_replay": F.min(F.when(replay, F.col("_id"))).over(family), "_report": F.min(F.when(leading, F.col("_id"))).over(family)})
    replay_choice = _choices(led.where(replay).select("_id", F.col("_top").alias("score"), F.col("_report").alias("_first"), "family"))
    report_choice = _choices(led.where(~replay).select("_id", "score", F.col("_replay").alias("_first"), "family"))
    return zipped, replay_choice, report_choice


def _cut(replays: DataFrame, reports: DataFrame, span: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same with families of any size, ranked in chunks of ids."""
    # Only the best score of a family can be somebody's best.
    first_replay = replays.groupBy("family").agg(F.min("_id").alias("_first"))
    first_report = reports.groupBy("family").agg(F.min(F.struct((-F.col("score")).alias("_s"), "_id")).alias("_top")).select(
        "family", (-F.col("_top._s")).alias("score"), F.col("_top._id").alias("_first")
    )
    ranked_replays = running_total(replays, ["family"], "_id", F.lit(1), "k", span=span)
    ranked_reports = running_total(reports, ["family", "score"], "_id", F.lit(1), "k", span=span)
    zipped = ranked_replays.withColumnRenamed("_id", "replay_id").join(
        ranked_reports.withColumnRenamed("_id", "report_id"), ["family", "k"]
    )
    return zipped, _choices(replays.join(first_report, "family")), _choices(reports.join(first_replay, "family"))


def _round(replays: DataFrame, reports: DataFrame, span: int | None) -> DataFrame:
    """Pairs that are final now. ``replays``: _id, family; ``reports``: _id, family, score. Without ``span`` no family
    is too large for a task."""
    zipped, replay_choice, report_choice = _cut(replays, reports, span) if span else _dealt(replays, reports)
    prefixed = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c.lstrip('_')}") for c in df.columns])
    judged = zipped.join(prefixed(replay_choice, "replay"), "replay_id").join(
        prefixed(report_choice, "report"), "report_id"
    )
    elsewhere = lambda two: F.when(
        two[0]["family"] == F.col("family"), F.get(two, F.lit(1))["_first"]
    ).otherwise(two[0]["_first"])
    no_worse = lambda mine, other: F.coalesce(mine <= other, F.lit(True))
    final = (
        (F.col("replay_best") == F.col("score"))
        & (F.col("report_best") == F.col("score"))
        & no_worse(F.col("replay_id"), elsewhere(F.col("report_two")))
        & no_worse(F.col("report_id"), elsewhere(F.col("replay_two")))
    )
    judged = judged.withColumn("_ok", final)
    broken = judged.filter(~F.col("_ok")).groupBy("family", "score").agg(F.min("k").alias("_stop"))
    return (
        judged.filter("_ok")
        .join(broken, ["family", "score"], "left")
        .filter(F.col("_stop").isNull() | (F.col("k") < F.col("_stop")))
        .select("replay_id", "report_id", "score")
        .distinct()
    )


def _greedy(replays: DataFrame, reports: DataFrame, span: int) -> list[DataFrame]:
    """The pairs of every round, written. ``replays``: _id, family; ``reports``: _id, family, score, maybe repeated."""
    right = materialize(reports)
    # Families are numbered, so that the rounds move two numbers and not names. Members of families that the
    # other side does not know can never match.
    known = materialize(right.select("family").distinct().withColumn("_no", F.monotonically_increasing_id()))
    numbered = lambda side, *more: side.join(known, "family").select("_id", F.col("_no").alias("family"), *more)
    left = materialize(numbered(replays))
    right = numbered(right, "score").distinct()
    right = materialize(right.join(left.select("family").distinct(), "family", "left_semi"))
    crowded = lambda side: not side.groupBy("family").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > span).isEmpty()
    cut = span if crowded(left) or crowded(right) else None
    done = []
    while not right.isEmpty():
        pairs = materialize(_round(left, right, cut))
        done.append(pairs)
        left = left.join(pairs.select(F.col("replay_id").alias("_id")), "_id", "left_anti")
        right = right.join(pairs.select(F.col("report_id").alias("_id")), "_id", "left_anti")
        left = materialize(left.join(right.select("family").distinct(), "family", "left_semi"))
        right = materialize(right.join(left.select("family").distinct(), "family", "left_semi"))
    return done


def match_replays(
    replays: DataFrame, reports: DataFrame, *, minimum: float = MINIMUM_CONFIDENCE, span: int = ID_SPAN
) -> DataFrame:
    """Greedy one-to-one matches (JON-01 to JON-03).

    ``replays``: sha256 (unique), path, file_name, size_bytes. ``reports``: message_id (unique), timestamp,
    attachments. Below a minimum of 0.09 the time alone can match; a minimum must be above 0.
    """
    if minimum <= 0:
        raise ValueError("minimum must be above 0: everything would match everything")
    by_time = minimum <= CLOSE_TIME
    a = _with_order(replays.select("sha256", "path", "file_name", "size_bytes"), "sha256")
    b = _with_order(reports.select("message_id", "timestamp", "attachments"), "message_id")
    done = _greedy(replay_families(a, b, by_time=False), report_families(b, minimum=minimum, by_time=False), span)
    if by_time:
        # Any name scores more than every time, so times are only asked of those that names leave.
        free_a, free_b = a.select("_id", "file_name"), b.select("_id", "timestamp")
        for pairs in done:
            free_a = free_a.join(pairs.select(F.col("replay_id").alias("_id")), "_id", "left_anti")
            free_b = free_b.join(pairs.select(F.col("report_id").alias("_id")), "_id", "left_anti")
        done += _greedy(replay_minutes(free_a), report_minutes(free_b, minimum=minimum), span)
    spark = replays.sparkSession
    matched = spark.createDataFrame([], "replay_id long, report_id long, score double")
    for pairs in done:
        matched = matched.unionByName(pairs)
    together = matched.join(a.withColumnRenamed("_id", "replay_id"), "replay_id").join(
        b.withColumnRenamed("_id", "report_id"), "report_id"
    )
    return pair_evidence(together.drop("score")).select(
        F.col("sha256").alias("replay_sha256"),
        F.col("path").alias("replay_path"),
        "message_id",
        F.round("score", 4).alias("confidence"),
        "reasons",
    )


def best_reports(replays: DataFrame, reports: DataFrame, *, minimum: float = MINIMUM_CONFIDENCE) -> DataFrame:
    """The best report of every replay, free or not: highest score, then lowest message id.

    Families reduce to their first report per score, so the work is linear in the rows.
    """
    by_time = minimum <= CLOSE_TIME
    a = replays.withColumn("_id", F.col("sha256"))
    b = reports.withColumn("_id", F.col("message_id"))
    offers = (
        report_families(b, minimum=minimum, by_time=by_time)
        .groupBy("family", "score")
        .agg(F.min("_id").alias("message_id"))
    )
    best = (
        replay_families(a, b, by_time=by_time)
        .join(offers, "family")
        .groupBy("_id")
        .agg(F.min(F.struct((-F.col("score")).alias("_s"), "message_id")).alias("_b"))
        .select(F.col("_id").alias("sha256"), "_b.message_id")
    )
    pairs = best.join(replays, "sha256").join(reports.select("message_id", "timestamp", "attachments"), "message_id")
    return pair_evidence(pairs).select("sha256", "message_id", F.round("score", 4).alias("score"), "reasons")
