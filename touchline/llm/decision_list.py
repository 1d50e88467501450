"""Quality rules: base counts of whole texts and a learned decision list, as Spark expressions.

The list is learned by sequential covering. A bounded sample of labelled rows is measured by the same
expressions and summed into counts per combination of threshold bins; on these counts a rule is grown,
one threshold condition at a time by information gain, until it covers no good row, then pruned from its
end on rows that did not grow it, and kept if it is precise enough there. Rows that it covers leave, and
the next rule is grown. The rules become one ordered conditional expression over the counts.

Defined results: a null or empty text has no words and fails the base rule; labels without a row, rows
without a label, null labels and repeated labels are allowed; with no labelled row, or labels of one
class, the list is empty and only the base rule rejects; measured columns replace columns of the same
name in the result of ``measure``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.session import materialize

#: Labelled rows the list is learned from, at most: the lowest by the hash of their id.
SAMPLE_ROWS = 20_000

#: A rule must cover so many rejected rows of the pruning part, and so large a share of those it covers there.
LEAST_SUPPORT, LEAST_PRECISION = 5, 0.97
MOST_RULES, MOST_CONDITIONS = 16, 4

_QUANTILES = [0.0, 0.01, 0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98, 0.99, 1.0]
_BLANKS = "[ \\t-\\r]+"
#: Counts of ``measure``, and those that the contract of the query names.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = FEATURES[self.feature]()
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


#: What conditions may test, over the counts.
FEATURES = {
    "words": lambda: F.col("n_words").cast("double"),
    "chars_per_word": lambda: _share("word_chars", "n_words"),
    "symbols_per_word": lambda: _share("n_symbols", "n_words"),
    "repeated_share": lambda: _share("n_repeat_words", "n_words"),
    "repeated_line_share": lambda: _share("n_dup_lines", "n_lines"),
    "upper_share": lambda: _share("n_upper", "word_chars"),
    "marks_per_word": lambda: _share("n_marks", "n_words"),
}


def _without(pattern: str) -> Column:
    return (F.length("_text") - F.length(F.regexp_replace("_text", pattern, ""))).cast("long")


def measure(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with the counts of ``COUNTS``, all inside one pass over the text.

    Repeated windows: the windows' hashes with their places are sorted, so equal ones are neighbours; a
    text without equal windows, the usual case, is told by counting distinct hashes and not sorted.
    """
    kept = [c for c in rows.columns if c not in COUNTS and not c.startswith("_t_")]
    x = rows.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    x = x.select(*kept, "_text", F.filter(F.split("_text", _BLANKS), lambda w: w != "").alias("_t_words"))
    x = x.select(
        *kept,
        F.size("_t_words").cast("long").alias("n_words"),
        F.length(F.array_join("_t_words", "")).cast("long").alias("word_chars"),
        _without("[#*$%&|<>]").alias("n_symbols"),
        _without("\\p{Lu}").alias("n_upper"),
        _without("[!?]").alias("n_marks"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike("[^ \\t-\\r]")).alias("_t_lines"),
        F.when(
            F.size("_t_words") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("_t_words") - 3), lambda i: F.xxhash64(F.get("_t_words", i), F.get("_t_words", i + 1), F.get("_t_words", i + 2))),
        ).otherwise(F.array().cast("array<bigint>")).alias("_t_windows"),
    )
    passed = [*kept, "n_words", "word_chars", "n_symbols", "n_upper", "n_marks"]
    x = x.select(
        *passed,
        F.size("_t_lines").cast("long").alias("n_lines"),
        (F.size("_t_lines") - F.size(F.array_distinct("_t_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size(F.array_distinct("_t_windows")) < F.size("_t_windows"),
            F.sort_array(F.transform("_t_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("_t_sorted"),
    )
    x = x.select(
        *passed,
        "n_lines",
        "n_dup_lines",
        F.sort_array(
            F.transform(
                F.filter("_t_sorted", lambda s, j: (F.get("_t_sorted", j - 1)["h"] == s["h"]) | (F.get("_t_sorted", j + 1)["h"] == s["h"])),
                lambda s: s["i"],
            )
        ).alias("_t_starts"),
    )
    repeated = F.aggregate(
        F.transform("_t_starts", lambda s, j: F.least(F.lit(3), F.coalesce(F.get("_t_starts", j + 1) - s, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, n: a + n,
    )
    # a generated row, since a later filter on a count would otherwise be rewritten over the text, count by count
    counts = F.struct(*[F.col(c) for c in COUNTS if c != "n_repeat_words"], repeated.alias("n_repeat_words"))
    return x.select(*kept, F.inline(F.array(counts)))


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


class _Counts:
    """Good and bad rows by combination of bins; ``part`` 0 and 1 grow rules, 2 prunes them."""

    def __init__(self, rows: list[tuple[tuple[int, ...], int, bool, int]]) -> None:
        self.rows = rows

    def sums(self, test, parts: tuple[int, ...]) -> tuple[int, int]:
        bad = sum(n for bins, part, is_bad, n in self.rows if is_bad and part in parts and test(bins))
        good = sum(n for bins, part, is_bad, n in self.rows if not is_bad and part in parts and test(bins))
        return bad, good


def _covers(rule: list[tuple[int, bool, int]]):
    return lambda bins: all((bins[f] > j) == above for f, above, j in rule)


def _best(counts: _Counts, rule: list, thresholds: list[list[float]]) -> tuple[int, bool, int, int] | None:
    """The condition with the largest gain over the growing rows the rule covers: feature, side, and the
    first and last threshold that give the same cover."""
    covered = _covers(rule)
    rows = [r for r in counts.rows if r[1] < 2 and covered(r[0])]
    bad, good = (sum(r[3] for r in rows if r[2] is side) for side in (True, False))
    if not bad or not good:
        return None
    best, choice = 1e-9, None
    before = math.log2(bad / (bad + good))
    for f, limits in enumerate(thresholds):
        seen = [[0, 0] for _ in range(len(limits) + 1)]
        for bins, _, is_bad, n in rows:
            seen[bins[f]][is_bad] += n
        low = [0, 0]
        tried: dict[tuple[bool, int, int], list[int]] = {}
        for j in range(len(limits)):
            low = [low[0] + seen[j][0], low[1] + seen[j][1]]
            for above, b, g in ((False, low[1], low[0]), (True, bad - low[1], good - low[0])):
                if b and b + g < bad + good:
                    tried.setdefault((above, b, g), []).append(j)
        for (above, b, g), at in tried.items():
            if (gain := b * (math.log2(b / (b + g)) - before)) > best:
                best, choice = gain, (f, above, at[0], at[-1])
    return choice


def learn(counted: list[tuple[tuple[int, ...], int, bool, int]], thresholds: list[list[float]]) -> list[list[Condition]]:
    """Rules for rejected rows, in order, from counts of (bins, part, rejected, rows)."""
    names, counts, rules = list(FEATURES), _Counts(counted), []
    while len(rules) < MOST_RULES:
        rule, spans = [], []
        while len(rule) < MOST_CONDITIONS and (found := _best(counts, rule, thresholds)):
            f, above, first, last = found
            rule.append((f, above, (first + last) // 2))
            spans.append((first, last))
        scored = []
        for size in range(len(rule), 0, -1):
            bad, good = counts.sums(_covers(rule[:size]), (2,))
            scored.append(((bad - good) / max(1, bad + good), size, bad, good))
        if not scored:
            break
        _, size, bad, good = max(scored, key=lambda s: s[0])
        if bad < LEAST_SUPPORT or bad < LEAST_PRECISION * (bad + good):
            break
        # in the middle between the outermost thresholds that cover the same rows
        rules.append([Condition(names[f], above, (thresholds[f][a] + thresholds[f][b]) / 2) for (f, above, _), (a, b) in zip(rule[:size], spans[:size], strict=True)])
        gone = _covers(rule[:size])
        counts = _Counts([r for r in counts.rows if not gone(r[0])])
    return rules


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """Learn the list from at most ``sample_rows`` labelled rows; label 0 is to be rejected.

    Rows that fail the base rule are rejected without the list and don't shape it.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.min(label).alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key")
        .limit(sample_rows)
    )
    # at most sample_rows pairs of a key and a label
    taken = documents.select(F.col(key).alias("_key"), F.col(text).alias("_body")).join(F.broadcast(chosen), "_key")
    measured = measure(taken, "_body").select((F.col("_label") == 0).alias("bad"), F.pmod(F.xxhash64("_key", F.lit(3)), F.lit(3)).cast("int").alias("part"), base_failed().alias("failed"), *[f().alias(n) for n, f in FEATURES.items()])
    sample = materialize(measured.where(~F.col("failed")).drop("failed"))
    limits = sample.groupBy("bad").agg(*[F.percentile_approx(n, _QUANTILES, 10_000).alias(n) for n in FEATURES]).collect()
    if len(limits) < 2:
        return []
    thresholds = [sorted({v for row in limits for v in row[n]}) for n in FEATURES]
    # halfway to the next measured value, so that a threshold lies between rows and not on one
    following = sample.select(*[F.min(F.when(F.col(n) > v, F.col(n))) for n, t in zip(FEATURES, thresholds, strict=True) for v in t]).first()
    after = iter(following)
    thresholds = [[v if (a := next(after)) is None else (v + a) / 2 for v in t] for t in thresholds]
    bins = [sum(((F.col(n) > v).cast("int") for v in t), F.lit(0)).alias(n) for n, t in zip(FEATURES, thresholds, strict=True)]
    # at most sample_rows combinations
    counted = sample.select("bad", "part", *bins).groupBy("bad", "part", *FEATURES).count().collect()
    rows = sorted((tuple(r[n] for n in FEATURES), r["part"], r["bad"], r["count"]) for r in counted)
    return learn(rows, thresholds)


def rejected_by(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that covers a measured row, from 1; 0 where none does."""
    out = F.lit(0)
    for number in range(len(rules), 0, -1):
        test = F.lit(True)
        for condition in rules[number - 1]:
            test = test & condition.column()
        out = F.when(test, F.lit(number)).otherwise(out)
    return out


def judge(documents: DataFrame, rules: list[list[Condition]], text: str = "text") -> DataFrame:
    """Documents with their counts, ``base_failed``, ``rule`` and ``kept``."""
    judged = measure(documents, text).withColumn("base_failed", base_failed()).withColumn("rule", rejected_by(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
