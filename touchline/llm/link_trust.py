"""URL filter: rules by host and path, and trust carried over the host graph where no rule speaks.

Hosts with pages that rules allow are trusted seeds, hosts with pages that rules block are distrusted seeds,
each weighted by its pages. Trust is a personalised PageRank from the trusted seeds along host edges; distrust
is one from the blocked seeds along reversed edges, for who links to a bad host is suspect. Edges are links of
pages to other hosts and the steps between a host of the table and its parent domain. A host whose
share of distrust is above a threshold is blocked; a host that neither reaches is allowed.

Links are counted per pair of hosts before they are shuffled, scores per host are combined where they are
made, and pages meet the host table in a join with one row per host. Scores are spread until every host that can be
reached has been and no share can cross the threshold any more (``_settled``).

Only DataFrame functions are used. Defined results: a null URL or one without ``://`` has an empty host and
path, fits no rule and is judged as the host ''; html may be null; equal rules are one; of fitting rules of
equal length the first in text order wins; repeated pages count again; an empty table gives no rows; columns
of the result replace those of the same name.
"""

from __future__ import annotations

import itertools
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.rows import attach
from touchline.session import materialize

#: Neighbours of a host that are joined in one piece, rounds between two written tables, and the least move of a share that counts.
SPLIT, AT_ONCE, NEAR = 10_000, 5, 1e-6

_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = "(?i)href\\s*=\\s*[\"']?\\s*((?:[a-z]+:)?//[^\"'\\s>]+)"


@dataclass(frozen=True)
class Rule:
    """``place`` is a host with a path, like ``example.com/en/``."""

    place: str
    verdict: str


def _lower(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def first_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """(place, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(set(rules), key=lambda r: (len(r.place), [-ord(c) for c in r.place])):  # the last test made comes first
        name, slash, rest = rule.place.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule.place).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, and steps between the pages' hosts and their parents."""
    own = pages.select(host_of(F.col(url)).alias("src"), F.col(html).alias("html"))
    target = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    links = own.select("src", F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("to")).select("src", host_of(target).alias("dst"))
    linked = links.where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    hosts = own.select("src").where("src <> ''").distinct()
    # a step to every parent, so that hosts of one domain meet there
    up = hosts.select("src", F.regexp_replace("src", "^[^.]*\\.?", "").alias("dst"), F.lit(1.0).alias("n")).where("dst <> ''")
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    return linked.union(up).union(down).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, threshold: float = 0.5) -> DataFrame:
    """(host, trust, distrust) spread from ``seeds`` (host, trust, distrust), distrust against the edges.

    A round is one join: a row of the graph carries the part of trust that goes one way and the part of distrust
    that goes the other. Hosts with very many neighbours are split by ``salt``.
    Without ``rounds``, steps go on until ``_settled``.
    """
    way = lambda one, other, n, back: edges.select(F.col(one).alias("host"), F.col(other).alias("to"), F.col(n).alias("out"), F.col(back).alias("in"))
    edges = edges.withColumn("zero", F.lit(0.0))
    both = way("src", "dst", "n", "zero").union(way("dst", "src", "zero", "n")).groupBy("host", "to").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
    both = materialize(both)
    totals = both.groupBy("host").agg(F.sum("out").alias("all_out"), F.sum("in").alias("all_in"), F.ceil(F.count("*") / SPLIT).alias("salts"))
    known = totals.select(F.col("host").alias("to"), F.col("salts").alias("to_salts"))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    moves = materialize(
        both.join(totals, "host").join(known, "to").select(
            "host", F.pmod(F.xxhash64("to"), F.col("salts")).alias("salt"), "to", "to_salts", share("out", "all_out").alias("trusts"), share("in", "all_in").alias("distrusts")
        )
    )
    sums = seeds.agg(F.sum("trust").alias("all_trust"), F.sum("distrust").alias("all_distrust"))
    one = F.lit(1).cast("long")
    start = materialize(
        attach(seeds, sums).join(totals.select("host", "salts"), "host", "left")
        .select("host", F.coalesce("salts", one).alias("salts"), share("trust", "all_trust").alias("trust"), share("distrust", "all_distrust").alias("distrust"))
    )
    back = start.select("host", "salts", *[(F.col(c) * (1 - damping)).alias(c) for c in ("trust", "distrust")])
    scores = last = start
    for turn in itertools.count() if rounds is None else range(rounds):
        asked = scores.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "trust", "distrust")
        sent = asked.join(moves, ["host", "salt"]).select(
            F.col("to").alias("host"), F.col("to_salts").alias("salts"), *[(F.col(c) * F.col(f"{c}s") * damping).alias(c) for c in ("trust", "distrust")]
        )
        scores = sent.union(back).groupBy("host").agg(F.max("salts").alias("salts"), F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        scores = scores.where("trust > 0 OR distrust > 0")
        if turn % AT_ONCE == AT_ONCE - 1:
            scores = materialize(scores)
            if rounds is None and _settled(last, scores, threshold):
                break
            last = scores
    return scores.select("host", "trust", "distrust")


def share_of_distrust() -> Column:
    return F.try_divide("distrust", F.col("trust") + F.col("distrust"))


def _settled(last: DataFrame, scores: DataFrame, threshold: float) -> bool:
    """Whether no host can still change sides.

    Trust and distrust must have reached all the hosts they can. After that each step changes scores by at most
    ``damping`` of the step before, so in all the later steps a share moves by less than it did in these; a host
    is open while that was more than half of its distance from the threshold (``NEAR`` at least).
    """
    was = last.select("host", F.col("trust").alias("old_trust"), F.col("distrust").alias("old_distrust"))
    both = scores.join(was, "host", "left")
    reached = (F.col("trust") > 0) & (F.coalesce("old_trust", F.lit(0.0)) == 0) | (F.col("distrust") > 0) & (F.coalesce("old_distrust", F.lit(0.0)) == 0)
    old = F.try_divide("old_distrust", F.col("old_trust") + F.col("old_distrust"))
    moved = F.abs(share_of_distrust() - old) > F.greatest(F.lit(NEAR), F.abs(share_of_distrust() - threshold) / 2)
    return both.where(reached | moved).isEmpty()


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", html: str = "html", threshold: float = 0.5, damping: float = 0.85, rounds: int | None = None) -> DataFrame:
    """``pages`` without html, with host, path, rule, verdict and the host's share of distrust."""
    kept = [c for c in pages.columns if c not in {"host", "path", "rule", "verdict", "distrust", html}]
    placed = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = placed.withColumn("_fit", first_rule(rules, F.col("host"), F.col("path")))
    weight = lambda verdict: F.count_if(F.col("_fit.verdict") == verdict).cast("double")
    seeds = ruled.groupBy("host").agg(weight("allow").alias("trust"), weight("block").alias("distrust")).where("trust + distrust > 0")
    scores = spread(host_edges(pages, url, html), seeds, damping, rounds, threshold)
    shares = scores.where("trust + distrust > 0").select("host", share_of_distrust().alias("distrust"))
    by_method = F.when(F.coalesce("distrust", F.lit(0.0)) > threshold, "block").otherwise("allow")
    return ruled.join(shares, "host", "left").select(
        *kept, "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce("_fit.verdict", by_method).alias("verdict"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )
