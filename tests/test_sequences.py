"""Chunked look-around, ranks and medians against plain Python on random data."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from touchline.operators.sequences import (
    cut,
    exact_medians,
    look_around,
    rank_within,
    recent_values,
    running_total,
)


def _rows(seed, n=200, keys=2):
    rng = random.Random(seed)
    out = []
    for key in range(keys):
        seqs = sorted(rng.sample(range(n * 3), n))
        out += [(key, s, rng.choice([None, None, 1, 2, 3])) for s in seqs]
    return out


@pytest.mark.parametrize("parts", [1, 7, 64, None])
def test_look_around(spark, parts):
    rows = _rows(parts or 0)
    df = spark.createDataFrame(rows, "k int, seq long, v int")
    value = F.when(F.col("v").isNotNull(), F.struct("seq", "v"))
    got = {
        (r.k, r.seq): (r.p and (r.p.seq, r.p.v), r.n and (r.n.seq, r.n.v))
        for r in look_around(df, ["k"], "seq", before={"p": value}, after={"n": value}, parts=parts).collect()
    }
    for key in (0, 1):
        mine = [r for r in rows if r[0] == key]
        for i, (_, seq, _v) in enumerate(mine):
            before = [(s, v) for _, s, v in mine[:i] if v is not None]
            after = [(s, v) for _, s, v in mine[i + 1 :] if v is not None]
            assert got[(key, seq)] == (before[-1] if before else None, after[0] if after else None)


@pytest.mark.parametrize(("span", "parts"), [(3, 9), (1000, 1)])
def test_running_total_and_recent(spark, span, parts):
    rows = _rows(5, n=60)
    df = spark.createDataFrame(rows, "k int, seq long, v int")
    totals = running_total(df, ["k"], "seq", F.coalesce("v", F.lit(0)), "t", span=span)
    recent = recent_values(totals, ["k"], "seq", F.col("seq"), 4, "r", parts=parts)
    got = {(r.k, r.seq): (r.t, r.r) for r in recent.collect()}
    for key in (0, 1):
        mine = [r for r in rows if r[0] == key]
        for i, (_, seq, _v) in enumerate(mine):
            total = sum(v or 0 for _, _, v in mine[: i + 1])
            assert got[(key, seq)] == (total, [s for _, s, _ in mine[max(0, i - 3) : i + 1]])


def test_parts_follow_ranks_not_values(spark):
    """Spread ids of one key give as many border rows as there are parts."""
    spread = spark.range(4000).select(F.lit(1).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1 << 60)).alias("seq"), (F.col("id") % 3).alias("v"))
    rows = cut(spread, ["k"], ["seq"], 8)
    sizes = [r["count"] for r in rows.groupBy("_chunk").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500
    value = F.struct("seq", "v")
    seen = look_around(rows, ["k"], "seq", before={"p": value}).select("seq", "p.v").orderBy("seq").collect()
    order = [r.v for r in spread.orderBy("seq").collect()]
    assert [r.v for r in seen] == [None, *order[:-1]]


def test_rank_within_hot_groups(spark):
    rng = random.Random(1)
    rows = [(0 if i % 3 else 1, rng.randint(0, 5), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, v int, tie int")
    ranked = rank_within(df, ["k"], [F.desc("v"), F.asc("tie")], rank="r", size="n")
    got = {(r.k, r.tie): (r.r, r.n) for r in ranked.collect()}
    for key in (0, 1):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        assert all(got[(key, r[2])] == (i + 1, len(mine)) for i, r in enumerate(mine))


def test_exact_medians_of_few_values(spark):
    rng = random.Random(4)
    rows = [(n, float(rng.randint(0, 3))) for n in range(1, 25) for _ in range(n)]
    got = {r.k: r.median for r in exact_medians(spark.createDataFrame(rows, "k int, a double"), ["k"], ["a"]).collect()}
    assert got == {n: statistics.median([v for k, v in rows if k == n]) for n in range(1, 25)}


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_exact_medians(spark, accuracy):
    rng = random.Random(3)
    rows = [(i % 3, rng.choice([None, rng.gauss(0, 1), 0.5]), float(rng.randint(0, 9))) for i in range(3001)]
    df = spark.createDataFrame(rows, "k int, a double, b double").repartition(4)
    got = {(r.k, r.name): r for r in exact_medians(df, ["k"], ["a", "b"], accuracy=accuracy).collect()}
    for key in range(3):
        for pos, name in ((1, "a"), (2, "b")):
            values = [r[pos] for r in rows if r[0] == key and r[pos] is not None]
            assert got[(key, name)].median == pytest.approx(statistics.median(values), abs=1e-12)
            assert got[(key, name)].n == len(values)
            assert got[(key, name)].sd == pytest.approx(statistics.pstdev(values))
