"""Greedy matching against the plain rule over all pairs, on small random sets with crowded names."""

import random
import re

import pytest
from pyspark.sql import functions as F

from touchline.operators import matching as M

REPORT = "message_id string, timestamp string, attachments array<struct<file_name string, url string, size_bytes long>>"


def base(stem):
    found = re.match(r"^(.+)-[0-9a-fA-F]{5,64}$", stem)
    return found.group(1) if found else stem


def plain_score(replay, report):
    _, _, name, size = replay
    _, stamp, attachments = report
    score = 0.0
    for a, _url, a_size in attachments:
        (s1, x1), (s2, x2) = a.lower().rsplit(".", 1), name.lower().rsplit(".", 1)
        if a.lower() == name.lower():
            score = 0.90
        elif x1 == x2 and (s1 == base(s2) or s2 == base(s1)):
            score = 0.84
        else:
            continue
        if a_size is not None and a_size == size:
            score += 0.06
        break
    minutes = int(re.search(r"h(\d\d)", name).group(1))
    m, s = stamp[14:16], stamp[17:19]
    apart = abs(minutes * 60 - int(m) * 60 - int(s))
    score += 0.08 if apart <= 60 else 0.03 if apart <= 300 else 0.0
    return min(score, 1.0)


def plain_match(replays, reports, minimum):
    pairs = sorted(
        ((-plain_score(a, b), a[0], b[0]) for a in replays for b in reports if plain_score(a, b) >= minimum)
    )
    used_a, used_b, out = set(), set(), {}
    for score, a, b in pairs:
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out[a] = (b, round(-score, 4))
    return out


def crowd(seed, n):
    rng = random.Random(seed)
    stem = lambda: f"24-09-26-22h{rng.choice(['10', '12', '15'])}-{rng.choice('ab')}"
    tail = lambda p: f"-{rng.choice(['abcde', '12345'])}" if rng.random() < p else ""
    replays = [(f"{rng.getrandbits(64):016x}", "p", f"{stem()}{tail(0.6)}.hbr2", rng.randint(0, 2)) for _ in range(n)]
    reports = []
    for i in range(n):
        atts = [(f"{stem()}{tail(0.3)}.hbr2", None, rng.choice([None, 0, 1, 2])) for _ in range(rng.choice([1, 1, 1, 2]))]
        second = rng.randint(0, 59)
        reports.append((f"m{rng.getrandbits(40):012x}", f"2026-09-24T22:{rng.randint(8, 17):02d}:{second:02d}+02:00", atts))
    return replays, reports


@pytest.mark.parametrize("seed,n,minimum,span", [(1, 30, 0.65, 4), (2, 40, 0.65, 1 << 18), (3, 20, 0.03, 8), (4, 60, 0.9, 5)])
def test_greedy_matching(spark, seed, n, minimum, span):
    replays, reports = crowd(seed, n)
    a = spark.createDataFrame(replays, "sha256 string, path string, file_name string, size_bytes long")
    b = spark.createDataFrame(reports, REPORT)
    got = {r.replay_sha256: (r.message_id, r.confidence) for r in M.match_replays(a, b, minimum=minimum, span=span).collect()}
    assert got == plain_match(replays, reports, minimum)


def test_first_fitting_attachment_counts(spark):
    """A stacked hash explains one replay first, without its size, although the second name would add it."""
    a = spark.createDataFrame(
        [("r1", "p", "foo-aaaaa.hbr2", 7), ("r2", "p", "foo-ccccc.hbr2", 7)],
        "sha256 string, path string, file_name string, size_bytes long",
    )
    b = spark.createDataFrame(
        [("m1", None, [("foo-aaaaa-bbbbb.hbr2", None, 5), ("foo.hbr2", None, 7)]), ("m2", None, [("foo.hbr2", None, 3)])], REPORT
    )
    got = {r.replay_sha256: (r.message_id, r.confidence) for r in M.match_replays(a, b).collect()}
    assert got == {"r2": ("m1", 0.9), "r1": ("m2", 0.84)}
    best = {r.sha256: (r.message_id, r.score) for r in M.best_reports(a, b).collect()}
    assert best == {"r1": ("m1", 0.84), "r2": ("m1", 0.9)}


def test_golden_pair(spark):
    pair = spark.createDataFrame(
        [("24-09-26-22h12-northcup-c0ffee1234567890.hbr2", 44237, "2026-09-24T22:12:27+02:00", [("24-09-26-22h12-northcup.hbr2", None, 44237)])],
        "file_name string, size_bytes long, timestamp string, attachments array<struct<file_name string, url string, size_bytes long>>",
    )
    row = M.pair_evidence(pair).first()
    assert row.score >= 0.9 - 1e-9
    assert row.reasons[:2] == ["dce_hashed_asset_filename", "attachment_size_matches"]


def test_one_popular_name_takes_few_rounds(spark, monkeypatch):
    """Everybody shares one name: one round pairs them all by rank."""
    n = 300
    a = spark.range(n).select(
        F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.lit("p").alias("path"),
        F.lit("24-09-26-22h12-x.hbr2").alias("file_name"), F.lit(1).cast("long").alias("size_bytes"),
    )
    b = spark.range(n).select(
        F.format_string("m%05d", "id").alias("message_id"), F.lit("2026-09-24T22:12:00").alias("timestamp"),
        F.array(F.struct(F.lit("24-09-26-22h12-x.hbr2").alias("file_name"), F.lit(None).cast("string").alias("url"), F.lit(1).cast("long").alias("size_bytes"))).alias("attachments"),
    )
    rounds = []
    step = M._round
    monkeypatch.setattr(M, "_round", lambda *args: rounds.append(1) or step(*args))
    got = {r.replay_sha256: r.message_id for r in M.match_replays(a, b, span=16).collect()}
    hashes = sorted(got)
    assert [got[h] for h in hashes] == [f"m{i:05d}" for i in range(n)]
    assert len(rounds) == 1
