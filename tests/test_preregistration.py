"""Canonical JSON and self digests against Python's own."""

import hashlib
import json

from pyspark.sql import functions as F

from touchline.operators import preregistration as R

DOCUMENTS = [
    {"b": 1, "a": {"z": [1e-05, 0.0003, -2.5e-07, 1e16], "y": None}, "c": True},
    {"text": 'a "quoted" 1.0E-5, \\ and ü', "1.0E-5": "1e-05", "n": -7, "empty": {}, "list": []},
    {"Z": "upper first", "a": "then lower", "é": 0.125},
]


def canonical(document):
    return json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_canonical_json(spark):
    rows = spark.createDataFrame([(i, json.dumps(d, indent=1)) for i, d in enumerate(DOCUMENTS)], "n int, text string")
    got = {r["n"]: r["text"] for r in rows.select("n", R.canonical_json(F.parse_json("text")).alias("text")).collect()}
    assert got == {i: canonical(d) for i, d in enumerate(DOCUMENTS)}


def test_self_digest(spark):
    stored = [hashlib.sha256(canonical(d).encode()).hexdigest() for d in DOCUMENTS]
    rows = spark.createDataFrame([(json.dumps({"own": s, **d}),) for s, d in zip(stored, DOCUMENTS, strict=True)], "text string")
    got = [r["digest"] for r in rows.select(R.self_digest(F.parse_json("text"), "own").alias("digest")).collect()]
    assert got == stored
    odd = spark.createDataFrame([("[1]",), ("7",), (None,)], "text string")
    assert [r[0] for r in odd.select(R.self_digest(F.parse_json("text"), "own")).collect()] == [None] * 3
