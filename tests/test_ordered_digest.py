"""The root of the hash tree against plain hashing."""

import hashlib

import pytest

from touchline.operators import audits as A


def plain_root(rows, fan_out):
    level = [hashlib.sha256("".join("-" if v is None else f"{len(str(v))}:{v}" for v in r).encode()).hexdigest() for r in rows]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + fan_out]).encode()).hexdigest() for i in range(0, len(level), fan_out)]
    return level[0]


@pytest.mark.parametrize("n", [1, 2, 5, 25, 126])
def test_root(spark, n):
    rows = [(i, f"p{i}", None if i % 3 == 0 else i) for i in range(n)]
    df = spark.createDataFrame(rows, "position long, path string, size long").repartition(3)
    root = lambda d: A.ordered_root(d, ["position"], ["path", "size"], fan_out=5).first()
    want = plain_root([r[1:] for r in rows], 5)
    assert tuple(root(df)) == (n, want)
    if n > 1:  # two rows change places, or one row changes
        swapped = [(1 - i if i < 2 else i, *r) for i, *r in rows]
        assert root(spark.createDataFrame(swapped, df.schema))["root"] != want
        assert root(spark.createDataFrame([*rows[:-1], (n - 1, "other", 1)], df.schema))["root"] != want


def test_no_rows(spark):
    assert A.ordered_root(spark.createDataFrame([], "position long, path string"), ["position"], ["path"]).collect() == []
