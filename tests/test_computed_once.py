"""Heavy values are computed once a row, and heavy rows are dealt over tasks."""

import re

import pytest
from pyspark.sql import functions as F

from touchline.operators import gates as G
from touchline.operators import preregistration as R
from touchline.workload import ENTRIES

SMALL = "/root/testdata/sf0.001"


def parses(df):
    """How often the plan parses a document."""
    return len(re.findall("parse_?json", df._jdf.queryExecution().optimizedPlan().toString(), re.IGNORECASE))


def test_generation_state_is_read_once(spark):
    rows = spark.createDataFrame([("[1]", "v7", "m")], "text string, analysis_version string, manifest_sha256 string")
    found = R.audit_generation_states(rows.withColumn("state", F.parse_json("text")), F.col("text"), schema="s")
    assert parses(found) == 1
    assert [tuple(r) for r in found.select("subject", "check").collect()] == [("[1]", "invalid_generation_state:not_object")]


def test_preregistration_is_read_once(spark):
    names = ("analysis_version", "parent", "manifest_sha256", "shard_root")
    rows = spark.createDataFrame([("[1]", 3, *names)], "text string, generation long, " + ", ".join(f"{n} string" for n in names))
    found = R.audit_preregistrations(rows.withColumn("preregistration", F.parse_json("text")), F.col("text"), schema="s")
    assert parses(found) == 1
    assert [tuple(r) for r in found.select("subject", "check").collect()] == [("[1]", "invalid_preregistration:not_object")]


def test_gate_evidence_is_read_once(spark):
    rows = spark.createDataFrame([("{}",)], "text string")
    found = G.gate_evidence_issues(rows.select(F.parse_json("text").alias("document")))
    assert parses(found) == 1
    assert found.columns == ["document", "issues"]


@pytest.mark.parametrize("name", ["generation_state_audit", "preregistration_audit", "gate_evidence_issues"])
def test_documents_are_dealt_over_tasks(spark, name):
    assert ENTRIES[name].run(spark, SMALL).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("name", ["artifact_player_rows", "artifact_names"])
def test_artifacts_are_rows_and_read_once(spark, name):
    """No file of each artifact, whose number would grow with the tables."""
    found = ENTRIES[name].run(spark, SMALL)
    assert parses(found) == 1
    assert all(f.endswith(".parquet") for f in found.inputFiles()) and found.rdd.getNumPartitions() == 4
