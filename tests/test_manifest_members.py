"""Members of a published manifest: the audit of small replays against that of any, and how often lines move."""

from touchline.operators import manifest_audits as MA
from touchline.workload import manifest_checks as W

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.select("subject", "check", "detail").collect()), key=repr)


def test_few_members_break_the_same_rules(spark):
    members = spark.createDataFrame(
        [
            ("a", 1, 2, "p", 5), ("a", 2, 2, "q", 5), ("a", 3, 2, "q", 0), ("a", 4, 1, "p", 5), ("b", 1, -1, "stranger", 5),
            ("b", 2, None, None, None), ("b", 3, None, " q", 1), ("orphan", 1, 1, "p", 1), ("c", 2, 3, "q", 1), ("c", 1, 3, "p", 1),
        ],
        "replay_sha256 string, position long, replay_player_id long, identity string, samples long",
    )
    entries = spark.createDataFrame([("a", 4), ("b", 2), ("c", 2), ("c", 1), ("none", 0), ("void", None)], "replay_sha256 string, selected_player_count long")
    selected = spark.createDataFrame([("p",), ("q",), ("q",)], "player_id string")
    few, many = (rows(MA.audit_members(members, entries, selected, few=few)) for few in (True, False))
    assert few == many
    assert {check for _, check, _ in few} == {f"members.{c}" for c in ("identity", "replay_player_id", "samples", "unselected", "count", "repeated_id", "not_in_order")}
    assert ("a|2", "members.repeated_id", "3") in few


def test_lines_move_once_for_their_rules(spark):
    """Places, order and repeated ids of members follow from one deal by replay, as numbers; nothing is cut by range."""
    selected, _, members = W._lists(spark, SMALL)
    found = MA.audit_members(members, spark.createDataFrame([], "replay_sha256 string, selected_player_count long"), selected, few=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 2 and plan.count("Window [") == 3 and "rangepartitioning" not in plan
    assert not any("/rows/" in f for f in members.inputFiles())
