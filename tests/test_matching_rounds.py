"""What the rounds of matching move."""

import pytest

from tests.test_matching import REPORT, crowd, plain_match
from touchline.operators import matching as M
from touchline.workload import imports


def test_rounds_move_numbers(spark, monkeypatch):
    """Families are numbers inside the rounds, and a member's choices come from the best score of a family."""
    kinds, plain = [], M._round

    def watched(replays, reports, span):
        kinds.append({replays.schema["family"].dataType.simpleString(), reports.schema["family"].dataType.simpleString()})
        return plain(replays, reports, span)

    monkeypatch.setattr(M, "_round", watched)
    replays, reports = crowd(3, 12)
    a = spark.createDataFrame(replays, "sha256 string, path string, file_name string, size_bytes long")
    b = spark.createDataFrame(reports, REPORT)
    got = {r.replay_sha256: (r.message_id, r.confidence) for r in M.match_replays(a, b).collect()}
    assert got == plain_match(replays, reports, M.MINIMUM_CONFIDENCE)
    assert kinds and all(k == {"bigint"} for k in kinds)


@pytest.mark.parametrize("seed,n,minimum", [(5, 40, 0.65), (6, 30, 0.03)])
def test_families_are_dealt_once_where_they_fit(spark, monkeypatch, seed, n, minimum):
    """Small families are ranked where they lie, larger ones than ``span`` in chunks; both give the greedy matches."""
    replays, reports = crowd(seed, n)
    a = spark.createDataFrame(replays, "sha256 string, path string, file_name string, size_bytes long")
    b = spark.createDataFrame(reports, REPORT)
    want, ways, plain = plain_match(replays, reports, minimum), [], M._round
    monkeypatch.setattr(M, "_round", lambda left, right, span: ways.append(span) or plain(left, right, span))
    for span, way in ((1000, None), (1, 1)):
        ways.clear()
        got = {r.replay_sha256: (r.message_id, r.confidence) for r in M.match_replays(a, b, minimum=minimum, span=span).collect()}
        assert got == want and ways[0] is way


def test_times_are_asked_of_those_that_names_leave(spark, monkeypatch):
    """A replay that a name matches has no minute to look up, and its report no eleven."""
    a = spark.createDataFrame([(f"r{i}", "p", f"24-09-26-22h12-{'a' if i < 8 else 'b'}.hbr2", 1) for i in range(9)], "sha256 string, path string, file_name string, size_bytes long")
    b = spark.createDataFrame([(f"m{i}", "2026-09-24T22:12:00", [(f"24-09-26-22h12-{'a' if i < 8 else 'c'}.hbr2", None, 1)]) for i in range(9)], REPORT)
    seen, plain = [], M._greedy
    monkeypatch.setattr(M, "_greedy", lambda replays, reports, span: seen.append((replays.count(), reports.count())) or plain(replays, reports, span))
    got = {r.replay_sha256: (r.message_id, r.confidence) for r in M.match_replays(a, b, minimum=0.03).collect()}
    assert got == {f"r{i}": (f"m{i}", 1.0 if i < 8 else 0.08) for i in range(9)}
    assert seen[1] == (1, 11)


def test_both_versions_are_published_from_rows_made_once(spark, monkeypatch):
    """Reports, groups, matches and the manifest are read from written tables, however often they are published."""
    published = []
    monkeypatch.setattr(imports.sinks, "publish_tables", lambda tables, root: published.append(tables) or len(published))
    monkeypatch.setattr(imports.sinks, "read_published", lambda spark, root, name, schema, version: spark.createDataFrame([], schema))
    imports.published_import(spark, "/root/testdata/sf0.001")
    assert len(published) == 2
    for name in ("replays", "reports", "matches", "manifest"):
        files = published[0][name][0].inputFiles()
        assert files and all("/rows/" in f for f in files)
