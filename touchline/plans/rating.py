"""The rating plan: match rows to a leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame

from touchline.operators import skill
from touchline.session import materialize


def leaderboard(rows: DataFrame) -> DataFrame:
    """Rate every player from match rows.

    Evidence is read by the normalisers, the strengths and the observations, so it is written out once;
    the normalisers (a few dozen rows) are written out so that later passes do not redo the medians.
    """
    evidence = materialize(skill.match_evidence(rows))
    norms = materialize(skill.normalizers(evidence).coalesce(1))
    normalized = skill.normalize(evidence, norms)
    return skill.roll_up(skill.observations(normalized, skill.player_strengths(normalized)))
