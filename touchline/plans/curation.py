"""The curation plan: leaderboard and replays to a training manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import curation as C
from touchline.session import materialize


def selection(board: DataFrame, **policy) -> DataFrame:
    """Selected players. The leaderboard is written out first: ranking looks at it more than once; the selection
    too, so that its size is known to the joins."""
    return materialize(C.select_players(materialize(board), **policy))


def training_manifest(
    board: DataFrame, players: DataFrame, replays: DataFrame, *, modulus: int = 10, bucket: int = 0, salt: str = "holdout-v1:", **policy
) -> dict[str, DataFrame]:
    """Selected players, graded replays, members and manifest rows with their split."""
    chosen = selection(board, **policy)
    graded = replays.withColumn("reasons", C.replay_rejections())
    members = C.selected_in_replays(players, graded.filter(F.size("reasons") == 0), chosen)
    return {
        "selected_players": chosen,
        "rejections": C.rejection_histogram(graded),
        "members": members,
        "replays": C.manifest_entries(members, replays, modulus=modulus, bucket=bucket, salt=salt),
    }
