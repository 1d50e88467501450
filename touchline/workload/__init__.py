"""All registered queries over the given tables."""

from touchline.workload import curation_gates, documents_checks, imports, ledger_status, manifest_checks, match_events, pitch_positions, player_ratings, preregistrations, round_trips, streams_models, table_audits  # noqa: F401
from touchline.workload.registry import ENTRIES

__all__ = ["ENTRIES"]
