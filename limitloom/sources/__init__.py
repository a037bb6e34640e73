from limitloom.sources.history import stitch_history
from limitloom.sources.sinks import append_audience, replace_table, session_view, to_records
from limitloom.sources.tables import DOMAIN, DRIVER, conform, load, nested, run_sql

__all__ = [
    "DOMAIN",
    "DRIVER",
    "append_audience",
    "conform",
    "load",
    "nested",
    "replace_table",
    "run_sql",
    "session_view",
    "stitch_history",
    "to_records",
]
