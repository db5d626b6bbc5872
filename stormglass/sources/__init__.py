from .files import (explode_envelopes, read_documents, read_envelopes, read_observation_json,
                    read_series, read_wide, series_catalogue, snapshot_status,
                    validate_envelopes)
from .sinks import load_model, save_model, write_documents, write_table
from .tables import indicator_long, load_tables, macro_obs, scored_documents, scored_lines

__all__ = [
    "explode_envelopes", "indicator_long", "load_model", "load_tables", "macro_obs",
    "read_documents", "read_envelopes", "read_observation_json", "read_series", "read_wide",
    "save_model", "scored_documents", "scored_lines", "series_catalogue", "snapshot_status", "validate_envelopes", "write_documents",
    "write_table",
]
