from tallyflow.sources.csv_files import ColumnContractError, missing_columns, open_source
from tallyflow.sources.discovery import discover, empty_files, list_files, pending, stream_files, with_phase

__all__ = [
    "ColumnContractError",
    "discover",
    "empty_files",
    "list_files",
    "missing_columns",
    "open_source",
    "pending",
    "stream_files",
    "with_phase",
]
