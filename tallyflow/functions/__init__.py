from tallyflow.functions.coerce import parse_price, parse_timestamp, parse_user_id
from tallyflow.functions.text import (
    batch_id,
    batch_summary_line,
    file_stem,
    scan_summary_line,
    two_decimals,
)

__all__ = [
    "batch_id",
    "batch_summary_line",
    "file_stem",
    "parse_price",
    "parse_timestamp",
    "parse_user_id",
    "scan_summary_line",
    "two_decimals",
]
