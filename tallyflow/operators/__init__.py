from tallyflow.operators.history import running_history
from tallyflow.operators.metrics import accumulated, batch_metrics, merge_states, state_of
from tallyflow.operators.ordinals import assign_chunks, ordinals_by_id, ordinals_by_range
from tallyflow.operators.quality import accepted, coerce_rows, rejected, split_valid_rejected
from tallyflow.operators.reports import (
    full_scan_stats,
    recent_history,
    recent_rows,
    reconciliation,
    repeated_batch_ids,
)

__all__ = [
    "accepted",
    "accumulated",
    "assign_chunks",
    "batch_metrics",
    "coerce_rows",
    "full_scan_stats",
    "merge_states",
    "ordinals_by_id",
    "ordinals_by_range",
    "recent_history",
    "recent_rows",
    "reconciliation",
    "rejected",
    "repeated_batch_ids",
    "running_history",
    "split_valid_rejected",
    "state_of",
]
