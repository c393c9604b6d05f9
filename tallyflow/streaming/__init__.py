from tallyflow.streaming.ingest import IncrementalIngest, IngestOptions, IngestReport
from tallyflow.streaming.warehouse import Commit, Warehouse

__all__ = ["Commit", "IncrementalIngest", "IngestOptions", "IngestReport", "Warehouse"]
