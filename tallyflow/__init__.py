"""Incremental CSV ingest and running statistics on Spark."""

from tallyflow.streaming import IncrementalIngest, IngestOptions, Warehouse

__all__ = ["IncrementalIngest", "IngestOptions", "Warehouse"]
