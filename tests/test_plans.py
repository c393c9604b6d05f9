"""Plan shape: what is shuffled, pushed down, reused and kept out of the driver."""

import os
import re

import pytest

from tallyflow import IncrementalIngest
from tallyflow import operators as ops
from tallyflow.plans import feeds
from tallyflow.plans.catalog import QUERIES
from tallyflow.session import prepare
from tallyflow.sources import csv_files

SF_DIR = "/root/testdata/sf0.001"

needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def executed(frame):
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    return plan(frame).split("== Initial Plan ==")[0]


@needs_tables
def test_history_shuffles_the_rows_once(spark):
    text = executed(QUERIES["running_history"](spark, SF_DIR))
    by_bucket = re.findall(r"Exchange hashpartitioning\(file_name#\d+, _bucket", text)
    # One for the rows and one for the counts that were aggregated before it.
    assert len(by_bucket) == 2
    assert "ReusedExchange" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@needs_tables
def test_no_query_joins_without_a_key(spark):
    for name, query in QUERIES.items():
        if "ingest" in name or "roundtrip" in name:
            continue
        text = plan(query(spark, SF_DIR))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


@needs_tables
def test_scans_read_only_what_is_asked(spark):
    text = plan(QUERIES["full_scan_stats"](spark, SF_DIR))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>" in text
    text = plan(QUERIES["coerced_rows"](spark, SF_DIR))
    assert "Exchange" not in text


@needs_tables
def test_top_k_does_not_sort_everything(spark):
    for name in ("recent_history", "recent_rows"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, SF_DIR))


@needs_tables
def test_batch_metrics_aggregate_before_the_shuffle(spark):
    text = plan(ops.batch_metrics(feeds.event_coerced(spark, SF_DIR)))
    assert "partial_sum(price" in text and "SortAggregate" not in text


def test_lines_are_read_without_a_shuffle(spark, tmp_path):
    prepare(spark)
    path = tmp_path / "a.csv"
    path.write_text("timestamp,price,user_id\n1/1/2026,2,3\n")
    survey = csv_files.survey_blocks(csv_files.line_scan(spark, [str(path)]))
    assert "SortAggregate" not in plan(survey)
    survey.write.parquet(str(tmp_path / "blocks"))
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    rows = csv_files.read_source_rows(spark, [str(path)], blocks, csv_files.read_layout(blocks))
    text = plan(ops.coerce_rows(ops.assign_chunks(rows, 10)))
    lines_side, offsets_side = text.split("BroadcastExchange")
    assert "FileScan csv" in lines_side and "Exchange" not in lines_side
    assert "FileScan parquet" in offsets_side


def test_stored_prices_are_scanned_narrowly(spark, tmp_path):
    (tmp_path / "source").mkdir()
    (tmp_path / "source" / "a.csv").write_text("timestamp,price,user_id\n1/1/2026,2,3\n")
    ingest = IncrementalIngest(spark, str(tmp_path / "source"), str(tmp_path / "warehouse"))
    ingest.run()
    text = plan(ops.full_scan_stats(ingest.warehouse.raw_transactions()))
    scan = next(line for line in text.splitlines() if "FileScan parquet [price" in line)
    assert "PushedFilters: [IsNotNull(price)]" in scan
    assert "ReadSchema: struct<price:double>" in scan
    assert re.search(r"PartitionFilters: \[[^\]]*branch#\d+ = raw", scan)
