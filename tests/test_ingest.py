import json
import os
import random
import re
import shutil
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyflow import IncrementalIngest, IngestOptions, Warehouse
from tallyflow.schemas import STATE
from tallyflow.sources.csv_files import ColumnContractError
from tallyflow.streaming import Commit
from tallyflow.streaming.ingest import RepeatedBatchError

HEADER = "timestamp,price,user_id\n"


def write(folder, name, prices, first_user=1):
    lines = [f"2026-01-{i % 28 + 1:02d},{p},{first_user + i}\n" for i, p in enumerate(prices)]
    (folder / name).write_text(HEADER + "".join(lines))
    return str(folder / name)


@pytest.fixture
def source(tmp_path):
    folder = tmp_path / "source"
    folder.mkdir()
    return folder


@pytest.fixture
def target(tmp_path):
    return str(tmp_path / "warehouse")


def state(ingest):
    return tuple(ingest.warehouse.state().first())


def done(ingest):
    return sorted(r["file_name"] for r in ingest.warehouse.processed_files().collect())


def assert_reconciled(ingest):
    row = ingest.reconcile().first()
    assert row["matches"], row


def totals(ingest):
    rows = ingest.warehouse.history().orderBy("total_accumulated_rows").collect()
    return [
        (r["file_name"], r["chunk_index"], r["batch_rows"], r["total_accumulated_rows"], r["accumulated_sum"])
        for r in rows
    ]


def test_files_without_a_byte_are_listed_or_refused(spark, source, target):
    write(source, "a.csv", [1, 2])
    for name in ("empty.csv", "sp ace%25.csv", "validation.csv"):
        (source / name).write_text("")
    (source / "empty.txt").write_text("")
    strict = IncrementalIngest(spark, str(source), target, options=IngestOptions(refuse_empty_files=True))
    names = ["empty.csv", "sp ace%25.csv", "validation.csv"]
    assert sorted(r["file_name"] for r in strict.empty_files().collect()) == names
    with pytest.raises(ColumnContractError, match=r"in 3 file\(s\): empty.csv, sp ace%25.csv, validation.csv"):
        strict.run()
    assert state(strict)[0] == 0
    # By default they wait; once they have content, or are done, they are none of these.
    lenient = IncrementalIngest(spark, str(source), target)
    lenient.run()
    assert state(lenient)[0] == 2
    for name in names:
        write(source, name, [3])
    assert lenient.empty_files().isEmpty()
    strict.run()
    assert state(strict) == (5, 12.0, 1.0, 3.0)
    (source / "a.csv").write_text("")
    assert strict.empty_files().isEmpty()


def test_rows_history_and_rejects_of_one_file(spark, source, target):
    path = write(source, "transactions.csv", ["10", "", "30", "50"])
    ingest = IncrementalIngest(spark, str(source), target, chunk_size=2)
    (report,) = ingest.ingest_files([path])
    assert (report.rows_accepted, report.rows_rejected) == (3, 1)
    assert state(ingest) == (3, 90.0, 10.0, 50.0)
    assert totals(ingest) == [("transactions.csv", 1, 1, 1, 10.0), ("transactions.csv", 2, 2, 3, 90.0)]
    assert_reconciled(ingest)
    raw = ingest.warehouse.raw_transactions().orderBy("ordinal").collect()
    assert [(r["price"], r["user_id"], r["chunk_index"], r["ordinal"]) for r in raw] == [
        (10.0, 1, 1, 0), (30.0, 3, 2, 2), (50.0, 4, 2, 3),
    ]
    (reject,) = ingest.warehouse.rejected_transactions().collect()
    assert (reject["price"], reject["raw_price"], reject["user_id"]) == (None, None, 2)
    assert reject["reject_reason"] == "PRICE_NULL_OR_NON_NUMERIC"
    # A chunk's accepted rows, rejects and history row share one id and one clock.
    assert reject["batch_id"] == raw[0]["batch_id"]
    loaded = {r["loaded_at"] for r in raw}
    assert loaded == {r["processed_at"] for r in ingest.warehouse.history().collect()}


def test_second_pass_skips_and_a_new_object_resumes(spark, source, target):
    path = write(source, "transactions.csv", ["10", "", "30", "50"])
    validation = write(source, "validation.csv", ["70"])
    ingest = IncrementalIngest(spark, str(source), target, chunk_size=2)
    ingest.ingest_files([path])
    assert ingest.ingest_files([path]) == []
    assert (state(ingest), done(ingest)) == ((3, 90.0, 10.0, 50.0), ["transactions.csv"])
    resumed = IncrementalIngest(spark, str(source), target, chunk_size=2)
    resumed.ingest_files([validation])
    assert state(resumed) == (4, 160.0, 10.0, 70.0)
    assert done(resumed) == ["transactions.csv", "validation.csv"]
    assert_reconciled(resumed)


def test_run_takes_only_new_arrivals(spark, source, target):
    write(source, "batch-a.csv", ["10"])
    write(source, "batch-b.csv", ["20"])
    ingest = IncrementalIngest(spark, str(source), target, chunk_size=1)
    ingest.run()
    assert state(ingest) == (2, 30.0, 10.0, 20.0)
    write(source, "batch-c.csv", ["30"])
    old = write(source, "batch-d.csv", ["40"])
    os.utime(old, (time.time() - 90 * 86400,) * 2)
    ingest = IncrementalIngest(spark, str(source), target, chunk_size=1)
    ingest.run()
    assert state(ingest) == (4, 100.0, 10.0, 40.0)
    assert done(ingest) == [f"batch-{x}.csv" for x in "abcd"]
    assert [t[3:] for t in totals(ingest)] == [(1, 10.0), (2, 30.0), (3, 60.0), (4, 100.0)]
    # A known name with other content is not taken again.
    write(source, "batch-a.csv", ["1000"])
    assert ingest.run() == []


def test_validation_file_comes_last_and_needs_a_source_file(spark, source, target):
    write(source, "validation.csv", ["1"])
    ingest = IncrementalIngest(spark, str(source), target)
    with pytest.raises(FileNotFoundError):
        ingest.run()
    write(source, "zz.csv", ["2", "3"])
    ingest.run()
    assert [(t[0], t[3]) for t in totals(ingest)] == [("zz.csv", 2), ("validation.csv", 3)]
    assert ingest.discover().count() == 1
    assert ingest.discover(include_validation=True).count() == 2


def test_chunks_and_files_without_an_accepted_row(spark, source, target):
    write(source, "a.csv", ["x", "nan", "5", "7"])
    write(source, "b.csv", ["", "N/A", "12d"])
    (source / "c.csv").write_text(HEADER)
    ingest = IncrementalIngest(spark, str(source), target, chunk_size=2)
    ingest.run()
    assert totals(ingest) == [("a.csv", 2, 2, 2, 12.0)]
    assert done(ingest) == ["a.csv", "b.csv", "c.csv"]
    assert ingest.warehouse.rejected_transactions().count() == 5


def test_given_order_and_repeated_names(spark, source, target, tmp_path):
    other = tmp_path / "other"
    other.mkdir()
    paths = [write(source, "b.csv", ["1"]), write(source, "a.csv", ["2"]), write(other, "b.csv", ["9"])]
    ingest = IncrementalIngest(spark, str(source), target)
    ingest.ingest_files(paths)
    assert [t[0] for t in totals(ingest)] == ["b.csv", "a.csv"]
    assert state(ingest) == (2, 3.0, 1.0, 2.0)
    start = spark.createDataFrame([(4, 100.0, -5.0, 7.0)], STATE)
    ingest.ingest_files([write(source, "c.csv", ["50"])], start)
    assert state(ingest) == (5, 150.0, -5.0, 50.0)
    (source / "empty.csv").write_text("")
    with pytest.raises(ColumnContractError, match="empty.csv"):
        ingest.ingest_files([str(source / "empty.csv")])


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["_write_history", "_next_commit"])
@pytest.mark.parametrize("lose_checkpoint", [False, True])
def test_crash_before_the_commit_leaves_nothing_and_replays_once(
    spark, source, target, monkeypatch, step, lose_checkpoint
):
    write(source, "a.csv", ["1", "2", "x"])
    ingest = IncrementalIngest(spark, str(source), target, chunk_size=2)
    ingest.run()
    write(source, "b.csv", ["3", "4", "y"])

    def crash(*_args, **_kwargs):
        raise Crash(step)

    with monkeypatch.context() as patched:
        patched.setattr(IncrementalIngest, step, crash)
        with pytest.raises(Crash):
            ingest.run()
    assert state(ingest) == (2, 3.0, 1.0, 2.0)
    assert ingest.warehouse.raw_transactions().count() == 2
    assert_reconciled(ingest)

    # More arrives before the restart, so the replay may not even name the same files.
    write(source, "c.csv", ["5"])
    if lose_checkpoint:
        shutil.move(f"{target}/_checkpoints", f"{target}/lost")
    resumed = IncrementalIngest(spark, str(source), target, chunk_size=2)
    resumed.run()
    assert state(resumed) == (5, 15.0, 1.0, 5.0)
    assert resumed.warehouse.raw_transactions().count() == 5
    assert resumed.warehouse.rejected_transactions().count() == 2
    assert done(resumed) == ["a.csv", "b.csv", "c.csv"]
    assert_reconciled(resumed)


def test_crash_after_the_commit_is_not_repeated(spark, source, target, monkeypatch):
    write(source, "a.csv", ["1", "2"])
    ingest = IncrementalIngest(spark, str(source), target)
    append = Warehouse.append_commit

    def append_then_crash(self, *args):
        append(self, *args)
        raise Crash("after commit")

    with monkeypatch.context() as patched:
        patched.setattr(Warehouse, "append_commit", append_then_crash)
        with pytest.raises(Crash):
            ingest.run()
    assert IncrementalIngest(spark, str(source), target).run() == []
    assert state(ingest) == (2, 3.0, 1.0, 2.0)
    assert_reconciled(ingest)


def test_bad_header_aborts_or_is_set_aside(spark, source, target):
    write(source, "a.csv", ["1"])
    (source / "bad.csv").write_text("timestamp,cost,uid\nd,1,2\n")
    ingest = IncrementalIngest(spark, str(source), target)
    with pytest.raises(ColumnContractError, match="bad.csv: price, user_id"):
        ingest.run()
    assert done(ingest) == []
    tolerant = IncrementalIngest(
        spark, str(source), target, options=IngestOptions(quarantine_bad_files=True)
    )
    tolerant.run()
    assert done(tolerant) == ["a.csv"]
    (aside,) = tolerant.warehouse.quarantined_files().collect()
    assert (aside["file_name"], aside["missing"]) == ("bad.csv", ["price", "user_id"])
    # Repaired in place under the same name, it is taken by the next run.
    write(source, "bad.csv", ["4"])
    tolerant.run()
    assert (done(tolerant), state(tolerant)) == (["a.csv", "bad.csv"], (2, 5.0, 1.0, 4.0))
    assert tolerant.warehouse.quarantined_files().isEmpty()


def test_large_work_is_split_into_several_ingests(spark, source, target):
    for name in "abcde":
        write(source, f"{name}.csv", ["1", "2"])
    options = IngestOptions(chunk_size=2, max_files_per_ingest=2)
    ingest = IncrementalIngest(spark, str(source), target, options=options)
    assert [r.files for r in ingest.run()] == [("a.csv", "b.csv"), ("c.csv", "d.csv"), ("e.csv",)]
    assert totals(ingest) == [(f"{n}.csv", 1, 2, 2 * i, 3.0 * i) for i, n in enumerate("abcde", 1)]
    by_size = IngestOptions(max_bytes_per_ingest=1)
    assert len(IncrementalIngest(spark, str(source), target + "2", options=by_size).run()) == 5


def test_state_documents(spark, source, target, tmp_path):
    write(source, "b.csv", ["10", "20"])
    write(source, "a.csv", ["5"])
    ingest = IncrementalIngest(spark, str(source), target)
    empty = json.loads(ingest.warehouse.state_document().first()[0])
    assert empty == {
        "global_count": 0, "global_sum": 0.0, "global_min": "Infinity", "global_max": "-Infinity",
        "processed_files": [],
    }
    ingest.run()
    exported = str(tmp_path / "exported")
    ingest.warehouse.export_state(exported)
    text = "\n".join(r["value"] for r in spark.read.text(exported, wholetext=True).collect())
    assert json.loads(text) == {
        "global_count": 3, "global_sum": 35.0, "global_min": 5.0, "global_max": 20.0,
        "processed_files": ["a.csv", "b.csv"],
    }
    with pytest.raises(ValueError, match="empty warehouse"):
        ingest.warehouse.import_state(exported)
    # A warehouse that starts from the document goes on where it stopped.
    write(source, "c.csv", ["1"])
    successor = IncrementalIngest(spark, str(source), target + "2")
    successor.warehouse.import_state(exported)
    successor.run()
    assert (state(successor), done(successor)) == ((4, 36.0, 1.0, 20.0), ["a.csv", "b.csv", "c.csv"])


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_state_however_files_are_split_into_runs(spark, source, target, tmp_path, seed):
    """Each price is a double, their sum is not; every digit outlives commits, snapshots and documents."""
    rng = random.Random(seed)
    waiting = [(f"f{i}.csv", [f"{rng.randint(10**12, 10**13)}.{rng.randint(10, 99)}" for _ in range(40)]) for i in range(6)]
    everything = sum(Decimal(p) for _, prices in waiting for p in prices)
    assert Decimal(float(everything)) != everything
    rng.shuffle(waiting)
    options = IngestOptions(chunk_size=7, sum_scale=2)
    ingest = IncrementalIngest(spark, str(source), target, options=options)
    ingest.warehouse.snapshot_every = 2
    while waiting:
        for _ in range(rng.randint(1, 2)):
            if waiting:
                write(source, *waiting.pop())
        ingest.run()
        if len(waiting) == 3:
            # Goes on in another warehouse, from the document of the first.
            ingest.warehouse.export_state(str(tmp_path / "state"))
            ingest = IncrementalIngest(spark, str(source), target + "2", options=options)
            ingest.warehouse.import_state(str(tmp_path / "state"))
    row = ingest.warehouse.state(exact=True).first()
    assert (row.global_count, row.global_exact, row.global_sum) == (240, str(everything), float(everything))


def test_an_exact_sum_that_belongs_to_another_state_is_left_out(spark, source, target, tmp_path):
    path = tmp_path / "state.json"
    path.write_text('{"global_count": 2, "global_sum": 9.5, "global_exact": "9.25"}')
    warehouse = Warehouse(spark, target).initialize()
    warehouse.import_state(str(path))
    assert tuple(warehouse.state(exact=True).first())[-1] is None
    # The double counts then, and given totals displace the exact sum as well.
    write(source, "a.csv", ["0.25"])
    write(source, "b.csv", ["0.5"])
    ingest = IncrementalIngest(spark, str(source), target, options=IngestOptions(sum_scale=2))
    ingest.ingest_files([str(source / "a.csv")])
    assert ingest.warehouse.latest_commit().global_exact == "9.75"
    ingest.ingest_files([str(source / "b.csv")], spark.createDataFrame([(1, 1.0, 1.0, 1.0)], STATE))
    assert ingest.warehouse.latest_commit().global_exact == "1.50"


@pytest.mark.parametrize(
    "document, expected",
    [
        ("{}", (0, 0.0, None, None)),
        ('{"global_count": 0, "global_min": Infinity, "global_max": -Infinity}', (0, 0.0, None, None)),
        ('{"global_count": 2, "global_sum": 3, "global_min": 1, "processed_files": ["x"]}', (2, 3.0, 1.0, None)),
        ("[]", ValueError),
        ('{"processed_files": "x"}', ValueError),
    ],
)
def test_imported_documents_are_checked(spark, target, tmp_path, document, expected):
    path = tmp_path / "state.json"
    path.write_text(document)
    warehouse = Warehouse(spark, target).initialize()
    if expected is ValueError:
        with pytest.raises(ValueError):
            warehouse.import_state(str(path))
    else:
        warehouse.import_state(str(path))
        assert tuple(warehouse.state().first()) == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_of_files_into_runs_gives_the_full_aggregate(spark, source, target, seed):
    rng = random.Random(seed)
    prices, waiting = [], []
    for i in range(7):
        values = [rng.choice(["", "x", str(rng.randint(-99, 99))]) for _ in range(rng.randint(0, 30))]
        waiting.append((f"f{i}.csv", values))
        prices += [float(v) for v in values if v not in ("", "x")]
    rng.shuffle(waiting)
    ingest = None
    while waiting:
        for _ in range(rng.randint(1, 3)):
            if waiting:
                write(source, *waiting.pop())
        ingest = IncrementalIngest(spark, str(source), target, chunk_size=rng.randint(1, 9))
        ingest.run()
    assert state(ingest) == (len(prices), sum(prices), min(prices), max(prices))
    assert_reconciled(ingest)
    recent = ingest.warehouse.history().orderBy(F.desc("total_accumulated_rows")).first()
    assert recent["accumulated_avg"] == sum(prices) / len(prices)


def test_source_options_and_column_names(spark, source, target):
    (source / "a.csv").write_text("user_id,note,price,timestamp\n7.5,x,inf,1/2/2026\n8,y,1,bad\n9,z,2,2026-02-03,extra\n")
    ingest = IncrementalIngest(spark, str(source), target)
    ingest.run()
    raw = ingest.warehouse.raw_transactions().orderBy("ordinal").collect()
    assert [(r["price"], r["user_id"]) for r in raw] == [(float("inf"), None), (1.0, 8)]
    (reject,) = ingest.warehouse.rejected_transactions().collect()
    assert (reject["reject_reason"], reject["raw_price"]) == ("ROW_LONGER_THAN_HEADER", "2")
    with pytest.raises(ValueError):
        IncrementalIngest(spark, str(source), target, chunk_size=0)


def test_long_running_query(spark, source, target):
    write(source, "a.csv", ["1"])
    ingest = IncrementalIngest(
        spark, str(source), target, options=IngestOptions(max_files_per_trigger=1)
    )
    query = ingest.start("100 milliseconds")
    try:
        query.processAllAvailable()
        assert state(ingest) == (1, 1.0, 1.0, 1.0)
        write(source, "b.csv", ["2"])
        write(source, "validation.csv", ["9"])
        query.processAllAvailable()
    finally:
        query.stop()
    assert (state(ingest), done(ingest)) == ((2, 3.0, 1.0, 2.0), ["a.csv", "b.csv"])


def test_corrected_file_after_a_crash_leaves_no_old_reject(spark, source, target, monkeypatch):
    path = write(source, "a.csv", ["x", "2"])
    ingest = IncrementalIngest(spark, str(source), target)
    with monkeypatch.context() as patched:
        patched.setattr(IncrementalIngest, "_next_commit", lambda *_: (_ for _ in ()).throw(Crash("now")))
        with pytest.raises(Crash):
            ingest.run()
    write(source, "a.csv", ["1", "2"])
    os.utime(path, (time.time() + 5, time.time() + 5))
    ingest.run()
    assert ingest.warehouse.raw_transactions().count() == 2
    assert ingest.warehouse.rejected_transactions().count() == 0
    assert state(ingest) == (2, 3.0, 1.0, 2.0)


@pytest.mark.parametrize("files", [10_000, 1])
def test_missing_columns_commit_nothing_however_work_is_split(spark, source, target, files):
    write(source, "a.csv", ["1"])
    (source / "b.csv").write_text("timestamp,user_id\n1/1/2012,3\n")
    ingest = IncrementalIngest(spark, str(source), target, options=IngestOptions(max_files_per_ingest=files))
    with pytest.raises(ColumnContractError, match="b.csv: price"):
        ingest.run()
    assert done(ingest) == [] and ingest.warehouse.raw_transactions().count() == 0


def test_equal_names_in_nested_folders(spark, source, target):
    below = source / "sub"
    below.mkdir()
    paths = [write(below, "a.csv", ["9"]), write(source, "a.csv", ["1"])]
    ingest = IncrementalIngest(spark, str(source), target)
    ingest.ingest_files([paths[1], paths[0]])
    assert state(ingest) == (1, 1.0, 1.0, 1.0)


def test_hidden_names_are_refused_and_odd_directories_read(spark, source, target):
    odd = source / "in[1]"
    odd.mkdir()
    write(odd, "a.csv", ["1"])
    ingest = IncrementalIngest(spark, str(odd), target)
    ingest.run()
    assert done(ingest) == ["a.csv"]
    write(odd, "_b.csv", ["1"])
    write(odd, ".c.csv", ["1"])
    with pytest.raises(ValueError, match=r"\.c\.csv, _b\.csv"):
        ingest.run()


def test_chunk_size_beside_options(spark, source, target):
    ingest = IncrementalIngest(spark, str(source), target, 3, IngestOptions(sum_scale=2))
    assert (ingest.options.chunk_size, ingest.options.sum_scale) == (3, 2)
    assert IncrementalIngest(spark, str(source), target).options.chunk_size == 10
    assert IncrementalIngest(spark, str(source), target, options=IngestOptions(chunk_size=7)).options.chunk_size == 7


def test_one_ingest_lists_only_its_own_folder(spark, source, target):
    for name in "ab":
        write(source, f"{name}.csv", ["1"])
        ingest = IncrementalIngest(spark, str(source), target)
        (report,) = ingest.run()
    files = ingest.warehouse.uncommitted_raw(report.ingest_key).inputFiles()
    assert files and all(f"ingest_key={report.ingest_key}" in f for f in files)


def test_snapshots_bound_the_files_opened(spark, source, target):
    """However many commits there are, a reader opens one snapshot and the epochs after it."""
    warehouse = Warehouse(spark, target, snapshot_every=3).initialize()
    opened, empty = [], spark.createDataFrame([], "file_name string")
    for version in range(1, 11):
        warehouse.append_commit(Commit(version, version, 1.0 * version, 1.0, 2.0), f"key{version}", [f"f{version}-{i}.csv" for i in range(20)])
        names = warehouse.processed_files()
        opened.append(len(names.inputFiles()))
        assert (names.count(), names.distinct().count()) == (20 * version, 20 * version)
        assert warehouse.commits().count() == version and warehouse.latest_commit().version == version
        assert tuple(warehouse.state().first()) == (version, 1.0 * version, 1.0, 2.0)
    assert max(opened) <= 64 + 2
    few = spark.createDataFrame([("f1-3.csv",), ("f10-19.csv",), ("new.csv",)], "file_name string")
    assert [r["file_name"] for r in warehouse.pending(few).collect()] == ["new.csv"]
    plan = warehouse.processed_files([5])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert warehouse.pending(empty).count() == 0
    assert sum(name.startswith("upto=") for name in os.listdir(f"{target}/snapshots")) == 3


def test_incomplete_snapshot_is_not_looked_at(spark, target):
    warehouse = Warehouse(spark, target, snapshot_every=2).initialize()
    for version in range(1, 4):
        warehouse.append_commit(Commit(version), f"key{version}", [f"f{version}.csv"])
    # A crash before the keys were written.
    shutil.rmtree(f"{target}/snapshots/upto=0/keys")
    assert warehouse.processed_files().count() == 3
    warehouse.append_commit(Commit(4), "key4", ["f4.csv"])
    assert warehouse.processed_files().count() == 4 and len(warehouse.processed_files().inputFiles()) <= 4
    assert warehouse.latest_commit().version == 4


def test_ingests_across_snapshots(spark, source, target):
    ingest = IncrementalIngest(spark, str(source), target, chunk_size=2)
    ingest.warehouse.snapshot_every = 2
    for k in range(5):
        write(source, f"batch-{k}.csv", [str(10 * k + 1), "", str(10 * k + 2)])
        (report,) = ingest.run()
        assert report.version == k + 1
    assert ingest.run() == []
    assert_reconciled(ingest)
    assert ingest.warehouse.raw_transactions().count() == 10
    places = ingest.warehouse.raw_transactions().select("file_name", "ingest_no", "file_no").distinct().collect()
    assert sorted(map(tuple, places)) == [(f"batch-{k}.csv", k + 1, 1) for k in range(5)]


def test_only_pending_files_reach_the_driver(spark, source, target, monkeypatch):
    ingest = IncrementalIngest(spark, str(source), target)
    done = [f"old-{k:05d}.csv" for k in range(10_000)]
    for name in done[:300]:
        (source / name).write_text(HEADER)
    ingest.warehouse.append_commit(Commit(1), "old", done)
    write(source, "new-1.csv", ["1"])
    write(source, "new-2.csv", ["2"])
    collected = []
    monkeypatch.setattr(ingest, "_collect", lambda files, own=ingest._collect: collected.append(own(files)) or collected[-1])
    (report,) = ingest.run()
    assert report.files == ("new-1.csv", "new-2.csv")
    assert sorted(f.file_name for files in collected for f in files) == ["new-1.csv", "new-2.csv"]


def test_a_repeated_batch_id_aborts_before_the_commit(spark, source, target):
    path = write(source, "a.csv", ["1", "2", "3"])
    ingest = IncrementalIngest(spark, str(source), target, chunk_size=2)
    ingest.ingest_files([path])
    # Its name is forgotten, its history is not.
    ingest.warehouse.processed_files = lambda buckets=None: spark.createDataFrame([], "file_name string")
    write(source, "a.csv", ["1", "2", "3", "4"])
    other = write(source, "b.csv", ["5"])
    with pytest.raises(RepeatedBatchError, match="a-lote-0001"):
        ingest.ingest_files([other, path])
    assert ingest.warehouse.latest_commit().version == 1 and ingest.warehouse.raw_transactions().count() == 3
    (report,) = ingest.ingest_files([other])
    assert report.version == 2


def test_several_ingests_share_one_pass(spark, source, target, monkeypatch):
    """Files are read and rows written once for all of them; keys, counts, states and commits stay apart."""
    prices = {"a": ["1", "x"], "b": ["2", "3", ""], "c": ["x"], "d": ["4", "5", "6"], "e": ["7"], "f": ["8", ""], "g": ["9"]}
    for name, given in prices.items():
        write(source, f"{name}.csv", given)
    options = IngestOptions(chunk_size=2, max_files_per_ingest=1, sum_scale=2)
    ingest = IncrementalIngest(spark, str(source), target, options=options)
    ingest.warehouse.snapshot_every = 3
    passes = []
    monkeypatch.setattr(ingest, "_write_transactions", lambda files, *a, own=ingest._write_transactions: passes.append(len(files)) or own(files, *a))
    reports = ingest.run()
    assert passes == [7]
    assert [(r.version, r.files, r.rows_accepted, r.rows_rejected) for r in reports] == [
        (1, ("a.csv",), 1, 1), (2, ("b.csv",), 2, 1), (3, ("c.csv",), 0, 1), (4, ("d.csv",), 3, 0), (5, ("e.csv",), 1, 0), (6, ("f.csv",), 1, 1), (7, ("g.csv",), 1, 0),
    ]
    assert [(r.state.global_count, r.state.global_sum, r.state.global_exact) for r in reports] == [
        (n, float(s), f"{s}.00") for n, s in ((1, 1), (3, 6), (3, 6), (6, 21), (7, 28), (8, 36), (9, 45))
    ]
    assert len({r.ingest_key for r in reports}) == 7 == ingest.warehouse.commits().count()
    assert len(os.listdir(f"{target}/commits")) == 3 and os.listdir(f"{target}/snapshots") == ["upto=1"]
    rows = ingest.warehouse.raw_transactions().select("file_name", "ingest_no", "file_no", "ingest_key").distinct().collect()
    assert {tuple(r) for r in rows} == {(f, r.version, 1, r.ingest_key) for r in reports for f in r.files if r.rows_accepted}
    assert totals(ingest)[-1] == ("g.csv", 1, 1, 9, 45.0)
    assert_reconciled(ingest)
    assert ingest.run() == []


def test_in_one_pass_bad_files_are_set_aside_and_ingests_before_a_repeated_id_count(spark, source, target):
    paths = [write(source, f"{name}.csv", ["1", "2", "3"]) for name in "abc"]
    (source / "bad.csv").write_text("timestamp,cost,uid\nd,1,2\n")
    (source / "b.csv").write_text("timestamp,cost\nd,1\n")
    options = IngestOptions(chunk_size=2, max_files_per_ingest=2, quarantine_bad_files=True)
    ingest = IncrementalIngest(spark, str(source), target, options=options)
    assert [r.files for r in ingest.run()] == [("a.csv",), ("c.csv",)]
    assert sorted(r["file_name"] for r in ingest.warehouse.quarantined_files().collect()) == ["b.csv", "bad.csv"]
    # The name of c is forgotten, its history is not.
    ingest.warehouse.processed_files = lambda buckets=None: spark.createDataFrame([], "file_name string")
    new = [write(source, f"{name}.csv", ["5"]) for name in "xyz"]
    write(source, "c.csv", ["1", "2", "3", "4"])
    with pytest.raises(RepeatedBatchError, match="c-lote-0001"):
        ingest.ingest_files([*new[:2], paths[2], new[2]])
    assert ingest.warehouse.latest_commit().version == 3 and state(ingest)[:2] == (8, 22.0)
    assert ingest.warehouse.raw_transactions().where("file_name IN ('x.csv', 'y.csv', 'z.csv')").count() == 2
