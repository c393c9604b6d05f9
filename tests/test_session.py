import os
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyflow import session
from tallyflow.session import prepare, remove, shared_dir, written


def fake(checkpoint_dir, master="local[2]"):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: checkpoint_dir),
        sparkContext=SimpleNamespace(applicationId="app-1", master=master, getCheckpointDir=lambda: None, _jsc=None),
    )


def test_shared_dir_follows_the_cluster_setting():
    assert shared_dir(fake("hdfs://n/ckpt/"), "x").startswith("hdfs://n/ckpt/x-")
    assert "/tallyflow-app-1/x-" in shared_dir(fake(None), "x")
    assert shared_dir(fake("s3a://b"), "x") != shared_dir(fake("s3a://b"), "x")


def test_shared_dir_needs_a_shared_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(fake(None, "spark://host:7077"), "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(fake(None, "local-cluster[2,1,1024]"), "x")


def test_written_tables_are_removed(spark):
    table = written(spark.range(5), "some-rows")
    (path,) = {file.rpartition("/")[0] for file in table.inputFiles()}
    assert table.count() == 5
    remove(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))


def test_prepare_keeps_what_the_user_set(spark):
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "3")
    try:
        prepare(spark)
        assert spark.conf.get(key) == "3"
        spark.conf.unset(key)
        prepare(spark)
        assert spark.conf.get(key) == str(spark.sparkContext.defaultParallelism)
    finally:
        if before:
            spark.conf.set(key, before)


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {name for folder in folders for _, _, names in os.walk(folder.toString()) for name in names if name.startswith("shuffle_")}


def test_stored_tables_leave_no_shuffle_and_are_deleted_once_released(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda s, purpose: session._MADE.append((s, str(tmp_path / purpose))) or str(tmp_path / purpose))
    before, own = shuffle_files(spark), spark.conf.get(session.SHUFFLE_CLEANUP, None)
    table = session.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    other = session.written(table, "other")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and spark.conf.get(session.SHUFFLE_CLEANUP, None) == own
    assert table.count() == other.count() == 7
    session.released(table)
    assert not (tmp_path / "counted").exists() and other.count() == 7
    session.released(other)
    assert not any(path.startswith(str(tmp_path)) for _, path in session._MADE)
