from types import SimpleNamespace

import pytest

from urbanweave import runtime
from urbanweave.sources.months import write_months


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(master, configured=None, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: configured or default), sparkContext=Context(master, folder)
    )


def test_the_configured_folder_comes_first():
    assert runtime.shared_folder(session("yarn", "hdfs:///shared", "/other")) == "hdfs:///shared"
    assert runtime.shared_folder(session("yarn", None, "hdfs:///context")) == "hdfs:///context"


def test_only_a_local_session_gets_a_folder_of_its_own():
    local = session("local[2]")
    assert runtime.shared_folder(local) == runtime.shared_folder(local) != ""
    with pytest.raises(RuntimeError):
        runtime.shared_folder(session("yarn"))


def test_settled_tables_keep_rows_and_counts(spark):
    kept, rows = runtime.settle_counted(spark.range(10).where("id > 3"))
    assert rows == 6 == kept.count()
    empty, none = runtime.settle_counted(spark.range(10).where("id > 30"))
    assert none == 0 and empty.columns == ["id"] and empty.count() == 0
    assert "FileScan" in kept._jdf.queryExecution().executedPlan().toString()


def test_broadcast_hint_depends_on_the_counted_rows(spark):
    rows = spark.range(10)
    hinted = runtime.small_side(rows, 10)._jdf.queryExecution().logical().toString()
    assert "broadcast" in hinted
    assert runtime.small_side(rows, runtime.BROADCAST_ROW_LIMIT + 1) is rows


def test_small_tasks_end_with_the_block_and_leave_own_settings(spark):
    own, ours = runtime.TASK_BYTES
    usual = spark.conf.get(ours)
    spark.conf.set(own, "5m")
    try:
        with runtime.small_tasks(spark):
            assert spark.conf.get(own) == "5m" and spark.conf.get(ours) == runtime.TASK_BYTES[ours] != usual
        assert spark.conf.get(own) == "5m" and spark.conf.get(ours) == usual
    finally:
        spark.conf.unset(own)


def test_months_are_written_in_small_tasks(spark, tmp_path):
    """A month of many rows is written, and sorted before, in parts."""
    noise = [f"sha2(concat(id, '{n}'), 512) AS c{n}" for n in range(8)]
    trips = spark.range(60_000).selectExpr("timestamp_ntz'2024-01-05 00:00:00' AS trip_start_timestamp", *noise)
    write_months(trips, str(tmp_path / "out"))
    assert len(list((tmp_path / "out" / "year=2024" / "month=01").glob("*.parquet"))) > 1
