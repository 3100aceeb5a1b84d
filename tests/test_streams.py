"""Streams run to their end."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strandloom.streaming import windows as ST

AT = datetime(2024, 1, 1)


def events(spark, path, hours, rounds=1):
    """One file of (user, ts) rows a round, as a stream of one file a batch."""
    for i in range(rounds):
        spark.createDataFrame([(u, AT + timedelta(hours=h + 100 * i)) for u, h in hours], "user long, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    return ST.read_stream(spark, path, "user long, ts timestamp")


@pytest.mark.parametrize("rounds", [1, 3])
def test_sessions_are_written_by_the_executors(spark, tmp_path, rounds):
    stream = events(spark, str(tmp_path / "e"), [(1, 0), (1, 1), (1, 5), (2, 1)], rounds)
    out = ST.drain(ST.sessions(stream, "ts", ["user"], "2 hours"), f"s{rounds}", "complete")
    want = [(u, AT + timedelta(hours=a + 100 * i), n) for i in range(rounds) for u, a, n in ((1, 0, 2), (1, 5, 1), (2, 1, 1))]
    assert sorted((r["user"], r["session_start"], r["n"]) for r in out.collect()) == sorted(want)
    # Rows of a memory sink would lie in the driver and come from no file.
    files = out.inputFiles()
    assert files and len({f.rsplit("/", 1)[0] for f in files}) == 1


def test_drain_appends_batches_and_takes_an_empty_stream(spark, tmp_path):
    stream = events(spark, str(tmp_path / "e"), [(1, 0), (2, 1)], 3)
    out = ST.drain(stream.filter(F.col("user") == 1), "appended")
    assert sorted(r["ts"] for r in out.collect()) == [AT + timedelta(hours=100 * i) for i in range(3)] and out.inputFiles()
    spark.createDataFrame([], "user long, ts timestamp").limit(0).write.parquet(str(tmp_path / "none"))
    none = ST.drain(ST.sessions(ST.read_stream(spark, str(tmp_path / "none"), "user long, ts timestamp"), "ts", ["user"], "2 hours"), "none", "complete")
    assert none.collect() == [] and none.columns == ["session_start", "session_end", "user", "n"]
