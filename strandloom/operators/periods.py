"""Continuous covered periods and the gaps between them, by a distributed sweep line.

Boundaries become +1 / -1 events, equal positions are added up first, and the
events are range-partitioned by (key, position).  The running number of open
intervals is a prefix sum in two levels: inside each range partition, and over the
small table of partition totals.  No key is ever held by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import bounded_broadcast, stage


def range_numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` range-partitioned by ``order`` with the partition's number in ``_pid``."""
    return df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_pid", F.spark_partition_id())


def sweep(df: DataFrame, key: str, start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """Piecewise constant coverage events: (key, pos, delta, active) with ``active`` counted from ``pos`` on.

    Rows with a null key, a null bound or end <= start are no intervals.  Equal
    intervals count as often as they occur.  An empty frame gives no rows.
    """
    k = F.col(key).alias("key")
    ok = df.filter(F.col(key).isNotNull() & F.col(start).isNotNull() & (F.col(end) > F.col(start)))
    both = F.array(F.struct(F.col(start).cast("long").alias("pos"), F.lit(1).cast("long").alias("delta")), F.struct(F.col(end).cast("long").alias("pos"), F.lit(-1).cast("long").alias("delta")))
    events = ok.select(k, F.inline(both)).groupBy("key", "pos").agg(F.sum("delta").alias("delta"))
    local = Window.partitionBy("_pid", "key").orderBy("pos")
    # (partition, key) groups are at most one range partition in size.
    staged = stage(range_numbered(events, ["key", "pos"]).withColumn("_run", F.sum("delta").over(local)), "sweep")
    totals = staged.groupBy("key", "_pid").agg(F.sum("delta").alias("_d"))
    before = totals.select("key", "_pid", (F.sum("_d").over(Window.partitionBy("key").orderBy("_pid")) - F.col("_d")).alias("_before"))
    return staged.join(bounded_broadcast(before), ["key", "_pid"]).select("key", "pos", "delta", "_pid", (F.col("_run") + F.col("_before")).alias("active"))


def periods_and_gaps(df: DataFrame, key: str, start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """(kind, key, start_pos, end_pos): ``period`` rows and the ``gap`` rows between neighbouring ones.

    Touching intervals make one period; a gap always has both neighbours.  Null keys,
    null bounds and empty or exchanged intervals are left out.
    """
    ev = sweep(df, key, start, end)
    prev = F.col("active") - F.col("delta")
    # Events with delta 0 are touching ends: neither start nor end.
    edges = ev.filter(((prev == 0) & (F.col("active") > 0)) | ((prev > 0) & (F.col("active") == 0)))
    edges = edges.select("key", "pos", "_pid", (F.col("active") > 0).alias("_open"))
    edges = stage(edges.withColumn("_next", F.lead("pos").over(Window.partitionBy("_pid", "key").orderBy("pos"))), "edges")
    firsts = edges.groupBy("key", "_pid").agg(F.min("pos").alias("_first"))
    after = firsts.select("key", "_pid", F.lead("_first").over(Window.partitionBy("key").orderBy("_pid")).alias("_after"))
    full = edges.join(bounded_broadcast(after), ["key", "_pid"]).withColumn("_next", F.coalesce("_next", "_after"))
    return full.filter(F.col("_next").isNotNull()).select(F.when(F.col("_open"), "period").otherwise("gap").alias("kind"), "key", F.col("pos").alias("start_pos"), F.col("_next").alias("end_pos"))
