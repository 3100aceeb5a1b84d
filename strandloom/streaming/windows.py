"""Streaming forms: event-time windows, session-like periods, duplicate marking, running percentile summaries.

The library these operators come from has no event time; these are the same operators
over unbounded tables, with watermarks that bound their state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandloom.session import shared_dir


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes", weight: str | None = None) -> DataFrame:
    """Counts (and weighted counts) per tumbling or sliding event-time window; rows later than ``late`` are dropped."""
    w = F.window(F.col(time), size, slide) if slide else F.window(F.col(time), size)
    aggs = [F.count("*").alias("n")] + ([F.sum(weight).alias("weight")] if weight else [])
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", *(["weight"] if weight else []))


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Periods of activity that close after ``gap`` without a row."""
    s = F.session_window(F.col(time), gap)
    return stream.withWatermark(time, late).groupBy(s.alias("s"), *keys).agg(F.count("*").alias("n")).select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), *keys, "n")


def first_seen(stream: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows without those whose key was seen within the watermark (duplicate removal)."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def bucket_counts(stream: DataFrame, keys: list[str], value: str, alpha: float = 0.01) -> DataFrame:
    """Running counts per logarithmic bucket, whose sums over any keys give percentiles within ``alpha``."""
    import math

    b = F.ceil(F.log(F.col(value)) / math.log((1 + alpha) / (1 - alpha))).cast("long")
    ok = stream.filter((F.col(value) > 0) & (F.col(value) < float("inf")))
    return ok.groupBy(*keys, b.alias("bucket")).agg(F.count("*").alias("n"))


def open_periods(stream: DataFrame, key: str, start: str, end: str, gap: int) -> DataFrame:
    """(key, start_pos, end_pos): covered periods of rows that arrive in order of start per key, emitted when a row starts ``gap`` or more after their end.

    The open period of every key is the state; one that is never closed by a later row
    stays open.  Null keys or bounds and empty intervals are left out.
    """
    ok = stream.filter(F.col(key).isNotNull() & (F.col(end) > F.col(start))).select(F.col(key).alias("key"), F.col(start).alias("s"), F.col(end).alias("e"))

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lo, hi = state.get if state.exists else (None, None)
        out = []
        rows = pd.concat(list(frames)).sort_values(["s", "e"])
        for s, e in zip(rows.s.tolist(), rows.e.tolist()):
            if lo is not None and s - hi >= gap:
                out.append((k[0], lo, hi))
                lo = None
            lo, hi = (s, e) if lo is None else (min(lo, s), max(hi, e))
        if lo is not None:
            state.update((lo, hi))
        yield pd.DataFrame(out, columns=["key", "start_pos", "end_pos"])

    kind = ok.schema["key"].dataType.simpleString()
    return ok.groupBy("key").applyInPandasWithState(step, f"key {kind}, start_pos long, end_pos long", "lo long, hi long", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all data there is and give the result as a table in the shared folder.

    The executors write every batch, so no result passes through the driver; state and progress lie in the shared
    folder too, and are removed at the end.  ``complete`` keeps the last batch, which has all rows.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/{name}"
    out, state = f"{root}/out", f"{root}/state"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(out))
    fs.deleteOnExit(hadoop(root))
    kept: list[str] = []

    def write(rows: DataFrame, batch: int) -> None:
        path = f"{out}/{batch}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        while mode == "complete" and kept:
            fs.delete(hadoop(kept.pop()), True)
        kept.append(path)

    q = stream.writeStream.outputMode(mode).foreachBatch(write).queryName(name).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    fs.delete(hadoop(state), True)
    return spark.read.schema(stream.schema).parquet(*(kept or [out]))
