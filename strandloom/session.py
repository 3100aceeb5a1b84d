"""Session factory and the shared-folder staging used to cut lineage.

``stage`` writes a DataFrame once to the shared folder named by
``spark.checkpoint.dir`` and reads it back, so later jobs neither recompute it
nor depend on blocks held by one executor.  ``discard`` removes a staged folder as soon
as nothing reads it any more; the others go when the driver's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "strandloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Rows are kept as they are (an empty frame stays empty with its schema); column
    order and types are unchanged.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the folder behind a frame made by ``stage``; no plan may read it afterwards.  Other frames are left alone."""
    path = getattr(df, "_staged_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


BROADCAST_ROWS = 100_000
SMALL_BYTES = 1 << 20
BROADCAST_BYTES = 16 << 20


def stored_bytes(df: DataFrame) -> int:
    """Spark's bound on the size of ``df``, from the sizes of the files it reads; costs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS, of: DataFrame | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``limit`` rows in at most ``BROADCAST_BYTES``, else plain.

    The size is measured, not assumed: the frame is staged first, if it isn't yet, so its files can
    be weighed (up to 1 MB is small without counting), and beyond either bound the join is an
    ordinary shuffle join.  Where ``df`` only renames or picks columns of the staged frame ``of``,
    that one is measured.
    """
    s = df if of is not None or hasattr(df, "_staged_path") else stage(df, "side")
    m = s if of is None else of
    size = stored_bytes(m)
    return F.broadcast(s) if size <= SMALL_BYTES or (size <= BROADCAST_BYTES and m.count() <= limit) else s


def table_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """As ``bounded_broadcast`` for a frame that is cheap to count (a small stored table)."""
    size = stored_bytes(df)
    return F.broadcast(df) if size <= SMALL_BYTES or (size <= BROADCAST_BYTES and df.limit(limit + 1).count() <= limit) else df


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle tasks to plan for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
