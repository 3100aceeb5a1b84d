"""Per-key results when a few keys hold most records.

Fragment-replicate by estimated load:

1. *Combine.* For sums, rows are first combined per map batch; what is weighed and moved
   from then on are the combined rows.
2. *Estimate.* Loads are counted over hash buckets of all these rows and, inside the
   heavy buckets, per key.  The estimate only steers placement; no result depends
   on it.
3. *Plan.* On the driver, buckets (some per task) and heavy keys (at most a few per task) are
   bin-packed to tasks, largest first; a key above a task's fair share is split
   into shards in proportion to its load, each shard to another task.
4. *Run.* Rows are sent to the task of their shard with ``repartitionById`` and aggregated
   there.  Only keys with several shards meet a second, tiny aggregation.
5. *Join.* ``balanced_join`` sends a matching row to exactly those tasks that hold
   a shard of its key.

A row's shard follows from a hash of the row itself, so a task that runs again after
a lost executor sends its rows where the first run sent them.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import parallelism, stage

LEAST_BUCKETS = 4096


@dataclass
class LoadPlan:
    """Where keys go: task of every hash bucket, and the shard tasks of every split or heavy key."""

    tasks: int
    bucket_task: list[int]
    heavy: dict[int, list[int]] = field(default_factory=dict)

    def with_tasks(self, df: DataFrame, hash_col: str) -> DataFrame:
        """``df`` with ``__tasks`` (array<int>): the tasks that hold shards of the key with this hash.

        The two lists are broadcast; they have a few entries per task, whatever the data.
        """
        spark = df.sparkSession
        at = F.pmod(F.col(hash_col), F.lit(len(self.bucket_task)))
        light = spark.createDataFrame(list(enumerate(self.bucket_task)), "__bucket long, __light int")
        out = df.withColumn("__bucket", at).join(F.broadcast(light), "__bucket").drop("__bucket")
        if not self.heavy:
            return out.withColumn("__tasks", F.array("__light")).drop("__light")
        heavy = spark.createDataFrame(list(self.heavy.items()), "__heavy long, __shards array<int>")
        out = out.join(F.broadcast(heavy), F.col(hash_col) == F.col("__heavy"), "left")
        return out.withColumn("__tasks", F.coalesce("__shards", F.array("__light"))).drop("__light", "__heavy", "__shards")


def row_hash(df: DataFrame) -> Column:
    """Hash of a row's columns; maps, which can't be hashed, are left out."""
    def plain(t: T.DataType) -> bool:
        if isinstance(t, T.StructType):
            return all(plain(f.dataType) for f in t)
        return plain(t.elementType) if isinstance(t, T.ArrayType) else not isinstance(t, (T.MapType, T.VariantType))

    return F.xxhash64(F.lit(1), *[F.col(f"`{f.name}`") for f in df.schema if plain(f.dataType)])


def _shard(row: Column) -> Column:
    return F.element_at("__tasks", (F.pmod(row, F.size("__tasks")) + 1).cast("int"))


def key_hash(cols: Sequence[str]) -> Column:
    """64-bit hash of the key columns; null is hashed as a value of its own."""
    return F.xxhash64(*[x for c in cols for x in (F.col(c), F.col(c).isNull())])


def plan_load(df: DataFrame, keys: Sequence[str], tasks: int | None = None) -> LoadPlan:
    """Estimate the load of the keys of ``df`` and place them on ``tasks`` tasks.

    What reaches the driver is bounded whatever the data: 16 bucket counts a task (4,096 at least), and
    at most ``4 * tasks`` heavy keys (each above a quarter of a task's fair share).  An
    empty frame gives an even plan.
    """
    return _plan(df.select(key_hash(keys).alias("h")), tasks or parallelism(df.sparkSession))


def _plan(h: DataFrame, tasks: int) -> LoadPlan:
    buckets = max(LEAST_BUCKETS, 16 * tasks)
    by_bucket = {r["b"]: r["n"] for r in h.groupBy(F.pmod("h", F.lit(buckets)).alias("b")).agg(F.count("*").alias("n")).collect()}
    total = sum(by_bucket.values())
    heavy_loads: dict[int, float] = {}
    if total:
        # A key can only be heavy if its bucket is: few hashes are left to count exactly.
        hot = [(b,) for b, n in by_bucket.items() if n * 4 * tasks >= total]
        if hot:
            share = total / tasks
            side = F.broadcast(h.sparkSession.createDataFrame(hot, "b long"))
            rows = h.withColumn("b", F.pmod("h", F.lit(buckets))).join(side, "b", "left_semi").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= share / 4).collect()
            heavy_loads = {r["h"]: float(r["n"]) for r in rows}
    for k, n in heavy_loads.items():
        by_bucket[k % buckets] -= n
    items: list[tuple[float, str, int]] = [(max(0.0, n), "b", b) for b, n in by_bucket.items()]
    fair = max(1.0, total / tasks)
    plan = LoadPlan(tasks, [b % tasks for b in range(buckets)])
    for k, n in heavy_loads.items():
        shards = min(tasks, max(1, -(-int(n * 2) // int(fair))))
        items += [(n / shards, "k", k)] * shards
    items.sort(key=lambda x: (-x[0], x[1], x[2]))
    bins = [(0.0, t) for t in range(tasks)]
    heapq.heapify(bins)
    for n, kind, k in items:
        skipped = []
        load, t = heapq.heappop(bins)
        taken = set(plan.heavy.get(k, ())) if kind == "k" else ()
        while t in taken and bins:
            skipped.append((load, t))
            load, t = heapq.heappop(bins)
        if kind == "b":
            plan.bucket_task[k] = t
        else:
            plan.heavy.setdefault(k, []).append(t)
        heapq.heappush(bins, (load + n, t))
        for s in skipped:
            heapq.heappush(bins, s)
    return plan


def _combine(keys: list[str], sums: list[str], schema: pa.Schema):
    """A mapInArrow function adding up ``sums`` per key over runs of batches."""

    def run(batches):
        held, rows = [], 0

        def flush():
            t = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([(s, "sum") for s in sums])
            t = t.select([*keys, *[f"{s}_sum" for s in sums]]).rename_columns([*keys, *sums]).cast(schema)
            return t.to_batches()

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= 262_144:
                yield from flush()
                held, rows = [], 0
        if held:
            yield from flush()

    return run


def balanced_sums(df: DataFrame, keys: Sequence[str], sums: dict[str, Column], plan: LoadPlan | None = None) -> DataFrame:
    """Row count ``n`` and sums per key, one row per key, without a slow task for hot keys.

    Nulls in a key are a key of their own; null terms of a sum count as 0 (a key with
    only null terms gives 0).  An empty frame gives no rows.  Columns of ``df`` other
    than the keys and those used in ``sums`` are ignored, whatever their names.
    """
    keys = list(keys)
    names = [f"__s{i}" for i in range(len(sums))]
    rows = df.select(*keys, F.lit(1).cast("long").alias("__n"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(a) for a, c in zip(names, sums.values())])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
    from pyspark.sql.pandas.types import to_arrow_schema

    part = rows.mapInArrow(_combine(keys, ["__n", *names], to_arrow_schema(schema)), schema).withColumn("__h", key_hash(keys))
    # Read by the estimate and by the run: staged, so the input is scanned once.
    part = stage(part, "combined")
    plan = plan or _plan(part.select(F.col("__h").alias("h")), parallelism(df.sparkSession))
    part = plan.with_tasks(part, "__h")
    part = part.withColumn("__task", _shard(F.xxhash64("__h", "__n", *names))).withColumn("__many", F.size("__tasks") > 1).drop("__tasks", "__h")
    agg = [F.sum("__n").alias("__n"), *[F.sum(a).alias(a) for a in names]]
    once = part.repartitionById(plan.tasks, F.col("__task")).groupBy("__task", "__many", *keys).agg(*agg)
    if plan.heavy:
        # Read below by two branches; without staging each would scan and combine the input again.
        once = stage(once, "balanced")
        light = once.filter(~F.col("__many")).select(*keys, "__n", *names)
        split = once.filter("__many").groupBy(*keys).agg(*agg)
        once = light.unionByName(split.select(*keys, "__n", *names))
    return once.select(*keys, F.col("__n").alias("n"), *[F.col(a).alias(k) for a, k in zip(names, sums)])


def balanced_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", plan: LoadPlan | None = None) -> DataFrame:
    """Equi join with ``left``'s hot keys split over tasks and ``right``'s rows replicated to those shards only.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``.  Null keys match
    nothing, as in SQL.  Columns of both sides with one name (other than the keys)
    come out as ``name`` and ``name_right``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    keys = list(keys)
    plan = plan or plan_load(left, keys)
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    right = right.withColumnsRenamed({c: f"{c}_right" for c in clash})
    lt = plan.with_tasks(left.withColumn("__h", key_hash(keys)), "__h")
    lt = lt.withColumn("__task", _shard(row_hash(left))).drop("__tasks", "__h")
    rt = plan.with_tasks(right.withColumn("__h", key_hash(keys)), "__h").withColumn("__task", F.explode("__tasks")).drop("__tasks", "__h")
    lt = lt.repartitionById(plan.tasks, F.col("__task"))
    rt = rt.repartitionById(plan.tasks, F.col("__task"))
    return lt.join(rt.hint("shuffle_hash") if how != "inner" else rt, ["__task", *keys], how).drop("__task")
