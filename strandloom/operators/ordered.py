"""Ranks, running totals and neighbours in a global order, without gathering a group in one task.

Rows are range-partitioned by (keys, order) and staged with their partition's number.
A window inside (partition, keys) gives the local answer; a table with one row per
(partition, keys) carries totals, or border rows, from one partition to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import bounded_broadcast, stage

Order = Sequence[str]


def _column(o: str) -> Column:
    """``name`` or ``-name`` for descending."""
    return F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc()


class Ordered:
    """``df`` in the order (keys, order); null keys form a group of their own."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Order):
        self.keys, self.order = list(keys), list(order)
        cols = [F.col(k).asc() for k in self.keys] + [_column(o) for o in self.order]
        self.df = stage(df.repartitionByRange(*cols).withColumn("_pid", F.spark_partition_id()), "ordered")
        self.window = Window.partitionBy("_pid", *self.keys).orderBy(*[_column(o) for o in self.order])

    def _join(self, local: DataFrame, side: DataFrame) -> DataFrame:
        s = bounded_broadcast(side.withColumnsRenamed({"_pid": "_pid_s"} | {k: f"{k}_s" for k in self.keys}))
        cond = F.col("_pid") == F.col("_pid_s")
        for k in self.keys:
            cond &= F.col(k).eqNullSafe(F.col(f"{k}_s"))
        return local.join(s, cond, "left").drop("_pid_s", *[f"{k}_s" for k in self.keys])

    def running(self, what: dict[str, tuple[str, Column]]) -> DataFrame:
        """Inclusive running aggregates: name to (``sum``, ``min`` or ``max``, expression)."""
        fn = {"sum": F.sum, "min": F.min, "max": F.max}
        rows = self.window.rowsBetween(Window.unboundedPreceding, 0)
        local = self.df.select("*", *[fn[f](c).over(rows).alias(f"_l_{n}") for n, (f, c) in what.items()])
        part = self.df.groupBy("_pid", *self.keys).agg(*[fn[f](c).alias(f"_t_{n}") for n, (f, c) in what.items()])
        before = Window.partitionBy(*self.keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        side = part.select("_pid", *self.keys, *[fn[f](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (f, _) in what.items()])
        j = self._join(local, side)
        for n, (f, _) in what.items():
            a, c = F.col(f"_l_{n}"), F.col(f"_c_{n}")
            both = a + F.coalesce(c, F.lit(0)) if f == "sum" else (F.least(a, c) if f == "min" else F.greatest(a, c))
            j = j.withColumn(n, both).drop(f"_l_{n}", f"_c_{n}")
        return j.drop("_pid")

    def row_number(self, name: str = "place") -> DataFrame:
        """1-based place in the order within the keys."""
        return self.running({name: ("sum", F.lit(1).cast("long"))})

    def neighbour(self, cols: Sequence[str], step: int = 1, suffix: str = "_next") -> DataFrame:
        """Columns of the next (``step=1``) or previous (``step=-1``) row of the same keys."""
        shift = F.lead if step > 0 else F.lag
        row = F.struct(*cols)
        local = self.df.withColumn("_row", shift(row).over(self.window))
        ordered = F.row_number().over(self.window if step > 0 else Window.partitionBy("_pid", *self.keys).orderBy(*[_column(o[1:] if o.startswith("-") else f"-{o}") for o in self.order]))
        border = self.df.withColumn("_i", ordered).filter(F.col("_i") == 1).select("_pid", *self.keys, row.alias("_b"))
        w = Window.partitionBy(*self.keys).orderBy("_pid")
        side = border.select("_pid", *self.keys, shift("_b").over(w).alias("_far"))
        j = self._join(local, side).withColumn("_row", F.coalesce("_row", "_far"))
        return j.select(*[c for c in self.df.columns if c != "_pid"], *[F.col(f"_row.{c}").alias(c + suffix) for c in cols])


def exact_quantile(df: DataFrame, value: str, prob: float) -> DataFrame:
    """One row (value): the ``prob`` quantile of the non-null values, interpolated between neighbouring order statistics; null without values."""
    v = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    o = Ordered(v, [], ["v"]).row_number("_at")
    n = v.agg(F.count("*").alias("_n"))
    pos = F.lit(float(prob)) * (F.col("_n") - 1)
    near = o.join(F.broadcast(n)).withColumn("_pos", pos).filter((F.col("_at") - 1 == F.floor("_pos")) | (F.col("_at") - 1 == F.ceil("_pos")))
    lo, hi = F.min_by("v", "_at"), F.max_by("v", "_at")
    return near.agg((lo + (hi - lo) * F.max(F.col("_pos") - F.floor("_pos"))).alias("value"))
