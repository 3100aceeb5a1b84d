"""Mixing sources to target weights by hierarchical budgeting.

Budgets are set on the tree domain / language / source, whose leaves are the parts of each
source in one language of one domain: a source's target is parted among its leaves by
their sizes, a leaf can take at most ``max_passes`` times its size, and what it cannot take
goes to its siblings with room first, then to the siblings of its parent, and so on up.

Selection takes every whole pass a leaf's budget allows, and of the last pass the
prefix, in a seeded order of its own for each pass, that fits the rest.  The prefix is
found by summing sizes per (leaf, hash bucket), cutting at the bucket that crosses the
budget, and ordering rows only within that bucket; no leaf is ever sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import bounded_broadcast

BUCKETS = 1024


@dataclass
class Leaf:
    """A part of a source; ``wanted``, ``short`` and ``budget`` are set by ``budgets``."""

    path: tuple[str, ...]
    share: float
    size: int
    max_passes: int
    wanted: float = 0.0
    short: float = 0.0
    budget: float = 0.0

    @property
    def cap(self) -> float:
        return float(self.max_passes) * self.size


def _fill(leaves: list[Leaf], amount: float) -> float:
    """Give ``amount`` to leaves with room in proportion to their shares; return what found no room."""
    room = [x for x in leaves if x.cap > x.budget and x.share > 0]
    while amount > 0 and room:
        total = sum(x.share for x in room)
        fill = [(x.cap - x.budget) / (amount * x.share / total) for x in room]
        step = min(1.0, min(fill))
        for x, f in zip(room, fill):
            x.budget = x.cap if f <= step else min(x.cap, x.budget + step * amount * x.share / total)
        room = [x for x, f in zip(room, fill) if f > step]
        amount = amount * (1 - step) if step < 1 else 0.0
    return amount


def budgets(leaves: list[Leaf], total: float) -> float:
    """Set every leaf's budget; returns the part of ``total`` that no leaf can take.

    ``wanted`` is the weight propagated to a leaf, its share of ``total``; ``short`` is what it cannot
    take of it (below 0: the room it has left for others).
    """
    owed: dict[tuple[str, ...], float] = {}
    for x in leaves:
        x.wanted = total * x.share
        x.short = x.wanted - x.cap
        x.budget = min(x.wanted, x.cap)
        owed[x.path[:-1]] = owed.get(x.path[:-1], 0.0) + max(0.0, x.short)
    depth = max((len(x.path) for x in leaves), default=0)
    for level in range(depth - 1, -1, -1):
        up: dict[tuple[str, ...], float] = {}
        for node in sorted({x.path[:level] for x in leaves}):
            short = owed.get(node, 0.0)
            rest = _fill([x for x in leaves if x.path[:level] == node], short) if short else 0.0
            if level:
                up[node[:-1]] = up.get(node[:-1], 0.0) + rest
            else:
                return rest
        owed = {k: up.get(k, 0.0) + owed.get(k, 0.0) for k in {*up, *(k for k in owed if len(k) < level)}}
    return 0.0


def source_shortage(leaves: list[Leaf]) -> dict[str, float]:
    """What each source (last step of a path) is short of its target, added up over its leaves, from the ``budgets`` set."""
    out: dict[str, float] = {}
    for x in leaves:
        out[x.path[-1]] = out.get(x.path[-1], 0.0) + x.short
    return out


def select(items: DataFrame, leaf_budgets: DataFrame, item: str, seed: int = 0) -> DataFrame:
    """(leaf, item, pass, size): the records of the mixture.

    ``items`` has ``leaf``, ``item`` and ``size``; ``leaf_budgets`` has ``leaf``,
    ``leaf_size`` and ``budget`` and is as small as the list of targets.  Items of a leaf
    without a budget, with a null leaf or a null size are left out.  The first item that
    would pass the budget ends the prefix, so a leaf stays below its budget by less than
    one item.
    """
    whole = F.floor(F.col("budget") / F.col("leaf_size")).cast("long")
    b = leaf_budgets.filter(F.col("leaf_size") > 0).withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("leaf_size"))
    rows = items.filter(F.col("size").isNotNull()).select("leaf", F.col(item).alias("item"), F.col("size").cast("long").alias("size")).join(F.broadcast(b), "leaf")
    full = rows.filter(F.col("whole") > 0).withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole"))))
    h = F.xxhash64(F.lit(seed), F.col("whole"), "item")
    part = rows.filter(F.col("rest") > 0).withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 64 - 10))
    sums = part.groupBy("leaf", "bucket").agg(F.sum("size").alias("in_bucket"))
    w = Window.partitionBy("leaf").orderBy("bucket")  # at most BUCKETS rows a leaf
    before = sums.select("leaf", "bucket", "in_bucket", (F.sum("in_bucket").over(w) - F.col("in_bucket")).alias("before"))
    part = part.join(bounded_broadcast(before), ["leaf", "bucket"])
    inside = part.filter(F.col("before") + F.col("in_bucket") <= F.col("rest"))
    cut = part.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("in_bucket") > F.col("rest")))
    inner = Window.partitionBy("leaf", "bucket").orderBy("h", "item").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("upto", F.col("before") + F.sum("size").over(inner)).filter(F.col("upto") <= F.col("rest"))
    last = inside.select("leaf", "item", "size", "whole").unionByName(cut.select("leaf", "item", "size", "whole"))
    return full.select("leaf", "item", "pass", "size").unionByName(last.select("leaf", "item", (F.col("whole") + 1).alias("pass"), "size"))
