"""Filling containers of fixed capacity: first-fit decreasing with a tournament tree.

Items are put into randomised groups by a hash, each small enough for one task, and
each group is packed by itself.  Only the last, part-filled container of a group is
lost, so with thousands of items a group the waste of grouping is negligible.  An
item larger than a container is cut into full containers and a rest; no other item
is ever split.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_ITEMS = 16_384


def first_fit_decreasing(sizes: Sequence[int], capacity: int) -> tuple[np.ndarray, int]:
    """Container of every item (sizes from 0 to capacity), and how many containers were opened.

    The tree's leaves are containers with their free space, every inner node the most
    free space below it; the first container that fits is found from the root down.
    """
    n = len(sizes)
    order = np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable").tolist()
    out = np.zeros(n, dtype=np.int64)
    if not n:
        return out, 0
    width = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * width)
    used = 0
    for i in order:
        s = int(sizes[i])
        k = 1
        while k < width:
            k *= 2
            if tree[k] < s:
                k += 1
        out[i] = k - width
        used = max(used, k - width + 1)
        tree[k] -= s
        while k > 1:
            k //= 2
            a, b = tree[2 * k], tree[2 * k + 1]
            best = a if a >= b else b
            if tree[k] == best:
                break
            tree[k] = best
    return out, used


def pack(df: DataFrame, item: str, size: str, capacity: int, total: int, seed: int = 0, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(container, item, piece, n_pieces, offset, size): where every item of ``df`` lies.

    ``total`` is the number of rows of ``df``; it only sets the number of groups.
    Null sizes are not packed; items of size 0 take a place in some container.  Repeated
    items are packed as often as they occur.  An empty frame gives no rows.
    """
    groups = max(1, -(-total // group_items))
    s = F.col(size).cast("long")
    items = df.filter(s.isNotNull()).select(F.col(item).alias("item"), s.alias("full"))
    n = F.greatest(F.ceil(F.col("full") / capacity), F.lit(1)).cast("long")
    pieces = items.select("item", n.alias("n_pieces"), "full", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece"))
    pieces = pieces.withColumn("offset", F.col("piece") * capacity).withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("full") - F.col("offset")))
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "item", "piece"), F.lit(groups)))
    kind = items.schema["item"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        # A total order makes the packing the same whatever order rows arrive in.
        pdf = pdf.sort_values(["size", "item", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        pdf["container"], _ = first_fit_decreasing(pdf["size"].to_numpy(), capacity)
        return pdf[["grp", "container", "item", "piece", "n_pieces", "offset", "size"]]

    return pieces.select("grp", "item", "piece", "n_pieces", "offset", "size").groupBy("grp").applyInPandas(one, f"grp long, container long, item {kind}, piece long, n_pieces long, offset long, size long")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, units packed, share of space unused."""
    per = packed.groupBy("grp", "container").agg(F.sum("size").alias("used"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("used"), F.lit(0)).alias("units"), (1 - F.try_divide(F.sum("used"), F.count("*") * capacity)).alias("unused_share"))
