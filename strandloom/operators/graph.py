"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import discard, stage

SALTS = 8


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, pivot) for every id in ``links`` (a, b): the least id its chain of links reaches.

    Every round, each node hands its greater neighbours to the least pivot it knows and
    then itself (large star, small star), so chains shrink geometrically.  Links are held
    in the shared folder between rounds; nothing but three numbers reaches the driver.
    Self links and repeated links are harmless; without links there are no rows.  Rounds grow with
    the logarithm of the longest chain; should ``max_rounds`` not do, the call raises and may be repeated
    with more.
    """
    e = stage(links.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = e.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _hand(both.filter(F.col("v") > F.col("u")), least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # Small star: every node's lesser neighbours, and itself, go to the least of them.
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = _hand(large, down, "b").select(F.inline(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))))
        last, e = e, stage(small.filter(F.col("a") != F.col("b")).distinct(), "links")
        discard(last)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.count_distinct("b").alias("nb")).first()
        if before == tuple(now):
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds; call again with more")
    return e.select(F.col("b").alias("id"), F.col("a").alias("pivot")).unionByName(e.select(F.col("a").alias("id"), F.col("a").alias("pivot")).distinct())


def _hand(edges: DataFrame, least: DataFrame, key: str) -> DataFrame:
    """``edges`` with the ``m`` of their ``key``; a key with very many edges is spread over salted copies of its one row."""
    salted = edges.withColumn("_salt", F.pmod(F.xxhash64("*"), F.lit(SALTS)))
    return salted.join(least.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [key, "_salt"]).drop("_salt")
