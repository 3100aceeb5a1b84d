"""Transcripts from spliced reads: junctions, filters, the exon graph and its paths, abundance, classes."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandloom.functions import blocks as B
from strandloom.operators import setops
from strandloom.operators.join import _carried, overlap_join
from strandloom.operators.ordered import Ordered
from strandloom.session import bounded_broadcast, discard, stage

MAX_PATHS = 10_000


def junctions(reads: DataFrame) -> DataFrame:
    """(chrom, start_pos, end_pos, reads, weight): introns of spliced reads, strand ignored.

    ``blocks`` is an array of start_pos / end_pos structs.
    """
    b = F.transform("blocks", lambda x: B.block(x["start_pos"], x["end_pos"]))
    i = reads.filter(F.size("blocks") > 1).select("chrom", "weight", F.inline(B.introns(b)))
    return i.groupBy("chrom", F.col("start").alias("start_pos"), F.col("end").alias("end_pos")).agg(F.count("*").alias("reads"), F.sum("weight").alias("weight"))


def low_junction_filter(j: DataFrame, least_reads: int = 3, least_share: float = 0.05) -> DataFrame:
    """Junctions with enough reads, and at least a share of the reads of the strongest junction they overlap."""
    o = overlap_join(j, j, "inner").groupBy("chrom", "start_pos", "end_pos", "reads").agg(F.max("reads_r").alias("_top"))
    return j.join(o.filter((F.col("reads") >= least_reads) & (F.col("reads") >= least_share * F.col("_top"))).select("chrom", "start_pos", "end_pos"), ["chrom", "start_pos", "end_pos"], "left_semi")


def exon_islands(reads: DataFrame) -> DataFrame:
    """Covered stretches of the reads' blocks."""
    b = reads.select("chrom", F.inline("blocks"))
    return setops.merged(b, touching=True)


def splice_graph(reads: DataFrame, least_reads: int = 3, least_share: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): exon pieces cut at junction ends, and edges by adjacency (weight null) or junction (its reads)."""
    j = stage(low_junction_filter(stage(junctions(reads), "junctions"), least_reads, least_share), "junctions")
    ex = stage(exon_islands(reads), "exons")
    cuts = j.select("chrom", F.explode(F.array("start_pos", "end_pos")).alias("start_pos")).distinct().withColumn("end_pos", F.col("start_pos") + 1)
    per = stage(overlap_join(ex, cuts, "inner").groupBy("chrom", "start_pos", "end_pos").agg(F.array_sort(F.collect_set("start_pos_r")).alias("_c")), "cut")
    whole = ex.join(bounded_broadcast(per.select("chrom", "start_pos", "end_pos"), of=per), ["chrom", "start_pos", "end_pos"], "left_anti")
    pts = F.array_distinct(F.concat(F.array("start_pos"), "_c", F.array("end_pos")))
    v = per.withColumn("_p", F.array_sort(pts)).select("chrom", F.inline(F.filter(F.zip_with(F.slice("_p", 1, F.size("_p") - 1), F.slice("_p", 2, F.size("_p")), lambda a, b: F.struct(a.alias("start_pos"), b.alias("end_pos"))), lambda x: x["start_pos"] < x["end_pos"])))
    v = v.unionByName(whole.select("chrom", "start_pos", "end_pos"))
    v = stage(v, "vertices")
    left = v.select("chrom", F.col("start_pos").alias("from_start"), F.col("end_pos").alias("at"))
    right = v.select("chrom", F.col("start_pos").alias("to_start"))
    adjacent = left.join(right.withColumn("at", F.col("to_start")), ["chrom", "at"]).select("chrom", "from_start", "to_start", F.lit(None).cast("long").alias("reads"))
    spliced = j.select("chrom", F.col("start_pos").alias("at"), F.col("end_pos").alias("to_start"), "reads").join(left, ["chrom", "at"]).join(right, ["chrom", "to_start"]).select("chrom", "from_start", "to_start", "reads")
    return v, stage(adjacent.unionByName(spliced), "edges")


def k_paths(edges: dict[int, list[tuple[int, float]]], sources: list[int], sinks: set[int], k: int) -> list[tuple[float, list[int]]]:
    """The ``k`` heaviest paths of every source-sink pair of a directed acyclic graph whose nodes are in topological order of their numbers.

    Heaviest first; equal weights by their nodes.  Each source is searched on its own, so no
    source's paths push out another's.
    """
    out = []
    for s in sources:
        # Only what ``s`` reaches is visited: a locus may have as many sources as nodes.
        best: dict[int, list[tuple[float, list[int]]]] = {s: [(0.0, [s])]}
        ahead = [s]
        while ahead:
            n = heappop(ahead)
            # All edges into ``n`` come from lesser nodes, so its paths are complete here.
            paths = sorted(best.pop(n), key=lambda x: (-x[0], x[1]))[:k]
            if n in sinks:
                out += paths
            for t, w in edges.get(n, ()):
                if t not in best:
                    heappush(ahead, t)
                    best[t] = []
                best[t] += [(c + w, [*p, t]) for c, p in paths]
    return sorted(out, key=lambda x: (-x[0], x[1]))


class _Pieces:
    """Connected pieces of a graph whose edges come by their lesser node, each given out once no later edge can reach it.

    Only the pieces that span the place at hand are held, so memory doesn't grow with the graph.
    """

    def __init__(self) -> None:
        self.of: dict[int, _Piece] = {}
        self.open: list[tuple[int, int, _Piece]] = []
        self.n = 0

    def add(self, a: int, a_end: int, b: int, b_end: int, w: float) -> None:
        p, q = self.of.get(a), self.of.get(b)
        if p is None or q is not None and len(q.end) > len(p.end):
            p, q = q, p
        if p is None:
            p = _Piece()
        was = p.last
        if q is not None and q is not p:
            for n in q.end:
                self.of[n] = p
            p.end.update(q.end)
            p.after.update(q.after)
            p.last = max(p.last, q.last)
            q.end, q.after, q.last = {}, {}, None
        self.of[a] = self.of[b] = p
        p.end[a], p.end[b] = a_end, b_end
        p.after.setdefault(a, []).append((b, w))
        p.last = b if p.last is None else max(p.last, b)
        if p.last != was:
            self.n += 1
            heappush(self.open, (p.last, self.n, p))

    def before(self, at: float) -> Iterator[_Piece]:
        """Pieces that end before ``at``, the least lesser node still to come."""
        while self.open and self.open[0][0] < at:
            last, _, p = heappop(self.open)
            if p.last == last:
                for n in p.end:
                    del self.of[n]
                p.last = None
                yield p


class _Piece:
    """Nodes with their ends, edges by their lesser node, and the greatest node (none of a piece that was given out or joined to another)."""

    __slots__ = ("end", "after", "last")

    def __init__(self) -> None:
        self.end: dict[int, int] = {}
        self.after: dict[int, list[tuple[int, float]]] = {}
        self.last: int | None = None


def _piece_paths(p: _Piece, k: int, least_blocks: int) -> Iterator[tuple[float, list[int], list[dict[str, int]]]]:
    """(weight, nodes, blocks) of a piece's paths, one source's at a time."""
    end, after = p.end, p.after
    targets = {t for x in after.values() for t, _ in x}
    sinks = {n for n in end if n not in after}
    for s in sorted(n for n in end if n not in targets):
        for w, path in k_paths(after, [s], sinks, k):
            bl: list[dict[str, int]] = []
            for n in path:
                if bl and bl[-1]["end"] == n:
                    bl[-1]["end"] = end[n]
                else:
                    bl.append({"start": n, "end": end[n]})
            if len(bl) >= least_blocks:
                yield w, path, bl


def _locus_paths(edges: DataFrame, k: int, least_blocks: int) -> DataFrame:
    """(chrom, locus, weight, nodes, blocks): the paths of every locus, from (chrom, locus, a, a_end, b, b_end, w) edges.

    The edges of a locus come in order and leave with their piece: no locus, nor its paths, is ever held whole.
    """
    schema = StructType.fromDDL(f"chrom string, locus long, weight double, nodes array<bigint>, blocks {B.BLOCKS}")
    arrow = to_arrow_schema(schema)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            locus, pieces = None, _Pieces()
            done = lambda at: ((*locus, *x) for p in pieces.before(at) for x in _piece_paths(p, k, least_blocks))
            for b in batches:
                for chrom, key, *edge in zip(*[b.column(c).to_pylist() for c in ("chrom", "locus", "a", "a_end", "b", "b_end", "w")]):
                    if locus != (chrom, key):
                        yield from done(inf)
                        locus = chrom, key
                    yield from done(edge[0])
                    pieces.add(*edge)
            yield from done(inf)

        held, nodes = [], 0
        for r in rows():
            held.append(r)
            nodes += len(r[3])
            if nodes > 50_000:
                yield emit(held)
                held, nodes = [], 0
        yield emit(held)

    return edges.repartition("chrom", "locus").sortWithinPartitions("chrom", "locus", "a", "b").mapInArrow(run, schema)


def transcripts(vertices: DataFrame, edges: DataFrame, k: int = MAX_PATHS, single: bool = True, least_blocks: int = 1) -> DataFrame:
    """(chrom, locus, path, weight, blocks): source-to-sink paths, the ``k`` heaviest of each source-sink pair of a locus.

    Loci are the stretches joined by vertices, which are disjoint, and edges; one locus is one task's work,
    chromosomes are not.  Path enumeration is exponential by nature; ``k`` bounds it per pair.
    Loci of one vertex without edges are paths of one block, left out unless ``single``.  Paths of less than
    ``least_blocks`` blocks are left out before the others are numbered, heaviest first.
    """
    ends = lambda side: vertices.select("chrom", F.col("start_pos").alias(f"{side}_start"), F.col("end_pos").alias(f"{side}_end"))
    e = edges.join(ends("to"), ["chrom", "to_start"]).join(ends("from"), ["chrom", "from_start"])
    e = stage(e.select("chrom", F.col("from_start").alias("a"), F.col("from_end").alias("a_end"), F.col("to_start").alias("b"), F.col("to_end").alias("b_end"), F.coalesce("reads", F.lit(0)).cast("double").alias("w")), "spans")
    # Spans begin and end with a vertex, so a vertex lies in one or apart from all.
    loci = stage(setops.merged(e.select("chrom", F.col("a").alias("start_pos"), F.col("b_end").alias("end_pos"))), "loci")
    placed = e if least_blocks > 1 else e.unionByName(
        vertices.select("chrom", F.col("start_pos").alias("a"), F.col("end_pos").alias("a_end")).join(e.select("chrom", F.explode(F.array("a", "b")).alias("a")), ["chrom", "a"], "left_anti"), allowMissingColumns=True
    )
    opened = loci.select(F.col("chrom").alias("_chrom"), F.col("start_pos").alias("_pos"), F.lit(0).alias("_side"), F.struct("start_pos", "end_pos").alias("_at"))
    placed = opened.unionByName(placed.withColumnRenamed("chrom", "_chrom").withColumn("_pos", F.col("a")).withColumn("_side", F.lit(1)), allowMissingColumns=True)
    # The last locus that starts up to a vertex holds it, or none does.
    near = _carried(placed, ["_pos", "_side"], {"_in": ("_at", False)}).filter("_side = 1").withColumnRenamed("_chrom", "chrom")
    found = _locus_paths(near.filter("b IS NOT NULL").select("chrom", F.col("_in.start_pos").alias("locus"), "a", "a_end", "b", "b_end", "w"), k, least_blocks)
    if least_blocks <= 1:
        inside = F.coalesce(F.col("_in.end_pos") > F.col("a"), F.lit(False))
        alone = near.filter(F.col("b").isNull() & (inside | F.lit(single)))
        locus = F.when(inside, F.col("_in.start_pos")).otherwise(F.col("a"))
        found = found.unionByName(alone.select("chrom", locus.alias("locus"), F.lit(0.0).alias("weight"), F.array("a").alias("nodes"), F.array(B.block(F.col("a"), F.col("a_end"))).alias("blocks")))
    # Numbered by a sort of all loci: a locus may have any number of paths.
    paths = stage(found, "paths")
    numbered = Ordered(paths, ["chrom", "locus"], ["-weight", "nodes"])
    discard(paths)
    return numbered.row_number().select("chrom", "locus", (F.col("place") - 1).cast("int").alias("path"), "weight", "blocks")


def fpkm(t: DataFrame, reads: DataFrame, key: str) -> DataFrame:
    """(key, count, fpkm): weighted reads overlapping each transcript, per kilobase of blocks and million reads."""
    total = reads.agg(F.sum("weight").alias("_t"))
    hit = overlap_join(t, reads, "inner").groupBy(key, F.col("length")).agg(F.sum("weight_r").alias("count"))
    return hit.join(F.broadcast(total)).select(key, "count", F.try_divide(F.try_divide(F.col("count") * 1000, "length") * 1e6, F.col("_t")).alias("fpkm"))


def intron_retention(t: DataFrame, j: DataFrame, depth: DataFrame, least_ratio: float = 0.95) -> DataFrame:
    """Transcripts with a block that holds a whole junction covered at less than ``least_ratio`` of the block's other bases.

    ``t`` is (id, chrom, start_pos, end_pos) per block, ``depth`` (chrom, start_pos, end_pos, depth) segments.
    """
    hold = overlap_join(t, j, "inner", contained="right").select("id", "chrom", "start_pos", "end_pos", F.col("start_pos_r").alias("i_start"), F.col("end_pos_r").alias("i_end"))
    cov = overlap_join(hold, depth, "left")
    part = lambda lo, hi: F.sum(F.coalesce(F.col("depth_r") * F.greatest(F.least(hi, F.col("end_pos_r")) - F.greatest(lo, F.col("start_pos_r")), F.lit(0)), F.lit(0)))
    g = cov.groupBy("id", "chrom", "start_pos", "end_pos", "i_start", "i_end").agg(part(F.col("i_start"), F.col("i_end")).alias("inside"), part(F.col("start_pos"), F.col("end_pos")).alias("all"))
    rest = (F.col("end_pos") - F.col("start_pos")) - (F.col("i_end") - F.col("i_start"))
    ratio = (F.col("inside") / (F.col("i_end") - F.col("i_start"))) / F.nullif((F.col("all") - F.col("inside")) / F.nullif(rest, F.lit(0)), F.lit(0.0))
    return g.withColumn("ratio", ratio).filter(F.coalesce("ratio", F.lit(0.0)) < least_ratio)


def classify(rec: DataFrame, ref: DataFrame, key: str, ref_key: str) -> DataFrame:
    """(key, class): ``equal``, ``contained``, ``contains``, ``overlap``, ``antisense`` or ``intergenic`` against a reference set, the first that applies."""
    hit = overlap_join(rec, ref, "left")
    same = F.col("start_pos").eqNullSafe(F.col("start_pos_r")) & F.col("end_pos").eqNullSafe(F.col("end_pos_r"))
    rank = (
        F.when(F.col(f"{ref_key}_r").isNull(), 6).when(F.col("strand") != F.col("strand_r"), 5).when(same, 1)
        .when((F.col("start_pos") >= F.col("start_pos_r")) & (F.col("end_pos") <= F.col("end_pos_r")), 2)
        .when((F.col("start_pos") <= F.col("start_pos_r")) & (F.col("end_pos") >= F.col("end_pos_r")), 3).otherwise(4)
    )
    names = F.array(*[F.lit(x) for x in ("equal", "contained", "contains", "overlap", "antisense", "intergenic")])
    return hit.groupBy(key).agg(F.element_at(names, F.min(rank)).alias("class"))


def best_isoform(t: DataFrame, locus: str, score: str, key: str) -> DataFrame:
    """The highest-scoring row of every locus; equal scores go to the least key."""
    best = t.groupBy(locus).agg(F.min_by(key, F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))).alias(key))
    return t.join(best, [locus, key], "left_semi")
