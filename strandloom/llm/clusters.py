"""Clusters of matrix rows that rise and fall together: parallel pivot correlation clustering.

1. *Matrix.* The long table becomes one vector a row (log2(1 + value), nulls where
   lost); rows with equal vectors are represented by one of them.
2. *Tables.* Rows are filed by id in tables of concatenated cross-polytope hashes of their
   centred, scaled vectors; the number of hashes grows with the logarithm of the number
   of rows, so a bucket's unlike rows stay few, and the number of tables follows from it.
   Rows with one dominant cell are also filed without it, so that a partner that lost
   that cell still meets them.
3. *Pivot rounds.* In the first ``PIVOT_TABLES`` tables every row is compared with the row
   of least hash in its bucket.  In rounds, rows whose hash is the least among their
   remaining alike neighbours become pivots and absorb these, until no row is left; then
   every row goes to the closest of the pivots it is alike to.
4. *Chains.* Rows of different pivots that share a bucket of any table are compared, from
   one-byte sketches whose error is bounded for every pair; only pairs the bound leaves
   open are decided from the stored doubles.  Rows that lost more than ``SPARSE`` of
   their cells, which the hashes see too badly, are so compared with all rows, in tiles.
   Clusters with a link between them are merged, so chains end in one cluster.
5. *Medoids.* Members are compared with their cluster's mean profile; the closest are
   its most typical rows.

Two rows at the limit of correlation, without lost cells, miss each other in all tables with
probability ``MISS``; README gives the measured recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.graph import components
from strandloom.operators.ordered import Ordered
from strandloom.session import BROADCAST_ROWS, bounded_broadcast, discard, stage

MISS = 1e-6
COMPANIONS = 0.1
PIVOT_TABLES = 16
HASH_COLUMNS = 128
DOMINANT = 0.10
BUCKET_ROWS = 2048
HOT_ROWS = 1 << 17
SPARSE = 0.05
SLACK = 1e-9
LOST = -128
SEED = 7


# --- vectors ------------------------------------------------------------------------------


def row_vectors(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """(id, row, rep, vec): a staged vector per row, and the id of the row standing for all equal vectors.

    Null rows, null columns and cells that are null, NaN, infinite or at most -1 are
    left out; a cell delivered again counts once (its greatest value).  Rows without
    any valid cell give no vector.  The number of columns is bounded by nothing but the
    room for one row's vector.
    """
    v = F.col(value).cast("double")
    cells = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull() & (v > -1) & (v < float("inf"))).select(F.col(row).alias("row"), F.col(col).cast("string").alias("col"), v.alias("v"))
    cols = stage(cells.select("col").distinct(), "columns")
    width = cols.count()
    if not width:
        return cells.sparkSession.createDataFrame([], "id long, row string, rep long, vec array<double>")
    # A list that may be broadcast may also be numbered in one task.
    index = cols.select("col", F.row_number().over(Window.orderBy("col")).cast("long").alias("i")) if width <= BROADCAST_ROWS else Ordered(cols, [], ["col"]).row_number("i")
    placed = cells.join(F.broadcast(index) if width <= BROADCAST_ROWS else index, "col").select("row", (F.col("i") - 1).cast("int").alias("i"), F.log2(1 + F.col("v")).alias("x"))
    once = placed.groupBy("row", "i").agg(F.max("x").alias("x"))
    got = once.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.try_element_at("m", i))
    rows = stage(got.select(F.monotonically_increasing_id().alias("id"), "row", dense.alias("vec")), "rows")
    out = stage(_with_reps(rows), "vectors")
    discard(rows)
    return out


def _with_reps(rows: DataFrame) -> DataFrame:
    """Copies are joined to their representative by a digest of the vector (a join on arrays would drop those with nulls)."""
    keyed = rows.withColumn("_k", F.sha2(F.to_json(F.struct("vec"), {"ignoreNullFields": "false"}), 256))
    reps = keyed.groupBy("_k").agg(F.min("id").alias("rep"))
    return keyed.join(reps, "_k").select("id", "row", "rep", "vec")


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list column as doubles, NaN for nulls."""
    flat = pc.fill_null(col.flatten(), float("nan")) if len(col) else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def alike_rows(x: np.ndarray, y: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Row by row: do ``x`` and ``y`` (NaN where lost) correlate at ``r`` or more over the columns both have, and the correlation.

    A pair with fewer than two common columns, or without change in them, is not alike.
    """
    both = ~np.isnan(x) & ~np.isnan(y)
    n = np.maximum(both.sum(1), 1)[:, None]
    px, py = np.where(both, x, 0.0), np.where(both, y, 0.0)
    dx = np.where(both, px - px.sum(1, keepdims=True) / n, 0.0)
    dy = np.where(both, py - py.sum(1, keepdims=True) / n, 0.0)
    vx, vy, c = (dx * dx).sum(1), (dy * dy).sum(1), (dx * dy).sum(1)
    varies = (vx > 1e-20 * (px * px).sum(1)) & (vy > 1e-20 * (py * py).sum(1)) & (both.sum(1) >= 2)
    corr = np.where(varies, c / np.sqrt(np.where(varies, vx * vy, 1.0)), 0.0)
    # A rounding slack keeps a correlation of exactly r.
    return varies & (c > 0) & (corr >= r - SLACK), corr


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centred, scaled rows with 0 where lost; and which rows vary."""
    m = ~np.isnan(x)
    n = np.maximum(m.sum(1), 1)
    z = np.where(m, x - (np.where(m, x, 0).sum(1) / n)[:, None], 0.0)
    norm = np.sqrt((z * z).sum(1))
    ok = norm > 1e-10 * np.sqrt(np.where(m, x * x, 0.0).sum(1))
    return z / np.where(ok & (norm > 0), norm, 1.0)[:, None], ok & (norm > 0)


# --- sketches with bounded error -----------------------------------------------------------


def sketch(x: np.ndarray) -> np.ndarray:
    """Centred rows in whole steps from -127 to 127 of their greatest cell, ``LOST`` where lost; every cell is off by at most half a step."""
    m = ~np.isnan(x)
    n = np.maximum(m.sum(1), 1)
    z = np.where(m, x - (np.where(m, x, 0).sum(1) / n)[:, None], 0.0)
    top = np.abs(z).max(1, initial=0.0)[:, None]
    return np.where(m, np.rint(z / np.where(top > 0, top, 1.0) * 127), LOST).astype(np.int8)


def _judge(n: np.ndarray, vx: np.ndarray, vy: np.ndarray, c: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """From sketch sums over common columns: which pairs are surely alike, and which may be.

    A row lies within half a step a cell of its sketch, so the angle between the two is at
    most asin(h / length of the sketch) with h = sqrt(n) / 2, and the angle of a pair lies
    within the sum of its two of the sketches' angle.
    """
    h = 0.5 * np.sqrt(n) * (1 + 1e-9)
    lx, ly = np.sqrt(np.maximum(vx, 0.0)), np.sqrt(np.maximum(vy, 0.0))
    off = sum(np.arcsin(np.minimum(1.0, h / np.maximum(np.maximum(z, h), 0.5))) for z in (lx, ly))
    angle = np.arccos(np.clip(c / np.maximum(lx * ly, 1e-300), -1.0, 1.0))
    limit = math.acos(r)
    sure = (lx > h) & (ly > h) & (angle + off <= limit - 1e-9) & (n >= 2)
    return sure, ~sure & (n >= 2) & (angle - off <= limit + 1e-6)


def judge_rows(x: np.ndarray, y: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """``_judge`` of sketches row by row."""
    kind = np.float32 if x.shape[1] <= 1000 else np.float64
    mx, my = (x != LOST).astype(kind), (y != LOST).astype(kind)
    zx, zy = x * mx, y * my
    dot = lambda a, b: np.einsum("ij,ij->i", a, b).astype(np.float64)
    n, sx, sy = dot(mx, my), dot(zx, my), dot(mx, zy)
    k = np.maximum(n, 1)
    return _judge(n, dot(zx * zx, my) - sx * sx / k, dot(mx, zy * zy) - sy * sy / k, dot(zx, zy) - sx * sy / k, r)


def judge_all(x: np.ndarray, y: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """``_judge`` of every sketch of ``x`` with every one of ``y``.

    The sums are whole numbers, exact in single precision up to 1,000 columns.  With both
    lengths above 5 sqrt(n) each angle to a sketch is below 0.101, so pairs far beyond
    the limit are left out by their cosine before the angles of the others are worked out.
    """
    kind = np.float32 if x.shape[1] <= 1000 else np.float64
    mx, my = (x != LOST).astype(kind), (y != LOST).astype(kind)
    zx, zy = x * mx, y * my
    n, sx, sy, c = mx @ my.T, zx @ my.T, mx @ zy.T, zx @ zy.T
    vx, vy = (zx * zx) @ my.T, mx @ (zy * zy).T
    k = np.maximum(n, 1)
    lx, ly, cov = vx - sx * sx / k, vy - sy * sy / k, c - sx * sy / k
    low = math.cos(min(math.pi, math.acos(r) + 0.21)) - 1e-3
    near = cov >= low * np.sqrt(np.maximum(lx * ly, 0))
    near |= (lx < 26 * n) | (ly < 26 * n)
    near &= n >= 2
    sure, maybe = np.zeros(n.shape, bool), np.zeros(n.shape, bool)
    i, j = np.nonzero(near)
    n, sx, sy, c, vx, vy = (m[i, j].astype(np.float64) for m in (n, sx, sy, c, vx, vy))
    sure[i, j], maybe[i, j] = _judge(n, vx - sx * sx / n, vy - sy * sy / n, c - sx * sy / n, r)
    return sure, maybe


# --- tables -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Plan:
    """How rows are filed: columns hashed, hashes per table, tables, and tables for rows without a dominant cell."""

    width: int
    hashes: int
    tables: int
    without: int

    @property
    def dims(self) -> int:
        return min(self.width, HASH_COLUMNS)


def meet(dims: int, r: float) -> float:
    """Probability that one cross-polytope hash of two unit vectors with scalar product ``r`` agrees (seeded simulation)."""
    rng = np.random.default_rng(1)
    a = rng.standard_normal((20_000, dims))
    b = r * a + math.sqrt(1 - r * r) * rng.standard_normal((20_000, dims))
    i, j = np.abs(a).argmax(1), np.abs(b).argmax(1)
    at = np.arange(len(a))
    return max(1e-3, float(((i == j) & ((a[at, i] < 0) == (b[at, j] < 0))).mean()))


def filing_plan(n: int, width: int, r: float, miss: float = MISS) -> Plan:
    """Hashes so that a bucket holds about ``COMPANIONS`` unlike rows beside a row, and tables so that alike ones miss each other with probability ``miss``."""
    dims = min(width, HASH_COLUMNS)
    hashes = max(1, math.ceil(math.log(max(n, 2) / COMPANIONS) / math.log(max(2 * dims, 2))))
    tables = max(1, math.ceil(math.log(miss) / math.log1p(-min(0.999, meet(dims, r) ** hashes))))
    return Plan(width, hashes, tables, -(-tables // 2))


def _cross_polytope(u: np.ndarray, g: np.ndarray) -> np.ndarray:
    y = u @ g
    a = np.abs(y).argmax(1)
    return a * 2 + (y[np.arange(len(y)), a] < 0)


def _filer(plan: Plan, tables: int, seed: int):
    """mapInArrow: (id, label, vec) to (bucket, id, label) for the first ``tables`` tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        d = plan.dims
        # Wide rows are first brought to ``dims`` columns by random signs, which keeps angles up to about 1 / sqrt(dims).
        signs = rng.choice(np.array([-1, 1], dtype=np.int8), (plan.width, d)) if plan.width > d else None
        turns = rng.standard_normal((plan.tables, plan.hashes, d, d)).astype(np.float32)

        def short(u: np.ndarray) -> np.ndarray:
            return (u @ signs if signs is not None else u).astype(np.float32)

        def bucket(u: np.ndarray, t: int) -> np.ndarray:
            h = np.full(len(u), t, dtype=np.int64)
            for g in turns[t]:
                h = h * (2 * d) + _cross_polytope(u, g)
            return h

        step = max(64, min(4000, 2**22 // plan.width))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                x = _matrix(b.column(2), plan.width)
                u, ok = _units(x)
                full = (short(u[ok]), np.flatnonzero(ok))
                less = []
                order = np.argsort(-(u * u), axis=1)[:, :2]
                at = np.arange(len(x))
                for k in range(min(2, plan.width)):
                    y = x.copy()
                    y[at, order[:, k]] = np.nan
                    lu, lok = _units(y)
                    keep = ok & lok & (u[at, order[:, k]] ** 2 >= DOMINANT)
                    less.append((short(lu[keep]), np.flatnonzero(keep)))
                buckets, rows = [], []
                for t in range(tables):
                    seen = []
                    for fu, keep in [full, *(less if t < plan.without else ())]:
                        h = bucket(fu, t)
                        # A row is filed once in a bucket, whichever form leads there.
                        new = np.ones(len(keep), dtype=bool)
                        for other in seen:
                            new &= other[keep] != h
                        if len(less):
                            mark = np.full(len(x), -1, dtype=np.int64)
                            mark[keep] = h
                            seen.append(mark)
                        buckets.append(h[new])
                        rows.append(keep[new])
                row = np.concatenate(rows)
                if len(row):
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets)), b.column(0).take(take), b.column(1).take(take)], names=["bucket", "id", "label"])

    return run


FILED = "bucket long, id long, label long"


def filed_rows(vectors: DataFrame, plan: Plan, tables: int, seed: int = SEED) -> DataFrame:
    """(bucket, id, label) of ``vectors`` (id, label, vec)."""
    return vectors.select("id", "label", "vec").mapInArrow(_filer(plan, tables, seed), FILED)


# --- exact comparison of given pairs -------------------------------------------------------


def verified(pairs: DataFrame, vectors: DataFrame, width: int, r: float) -> DataFrame:
    """``pairs`` (a, b, ...) that are alike by the stored doubles, with their correlation ``r``."""
    one = vectors.select(F.col("id").alias("b"), F.col("vec").alias("_vb"))
    used = vectors.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    two = bounded_broadcast(used.select(F.col("id").alias("a"), F.col("vec").alias("_va")))
    rest = pairs.columns
    both = pairs.join(one, "b").join(two, "a").select(*rest, "_va", "_vb")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_columns - 2
            ok, corr = alike_rows(_matrix(b.column(n), width), _matrix(b.column(n + 1), width), r)
            m = pa.array(ok)
            yield pa.RecordBatch.from_arrays([*[c.filter(m) for c in b.columns[:n]], pa.array(corr[ok])], names=[*rest, "r"])

    return both.mapInArrow(run, f"{kept}, r double")


# --- pivots -------------------------------------------------------------------------------


def _rank(c: str):
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))


def bucket_stars(vectors: DataFrame, plan: Plan, r: float, seed: int = SEED) -> DataFrame:
    """(a, b, r): every row and the row of least hash in a bucket of the first ``PIVOT_TABLES`` tables, where they are alike."""
    filed = stage(filed_rows(vectors, plan, min(PIVOT_TABLES, plan.tables), seed).select("bucket", "id"), "filed")
    first = filed.groupBy("bucket").agg(F.min(_rank("id")).alias("_least"), F.count("*").alias("_n")).filter(F.col("_n") > 1)
    met = filed.join(bounded_broadcast(first.select("bucket", F.col("_least.id").alias("a"))), "bucket").filter(F.col("id") != F.col("a"))
    pairs = stage(met.select("a", F.col("id").alias("b")).distinct(), "stars")
    out = stage(verified(pairs, vectors, plan.width, r), "star")
    discard(filed)
    discard(pairs)
    return out


def pivot_rounds(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, pivot) for every id in ``links`` (a, b, r) between alike rows: the closest of the pivots it is linked to.

    In every round the rows whose hash is the least among their remaining neighbours
    become pivots and absorb these neighbours.  No two pivots are linked; a pivot's pivot is itself.
    Rounds are expected to grow with the logarithm of the number of rows, and every round
    settles at least the row of least hash; at ``max_rounds`` the call raises.
    """
    edge = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"), F.col("r").alias("r"))
    both = stage(links.filter(F.col("a") != F.col("b")).select(F.inline(F.array(edge("a", "b"), edge("b", "a")))).groupBy("u", "v").agg(F.max("r").alias("r")), "edges")
    active, settled = both.select("u", "v"), []
    for _ in range(max_rounds):
        least = active.groupBy("u").agg(F.min(_rank("v")).alias("_least"))
        new = least.filter(_rank("u") < F.col("_least")).select(F.col("u").alias("pivot"))
        taken = active.join(new, F.col("u") == F.col("pivot")).select(F.col("v").alias("id"), F.lit(False).alias("chosen")).distinct()
        done = stage(new.select(F.col("pivot").alias("id"), F.lit(True).alias("chosen")).unionByName(taken), "settled")
        settled.append(done)
        out = bounded_broadcast(done)
        last, active = active, stage(active.join(out.select(F.col("id").alias("u")), "u", "left_anti").join(out.select(F.col("id").alias("v")), "v", "left_anti").select("u", "v"), "active")
        discard(last)
        if active.isEmpty():
            break
    else:
        raise RuntimeError(f"pivots did not settle in {max_rounds} rounds; call again with more")
    ids, ended = both.select(F.col("u").alias("id")).distinct(), reduce(DataFrame.unionByName, settled)
    # A row whose neighbours were all absorbed elsewhere is a pivot too, until here without members.
    alone = ids.join(ended.select("id"), "id", "left_anti")
    pivots = ended.filter("chosen").select(F.col("id").alias("pivot")).unionByName(alone.select(F.col("id").alias("pivot")))
    near = both.join(pivots, F.col("v") == F.col("pivot")).groupBy("u").agg(F.max_by("v", F.struct(F.col("r"), -F.xxhash64("v").cast("decimal(20,0)"))).alias("pivot"))
    # Pivots are the rows without a pivot among their neighbours.
    return ids.join(near.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("pivot", "id").alias("pivot"))


# --- chains between the clusters of different pivots ----------------------------------------


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], work, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """``work`` on tables of whole runs of equal ``keys``, cut from a stream sorted by them; one run or ``rows`` rows are held at a time."""
    held: list[pa.RecordBatch] = []
    n = 0

    def joined() -> pa.Table:
        return pa.Table.from_batches(held).combine_chunks()

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = joined()
        at = np.stack([t.column(k).to_numpy() for k in keys], 1)
        change = np.flatnonzero((at[1:] != at[:-1]).any(1))
        if len(change):
            cut = int(change[-1]) + 1
            yield from work(t.slice(0, cut))
            held = t.slice(cut).to_batches()
            n = len(t) - cut
            rows = max(50_000, 2 * n)
        else:
            held, rows = t.to_batches(), 2 * n
    if held:
        yield from work(joined())


MIXED = "bucket long, id long, inner boolean, n long, k_main long"


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, id, label) sorted by bucket and label to the rows of buckets with several labels, and whether they have the most frequent one."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, label = t.column("bucket").to_numpy(), t.column("label").to_numpy()
        new_b = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        new_l = new_b | np.concatenate([[True], label[1:] != label[:-1]])
        b_start, l_start = np.flatnonzero(new_b), np.flatnonzero(new_l)
        size = np.diff(np.append(b_start, len(bucket)))
        count = np.diff(np.append(l_start, len(bucket)))
        of_run = np.cumsum(new_b)[l_start] - 1
        first_run = np.searchsorted(l_start, b_start)
        most = np.maximum.reduceat(count, first_run)
        top = np.flatnonzero(count == most[of_run])
        _, where = np.unique(of_run[top], return_index=True)
        main = top[where]
        row_b, row_l = np.cumsum(new_b) - 1, np.cumsum(new_l) - 1
        several = np.diff(np.append(first_run, len(l_start))) > 1
        keep = several[row_b]
        if keep.any():
            k = row_b[keep]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[keep]), pa.array(t.column("id").to_numpy()[keep]), pa.array((row_l == main[row_b])[keep]), pa.array(size[k].astype(np.int64)), pa.array(most[k].astype(np.int64))], names=["bucket", "id", "inner", "n", "k_main"])

    return _runs(batches, ["bucket"], work)


def mixed_rows(vectors: DataFrame, plan: Plan, n: int, hot_rows: int, seed: int) -> DataFrame:
    """Rows of the buckets that hold several labels (``MIXED``); buckets above ``hot_rows`` are counted by aggregation, the others in one pass over their sorted rows."""
    filed = filed_rows(vectors, plan, plan.tables, seed)

    def cold(df: DataFrame) -> DataFrame:
        return df.repartition("bucket").sortWithinPartitions("bucket", "label", "id").mapInArrow(_mixed, MIXED)

    if n <= hot_rows:
        return cold(filed)
    # A bucket can only be hot if its slot is; slots are few enough for counting them to be combined before the shuffle.
    slots = max(4096, 4 * n * plan.tables // hot_rows)
    slot = F.pmod(F.xxhash64("bucket"), F.lit(slots)).alias("slot")
    hot = bounded_broadcast(filed.select(slot).groupBy("slot").agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).select("slot"))
    placed = filed.select("*", slot)
    rows = stage(placed.join(hot, "slot").select("bucket", "id", "label"), "hot")
    per = rows.groupBy("bucket", "label").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.sum("k").alias("n"), F.count("*").alias("_labels"), F.max(F.struct("k", "label")).alias("_main"))
    per = bounded_broadcast(per.filter(F.col("_labels") > 1).select("bucket", "n", F.col("_main.k").alias("k_main"), F.col("_main.label").alias("_most")))
    warm = rows.join(per, "bucket").select("bucket", "id", (F.col("label") == F.col("_most")).alias("inner"), "n", "k_main")
    return cold(placed.join(hot, "slot", "left_anti").select("bucket", "id", "label")).unionByName(warm)


def tiled(mixed: DataFrame, bucket_rows: int, seed: int) -> DataFrame:
    """(bucket, tile, id): small buckets are one tile; larger ones are cut so that all pairs but those within the most frequent label meet."""
    half = max(1, bucket_rows // 2)
    zero = F.lit(0).cast("long")
    n_main, n_rest = F.ceil(F.col("k_main") / half).cast("long"), F.ceil((F.col("n") - F.col("k_main")) / half).cast("long")
    own = mixed.withColumn("_c", F.pmod(F.xxhash64("id", F.lit(seed)), F.when(F.col("inner"), n_main).otherwise(n_rest)))
    # Tiles: (rest i, rest j) for i <= j, and (main i, rest j); numbered after all of these.
    rest = F.transform(F.sequence(zero, n_rest - 1), lambda j: F.least(j, F.col("_c")) * n_rest + F.greatest(j, F.col("_c")))
    main_of_rest = F.transform(F.sequence(zero, n_main - 1), lambda i: n_rest * n_rest + i * n_rest + F.col("_c"))
    main = F.transform(F.sequence(zero, n_rest - 1), lambda j: n_rest * n_rest + F.col("_c") * n_rest + j)
    tiles = F.when(F.col("n") <= bucket_rows, F.array(zero)).when(F.col("inner"), main).otherwise(F.concat(rest, main_of_rest))
    return own.select("bucket", F.explode(tiles).alias("tile"), "id")


def _label_forest(label: np.ndarray, ok: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links (i, j) of a boolean matrix that join all labels it joins, one for each step, and every row's component of labels."""
    _, lab = np.unique(label, return_inverse=True)
    seen = np.zeros(lab.max() + 1, dtype=bool)
    part = np.arange(len(seen))
    out = []
    for s in np.unique(lab[ok.any(1)]):
        if seen[s]:
            continue
        seen[s] = True
        front = np.flatnonzero(lab == s)
        while len(front):
            sub = ok[front]
            js = np.flatnonzero(sub.any(0) & ~seen[lab])
            if not len(js):
                break
            new, first = np.unique(lab[js], return_index=True)
            js = js[first]
            out += zip(front[sub[:, js].argmax(0)].tolist(), js.tolist())
            seen[new], part[new] = True, s
            front = np.flatnonzero(np.isin(lab, new))
    return out, part[lab]


LINKS = "a long, b long, la long, lb long, sure boolean"


def _links(ids: np.ndarray, label: np.ndarray, i: np.ndarray, j: np.ndarray, sure: np.ndarray) -> pa.RecordBatch:
    swap = ids[i] > ids[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[i], ids[j], label[i], label[j], sure)], names=["a", "b", "la", "lb", "sure"])


def _matrix_links(ids: np.ndarray, label: np.ndarray, sure: np.ndarray, maybe: np.ndarray) -> pa.RecordBatch:
    """Forest of the sure links, and the open pairs between labels it leaves apart."""
    pairs, part = _label_forest(label, sure)
    p = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    i, j = np.nonzero(maybe & (part[:, None] < part[None, :]) | (maybe.T & (part[:, None] < part[None, :])))
    return _links(ids, label, np.concatenate([p[:, 0], i]), np.concatenate([p[:, 1], j]), np.concatenate([np.ones(len(p), bool), np.zeros(len(i), bool)]))


def _sketches(col: pa.Array) -> np.ndarray:
    n = len(col)
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.int8).reshape(n, -1)


def _tile_links(r: float, few: int = 24):
    """mapInArrow over (bucket, tile, id, label, q) sorted by (bucket, tile): links between rows of different labels (``LINKS``)."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key = np.stack([t.column("bucket").to_numpy(), t.column("tile").to_numpy()], 1)
        start = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1])
        size = np.diff(np.append(start, len(key)))
        ids, label = t.column("id").to_numpy(), t.column("label").to_numpy()
        q = _sketches(t.column("q"))
        left, right = [], []
        for s in range(2, few + 1):
            at = start[size == s]
            i, j = np.triu_indices(s, 1)
            left.append((at[:, None] + i).ravel())
            right.append((at[:, None] + j).ravel())
        i, j = np.concatenate(left), np.concatenate(right)
        other = label[i] != label[j]
        i, j = i[other], j[other]
        for k in range(0, len(i), 20_000):
            a, b = i[k : k + 20_000], j[k : k + 20_000]
            sure, maybe = judge_rows(q[a], q[b], r)
            hit = sure | maybe
            if hit.any():
                yield _links(ids, label, a[hit], b[hit], sure[hit])
        for s, n in zip(start[size > few], size[size > few]):
            own, lab, x = ids[s : s + n], label[s : s + n], q[s : s + n]
            sure, maybe = np.zeros((n, n), bool), np.zeros((n, n), bool)
            for k in range(0, n, 256):
                sure[k : k + 256], maybe[k : k + 256] = judge_all(x[k : k + 256], x, r)
            apart = lab[:, None] != lab[None, :]
            yield _matrix_links(own, lab, sure & apart, maybe & apart)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _runs(batches, ["bucket", "tile"], work)

    return run


def sparse_links(vectors: DataFrame, sketches: DataFrame, width: int, n: int, r: float, tile_rows: int) -> DataFrame:
    """``LINKS`` of the rows with more than ``SPARSE`` of their cells lost with all rows, tile by tile."""
    sparse = stage(vectors.filter(F.size(F.array_compact("vec")) < (1 - SPARSE) * width).select("id"), "sparse")
    n_sparse = sparse.count()
    if not n_sparse:
        return vectors.sparkSession.createDataFrame([], LINKS)
    most = max(64, min(tile_rows, 2**22 // width))
    down, across = -(-n_sparse // most), -(-n // most)
    chunk = lambda k: F.pmod(F.xxhash64("id"), F.lit(k))
    tiles = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    left = sketches.join(bounded_broadcast(sparse), "id", "left_semi").select(chunk(down).alias("i"), tiles(across).alias("j"), "id", "label", "q").toDF("i", "j", "id", "label", "q")
    right = sketches.select(tiles(down).alias("i"), chunk(across).alias("j"), "id", "label", "q").toDF("i", "j", "id", "label", "q")

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        m, k = len(x), len(y)
        ids = np.concatenate([x.column("id").to_numpy(), y.column("id").to_numpy()])
        label = np.concatenate([x.column("label").to_numpy(), y.column("label").to_numpy()])
        sure, maybe = np.zeros((m + k, m + k), bool), np.zeros((m + k, m + k), bool)
        if m and k:
            qx, qy = _sketches(x.column("q")), _sketches(y.column("q"))
            for s in range(0, m, 256):
                e = min(s + 256, m)
                sure[s:e, m:], maybe[s:e, m:] = judge_all(qx[s:e], qy, r)
            apart = label[:m, None] != label[None, m:]
            sure[:m, m:] &= apart
            maybe[:m, m:] &= apart
            sure[m:, :m] = sure[:m, m:].T
        return pa.Table.from_batches([_matrix_links(ids, label, sure, maybe)])

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, LINKS)


def chain_links(vectors: DataFrame, plan: Plan, n: int, r: float, bucket_rows: int, hot_rows: int, seed: int = SEED) -> DataFrame:
    """(a, b, la, lb): alike rows with different labels, enough of them to join all labels that alike rows of a bucket, or sparse rows, join."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2), plan.width)
            q = sketch(x)
            q[~_units(x)[1]] = LOST
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([row.tobytes() for row in q], pa.binary())], names=["id", "label", "q"])

    sketches = stage(vectors.select("id", "label", "vec").mapInArrow(draw, "id long, label long, q binary"), "sketches")
    tiles = tiled(mixed_rows(vectors, plan, n, hot_rows, seed), bucket_rows, seed).join(bounded_broadcast(sketches), "id")
    met = tiles.select("bucket", "tile", "id", "label", "q").repartition("bucket", "tile").sortWithinPartitions("bucket", "tile").mapInArrow(_tile_links(r), LINKS)
    found = stage(met.unionByName(sparse_links(vectors, sketches, plan.width, n, r, bucket_rows)).distinct(), "found")
    sure = found.filter("sure").select("a", "b", "la", "lb")
    still = found.filter(~F.col("sure")).select("a", "b", "la", "lb")
    return sure if still.isEmpty() else stage(sure.unionByName(verified(still, vectors, plan.width, r).drop("r")), "chains")



# --- clusters -----------------------------------------------------------------------------


@dataclass
class Grouping:
    """What the clustering found: each row's pivot, the links from rows to bucket pivots, and the links between clusters."""

    pivots: DataFrame | None
    stars: DataFrame
    chains: DataFrame


def group(vectors: DataFrame, r: float = 0.9, miss: float = MISS, bucket_rows: int = BUCKET_ROWS, hot_rows: int = HOT_ROWS) -> Grouping:
    """Pivot clusters of ``vectors`` (id, vec) and the links that join them."""
    head = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("w")).first()
    spark = vectors.sparkSession
    if not head["n"] or not head["w"]:
        return Grouping(None, spark.createDataFrame([], "a long, b long, r double"), spark.createDataFrame([], "a long, b long, la long, lb long"))
    plan = filing_plan(head["n"], head["w"], r, miss)
    stars = bucket_stars(vectors.withColumn("label", F.col("id")), plan, r)
    pivots = stage(pivot_rounds(stars), "pivot")
    labelled = vectors.join(bounded_broadcast(pivots), "id", "left").select("id", F.coalesce("pivot", "id").alias("label"), "vec")
    return Grouping(pivots, stars, chain_links(labelled, plan, head["n"], r, bucket_rows, hot_rows))


def similar_links(vectors: DataFrame, r: float = 0.9, **kw) -> DataFrame:
    """(a, b): alike rows of ``vectors`` (id, vec) that join the rows a chain of alike rows joins."""
    g = group(vectors, r, **kw)
    return g.stars.select("a", "b").unionByName(g.chains.select("a", "b")).distinct()


def cluster_rows(df: DataFrame, row: str, col: str, value: str, r: float = 0.9, miss: float = MISS, bucket_rows: int = BUCKET_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, row, cluster, vec): every row with a vector, and its cluster's least pivot (its own id if it is like no other).

    Rows whose values are all equal are like no other, copies of such rows too.
    """
    v = row_vectors(df, row, col, value)
    g = group(v.filter(F.col("id") == F.col("rep")).select("id", "vec"), r, miss, bucket_rows, hot_rows)
    placed = v
    if g.pivots is None:
        placed = v.withColumn("pivot", F.col("rep"))
    else:
        placed = v.join(bounded_broadcast(g.pivots.withColumnRenamed("id", "rep"), of=g.pivots), "rep", "left").withColumn("pivot", F.coalesce("pivot", "rep"))
        joined = stage(components(g.chains.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("id").alias("pivot"), F.col("pivot").alias("_joined")), "joined")
        placed = placed.join(bounded_broadcast(joined), "pivot", "left").withColumn("pivot", F.coalesce("_joined", "pivot"))
    varies = F.array_max("vec") > F.array_min("vec")
    return placed.select("id", "row", F.when(varies, F.col("pivot")).otherwise(F.col("id")).alias("cluster"), "vec")


def cluster_pairs(members: DataFrame, chunk: int = 4096) -> DataFrame:
    """(row_a, row_b), row_a < row_b: all pairs of rows in one cluster; a large cluster's pairs are made in as many tasks as it has chunks."""
    m = members.select("cluster", "row")
    many = m.groupBy("cluster").agg(F.ceil(F.count("*") / chunk).cast("long").alias("_parts"), F.count("*").alias("n")).filter(F.col("n") > 1).drop("n")
    m = stage(m.join(many, "cluster"), "members")
    a = m.select("cluster", F.pmod(F.xxhash64("row"), F.col("_parts")).alias("_part"), F.col("row").alias("row_a"))
    b = m.select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"), F.col("row").alias("row_b"))
    return a.join(b, ["cluster", "_part"]).filter(F.col("row_a") < F.col("row_b")).select("row_a", "row_b")


def describe_clusters(members: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster, size, medoid, typical): clusters of two rows or more with their most typical rows, best first.

    The mean profile of a cluster is taken over its centred, scaled rows; ties in
    similarity (to 9 digits) go to the lesser row name.
    """
    n_valid = F.size(F.array_compact("vec"))
    mean = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / n_valid
    ss = lambda m: F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.coalesce((x - m) * (x - m), F.lit(0.0)))
    sized = members.groupBy("cluster").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    m = members.join(sized, "cluster").withColumn("_m", mean).withColumn("_s", F.sqrt(ss(F.col("_m"))))
    unit = stage(m.filter(F.col("_s") > 0).select("cluster", "size", "row", F.transform("vec", lambda x: (x - F.col("_m")) / F.col("_s")).alias("u")), "units")
    cells = unit.select("cluster", F.posexplode("u").alias("i", "x")).filter(F.col("x").isNotNull())
    centre = cells.groupBy("cluster", "i").agg(F.avg("x").alias("c")).groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("centre"))
    dot = F.aggregate(F.transform("u", lambda x, i: F.coalesce(x * F.try_element_at("centre", i), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    scored = unit.join(centre, "cluster").select("cluster", "size", "row", F.round(dot, 9).alias("fit")).withColumn("_part", F.pmod(F.xxhash64("row"), F.lit(64)))
    best = F.col("fit").desc(), F.col("row").asc()
    # Two steps, so that the rows of a very large cluster are never ranked in one task.
    few = scored.withColumn("_k", F.row_number().over(Window.partitionBy("cluster", "_part").orderBy(*best))).filter(F.col("_k") <= typical)
    top = few.withColumn("_k", F.row_number().over(Window.partitionBy("cluster").orderBy(*best))).filter(F.col("_k") <= typical)
    out = top.groupBy("cluster").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("_k", "row"))).alias("t"))
    return out.select("cluster", "size", F.get("t", F.lit(0))["row"].alias("medoid"), F.transform("t", lambda x: x["row"]).alias("typical"))
