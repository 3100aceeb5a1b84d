"""Conservation over multiple alignments: rates and base biases per column, region and window, hidden states, motifs.

An alignment column matters to a tree only by its pattern, the bases of the species in a
fixed order.  Every numeric kernel therefore runs once per distinct pattern, in Arrow
batches, and its result is joined back; regions and windows are first reduced to counts of
patterns with map-side combine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import hmm as H
from strandloom.functions import phylo as PH
from strandloom.operators import motif as MO
from strandloom.operators import msa as MS
from strandloom.operators.join import overlap_join
from strandloom.session import bounded_broadcast, stage


@dataclass(frozen=True)
class Neutral:
    """A neutral model: tree (Newick), transition bias and background of A, C, G, T."""

    tree: str
    kappa: float = 2.0
    pi: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25)
    species: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        object.__setattr__(self, "species", tuple(sorted(PH.parse_newick(self.tree).leaves())))

    def evolution(self) -> PH.Evolution:
        pi = np.asarray(self.pi, dtype=float)
        return PH.Evolution(PH.parse_newick(self.tree), PH.hky(self.kappa, pi), pi)

    def length(self) -> float:
        return PH.parse_newick(self.tree).total()

    def column(self, pattern: str) -> dict[str, str]:
        return dict(zip(self.species, pattern))


def sites(msa: DataFrame, reference: str, model: Neutral) -> DataFrame:
    """(block_id, column, chrom, start_pos, end_pos, pattern): columns of the alignment in which the reference has a base.

    Species that are absent from a block count as gaps, species outside the tree don't count;
    ``column`` and ``start_pos`` are those of the reference without its gaps.
    """
    c = MS.compress(msa, reference)
    ref = msa.filter(F.col("species") == reference).select("block_id", F.col("chrom").alias("_c"), F.col("start").alias("_s"))
    v = MS.column_vectors(c).join(ref, "block_id")
    pattern = F.concat(*[F.coalesce(F.try_element_at("bases", F.lit(s)), F.lit("-")) for s in model.species])
    start = (F.col("_s") + F.col("column")).cast("long")
    return v.select("block_id", "column", F.col("_c").alias("chrom"), start.alias("start_pos"), (start + 1).alias("end_pos"), pattern.alias("pattern"))


def _per_pattern(s: DataFrame, fn: Callable[[str], tuple], schema: str) -> DataFrame:
    """``s`` joined to ``fn`` of each of its distinct patterns."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(0).to_pylist()
            got = [fn(x) for x in p]
            cols = list(zip(*got)) if got else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c)) if got else pa.array([], pa.float64()) for c in cols]], names=["pattern", *names])

    fits = s.select("pattern").distinct().mapInArrow(run, f"pattern string, {schema}")
    return s.join(bounded_broadcast(fits), "pattern")


def site_rates(s: DataFrame, model: Neutral) -> DataFrame:
    """``s`` with log_likelihood (neutral), omega (the rate that fits best), lod against rate 1, and the tree's length at that rate."""
    e, n = model.evolution(), model.length()

    def fit(p: str) -> tuple:
        omega, lod = e.fit_omega([model.column(p)])
        return float(e.log_likelihood([model.column(p)])), omega, lod, omega * n

    return _per_pattern(s, fit, "log_likelihood double, omega double, lod double, tree_length double")


def site_biases(s: DataFrame, model: Neutral) -> DataFrame:
    """``s`` with the fitted base bias (pi_a, pi_c, pi_g, pi_t) and its log odds."""
    e = model.evolution()

    def fit(p: str) -> tuple:
        pi, lod = e.fit_pi(model.column(p))
        return (*[float(x) for x in pi], lod)

    return _per_pattern(s, fit, "pi_a double, pi_c double, pi_g double, pi_t double, bias_lod double")


def filled(s: DataFrame, model: Neutral) -> DataFrame:
    """``s`` with ``filled``: its pattern with every gap replaced by the most likely base."""
    e = model.evolution()

    def fill(p: str) -> tuple:
        c = e.fill_gaps(model.column(p))
        return ("".join(c[x] for x in model.species),)

    return _per_pattern(s, fill, "filled string")


def _joint(counts: DataFrame, keys: Sequence[str], model: Neutral) -> DataFrame:
    """One rate for all columns of each group of ``counts`` (keys, pattern, n)."""
    e = model.evolution()
    length = model.length()

    @F.pandas_udf("omega double, lod double, log_likelihood double, tree_length double")
    def fit(patterns: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = []
        for p, k in zip(patterns, n):
            cols = [model.column(x) for x in p]
            omega, lod = e.fit_omega(cols, weights=np.asarray(k, dtype=float))
            rows.append((omega, lod, float(np.asarray(k) @ np.log(np.maximum(e.likelihoods(cols), 1e-300))), omega * length))
        return pd.DataFrame(rows, columns=["omega", "lod", "log_likelihood", "tree_length"])

    # A group holds no more patterns than bases ** species.
    g = counts.groupBy(*keys).agg(F.sum("n").alias("columns"), F.array_sort(F.collect_list(F.struct("pattern", "n"))).alias("p"))
    return g.select(*keys, "columns", fit(F.col("p.pattern"), F.col("p.n")).alias("f")).select(*keys, "columns", "f.*")


def region_rates(s: DataFrame, regions: DataFrame, key: str, model: Neutral) -> DataFrame:
    """(key, columns, omega, lod, log_likelihood, tree_length): one rate fitted to all columns in each region; regions without columns are left out."""
    hit = overlap_join(regions.select(key, "chrom", "start_pos", "end_pos"), s.select("chrom", "start_pos", "end_pos", "pattern"), "inner")
    return _joint(hit.groupBy(key, F.col("pattern_r").alias("pattern")).agg(F.count("*").alias("n")), [key], model)


def window_rates(s: DataFrame, model: Neutral, size: int, step: int) -> DataFrame:
    """(chrom, start_pos, columns, omega, ...): one rate fitted to the columns of every window [k * step, k * step + size) that has any."""
    lo = F.greatest(F.floor((F.col("start_pos") - size) / step) + 1, F.lit(0)).cast("long")
    w = s.select("chrom", "pattern", F.explode(F.sequence(lo, F.floor(F.col("start_pos") / step).cast("long"))).alias("_w"))
    n = w.groupBy("chrom", (F.col("_w") * step).alias("start_pos"), "pattern").agg(F.count("*").alias("n"))
    return _joint(n, ["chrom", "start_pos"], model)


def mean_branch_length(rates: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """(key, columns, mean_length): mean length of the fitted trees of the columns in each region."""
    hit = overlap_join(regions.select(key, "chrom", "start_pos", "end_pos"), rates.select("chrom", "start_pos", "end_pos", "tree_length"), "inner")
    return hit.groupBy(key).agg(F.count("*").alias("columns"), F.avg("tree_length_r").alias("mean_length"))


def conserved_states(s: DataFrame, model: Neutral, element_length: float, coverage: float, bias: float = 0.97) -> DataFrame:
    """(block_id, column, state, posterior): most likely path of a neutral (0) and a base-biased (1) state along every block, and the probability of state 1.

    The biased state favours one base, each of the four equally likely, with probability
    ``bias``; ``element_length`` is the expected length of a conserved element and ``coverage`` the expected share of columns in them.
    """
    e = model.evolution()
    biased = [e.with_background(np.where(np.arange(4) == b, bias, (1 - bias) / 3)) for b in range(4)]
    like = lambda p: (float(e.likelihood(model.column(p))), float(np.mean([x.likelihood(model.column(p)) for x in biased])))
    emitted = _per_pattern(s, like, "l0 double, l1 double")
    leave = 1 / element_length
    enter = leave * coverage / (1 - coverage)
    start, step = np.array([1 - coverage, coverage]), np.array([[1 - enter, enter], [leave, 1 - leave]])

    @F.pandas_udf("states array<int>, posterior array<double>")
    def path(l0: pd.Series, l1: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(l0, l1):
            x = np.stack([a, b], 1)
            rows.append((H.viterbi(start, step, x).astype(int).tolist(), H.posterior(start, step, x)[0][:, 1].tolist()))
        return pd.DataFrame(rows, columns=["states", "posterior"])

    blocks = emitted.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("column", "l0", "l1"))).alias("x"))
    out = blocks.select("block_id", "x", path(F.col("x.l0"), F.col("x.l1")).alias("p"))
    return out.select("block_id", F.inline(F.arrays_zip(F.col("x.column").alias("column"), F.col("p.states").alias("state"), F.col("p.posterior").alias("posterior"))))


def conserved_motifs(msa: DataFrame, reference: str, pwms: list[tuple[str, np.ndarray]], least: float, rates: DataFrame) -> DataFrame:
    """(block_id, motif, start, end, strand, score, mean_lod, mean_omega): matches on the reference and the fits of their columns."""
    ref = MS.compress(msa, reference).filter(F.col("species") == reference).select(F.col("block_id").alias("id"), F.col("text").alias("bases"))
    hit = stage(MO.scan(ref, pwms, least).withColumnRenamed("id", "block_id"), "motifs")
    cells = hit.withColumn("column", F.explode(F.sequence(F.col("start").cast("int"), F.col("end").cast("int") - 1)))
    j = cells.join(rates.select("block_id", "column", "lod", "omega"), ["block_id", "column"])
    return j.groupBy(*hit.columns).agg(F.avg("lod").alias("mean_lod"), F.avg("omega").alias("mean_omega"))


def motif_counts(matches: DataFrame, least_lod: float) -> DataFrame:
    """(motif, matches, conserved, share): matches of every motif, and those whose columns fit a slower rate than neutral with ``least_lod`` or more."""
    slow = (F.col("mean_lod") >= least_lod) & (F.col("mean_omega") < 1)
    return matches.groupBy("motif").agg(F.count("*").alias("matches"), F.count_if(slow).alias("conserved")).withColumn("share", F.col("conserved") / F.col("matches"))


def evolved(sequences: DataFrame, model: Neutral, seed: int) -> DataFrame:
    """(id, species, text): every sequence of (id, bases) evolved down the tree; bases other than A, C, G, T are drawn as A.

    The draw depends on (seed, id) only.  Null bases give no rows.
    """
    e = model.evolution()
    kind = sequences.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, s, h in zip(*[b.column(c).to_pylist() for c in range(3)]):
                clean = "".join(x if x in PH.BASES else "A" for x in s.upper())
                out += [(i, k, v) for k, v in e.evolve(clean, h).items()]
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (b.schema.field(0).type, pa.string(), pa.string()))], names=["id", "species", "text"])

    src = sequences.filter(F.col("bases").isNotNull()).select("id", "bases", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2**62)).alias("h"))
    return src.mapInArrow(run, f"id {kind}, species string, text string")
