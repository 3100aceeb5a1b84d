"""Rank tests, group comparisons, multiple-testing corrections and histograms over DataFrames.

Ranks come from counts per distinct value and a running sum over them in a global
order (``ordered``), so neither ties nor one very large group end in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import kernels as K
from strandloom.operators.ordered import Ordered

normal_tail = K.arrow_udf(K.normal_sf)
chi2_tail = K.arrow_udf(K.chi2_sf)
t_p = K.arrow_udf(K.t_two_sided)
f_p = K.arrow_udf(K.f_sf)
hyper_p = K.arrow_udf(lambda t, m, d, h: K.hypergeometric_tail(int(t), int(m), int(d), int(h)))


def moments(df: DataFrame, keys: Sequence[str], group: str, value: str, a: str, b: str) -> DataFrame:
    """Per key: count, mean and sample variance of the values of groups ``a`` and ``b`` (suffixes 1 and 2)."""
    out = []
    for g, s in ((a, "1"), (b, "2")):
        v = F.when(F.col(group) == g, F.col(value))
        out += [F.count(v).alias(f"n{s}"), F.avg(v).alias(f"mean{s}"), F.var_samp(v).alias(f"var{s}")]
    return df.groupBy(*keys).agg(*out)


def tuned_t(m: DataFrame, tuning: float = 0.0) -> DataFrame:
    """``t``: difference of means over pooled sd x sqrt(1/n1 + 1/n2) plus a tuning constant; ``p`` without tuning."""
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2"), F.col("n1") + F.col("n2") - 2))
    se = pooled * F.sqrt(F.try_divide(F.lit(1.0), "n1") + F.try_divide(F.lit(1.0), "n2")) + tuning
    ok = (F.col("n1") > 1) & (F.col("n2") > 1) & (se > 0)
    out = m.withColumn("t", F.when(ok, F.try_divide(F.col("mean1") - F.col("mean2"), se)))
    return out.withColumn("p", t_p("t", (F.col("n1") + F.col("n2") - 2).cast("double")))


def fold_change(m: DataFrame, logged: bool) -> DataFrame:
    """``fold``: difference of means of logged values, else their ratio."""
    return m.withColumn("fold", F.col("mean1") - F.col("mean2") if logged else F.try_divide("mean1", "mean2"))


def paired_t(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    d = F.col(x) - F.col(y)
    return df.groupBy(*keys).agg(F.count(d).alias("n"), (F.avg(d) / F.nullif(F.stddev_samp(d) / F.sqrt(F.count(d)), F.lit(0.0))).alias("t"))


def anova(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """F statistic and p of the groups' means per key; null with fewer than two groups or no spread within."""
    g = df.filter(F.col(value).isNotNull()).groupBy(*keys, group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    n, k = F.sum("n"), F.count("*")
    grand = F.try_divide(F.sum(F.col("n") * F.col("m")), n)
    within = F.sum((F.col("n") - 1) * F.col("v"))
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * grand * grand
    f = F.when((k > 1) & (n > k) & (within > 0), F.try_divide(F.try_divide(between, k - 1), F.try_divide(within, n - k)))
    out = g.groupBy(*keys).agg(k.alias("groups"), n.alias("n"), f.alias("f"))
    return out.withColumn("p", f_p("f", (F.col("groups") - 1).cast("double"), (F.col("n") - F.col("groups")).cast("double")))


def max_mean(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The larger in size of sum(positives)/n and sum(negatives)/n, sign kept."""
    pos = F.sum(F.greatest(F.col(value), F.lit(0.0))) / F.count(value)
    neg = F.sum(F.least(F.col(value), F.lit(0.0))) / F.count(value)
    return df.groupBy(*keys).agg(F.when(pos >= -neg, pos).otherwise(neg).alias("max_mean"))


def _ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """1-based average ranks of distinct values per key: (keys, value, _rank)."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    r = Ordered(c, keys, [value]).running({"_upto": ("sum", F.col("_n"))})
    return r.select(*keys, value, (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias("_rank"))


def mann_whitney(df: DataFrame, keys: Sequence[str], group: str, value: str, a: str, b: str) -> DataFrame:
    """z and two-sided p of group ``a``'s rank sum (average ranks, variance without tie correction)."""
    two = df.filter(F.col(group).isin(a, b) & F.col(value).isNotNull())
    j = two.join(_ranks(two, keys, value), [*keys, value])
    s = j.groupBy(*keys).agg(F.sum(F.when(F.col(group) == a, F.col("_rank"))).alias("w"), F.sum((F.col(group) == a).cast("double")).alias("n1"), F.sum((F.col(group) == b).cast("double")).alias("n2"))
    z = (F.col("w") - F.col("n1") * (F.col("n1") + F.col("n2") + 1) / 2) / F.sqrt(F.nullif(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12, F.lit(0.0)))
    return s.select(*keys, "n1", "n2", z.alias("z")).withColumn("p", 2 * normal_tail(F.abs("z")))


def signed_rank(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Paired signed-rank z and two-sided p: rank sum of differences at most 0 (zeros kept), no tie correction."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_d", F.col(x) - F.col(y)).withColumn("_a", F.abs("_d"))
    j = d.join(_ranks(d, keys, "_a"), [*keys, "_a"])
    s = j.groupBy(*keys).agg(F.sum(F.when(F.col("_d") <= 0, F.col("_rank")).otherwise(0.0)).alias("w"), F.count("*").cast("double").alias("n"))
    z = (F.col("w") - F.col("n") * (F.col("n") + 1) / 4) / F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24)
    return s.select(*keys, "n", z.alias("z")).withColumn("p", 2 * normal_tail(F.abs("z")))


def ks_statistic(df: DataFrame, keys: Sequence[str], group: str, value: str, a: str, b: str) -> DataFrame:
    """Greatest gap between the distribution functions of two groups."""
    c = df.filter(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum((F.col(group) == a).cast("int")).alias("x"), F.sum((F.col(group) == b).cast("int")).alias("y"))
    r = Ordered(c, keys, [value]).running({"_x": ("sum", F.col("x")), "_y": ("sum", F.col("y"))})
    # The totals are the last running sums; a second aggregation over (key) finds them together with the gap.
    t = c.groupBy(*keys).agg(F.sum("x").alias("_tx"), F.sum("y").alias("_ty"))
    j = r.join(t, list(keys)) if keys else r.join(F.broadcast(t))
    return j.groupBy(*keys).agg(F.max(F.abs(F.try_divide("_x", "_tx") - F.try_divide("_y", "_ty"))).alias("ks"))


def fisher_combined(df: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """-2 sum(ln p) and its chi-square tail with 2n degrees; zero p values are taken as 1e-300."""
    s = df.filter(F.col(p).isNotNull()).groupBy(*keys).agg((-2 * F.sum(F.ln(F.greatest(F.col(p), F.lit(1e-300))))).alias("stat"), F.count("*").alias("n"))
    return s.withColumn("p_combined", chi2_tail("stat", (2 * F.col("n")).cast("double")))


# --- multiple testing --------------------------------------------------------------------


def bh_cutoff(df: DataFrame, p: str, alpha: float, by: Sequence[str] = (), first_rank: int = 1) -> DataFrame:
    """Greatest p with p <= rank / n * alpha per ``by`` (0 if none); ``first_rank=0`` counts ranks from 0.

    Works on the counts of distinct p values.
    """
    c = df.filter(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("_n"))
    t = c.groupBy(*by).agg(F.sum("_n").alias("_t"))
    r = Ordered(c, by, [p]).running({"_r": ("sum", F.col("_n"))})
    r = r.join(t, list(by)) if by else r.join(F.broadcast(t))
    ok = F.col(p) <= (F.col("_r") - 1 + first_rank) / F.col("_t") * alpha
    return r.groupBy(*by).agg(F.coalesce(F.max(F.when(ok, F.col(p))), F.lit(0.0)).alias("cutoff"))


def hochberg(df: DataFrame, p: str, by: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """``p_adj``: step-up adjusted p, min over greater ones of (count from the top) x p, at most 1; null p are left out."""
    o = Ordered(df.filter(F.col(p).isNotNull()), by, [f"-{p}", *([tie] if tie else [])]).row_number("_i")
    r = Ordered(o, by, ["_i"]).running({"_m": ("min", F.col("_i") * F.col(p))})
    return r.withColumn("p_adj", F.least(F.lit(1.0), F.col("_m"))).drop("_i", "_m")


def permutation_fdr(observed: DataFrame, permuted: DataFrame, value: str, rounds: int) -> DataFrame:
    """(value, fdr): mean number of permuted values at least as large over observed ones, made monotone from the smallest up."""
    o = observed.groupBy(value).agg(F.count("*").alias("_o")).withColumn("_p", F.lit(0).cast("long"))
    p = permuted.groupBy(value).agg(F.count("*").alias("_p")).withColumn("_o", F.lit(0).cast("long"))
    u = o.select(value, "_o", "_p").unionByName(p.select(value, "_o", "_p")).groupBy(value).agg(F.sum("_o").alias("_o"), F.sum("_p").alias("_p"))
    r = Ordered(u, [], [f"-{value}"]).running({"_po": ("sum", F.col("_p")), "_oo": ("sum", F.col("_o"))}).filter(F.col("_o") > 0)
    r = r.withColumn("_raw", F.least(F.lit(1.0), F.col("_po") / rounds / F.col("_oo")))
    return Ordered(r, [], [value]).running({"fdr": ("min", F.col("_raw"))}).select(value, "fdr")


def family_wise(observed: DataFrame, permuted: DataFrame, value: str, round_col: str) -> DataFrame:
    """``fwer``: share of permutations whose greatest value is at least the observed one."""
    top = permuted.groupBy(round_col).agg(F.max(value).alias("_m"))
    tops = top.agg(F.array_sort(F.collect_list("_m")).alias("_tops"))  # one number a permutation
    return observed.join(F.broadcast(tops)).withColumn("fwer", F.size(F.filter("_tops", lambda t: t >= F.col(value))) / F.size("_tops")).drop("_tops")


def empirical_p(df: DataFrame, background: DataFrame, value: str) -> DataFrame:
    """``p``: 1 - share of background values below each value; ``p_plus_one`` is (b + 1) / (n + 1)."""
    b = background.groupBy(value).agg(F.count("*").alias("_b")).withColumn("_x", F.lit(False))
    x = df.select(value).distinct().select(value, F.lit(0).cast("long").alias("_b"), F.lit(True).alias("_x"))
    u = b.unionByName(x).groupBy(value).agg(F.sum("_b").alias("_b"), F.max("_x").alias("_x"))
    t = u.agg(F.sum("_b").alias("_n"))
    c = Ordered(u, [], [value]).running({"_upto": ("sum", F.col("_b"))}).filter("_x").join(F.broadcast(t))
    below = F.col("_upto") - F.col("_b")
    c = c.select(value, (1 - F.try_divide(below, F.col("_n"))).alias("p"), ((F.col("_n") - below + 1) / (F.col("_n") + 1)).alias("p_plus_one"))
    return df.join(c, value)


# --- histograms --------------------------------------------------------------------------


def histogram(df: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float, bins: int, clamp: bool = True) -> DataFrame:
    """(keys, bin, start, n): equal-width bins from 0; values outside go to the edge bins, or nowhere."""
    width = (hi - lo) / bins
    b = F.floor(F.least(F.greatest((F.col(value) - lo) / width, F.lit(-1.0)), F.lit(float(bins)))).cast("int")
    ok = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ok = ok if clamp else ok.filter((F.col(value) >= lo) & (F.col(value) <= hi))
    return ok.groupBy(*keys, F.greatest(F.lit(0), F.least(F.lit(bins - 1), b)).alias("bin")).agg(F.count("*").alias("n")).withColumn("start", lo + F.col("bin") * width)


def bin_quantile(h: DataFrame, keys: Sequence[str], prob: float, width: float) -> DataFrame:
    """Midpoint of the first bin whose cumulative share passes ``prob``."""
    w = Window.partitionBy(*keys).orderBy("bin")
    c = h.withColumn("_c", F.sum("n").over(w) / F.sum("n").over(Window.partitionBy(*keys)))
    return c.filter(F.col("_c") > prob).groupBy(*keys).agg((F.min("start") + width / 2).alias("quantile"))


def cumulative(h: DataFrame, keys: Sequence[str], at: float) -> DataFrame:
    """Share of counts in bins that start below ``at``, and number in the others."""
    return h.groupBy(*keys).agg((F.sum(F.when(F.col("start") < at, F.col("n")).otherwise(0)) / F.sum("n")).alias("cumulative"), F.sum(F.when(F.col("start") >= at, F.col("n")).otherwise(0)).alias("larger"))


def add_histograms(hs: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    out = hs[0]
    for h in hs[1:]:
        out = out.unionByName(h)
    return out.groupBy(*keys, "bin").agg(F.max("start").alias("start"), F.sum("n").alias("n"))


def compare_histograms(a: DataFrame, b: DataFrame, pseudo: float = 0.0) -> DataFrame:
    """One row: Kullback-Leibler divergence of a from b (natural log) and chi-square distance of their shares."""
    j = a.select("bin", F.col("n").alias("x")).join(b.select("bin", F.col("n").alias("y")), "bin", "full").fillna(0)
    t = j.agg(F.sum(F.col("x") + pseudo).alias("tx"), F.sum(F.col("y") + pseudo).alias("ty"))
    p, q = F.try_divide(F.col("x") + pseudo, F.col("tx")), F.try_divide(F.col("y") + pseudo, F.col("ty"))
    kl = F.sum(F.when((p > 0) & (q > 0), p * F.ln(F.try_divide(p, q))).when(p > 0, F.lit(float("inf"))).otherwise(0.0))
    return j.join(F.broadcast(t)).agg(kl.alias("kl"), F.sum(F.when(p + q > 0, F.try_divide((p - q) ** 2, p + q)).otherwise(0.0)).alias("chi2"))


# --- sequences of numbers ----------------------------------------------------------------


def max_subsum(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """(keys, sum, start, end): the contiguous run with the greatest sum, the first of equals; sum 0, start 0, end -1 without a positive value.

    ``order`` counts from 0 without holes.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    run = df.withColumn("_c", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.min(F.struct((F.col("_c") - F.col(value)).alias("v"), F.col(order).alias("i"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = run.withColumn("_l", low)
    best = b.groupBy(*keys).agg(F.max_by(F.struct((F.col("_c") - F.col("_l.v")).alias("s"), F.col("_l.i").alias("i"), F.col(order).alias("j")), F.struct(F.round(F.col("_c") - F.col("_l.v"), 9), -F.col(order))).alias("_b"))
    some = F.col("_b.s") > 0
    return best.select(*keys, F.when(some, F.col("_b.s")).otherwise(0.0).alias("sum"), F.when(some, F.col("_b.i")).otherwise(0).alias("start"), F.when(some, F.col("_b.j")).otherwise(-1).alias("end"))


def run_over(df: DataFrame, keys: Sequence[str], order: str, value: str, least: float) -> DataFrame:
    """First and last place with a value above ``least``."""
    return df.filter(F.col(value) > least).groupBy(*keys).agg(F.min(order).alias("first"), F.max(order).alias("last"))
