"""Matrices in long form (row, col, value) and the statistics of their rows and columns.

Columns of the frames are ``row``, ``col`` and ``value``; cells that are null or NaN don't
exist.  Normalisations are grouped aggregates joined back; ranks and medians come from a
global order, so the values of one hot column are never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.ordered import Ordered


def cells(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Long matrix of valid cells, each (row, col) once (its greatest value)."""
    v = F.col(value).cast("double")
    ok = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull() & v.isNotNull() & ~F.isnan(v))
    return ok.groupBy(F.col(row).alias("row"), F.col(col).alias("col")).agg(F.max(v).alias("value"))


def _joined(m: DataFrame, by: str, *aggs: Column) -> DataFrame:
    return m.join(m.groupBy(by).agg(*aggs), by)


def zscore(m: DataFrame, by: str = "col", scaled: bool = False, fudge: float = 0.0) -> DataFrame:
    """(x - mean) / (sd + fudge) per ``by``; ``scaled`` multiplies by the root of the count.  Null for a single value or no spread."""
    j = _joined(m, by, F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"), F.count("*").alias("_n"))
    z = (F.col("value") - F.col("_m")) / F.nullif(F.col("_s") + fudge, F.lit(0.0))
    return j.withColumn("value", z * F.sqrt("_n") if scaled else z).select("row", "col", "value")


def divide_by_mean(m: DataFrame, by: str = "col") -> DataFrame:
    j = _joined(m, by, F.avg("value").alias("_m"))
    return j.withColumn("value", F.try_divide("value", "_m")).select("row", "col", "value")


def medians(m: DataFrame, by: str, value: str = "value", name: str = "median") -> DataFrame:
    """(by, name): exact medians from places in a global order, averaging the two middle values of even counts."""
    n = m.groupBy(by).agg(F.count("*").alias("_n"))
    p = Ordered(m.select(by, value, F.xxhash64("row", "col").alias("_h")), [by], [value, "_h"]).row_number("_k").join(n, by)
    mid = (F.col("_k") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_k") == F.floor(F.col("_n") / 2) + 1)
    return p.filter(mid).groupBy(by).agg(F.avg(value).alias(name))


def divide_by_median(m: DataFrame, by: str = "col") -> DataFrame:
    j = m.join(medians(m, by, name="_m"), by)
    return j.withColumn("value", F.try_divide("value", "_m")).select("row", "col", "value")


def median_centre(m: DataFrame, by: str = "col") -> DataFrame:
    return m.join(medians(m, by, name="_m"), by).withColumn("value", F.col("value") - F.col("_m")).select("row", "col", "value")


def mad(m: DataFrame, by: str = "col") -> DataFrame:
    """(by, median, mad)."""
    first = medians(m, by)
    off = m.join(first, by).withColumn("_d", F.abs(F.col("value") - F.col("median")))
    return first.join(medians(off, by, "_d", "mad"), by)


def scale_normalise(m: DataFrame) -> DataFrame:
    """Columns stretched around their medians to the geometric mean of all columns' MADs."""
    d = mad(m)
    g = d.agg(F.exp(F.avg(F.ln("mad"))).alias("_g"))
    j = m.join(d, "col").join(F.broadcast(g))
    return j.withColumn("value", F.col("median") + (F.col("value") - F.col("median")) * F.try_divide("_g", "mad")).select("row", "col", "value")


def density(m: DataFrame, by: str = "col") -> DataFrame:
    return _joined(m, by, F.sum("value").alias("_t")).withColumn("value", F.try_divide("value", "_t")).select("row", "col", "value")


def log_transform(m: DataFrame, base: int = 2, fudge: float = 1.0) -> DataFrame:
    x = F.col("value") + fudge
    return m.withColumn("value", F.when(x > 0, F.log2(x) if base == 2 else F.log10(x)))


def floor_at(m: DataFrame, least: float) -> DataFrame:
    return m.withColumn("value", F.greatest("value", F.lit(least)))


def quantile_normalise(m: DataFrame) -> DataFrame:
    """Each value replaced by the mean over columns of the values of its place in the sorted column; ties go by row."""
    r = Ordered(m, ["col"], ["value", "row"]).row_number("_k")
    means = r.groupBy("_k").agg(F.avg("value").alias("_v"))
    return r.join(means, "_k").select("row", "col", F.col("_v").alias("value"))


def average_rank(m: DataFrame, by: str, ascending: bool = True, name: str = "rank") -> DataFrame:
    """0-based rank of each value per ``by``, ties sharing the mean of their ranks."""
    counts = m.groupBy(by, "value").agg(F.count("*").alias("_n"))
    upto = Ordered(counts, [by], ["value" if ascending else "-value"]).running({"_upto": ("sum", F.col("_n"))})
    ranks = upto.select(by, "value", (F.col("_upto") - F.col("_n") + (F.col("_n") - 1) / 2).alias(name))
    return m.join(ranks, [by, "value"]).select(*m.columns, name)


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product: a's columns are b's rows; missing cells are 0."""
    j = a.select("row", F.col("col").alias("k"), F.col("value").alias("x")).join(b.select(F.col("row").alias("k"), "col", F.col("value").alias("y")), "k")
    return j.groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def versus_controls(m: DataFrame, controls: Sequence[str], fudge: float = 0.0) -> DataFrame:
    """z of each value against its column's control rows."""
    is_c = F.col("row").isin(list(controls))
    j = _joined(m, "col", F.avg(F.when(is_c, F.col("value"))).alias("_m"), F.stddev_samp(F.when(is_c, F.col("value"))).alias("_s"))
    return j.withColumn("value", (F.col("value") - F.col("_m")) / F.nullif(F.col("_s") + fudge, F.lit(0.0))).select("row", "col", "value")


def variable_rows(m: DataFrame, fold: float) -> DataFrame:
    """Rows whose greatest value is at least ``fold`` times the least one (which must be above 0)."""
    keep = m.groupBy("row").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).filter((F.col("lo") > 0) & (F.col("hi") >= fold * F.col("lo")))
    return m.join(keep.select("row"), "row", "left_semi")


def rows_above(m: DataFrame, least: float, count: int) -> DataFrame:
    keep = m.groupBy("row").agg(F.sum((F.col("value") >= least).cast("int")).alias("n")).filter(F.col("n") >= count)
    return m.join(keep.select("row"), "row", "left_semi")


def size_factors(m: DataFrame) -> DataFrame:
    """(col, factor): 1 / median over rows of value / geometric mean of the row; rows with a zero or a lost cell are skipped."""
    n_cols = m.agg(F.count_distinct("col").alias("_c"))
    full = m.groupBy("row").agg(F.min("value").alias("lo"), F.count("*").alias("n"), F.exp(F.avg(F.when(F.col("value") > 0, F.ln("value")))).alias("g"))
    ok = full.join(F.broadcast(n_cols)).filter((F.col("lo") > 0) & (F.col("n") == F.col("_c"))).select("row", "g")
    q = m.join(ok, "row").withColumn("_q", F.col("value") / F.col("g"))
    return medians(q, "col", "_q", "_m").select("col", F.try_divide(F.lit(1.0), "_m").alias("factor"))


def corr_of(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate that is null, not an error, without spread; both columns must be present or lost together."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def correlation(m: DataFrame, by: str = "col", ranks: bool = False) -> DataFrame:
    """(a, b, n, r), a < b: Pearson (or Spearman) correlation of every pair of columns (or rows) over the cells both have.

    Pairs meet on the other dimension, so this suits the short dimension of a matrix
    (samples); its output is quadratic in it by definition.
    """
    other = "row" if by == "col" else "col"
    src = average_rank(m, by).select("row", "col", F.col("rank").alias("value")) if ranks else m
    # One list per line of the other dimension, expanded to its pairs map-side.
    lists = src.groupBy(other).agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), F.col("value").alias("v")))).alias("c"))
    pairs = lists.select(F.explode(F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda y: F.struct(x["k"].alias("a"), y["k"].alias("b"), x["v"].alias("x"), y["v"].alias("y")))))).alias("p")).select("p.*")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), corr_of("x", "y").alias("r"))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two arrays of shares; null if any share is null."""
    h = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log2(x)).otherwise(F.when(x.isNotNull(), 0.0)))
    mid = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return F.sqrt(F.greatest(h(mid) - (h(p) + h(q)) / 2, F.lit(0.0)))


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log2(x)).otherwise(0.0))


def relative(p: Column) -> Column:
    return let_total(p, lambda t: F.transform(p, lambda x: F.try_divide(x, t)))


def let_total(p: Column, body) -> Column:
    return F.get(F.transform(F.array(F.aggregate(p, F.lit(0.0), lambda s, x: s + x)), body), F.lit(0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays; null without spread."""
    s = lambda x: F.aggregate(x, F.lit(0.0), lambda t, v: t + v)
    n = F.size(a)
    dot = lambda x, y: s(F.zip_with(x, y, lambda p, q: p * q))
    cov = n * dot(a, b) - s(a) * s(b)
    var = (n * dot(a, a) - s(a) * s(a)) * (n * dot(b, b) - s(b) * s(b))
    return F.when(var > 0, cov / F.sqrt(F.greatest(var, F.lit(0.0))))


def sign_hamming(a: Column, b: Column, threshold: float) -> Column:
    """Places where the two arrays differ in being above, below or at the threshold either side of 0."""
    cls = lambda x: F.when(x > threshold, 1).when(x < -threshold, -1).otherwise(0)
    return F.aggregate(F.zip_with(a, b, lambda x, y: (cls(x) != cls(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def specificity(shares: Column, most: float = 1.0) -> Column:
    """array<double>: 1 - JS distance to each one-hot profile over ``most``, at least 0."""
    n = F.size(shares)
    hot = lambda i: F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.when(i == j, 1.0).otherwise(0.0))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(1 - js_distance(shares, hot(i)) / most, F.lit(0.0)))


def to_wide(m: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One column per name in ``cols``."""
    return m.groupBy("row").pivot("col", list(cols)).agg(F.first("value"))


def row_profiles(m: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(row, profile): values in the order of ``cols``, null where lost."""
    w = to_wide(m, cols)
    return w.select("row", F.array(*[F.col(f"`{c}`") for c in cols]).alias("profile"))
