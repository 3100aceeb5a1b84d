"""Queries on matrices and statistics: expression, intensity, and the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import expression as E
from strandloom.operators import matrix as M
from strandloom.operators import stats as S
from strandloom.plans.tables import Registry, table

R = Registry()

MX = "m AS (SELECT row_name AS row, col, max(value) AS value FROM expression WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2)"
IN = "m AS (SELECT row_name AS row, col, max(value) AS value FROM intensity WHERE value IS NOT NULL AND isfinite(value) AND value > 0 GROUP BY 1, 2)"


def mx(spark: SparkSession, d: str) -> DataFrame:
    return M.cells(table(spark, d, "expression"), "row_name", "col", "value")


def intensity(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "intensity")
    return M.cells(t.filter((F.col("value") > 0) & (F.col("value") < float("inf"))), "row_name", "col", "value")


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@R.add("zscore_columns", f'WITH {MX} SELECT row, col, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS value FROM m WINDOW w AS (PARTITION BY col)')
def zscore_columns(spark, d):
    return r6(M.zscore(mx(spark, d)), "value")


@R.add("zscore_rows", f'WITH {MX} SELECT row, col, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) AS value FROM m WINDOW w AS (PARTITION BY row)')
def zscore_rows(spark, d):
    return r6(M.zscore(mx(spark, d), "row"), "value")


@R.add("mean_normalised", f"WITH {MX} SELECT row, col, round(value / avg(value) OVER (PARTITION BY col), 6) AS value FROM m")
def mean_normalised(spark, d):
    return r6(M.divide_by_mean(mx(spark, d)), "value")


@R.add("median_normalised", f"WITH {MX} SELECT row, col, round(value / median(value) OVER (PARTITION BY col), 6) AS value FROM m")
def median_normalised(spark, d):
    return r6(M.divide_by_median(mx(spark, d)), "value")


@R.add("median_centred", f"WITH {IN} SELECT row, col, round(value - median(value) OVER (PARTITION BY col), 6) AS value FROM m")
def median_centred(spark, d):
    return r6(M.median_centre(intensity(spark, d)), "value")


@R.add("column_mad", f"WITH {IN}, c AS (SELECT *, median(value) OVER (PARTITION BY col) AS md FROM m) SELECT col, round(max(md), 6) AS median, round(median(abs(value - md)), 6) AS mad FROM c GROUP BY 1")
def column_mad(spark, d):
    return r6(M.mad(intensity(spark, d)), "median", "mad")


@R.add("scale_normalised", f"WITH {MX}, c AS (SELECT *, median(value) OVER (PARTITION BY col) AS md FROM m), s AS (SELECT col, max(md) AS md, median(abs(value - md)) AS mad FROM c GROUP BY 1), g AS (SELECT exp(avg(ln(mad))) AS g FROM s) SELECT m.row, m.col, round(s.md + (value - s.md) * g.g / s.mad, 6) AS value FROM m JOIN s ON m.col = s.col CROSS JOIN g")
def scale_normalised(spark, d):
    return r6(M.scale_normalise(mx(spark, d)), "value")


@R.add("density_normalised", f"WITH {MX} SELECT row, col, round(value / sum(value) OVER (PARTITION BY col), 9) AS value FROM m")
def density_normalised(spark, d):
    return M.density(mx(spark, d)).withColumn("value", F.round("value", 9))


@R.add("log2_floored", f"WITH {MX} SELECT row, col, round(log2(greatest(value, 50) + 1), 6) AS value FROM m")
def log2_floored(spark, d):
    return r6(M.log_transform(M.floor_at(mx(spark, d), 50.0), 2, 1.0), "value")


@R.add("quantile_normalised", f"WITH {MX}, r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY value, row) AS k FROM m) SELECT row, col, round(avg(value) OVER (PARTITION BY k), 6) AS value FROM r")
def quantile_normalised(spark, d):
    return r6(M.quantile_normalise(mx(spark, d)), "value")


@R.add("average_ranks", f"WITH {MX} SELECT row, col, value, rank() OVER w - 1 + (count(*) OVER (PARTITION BY col, value) - 1) / 2 AS rank FROM m WINDOW w AS (PARTITION BY col ORDER BY value)")
def average_ranks(spark, d):
    return M.average_rank(mx(spark, d), "col")


@R.add("column_correlation", f"WITH {MX} SELECT a.col AS a, b.col AS b, count(*) AS n, round(corr(a.value, b.value), 6) AS r FROM m a JOIN m b ON a.row = b.row AND a.col < b.col GROUP BY 1, 2")
def column_correlation(spark, d):
    return r6(M.correlation(mx(spark, d)), "r")


@R.add("column_spearman", f"WITH {MX}, k AS (SELECT row, col, rank() OVER w + (count(*) OVER (PARTITION BY col, value) - 1) / 2 AS value FROM m WINDOW w AS (PARTITION BY col ORDER BY value)) SELECT a.col AS a, b.col AS b, count(*) AS n, round(corr(a.value, b.value), 6) AS r FROM k a JOIN k b ON a.row = b.row AND a.col < b.col GROUP BY 1, 2")
def column_spearman(spark, d):
    return r6(M.correlation(mx(spark, d), ranks=True), "r")


@R.add("matrix_product", f"WITH {MX} SELECT a.col AS row, b.col AS col, round(sum(a.value * b.value), 2) AS value FROM m a JOIN m b ON a.row = b.row GROUP BY 1, 2")
def matrix_product(spark, d):
    """The matrix's transpose times itself."""
    m = mx(spark, d)
    t = m.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")
    return M.product(t, m).withColumn("value", F.round("value", 2))


@R.add("versus_controls", f"WITH {IN}, d AS (SELECT DISTINCT row_name FROM intensity WHERE description = 'control'), s AS (SELECT col, avg(value) AS a, stddev_samp(value) AS s FROM m WHERE row IN (SELECT row_name FROM d) GROUP BY 1) SELECT m.row, m.col, round((value - a) / nullif(s, 0), 6) AS value FROM m JOIN s ON m.col = s.col")
def versus_controls(spark, d):
    """z against the control rows of each column, controls looked up by a semi join."""
    m = intensity(spark, d)
    c = table(spark, d, "intensity").filter(F.col("description") == "control").select(F.col("row_name").alias("row")).distinct()
    s = m.join(c, "row", "left_semi").groupBy("col").agg(F.avg("value").alias("a"), F.stddev_samp("value").alias("s"))
    return m.join(s, "col").select("row", "col", F.round((F.col("value") - F.col("a")) / F.nullif(F.col("s"), F.lit(0.0)), 6).alias("value"))


@R.add("variable_rows", f"WITH {MX} SELECT row FROM m GROUP BY 1 HAVING min(value) > 0 AND max(value) >= 10 * min(value)")
def variable_rows(spark, d):
    return M.variable_rows(mx(spark, d), 10.0).select("row").distinct()


@R.add("rows_above", f"WITH {MX} SELECT row FROM m GROUP BY 1 HAVING count(*) FILTER (value >= 200) >= 10")
def rows_above(spark, d):
    return M.rows_above(mx(spark, d), 200.0, 10).select("row").distinct()


@R.add("size_factors", f"WITH {MX}, g AS (SELECT row, exp(avg(CASE WHEN value > 0 THEN ln(value) END)) AS g FROM m GROUP BY 1 HAVING min(value) > 0 AND count(*) = (SELECT count(DISTINCT col) FROM m)) SELECT col, round(1 / median(value / g), 6) AS factor FROM m JOIN g ON m.row = g.row GROUP BY 1")
def size_factors(spark, d):
    return r6(M.size_factors(mx(spark, d)), "factor")


@R.add("row_and_column_stats", f"WITH {MX} SELECT 'row' AS kind, row AS key, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS lo, max(value) AS hi FROM m GROUP BY 2 UNION ALL SELECT 'col', col, count(*), round(avg(value), 6), round(stddev_samp(value), 6), min(value), max(value) FROM m GROUP BY 2")
def row_and_column_stats(spark, d):
    m = mx(spark, d)
    per = lambda k: m.groupBy(F.lit(k).alias("kind"), F.col(k).alias("key")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return per("row").unionByName(per("col"))


@R.add("compress_by_description", "WITH m AS (SELECT row_name, description, col, max(value) AS value FROM expression WHERE value IS NOT NULL AND NOT isnan(value) AND description IS NOT NULL GROUP BY 1, 2, 3) SELECT description, col, round(avg(value), 6) AS value, count(*) AS n FROM m GROUP BY 1, 2")
def compress_by_description(spark, d):
    t = table(spark, d, "expression").filter(F.col("value").isNotNull() & ~F.isnan("value") & F.col("description").isNotNull())
    once = t.groupBy("row_name", "description", "col").agg(F.max("value").alias("value"))
    return once.groupBy("description", "col").agg(F.round(F.avg("value"), 6).alias("value"), F.count("*").alias("n"))


@R.add("wide_matrix", f"WITH {MX} SELECT row, max(value) FILTER (col = 'smp_01') AS smp_01, max(value) FILTER (col = 'smp_02') AS smp_02, max(value) FILTER (col = 'smp_03') AS smp_03 FROM m GROUP BY 1")
def wide_matrix(spark, d):
    return M.to_wide(mx(spark, d), ["smp_01", "smp_02", "smp_03"])


@R.add("wide_matrix_all")
def wide_matrix_all(spark, d):
    """The whole matrix in wide form: a column for every ``col`` of the table."""
    m = mx(spark, d)
    return M.to_wide(m, [r["col"] for r in m.select("col").distinct().orderBy("col").collect()])


# --- comparisons -------------------------------------------------------------------------

GRP = f"{MX}, l AS (SELECT row, value, col, CASE WHEN CAST(right(col, 2) AS INTEGER) <= 20 THEN 'a' ELSE 'b' END AS g FROM m)"


def samples(spark: SparkSession, d: str) -> DataFrame:
    c = mx(spark, d).select("col").distinct()
    return c.withColumn("group", F.when(F.substring("col", -2, 2).cast("int") <= 20, "a").otherwise("b"))


def grouped(spark: SparkSession, d: str) -> DataFrame:
    return mx(spark, d).withColumn("g", F.when(F.substring("col", -2, 2).cast("int") <= 20, "a").otherwise("b"))


@R.add("t_and_fold", f"""
WITH {GRP}, s AS (SELECT row, count(*) FILTER (g = 'a') AS n1, count(*) FILTER (g = 'b') AS n2, avg(value) FILTER (g = 'a') AS m1, avg(value) FILTER (g = 'b') AS m2, var_samp(value) FILTER (g = 'a') AS v1, var_samp(value) FILTER (g = 'b') AS v2 FROM l GROUP BY 1)
SELECT row, round((m1 - m2) / (sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * sqrt(1 / n1 + 1 / n2) + 0.5), 6) AS t, round(m1 / m2, 6) AS fold FROM s
""")
def t_and_fold(spark, d):
    m = S.moments(grouped(spark, d), ["row"], "g", "value", "a", "b")
    return r6(S.fold_change(S.tuned_t(m, 0.5), False).select("row", "t", "fold"), "t", "fold")


@R.add("anova_f", f"""
WITH {MX}, l AS (SELECT *, CAST(floor((CAST(right(col, 2) AS INTEGER) - 1) / 10) AS INTEGER) AS g FROM m), s AS (SELECT row, g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM l GROUP BY 1, 2),
x AS (SELECT row, count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS gm, sum((n - 1) * v) AS w, sum(n * m * m) AS q FROM s GROUP BY 1)
SELECT row, round(((q - n * gm * gm) / (k - 1)) / (w / (n - k)), 4) AS f FROM x WHERE w > 0
""")
def anova_f(spark, d):
    m = mx(spark, d).withColumn("g", F.floor((F.substring("col", -2, 2).cast("int") - 1) / 10))
    return S.anova(m, ["row"], "g", "value").filter(F.col("f").isNotNull()).select("row", F.round("f", 4).alias("f"))


@R.add("mann_whitney_z", f"""
WITH {GRP}, k AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY row, value) - 1) / 2 AS rk FROM l WINDOW w AS (PARTITION BY row ORDER BY value)),
s AS (SELECT row, sum(rk) FILTER (g = 'a') AS w, count(*) FILTER (g = 'a') AS n1, count(*) FILTER (g = 'b') AS n2 FROM k GROUP BY 1)
SELECT row, round((w - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 6) AS z FROM s
""")
def mann_whitney_z(spark, d):
    return r6(S.mann_whitney(grouped(spark, d), ["row"], "g", "value", "a", "b").select("row", "z"), "z")


@R.add("ks_gap", f"""
WITH {GRP}, c AS (SELECT row, value, count(*) FILTER (g = 'a') AS x, count(*) FILTER (g = 'b') AS y FROM l GROUP BY 1, 2),
r AS (SELECT row, sum(x) OVER w / sum(x) OVER (PARTITION BY row) AS fx, sum(y) OVER w / sum(y) OVER (PARTITION BY row) AS fy FROM c WINDOW w AS (PARTITION BY row ORDER BY value))
SELECT row, round(max(abs(fx - fy)), 6) AS ks FROM r GROUP BY 1
""")
def ks_gap(spark, d):
    return r6(S.ks_statistic(grouped(spark, d), ["row"], "g", "value", "a", "b"), "ks")


@R.add("max_mean", f"WITH {MX}, z AS (SELECT col, value - median(value) OVER (PARTITION BY col) AS v FROM m), s AS (SELECT col, sum(greatest(v, 0)) / count(*) AS p, sum(least(v, 0)) / count(*) AS n FROM z GROUP BY 1) SELECT col, round(CASE WHEN p >= -n THEN p ELSE n END, 4) AS max_mean FROM s")
def max_mean(spark, d):
    m = mx(spark, d)
    c = M.median_centre(m).withColumnRenamed("value", "v")
    return S.max_mean(c, ["col"], "v").withColumn("max_mean", F.round("max_mean", 4))


PV = "p AS (SELECT o_orderpriority AS grp, o_orderkey AS id, (o_orderkey * 7919 % 10007 + 1) / 10008.0::double AS p FROM orders)"


def pvalues(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") * 7919 % 10007 + 1) / F.lit(10008.0)).alias("p"))


@R.add("bh_cutoff", f"WITH {PV}, k AS (SELECT *, rank() OVER w + count(*) OVER (PARTITION BY grp, p) - 1 AS r, count(*) OVER (PARTITION BY grp) AS n FROM p WINDOW w AS (PARTITION BY grp ORDER BY p)) SELECT grp, coalesce(max(p) FILTER (p <= r / n * 0.9999), 0) AS cutoff FROM k GROUP BY 1")
def bh_cutoff(spark, d):
    return S.bh_cutoff(pvalues(spark, d), "p", 0.9999, ["grp"])


@R.add("hochberg_adjusted", f"WITH {PV}, k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p DESC, id) AS i FROM p) SELECT grp, id, round(least(1, min(i * p) OVER (PARTITION BY grp ORDER BY i ROWS UNBOUNDED PRECEDING)), 9) AS p_adj FROM k")
def hochberg_adjusted(spark, d):
    h = S.hochberg(pvalues(spark, d), "p", ["grp"], "id")
    return h.select("grp", "id", F.round("p_adj", 9).alias("p_adj"))


@R.add("fisher_statistic", f"WITH {PV} SELECT grp, round(-2 * sum(ln(p)), 4) AS stat, count(*) AS n FROM p GROUP BY 1")
def fisher_statistic(spark, d):
    return S.fisher_combined(pvalues(spark, d), ["grp"], "p").select("grp", F.round("stat", 4).alias("stat"), "n")


@R.add("empirical_p", f"WITH {PV}, x AS (SELECT id, p FROM p WHERE grp = '1-URGENT'), b AS (SELECT p FROM p WHERE grp <> '1-URGENT'), n AS (SELECT count(*) AS n FROM b) SELECT x.id, round(1 - (SELECT count(*) FROM b WHERE b.p < x.p) / n.n, 9) AS p_emp FROM x, n")
def empirical_p(spark, d):
    p = pvalues(spark, d)
    x = p.filter(F.col("grp") == "1-URGENT").select("id", F.col("p").alias("v"))
    return S.empirical_p(x, p.filter(F.col("grp") != "1-URGENT").select(F.col("p").alias("v")), "v").select("id", F.round("p", 9).alias("p_emp"))


@R.add("max_subsum", f"""
WITH {MX}, c AS (SELECT row, CAST(right(col, 2) AS INTEGER) AS k0, value - avg(value) OVER (PARTITION BY row) AS v FROM m), o AS (SELECT row, row_number() OVER (PARTITION BY row ORDER BY k0) - 1 AS k, v FROM c),
a AS (SELECT x.row, x.k AS s, y.k AS e, (SELECT sum(v) FROM o z WHERE z.row = x.row AND z.k BETWEEN x.k AND y.k) AS t FROM o x JOIN o y ON x.row = y.row AND x.k <= y.k)
SELECT row, round(greatest(0, max(t)), 5) AS sum FROM a GROUP BY 1
""")
def max_subsum(spark, d):
    """Greatest contiguous sum of each row's centred values."""
    from pyspark.sql import Window

    m = mx(spark, d)
    c = m.join(m.groupBy("row").agg(F.avg("value").alias("_m")), "row").withColumn("v", F.col("value") - F.col("_m"))
    k = F.row_number().over(Window.partitionBy("row").orderBy(F.substring("col", -2, 2).cast("int"))) - 1
    return S.max_subsum(c.withColumn("k", k), ["row"], "k", "v").select("row", F.round("sum", 5).alias("sum"))


@R.add("differential_permutations")
def differential_permutations(spark, d):
    return E.compare(mx(spark, d), samples(spark, d), "a", "b", rounds=20, seed=4)


# --- sets --------------------------------------------------------------------------------

SETS = "sets AS (SELECT DISTINCT p_brand AS set, p_partkey AS gene FROM part), rk AS (SELECT l_partkey AS gene, sum(l_extendedprice * (l_discount - 0.05)) AS score FROM lineitem GROUP BY 1)"


def gene_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sets = table(spark, d, "part").select(F.col("p_brand").alias("set"), F.col("p_partkey").alias("gene")).distinct()
    rk = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.round(F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.05)), 4).alias("score"))
    return sets, rk


@R.add("running_enrichment", """
WITH sets AS (SELECT DISTINCT p_brand AS set, p_partkey AS gene FROM part), rk AS (SELECT l_partkey AS gene, round(sum(l_extendedprice * (l_discount - 0.05)), 4) AS score FROM lineitem GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, gene) AS k FROM rk), n AS (SELECT count(*) AS n FROM rk),
s AS (SELECT x.set, count(*) AS size, sum(abs(o.score)) AS tot FROM sets x JOIN o ON x.gene = o.gene GROUP BY 1),
st AS (SELECT s.set, o.k, CASE WHEN h.gene IS NOT NULL THEN abs(o.score) / s.tot ELSE -1.0 / (n.n - s.size) END AS d, s.size FROM s CROSS JOIN o CROSS JOIN n LEFT JOIN sets h ON h.set = s.set AND h.gene = o.gene),
r AS (SELECT set, size, sum(d) OVER (PARTITION BY set ORDER BY k) AS es FROM st), x AS (SELECT set, max(size) AS size, max(es) AS hi, min(es) AS lo FROM r GROUP BY 1)
SELECT set, size, round(CASE WHEN hi >= -lo THEN hi ELSE lo END, 6) AS es FROM x
""")
def running_enrichment(spark, d):
    sets, rk = gene_sets(spark, d)
    return r6(E.running_enrichment(rk, sets), "es")


@R.add("set_hits", """
WITH sets AS (SELECT DISTINCT p_brand AS set, p_partkey AS gene FROM part), sel AS (SELECT DISTINCT l_partkey AS gene FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)
SELECT s.set, count(*) AS size, count(sel.gene) AS hits FROM sets s LEFT JOIN sel ON s.gene = sel.gene GROUP BY 1
""")
def set_hits(spark, d):
    sets, _ = gene_sets(spark, d)
    sel = table(spark, d, "lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).select(F.col("l_partkey").alias("gene"))
    return E.set_enrichment(sets, sel, 100_000).select("set", "size", "hits")


@R.add("set_enrichment_p", """
WITH sets AS (SELECT DISTINCT p_brand AS set, p_partkey AS gene FROM part), sel AS (SELECT DISTINCT l_partkey AS gene FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45), u AS (SELECT count(*) AS t FROM part), n AS (SELECT count(*) AS d FROM sel),
h AS (SELECT set, count(*) AS size, count(sel.gene) AS hits FROM sets LEFT JOIN sel ON sets.gene = sel.gene GROUP BY 1), x AS (SELECT h.*, t, d, unnest(range(hits, least(size, d) + 1)) AS i FROM h, u, n),
p AS (SELECT set, sum(CASE WHEN d - i <= t - size THEN exp(lgamma(size + 1) - lgamma(i + 1) - lgamma(size - i + 1) + lgamma(t - size + 1) - lgamma(d - i + 1) - lgamma(t - size - d + i + 1) - lgamma(t + 1) + lgamma(d + 1) + lgamma(t - d + 1)) ELSE 0 END) AS p FROM x GROUP BY 1)
SELECT set, size, hits, round(CASE WHEN hits <= 0 THEN 1 ELSE least(1, p) END, 7) AS p FROM h JOIN p USING (set)
""")
def set_enrichment_p(spark, d):
    sets, _ = gene_sets(spark, d)
    sel = table(spark, d, "lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).select(F.col("l_partkey").alias("gene"))
    universe = table(spark, d, "part").count()
    return E.set_enrichment(sets, sel, universe).withColumn("p", F.round("p", 7))


@R.add("set_max_mean", """
WITH sets AS (SELECT DISTINCT p_brand AS set, p_partkey AS gene FROM part), rk AS (SELECT l_partkey AS gene, round(sum(l_extendedprice * (l_discount - 0.05)), 4) AS score FROM lineitem GROUP BY 1),
s AS (SELECT set, sum(greatest(score, 0)) / count(*) AS p, sum(least(score, 0)) / count(*) AS n FROM sets JOIN rk ON sets.gene = rk.gene GROUP BY 1) SELECT set, round(CASE WHEN p >= -n THEN p ELSE n END, 3) AS max_mean FROM s
""")
def set_max_mean(spark, d):
    sets, rk = gene_sets(spark, d)
    return E.gene_set_max_mean(rk, sets).withColumn("max_mean", F.round("max_mean", 3))


@R.add("signatures", f"""
WITH {GRP}, s AS (SELECT row, g, sum(value) AS s, count(*) AS n FROM l GROUP BY 1, 2), d AS (SELECT row, g, round(s / n - (sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0), 6) AS diff FROM s WINDOW w AS (PARTITION BY row))
SELECT g AS "group", row, rank, diff FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY diff DESC, row) AS rank FROM d WHERE diff IS NOT NULL) WHERE rank <= 10
""")
def signatures(spark, d):
    return r6(E.signatures(mx(spark, d), samples(spark, d), 10), "diff")


def profiles(spark: SparkSession, d: str) -> DataFrame:
    m = M.log_transform(mx(spark, d))
    cols = [f"smp_{i:02d}" for i in range(1, 41)]
    p = M.row_profiles(m, cols)
    mean = F.aggregate("profile", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / F.size(F.array_compact("profile"))
    return p.select("row", F.transform("profile", lambda x: F.coalesce(x, mean)).alias("profile"))


@R.add("kmeans_euclidean")
def kmeans_euclidean(spark, d):
    return E.kmeans(profiles(spark, d), 6, "euclidean", seed=1)


@R.add("kmeans_pearson")
def kmeans_pearson(spark, d):
    return E.kmeans(profiles(spark, d), 6, "pearson", seed=1)


@R.add("silhouette")
def silhouette(spark, d):
    p = profiles(spark, d)
    return E.silhouette(p, E.kmeans(p, 4, "euclidean", seed=2))


@R.add("js_specificity", f"""
WITH {MX}, s AS (SELECT row, value / sum(value) OVER (PARTITION BY row) AS p, sum(value) OVER (PARTITION BY row) AS t, col FROM m),
h AS (SELECT row, sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END) AS h, sum(CASE WHEN p > 0 THEN -p / 2 * log2(p / 2) ELSE 0 END) AS hm FROM s WHERE t > 0 GROUP BY 1),
j AS (SELECT s.row, s.col, h.hm - CASE WHEN p > 0 THEN -p / 2 * log2(p / 2) ELSE 0 END - (p + 1) / 2 * log2((p + 1) / 2) - h.h / 2 AS d FROM s JOIN h ON s.row = h.row)
SELECT row, round(max(1 - sqrt(greatest(d, 0))), 6) AS specificity FROM j GROUP BY 1
""")
def js_specificity(spark, d):
    """Greatest specificity of each row's profile to one column."""
    m = M.density(mx(spark, d), "row")
    g = m.groupBy("row").agg(F.collect_list("value").alias("p")).filter(F.exists("p", lambda x: x > 0))
    return g.select("row", F.round(F.array_max(M.specificity(F.col("p"))), 6).alias("specificity"))


@R.add("embedding_distances", """
WITH e AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings), c AS (SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) r(i) GROUP BY 1, 2), cc AS (SELECT label, list(m ORDER BY i) AS m FROM c GROUP BY 1)
SELECT e.vec_id, round(sqrt(list_sum([(e.v[i] - cc.m[i]) * (e.v[i] - cc.m[i]) for i in range(1, 65)])), 5) AS euclid, round(list_sum([abs(e.v[i] - cc.m[i]) for i in range(1, 65)]), 5) AS manhattan FROM e JOIN cc ON e.label = cc.label
""")
def embedding_distances(spark, d):
    """Distance of every vector to its label's mean."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    c = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    j = e.join(c, "label")
    return j.select("vec_id", F.round(M.euclidean(F.col("v"), F.col("m")), 5).alias("euclid"), F.round(M.manhattan(F.col("v"), F.col("m")), 5).alias("manhattan"))
