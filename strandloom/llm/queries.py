"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import canonical as C
from strandloom.llm import clusters as K
from strandloom.llm import mixing as M
from strandloom.llm import packing as P
from strandloom.llm import quantiles as Q
from strandloom.llm.tokens import token_counts
from strandloom.plans.tables import Registry, table
from strandloom.session import bounded_broadcast, stage

R = Registry()
CAPACITY = 2048


# --- p2: percentiles ---------------------------------------------------------------------


def intensity_values(spark: SparkSession, d: str) -> DataFrame:
    """Valid cells of intensity, each once, with the first run day that delivered it."""
    return Q.valid_values(table(spark, d, "intensity"), "col", "value", ["row_name", "col"], keep=["run_day"])


CELLS_SQL = "cells AS (SELECT row_name, col, min(run_day) AS run_day, min(value) AS value FROM intensity WHERE col IS NOT NULL AND value > 0 AND isfinite(value) GROUP BY 1, 2)"


@R.add("p2_found", f"WITH {CELLS_SQL} SELECT col FROM cells GROUP BY col HAVING quantile_cont(value, 0.9) >= 5 * quantile_cont(value, 0.5)")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    q = Q.exact_percentiles(intensity_values(spark, d), "col", "value", [0.5, 0.9])
    two = q.groupBy("col").agg(F.max(F.when(F.col("prob") == 0.5, F.col("percentile"))).alias("p50"), F.max(F.when(F.col("prob") == 0.9, F.col("percentile"))).alias("p90"))
    return two.filter(F.col("p90") >= 5 * F.col("p50")).select("col")


PROBS = [0.01, 0.25, 0.5, 0.75, 0.9, 0.99]


@R.add("p2_percentiles", f"""
WITH {CELLS_SQL}, p AS (SELECT unnest([{", ".join(map(str, PROBS))}])::double AS prob),
s AS (SELECT col, value, row_number() OVER (PARTITION BY col ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY col) AS n FROM cells)
SELECT col, prob, n, round(max(CASE WHEN k = floor(prob * (n - 1)) THEN value END) + (max(CASE WHEN k = ceil(prob * (n - 1)) THEN value END) - max(CASE WHEN k = floor(prob * (n - 1)) THEN value END)) * (max(prob * (n - 1)) - floor(max(prob * (n - 1)))), 6) AS percentile
FROM s CROSS JOIN p GROUP BY col, prob, n
""")
def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return Q.exact_percentiles(intensity_values(spark, d), "col", "value", PROBS).withColumn("percentile", F.round("percentile", 6))


@R.add("p2_merged_summaries", f"""
WITH {CELLS_SQL}, s AS (SELECT col, run_day, CAST(ceil(ln(value) / ln(1.01 / 0.99)) AS BIGINT) AS bucket, count(*) AS n FROM cells GROUP BY 1, 2, 3), b AS (SELECT col, bucket, sum(n) AS n FROM s GROUP BY 1, 2),
c AS (SELECT col, bucket, sum(n) OVER (PARTITION BY col ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY col) AS total FROM b), p AS (SELECT unnest([{", ".join(map(str, PROBS))}])::double AS prob)
SELECT col, prob, CAST(max(total) AS BIGINT) AS n, round(pow(1.01 / 0.99, min(bucket)) * (2 / (1 + 1.01 / 0.99)), 6) AS percentile FROM c, p WHERE upto > floor(prob * (total - 1)) GROUP BY 1, 2
""")
def p2_merged_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles from summaries made per run_day and put together; each cell belongs to the first day that has it."""
    per_day = Q.summaries(intensity_values(spark, d), ["col", "run_day"], "value")
    return Q.summary_percentiles(per_day, "col", PROBS).withColumn("percentile", F.round("percentile", 6))


# --- p3: clusters ------------------------------------------------------------------------


def expression_clusters(spark: SparkSession, d: str) -> DataFrame:
    return K.cluster_rows(table(spark, d, "expression"), "row_name", "col", "value")


LINKS_SQL = """
WITH RECURSIVE m AS (SELECT row_name, col, log2(1 + max(value)) AS v FROM expression WHERE value IS NOT NULL AND NOT isnan(value) AND value > -1 AND row_name IS NOT NULL AND col IS NOT NULL GROUP BY 1, 2),
varies AS (SELECT row_name FROM m GROUP BY 1 HAVING max(v) > min(v)), w AS (SELECT m.* FROM m JOIN varies USING (row_name)),
p AS (SELECT a.row_name AS x, b.row_name AS y, corr(a.v, b.v) AS r FROM w a JOIN w b ON a.col = b.col AND a.row_name < b.row_name GROUP BY 1, 2),
e AS (SELECT x AS a, y AS b FROM p WHERE r >= 0.9 AND NOT isnan(r) UNION ALL SELECT y, x FROM p WHERE r >= 0.9 AND NOT isnan(r)),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
"""


@R.add("p3_found", LINKS_SQL + "SELECT a AS row_a, b AS row_b FROM reach WHERE a < b")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return K.cluster_pairs(expression_clusters(spark, d))


CLUSTERS_SQL = LINKS_SQL + """,
c AS (SELECT a AS row_name, min(b) AS a FROM (SELECT a, b FROM reach UNION SELECT a, a FROM reach) GROUP BY 1),
u AS (SELECT c.a, m.row_name, m.col, (m.v - avg(m.v) OVER w) / sqrt(sum(m.v * m.v) OVER w - count(*) OVER w * pow(avg(m.v) OVER w, 2)) AS u FROM m JOIN c USING (row_name) WINDOW w AS (PARTITION BY m.row_name)),
g AS (SELECT a, col, avg(u) AS g FROM u GROUP BY 1, 2),
f AS (SELECT a, row_name, round(sum(u.u * g.g), 9) AS fit FROM u JOIN g USING (a, col) GROUP BY 1, 2),
t AS (SELECT a, list(row_name ORDER BY fit DESC, row_name)[1:3] AS typical, count(*) AS size, first(row_name ORDER BY fit DESC, row_name) AS medoid FROM f GROUP BY 1)
"""


@R.add("p3_clusters", CLUSTERS_SQL + "SELECT medoid, size, typical FROM t")
def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    return K.describe_clusters(stage(expression_clusters(spark, d), "clusters")).select("medoid", "size", "typical")


@R.add("p3_members", CLUSTERS_SQL + "SELECT c.row_name, t.medoid, t.size FROM c JOIN t USING (a)")
def p3_members(spark: SparkSession, d: str) -> DataFrame:
    """Every row of a cluster with the cluster's medoid and size."""
    m = stage(expression_clusters(spark, d), "clusters")
    named = K.describe_clusters(m).select("cluster", "medoid", "size")
    return m.select("cluster", F.col("row").alias("row_name")).join(bounded_broadcast(named), "cluster").select("row_name", "medoid", "size")


# --- p6: containers ----------------------------------------------------------------------


def document_tokens(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return stage(token_counts(table(spark, d, "documents").select("doc_id", *cols, "text")), "tokens")


def packed_documents(spark: SparkSession, d: str) -> DataFrame:
    t = document_tokens(spark, d)
    total = t.agg(F.coalesce(F.sum(F.greatest(F.ceil(F.col("n_tokens") / CAPACITY), F.lit(1))), F.lit(0)).alias("n")).first()["n"]
    return P.pack(t, "doc_id", "n_tokens", CAPACITY, int(total))


@R.add("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return packed_documents(spark, d).filter((F.col("n_pieces") > 1) & (F.col("piece") == 0)).select(F.col("item").alias("doc_id"))


@R.add("p6_containers")
def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Where every document's tokens lie: container, and range of its tokens."""
    p = packed_documents(spark, d)
    return p.select("grp", "container", F.col("item").alias("doc_id"), F.col("offset").alias("first_token"), F.col("size").alias("n_tokens"))


@R.add("p6_fill")
def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return P.fill_report(packed_documents(spark, d), CAPACITY)


# --- p7: mixture -------------------------------------------------------------------------


def source_items(spark: SparkSession, d: str) -> DataFrame:
    t = document_tokens(spark, d, "source", "kind", "lang")
    clean = lambda c: F.coalesce(F.lower(F.trim(c, F.lit(" \t\r\n"))), F.lit(""))
    t = t.filter(F.col("source").isNotNull()).withColumn("leaf", F.concat_ws(SEP, clean("kind"), clean("lang"), clean("source")))
    return t.select("doc_id", "leaf", "n_tokens")


SEP = "\x1f"


def source_leaves(spark: SparkSession, d: str, items: DataFrame) -> tuple[list[M.Leaf], dict[str, str], int]:
    """Leaves (kind, lang, source) of the mixture tree, the spelling of sources, and the tokens of all documents with a source.

    A target without any document is a leaf of size 0.  Targets and leaves are lists of names
    (sources, by the languages and kinds they occur in), whatever the number of documents.
    """
    targets = {r["source"].strip(" \t\r\n").lower(): r for r in table(spark, d, "mix_targets").filter(F.col("source").isNotNull()).toLocalIterator()}
    sizes = items.groupBy("leaf").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"))
    total, by = 0, {k: [] for k in targets}
    for r in sizes.toLocalIterator():
        total += r["n"]
        path = tuple(r["leaf"].split(SEP))
        if path[-1] in by:
            by[path[-1]].append((path, r["n"]))
    leaves = []
    for k, r in targets.items():
        parts = sorted(by[k]) or [(("", "", k), 0)]
        whole = sum(n for _, n in parts)
        leaves += [M.Leaf(p, (r["target_share"] or 0.0) * (n / whole if whole else 1 / len(parts)), n, r["max_passes"] or 0) for p, n in parts]
    return leaves, {k: r["source"] for k, r in targets.items()}, total


@R.add("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources short of their target, from the shortages the budgeting records; cases within its rounding are decided by the two products."""
    items = source_items(spark, d)
    leaves, spelled, total = source_leaves(spark, d, items)
    M.budgets(leaves, float(total))
    short = M.source_shortage(leaves)
    near = [k for k, s in short.items() if s > -1e-9 * total]
    limits = {k: (r["target_share"] or 0.0, r["max_passes"] or 0) for r in table(spark, d, "mix_targets").filter(F.col("source").isNotNull()).toLocalIterator() for k in [r["source"].strip(" \t\r\n").lower()]}
    size = {k: sum(x.size for x in leaves if x.path[-1] == k) for k in near}
    return spark.createDataFrame([(spelled[k],) for k in near if limits[k][1] * size[k] < limits[k][0] * total], "source string")


def mixture(spark: SparkSession, d: str) -> tuple[DataFrame, list[M.Leaf], dict[str, str]]:
    items = source_items(spark, d)
    leaves, spelled, total = source_leaves(spark, d, items)
    M.budgets(leaves, float(total))
    b = spark.createDataFrame([(SEP.join(x.path), x.size, x.budget) for x in leaves if x.budget > 0], "leaf string, leaf_size long, budget double")
    m = M.select(items.withColumnRenamed("n_tokens", "size"), b, "doc_id")
    return m.withColumn("source", F.substring_index("leaf", SEP, -1)), leaves, spelled


@R.add("p7_mixture")
def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The records of the mixture, each with the pass that takes it."""
    m, _, spelled = mixture(spark, d)
    names = spark.createDataFrame(list(spelled.items()), "source string, name string")
    return m.join(F.broadcast(names), "source").select(F.col("name").alias("source"), F.col("item").alias("doc_id"), "pass", F.col("size").alias("n_tokens"))


@R.add("p7_shares")
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source."""
    m, leaves, spelled = mixture(spark, d)
    got = m.groupBy("source").agg(F.sum("size").alias("tokens"), F.max("pass").alias("passes"))
    share = {k: sum(x.share for x in leaves if x.path[-1] == k) for k in spelled}
    names = spark.createDataFrame([(k, v, float(share[k])) for k, v in spelled.items()], "source string, name string, target_share double")
    j = names.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    all_tokens = got.agg(F.sum("tokens").alias("_all"))
    out = j.join(F.broadcast(all_tokens)).select(F.col("name").alias("source"), "target_share", "tokens", F.coalesce("passes", F.lit(0)).alias("passes"), F.try_divide("tokens", "_all").alias("reached_share"))
    return out


# --- p8: one form for equal looks --------------------------------------------------------


@R.add("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("stored"), "text")
    keys = C.compared(docs).select("doc_id", "stored", F.md5("text").alias("look"))
    pairs = C.same_look_pairs(keys, "doc_id")
    return pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


@R.add("p8_canonical")
def p8_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in its consistent form."""
    return C.canonical(table(spark, d, "documents").select("doc_id", "text"))
