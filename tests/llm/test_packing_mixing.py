import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandloom.llm import mixing as M
from strandloom.llm import packing as P
from strandloom.llm import queries as Q
from strandloom.llm.tokens import encoding, token_counts


def naive_ffd(sizes, cap):
    bins, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        for k, free in enumerate(bins):
            if free >= sizes[i]:
                break
        else:
            k = len(bins)
            bins.append(cap)
        bins[k] -= sizes[i]
        out[i] = k
    return out, len(bins)


def test_first_fit_decreasing_equals_naive():
    rnd = random.Random(1)
    for n in (0, 1, 2, 7, 100):
        s = [rnd.choice([0, 1, 50, 100, rnd.randrange(101)]) for _ in range(n)]
        got, used = P.first_fit_decreasing(s, 100)
        assert (list(got), used) == naive_ffd(s, 100)


def test_pack_whole_items_and_splits(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, 0, 5, 100, 101, 250, rnd.randrange(100)])) for i in range(800)] + [(3, 40), (3, 40)]
    df = spark.createDataFrame(rows, "item long, size long")
    out = P.pack(df, "item", "size", 100, len(rows), group_items=200).collect()
    used = defaultdict(int)
    per = defaultdict(int)
    for r in out:
        used[r["grp"], r["container"]] += r["size"]
        per[r["item"]] += r["size"]
        assert r["size"] == 100 or r["piece"] == r["n_pieces"] - 1
    assert max(used.values()) <= 100
    want = defaultdict(int)
    for i, s in rows:
        if s is not None:
            want[i] += s
    assert {k: v for k, v in per.items()} == dict(want)
    assert {r["item"] for r in out if r["n_pieces"] > 1} == {i for i, s in rows if s and s > 100}
    assert sum(used.values()) / (len(used) * 100) > 0.9
    assert P.pack(df.limit(0), "item", "size", 100, 0).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello  world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "a" * 20_000)], "id int, text string")
    got = {r["id"]: r["n_tokens"] for r in token_counts(df).collect()}
    enc = encoding("/opt/tokenizers")
    assert got[1] == len(enc.encode_ordinary("Hello  world")) and got[2] == 0 and got[3] is None
    assert got[4] > 1 and got[5] == len(enc.encode_ordinary("a" * 20_000))


def leaf(path, share, size, passes):
    return M.Leaf(tuple(path.split("/")), share, size, passes)


def test_budgets_fill_siblings_before_ancestors():
    x = [leaf("qa/en/a", 0.4, 100, 1), leaf("qa/en/b", 0.2, 1000, 1), leaf("qa/fr/c", 0.2, 1000, 1), leaf("web/en/d", 0.2, 1000, 1)]
    assert M.budgets(x, 1000) == 0
    assert [round(l.budget) for l in x] == [100, 500, 200, 200]
    y = [leaf("qa/en/a", 0.5, 100, 1), leaf("qa/en/b", 0.1, 150, 1), leaf("qa/fr/c", 0.2, 300, 1), leaf("web/en/d", 0.2, 1000, 1)]
    assert M.budgets(y, 1000) == 0
    assert [round(l.budget) for l in y] == [100, 150, 300, 450]
    z = [leaf("a/b/c", 0.5, 10, 2), leaf("a/b/d", 0.5, 10, 1)]
    assert M.budgets(z, 100) == pytest.approx(70)
    assert [l.budget for l in z] == [20, 10]
    assert M.budgets([], 10) == 0


def test_shortages_are_recorded():
    x = [leaf("qa/en/a", 0.3, 100, 2), leaf("qa/fr/a", 0.1, 50, 2), leaf("web/en/b", 0.6, 2000, 1)]
    M.budgets(x, 1000)
    assert [l.wanted for l in x] == [300, 100, 600] and [l.short for l in x] == [100, 0, -1400]
    assert M.source_shortage(x) == {"a": 100, "b": -1400}
    assert [round(l.budget) for l in x] == [200, 100, 700]
    big = [leaf(f"d/l/{i}", 0.1, 10**15 + i, 1) for i in range(10)]
    assert M.budgets(big, 1.2e16) == pytest.approx(1.2e16 - sum(l.size for l in big)) and all(l.budget == l.cap for l in big)


@pytest.fixture(scope="module")
def mixed_tables(spark, tmp_path_factory):
    """Documents of one-token texts: exact sizes without a tokenizer."""
    d = str(tmp_path_factory.mktemp("mix"))
    docs = [(i, "hello", k, g, s) for i, (k, g, s) in enumerate([("question", "en", "A")] * 30 + [("answer", "fr", " a ")] * 10 + [("answer", None, "b")] * 50 + [("question", "en", "c")] * 10 + [("question", "en", None)] * 20)]
    spark.createDataFrame(docs, "doc_id long, text string, kind string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    # a: 40 tokens once reach 0.4 exactly; b is short, c is short by one token, d has no document.
    spark.createDataFrame([("a", 0.4, 1), ("B", 0.3, 2), ("c", 0.21, 2), ("d", 0.09, 9)], "source string, target_share double, max_passes int").write.parquet(f"{d}/mix_targets.parquet")
    return d


def test_short_sources(spark, mixed_tables):
    assert sorted(r["source"] for r in Q.p7_found(spark, mixed_tables).collect()) == ["c", "d"]
    shares = {r["source"]: r for r in Q.p7_shares(spark, mixed_tables).collect()}
    assert shares["a"]["tokens"] == 40 and shares["c"]["tokens"] == 20 and shares["c"]["passes"] == 2 and shares["d"]["tokens"] == 0
    assert shares["B"]["tokens"] == 40 and shares["B"]["reached_share"] == 0.4


def test_selection_prefixes(spark):
    rnd = random.Random(3)
    rows = [("a", i, rnd.randrange(1, 20), "x") for i in range(500)] + [("b", 1000 + i, 7, "x") for i in range(30)] + [(None, 9999, 5, "x"), ("a", 8888, None, "x")]
    df = spark.createDataFrame(rows, "leaf string, doc long, size long, pass string")
    total = {k: sum(r[2] for r in rows if r[0] == k and r[2]) for k in "ab"}
    b = spark.createDataFrame([("a", total["a"], 0.3 * total["a"]), ("b", total["b"], 2.5 * total["b"])], "leaf string, leaf_size long, budget double")
    out = M.select(df, b, "doc", seed=5).collect()
    got = defaultdict(int)
    times = defaultdict(int)
    for r in out:
        got[r["leaf"]] += r["size"]
        times[r["leaf"], r["item"]] += 1
    assert 0.3 * total["a"] - 20 < got["a"] <= 0.3 * total["a"]
    assert 2.5 * total["b"] - 7 < got["b"] <= 2.5 * total["b"]
    assert {n for (k, _), n in times.items() if k == "b"} == {2, 3} and {n for (k, _), n in times.items() if k == "a"} == {1}
    assert sorted(map(tuple, M.select(df.repartition(3), b, "doc", seed=5).collect())) == sorted(map(tuple, out))
    assert M.select(df.limit(0), b, "doc").count() == 0
