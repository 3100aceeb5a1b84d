"""Conservation, enrichment and pile-up operators against direct evaluation on small inputs."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandloom.functions import hmm as H
from strandloom.functions import phylo as PH
from strandloom.operators import conservation as CO
from strandloom.operators import genes as G
from strandloom.operators import peaks as P
from strandloom.operators.ordered import exact_quantile

MODEL = CO.Neutral("((a:0.1,b:0.2):0.05,c:0.3);", 2.5, (0.3, 0.2, 0.2, 0.3))
MSA = "block_id string, score double, species string, chrom string, start long, size long, strand string, src_size long, text string, pattern string"


@pytest.fixture(scope="module")
def blocks():
    rnd = random.Random(1)
    out = []
    for k in range(6):
        n = rnd.randrange(15, 40)
        for s in ("a", "b", "c", "other"):
            if s == "c" and k == 2:
                continue  # a species that is absent from a block
            text = "".join(rnd.choice("ACGT-") if rnd.random() < 0.4 else "A" for _ in range(n))
            out.append((f"b{k}", 0.0, s, "x" if k < 4 else "y", 1000 * k, n, "+", 0, text, "clash"))
    return out


@pytest.fixture(scope="module")
def site_rows(spark, blocks):
    want = {}
    by = defaultdict(dict)
    for b in blocks:
        by[b[0], b[3], b[4]][b[2]] = b[8]
    for (k, c, s), t in by.items():
        at = 0
        for i, ref in enumerate(t["a"]):
            if ref != "-":
                want[k, at] = (c, s + at, "".join(t[x][i] if x in t else "-" for x in "abc"))
                at += 1
    return want


@pytest.fixture(scope="module")
def sites(spark, blocks):
    from strandloom.session import stage

    return stage(CO.sites(spark.createDataFrame(blocks, MSA), "a", MODEL), "sites")


def test_sites(sites, site_rows):
    got = {(r["block_id"], r["column"]): (r["chrom"], r["start_pos"], r["pattern"]) for r in sites.collect()}
    assert got == site_rows


def test_site_fits(sites, site_rows):
    e = MODEL.evolution()
    for r in CO.site_rates(sites, MODEL).collect():
        c = MODEL.column(site_rows[r["block_id"], r["column"]][2])
        omega, lod = e.fit_omega([c])
        assert (r["omega"], r["lod"]) == pytest.approx((omega, lod)) and r["log_likelihood"] == pytest.approx(math.log(e.likelihood(c)))
        assert r["tree_length"] == pytest.approx(omega * 0.65)
    for r in CO.site_biases(sites, MODEL).limit(20).collect():
        pi, lod = e.fit_pi(MODEL.column(r["pattern"]))
        assert [r["pi_a"], r["pi_c"], r["pi_g"], r["pi_t"], r["bias_lod"]] == pytest.approx([*pi, lod])
    for r in CO.filled(sites, MODEL).collect():
        assert "-" not in r["filled"] and all(x in ("-", y) for x, y in zip(r["pattern"], r["filled"]))


def test_region_and_window_fits(spark, sites, site_rows):
    e = MODEL.evolution()
    regions = [("r1", "x", 0, 1010), ("r2", "x", 1005, 3000), ("r3", "y", 4000, 4009), ("r4", "z", 0, 9), ("r5", None, 0, 9)]
    df = spark.createDataFrame(regions, "name string, chrom string, start_pos long, end_pos long")
    got = {r["name"]: r for r in CO.region_rates(sites, df, "name", MODEL).collect()}
    cols = {n: [MODEL.column(p) for c, at, p in site_rows.values() if c == k and s <= at < t] for n, k, s, t in regions}
    assert set(got) == {n for n, c in cols.items() if c}
    for n, r in got.items():
        assert r["columns"] == len(cols[n]) and (r["omega"], r["lod"]) == pytest.approx(e.fit_omega(cols[n]), rel=1e-6)
        assert r["log_likelihood"] == pytest.approx(e.log_likelihood(cols[n]))
    mean = {r["name"]: r["mean_length"] for r in CO.mean_branch_length(CO.site_rates(sites, MODEL), df, "name").collect()}
    for n in got:
        assert mean[n] == pytest.approx(np.mean([e.fit_omega([c])[0] for c in cols[n]]) * 0.65)
    win = {(r["chrom"], r["start_pos"]): (r["columns"], r["omega"]) for r in CO.window_rates(sites, MODEL, 10, 5).collect()}
    want = defaultdict(list)
    for c, at, p in site_rows.values():
        for w in range(max(0, (at - 10) // 5 + 1), at // 5 + 1):
            want[c, w * 5].append(MODEL.column(p))
    assert set(win) == set(want)
    for k in list(win)[:8]:
        assert win[k][0] == len(want[k]) and win[k][1] == pytest.approx(e.fit_omega(want[k])[0], rel=1e-6)


def test_conserved_states(sites, site_rows):
    e = MODEL.evolution()
    biased = [e.with_background(np.where(np.arange(4) == b, 0.97, 0.01)) for b in range(4)]
    got = {(r["block_id"], r["column"]): (r["state"], r["posterior"]) for r in CO.conserved_states(sites, MODEL, 8.0, 0.25).collect()}
    assert set(got) == set(site_rows)
    for b in ("b0", "b2", "b5"):
        cols = [MODEL.column(site_rows[k][2]) for k in sorted(site_rows) if k[0] == b]
        like = np.array([[e.likelihood(c), np.mean([x.likelihood(c) for x in biased])] for c in cols])
        step = np.array([[1 - 1 / 24, 1 / 24], [1 / 8, 7 / 8]])
        post, _ = H.posterior(np.array([0.75, 0.25]), step, like)
        assert [got[b, i][1] for i in range(len(cols))] == pytest.approx(post[:, 1].tolist())
        assert [got[b, i][0] for i in range(len(cols))] == H.viterbi(np.array([0.75, 0.25]), step, like).tolist()


def test_motifs_and_evolution(spark, blocks, sites):
    m = np.array([[0.97, 0.01, 0.01, 0.01]] * 4)
    rates = CO.site_rates(sites, MODEL)
    fit = {(r["block_id"], r["column"]): r["lod"] for r in rates.collect()}
    got = CO.conserved_motifs(spark.createDataFrame(blocks, MSA), "a", [("aaaa", m)], 4.0, rates).collect()
    ref = {b[0]: b[8].replace("-", "") for b in blocks if b[2] == "a"}
    want = {(k, i) for k, t in ref.items() for i in range(len(t) - 3) if t[i : i + 4] in ("AAAA", "TTTT")}
    assert {(r["block_id"], r["start"]) for r in got} == want and want
    for r in got:
        assert r["mean_lod"] == pytest.approx(np.mean([fit[r["block_id"], i] for i in range(r["start"], r["end"])]))
    seqs = spark.createDataFrame([(1, "ACGTN" * 4), (2, ""), (3, None)], "id long, bases string")
    out = sorted(map(tuple, CO.evolved(seqs, MODEL, 5).collect()))
    assert [(i, s, len(t)) for i, s, t in out] == [(1, s, 20) for s in "abc"] + [(2, s, 0) for s in "abc"]
    assert out == sorted(map(tuple, CO.evolved(seqs.repartition(3), MODEL, 5).collect()))


def test_empty_alignment(spark):
    none = spark.createDataFrame([], MSA)
    s = CO.sites(none, "a", MODEL)
    for out in (CO.site_rates(s, MODEL), CO.site_biases(s, MODEL), CO.window_rates(s, MODEL, 10, 5), CO.conserved_states(s, MODEL, 8.0, 0.2)):
        assert out.count() == 0


def test_weights_repeat_columns():
    e, cols = MODEL.evolution(), [{"a": "A", "b": "A", "c": "G"}, {"a": "C", "b": "C", "c": "C"}]
    assert e.fit_omega(cols, weights=np.array([3.0, 2.0])) == pytest.approx(e.fit_omega([cols[0]] * 3 + [cols[1]] * 2))
    assert PH.parse_newick(MODEL.tree).total() == pytest.approx(0.65)


def test_end_pileup(spark):
    rnd = random.Random(3)
    reads = [(i, rnd.choice(["x", "x", None]), s := rnd.choice([50, 50, rnd.randrange(100)]), s + rnd.choice([0, 7, 9]), rnd.choice(["+", "-", None])) for i in range(200)]
    regions = [("r", "x", 10, 90), ("s", "x", 40, 60), ("t", "y", 0, 9)]
    got = P.end_pileup(spark.createDataFrame(reads, "rec_id long, chrom string, start_pos long, end_pos long, strand string"), spark.createDataFrame(regions, "name string, chrom string, start_pos long, end_pos long"), "name", 9, 1).collect()
    want = Counter()
    for _, c, s, e, st in reads:
        if c and e > s:
            at = e - 1 if st == "-" else s
            want.update((n, at) for n, k, a, b in regions if k == c and a <= at < b)
    assert {(r["name"], r["pos"]): r["n"] for r in got} == dict(want)
    assert {r["p"] for r in got if r["pos"] == 50 and r["name"] == "r"} == {0.1} and all(0.1 <= r["p"] <= 1 for r in got)


def test_annotation_enrichment(spark):
    sizes = spark.createDataFrame([("x", 10_000)], "chrom string, length long")
    peaks = [(i, "x", 100 + 3 * i, 102 + 3 * i) for i in range(20)] + [(99, "x", 9000, 9005)]
    sets = [("hit", "x", 90, 170), ("miss", "x", 3000, 3400), (None, "x", 0, 10)]
    iv = "id long, chrom string, start_pos long, end_pos long"
    got = P.annotation_enrichment(spark.createDataFrame(sets, iv.replace("id long", "kind string")), "kind", spark.createDataFrame(peaks, iv), spark.createDataFrame([(0, "x", 0, 2000), (1, "x", 1500, 4000)], iv), sizes, "id", 30, 4)
    r = {x["kind"]: x for x in got.collect()}
    assert set(r) == {"hit", "miss"} and r["hit"]["observed"] == 20 and r["miss"]["observed"] == 0
    assert r["hit"]["p"] == pytest.approx(1 / 31) and r["miss"]["p"] == 1.0 and 0 < r["hit"]["expected"] < 4 and r["hit"]["enrichment"] > 5


def test_intron_samples(spark):
    t = spark.createDataFrame([("t", "x", [(0, 10), (50, 90), (95, 99)]), ("u", "x", [(0, 5)]), ("v", None, None)], "name string, chrom string, blocks array<struct<start:long,end:long>>")
    got = {r["intron"]: (r["start_pos"], r["end_pos"]) for r in G.sample_introns(t, 1).collect()}
    assert set(got) == {0, 1} and got[1] == (90, 95)
    assert got[0][1] - got[0][0] == 10 and 10 <= got[0][0] and got[0][1] <= 50


@pytest.mark.parametrize("prob", [0.0, 0.3, 0.99, 1.0])
def test_exact_quantile(spark, prob):
    rnd = random.Random(2)
    v = [rnd.choice([1.0, rnd.random(), None]) for _ in range(500)]
    got = exact_quantile(spark.createDataFrame([(x,) for x in v], "v double"), "v", prob).first()["value"]
    assert got == pytest.approx(np.quantile([x for x in v if x is not None], prob), rel=1e-12)
    assert exact_quantile(spark.createDataFrame([], "v double"), "v", prob).first()["value"] is None


def test_divergence_of_equal_samples_is_small(spark):
    rnd = random.Random(6)
    mk = lambda n, place: [("x", s := place(), s + 10, 1.0, i) for i in range(n)]
    cols = "chrom string, start_pos long, end_pos long, weight double, rec_id long"
    back = mk(200, lambda: rnd.randrange(90_000))
    a = spark.createDataFrame(back + mk(300, lambda: 42_000 + rnd.randrange(100)), cols)
    b = spark.createDataFrame(mk(200, lambda: rnd.randrange(90_000)), cols)
    sizes = spark.createDataFrame([("x", 100_000)], "chrom string, length long")
    got = P.skellam_divergence_peaks(a, b, sizes, 1000, 500, 1e-3).collect()
    assert len(got) == 1 and got[0]["start_pos"] <= 42_000 < got[0]["end_pos"] and got[0]["divergence"] > 0.5


def pileup_by_pairs(ends, regions, rounds, seed):
    """{(key, pos): (n, p)} from every pair of an end and a region, with the hashes of SQL."""
    by = {}
    for r in ends.sparkSession.sql(f"SELECT r.k, e.at, pmod(xxhash64({seed}, r.k, e.rec_id, t.i), r.b - r.a) AS place, t.i FROM {{e}} e JOIN {{r}} r ON e.chrom = r.chrom AND r.a <= e.at AND e.at < r.b CROSS JOIN (SELECT explode(sequence(1, {rounds})) AS i) t", e=ends, r=regions).collect():
        at, drawn = by.setdefault(r["k"], (Counter(), {}))
        at[r["at"]] += r["i"] == 1
        drawn.setdefault(r["i"], Counter())[r["place"]] += 1
    return {(k, x): (n, (1 + sum(max(c.values()) >= n for c in drawn.values())) / (rounds + 1)) for k, (at, drawn) in by.items() for x, n in at.items()}


@pytest.mark.parametrize("pairs", [4_000_000, 300])
def test_end_pileup_writes_no_pairs(spark, monkeypatch, pairs):
    rnd = random.Random(5)
    ends = [(i, "x" if i % 5 else "y", rnd.choice([700, 1500, rnd.randrange(-40, 3000), rnd.randrange(40_000)])) for i in range(1500)]
    # Long, short and crowded regions, one over a block's edge, and one key with two regions.
    regions = [(f"k{i}", "x", a := rnd.randrange(-50, 3000), a + rnd.choice([1, 5, 400, 1024, 1025, 20_000])) for i in range(300)] + [("edge", "x", 1020, 1030), ("two", "x", 690, 710), ("two", "y", 0, 2000), (None, "x", 0, 10)]
    monkeypatch.setattr(P, "PILEUP_PAIRS", pairs)
    staged, stage = [], P.stage
    monkeypatch.setattr(P, "stage", lambda df, label="stage": staged.append(s := stage(df, label)) or s)
    e, r = spark.createDataFrame(ends, "rec_id long, chrom string, at long"), spark.createDataFrame(regions, "k string, chrom string, a long, b long")
    reads = e.selectExpr("rec_id", "chrom", "at AS start_pos", "at + 1 AS end_pos", "'+' AS strand")
    got = P.end_pileup(reads, r.selectExpr("k", "chrom", "a AS start_pos", "b AS end_pos"), "k", 7, 3).collect()
    want = pileup_by_pairs(e, r.filter("k IS NOT NULL"), 7, 3)
    assert len(got) == len(want) and {(x["k"], x["pos"]): (x["n"], pytest.approx(x["p"])) for x in got} == want
    # Ends are written at most twice a level of region lengths (three here); all pairs would be over 20,000 rows.
    single = [x for x in staged if x.columns == ["_cell", "_a", "_b"]]
    assert sum(want[k][0] for k in want) > 20_000 and [x.count() <= 6 * len(ends) for x in single] == [True]
