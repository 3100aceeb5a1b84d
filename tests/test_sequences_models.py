import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import align as AL
from strandloom.functions import hmm as H
from strandloom.functions import phylo as P
from strandloom.functions import sequence as Q
from strandloom.operators import motif as MO


def col(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(expr.alias("r")).first()["r"]


def brute_align(a, b, match, mismatch, go, ge, local):
    from functools import lru_cache

    @lru_cache(None)
    def best(i, j, state):
        opts = [0.0] if local and state == "h" else []
        if i == 0 and j == 0:
            return 0.0 if state == "h" else -1e9
        if state == "h":
            if i and j:
                opts.append(best(i - 1, j - 1, "h") + (match if a[i - 1] == b[j - 1] else mismatch))
            opts += [best(i, j, s) for s in ("v", "g")]
            return max(opts)
        di, dj = (1, 0) if state == "v" else (0, 1)
        if i < di or j < dj:
            return -1e9
        return max(best(i - di, j - dj, "h") - go, best(i - di, j - dj, state) - ge)

    cells = [(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1)] if local else [(len(a), len(b))]
    return max(best(i, j, "h") for i, j in cells)


@pytest.mark.parametrize("local", [True, False])
def test_alignment_scores(local):
    rnd = random.Random(7)
    for _ in range(60):
        a, b = ("".join(rnd.choice("ACG") for _ in range(rnd.randrange(0, 8))) for _ in range(2))
        r = AL.align(a, b, 2, -1, 3, 1, local)
        assert r[0] == pytest.approx(brute_align(a, b, 2, -1, 3, 1, local)), (a, b)
        ra, rb = r[5], r[6]
        assert len(ra) == len(rb) and ra.replace("-", "") == a[r[1] : r[2]] and rb.replace("-", "") == b[r[3] : r[4]]


def test_hmm_against_enumeration():
    m = H.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.5, 0.4, 0.1], [0.1, 0.3, 0.6]]))
    obs = [0, 2, 1, 2, 0, 0]
    like = m.likelihoods(obs)

    def p(path):
        x = m.start[path[0]] * like[0][path[0]]
        for t in range(1, len(obs)):
            x *= m.transition[path[t - 1], path[t]] * like[t][path[t]]
        return x

    paths = list(itertools.product(range(2), repeat=len(obs)))
    assert tuple(H.viterbi(m.start, m.transition, like)) == max(paths, key=p)
    post, ll = H.posterior(m.start, m.transition, like)
    total = sum(map(p, paths))
    assert np.exp(ll) == pytest.approx(total)
    assert post[2, 1] == pytest.approx(sum(p(x) for x in paths if x[2] == 1) / total)
    assert len(H.viterbi(m.start, m.transition, like[:0])) == 0


def test_tree_likelihood_against_sum():
    pi = np.array([0.3, 0.2, 0.2, 0.3])
    e = P.Evolution(P.parse_newick("((a:0.1,b:0.2):0.05,c:0.3);"), P.hky(2.0, pi), pi)
    t = e.transition
    col = {"a": "A", "b": "G", "c": "A"}
    want = sum(pi[r] * t(0.05)[r, x] * t(0.1)[x, 0] * t(0.2)[x, 2] * t(0.3)[r, 0] for r in range(4) for x in range(4))
    assert e.likelihood(col) == pytest.approx(want)
    assert e.likelihood({"a": "-", "b": "N"}) == pytest.approx(1.0)
    omega, lod = e.fit_omega([{"a": "A", "b": "A", "c": "A"}] * 30)
    assert omega < 0.01 and lod > 0
    out = e.evolve("ACGT" * 50, 1)
    assert set(out) == {"a", "b", "c"} and len(out["a"]) == 200
    assert e.fill_gaps({"a": "A", "b": "A", "c": "-"})["c"] == "A"


def test_motif_scan_is_the_same_over_chunks(spark, monkeypatch):
    rnd = random.Random(8)
    s = "".join(rnd.choice("ACGTN") for _ in range(600))
    m, short = MO.normalised(np.array([[8, 1, 1, 1], [1, 8, 1, 1], [1, 1, 8, 1]]) * 1.0), MO.normalised(np.array([[8, 1, 1, 1], [1, 1, 1, 8]]) * 1.0)
    df = spark.createDataFrame([(1, s), (2, None), (3, "")], "id long, bases string")
    want = sorted(map(tuple, MO.scan(df, [("x", m), ("y", short)], 1.0).collect()))
    monkeypatch.setattr(MO, "CHUNK", 50)
    assert sorted(map(tuple, MO.scan(df, [("x", m), ("y", short)], 1.0).collect())) == want
    assert want


def test_sequence_functions(spark):
    s = F.col("s")
    assert col(spark, Q.reverse_complement(s), "AACGt") == "aCGTT"
    assert col(spark, Q.gc_fraction(s), "") is None
    assert [tuple(r) for r in col(spark, Q.ungapped_runs(s), "--AC-G--")] == [(2, 4), (5, 6)]
    assert [r["bases"] for r in col(spark, Q.chunks(s, 4, 1), "ABCDEFGH")] == ["ABCD", "DEFG", "GH"]
    assert col(spark, Q.kmers(s, 3), "AB") == []
    assert col(spark, Q.flowgram(s, "TACG"), "TTAGG") == [2, 1, 0, 2]
    assert [tuple(r) for r in col(spark, Q.orfs(s), "CATGAAATAGATGCTAA")] == [(1, 10, 1)]
    assert col(spark, Q.digest(s, "GATC", 1), "AAGATCTTGATC") == ["AAG", "ATCTTG", "ATC"]
    assert col(spark, Q.motif_starts(s, "AR"), "AAGA") == [0, 1]
    assert col(spark, Q.hamming(s, F.lit("ab"), True), "AC") == 1
    assert col(spark, Q.hamming(s, F.lit("abc")), "AC") is None
    assert sorted(col(spark, Q.shuffled(s, F.lit(1), 2), "AACGT")) == list("AACGT")


def test_longest_frames_match_all_frames(spark):
    rnd = random.Random(8)
    seqs = ["".join(rnd.choice("ATGATGAC") for _ in range(rnd.randrange(0, 90))) for _ in range(300)] + [None, "", "ATG", "ATGTAA", "augUAAé", "TTATGéTAA", "ATGTAACATGTAA"]
    rows = spark.createDataFrame(list(enumerate(seqs)), "id long, s string").repartition(3)
    got = {r["id"]: r["o"] for r in rows.select("id", Q.longest_orf(F.col("s")).alias("o")).collect()}
    for i, s in enumerate(seqs):
        want = min(((a - b, a, b) for a, b, _ in Q.find_orfs(s)), default=None) if s else None
        assert (tuple(got[i]) if got[i] else None) == (want[1:] if want else None), s
    assert rows.limit(0).select(Q.longest_orf(F.col("s"))).count() == 0
