import random
from collections import defaultdict

from strandloom.operators import assembly as A


def all_paths(edges, n, sinks):
    """(weight, nodes) of every path from ``n`` to a sink, by plain recursion."""
    if n in sinks:
        yield 0.0, [n]
    for t, w in edges.get(n, ()):
        for c, p in all_paths(edges, t, sinks):
            yield w + c, [n, *p]


def test_k_paths_of_every_source_sink_pair():
    rng = random.Random(4)
    for _ in range(20):
        edges = defaultdict(list)
        for a in range(12):
            for b in range(a + 1, 12):
                if rng.random() < 0.35 and a not in (9, 10, 11) and b not in (0, 1):
                    edges[a].append((b, float(rng.randrange(4))))
        targets = {t for e in edges.values() for t, _ in e}
        sources, sinks = [n for n in range(12) if n not in targets], {n for n in range(12) if not edges.get(n)}
        want = []
        for s in sources:
            by = defaultdict(list)
            for w, p in all_paths(edges, s, sinks):
                by[p[-1]].append((w, p))
            want += [p for found in by.values() for p in sorted(found, key=lambda x: (-x[0], x[1]))[:3]]
        assert A.k_paths(edges, sources, sinks, 3) == sorted(want, key=lambda x: (-x[0], x[1]))


def test_k_paths_visits_only_what_a_source_reaches():
    class Asked(set):
        times = 0

        def __contains__(self, n):
            self.times += 1
            return super().__contains__(n)

    # A locus of the check tables: many pieces under one long junction, few of them with edges.
    n = 2000
    edges = {3 * i: [(3 * i + 1, 2.0)] for i in range(n)}
    sinks = Asked(x for i in range(n) for x in (3 * i + 1, 3 * i + 2))
    sources = sorted(x for i in range(n) for x in (3 * i, 3 * i + 2))
    got = A.k_paths(edges, sources, sinks, 20)
    assert got == [(2.0, [3 * i, 3 * i + 1]) for i in range(n)] + [(0.0, [3 * i + 2]) for i in range(n)]
    assert sinks.times <= 4 * n


def test_hot_locus_keeps_the_paths_of_weak_pairs(spark):
    # Sources 0 and 10 lead to a hub, the hub to sinks 300 and 400; 10 and 400 have fewer reads.
    v = [(0, 5), (10, 15), (100, 105), (300, 305), (400, 405)] + [(200 + 2 * i, 201 + 2 * i) for i in range(4)]
    e = [(0, 100, 50), (10, 100, 1)] + [(100, 200 + 2 * i, 9) for i in range(4)] + [(200 + 2 * i, t, n) for i in range(4) for t, n in ((300, 30), (400, 1))]
    vertices = spark.createDataFrame([("c", *x) for x in v], "chrom string, start_pos long, end_pos long")
    edges = spark.createDataFrame([("c", *x) for x in e], "chrom string, from_start long, to_start long, reads long")
    got = defaultdict(int)
    for r in A.transcripts(vertices, edges, 3).collect():
        got[r["blocks"][0]["start"], r["blocks"][-1]["start"]] += 1
    assert got == {(0, 300): 3, (0, 400): 3, (10, 300): 3, (10, 400): 3}


def test_pieces_apart_from_junctions(spark):
    # One locus of an edge over a piece without edges, and a piece apart from it.
    vertices = spark.createDataFrame([("c", *x) for x in [(0, 5), (7, 9), (20, 30), (40, 50)]], "chrom string, start_pos long, end_pos long")
    edges = spark.createDataFrame([("c", 0, 20, 4)], "chrom string, from_start long, to_start long, reads long")
    locus = {(0, 0, 4.0, ((0, 5), (20, 30))), (0, 1, 0.0, ((7, 9),))}
    for single, apart in ((True, {(40, 0, 0.0, ((40, 50),))}), (False, set())):
        got = {(r["locus"], r["path"], r["weight"], tuple((b["start"], b["end"]) for b in r["blocks"])) for r in A.transcripts(vertices, edges, 3, single).collect()}
        assert got == locus | apart


def test_pieces_leave_when_no_later_edge_reaches_them():
    rng = random.Random(6)
    for _ in range(50):
        edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(30)})
        root = list(range(60))
        for a, b in edges:
            root = [root[a] if r == root[b] else r for r in root]
        want = sorted(sorted(e for e in edges if root[e[0]] == r) for r in {root[a] for a, _ in edges})
        pieces, got = A._Pieces(), []
        for a, b in edges:
            got += [(a, p) for p in pieces.before(a)]
            pieces.add(a, a + 1, b, b + 1, 1.0)
        got += [(61, p) for p in pieces.before(61)]
        assert all(max(p.end) < at for at, p in got)
        assert sorted(sorted((a, b) for a, x in p.after.items() for b, _ in x) for _, p in got) == want
        assert not pieces.of and not pieces.open

    # One long junction holds a locus together, but only itself and the piece at hand are held.
    pieces, most, out = A._Pieces(), 0, 0
    pieces.add(0, 1, 10**6, 10**6 + 1, 1.0)
    for i in range(1, 5000):
        out += len(list(pieces.before(10 * i)))
        pieces.add(10 * i, 10 * i + 1, 10 * i + 5, 10 * i + 6, 2.0)
        most = max(most, len(pieces.of), len(pieces.open))
    assert most == 4 and out == 4998


def test_paths_of_a_locus_are_numbered_heaviest_first(spark):
    # Chromosome c: one locus of three pieces and a vertex without edges; d: another locus.
    vertices = spark.createDataFrame([("c", *x) for x in [(0, 5), (5, 8), (10, 12), (20, 24), (30, 35), (40, 44), (50, 51), (90, 99)]] + [("d", 0, 5), ("d", 9, 12)], "chrom string, start_pos long, end_pos long")
    edges = spark.createDataFrame([("c", 0, 5, None), ("c", 5, 90, 7), ("c", 0, 90, 2), ("c", 10, 40, 3), ("c", 20, 30, 9), ("d", 0, 9, 1)], "chrom string, from_start long, to_start long, reads long")
    paths = [(9.0, ((20, 24), (30, 35))), (7.0, ((0, 8), (90, 99))), (3.0, ((10, 12), (40, 44))), (2.0, ((0, 5), (90, 99))), (0.0, ((50, 51),))]
    for least in (1, 2):
        got = sorted((r["chrom"], r["locus"], r["path"], r["weight"], tuple((b["start"], b["end"]) for b in r["blocks"])) for r in A.transcripts(vertices, edges, 3, False, least).collect())
        assert got == [("c", 0, i, *p) for i, p in enumerate(paths) if len(p[1]) >= least] + [("d", 0, 0, 1.0, ((0, 5), (9, 12)))]
