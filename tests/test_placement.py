from collections import Counter

import numpy as np

from strandloom.operators import genes as G
from strandloom.operators import windows as W

FREE = [("c", 0, 5), ("c", 10, 13), ("c", 20, 120), ("c", 200, 207), ("d", 0, 4)]


def test_draws_reach_every_start_alike():
    start, end = (np.array([x[i] for x in FREE[:4]]) for i in (1, 2))
    for span in (0, 1, 3, 4, 6, 7, 8, 100):
        every = [s + i for _, s, e in FREE[:4] for i in range(e - s - span + 1)]
        got, fits = W.draw_starts(start, end, np.full(3 * len(every), span), np.arange(3 * len(every)) - len(every))
        assert fits.all() and Counter(got.tolist()) == Counter(every * 3)
    assert not W.draw_starts(start, end, np.array([101]), np.array([5]))[1].any()


def test_random_placement_loses_none_that_fits(spark):
    rows = [(f"t{i}", "c", [(1000, 1010), (1070, 1000 + 90)]) for i in range(40)] + [("long", "c", [(0, 101)]), ("small", "d", [(7, 11)]), ("big", "d", [(7, 12)]), ("none", "e", [(7, 12)])]
    t = spark.createDataFrame(rows, "name string, chrom string, blocks array<struct<start:long,end:long>>")
    free = spark.createDataFrame(FREE, "chrom string, start_pos long, end_pos long")
    got = {r["name"]: r["blocks"] for r in G.random_placement(t, free, 3).collect()}
    assert len(got) == len(rows) and {n for n, b in got.items() if b is None} == {"long", "big", "none"}
    starts = {got[f"t{i}"][0]["start"] for i in range(40)}
    assert starts <= set(range(20, 31)) and len(starts) > 5
    assert all([b["start"] - got[f"t{i}"][0]["start"] for b in got[f"t{i}"]] == [0, 70] for i in range(40)) and got["small"][0]["start"] == 0


def test_relocate_finds_the_only_free_place(spark):
    df = spark.createDataFrame([(i, "c", 0, 50) for i in range(20)] + [(99, "c", 0, 60)], "id long, chrom string, start_pos long, end_pos long")
    sizes = spark.createDataFrame([("c", 100_000)], "chrom string, length long")
    masks = spark.createDataFrame([("c", 0, 70_000), ("c", 70_050, 100_000), ("c", 100_500, 100_600), ("c", -90, -5)], "chrom string, start_pos long, end_pos long")
    got = {(r["id"], r["permutation"]): (r["start_pos"], r["end_pos"]) for r in W.relocate(df, sizes, "id", 1, rounds=2, masks=masks).collect()}
    assert got == {(i, k): (70_000, 70_050) for i in range(20) for k in (1, 2)} | {(99, k): (None, None) for k in (1, 2)}
