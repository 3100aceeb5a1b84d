"""Bad-row separation against a character-by-character reading of the same rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandloom.operators import rejects

SIZES = {"chr1": 1000, "chr2": 500}


def fields_of(s):
    """Fields of a line, or None where quoting is broken."""
    out, i = [], 0
    while True:
        if i < len(s) and s[i] == '"':
            i, buf = i + 1, ""
            while True:
                if i >= len(s):
                    return None
                if s[i] == '"':
                    if s[i + 1 : i + 2] == '"':
                        buf, i = buf + '"', i + 2
                        continue
                    i += 1
                    break
                buf, i = buf + s[i], i + 1
            if i < len(s) and s[i] != "\t":
                return None
        else:
            j = s.find("\t", i)
            j = len(s) if j < 0 else j
            buf, i = s[i:j], j
            if '"' in buf:
                return None
        out.append(buf)
        if i >= len(s):
            return out
        i += 1


def digits(x):
    return re.fullmatch("[0-9]+", x) is not None


def colour(x):
    return x == "0" or (re.fullmatch("[0-9]+,[0-9]+,[0-9]+", x) is not None and all(int(y) <= 255 for y in x.split(",")))


def value_ok(f, sizes):
    n = len(f)
    if f[0] not in sizes or not (digits(f[1]) and digits(f[2]) and int(f[1]) < int(f[2]) <= sizes[f[0]]):
        return False
    a, b = int(f[1]), int(f[2])
    if n > 3 and not f[3].strip():
        return False
    if n > 4 and not (re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", f[4]) and 0 <= float(f[4]) <= 1000):
        return False
    if n > 5 and f[5] not in "+-*." or n > 5 and len(f[5]) != 1:
        return False
    if n > 8:
        if not (digits(f[6]) and digits(f[7]) and a <= int(f[6]) <= int(f[7]) <= b and colour(f[8])):
            return False
    if n > 11:
        if not digits(f[9]) or int(f[9]) < 1:
            return False
        lists = []
        for x in f[10:12]:
            if not re.fullmatch("[0-9]+(,[0-9]+)*,?", x):
                return False
            lists.append([int(y) for y in x.rstrip(",").split(",")])
        z, s = lists
        if len(z) != int(f[9]) or len(s) != int(f[9]) or min(z) < 1 or s[0] != 0 or s[-1] + z[-1] != b - a:
            return False
        if any(s[i] < s[i - 1] + z[i - 1] for i in range(1, len(z))):
            return False
    return True


def track_reason(s):
    rest = s[re.match(r"\S+", s).end() :]
    if s.count('"') % 2:
        return "quoting"
    bare = re.sub(r'(?<!\S)([^\s"=]+)="([^"]*)"(?!\S)', lambda m: f"\0{m[1]}=" + m[2].replace(" ", "\1").replace("\t", "\2"), rest)
    if '"' in bare or '"' in s[: re.match(r"\S+", s).end()]:
        return "quoting"
    pairs = []
    for w in bare.split():
        w = w.lstrip("\0")
        if w.find("=") < 1:
            return "value"
        k, v = w.split("=", 1)
        pairs.append((k, v))
    d = dict(pairs)
    ok = bool(d.get("name")) and all(v for k, v in pairs if k == "name")
    ok &= all(v in rejects.VISIBILITY for k, v in pairs if k == "visibility")
    ok &= all(v in ("0", "1") for k, v in pairs if k == "useScore") and all(colour(v) for k, v in pairs if k == "color")
    return None if ok else "value"


def brute(line, layout, sizes):
    s = (line or "").strip(" \t\r\n\x0b\x0c")
    if not s or s[0] == "#" or s.split()[0].lower() == "browser":
        return None
    if s.split()[0].lower() == "track":
        return track_reason(s)
    f = fields_of(s)
    if f is None:
        return "quoting"
    if len(f) != layout:
        return "columns"
    return None if value_ok(f, sizes) else "value"


def run(spark, lines, sizes):
    df = spark.createDataFrame([(i, x, n) for i, (x, n) in enumerate(lines)], "line_id long, raw_line string, layout int")
    cs = spark.createDataFrame(list(sizes.items()), "chrom string, length long")
    out = rejects.parse_lines(df, cs).select("line_id", rejects.reason(F.col("errors")).alias("r")).collect()
    return {r["line_id"]: r["r"] for r in out}


def test_mutated_lines_match_brute_force(spark):
    rnd = random.Random(5)
    seeds = [
        ("chr1\t10\t90\tn\t5\t+\t20\t80\t0\t2\t10,20\t0,60", 12), ("chr2\t1\t9\ta b\t1e2\t.", 6), ('chr1\t1\t2\t"x ""y"" z"', 4), ('chr1\t1\t2\t"x\ty"\t.5', 5),
        ("track name=a visibility=full color=1,2,3", 3), ('TRACK name="a b" description="c=d" useScore=1', 3), ("browser position", 3), ("# c", 3), ("chr1\t0\t1000", 3),
        ("chr1\t10\t90\tn\t5\t-\t10\t90\t255,0,0\t1\t80,\t0,", 12),
    ]
    alphabet = ['"', "\t", " ", ",", "0", "9", "=", "-", "a", "１", '""', "\r", "."]
    lines = [(s, n) for s, n in seeds]
    for _ in range(1500):
        s, n = rnd.choice(seeds)
        for _ in range(rnd.randint(1, 3)):
            i = rnd.randrange(len(s) + 1)
            op = rnd.random()
            s = s[:i] + (rnd.choice(alphabet) if op < 0.6 else "") + s[i + (op > 0.3) :]
        lines.append((s, n))
    got = run(spark, lines, SIZES)
    wrong = [(x, got[i], brute(*x, SIZES)) for i, x in enumerate(lines) if got[i] != brute(*x, SIZES)]
    assert not wrong, wrong[:5]
    assert {"quoting", "columns", "value", None} == set(got.values())


def test_stored_table_matches_brute_force(spark, sf):
    lines = spark.read.parquet(f"{sf}/annotation_lines.parquet").select("line_id", "raw_line", "layout")
    cs = spark.read.parquet(f"{sf}/chrom_sizes.parquet")
    sizes = {r["chrom"]: r["length"] for r in cs.collect()}
    got = {r["line_id"]: r["r"] for r in rejects.parse_lines(lines, cs).select("line_id", rejects.reason(F.col("errors")).alias("r")).collect()}
    want = {r["line_id"]: brute(r["raw_line"], r["layout"], sizes) for r in lines.collect()}
    assert got == want


def test_edges(spark):
    long_quotes = "chr1\t1\t2\t" + '"' + '""' * 50_000 + '"'
    lines = [(None, 3), ("", 3), ("chr1\t1\t2", None), (long_quotes, 4), ("x" * 200_000, 3), ("chr1\t1\t" + "9" * 60, 3), ('track name="a" name=""', 3)]
    got = run(spark, lines, SIZES)
    assert got == {0: None, 1: None, 2: "columns", 3: None, 4: "columns", 5: "value", 6: "value"}
    assert run(spark, [], SIZES) == {}


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "chr1\t1\t2", 3, "keep", "old")], "line_id long, raw_line string, layout int, length string, errors string")
    cs = spark.createDataFrame([("chr1", 10), ("chr1", 9), (None, 1)], "chrom string, length long")
    r = rejects.parse_lines(df, cs).collect()
    assert len(r) == 1 and r[0]["length"] == "keep" and r[0]["errors"] == []


@pytest.mark.parametrize("x,ok", [("0", True), ("1,2,3", True), ("1,2,256", False), ("1,2", False), ("", False), ("00,1,2", True)])
def test_colour(spark, x, ok):
    assert spark.createDataFrame([(x,)], "c string").select(rejects.colour_ok(F.col("c")).alias("r")).first()["r"] is ok
