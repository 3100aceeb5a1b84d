import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from strandloom.llm import canonical as C


@pytest.mark.parametrize("a,b", [
    ("Ａｂ１，", "Ab1,"), ("é", "é"), ("a​b­c﻿", "abc"), ("a b c　d", "a b c d"), ("сор", "cop"), ("10 µm", "10 μm"), ("Ω", "Ω"), ("ΑΒΕ", "ABE"), ("ё", "ë"),
    ("e͏́", "é"), ("각", "각"), ("Å", "Å"), ("ï", "ї"), ("a\tb", "a b"), ("ガ", "ガ"),
])
def test_same_look(a, b):
    assert C.look(a) == C.look(b)


@pytest.mark.parametrize("a,b", [("A", "a"), ("e", "é"), ("2", "²"), ("1", "①"), ("½", "1/2"), ("-", "—"), ("a  b", "a b"), ("O", "0"), ("l", "I"), ("ab", "a b"), ("a\nb", "a b"), ("x₂", "x2"), ("ﬁ", "fi")])
def test_other_look(a, b):
    assert C.look(a) != C.look(b)


def test_repair_by_dominant_script():
    assert C.repair("pаper") == "paper" and C.repair("рaботa") == "работа"
    assert C.repair("paper") is None and C.repair("работа") is None
    assert C.repair("жay") is None  # a letter without a Latin look-alike stays of another script
    assert C.repair("cafе́") == "café"


def test_canonical_uses_corpus_words(spark):
    rows = [(1, "the pаper here", "x"), (2, "a paper", "x"), (3, "unknоwnword", "x"), (4, None, "x"), (5, "", "x"), (6, "ｆｕｌｌ é​", "x"), (7, "the pаper here", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = {r["doc_id"]: r["text"] for r in C.canonical(df).collect()}
    assert got == {1: "the paper here", 2: "a paper", 3: "unknоwnword", 4: None, 5: "", 6: "full é", 7: "the paper here"}
    assert C.canonical(df).columns == df.columns
    assert C.canonical(df.limit(0)).count() == 0


def test_canonical_keeps_the_look():
    for t in ("pаper Ｘ é", "10 µm ёлка", "ΑΒΓ test"):
        assert C.look(C.plain(t)) == C.look(t)
        assert unicodedata.is_normalized("NFC", C.plain(t))


def keys(df):
    return C.compared(df).select("doc_id", "stored", F.md5("text").alias("look"))


def all_pairs(rows):
    return sorted((i, j) for i, a in rows for j, b in rows if i < j and a is not None and b is not None and a != b and C.look(a) == C.look(b))


def test_pairs_match_brute_force(spark):
    texts = ["cop x", "сор x", "cop x", "COP x", "cop x", None, "", "", "\u200b", "other", "ｏther", "ｏther", "работа", "paбoтa", "рaботa", "знак жжa", "знак жжа", "Đоm", "Ðom", "Ɖom"]
    texts += ["e\u0301tude", "étude", "р\u0301q", "p\u0301q", "10 µm", "10 μm", "10 μм", "λό", "λo\u0301", "ファイルу8", "ファイルy8"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("stored", F.md5("text"))
    assert sorted(map(tuple, C.same_look_pairs(keys(df), "doc_id").collect())) == all_pairs(rows)


def test_pairs_of_made_spellings_match_brute_force(spark):
    """Words in random spellings of each letter's look group, with and without a plain spelling in the corpus."""
    rnd = random.Random(4)
    groups = {g.split()[0]: g.split() for g in C.LOOK_ALIKES.strip().split("\n")}
    words = ["".join(rnd.choice([*groups, "b", "б", "λ", "ж", "k", "字", "ル"]) for _ in range(rnd.randrange(1, 5))) for _ in range(40)]
    texts = [" ".join("".join(rnd.choice(groups.get(c, [c])) for c in w) for w in rnd.choices(words, k=rnd.randrange(1, 3))) for _ in range(400)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("stored", F.md5("text"))
    want = all_pairs(rows)
    assert sorted(map(tuple, C.same_look_pairs(keys(df), "doc_id").collect())) == want and len(want) > 100


def test_copies_meet_only_their_partners(spark):
    rows = [(i, "same text") for i in range(300)] + [(1000, "same\u00a0text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("stored", F.md5("text"))
    assert C.same_look_pairs(keys(df), "doc_id").count() == 300


def test_very_long_text():
    t = "аb " * 200_000
    assert len(C.look(t)) == len(t) and C.plain(t) == t
