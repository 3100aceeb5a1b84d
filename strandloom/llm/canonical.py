"""One consistent form for texts that look the same but differ in their characters.

``canonical`` works in two steps.  Per text: full- and half-width forms become plain
ones, characters without width or ink are dropped, horizontal blanks become spaces, the
micro sign becomes the Greek letter, and accents are composed (NFC).  Over the corpus: the
dominant script of every token is found, and in tokens that mix Latin, Greek and Cyrillic
the letters of the other scripts are replaced by their look-alikes of the dominant one
when the result is a word of the corpus; if it isn't, the token's other scripts are tried.

``compared`` is for comparison only.  To the canonical form it adds what a repair cannot
settle: words wholly in look-alike letters of one script, words with a letter that has a
twin in its own script, and mixed words without any corpus form.  Where the corpus
spells such a look in several ways, all of them get one representative.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import bounded_broadcast, stage

# Groups of letters drawn alike. The first of a group represents it.
LOOK_ALIKES = """
A Α А
B Β В
C Ϲ С
E Ε Е
H Η Н
I Ι І Ӏ
J Ϳ Ј
K Κ К
M Μ М
N Ν
O Ο О
P Ρ Р
S Ѕ
T Τ Т
V Ѵ
W Ԝ
X Χ Х
Y Υ У Ү
Z Ζ
G Ԍ
Q Ԛ
a а
c ϲ с ᴄ
d ԁ
e е
g ɡ
h һ
i і
j ϳ ј
l ӏ
o ο о ᴏ
p ρ р
q ԛ
s ѕ ꜱ
v ν ѵ ᴠ
w ԝ ᴡ
x х
y у
z ᴢ
μ µ
Γ Г
Π П
Φ Ф
π п ᴨ
κ к ĸ ᴋ
ʙ в
ʜ н
ᴍ м
ᴛ т
ᴦ г
ᴫ л
Æ Ӕ
æ ӕ
Ə Ә
ə ә
Ɵ Ө
ɵ ө
Ʒ Ӡ
ʒ ӡ
Ð Đ Ɖ
"""

# Characters that Unicode lists as ignorable by default, and format characters that do have ink.
IGNORABLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]
INKED = [(0x600, 0x605), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x890, 0x891), (0x8E2, 0x8E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1343F)]
KEPT_CONTROLS = "\t\n\r\x0b\x0c\x85"

SCRIPTS = ("LATIN", "GREEK", "CYRILLIC")


def _inked(c: int) -> bool:
    return any(a <= c <= b for a, b in INKED)


@lru_cache(maxsize=1)
def _plain_table() -> dict[int, int | str | None]:
    """Translation of width forms, blanks and characters without ink."""
    t: dict[int, int | str | None] = {}
    for c in range(0x20000):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat == "Zs" or c == 9:
            t[c] = " "
        elif (cat == "Cf" and not _inked(c)) or (cat == "Cc" and ch not in KEPT_CONTROLS):
            t[c] = None
        elif 0xFF00 < c < 0xFFF0:
            d = unicodedata.decomposition(ch)
            if d.startswith(("<wide>", "<narrow>")):
                t[c] = chr(int(d.split()[1], 16))
    for a, b in IGNORABLE:
        t.update(dict.fromkeys(range(a, b + 1)))
    t[ord("µ")] = "μ"
    return t


@lru_cache(maxsize=1)
def _look_table() -> dict[int, str]:
    return {ord(x): g.split()[0] for g in LOOK_ALIKES.strip().split("\n") for x in g.split()[1:]}


def script_of(ch: str) -> str:
    """LATIN, GREEK or CYRILLIC for a letter of these, else ''."""
    if ch.isascii():
        return "LATIN" if ch.isalpha() else ""
    if not ch.isalpha():
        return ""
    if ch == "µ":
        return "GREEK"
    first = unicodedata.name(ch, "").partition(" ")[0]
    return first if first in SCRIPTS else ""


_script = lru_cache(maxsize=8192)(script_of)


@lru_cache(maxsize=1)
def _to_script() -> dict[str, dict[str, str]]:
    """For each script, its letter for every look-alike of another script."""
    out: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
    for g in LOOK_ALIKES.strip().split("\n"):
        letters = g.split()
        for s in SCRIPTS:
            own = next((x for x in letters if script_of(x) == s and x != "µ"), None)
            if own:
                out[s] |= {x: own for x in letters if x != own and script_of(x) != s}
    return out


def plain(text: str) -> str:
    """Width forms, blanks and inkless characters made plain; accents composed."""
    if text.isascii() and "\t" not in text and text.isprintable():
        return text
    return unicodedata.normalize("NFC", text.translate(_plain_table()))


def look(text: str) -> str:
    """The text with every letter replaced by the representative of the letters drawn like it."""
    if text.isascii() and "\t" not in text and text.isprintable():
        return text
    d = unicodedata.normalize("NFD", text.translate(_plain_table())).translate(_look_table())
    return unicodedata.normalize("NFD", d)


# One definition of a word for Python and the JVM: a letter, then letters and accents.
WORD = r"\p{L}[\p{L}\p{M}]*+"
_WORD = regex.compile(WORD)


def scripts_in(token: str) -> dict[str, int]:
    n: dict[str, int] = {}
    for ch in token:
        if s := _script(ch):
            n[s] = n.get(s, 0) + 1
    return n


def by_dominance(token: str) -> list[str]:
    """The token's scripts, most letters first; of equals in the order Latin, Greek, Cyrillic."""
    n = scripts_in(token)
    return sorted(n, key=lambda s: (-n[s], SCRIPTS.index(s)))


def in_script(token: str, script: str) -> str | None:
    """The token with look-alikes of ``script`` for letters of others, or None where one has none."""
    table = _to_script()[script]
    # Accented letters are judged by their base letter.
    out = unicodedata.normalize("NFC", "".join(table.get(ch, ch) for ch in unicodedata.normalize("NFD", token)))
    return out if len(scripts_in(out)) == 1 else None


def repair(token: str) -> str | None:
    """A mixed-script token in its dominant script, or None where it isn't mixed or letters remain of another."""
    order = by_dominance(token)
    return in_script(token, order[0]) if len(order) > 1 else None


@lru_cache(maxsize=1)
def _look_groups() -> tuple[frozenset[str], frozenset[str]]:
    """Letters with a look-alike, and those with one in their own script."""
    groups = [g.split() for g in LOOK_ALIKES.strip().split("\n")]
    return frozenset(x for g in groups for x in g), frozenset(x for g in groups for x in g if sum(script_of(y) == script_of(x) for y in g) > 1)


def folds(token: str) -> bool:
    """Whether a token of one script may look like another that ``repair`` never leads to."""
    some, twins = _look_groups()
    # Letters of further scripts are their own look only.
    letters = [c for c in unicodedata.normalize("NFD", token) if _script(c)]
    return (all(c in some for c in letters) or any(c in twins for c in letters)) and look(token) != unicodedata.normalize("NFD", token)


_sorted_token = lru_cache(maxsize=65536)(lambda w: 2 if len(scripts_in(w)) > 1 else int(folds(w)))


def odd_tokens(text: str) -> tuple[list[str], list[str]]:
    """Distinct mixed-script tokens of a text, and those of one script for which ``folds`` holds."""
    if text.isascii():
        return [], []
    words = [w for w in dict.fromkeys(_WORD.findall(text)) if not w.isascii()]
    kind = [_sorted_token(w) for w in words]
    return [w for w, k in zip(words, kind) if k == 2], [w for w, k in zip(words, kind) if k == 1]


def _plain_batches(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text)
            texts = [None if t is None else plain(t) for t in b.column(i).to_pylist()]
            odd = [([], []) if t is None else odd_tokens(t) for t in texts]
            cols = [pa.array(texts, pa.string()) if j == i else b.column(j) for j in range(b.num_columns)]
            lists = [pa.array([o[k] for o in odd], pa.list_(pa.string())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*cols, *lists], names=[*b.schema.names, "__mixed", "__odd"])

    return run


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, mixed) to its forms: rank 0, 1, ... in its scripts by dominance for a mixed word, and its look as rank -1."""
    for b in batches:
        out = []
        for w, mixed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            out.append((w, mixed, -1, unicodedata.normalize("NFC", look(w))))
            if mixed:
                out += [(w, mixed, k, f) for k, s in enumerate(by_dominance(w)) if (f := in_script(w, s)) is not None]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.bool_(), pa.int32(), pa.string()))], names=["word", "mixed", "rank", "form"])


def _formed(df: DataFrame, text: str, compare: bool) -> DataFrame:
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema] + [T.StructField(c, T.ArrayType(T.StringType()), True) for c in ("__mixed", "__odd")])
    base = stage(df.mapInArrow(_plain_batches(text), schema), "plain")
    words = base.select(F.explode("__mixed").alias("word"), F.lit(True).alias("mixed"))
    if compare:
        words = words.unionByName(base.select(F.explode("__odd").alias("word"), F.lit(False).alias("mixed")))
    forms = stage(words.distinct().mapInArrow(_versions, "word string, mixed boolean, rank int, form string"), "forms")
    # Words of the corpus, joined to the wanted ones before anything is shuffled.
    wanted = bounded_broadcast(forms.select("form").distinct())
    said = base.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1))).alias("form"))
    known = stage(said.join(wanted, "form", "left_semi").distinct(), "known")
    settled = forms.join(bounded_broadcast(known), "form", "left_semi").filter("mixed AND rank >= 0")
    repairs = settled.groupBy("word").agg(F.min_by("form", "rank").alias("fixed"))
    if compare:
        repairs = stage(repairs, "repairs")
        # Spellings of one look that no repair settles; a look that the corpus spells itself counts as one.
        looks = forms.filter("rank = -1").select("word", F.col("form").alias("look"))
        left = looks.join(bounded_broadcast(settled.select("word").distinct()), "word", "left_anti")
        self_said = looks.select("look").distinct().join(known.withColumnRenamed("form", "look"), "look", "left_semi").select(F.col("look").alias("word"), "look")
        spelt = stage(left.unionByName(self_said).distinct(), "spelt")
        several = spelt.groupBy("look").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select("look")
        folded = stage(spelt.join(several, "look").filter(F.col("word") != F.col("look")), "folded")
        after = repairs.join(folded.select(F.col("word").alias("fixed"), "look"), "fixed", "left").select("word", F.coalesce("look", "fixed").alias("fixed"))
        repairs = after.unionByName(folded.select("word", F.col("look").alias("fixed")))
    repairs = bounded_broadcast(repairs)
    listed = F.concat("__mixed", "__odd") if compare else F.col("__mixed")
    n = F.coalesce(F.size(listed), F.lit(0))
    # Only rows with such words are touched.
    touched = stage(base.filter(n > 0).withColumn("__row", F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id())), "mixed")
    clean = base.filter(n <= 0).select(*df.columns)
    maps = touched.select("__row", F.explode(listed).alias("word")).join(repairs, "word").groupBy("__row").agg(F.collect_list(F.struct("word", "fixed")).alias("__fix"))
    out_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text)
            fixes = b.column(b.num_columns - 1).to_pylist()
            texts = []
            for t, f in zip(b.column(i).to_pylist(), fixes):
                m = {x["word"]: x["fixed"] for x in f or ()}
                texts.append(unicodedata.normalize("NFC", _WORD.sub(lambda w: m.get(w[0], w[0]), t)) if m else t)  # noqa: B023
            cols = [pa.array(texts, pa.string()) if j == i else b.column(j) for j in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    fixed = touched.join(maps, "__row", "left").select(*df.columns, "__fix").mapInArrow(apply, out_schema)
    return clean.unionByName(fixed)


def canonical(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``text`` in its consistent form; nulls stay null and empty texts empty.

    The vocabulary is the set of words of all rows of ``df``; a mixed-script word none of
    whose forms in one of its scripts is one of them is left as it is.  Rows, their order
    of columns and other columns are kept.
    """
    return _formed(df, text, False)


def compared(df: DataFrame, text: str = "text") -> DataFrame:
    """``canonical``, with what it cannot settle brought to one representative: texts that look alike become equal."""
    return _formed(df, text, True)


def same_look_pairs(keys: DataFrame, item: str, look_col: str = "look", stored: str = "stored") -> DataFrame:
    """(a, b), a < b: items with one look but different stored texts.

    Pairs are formed between the different stored texts of a look first and then
    expanded, so copies of one text meet nothing but the items they pair with.
    """
    k = stage(keys.filter(F.col(look_col).isNotNull()).select(F.col(item).alias("item"), F.col(look_col).alias("look"), F.col(stored).alias("stored")), "keys")
    texts = k.select("look", "stored").distinct()
    several = texts.groupBy("look").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("look")
    members = stage(k.join(several, "look"), "looks")
    classes = members.select("look", "stored").distinct()
    pairs = classes.alias("x").join(classes.alias("y"), F.expr("x.look = y.look AND x.stored < y.stored")).select("x.look", F.col("x.stored").alias("s1"), F.col("y.stored").alias("s2"))
    left = pairs.join(members.select("look", F.col("stored").alias("s1"), F.col("item").alias("i1")), ["look", "s1"])
    both = left.join(members.select("look", F.col("stored").alias("s2"), F.col("item").alias("i2")), ["look", "s2"])
    return both.select(F.least("i1", "i2").alias("a"), F.greatest("i1", "i2").alias("b")).filter(F.col("a") < F.col("b")).distinct()
