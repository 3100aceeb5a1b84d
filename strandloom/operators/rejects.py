"""Loading annotation lines with bad rows set apart.

Every field is kept as nullable text; cast and constraint rules are Column
expressions that fill one array of errors per row, and rows are split by whether
that array is empty.  Everything stays in the JVM and runs in one pass; the only
join is the lookup of chromosome lengths.

Quotes are handled by splitting a line at every double quote: parts at even places
lie outside quotes, parts at odd places inside, and an empty outside part between
two quotes is a doubled quote.  This is linear in the line's length, so very long
lines cannot overflow a regex matcher.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import table_broadcast

# Fixed values of the track line format.
VISIBILITY = ["0", "1", "2", "3", "4", "hide", "dense", "full", "pack", "squish"]
STRANDS = ["+", "-", "*", "."]
BED_FIELDS = ["chrom", "start", "end", "name", "score", "strand", "thick_start", "thick_end", "colour", "block_count", "block_sizes", "block_starts"]

EDGE = " \t\r\n\x0b\x0c"
HIDDEN_TAB = "￿"  # a noncharacter: stands for a tab inside quotes while fields are split


def _strip(c: Column) -> Column:
    return F.trim(c, F.lit(EDGE))


def _index(a: Column) -> Column:
    return F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("s")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often, and inside whatever lambda, it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def line_kind(line: Column) -> Column:
    """``empty``, ``comment``, ``browser``, ``track`` or ``annotation``; null lines are ``empty``."""
    s = _strip(line)
    first = F.lower(F.regexp_extract(s, r"^(\S*)", 1))
    return (
        F.when(s.isNull() | (s == ""), "empty")
        .when(s.startswith("#"), "comment")
        .when(first == "browser", "browser")
        .when(first == "track", "track")
        .otherwise("annotation")
    )


def quoted_ok(line: Column) -> Column:
    """Whether all wrapped fields of a tab-separated line open, close and end properly."""

    def parts_ok(parts: Column) -> Column:
        n = F.size(parts) - 1  # number of quotes

        def part_ok(p: Column) -> Column:
            i, s = p["i"], p["s"]
            opens = F.when(i == 0, (s == "") | s.endswith("\t")).otherwise(s.startswith("\t") & s.endswith("\t"))
            closes = (s == "") | s.startswith("\t")
            return (i % 2 == 1) | F.when(i == n, (i == 0) | closes).otherwise((s == "") & (i > 0) | opens)

        return (n % 2 == 0) & F.forall(_index(parts), part_ok)

    return let(F.split(line, '"', -1), parts_ok)


def unwrap_fields(line: Column) -> Column:
    """array<string>: the fields of a line for which ``quoted_ok`` holds, unwrapped."""

    def rebuilt(parts: Column) -> Column:
        n = F.size(parts) - 1

        def piece(p: Column) -> Column:
            i, s = p["i"], p["s"]
            return F.when(i % 2 == 1, F.translate(s, "\t", HIDDEN_TAB)).when((i > 0) & (i < n) & (s == ""), '"').otherwise(s)

        return F.array_join(F.transform(_index(parts), piece), "")

    wrapped = F.transform(F.split(let(F.split(line, '"', -1), rebuilt), "\t", -1), lambda f: F.translate(f, HIDDEN_TAB, "\t"))
    return F.when(line.contains('"'), wrapped).otherwise(F.split(line, "\t", -1))


def _digits(c: Column) -> Column:
    return c.rlike(r"\A[0-9]+\z")


def _number(c: Column) -> Column:
    """A digit string as a decimal: exact for up to 38 digits after leading zeros, else larger than any length."""
    bare = F.regexp_replace(c, r"^0+(?=[0-9])", "")
    big = F.lit("1" + "0" * 30).cast("decimal(38,0)")
    return F.when(F.length(bare) > 30, big).otherwise(bare.try_cast("decimal(38,0)"))


def colour_ok(c: Column) -> Column:
    """``0``, or three numbers from 0 to 255 with commas between."""
    three = c.rlike(r"\A[0-9]+,[0-9]+,[0-9]+\z")
    return (c == "0") | (three & F.forall(F.split(c, ","), lambda x: _number(x) <= 255))


def score_ok(c: Column) -> Column:
    """A plain or exponent decimal number from 0 to 1000."""
    form = c.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
    v = c.try_cast("double")
    return form & v.isNotNull() & (v >= 0) & (v <= 1000)


def _int_list(c: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(c, r",\z", ""), ","), _number)


def blocks_ok(count: Column, sizes: Column, starts: Column, span: Column) -> Column:
    """Block count, sizes and starts agree with each other and fill ``span``."""
    # A comma list without empty places; written so that no regex group repeats over a long list.
    form = lambda c: c.rlike(r"\A[0-9][0-9,]*+\z") & ~c.contains(",,")

    def fits(b: Column) -> Column:
        s, e, k = b["s"], b["e"], F.size(b["z"])
        ordered = F.forall(F.arrays_zip(F.slice(s, 2, F.greatest(k - 1, F.lit(0))).alias("x"), F.slice(e, 1, F.greatest(k - 1, F.lit(0))).alias("y")), lambda p: p["x"] >= p["y"])
        return (F.size(s) == k) & (_number(count) == k) & (k >= 1) & F.forall(b["z"], lambda x: x >= 1) & (F.get(s, F.lit(0)) == 0) & ordered & (F.try_element_at(e, F.lit(-1)) == span)

    lists = F.struct(_int_list(sizes).alias("z"), _int_list(starts).alias("s"))
    with_ends = let(lists, lambda b: F.struct(b["z"].alias("z"), b["s"].alias("s"), F.zip_with(b["s"], b["z"], lambda x, y: x + y).alias("e")))
    return F.coalesce(_digits(count) & form(sizes) & form(starts) & let(with_ends, fits), F.lit(False))


def annotation_errors(fields: Column, layout: Column, length: Column) -> Column:
    """array<string> of value errors, one per rule in BED order that fails; rules beyond ``layout`` don't apply."""
    f = lambda i: F.get(fields, F.lit(i))
    start, end = _number(f(1)), _number(f(2))
    span_ok = _digits(f(1)) & _digits(f(2)) & (start < end) & (end <= length)
    thick = _digits(f(6)) & _digits(f(7)) & _digits(f(1)) & _digits(f(2)) & (start <= _number(f(6))) & (_number(f(6)) <= _number(f(7))) & (_number(f(7)) <= end)
    rules = [
        ("chrom", 3, length.isNotNull()),
        ("start_end", 3, span_ok),
        ("name", 4, ~f(3).rlike(r"\A[\s\p{Z}]*\z")),
        ("score", 5, score_ok(f(4))),
        ("strand", 6, f(5).isin(STRANDS)),
        ("thick", 8, thick),
        ("colour", 9, colour_ok(f(8))),
        ("blocks", 12, blocks_ok(f(9), f(10), f(11), end - start)),
    ]
    checks = [F.when((layout >= least) & ~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, least, ok in rules]
    return F.array_compact(F.array(*checks))


# --- track lines -------------------------------------------------------------------------


def _track_parts(line: Column) -> Column:
    """The parts of what follows the first word, split at quotes."""
    return F.split(F.regexp_replace(line, r"\A\S+", ""), '"', -1)


def track_quoted_ok(line: Column) -> Column:
    """An even number of quotes, each pair of them the value of a ``key="..."`` set off by blanks."""

    def parts_ok(parts: Column) -> Column:
        n = F.size(parts) - 1

        def part_ok(p: Column) -> Column:
            i, s = p["i"], p["s"]
            opens = s.rlike(r"\s[^\s=]++=\z")  # the first part starts with the blank after the word
            closes = (s == "") | s.rlike(r"\A\s")
            return (i % 2 == 1) | F.when(n == 0, True).when(i == 0, opens).when(i == n, closes).otherwise(opens & s.rlike(r"\A\s"))

        return (n % 2 == 0) & F.forall(_index(parts), part_ok)

    return let(_track_parts(line), parts_ok) & ~F.regexp_extract(line, r"\A(\S+)", 1).contains('"')


def track_words(line: Column) -> Column:
    """array<struct<k,v>> of a track line for which ``track_quoted_ok`` holds; v is null for a word that is no pair."""
    parts = _track_parts(line)
    hide = F.transform(_index(parts), lambda p: F.when(p["i"] % 2 == 1, F.translate(p["s"], " \t\r\n\x0b\x0c", "﷐﷑﷒﷓﷔﷕")).otherwise(p["s"]))
    words = F.filter(F.split(F.array_join(hide, ""), r"\s+", -1), lambda w: w != "")
    show = lambda c: F.translate(c, "﷐﷑﷒﷓﷔﷕", " \t\r\n\x0b\x0c")
    at = lambda w: F.instr(w, "=")
    return F.transform(words, lambda w: F.struct(F.when(at(w) > 1, F.substring(w, F.lit(1), at(w) - 1)).otherwise(w).alias("k"), F.when(at(w) > 1, show(F.substring(w, at(w) + 1, F.length(w)))).alias("v")))


def track_errors(words: Column) -> Column:
    """array<string> of the rules a track line breaks; of a repeated key every value must hold."""

    def every(key: str, ok) -> Column:
        return F.forall(F.filter(words, lambda w: w["v"].isNotNull() & (w["k"] == key)), lambda w: ok(w["v"]))

    named = F.exists(words, lambda w: w["v"].isNotNull() & (w["k"] == "name"))
    rules = [
        ("pair", F.forall(words, lambda w: w["v"].isNotNull())),
        ("name", named & every("name", lambda v: v != "")),
        ("visibility", every("visibility", lambda v: v.isin(VISIBILITY))),
        ("useScore", every("useScore", lambda v: v.isin("0", "1"))),
        ("color", every("color", colour_ok)),
    ]
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules]))


def parse_lines(df: DataFrame, chrom_sizes: DataFrame, line: str = "raw_line", layout: str = "layout") -> DataFrame:
    """``df`` with ``kind``, ``fields`` (array<string>), ``track`` (array of k, v pairs) and ``errors`` (array<string>).

    ``errors`` holds ``quoting`` or ``columns`` alone, or ``value:<rule>`` for every
    value rule broken; it is empty for valid rows and for empty, comment and browser
    lines.  A null line is empty; a null layout fails as ``columns``.  Chromosomes are
    looked up as spelled in ``chrom_sizes`` (one length per name; the longest if a name
    is repeated).  Existing columns named like the results are replaced.
    """
    made = ["kind", "fields", "track", "errors"]
    base = df.drop(*made)
    s = _strip(F.col(line))
    staged = base.withColumn("kind", line_kind(F.col(line))).withColumn("__s", s)
    is_ann, is_track = F.col("kind") == "annotation", F.col("kind") == "track"
    staged = staged.withColumn("__q", F.when(is_ann, quoted_ok(F.col("__s"))).when(is_track, track_quoted_ok(F.col("__s"))))
    staged = staged.withColumn("fields", F.when(is_ann & F.col("__q"), unwrap_fields(F.col("__s"))))
    staged = staged.withColumn("__words", F.when(is_track & F.col("__q"), track_words(F.col("__s"))))
    staged = staged.withColumn("__chrom", F.get("fields", F.lit(0)))
    sizes = chrom_sizes.filter(F.col("chrom").isNotNull()).groupBy(F.col("chrom").alias("__chrom")).agg(F.max("length").alias("__length"))
    j = staged.join(table_broadcast(sizes), "__chrom", "left")
    columns_ok = F.coalesce(F.size("fields") == F.col(layout), F.lit(False))
    value = lambda errors: F.transform(errors, lambda e: F.concat(F.lit("value:"), e))
    none = F.array().cast("array<string>")
    errors = (
        F.when((is_ann | is_track) & ~F.col("__q"), F.array(F.lit("quoting")))
        .when(is_ann & ~columns_ok, F.array(F.lit("columns")))
        .when(is_ann, value(let(F.col("fields"), lambda f: annotation_errors(f, F.col(layout), F.col("__length")))))
        .when(is_track, value(let(F.col("__words"), track_errors)))
        .otherwise(none)
    )
    track = F.filter("__words", lambda w: w["v"].isNotNull())
    return j.withColumn("errors", errors).withColumn("track", track).select(*base.columns, *made)


def reason(errors: Column) -> Column:
    """The first applying of ``quoting``, ``columns`` and ``value``; null without errors."""
    return F.when(F.size(errors) > 0, F.substring_index(F.get(errors, F.lit(0)), ":", 1))


def split_rows(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid annotation and track lines, failed lines with their errors)."""
    lines = parsed.filter(F.col("kind").isin("annotation", "track"))
    return lines.filter(F.size("errors") == 0), lines.filter(F.size("errors") > 0)
