"""Functions on base sequences, as built-in expressions (open reading frames in Arrow batches)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Degenerate base codes.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "[AG]", "Y": "[CT]", "S": "[CG]", "W": "[AT]", "K": "[GT]", "M": "[AC]", "B": "[CGT]", "D": "[AGT]", "H": "[ACT]", "V": "[ACG]", "N": "[ACGT]"}
STOPS = ["TAA", "TAG", "TGA"]


def reverse_complement(s: Column) -> Column:
    """Case is kept; other characters stay."""
    return F.reverse(F.translate(s, "ACGTUacgtu", "TGCAAtgcaa"))


def gc_fraction(s: Column) -> Column:
    """Share of G and C of either case; null for an empty sequence."""
    return F.when(F.length(s) > 0, F.regexp_count(s, F.lit("[GCgc]")) / F.length(s))


def soft_masked(s: Column) -> Column:
    return F.regexp_count(s, F.lit("[acgt]"))


def hamming(a: Column, b: Column, ignore_case: bool = False) -> Column:
    """Places that differ; null for unequal lengths."""
    x, y = (F.upper(a), F.upper(b)) if ignore_case else (a, b)
    diff = F.aggregate(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: (p != q).cast("int")), F.lit(0), lambda s, v: s + v)
    return F.when(F.length(a) == F.length(b), F.when(F.length(a) == 0, 0).otherwise(diff))


def kmers(s: Column, k: int) -> Column:
    """array<string> of all k-mers in order."""
    n = F.length(s)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def chunks(s: Column, size: int, overlap: int) -> Column:
    """array<struct<start,bases>>: pieces of ``size`` of which neighbours share ``overlap`` bases."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    n = F.length(s)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(n > 0, F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring(s, i + 1, F.lit(size)).alias("bases")))).otherwise(F.array().cast("array<struct<start:int,bases:string>>"))


def ungapped_runs(s: Column) -> Column:
    """array<struct<start,end>> of the runs without ``-``."""
    runs = F.regexp_extract_all(s, F.lit("(-+|[^-]+)"), 1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    step = lambda a, r: F.struct((a["at"] + F.length(r)).alias("at"), F.when(r.startswith("-"), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(r)).alias("end"))))).alias("out"))
    return F.aggregate(runs, zero, step, lambda a: a["out"])


def mask(s: Column, start: Column, end: Column, soft: bool = False) -> Column:
    """[start, end) replaced by N, or lower-cased."""
    inner = F.substring(s, start + 1, end - start)
    return F.concat(F.substring(s, F.lit(1), start), F.lower(inner) if soft else F.repeat(F.lit("N"), F.length(inner)), F.substring(s, end + 1, F.length(s)))


def encode(s: Column) -> Column:
    """array<int>: 0 to 3 for A, C, G, T, 4 for anything else."""
    return F.transform(F.split(F.translate(F.upper(s), "ACGT", "0123"), ""), lambda c: F.when(c.isin("0", "1", "2", "3"), c.cast("int")).otherwise(4))


def shuffled(s: Column, key: Column, seed: int) -> Column:
    """The letters in a random order fixed by ``key`` and ``seed``."""
    keyed = F.transform(F.split(s, ""), lambda c, i: F.struct(F.xxhash64(F.lit(seed), key, i).alias("h"), c.alias("c")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["c"]), "")


def trim_poly_a(s: Column, least: int = 5) -> Column:
    """Without a tail of ``least`` or more A, or a head of as many T."""
    return F.regexp_replace(F.regexp_replace(s, f"A{{{least},}}$", ""), f"^T{{{least},}}", "")


def trim_letter(s: Column, letter: str) -> Column:
    """Without that letter at both ends."""
    return F.trim(s, F.lit(letter))


def is_poly_a(s: Column, share: float = 0.9) -> Column:
    return F.coalesce(F.regexp_count(F.upper(s), F.lit("A")) >= share * F.length(s), F.lit(False)) & (F.length(s) > 0)


def iupac_regex(motif: str) -> str:
    return "".join(IUPAC[c] for c in motif.upper())


def motif_starts(s: Column, motif: str) -> Column:
    """array<int>: 0-based starts of all matches, overlapping ones too, on the given strand."""
    pat = iupac_regex(motif)
    n = F.length(s) - len(motif)
    return F.when(n >= 0, F.filter(F.sequence(F.lit(0), n), lambda i: F.upper(F.substring(s, i + 1, F.lit(len(motif)))).rlike(f"^{pat}$"))).otherwise(F.array().cast("array<int>"))


def digest(s: Column, site: str, cut: int) -> Column:
    """Fragments after cutting ``cut`` bases into every site."""
    before, after = iupac_regex(site[:cut]), iupac_regex(site[cut:])
    return F.split(s, (f"(?<={before})" if before else "") + (f"(?={after})" if after else ""), -1)


def find_orfs(bases: str) -> list[tuple[int, int, int]]:
    """(start, end, frame) of every ATG that has a stop codon in its frame, in order of start; linear in the length."""
    x = np.frombuffer(bases.upper().replace("U", "T").encode("utf-32-le"), dtype=np.uint32)
    n = len(x) - 2
    if n < 1:
        return []
    at = lambda c: (x[:n] == ord(c[0])) & (x[1 : n + 1] == ord(c[1])) & (x[2:] == ord(c[2]))
    starts = np.flatnonzero(at("ATG"))
    if not len(starts):
        return []
    far = 1 << 60
    stop = np.where(at(STOPS[0]) | at(STOPS[1]) | at(STOPS[2]), np.arange(n), far)
    for f in range(3):
        stop[f::3] = np.minimum.accumulate(stop[f::3][::-1])[::-1]
    return [(int(i), int(stop[i]) + 3, int(i % 3)) for i in starts if stop[i] < far]


def orfs(s: Column) -> Column:
    """array<struct<start,end,frame>>: from every ATG to the first stop codon in its frame, stop included; null for null."""

    @F.pandas_udf("array<struct<start:int,end:int,frame:int>>")
    def run(col: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [{"start": a, "end": b, "frame": c} for a, b, c in find_orfs(x)] for x in col], dtype=object)

    return run(s)


def longest_of_each(seqs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the longest frame of every sequence, the first of equals; -1 without any.

    All sequences are searched as one: each starts at a multiple of three, so frames agree, and no codon
    reaches over the padding between them.
    """
    best = np.full((2, len(seqs)), -1, dtype=np.int64)
    raw = [b"" if s is None else s.upper().replace("U", "T").encode("latin-1", "replace") for s in seqs]
    size = np.array([len(r) for r in raw], dtype=np.int64)
    room = size + 3 + (-size) % 3
    x = np.frombuffer(b"".join(r.ljust(int(k), b"-") for r, k in zip(raw, room)), dtype=np.uint8)
    first = np.cumsum(room) - room
    n = len(x) - 2
    if n < 1:
        return best[0], best[1]
    at = lambda c: (x[:n] == ord(c[0])) & (x[1 : n + 1] == ord(c[1])) & (x[2:] == ord(c[2]))
    start = np.flatnonzero(at("ATG"))
    stops = np.flatnonzero(at(STOPS[0]) | at(STOPS[1]) | at(STOPS[2]))
    end = np.full(len(start), -1, dtype=np.int64)
    for f in range(3):
        mine, own = start % 3 == f, stops[stops % 3 == f]
        k = np.searchsorted(own, start[mine])
        end[mine] = np.where(k < len(own), np.append(own, 0)[k], -1)
    seq = np.searchsorted(first, start, side="right") - 1
    ok = (end >= 0) & (end < first[seq] + size[seq])
    start, end, seq = start[ok], end[ok] + 3, seq[ok]
    order = np.lexsort((start, start - end, seq))
    seq, lead = np.unique(seq[order], return_index=True)
    best[0][seq], best[1][seq] = start[order][lead] - first[seq], end[order][lead] - first[seq]
    return best[0], best[1]


def longest_orf(s: Column) -> Column:
    """struct<start,end>: the longest of ``orfs``, the first of equals; null without any."""

    @F.pandas_udf("start int, end int")
    def run(col: pd.Series) -> pd.DataFrame:
        rows, parts, size = col.tolist(), [], 0
        cuts = [0]
        for i, x in enumerate(rows):  # about four million bases at a time
            size += len(x or "")
            if size > 1 << 22:
                cuts.append(i + 1)
                size = 0
        for a, b in zip(cuts, [*cuts[1:], len(rows)]):
            parts.append(longest_of_each([x if isinstance(x, str) else None for x in rows[a:b]]))
        start, end = (np.concatenate(p) for p in zip(*parts))
        return pd.DataFrame({"start": start.astype(np.int32), "end": end.astype(np.int32)})

    got = run(s)
    return F.when(got["end"] >= 0, got)


def flowgram(s: Column, order: str) -> Column:
    """array<int>: run lengths read off while the flow order is repeated over the sequence."""
    k = len(order)
    runs = F.regexp_extract_all(F.upper(s), F.lit(r"(A+|C+|G+|T+)"), 1)
    pos = lambda b: F.instr(F.lit(order), F.substring(b, 1, 1)) - 1
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        skip = F.pmod(pos(r) - a["at"], F.lit(k))
        return F.struct(F.pmod(pos(r) + 1, F.lit(k)).alias("at"), F.concat(a["out"], F.array_repeat(F.lit(0), skip), F.array(F.length(r))).alias("out"))

    return F.aggregate(runs, zero, step, lambda a: a["out"])


def ungapped_match(long: Column, short: Column, start: Column, most: int) -> Column:
    """Whether ``short`` lies wholly in ``long`` from ``start`` on with at most ``most`` mismatches."""
    piece = F.substring(long, start + 1, F.length(short))
    return F.coalesce(hamming(piece, short) <= most, F.lit(False))


def all_kmers(spark, k: int) -> DataFrame:
    """All 4^k k-mers."""
    code = lambda i: F.substring(F.lit("ACGT"), (F.shiftrightunsigned("id", 2 * (k - 1 - i)) % 4 + 1).cast("int"), F.lit(1))
    return spark.range(4**k).select(F.concat(*[code(i) for i in range(k)]).alias("kmer"))


def gene_sequence(blocks: Column, strand: Column, chrom_bases: Column) -> Column:
    """Exons joined, reverse-complemented on the minus strand."""
    joined = F.array_join(F.transform(blocks, lambda b: F.substring(chrom_bases, (b["start"] + 1).cast("int"), (b["end"] - b["start"]).cast("int"))), "")
    return F.when(strand == "-", reverse_complement(joined)).otherwise(joined)
