"""Position weight matrices: parsing, scanning, information content, comparison.

Scans run on chunks of a sequence that overlap by the motif's length minus one, so a
chromosome-long record is spread over tasks; each chunk is scored with numpy in an
Arrow UDF.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import sequence as Q

CHUNK = 100_000


def parse_pwms(lines: DataFrame, value: str = "value") -> list[tuple[str, np.ndarray]]:
    """Named matrices from text: a line ``>name`` followed by lines of four weights (A, C, G, T)."""
    out: list[tuple[str, list[list[float]]]] = []
    for r in lines.select(value).collect():
        s = (r[0] or "").strip()
        if s.startswith(">"):
            out.append((s[1:].strip(), []))
        elif s and out:
            out[-1][1].append([float(x) for x in s.split()[:4]])
    return [(n, normalised(np.array(m))) for n, m in out if m]


def normalised(m: np.ndarray, pseudo: float = 0.0) -> np.ndarray:
    w = m + pseudo
    return w / w.sum(1, keepdims=True)


def information(m: np.ndarray) -> np.ndarray:
    """Bits of every column."""
    p = np.maximum(m, 1e-12)
    return 2 + (m * np.log2(p)).sum(1)


def trim_by_information(m: np.ndarray, least: float) -> np.ndarray:
    ok = np.flatnonzero(information(m) >= least)
    return m[ok[0] : ok[-1] + 1] if len(ok) else m[:0]


def reverse_complement(m: np.ndarray) -> np.ndarray:
    return m[::-1, ::-1]


def permute_columns(m: np.ndarray, seed: int) -> np.ndarray:
    return m[np.random.default_rng(seed).permutation(len(m))]


def kl_distance(a: np.ndarray, b: np.ndarray) -> float:
    p, q = np.maximum(a, 1e-12), np.maximum(b, 1e-12)
    return float((p * np.log2(p / q)).sum())


def consensus(m: np.ndarray) -> str:
    return "".join("ACGT"[i] for i in m.argmax(1))


_CODE = np.full(256, 4, dtype=np.int64)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i


def slide(bases: str, m: np.ndarray, background: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds scores at every start on both strands; minus infinity over gaps and N."""
    code = _CODE[np.frombuffer(bases.encode("latin-1", "replace"), dtype=np.uint8)]
    k, n = len(m), len(code) - len(m) + 1
    if n <= 0:
        return np.zeros(0), np.zeros(0)

    def score(w: np.ndarray) -> np.ndarray:
        lo = np.concatenate([np.log(np.maximum(w, 1e-12)) - np.log(background), np.full((k, 1), -np.inf)], axis=1)
        s = np.zeros(n)
        for j in range(k):
            s += lo[j][code[j : j + n]]
        return s

    return score(m), score(reverse_complement(m))


def scan(sequences: DataFrame, pwms: list[tuple[str, np.ndarray]], least: float, background: tuple = (0.25, 0.25, 0.25, 0.25)) -> DataFrame:
    """(id, motif, start, end, strand, score): places where the better strand scores at least ``least``.

    ``sequences`` is (id, bases); null bases give nothing; equal scores go to the plus strand.
    All positions are scored, the last one too.
    """
    longest = max((len(m) for _, m in pwms), default=1)
    bg = np.asarray(background, dtype=float)
    pieces = sequences.filter(F.col("bases").isNotNull()).select("id", F.inline(Q.chunks(F.col("bases"), max(CHUNK, 2 * longest), longest - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, start, s in zip(*[b.column(c).to_pylist() for c in range(3)]):
                for name, m in pwms:
                    plus, minus = slide(s, m, bg)
                    best = np.maximum(plus, minus)
                    for p in np.flatnonzero(best >= least):
                        rows.append((i, name, start + int(p), start + int(p) + len(m), "+" if plus[p] >= minus[p] else "-", float(best[p])))
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = [b.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "motif", "start", "end", "strand", "score"])

    kind = sequences.schema["id"].dataType.simpleString()
    out = pieces.mapInArrow(run, f"id {kind}, motif string, start long, end long, strand string, score double")
    return out.distinct()  # a start in the overlap of two chunks is found in both


def seed_matches(queries: DataFrame, targets: DataFrame, seed: int, most: int) -> DataFrame:
    """(query, target, start, mismatches): ungapped full-length matches that share a seed at a multiple of ``seed`` in the query.

    With ``most`` < number of seeds at least one seed is free of mismatches, so none is lost.
    """
    q = queries.select("query", "q_bases", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.length("q_bases") / seed).cast("int") - 1), lambda i: F.substring("q_bases", i * seed + 1, F.lit(seed)))).alias("i", "kmer"))
    t = targets.select("target", "t_bases", F.posexplode(Q.kmers(F.col("t_bases"), seed)).alias("at", "kmer"))
    j = q.join(t.select("target", "at", "kmer", "t_bases"), "kmer").withColumn("start", F.col("at") - F.col("i") * seed).filter(F.col("start") >= 0)
    piece = F.substring("t_bases", F.col("start") + 1, F.length("q_bases"))
    d = Q.hamming(piece, F.col("q_bases"))
    return j.withColumn("mismatches", d).filter(F.col("mismatches") <= most).select("query", "target", "start", "mismatches").distinct()
