"""Token counts with a public tokenizer, in Arrow batches."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

# Fixed value: the public pre-tokenization pattern that belongs to the byte_bpe_50k vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(directory: str, name: str = "byte_bpe_50k"):
    import tiktoken

    with open(os.path.join(directory, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", directory: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """``df`` without ``text`` but with its length in tokens; null texts have null tokens, empty ones 0.

    No special tokens are added or recognised.  An existing column ``out`` is replaced.
    """
    rest = [c for c in df.columns if c not in (text, out)]
    src = df.select(*rest, F.col(text).alias(text))
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in src.schema if f.name != text], T.StructField(out, T.LongType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(directory, name)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            n = [None if t is None else len(enc.encode_ordinary(t)) for t in texts.to_pylist()]
            cols = [b.column(b.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64())], names=[*rest, out])

    return src.mapInArrow(run, schema)
