"""Python work on many small groups, without the cost of one Arrow exchange a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def grouped_map(df: DataFrame, keys: Sequence[str], fn: Callable[[dict[str, list]], list[tuple]], schema: str) -> DataFrame:
    """``fn`` of the columns of every group (as lists), giving rows of ``schema``.

    Rows are hash-partitioned and sorted by the keys, and groups are cut from the stream of
    a partition; only the group at hand is held in Python.  Null keys are a group.
    """
    keys = list(keys)
    out_schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out_schema)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] | None = None
        at: tuple | None = None
        out: list[tuple] = []
        for b in batches:
            cols = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            marks = list(zip(*[cols[k] for k in keys]))
            start = 0
            for i in range(1, len(marks) + 1):
                if i < len(marks) and marks[i] == marks[start]:
                    continue
                piece = {n: c[start:i] for n, c in cols.items()}
                if held is not None and at == marks[start]:
                    for n in held:
                        held[n] += piece[n]
                else:
                    if held is not None:
                        out += fn(held)
                    held, at = piece, marks[start]
                start = i
                if len(out) > 10_000:
                    yield emit(out)
                    out = []
        if held is not None:
            out += fn(held)
        yield emit(out)

    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).mapInArrow(run, out_schema)
