"""Variants of the stored tables that operators must survive: empty, all null, and with clashing extra columns."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

SOURCE = Path("/root/testdata/sf0.001")
CLASHES = ["key", "n", "_pid", "_row", "_k", "item", "leaf", "g", "v", "at", "id", "bucket", "task", "_task", "label", "a", "b", "pos", "delta", "spelled", "_s", "kind_r", "start_pos_r"]


def make(out: Path, variant: str) -> str:
    """``empty``: no rows. ``nulls``: some rows, then rows of nulls only, all twice. ``clash``: every row, with extra columns."""
    out.mkdir(parents=True, exist_ok=True)
    for p in SOURCE.glob("*.parquet"):
        t = pq.read_table(p)
        if variant == "empty":
            t = t.slice(0, 0)
        elif variant == "nulls":
            head = t.slice(0, 40)
            none = pa.table({f.name: pa.nulls(5, f.type) for f in t.schema}, schema=pa.schema([f.with_nullable(True) for f in t.schema]))
            t = pa.concat_tables([head.cast(none.schema), none, head.cast(none.schema), none])
        else:
            for c in CLASHES:
                if c not in t.column_names:
                    t = t.append_column(c, pa.array([c] * len(t), pa.string()))
        pq.write_table(t, out / p.name)
    return str(out)
