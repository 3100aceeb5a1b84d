"""Schemas of the tables the readers give."""

from __future__ import annotations

BLOCKS = "array<struct<start:bigint,end:bigint>>"
INTERVAL = "chrom string, start_pos long, end_pos long, name string, score double, strand string"
TRANSCRIPT = INTERVAL + f", cds_start long, cds_end long, colour string, blocks {BLOCKS}, extra array<string>"
PSL_FIELDS = "matches mismatches rep_matches n_count q_gaps q_gap_bases t_gaps t_gap_bases strand q_name q_size q_start q_end t_name t_size t_start t_end block_count block_sizes q_starts t_starts".split()
PSL_TEXT = {"strand", "q_name", "t_name", "block_sizes", "q_starts", "t_starts"}
