"""Registered queries over empty, all-null and column-clashing variants of the tables."""

import edge_tables
import pytest

import __spark_entry__ as entry

CORE = [
    "p1_found", "p1_key_totals", "p4_found", "p4_valid_lines", "p5_found", "overlap_inner", "overlap_count", "nearest", "subtract", "complement", "coverage_runs", "window_scan", "read_filters",
    "mate_pairs", "umi_duplicates", "two_sample_p", "scan_peaks", "quantile_normalised", "column_correlation", "anova_f", "running_enrichment", "longest_orf", "sam_round_trip", "gene_loci", "gsea",
]


@pytest.fixture(scope="module", params=["empty", "nulls", "clash"])
def variant(request, tmp_path_factory):
    return request.param, edge_tables.make(tmp_path_factory.mktemp(request.param), request.param)


@pytest.mark.parametrize("name", CORE)
def test_query_survives(spark, variant, name):
    kind, d = variant
    rows = entry.queries()[name](spark, d).collect()
    if kind == "clash":
        plain = entry.queries()[name](spark, str(edge_tables.SOURCE)).collect()
        assert len(rows) == len(plain)


def test_every_query_is_lazy_about_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q)


def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 0
