"""Registered queries against DuckDB on the smallest tables, where these are there."""

from __future__ import annotations

import os

import duckdb
import pytest

from lacewing.plans import catalogue, reports, trees

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return connection


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(row[i]) for i in order) for row in rows)


#: Queries of kernels, which SQL can't express; tests/test_signatures.py holds the kernels by their invariants.
KERNELS = {"nmf_decomposition", "nmf_quality", "nmf_rank_scan", "nmf_cross_validation", "bootstrap_significance", "significant_exposures", "signature_shares", "fitted_to_signatures", "kmeans_clusters", "nmf_hidden_cells"}
#: Queries that are compared here; the others are compared on larger tables.
COMPARED = ["filter_calls", "context_6", "sample_statistics", "codon_effect", "box_stats", "ks_pairs", "benjamini_hochberg", "memo_sort", "attachment_fixed_tree", "dnds_overall", "coding_positions", "frameshift_offsets", "confusion_counts", "tree_edges", "rerooted_tree", "nearest_clonal", "represented_variants", "cumulative_frequencies", "clonal_and_minor", "variant_labels", "spearman_significance", "ks_significance", "harmonic_p_adjusted", "spearman_week", "orf_annotation", "mutation_effects", "memo_order", "violin_densities", "genotype_phylogeny", "adjacency_of_genotypes", "attachment_corrected", "node_labels", "outgroup_tree", "columns_by_cluster", "calls_of_files"]


@pytest.mark.parametrize("name", COMPARED)
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    expected = duck.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(expected.columns, expected.fetchall())


def test_every_query_has_an_oracle_or_is_a_kernel():
    assert hasattr(reports, "dnds_windows") and hasattr(trees, "memo_order") and set(catalogue.QUERIES) - set(catalogue.ORACLES) == KERNELS
