import os
from pathlib import Path

import pytest

import __spark_entry__ as contract
from tests.compare_sql import compare, connect

TABLES = "/root/testdata/sf0.001"
# One query per operator family; ORE_ALL=1 runs every query.
QUICK = (
    "baskets_order_brand", "frequent_itemsets", "son_counts", "cooccurrence_edges", "lpa_communities",
    "edge_betweenness", "modularity", "bfr_assign", "bfr_merge_pairs", "kmeans_step", "bfr_peel", "bootstrap_batches",
    "girvan_newman_summary", "itemset_report_file", "betweenness_file", "community_file", "reservoir_csv", "local_thresholds",
    "bloom_fpr", "fm_csv", "reservoir_snapshots", "stream_bloom", "retail_csv", "points_csv",
    "bfr_cs_merge", "bfr_ds_merge", "chunk_file_order", "clustering_file", "stream_fm_batches", "stream_snapshots",
    "stream_bootstrap", "retail_broken_csv", "retail_rejects", "shortest_path_dag", "community_lines",
)
NAMES = tuple(contract.queries()) if os.environ.get("ORE_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    if not Path(TABLES).exists():
        pytest.skip("test tables are not here")
    return connect(TABLES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    ok, line = compare(spark, con, TABLES, name)
    assert ok, line


def test_contract_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    if not Path(TABLES).exists():
        pytest.skip("test tables are not here")
    df = contract.entry(spark)
    assert df.columns == ["itemset", "size", "support"] and df.count() > 0
