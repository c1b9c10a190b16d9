"""Every query against its SQL on DuckDB, over the whole small tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck
from tallyroom.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
# The llm folder has its own tests.

# Their values at this scale do not change with salting; run them on the salted path too.
SALTED = [
    "hierarchy_check", "crosswalk_exact", "parent_rules", "ancestor_contains", "provenance_join", "peer_ratio",
    "scope_asof", "value_binding", "derived_recompute", "excerpt_repeats", "amount_binding", "citation_audit", "citation_resolve", "name_crosswalk",
    "prorata_allocation", "shares", "materiality_filter", "cumulative_share", "rate_distribution", "lineage_closure",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_check():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES.get(name), SF) == ""


@pytest.mark.parametrize("name", SALTED)
def test_salted_path_matches_sql(spark, con, hot_keys, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF) == ""


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "status" in df.columns


@pytest.mark.parametrize("name", ["grand_identity", "prorata_allocation", "canonical_digest", "interval_union", "name_crosswalk"])
def test_result_does_not_depend_on_partitions(spark, name):
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = QUERIES[name](spark, SF)
            seen.add(tuple(sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1
