"""Every query of the engine against its SQL, and the same result with other shuffle partitions."""

import pytest

from brindle.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import assert_same, connect, rows


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLE_SQL:
        assert_same(found, duck.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["rrf_three_channels", "dedupe_latest", "latency_nearest_rank", "previous_turns"])
def test_partitions_do_not_matter(spark, sf_dir, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(rows(QUERIES[name](spark, sf_dir).toPandas()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
