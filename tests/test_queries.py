"""Every query of the plan modules against its SQL twin in DuckDB."""

import pytest

from docketry.operators import vectors
from docketry.plans import registry
from docketry.sources import tables


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, sf_dir, duck, same, name):
    result = registry.queries()[name](spark, sf_dir)
    sql = registry.oracle_sql().get(name)
    if sql is None:  # held against plain versions elsewhere
        assert result.count() > 0
    else:
        same(result, duck.sql(sql))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["best_dates", "reference_votes", "record_changes", "patched_records"])
def test_tasks_do_not_grow_with_the_lines(spark, sf_dir, duck, same, name, monkeypatch):
    """Few rows a task allowed: more partitions than the session's, the same result."""
    monkeypatch.setattr(tables, "ROWS_A_TASK", 500)
    monkeypatch.setattr(tables, "HEAVY_ROWS_A_TASK", 100)
    result = registry.queries()[name](spark, sf_dir)
    assert result.rdd.getNumPartitions() >= 12
    same(result, duck.sql(registry.oracle_sql()[name]))


def test_vectors_of_one_label_are_dealt(spark, sf_dir, duck, same, monkeypatch):
    """Each label's gallery in shares: joined by label and share, the same neighbours."""
    monkeypatch.setattr(vectors, "HEAVY_ROWS_A_TASK", 30)
    result = registry.queries()["knn_ratio_test"](spark, sf_dir)
    assert "__share" in result._jdf.queryExecution().optimizedPlan().toString()
    same(result, duck.sql(registry.oracle_sql()["knn_ratio_test"]))
