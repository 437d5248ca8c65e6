"""Shuffles of tables are dealt by their rows, whatever the session's number."""

import pytest

from assaymill.operators import merge, ordered, tables
from assaymill.plans import catalogue, extraction

from .test_operators import cells, got

SMALL = "/root/testdata/sf0.001"


def test_parts(spark):
    least = spark.sparkContext.defaultParallelism
    assert [ordered.parts(spark.range(n), rows=10) for n in (0, 1, 10 * least, 10 * least + 1)] == [least, least, least, least + 1]


@pytest.mark.parametrize("name", ["q_long_assays", "q_assay_records", "q_extraction"])
def test_tasks_stay_small(spark, monkeypatch, name):
    """With ten times as many rows a task gets no more of them: each shuffle by
    table in the plan has a partition per 100 rows here."""
    expected = got(catalogue.QUERIES[name](spark, SMALL), "*")
    monkeypatch.setattr(ordered.parts, "__defaults__", (100,))
    n = -(-catalogue.table(spark, SMALL, "lineitem").count() // 100)
    df = catalogue.QUERIES[name](spark, SMALL)
    assert got(df, "*") == expected
    if name != "q_extraction":  # its records are persisted
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(f", {n}\n") >= 4 and "Repartition" in plan
    spark.catalog.clearCache()


def test_default_is_by_rows(spark, monkeypatch):
    c = cells(spark, [["Compound", "ICso"], *([f"Example {k}", f"{k} nM"] for k in range(1, 50))])
    plain = got(tables.long_assays(c, tables.is_biological(c)), "compound_id", "assay", "value")
    assert len(plain) == 49
    monkeypatch.setattr(ordered.parts, "__defaults__", (5,))
    df = tables.long_assays(c, tables.is_biological(c))
    assert df.rdd.getNumPartitions() == 10 and got(df, "compound_id", "assay", "value") == plain
    assert got(extraction.assay_records(c), "compound_id", "assay", "value") == plain


def test_ladder_isnt_broadcast(spark):
    """Keys of many structures are dealt by their number and merged."""
    s = spark.range(300_000).selectExpr("id AS structure_id", "'f' AS file", "concat('Cpd. ', id % 500, 'a') AS compound_id")
    a = spark.createDataFrame([("f", str(k)) for k in range(1, 4)] + [(None, "5")], "file string, assay_id string")
    df = merge.id_ladder(s, a)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("hashpartitioning(at") == 2
    assert len([x for x in plan.split("\n") if "hashpartitioning(at" in x and ", 10)" in x]) == 2
    assert {tuple(r) for r in df.groupBy("assay_id", "rung").count().collect()} == {(str(k), 8, 600) for k in range(1, 4)}
