"""Answers are parsed once per row, not once per use."""

from pyspark.sql import functions as F

from assaymill.functions import jsonish as J


def test_parsed_once(spark):
    df = spark.range(3).select(F.concat(F.lit("{'1': {'type': 'other', 'id': '"), F.col("id").cast("string"), F.lit("'},}")).alias("a")).select(J.entries(F.col("a"), F.lit(1)).alias("e"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("from_json(") == 2  # as written, as repaired
    assert sorted(r.e[0].id for r in df.collect()) == ["0", "1", "2"]


def test_null_and_broken(spark):
    answers = [(None,), ("",), ("no json",), ('{"1": "example_compound"}',), ('{"b2": "other", "b1": {"type": "x", "id": "none"}}',)]
    got = [[tuple(e) for e in r.e] for r in spark.createDataFrame(answers, "a string").coalesce(1).select(J.entries(F.col("a"), F.lit(2)).alias("e")).collect()]
    other = ("other", None)
    assert got == [[other, other], [other, other], [other, other], [("example_compound", None), other], [other, other]]
