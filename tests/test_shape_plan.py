"""A judgement is parsed once, however many rules look at it."""

from pyspark.sql import functions as F

from quillmesh.operators import judgements


def test_a_judgement_is_parsed_once(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("[1]",), (None,)], "j string").select(judgements.shape_issues(F.col("j")).alias("issues"))
    plan = rows._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("parse_json(") == 1 and plan.count("from_json(") <= 1, plan
    assert [r["issues"] == ["not_an_object"] for r in rows.collect()] == [False, True, True]
