"""The stored index's dictionary holds few grams a token, and short words are still found within longer tokens."""

from pyspark.sql import functions as F

from quillmesh.operators import search_index as si
from tests.test_stores import cards, fields, same


def test_grams(spark):
    rows = spark.createDataFrame([("rereading",), ("aaaaa",), ("the",), ("b7",), ("7",)], "t string").select("t", si.grams(F.col("t")).alias("g")).collect()
    assert {r["t"]: r["g"] for r in rows} == {"rereading": ["rer", "ere", "rea", "ead", "adi", "din", "ing"], "aaaaa": ["aaa"], "the": ["the"], "b7": ["b7"], "7": ["7"]}


def test_short_words_are_found_within_tokens(spark, tmp_path):
    df, index = cards(spark, 120), si.SearchIndex(spark, str(tmp_path / "index"))
    index.append(df, fields())
    held = {tuple(r) for r in index.holding(index.log.read()["segments"], ["7", "do", "read"]).collect()}
    assert held == {("7", "7"), ("7", "b7"), ("do", "un-do"), ("read", "reading"), ("read", "rereading")}
    for query in ("7", "un-do at", "do 7 the"):
        same(index, df, query, 40)
