"""Queries take their whole input: held against brute force on tables made for it."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from quillmesh.operators import cards as c
from quillmesh.operators import greedy, relations
from quillmesh.plans.catalog_more import CONFIG

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def few_vectors(spark, tmp_path_factory):
    """80 parts, of which 20 have a vector."""
    d = str(tmp_path_factory.mktemp("parts"))
    spark.read.parquet(f"{SF}/part.parquet").where("p_partkey < 80").write.parquet(f"{d}/part.parquet")
    spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 20").write.parquet(f"{d}/embeddings.parquet")
    return d


def test_cards_without_vector_have_candidates(spark, few_vectors):
    found = relations.candidates_plain(c.part_cards(spark, few_vectors), CONFIG)
    names = found.columns
    ordered = found.select(*names, *relations.best_first()).orderBy("c", "k").select(*names).collect()
    want = greedy.degree_capped_local([tuple(r) for r in ordered], CONFIG.top_k)
    got = [tuple(r) for r in entry_point.queries()["w03_capped_candidates"](spark, few_vectors).select(*names).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    bare = {r["id"] for r in c.part_cards(spark, few_vectors).where("vector is null").select("id").collect()}
    assert len(bare) == 60 and bare <= {x for r in got for x in r[:2]}


@pytest.mark.parametrize("name", ["r08_relations", "r10_graph"])
def test_cards_without_vector_have_edges(spark, few_vectors, name):
    bare = F.col("id").isin([r["id"] for r in c.part_cards(spark, few_vectors).where("vector is null").select("id").collect()])
    edges = entry_point.queries()[name](spark, few_vectors)
    edges = edges.where("method = 'semantic_fallback_v1'") if name == "r08_relations" else edges  # manual ones name any card
    ends = edges.select(F.explode(F.array("source", "target")).alias("end")).select(F.regexp_replace("end", "^card:", "").alias("id"))
    assert ends.where(bare).count() > 0
