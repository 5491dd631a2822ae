"""Near duplicates: one search for all fingerprints of a class, and no rounds where there are stars already."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import jaccard, simhash
from quillmesh.llm.common import connected_components


def jobs(spark, name, run):
    """How many Spark jobs run() takes, and what it gives."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        found = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)), found


@pytest.mark.parametrize("node_rows", [50, 1 << 13])
def test_kinds_are_searched_together_and_meet_only_themselves(spark, node_rows):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    flips = np.array([np.bitwise_or.reduce(np.int64(1) << rng.choice(63, k, replace=False)) for k in rng.integers(1, 8, 240)])
    pool = np.unique(np.concatenate([base, np.repeat(base, 4) ^ flips]))
    rows = [(int(k), int(fp)) for k in range(3) for fp in rng.choice(pool, 200, replace=False)]
    df = spark.createDataFrame(rows, "place int, fp bigint")
    links = simhash.search_links(df, node_rows=node_rows, kind="place")
    assert links.columns == ["place", "a", "b"]
    found = links.collect()
    for k in range(3):
        alone = df.where(F.col("place") == k).select("fp")
        want = dict(map(tuple, connected_components(simhash.search_links(alone, node_rows=node_rows), "a", "b").collect()))
        mine = spark.createDataFrame([(r["a"], r["b"]) for r in found if r["place"] == k], "a bigint, b bigint")
        assert dict(map(tuple, connected_components(mine, "a", "b").collect())) == want and want


def test_stars_take_no_round(spark):
    stars = spark.createDataFrame([(1, 5), (1, 6), (7, 2), (2, 8), (2, 2)], "a int, b int")
    few, found = jobs(spark, "stars", lambda: dict(map(tuple, connected_components(stars, "a", "b").collect())))
    assert found == {1: 1, 5: 1, 6: 1, 2: 2, 7: 2, 8: 2}
    chain = spark.createDataFrame([(1, 5), (5, 6), (7, 2)], "a int, b int")
    more, found = jobs(spark, "chain", lambda: dict(map(tuple, connected_components(chain, "a", "b").collect())))
    assert found == {1: 1, 5: 1, 6: 1, 2: 2, 7: 2}
    assert few < more


def test_families_of_more_fingerprints_take_no_more_jobs(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 3)]) for k in range(30)]
    rows += [(30 + k, [rows[k][1][0], rows[k][1][1] ^ 7, int(rng.integers(0, 2**62))]) for k in range(10)]
    three = spark.createDataFrame(rows, "class bigint, prints array<bigint>")
    two = three.select("class", F.slice("prints", 1, 2).alias("prints"))
    count, found = jobs(spark, "three", lambda: dict(map(tuple, jaccard.families(three).collect())))
    fewer, same = jobs(spark, "two", lambda: dict(map(tuple, jaccard.families(two).collect())))
    assert found == same == {x: k for k in range(10) for x in (k, 30 + k)}
    assert count <= fewer + 3
