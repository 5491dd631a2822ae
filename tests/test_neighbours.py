"""Exact neighbours by cells against all pairs, and the plan of the token-hash vectors."""

import numpy as np
import pytest

import __spark_entry__ as entry_point
from quillmesh.operators import vectors

SF = "/root/testdata/sf0.001"


def slow(rows, k):
    out = {}
    x = {i: np.array(v, float) for i, v in rows}
    for i, v in x.items():
        found = []
        for j, w in x.items():
            if i != j:
                norm = np.linalg.norm(v) * np.linalg.norm(w)
                c = float(v @ w / norm) if norm else 0.0
                found.append((-np.floor(abs(c) * 1e6 + 0.5) / 1e6 * np.sign(c), j))
        out[i] = [(j, -s + 0.0) for s, j in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("block", [1_000, 16, 5])
def test_neighbours_are_exact(spark, block):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 8))
    rows = [(f"v{k:03d}", (centres[k % 6] + rng.normal(size=8) * 0.1).tolist()) for k in range(120)]
    rows += [(f"w{k}", rows[7][1]) for k in range(25)] + [("zero", [0.0] * 8), ("zero2", [0.0] * 8), ("minus", (-np.array(rows[0][1])).tolist())]
    df = spark.createDataFrame([*rows, ("none", None)], "id string, vector array<double>")
    report = {}
    got = vectors.nearest(df, k=4, block_rows=block, report=report).collect()
    want = slow(rows, 4)
    mine = {i: [] for i in want}
    for r in sorted(got, key=lambda r: (r["id"], r["rank"])):
        mine[r["id"]].append((r["other"], r["similarity"]))
    assert {i: [j for j, _ in x] for i, x in mine.items()} == {i: [j for j, _ in x] for i, x in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-9 for i in want for a, b in zip(mine[i], want[i], strict=True))
    assert block == 1_000 or report["skipped"] > 0.3, report
    assert vectors.nearest(df.limit(0), k=4).count() == 0


def test_token_hashes_are_folded_once(spark):
    plan = entry_point.queries()["a02_token_hash"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "labels.parquet" not in plan


def test_lengths_are_made_with_the_parts(spark):
    plan = entry_point.queries()["a02_token_hash"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "reduce(" not in plan


def test_vectors_that_lie_evenly_apart(spark, monkeypatch):
    """Where most cells are visited, all meet all in larger blocks, and few of the rows that come out look their vectors up."""
    rng, rows = np.random.default_rng(3), []
    rows = [(f"v{k:03d}", rng.normal(size=16).tolist()) for k in range(300)]
    sizes, match = [], vectors._match
    monkeypatch.setattr(vectors, "_match", lambda m, a, k, block, kind: sizes.append(block) or match(m, a, k, block, kind))
    got = vectors.nearest(spark.createDataFrame(rows, "id string, vector array<double>"), k=3, block_rows=4).collect()
    assert {i: [j for j, _ in x] for i, x in slow(rows, 3).items()} == {i: [r["other"] for r in sorted(got, key=lambda r: r["rank"]) if r["id"] == i] for i, _ in rows}
    assert sizes == [4, 19]


def test_few_columns_are_hopeful():
    sim = np.random.default_rng(2).normal(size=(5, 3_000))
    for row, cols in zip(sim, vectors._hopeful(sim, 4), strict=True):
        assert set(np.argsort(-row)[:4]) <= set(cols.tolist()) and len(cols) < 300
