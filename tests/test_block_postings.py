"""A block's postings are made in the scan of its cards: nothing is shuffled, and every token of every card is counted once."""

from collections import Counter

import pytest

from quillmesh.operators import search_index as si


@pytest.mark.parametrize(("per", "most"), [(16, 1 << 25), (16, 200), (1_024, 1 << 25)])
def test_postings_are_the_counts_and_move_only_to_their_buckets(spark, monkeypatch, per, most):
    monkeypatch.setattr(si, "BLOCK_CARDS", per)
    monkeypatch.setattr(si, "BLOCK_BYTES", most)
    rows = [(k, [f"w{j * k % 7}" for j in range(k % 11)], ["é", "x"] * (k % 3) if k % 5 else []) for k in range(100)]
    rows += [((1 << 33) + k, ["w1"], None) for k in range(3)]
    cards = spark.createDataFrame(rows, "card bigint, title array<string>, body array<string>").coalesce(1)
    found = si.block_postings(cards, ("title", "body"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    counts = [(r["token"], r["field"], c["card"], c["n"]) for r in got for c in r["cards"]]
    want = {(t, f, r[0], n) for r in rows for f, x in zip(("title", "body"), r[1:], strict=True) for t, n in Counter(x or []).items()}
    assert len(counts) == len(set(counts)) and set(counts) == want
    for r in got:
        assert r["top"] == max(c["n"] for c in r["cards"]) and {c["card"] // per for c in r["cards"]} == {r["block"]}
        assert [c["card"] for c in r["cards"]] == sorted(c["card"] for c in r["cards"])
    assert si.block_postings(cards.limit(0), ("title", "body")).count() == 0
