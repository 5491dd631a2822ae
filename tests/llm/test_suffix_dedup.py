"""Suffix-array deduplication against a dictionary of all windows, and a shard's parts against slow forms."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import queries, suffix_dedup

SF = "/root/testdata/sf0.001"


def slow(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[p : p + window] for x in data for p in range(len(x) - window + 1))
    found = []
    for x in data:
        cover = np.zeros(len(x) + 1, np.int64)
        for p in range(len(x) - window + 1):
            if seen[x[p : p + window]] > 1:
                cover[p : p + window] = 1
        kept = bytes(b for b, c in zip(x, cover, strict=False) if not c)
        found.append((len(x), int(cover.sum()), int((np.diff(cover, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return found


def rows_of(df):
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()


def test_query_on_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r["doc_id"] for r in docs), slow([r["text"] for r in docs], 400), strict=True))
    got = {r[0]: tuple(r)[1:] for r in queries.op11_suffix_dedup(spark, SF).collect()}
    assert got == want and any(x[1] for x in want.values())


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    words = ["one", "two", "naïve", "漢字", "aaaa", "bb", "😀", "\n"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common, long = make(30), make(400)
    texts = [None, "", "short", common, common, f"left {common} right", f"{make(9)}{common}", "x" * 3_000, "xy" * 2_000, "xy" * 700, long, long[200:900], f"{long} {long}", "\0" * 90, "\0" * 91]
    texts += [f"{make(8)} {common} {make(8)}" for _ in range(60)] + [make(40) for _ in range(40)]
    rows = list(enumerate(texts)) + [(3, common), (None, "no id " * 20), (None, None), (5, "other")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({x: F.lit(x) for x in ("key", "class", "_row", "spans", "start", "n", "bytes", "kept")})


@pytest.mark.parametrize("size, tiles", [(1 << 22, 8), (400, 8), (400, 1 << 10), (300, 1)])
def test_removal_is_the_slow_form(spark, odd, size, tiles, monkeypatch):
    """In one shard, in pairs of shards, and by digests."""
    got = suffix_dedup.remove_repeats(odd, window=40, gram=16, shard_bytes=size, max_tiles=tiles)
    assert set(got.columns) == set(odd.columns) | {"n_bytes", "n_removed", "n_spans"}
    rows = odd.select("doc_id", "text").collect()
    want = [(r["doc_id"], *x) for r, x in zip(rows, slow([r["text"] for r in rows], 40), strict=True)]
    assert Counter(map(tuple, rows_of(got))) == Counter(want)


def test_full_bitmap_changes_nothing(spark, odd):
    few = suffix_dedup.remove_repeats(odd, window=40, gram=8, max_bits=suffix_dedup.BUCKET)
    assert Counter(map(tuple, rows_of(few))) == Counter(map(tuple, rows_of(suffix_dedup.remove_repeats(odd, window=40, gram=16))))


def test_empty_table(spark, odd):
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_runs_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 128)
    monkeypatch.setattr(suffix_dedup, "RUN_WINDOWS", 50)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (0, 700, 10, 39, 40, 41, 300)] + [b"z" * 400, b""]
    at = np.cumsum([0, *map(len, texts)])
    text, begin, size, key, twice = suffix_dedup.window_runs(np.frombuffer(b"".join(texts), np.uint8), at, 40, 16)
    covered = sorted((t, p - at[t]) for t, b, n in zip(text, begin, size) for p in range(b, b + n))
    assert covered == [(k, p) for k, x in enumerate(texts) for p in range(len(x) - 39)]
    assert twice[text == 7].all() and size.max() <= 50
    key_of = {}
    for t, b, n, k in zip(text, begin, size, key):
        for p in range(b - at[t], b - at[t] + n):
            assert key_of.setdefault(texts[t][p : p + 40], k) == k


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    for trial in range(30):
        texts = [bytes(rng.integers(0, 1 + trial % 3, rng.integers(12, 90)).astype(np.uint8)) for _ in range(6)]
        texts += [texts[0], texts[1][3:], b"ab" * 30, b"ab" * 30]
        at = np.cumsum([0, *map(len, texts)])
        shard = suffix_dedup.Shard(np.frombuffer(b"".join(texts), np.uint8), at, 12)
        suffix = {int(at[k]) + p: x[p:] for k, x in enumerate(texts) for p in range(len(x))}
        assert [suffix[p] for p in shard.order] == sorted(suffix.values())
        count = Counter(suffix[p][:12] for p in suffix if len(suffix[p]) >= 12)
        assert shard.repeated().tolist() == [len(suffix[p]) >= 12 and count[suffix[p][:12]] > 1 for p in range(at[-1])]
        for slot, p in enumerate(shard.order):
            if len(suffix[p]) >= 12 and slot:
                a, b = suffix[p], suffix[shard.order[slot - 1]]
                assert shard.shared[slot] == next((k for k in range(12) if k >= min(len(a), len(b)) or a[k] != b[k]), 12)


def test_merging_two_shards():
    rng = np.random.default_rng(4)
    for trial in range(20):
        one, two = ([bytes(rng.integers(97, 99 + trial % 2, rng.integers(13, 60)).astype(np.uint8)) for _ in range(5)] for _ in range(2))
        two += [one[0][2:], b"a" * 40]
        shards = [suffix_dedup.Shard(np.frombuffer(b"".join(x), np.uint8), np.cumsum([0, *map(len, x)]), 13) for x in (one, two)]
        windows = [{x[p : p + 13] for x in side for p in range(len(x) - 12)} for side in (one, two)]
        for flags, side, others in zip(shards[0].search(shards[1]), (one, two), windows[::-1], strict=True):
            assert flags.tolist() == [len(x) - p >= 13 and x[p : p + 13] in others for x in side for p in range(len(x))]


def test_runs_that_cannot_repeat_are_not_sorted():
    """Runs that share a key's string but no window go before suffix arrays are made; those that share one stay."""
    rng = np.random.default_rng(5)
    for trial in range(20):
        one = lambda n: bytes(rng.integers(97, 123 - 24 * (trial % 2), n).astype(np.uint8))
        common, window = one(64), 100
        texts = [one(60) + common + one(60) for _ in range(20)] + [b"", b"short"]
        texts += [one(5) + texts[3][20:140] + one(5), b"z" * 102, texts[7]]
        at = np.cumsum([0, *map(len, texts)])
        seen = Counter(x[p : p + window] for x in texts for p in range(len(x) - window + 1))
        want = [k for k, x in enumerate(texts) if any(seen[x[p : p + window]] > 1 for p in range(len(x) - window + 1))]
        got = suffix_dedup.may_repeat(np.frombuffer(b"".join(texts), np.uint8), at, window).tolist()
        assert set(want) <= set(got) and {3, 7, 22, 23, 24} <= set(got)
        assert trial % 2 or got == want
    assert not len(suffix_dedup.may_repeat(np.zeros(0, np.uint8), np.zeros(1, np.int64)))
