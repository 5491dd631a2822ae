"""The fill-in-middle transformation against a slow form, on texts of many chunks and odd rows."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import fim

ODD = [None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "é漢\n字\n\n😀", "has <P> in it\nb", "<S>", "<", "<P\n>", "x" * 30_000, "line of words\n" * 4_000, "é\n" * 9_000 + "end", "same\ntext\n", "same\ntext\n"]


def slow(doc_id, text, form=fim.Format()):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{form.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in (form.prefix, form.suffix, form.middle)) or h[2] % 100 >= form.percent:
        return len(units), "plain", None, None, text
    if h[3] % 100 < form.spm_percent:
        return len(units), "spm", len(p), len(m), form.suffix + s + form.prefix + p + form.middle + m
    return len(units), "psm", len(p), len(m), form.prefix + p + form.suffix + s + form.middle + m


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, "one\ntwo\nthree\nfour\n" * k) for k in range(40)] + [(None, "no id\nat all\n" * 50), (13, ODD[13]), (13, "other\ntext")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({x: F.lit(x) for x in ("_row", "_n", "_first", "_key", "_one", "at", "chunk", "n", "form", "output", "node", "k")})


@pytest.mark.parametrize("giant", [1 << 16, 60])
def test_transform_is_the_slow_form(spark, odd, giant):
    got = fim.transform(odd, giant=giant, chunk=37)
    assert set(got.columns) == set(odd.columns) | {"prefix_chars", "middle_chars"}
    rows = got.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == slow(r["doc_id"], r["text"]), r["doc_id"]
        assert r["back"] == (r["text"] or "") and r["node"] == "node"


def test_tree_of_several_levels(spark):
    texts = {k: "".join(f"line {x}\n" if x % 3 else "\n" for x in range(200 * k)) + "open" * (k % 2) for k in range(1, 6)}
    rows = [(str(k), at, t[x : x + 16], 7919 * k, 104729 * k) for k, t in texts.items() for at, x in enumerate(range(0, len(t), 16))]
    chunks = spark.createDataFrame(rows + rows[:5], "key string, at bigint, chunk string, _one bigint, _two bigint")
    for r in fim.chunked_cuts(chunks, "key", fan=4).collect():
        k = int(r["key"])
        units = re.findall(r"[^\n]*\n|[^\n]+", texts[k])
        a, b = sorted((7919 * k % (len(units) + 1), 104729 * k % (len(units) + 1)))
        assert (r["n"], r["first"], r["second"]) == (len(units), len("".join(units[:a])), len("".join(units[:b])))


def test_other_automata_and_shares(spark, odd):
    # Units are words with the space after them; a text of spaces has none.
    after, ends = np.ones((2, 256), np.uint8), np.zeros((2, 256), np.uint8)
    after[:, 32] = 0
    ends[1, 32] = 1
    auto = fim.Automaton(after, ends, (0, 1))
    data, at = fim._cut(pa.array(["a  bc d", " ", None, "x" * 5_000 + " y"]))
    scan = fim.scan_texts(data, at, auto)
    assert scan[-1].tolist() == [3, 0, 0, 2]
    assert fim.find_cuts(data, at, scan, np.array([2, 0, 0, 1]), auto).tolist() == [6, 0, 0, 5_001]
    none = fim.Format(percent=0)
    assert {r["form"] for r in fim.transform(odd, form=none).select("form").distinct().collect()} == {"plain"}
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aa", "b", "c"), ("ab", "bc", "d"), ("abc", "b", "d")):
        with pytest.raises(ValueError):
            fim.Format(*bad)


def test_empty_table(spark, odd):
    assert fim.transform(odd.limit(0)).count() == 0
    assert fim.chunked_cuts(spark.createDataFrame([], "key string, at bigint, chunk string, _one bigint, _two bigint"), "key").count() == 0
