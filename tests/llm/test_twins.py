"""Classifiers and pipeline stages against slow versions of themselves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmesh.llm import jaccard, langid, mixing, quality
from quillmesh.llm.common import held_fold

SF = "/root/testdata/sf0.001"
ODD = [None, "", "   ", "x", "\n\n", "a a a a", "é漢 字", "WORD! " * 40, "|" * 30, "no stop\nno stop\n"]


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(10**6 + k, t, None, None, None) for k, t in enumerate(ODD)], own.schema)
    return own.unionByName(odd)


def slow_stats(text):
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(quality.STATS)
    lines, n = [x for x in data.split(b"\n") if x], len(words)
    count = lambda test: sum(map(test, data))
    upper, lower, wide = count(lambda b: 65 <= b <= 90), count(lambda b: 97 <= b <= 122), count(lambda b: b > 127)
    black = sum(len(w) for w in words)
    symbols = b"#$%&*@^~=<>_+\\{}[]"
    return [
        math.log1p(len(data)), math.log1p(n), black / n, (upper + lower + wide) / black, upper / max(upper + lower, 1), count(lambda b: b in symbols) / black, data.count(b"!") / n, data.count(b"|") / n,
        count(lambda b: 48 <= b <= 57) / black, wide / black, sum(words[k] == words[k + 1] for k in range(n - 1)) / n, len(set(words)) / n, max(words.count(w) for w in set(words)) / n,
        1 - len(set(lines)) / len(lines), math.log1p(len(data) / len(lines)), sum(w[-1:] in (b".", b",", b";", b":", b"?") for w in words) / n, sum(len(w) > 1 and w.isupper() for w in words) / n, sum(w[-1] in symbols + b"!|" for w in words) / n,
    ]


def test_quality_scores_like_rule_after_rule(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    assert len(model.rules) > 3
    for r in quality.classify(docs.select("doc_id", "text"), model).collect():
        x, total = slow_stats(r["text"]), model.intercept
        for rule, weight in zip(model.rules, model.weights, strict=True):
            total += weight if all((x[k] > t) == above for k, above, t in rule.terms) else 0
        want = 1 / (1 + math.exp(-total))
        assert math.isclose(r["score"], want, rel_tol=1e-9) and r["predicted"] == int(want >= 0.3)
    kept = {r["doc_id"] for r in quality.keep_good(docs, model).collect()}
    assert kept == {r["doc_id"] for r in quality.classify(docs, model).where("predicted = 1").collect()}


def test_held_out_labels_change_no_quality_model(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = held_fold(F.col("doc_id"), quality.FOLDS) == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs, turned) == quality.train(docs, labels)
    other = labels.withColumn("quality", F.when(~held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs, other) != quality.train(docs, labels)


def slow_language(text, net):
    """Window by window and filter by filter."""
    data, total, size = text.encode().lower(), np.zeros(len(net.languages)), 0
    for at in range(0, len(data), langid.WINDOW):
        window = data[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0")
        hidden = []
        for w in langid.WIDTHS:
            best = np.full(langid.FILTERS, -np.inf)
            for k in range(langid.WINDOW - w + 1):
                part = np.concatenate([net.p["e"][b] for b in window[k : k + w]])
                best = np.maximum(best, part @ net.p[f"f{w}"])
            hidden.append(np.maximum(best + net.p[f"b{w}"], 0))
        z = np.concatenate(hidden) @ net.p["o"] + net.p["c"]
        p = np.exp(z - z.max())
        weight = len(window) - window.count(0)
        total, size = total + p / p.sum() * weight, size + weight
    return total / max(size, 1)


def test_languages_like_window_after_window(spark, docs):
    net = langid.train(docs)
    some = docs.where((F.length(F.coalesce("text", F.lit(""))) < 700)).select("doc_id", "text")
    rows = langid.identify(some, net).collect()
    assert len(rows) > 10
    for r in rows:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        p = slow_language(r["text"], net)
        assert math.isclose(r["score"], p.max(), rel_tol=1e-4)
        assert r["lang_pred"] == net.languages[int(p.argmax())] or p.max() - np.sort(p)[-2] < 1e-4


def test_held_out_languages_change_no_network(spark, docs):
    held = held_fold(F.col("doc_id"), langid.FOLDS) == langid.HELD
    turned = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    one, two = langid.train(docs), langid.train(turned)
    assert one.languages == two.languages and all((one.p[k] == two.p[k]).all() for k in one.p)


def test_sample_repeats_rows_as_the_mix_says(docs):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    taken = {r["doc_id"]: r["n"] for r in mixing.sample(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert taken == {k: n for k, n in copies.items() if n}


def test_tokens_of_odd_texts(spark, docs):
    clash = docs.withColumns({x: F.lit(x) for x in ("token_ids", "decoded", "n_tokens")})
    rows = corpus_pipeline.token_stage(spark, clash, SF).collect()
    assert len(rows) == docs.count() and all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (10**6, 10**6 + 1)} == {0}


def test_members_of_a_group_meet_each_other_once():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    sets = [np.unique(np.where(rng.random(60) < 0.04, rng.integers(0, 2**63, 60), base)) for _ in range(40)] + [np.zeros(0, np.int64)]
    sizes = np.array(list(map(len, sets)))
    for side in (np.zeros(41, np.int64), (np.arange(41) % 3 == 0).astype(np.int64)):
        label = jaccard.similar_in_group(sizes, np.concatenate(sets), side)
        want = list(range(41))
        for i in range(41):
            for j in range(41):
                both = len(np.intersect1d(sets[i], sets[j]))
                meets = side[i] != side[j] if side.any() else i != j
                if meets and both and 10 * both >= 8 * (sizes[i] + sizes[j] - both):
                    a, b = sorted((want[i], want[j]))
                    want = [a if x == b else x for x in want]
        assert label.tolist() == want and len(set(want)) > 1
