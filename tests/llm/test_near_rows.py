"""Which rows a near-duplicate stage keeps."""

import random

import corpus_pipeline
from quillmesh.llm import simhash


def rows_kept(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in df.collect())


def test_null_and_repeated_ids_take_no_other_text_with_them(spark):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(1, words(1)), (None, words(1)), (None, words(2)), (None, words(3)), (5, words(4)), (5, words(4)), (5, words(5)), (9, words(6)), (7, words(6)), (9, words(7)), (None, words(8)), (None, words(8))]
    kept = simhash.drop_near(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = [(1, words(1)), (None, words(2)), (None, words(3)), (5, words(4)), (5, words(5)), (7, words(6)), (9, words(7)), (None, words(8))]
    assert rows_kept(kept) == sorted((k is None, k or 0, t) for k, t in want)


def five_words(text):
    w = text.split()
    k = min(5, len(w))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()


def test_stage_drops_what_shares_eight_tenths_of_its_shingles(spark):
    r = random.Random(4)
    texts = []
    for k in range(12):
        base = [f"w{k}x{r.randrange(10**6)}" for _ in range(r.choice([40, 120, 400]))]
        for copy in range(12):
            w = list(base)
            for at in r.sample(range(len(w)), r.randint(0, max(1, len(w) // 30))):
                w[at] = f"new{k}x{copy}x{at}"
            texts.append(" ".join(w))
    texts += ["", "a b", "a b", "a c"]
    sets = [five_words(t) for t in texts]
    label = list(range(len(texts)))
    near = lambda a, b: a == b or (len(a | b) > 0 and 10 * len(a & b) >= 8 * len(a | b))
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if near(sets[i], sets[j])]
    for i, j in pairs:
        x, y = sorted((label[i], label[j]))
        label = [x if z == y else z for z in label]
    want = sorted(set(label))
    far = [p for p in pairs if (simhash.fingerprint(texts[p[0]]) ^ simhash.fingerprint(texts[p[1]])).bit_count() > simhash.DISTANCE]
    assert far and 20 < len(want) < len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_stage(spark, docs, "").collect()) == want
    assert corpus_pipeline.near_stage(spark, docs.limit(0), "").count() == 0
