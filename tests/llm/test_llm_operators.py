"""Each operator against a brute-force form, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import importlib.util

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from quillmesh.llm import bpe, embed_dedup, exact_dedup, langid, licenses, mixing, quality, simhash, token_counts, url_filter
from quillmesh.llm.common import connected_components, new_folder
from quillmesh.llm.queries import ORACLES, URL_RULES, tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\t ", "a", "A a a a", "x" * 30_000, "word " * 20_000, "naïve café 漢字 😀 'tis 'S", "same text", "same text", "same text"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, repeated ids and rows, and columns with the names that operators use themselves."""
    rows = [(k, t, "en", "s" if k % 2 else None, k) for k, t in enumerate(ODD)] + [(9, "same text", "en", "s", 9), (None, "null id", None, "s", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clash = {x: F.lit(x) for x in ("_row", "_text", "fp", "size", "copies", "target", "place", "tie", "_maybe", "text_sha256", "key", "component", "node", "u", "v", "_id", "_doc", "last", "stats", "_stats")}
    return df.withColumns(clash)


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(tokenizer_path())


@pytest.fixture(scope="module")
def reference(vocab):
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(tokenizer_path()), special_tokens={})


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 1


def test_perfect_hash_is_minimal(vocab):
    found = vocab.hash.find(vocab.tokens)
    assert (found == np.arange(len(vocab.tokens))).all()
    assert sorted(vocab.hash.key_at.tolist()) == list(range(len(vocab.tokens)))


def test_encoding_is_the_library_s(vocab, reference):
    rng = np.random.default_rng(3)
    alphabet = list("ab'sStTrevldm  \n\t\x85\xa0\u3000\x1c12²③é漢字ßñ!?’😀\u0300")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 50))) for _ in range(3_000)] + [t for t in ODD if t is not None]
    texts += [a + b for a in ("'s", "'", " '", "''", "'re", "'r", "'ll", "  ", " \n") for b in ("", "s", " s", "x", "'s", "é")]
    flat, at = bpe.encode_texts(texts, vocab)
    for k, text in enumerate(texts):
        assert flat[at[k] : at[k + 1]].tolist() == reference.encode_ordinary(text), repr(text)


def test_long_texts_are_cut_where_a_piece_begins(vocab, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 64)
    text = "it's  a long\n\n text, don't   cut 12 34 words " * 40 + "y" * 500
    assert "".join(bpe.segments(text, 64)) == text
    flat, at = bpe.encode_texts([text, "", None, text], vocab)
    want = reference.encode_ordinary(text)
    assert flat.tolist() == want * 2 and np.diff(at).tolist() == [len(want), 0, 0, len(want)]


def test_pieces_that_share_a_hash_stay_apart(monkeypatch):
    unique = np.unique
    monkeypatch.setattr(np, "unique", lambda key, **k: unique(key & np.uint64(3), **k) if key.dtype == np.uint64 else unique(key, **k))
    chars = np.frombuffer("ababcabxababc".encode("utf-32-le"), np.uint32)
    begin, size = np.array([0, 2, 5, 7, 8, 10]), np.array([2, 3, 2, 1, 2, 3])
    code, first = bpe.number_pieces(chars, begin, size)
    text = "ababcabxababc"
    pieces = [text[b : b + s] for b, s in zip(begin, size, strict=True)]
    assert [pieces[first[c]] for c in code] == pieces


def test_round_trip(spark, odd, reference):
    path = tokenizer_path()
    both = documents(spark).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = bpe.decode(bpe.encode(both, path), path).withColumn("sha", bpe.ids_sha256(F.col("token_ids"))).collect()
    assert len(rows) == both.count()
    for r in rows:
        ids = reference.encode_ordinary(r["text"] or "")
        assert r["token_ids"] == ids and bytes(r["decoded"]).decode() == (r["text"] or "")
        assert r["sha"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode(odd.limit(0), path).count() == 0
    assert bytes(bpe.decode(spark.createDataFrame([(None,)], "token_ids array<int>"), path).first()["decoded"]) == b""


def test_unknown_ids_fail(vocab):
    with pytest.raises((ValueError, pa.ArrowInvalid, IndexError)):
        bpe.decode_ids(pa.array([[10**6]], pa.list_(pa.int32())), vocab)


# 2


@pytest.mark.parametrize("range_ids", [1, 3, 7, 1000])
def test_counts_do_not_depend_on_where_ranges_end(spark, range_ids, tmp_path):
    rng = np.random.default_rng(range_ids)
    want = []
    for name in ("a", "b", "c", "d"):
        sizes = rng.integers(0, 12, 20).tolist()
        stream = np.concatenate([np.append(rng.integers(1, 9, n), 0) for n in sizes]).astype("<u2")
        if name in "bd":
            stream, sizes = np.append(stream, [5, 5]).astype("<u2"), [*sizes, 2]
        (tmp_path / f"{name}.bin").write_bytes(stream.tobytes())
        want += [(f"{name}.bin", k, n, not (name in "bd" and k == 20)) for k, n in enumerate(sizes)]
    (tmp_path / "empty.bin").write_bytes(b"")
    found = token_counts.count_tokens(spark, str(tmp_path), 0, 2, range_ids).collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_half_an_id_fails(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\x01\x02\x03")
    with pytest.raises(Exception, match="not whole ids"):
        token_counts.count_tokens(spark, str(tmp_path), 0).collect()


def test_counts_through_files(spark, odd):
    rows = odd.where("doc_id is not null").select("doc_id", "text").dropDuplicates(["doc_id"])
    coded = bpe.encode(rows, tokenizer_path())
    want = {r["doc_id"]: len(r["token_ids"]) for r in coded.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.document_token_counts(coded).collect()} == want
    assert token_counts.document_token_counts(coded.limit(0)).count() == 0


def test_ids_that_do_not_fit_fail(spark):
    for ids in ([70_000], [50_256]):
        df = spark.createDataFrame([(1, ids)], "doc_id bigint, token_ids array<int>")
        with pytest.raises(Exception, match="does not fit|end-of-document"):
            token_counts.write_token_files(df, "doc_id", "token_ids", 50_256, new_folder(spark, "bad")).collect()


# 3


def test_licenses(spark, odd):
    texts = {
        1: "Hello.\nReleased under the MIT License.\nBye.",
        2: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License;\neither version 3 of the License, or (at your option) any later version.",
        3: "This program is free software; you can redistribute it.",
        4: "Licensed under CC BY-NC 4.0.\nLICENSED UNDER the Apache License, Version 2.0",
        5: None,
        6: "released under the mit licenses",
        7: "Released under the MIT License. Licensed under the MIT license!",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string").withColumn("licenses", F.lit("old"))
    found = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert {k: r["licenses"] for k, r in found.items()} == {1: ["MIT"], 2: ["GPL-3.0-or-later"], 3: [], 4: ["Apache-2.0", "CC-BY-NC-4.0"], 5: [], 6: [], 7: ["MIT"]}
    assert [tuple(s) for s in found[1]["license_sentences"]] == [(1, "mit")]
    notices = {
        "GPL-3.0-or-later": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n",
        "LGPL-2.1-or-later": " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.\n *\n * This library is distributed",
        "GPL-2.0-only": "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License version 2 as\n# published by the Free Software Foundation.\n",
        "Apache-2.0": "Copyright 2024 A\n\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n",
        "MIT": "Copyright (c) 2024 A\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright",
        "BSD": "// Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that the following conditions are\n// met:\n//\n//    * Redistributions of source code must retain the above copyright\n// notice, this list of conditions and the following disclaimer.\n",
        "CC-BY-SA-4.0": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.",
        "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this",
    }
    wrapped = spark.createDataFrame(list(notices.items()), "name string, text string")
    assert {r["name"]: r["licenses"] for r in licenses.scan_licenses(wrapped).collect()} == {k: [k] for k in notices}
    first = {r["name"]: r["license_sentences"][0]["at"] for r in licenses.scan_licenses(wrapped).collect()}
    assert first["GPL-3.0-or-later"] == 0 and first["Apache-2.0"] == first["MIT"] == 2
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(odd.limit(0)).count() == 0


# 4


def test_quality_holds_out_and_is_exact_between_forms(spark, odd):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    scored = quality.classify(quality.add_stats(docs, out="s"), model).join(labels, "doc_id").toPandas()
    again = model.score_array(np.stack(scored["s"].to_numpy()))
    assert np.allclose(again, scored["score"]) and ((scored["score"] >= 0.3) == scored["predicted"]).all()
    assert (scored["predicted"] == scored["quality"]).mean() > 0.9
    assert quality.train(docs, labels) == model
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns and quality.classify(odd, model).count() == odd.count()
    assert quality.train(docs.limit(0), labels).rules == () and quality.keep_good(odd.limit(0), model).count() == 0
    one = labels.withColumn("quality", F.lit(1))
    assert quality.keep_good(docs, quality.train(docs, one)).count() == docs.count()
    assert quality.text_stats(None) == quality.text_stats(" \n") == [0.0] * len(quality.STATS)


# 5


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    parts = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    comp = list(range(len(fps)))
    near = [[j for j, y in enumerate(fps) if (x ^ y).bit_count() <= 4] for x in fps]
    while True:
        new = [min(comp[j] for j in n) for n in near]
        if new == comp:
            return comp
        comp = new


def test_fingerprints(spark):
    texts = [t for t in ODD if t is None or len(t) < 200] + [r[0] for r in documents(spark).select("text").limit(40).collect()] + ["A\x0bb c\x1cd e", "one two three"]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0
    got = spark.createDataFrame([("a b c d",)], "t string").select(F.xxhash64("t")).first()[0] % (1 << 64)
    assert simhash.fingerprint("a b c d") == got


def signed(fps):
    return np.array(fps, np.uint64).view(np.int64).tolist()


@pytest.mark.parametrize("node_rows", [16, 50_000])
def test_components_of_fingerprints(spark, node_rows):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 12, dtype=np.uint64)
    fps = [int(base[k % 12]) for k in range(150)]
    for k in range(150):
        for _ in range(int(rng.integers(0, 6))):
            fps[k] ^= 1 << int(rng.integers(0, 64))
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f,) for f in signed(fps)], "fp bigint")
    links = simhash.search_links(df, node_rows=node_rows)
    found = {r["node"]: r["component"] for r in connected_components(links, "a", "b").collect()}
    mine = [found.get(f, f) for f in signed(fps)]
    want = brute_components(fps)
    assert all((mine[a] == mine[b]) == (want[a] == want[b]) for a in range(len(fps)) for b in range(a))


def test_index_of_many_like_fingerprints_prunes_groups(spark):
    """4,000 fingerprints, 1,500 of which agree in a third of their bits, so that trees have several levels."""
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**64, 4_000, dtype=np.uint64)
    fps[:1_500] = (fps[0] & np.uint64(0xFFFFFC0000000000)) | (fps[:1_500] & np.uint64(0x3FFFFFFFFFF))
    for k in range(3_000, 4_000):
        fps[k] = fps[k - 2_900] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, int(rng.integers(1, 7)), dtype=np.uint64))
    fps = np.unique(fps)
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    want = {frozenset(p) for p in zip(*np.nonzero(apart <= 4), strict=True) if p[0] < p[1]}
    df = spark.createDataFrame([(f,) for f in signed(fps)], "fp bigint")
    at = {f: k for k, f in enumerate(signed(fps))}
    links = {frozenset((at[r["a"]], at[r["b"]])) for r in simhash.search_links(df, node_rows=600).collect()}
    assert links <= want
    join = lambda pairs: dict(map(tuple, connected_components(spark.createDataFrame([tuple(map(int, p)) for p in pairs], "a int, b int"), "a", "b").collect()))
    assert len(want) > 500 and join(links) == join(want)
    index, leaves = simhash.gray_index(df, node_rows=600)
    report, inner = [], {}
    simhash.open_leaves(index, leaves, report=report).count()
    assert leaves >= 18 and report[-1][1] > report[-1][2] > 0
    order = np.argsort([int(x) for x in simhash_rank(fps)], kind="stable")
    simhash.components_of(np.array([0]), np.array([0]), np.array([0]), fps[order], report=inner)
    assert all(inner[level][0] > inner[level][1] for level in (0, 1))


def simhash_rank(x):
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def test_near_groups(spark, odd):
    docs = documents(spark).select("doc_id", "text")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    ids = [r["doc_id"] for r in rows]
    want = brute_components([simhash.fingerprint(r["text"]) for r in rows])
    assert [found[i] for i in ids] == [ids[k] for k in want]
    kept = simhash.drop_near(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(found.values()))
    groups = simhash.near_groups(odd)
    assert groups.count() == odd.count()
    empty = {r["component_id"] for r in groups.collect() if r["doc_id"] in (0, 1, 2, 3)}
    assert empty == {0}
    assert simhash.drop_near(odd).columns == odd.columns and simhash.near_groups(odd.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1200)] + [(7, 7), (3000, 3001)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    found = dict(map(tuple, connected_components(df, "a", "b").collect()))
    assert {found[k] for k in range(201)} == {0} and {found[k] for k in range(1000, 1200)} == {1000} and found[3001] == 3000
    assert connected_components(df.limit(0), "a", "b").count() == 0


# 6


def test_water_filling():
    assert mixing.water_fill([10, 10], [1, 3], 20) == [5, 15]
    assert mixing.water_fill([1, 10, 100], [1, 1, 1], 111) == [3.0, 30.0, 78.0]
    assert mixing.water_fill([1, 0, 2], [1, 5, 1], 100) == [3.0, 0.0, 6.0] and mixing.water_fill([], [], 0) == []


def test_mix(spark, odd):
    docs = documents(spark)
    rows = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert rows.set_index("doc_id").copies.sort_index().equals(again.set_index("doc_id").copies.sort_index())
    assert (rows.copies <= 3).all() and rows.groupby("source").target.nunique().eq(1).all()
    for _, g in rows.groupby("source"):
        assert abs((g["size"] * g.copies).sum() - g.target.iloc[0]) <= g["size"].max() / 2 + 1e-6
    taken = mixing.sample(docs)
    assert taken.columns == docs.columns and taken.count() == rows.copies.sum()
    assert mixing.mix(odd).count() == odd.count() and mixing.sample(odd).columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.sample(odd.limit(0)).count() == 0


# 7


@pytest.mark.parametrize("bits", [32768, 1 << 28])
def test_exact_groups(spark, odd, bits):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    found = exact_dedup.exact_groups(odd, max_bits=bits).collect()
    assert len(found) == len(rows)
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in by.items()}
    for r in found:
        ids = sha[r["text_sha256"]]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)
    kept = exact_dedup.drop_exact(odd, max_bits=bits)
    assert kept.columns == odd.columns
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["text"] or "") for r in kept.collect()) == sorted(
        ((k is None, k or 0), t) for t, ids in by.items() for k in [max((i for i in ids if i is not None), default=None)]
    )
    assert exact_dedup.exact_groups(odd.limit(0)).count() == 0 and exact_dedup.drop_exact(odd.limit(0)).count() == 0


# 8


def test_gradients():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"])
    x, y = rng.integers(1, 256, (5, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    loss = lambda: -np.log(net._forward(x)[0][np.arange(5), y]).mean()
    g = net._gradient(x, y)
    for name in ("e", "f3", "b2", "o", "c"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = loss()
        net.p[name][at] = old - 1e-5
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4


def test_language(spark, odd):
    docs = documents(spark)
    net = langid.train(docs)
    held = langid.identify(docs, net).where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2) & F.col("lang").isNotNull())
    good, n = held.where("lang = lang_pred").count(), held.count()
    assert good / n > 0.9
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd.where("doc_id < 6"), net).collect()}
    assert all(got[k] == ("und", 0.0) for k in range(4)) and got[4][0] in net.languages and 0 < got[4][1] <= 1
    assert langid.identify(odd, net).count() == odd.count() and langid.identify(odd.limit(0), net).count() == 0
    assert langid.train(docs.limit(0)) is None and langid.identify(odd, None).first()["lang_pred"] == "und"


# 9


@pytest.mark.parametrize("limits", [{}, {"cell_rows": 12, "tile_rows": 7}])
def test_near_vectors(spark, limits):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 16))
    v = np.concatenate([base[k % 12] + rng.normal(scale=s, size=16) for k, s in enumerate(np.tile([0.0, 0.06, 0.12, 0.3], 40))]).reshape(-1, 16).astype(np.float32)
    rows = [(k, v[k].tolist(), k % 3 if k % 10 else None) for k in range(len(v))]
    bad = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [], v[1].tolist()[:8]]
    rows += [(500 + k, x, 1) for k, x in enumerate(bad)] + [(600, None, None), (601, (2 * v[1]).tolist(), 1)]
    null_part = [(700, [1.0, None] + [1.0] * 14, 1), (None, v[1].tolist(), 1)]
    df = spark.createDataFrame(rows + null_part, "vec_id bigint, embedding array<float>, label int").withColumns({x: F.lit(0) for x in ("n", "key", "cell", "first", "links")})
    found = {r["vec_id"]: r for r in embed_dedup.near_vectors(df, **limits).collect()}
    assert len(found) == len(rows) + len(null_part)
    whole = {k: np.array(x, np.float64) for k, x, lab in rows if x and len(x) in (8, 16) and lab is not None and np.isfinite(x).all() and np.any(x)}
    lab = {k: l for k, _, l in rows}
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    near = {a: [b for b in whole if b != a and lab[a] == lab[b] and len(whole[a]) == len(whole[b]) and cos(whole[a], whole[b]) >= 0.98] for a in whole}
    comp = {k: k for k in [r[0] for r in rows]}
    while True:
        new = {k: min([comp[k], *(comp[j] for j in near.get(k, ()))]) for k in comp}
        if new == comp:
            break
        comp = new
    assert sum(map(len, near.values())) > 20
    for k in comp:
        assert (found[k]["n_links"], found[k]["component_id"], found[k]["kept"]) == (len(near.get(k, ())), comp[k], comp[k] == k), k
    assert found[None]["n_links"] == 0 and found[700]["component_id"] == 700
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


# 10


def judged(spark, urls, rules):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumns({"_own": F.lit(1), "rule": F.lit("old")})
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, rules).collect()}


def test_url_rules(spark):
    urls = ["https://A.Example.COM/en/77?x#y", "http://x.com/en/1", "com/en/1", None, "", "http://example.net/de/8", "http://notexample.net/de/8", "x://org/es/a", "http://org?/es/", "HTTP://a.com:80/en/", "http://u@b.com/en/", "a://b://com/en/"]
    found = judged(spark, urls, URL_RULES)
    assert [found[k][2:] for k in range(12)] == [
        ("example.com/en/7", "allow"), ("com/en/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block"),
        (None, "allow"), (None, "allow"), ("com/en/", "block"), (None, "allow"),
    ]
    assert found[0][:2] == ("a.example.com", "/en/77") and found[3][:2] == ("", "") and found[11][0] == "b:"
    assert judged(spark, ["http://a.com/x"], [])[0][2:] == (None, "allow")


def test_cascade_is_exact(spark):
    listed = [f"k{k}" for k in range(0, 600, 3)]
    every = spark.createDataFrame([(f"k{k}",) for k in range(3_000)], "key string")
    cascade = url_filter.build_cascade(spark.createDataFrame([(k,) for k in listed], "key string"), every, 50)
    assert len(cascade.levels) > 2
    assert {r[0] for r in every.where(cascade.holds(F.col("key"))).collect()} == set(listed)


def test_rules_against_brute_force(spark):
    hosts, paths = ["a.com", "b.a.com", "com", "x.org", "a.b.org"], ["", "/", "/p", "/p/q", "/pq"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths]
    rules = [url_filter.Rule("block", "com"), url_filter.Rule("allow", "a.com", "/p"), url_filter.Rule("block", "b.org", "/p/"), url_filter.Rule("allow", "org", "/pq"), url_filter.Rule("block", "b.a.com", "/p")]
    found = judged(spark, urls, rules)
    for k, u in enumerate(urls):
        host, path = found[k][:2]
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.key), len(r.host)), default=None)
        assert found[k][2:] == ((best.key, best.action) if best else (None, "allow")), u


# SQL and the pipeline


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    from quillmesh.llm.queries import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine = queries()[name](spark, SF)
    want = con.sql(ORACLES[name])
    cols = sorted(mine.columns)
    assert cols == sorted(want.columns)
    got = sorted(map(repr, (tuple(r[c] for c in cols) for r in mine.collect())))
    assert got == sorted(map(repr, want.select(*cols).fetchall()))


def test_pipeline(spark, odd):
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("no pipeline")
    import corpus_pipeline as p

    docs = documents(spark)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        ids = {r[0] for r in docs.select("doc_id").collect()}
        kept = [r[0] for r in out.select("doc_id").collect()]
        assert kept and set(kept) <= ids, name
        assert name == "mixing" or len(kept) == len(set(kept)), name
        assert stage(spark, odd.select(*docs.columns), SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        docs = out
    last = p.run(spark, SF)
    assert last.where("not round_trip").count() == 0 and last.count() == docs.count()
