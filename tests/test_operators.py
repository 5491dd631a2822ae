"""Operators on small hand-made tables: known numbers, order independence, brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import numeric, text, urls
from quillmesh.operators import concepts, conversations, graph, greedy, ingest, reader, relations, release, search, validate, vectors
from quillmesh.operators.cards import owned
from quillmesh.plans import build
from quillmesh.sources import files, sinks
from quillmesh.streaming import incremental

NONE = "source string, target string, type string, direction string, score double, note string"


def make_cards(spark, rows):
    """rows: id, categories, tags, overall, actions, vector."""
    df = spark.createDataFrame(
        [(k, r[0], *r[1:]) for k, r in enumerate(rows)], "ord long, id string, c array<string>, t array<string>, overall int, a array<string>, vector array<double>"
    )
    no = F.lit(None).cast("array<string>")
    return df.select(
        "id", "ord", F.col("id").alias("title"), F.concat(F.lit("about "), "id").alias("summary"), F.lit("u").alias("canonical_url"), F.lit("2024-01-01").alias("created_at"), F.lit("2024-01-02").alias("updated_at"),
        owned(F.col("c"), no).alias("categories"), owned(F.col("t"), no).alias("tags"), owned(F.col("c"), no).alias("navigation"), owned(F.col("a"), no).alias("actions"),
        owned(F.create_map(F.lit("overall"), F.col("overall")), F.create_map().cast("map<string,int>")).alias("relevance"), owned(F.lit("active"), F.lit(None).cast("string")).alias("status"), "vector",
    )


def unit(c):
    return [c, (1 - c * c) ** 0.5]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_taxonomy_scores(spark):
    cards = make_cards(spark, [("a", ["X"], ["t"], 5, ["go"], None), ("b", ["x "], ["T"], 4, ["GO"], None), ("c", ["x"], [], 1, [], None)])
    rows = {(r["source"], r["target"]): r["taxonomy"] for r in relations.candidates_plain(cards, relations.Config(min_combined=0)).collect()}
    assert rows == {("a", "b"): 1.0, ("a", "c"): 0.45, ("b", "c"): 0.45}


@pytest.mark.parametrize("raw,want", [(0.70, 0.0), (0.825, 0.5), (0.95, 1.0), (0.99, 1.0), (0.5, 0.0), (None, None)])
def test_similarity_range(spark, raw, want):
    assert value(spark, numeric.normalize_similarity(F.lit(raw).cast("double"))) == want


def test_publishing_gate(spark):
    cards = make_cards(spark, [("alpha", ["p"], [], 1, [], unit(1.0)), ("beta", ["q"], [], 1, [], unit(0.90)), ("far", ["r"], [], 1, [], [-1.0, 0.0])])
    none = spark.createDataFrame([], NONE)
    marked, edges = relations.build_relations(cards, relations.Config(), none, none, none)
    (m,) = marked.collect()
    assert (m["semantic"], m["combined"], m["publishable"]) == (0.8, 0.48, True)
    (e,) = edges.collect()
    assert (e["type"], e["classifier"], e["method"]) == ("complements", "heuristic-fallback", "semantic_fallback_v1")
    low = make_cards(spark, [("alpha", ["p"], [], 1, [], unit(1.0)), ("gamma", ["q"], [], 1, [], unit(0.85))])
    marked, edges = relations.build_relations(low, relations.Config(), none, none, none)
    assert marked.count() == 1 and edges.count() == 0


def test_manual_edges(spark):
    cards = make_cards(spark, [(x, [x], [], 1, [], None) for x in ("alpha", "gamma", "omega")])
    none = spark.createDataFrame([], NONE)
    one = lambda *r: spark.createDataFrame([r], NONE)
    pinned, over = one("gamma", "alpha", "depends_on", "source_to_target", None, "n"), one("omega", "alpha", "depends_on", "source_to_target", None, "n")
    edges = {r["pair_id"]: r for r in relations.build_relations(cards, relations.Config(), none, over, pinned)[1].collect()}
    p, o = edges["alpha::gamma"], edges["alpha::omega"]
    assert (p["source"], p["direction"], p["method"]) == ("alpha", "target_to_source", "manual_pinned")
    assert (o["direction"], o["method"], o["classifier"]) == ("target_to_source", "manual_override", "human")
    blocked = spark.createDataFrame([("gamma", "alpha"), ("alpha", "omega")], "source string, target string")
    assert relations.build_relations(cards, relations.Config(), blocked, over, pinned)[1].count() == 0


def random_cards(spark, n, seed):
    r = random.Random(seed)
    rows = [
        (f"c{k:04d}", r.sample(["x", "y", "z"], r.randint(0, 2)), r.sample(list("abcdef"), r.randint(0, 3)), r.randint(1, 5), r.sample(["go", "no"], r.randint(0, 1)), None if r.random() < 0.2 else [r.gauss(0, 1) for _ in range(4)])
        for k in range(n)
    ]
    return make_cards(spark, rows)


@pytest.mark.parametrize("config", [relations.Config(), relations.Config().with_range(0.0, 0.5), relations.Config(taxonomy_weight=0.9, semantic_weight=0.1), relations.Config(min_combined=0.04, min_taxonomy=0.0)])
def test_pruned_candidates_lose_none(spark, config):
    cards = random_cards(spark, 60, 3)
    got, want = relations.candidates(cards, config).collect(), relations.candidates_plain(cards, config).collect()
    assert sorted(got) == sorted(want) and len(want) > 10


@pytest.mark.parametrize("cap", [1, 3])
def test_greedy_choice(spark, cap):
    r = random.Random(cap)
    edges = [(a, b, r.randint(1, 5)) for a in range(25) for b in range(a) if r.random() < 0.4]
    df = spark.createDataFrame(edges, "source int, target int, w int")
    got = greedy.degree_capped(df, cap, [(-F.col("w")).alias("w"), F.col("source").alias("a"), F.col("target").alias("b")])
    want = greedy.degree_capped_local(sorted(edges, key=lambda e: (-e[2], e[0], e[1])), cap)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert greedy.degree_capped(df.limit(0), cap, [F.col("w").alias("w")]).count() == 0


def test_search_order(spark):
    rows = [("alpha", "Memory agent", "an agent with memory"), ("beta", "Agents", "memory"), ("gamma", "Other", "nothing")]
    df = spark.createDataFrame(rows, "id string, title string, summary string")
    index = search.index_documents(df, {"title": F.col("title"), "summary": F.col("summary")})
    found = search.search(index, "memory agent", ["agent", "memory"], 20, ("title", "summary")).collect()
    assert [r["id"] for r in found] == ["alpha", "beta"] and found[0]["matched_fields"].split(",")[0] == "title"
    assert search.search(index, "", [], 20).count() == 0
    with pytest.raises(ValueError):
        search.search(index, "x", ["x"], 0)


def test_text(spark):
    assert value(spark, text.normalize_search_text(F.lit("ＡＢＣ\x00  ﬁx"))) == "abc fix"
    assert value(spark, text.tokenize(F.lit("a 1 ab a-b c++ x_y 3.14"))) == ["1", "ab", "a-b", "x_y", "3.14"]
    assert value(spark, text.compact_markdown(F.lit("# A `b` [c](d) ![e](f) ```x\ny``` *g*"))) == "A b c g"
    assert value(spark, text.section(F.lit("## A\nx\n\n## B\ny"), "A")) == "x" and value(spark, text.section(F.lit("## A\nx"), "B")) is None
    assert value(spark, text.id_slug(F.lit("Äpfel & Co."))) == "apfel-co" or value(spark, text.id_slug(F.lit("Äpfel & Co."))) == "a-pfel-co"
    assert value(spark, text.decode_entities(F.lit("&#65;&eacute;&lt;&amp;lt;"))) == "A&eacute;<&lt;"
    assert value(spark, numeric.fnv1a(F.lit("a"))) == 0xE40C292C
    h = 2166136261
    for unit in (0x61, 0xD83D, 0xDE00):
        h = (h ^ unit) * 16777619 & 0xFFFFFFFF
    assert value(spark, numeric.fnv1a(F.lit("a😀"))) == h
    assert value(spark, numeric.to_fixed(F.lit(-0.375), 2)) == -0.38 and value(spark, numeric.cosine(F.lit([1.0]).cast("array<double>"), F.lit([0.0]).cast("array<double>"))) == 0.0


def test_pages(spark):
    html = "<title>T</title><nav>menu</nav><article>short</article><article><h1>Head &amp; tail</h1><p>one<br>two</p><script>x</script></article>"
    region = text.page_body(F.lit(html))
    assert value(spark, text.page_title(F.lit(html), region)) == "Head & tail"
    assert value(spark, text.plain_lines(region)) == "Head & tail\none\ntwo"
    page = '<script type="application/json">for(;;);{"a": [{"id": 1, "username": "u", "text": "t"}, {"pk": "2", "user": {"username": "v"}, "caption": {"text": "s"}}]}</script>'
    posts = spark.range(1).select(F.explode(files.embedded_json(F.lit(page))).alias("j")).select(F.explode(files.find_posts("j")).alias("p")).select("p.id", "p.username", "p.text").collect()
    assert sorted(map(tuple, posts)) == [("1", "u", "t"), ("2", "v", "s")]


def test_addresses(spark):
    for a, public in (("8.8.8.8", True), ("10.0.0.1", False), ("172.20.1.1", False), ("192.168.0.1", False), ("224.0.0.1", False), ("256.1.1.1", False), ("::1", False), ("2606:4700::1", True), ("2001:db8::1", False), ("2001:0db8::1", False), ("2002::1", False), ("192.0.1.0", False), ("192.88.99.1", False), ("::ffff:8.8.8.8", False), ("fe80::1", False)):
        assert value(spark, urls.is_public_address(F.lit(a))) is public, a


def test_resolved_targets(spark):
    cards = spark.createDataFrame([("a", "i1", "u1"), ("b", "i2", "u2"), ("c", "i3", "u3"), ("d", "i3", "u4")], "id string, identity string, url string")
    sources = spark.createDataFrame([("1", "i1", "u1"), ("2", "i1", "u2"), ("3", "zz", "u2"), ("4", "zz", "zz"), ("5", "i3", "zz"), ("6", None, None)], "key string, identity string, url string")
    found = {r["key"]: (r["action"], r["card_id"]) for r in ingest.resolve_targets(cards, sources).collect()}
    assert found == {"1": ("update", "a"), "2": ("conflict", None), "3": ("update", "b"), "4": ("create", None), "5": ("conflict", None), "6": ("create", None)}


def test_packs(spark):
    rows = [("r", p, k, n, b) for p, k, n, b in (("README.md", "readme", 0, 120), ("docs/a.md", "documentation", 3, 200), ("package.json", "manifest", 1, 100), ("src/index.ts", "source", 7, 10), ("src/b.ts", "source", 7, 10))]
    df = spark.createDataFrame(rows, "repo string, path string, kind string, priority int, bytes long")
    assert [r["path"] for r in ingest.select_packs(df, 3, 240).orderBy("place").collect()] == ["README.md", "package.json", "src/b.ts"]
    shuffled = ingest.select_packs(df.orderBy(F.rand(1)).repartition(3)).orderBy("place").collect()
    assert [r["path"] for r in shuffled] == ["README.md", "package.json", "docs/a.md", "src/b.ts"]


def pack_in_order(files, max_items, max_bytes):
    """The pack of one repository, file after file: (score, path, kind, bytes), sorted."""
    pack = []

    def fits(f, most):
        return len(pack) < max_items and f not in pack and sum(x[3] for x in pack) + f[3] <= max_bytes and sum(x[2] == f[2] for x in pack) < most

    turns = [([f for f in files if f[2] == kind], n) for kind, n in ingest.QUOTAS]
    turns.append(([min(same) for kind in ingest.MECHANISMS if (same := [f for f in files if f[2] == kind])], None))
    turns[-1] = (sorted(turns[-1][0])[: ingest.MECHANISM_FILES], None)
    turns += [([f for f in files if f[2] == kind], n) for kind, n in ingest.LATE_QUOTAS] + [(files, None)]
    for offered, n in turns:
        for f in offered:
            cap = ingest.KIND_CAPS.get(f[2], 1)
            if fits(f, cap if n is None else min(n, cap)):
                pack.append(f)
    return sorted(pack)


@pytest.mark.parametrize("max_items,max_bytes", [(14, 3_000), (14, 500), (5, 2_000), (14, 10**6)])
def test_packs_like_one_after_another(spark, max_items, max_bytes):
    r = random.Random(max_bytes)
    rows = [(repo, f"{r.choice(['docs', 'src', 'x'])}/f{k}.md", r.choice([*ingest.KINDS, "strange"]), r.randrange(9), r.choice([0, 40, 90, 400])) for repo in "abc" for k in range(60)]
    df = spark.createDataFrame(rows, "repo string, path string, kind string, priority int, bytes int")
    scored = df.where(~ingest.low_signal(F.col("path"), F.col("kind"))).withColumn("score", ingest.candidate_score(F.col("path"), F.col("kind"), F.col("priority"))).collect()
    got = ingest.select_packs(df, max_items, max_bytes).collect()
    for repo in "abc":
        files = sorted((x["score"], x["path"], x["kind"], x["bytes"]) for x in scored if x["repo"] == repo)
        want = pack_in_order(files, max_items, max_bytes)
        assert [x["path"] for x in sorted((x for x in got if x["repo"] == repo), key=lambda x: x["place"])] == [x[1] for x in want]


def chain_in_order(found):
    """(length, last, ambiguous) of one conversation's posts (id, author, reply_to, hint)."""
    now = top = min((p for p in found if p[2] is None), default=None)
    length, last, seen = 0, None, set()
    while now:
        length, last = length + 1, now[0]
        seen.add(now[0])
        after = [p for p in found if p[2] == now[0] and p[0] not in seen and p[1].lower() == top[1].lower()]
        named = [p for p in after if p[3] == length + 1]
        if len(after) > 1 and len(named) != 1:
            return length, last, True
        now = (named if len(after) > 1 else after or [None])[0]
    return length, last, False


def test_author_chains_like_one_after_another(spark):
    r, rows = random.Random(8), []
    for conv in range(40):
        for k in range(r.randint(1, 30)):
            rows.append((conv, f"{conv}-{k:02d}", r.choice("uuUUx"), None if not k or r.random() < 0.05 else f"{conv}-{r.randrange(max(0, k - 2), k):02d}", r.choice([None, None, k, k + 1])))
    got = {x["conv_id"]: tuple(x)[1:] for x in conversations.author_chains(posts(spark, rows)).collect()}
    assert got == {conv: chain_in_order([x[1:] for x in rows if x[0] == conv]) for conv in range(40)}


def test_tree_walk(spark):
    rows = [("r", "", "src", True, 1), ("r", "", "docs", True, 0), ("r", "", "a.md", False, 8), ("r", "src", "src/x.py", False, 8), ("r", "docs", "docs/y.md", False, 8), ("r", "src", "src/deep", True, 1)]
    df = spark.createDataFrame(rows, "repo string, parent string, path string, is_folder boolean, priority int")
    assert [r["path"] for r in ingest.discover(df).orderBy("place").collect()] == ["a.md", "docs/y.md", "src/x.py"]
    short = ingest.discover(df, ingest.WALK | {"trees": 2, "depth": 1}).orderBy("place").collect()
    assert [r["path"] for r in short] == ["a.md", "docs/y.md"] and short[0]["stops"] == "tree_budget"


def posts(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, id string, username string, reply_to string, hint int")


def test_roots_and_chains(spark):
    rows = [(1, "a", "u", None, None), (1, "b", "u", "a", None), (1, "c", "U", "b", None), (1, "d", "x", "c", None), (2, "e", "u", "f", None), (2, "f", "u", "e", None), (3, "g", "u", "gone", None), (3, "h", "u", "g", None)]
    rows += [(4, f"p{k:03d}", "u", f"p{k - 1:03d}" if k else None, None) for k in range(70)]
    found = {r["id"]: (r["root"], r["reason"]) for r in conversations.roots(posts(spark, rows)).collect()}
    assert found["a"] == ("a", "target_root") and found["d"] == ("a", "walked_parent_chain") and found["p069"] == ("p000", "walked_parent_chain")
    assert found["e"][0] is None and found["e"][1] == "cycle" and found["h"] == (None, "missing_parent") and found["g"][0] is None
    chain = {r["conv_id"]: tuple(r)[1:] for r in conversations.author_chains(posts(spark, rows[:4] + rows[8:])).collect()}
    assert chain == {1: (3, "c", False), 4: (70, "p069", False)}
    split = [(5, "a", "u", None, None), (5, "b", "u", "a", 2), (5, "c", "u", "a", None), (6, "a6", "u", None, None), (6, "b6", "u", "a6", None), (6, "c6", "u", "a6", None)]
    chain = {r["conv_id"]: tuple(r)[1:] for r in conversations.author_chains(posts(spark, split)).collect()}
    assert chain == {5: (2, "b", False), 6: (1, "a6", True)}


def test_tags_and_uniqueness(spark):
    policy = spark.createDataFrame([("Agent", "agent", "canonical"), ("agent", "other", "alias"), ("LLM", "llm", "alias")], "name string, tag string, kind string")
    values = spark.createDataFrame([(x,) for x in ("Agent", "agent", "AGENT", "llm", "none")], "value string")
    assert {r["value"]: r["tag"] for r in validate.resolve_tags(values, policy).collect()} == {"Agent": "agent", "agent": "other", "AGENT": "agent", "llm": "llm", "none": None}
    rows = spark.createDataFrame([("b", 2, "x"), ("a", 1, "x"), ("c", 3, "y"), ("d", 4, None), ("e", 5, None)], "id string, ord int, url string")
    assert [(r["key"], r["message"]) for r in validate.duplicates(rows, "id", "ord", {"url": F.col("url")}).collect()] == [("b", "first used by a")]
    with pytest.raises(ValueError, match="not_unique b"):
        validate.require_none(validate.duplicates(rows, "id", "ord", {"url": F.col("url")}), "cards")


def test_neighbours_do_not_depend_on_blocks(spark):
    r = random.Random(5)
    df = spark.createDataFrame([(k, [r.choice((0.0, 1.0, 2.0)) for _ in range(3)]) for k in range(60)], "id long, vector array<double>")
    one, many = (sorted(map(tuple, vectors.nearest(df, block_rows=b).collect())) for b in (1000, 9))
    assert one == many and len(one) == 300


def test_token_hash_and_embedder(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"])], "id int, tokens array<string>")
    found = vectors.token_hash_vectors(docs, "id", "tokens", 16).collect()
    assert all(len(r["vector"]) == 16 and abs(sum(x * x for x in r["vector"]) - 1) < 1e-6 for r in found)
    texts = spark.createDataFrame([(1, "xy"), (2, "z")], "id int, text string")
    assert {r["id"]: r["vector"] for r in vectors.embed(texts, "id", "text", lambda t: [[float(len(x)), 1.0] for x in t], 2).collect()} == {1: [2.0, 1.0], 2: [1.0, 1.0]}
    with pytest.raises(Exception, match="shape"):
        vectors.embed(texts, "id", "text", lambda t: [[1.0]] * len(t), 2).collect()
    with pytest.raises(Exception, match="not finite"):
        vectors.embed(texts, "id", "text", lambda t: [[float("nan"), 1.0]] * len(t), 2).collect()


def test_concepts_take_the_first(spark):
    cards = make_cards(spark, [("a", ["Big Data"], ["Graph DB"], 1, [], None), ("b", ["big data"], ["graph-db", "solo"], 1, [], None)])
    members = concepts.memberships(cards)
    named = {r["id"]: (r["label"], r["card_count"]) for r in concepts.concepts(members).collect()}
    assert named == {"category-big-data": ("Big Data", 2), "tag-graph-db": ("Graph DB", 2)}
    assert [tuple(r)[2:] for r in concepts.co_occurrence(members).collect()] == [(2, 1.0)]


def test_build_release_and_tampering(spark, tmp_path):
    cards = random_cards(spark, 30, 9).where("vector is not null")
    built = build.build_artifacts(cards, relations.Config().with_range(0.0, 0.5))
    assert build.publishable(built, cards, 4).count() == 0
    assert {r["code"] for r in build.publishable(built | {"vectors": built["vectors"].limit(2)}, cards, 5).collect()} == {"vectors_missing", "vector_dimensions"}
    root, sha = str(tmp_path / "releases"), "a" * 40
    said = release.write_release(spark, root, {k: built[k] for k in ("concepts", "edges")}, sha, "b" * 40)
    again, tables = release.read_release(spark, root)
    assert again == said and tables["edges"].count() == built["edges"].count()
    assert set(release.public_projection(said)) == {"release_id", "source_sha", "engine_sha", "artifacts"}
    assert release.current_release(spark, root) == said["release_id"]
    one = next((tmp_path / "releases" / "versions" / said["release_id"] / "edges").glob("part-*"))
    one.rename(one.with_name("part-x.parquet"))
    with pytest.raises(ValueError, match="edges: sha256 differs"):
        release.read_release(spark, root)
    assert release.lineage_issues(sha, sha, None, [], ()) == [] and release.lineage_issues(sha, "c" * 40, sha, ["data/x"], ("data/x",)) == []
    assert release.lineage_issues(sha, "c" * 40, sha, ["src/x"], ("data/x",)) == ["changed outside generated files: src/x"]


def test_pages_of_a_list(spark):
    cards = random_cards(spark, 23, 1)
    seen, cursor = [], None
    while True:
        found, cursor = reader.page(cards, "r1", 10, cursor)
        seen += [r["id"] for r in found.collect()]
        if not cursor:
            break
    assert seen == sorted(seen) and len(seen) == 23
    _, cursor = reader.page(cards, "r1", 10)
    with pytest.raises(ValueError, match="revision"):
        reader.page(cards, "r2", 10, cursor)


def test_card_files(spark, tmp_path):
    good = "﻿---\r\nid: a\r\ntitle: T\r\nrelevance:\r\n  ai: {overall: 3}\r\n  user: {}\r\n---\r\n# T\r\n\r\n## Notes\r\nhello\r\n"
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.md").write_bytes(good.encode())
    (tmp_path / "b.md").write_text("no front matter")
    (tmp_path / "c.md").write_text("---\n- a list\n---\nbody")
    (tmp_path / "README.md").write_text("---\nid: r\n---\n")
    rows = {r["file_path"].rsplit("/", 1)[-1]: r for r in files.read_cards(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.md", "b.md", "c.md"} and rows["a.md"]["data"]["relevance"]["ai"] == {"overall": 3} and rows["a.md"]["error"] is None
    assert (rows["b.md"]["error"], rows["c.md"]["error"]) == ("front_matter_missing", "front_matter_no_mapping")
    back = value(spark, sinks.render_card(F.struct(F.lit("a").alias("id"), F.lit(1).alias("n")), F.lit("T"), [("Notes", F.lit("hello"))]))
    assert back == "---\nid: a\nn: 1\n---\n\n# T\n\n## Notes\n\nhello\n"
    (tmp_path / "s.json").write_text(json.dumps({"k": 1}))
    assert files.read_state(spark, str(tmp_path), "k int").first()["k"] == 1
    assert files.read_settings(spark, str(tmp_path / "none.yaml"), {}) == {}
    assert value(spark, files.canonical_json(F.lit('{"b": 1, "a": [1, 2.50]}'))) == '{"a":[1,2.5],"b":1}'


def test_stream_keeps_the_index(spark, tmp_path):
    schema, source, index = "id string, body string", tmp_path / "in", str(tmp_path / "index")
    source.mkdir()

    def built(df):
        return df.dropDuplicates(["id"]).select("id", F.sha2(F.col("body").cast("binary"), 256).alias("input_hash"), F.length("body").alias("n"))

    for number, rows in enumerate(([("a", "x"), ("b", "yy")], [("b", "yy"), ("c", "zzz"), ("a", "xxxx")])):
        (source / f"{number}.json").write_text("\n".join(json.dumps({"id": i, "body": b}) for i, b in rows))
        stream = spark.readStream.schema(schema).json(str(source))
        incremental.maintain_index(stream, built, index, str(tmp_path / "state")).awaitTermination()
    last = incremental.DeltaIndex(spark, index).read()
    full = built(spark.createDataFrame([("a", "xxxx"), ("b", "yy"), ("c", "zzz")], schema))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, full.collect()))


def test_stream_metrics(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "view", 1.0), ("2024-01-01 00:20:00", "view", 3.0), ("2024-01-01 02:00:00", "view", 5.0)]
    df = spark.createDataFrame(rows, "ts string, route string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "e"))
    stream = incremental.metrics(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")), "ts", "route", "value")
    q = stream.writeStream.format("memory").queryName("m").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("m").collect())) == sorted(map(tuple, incremental.metrics(df, "ts", "route", "value").collect()))


def test_edges_of_three_kinds(spark):
    e = spark.createDataFrame([("a::b", "a", "b", "similar_to", "undirected", 0.5, "m", "c")], "pair_id string, source string, target string, type string, direction string, score double, method string, classifier string")
    m = spark.createDataFrame([("a", "k", "tag", 0.8)], "card_id string, concept_id string, origin string, strength double")
    o = spark.createDataFrame([("k", "l", 2, 1.0)], "source string, target string, support long, weight double")
    rows = {r["id"]: r for r in graph.edges(e, m, o).collect()}
    assert set(rows) == {"card-card:a::b", "card-concept:a::k", "concept-concept:k::l"} and rows["card-concept:a::k"]["target"] == "concept:k"
    shown = spark.createDataFrame([("a",)], "id string")
    assert graph.visible_edges(e, shown).count() == 0
