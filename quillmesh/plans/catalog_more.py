"""Queries on joins, aggregates, ranking, sets, pages and graphs; see catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls
from ..functions.numeric import cosine, to_fixed
from ..operators import cards as c
from ..operators import concepts as con
from ..operators import conversations as conv
from ..operators import graph, ingest, reader, relations, release, search, validate, vectors
from ..operators.cards import table
from ..operators.rounds import checkpoint
from ..streaming import incremental
from .build import build_artifacts, publishable
from .catalog import _META, _POS, _POSTS, _SIM, DOCS, MEMBERS, PARTS, PROMOTED, TOKEN, _members, _vectors, fixed, norm, query, tokens, toks

#: The fixture vectors are far apart, so their similarities are stretched from this range.
CONFIG = relations.Config().with_range(0.0, 0.5)

_JAC = "CASE WHEN len({a}) + len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"
_HIGH = "list_concat(CASE WHEN overall >= 4 THEN ['overall'] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN engineering >= 4 THEN ['engineering'] ELSE CAST([] AS VARCHAR[]) END)"
FEATURES = f"""{PARTS}, feat AS (SELECT id, ord, list_transform(cats, lambda x: lower(x)) AS cats, list_transform(tags, lambda x: lower(x)) AS tags, {_HIGH} AS rels, list_transform(acts, lambda x: lower(x)) AS acts, vector FROM cards)"""
_J = {x: _JAC.format(a=f"l.{x}", b=f"r.{x}") for x in ("cats", "tags", "rels", "acts")}
_TAX = fixed(f"({_J['cats']} * 0.45::DOUBLE + {_J['tags']} * 0.3::DOUBLE + {_J['rels']} * 0.2::DOUBLE + {_J['acts']} * 0.05::DOUBLE)", 4)
PAIRS = f"""{FEATURES}, p0 AS (SELECT l.id AS source, r.id AS target, {_TAX} AS taxonomy, CASE WHEN l.vector IS NOT NULL AND r.vector IS NOT NULL THEN list_cosine_similarity(l.vector, r.vector) END AS raw0
  FROM feat l JOIN feat r ON l.ord < r.ord),
p1 AS (SELECT *, CASE WHEN raw0 IS NOT NULL THEN {fixed('greatest(0.0::DOUBLE, least(1.0::DOUBLE, raw0 / 0.5::DOUBLE))', 4)} END AS semantic, {fixed('raw0', 4)} AS raw FROM p0),
pairs AS (SELECT source, target, taxonomy, semantic, raw, {fixed('coalesce((taxonomy * 0.4::DOUBLE + semantic * 0.6::DOUBLE) / (0.4::DOUBLE + 0.6::DOUBLE), taxonomy)', 4)} AS combined FROM p1)"""


@query(f"WITH {PAIRS} SELECT source, target, taxonomy, semantic, raw, combined FROM pairs WHERE (taxonomy >= 0.08 OR coalesce(semantic >= 0.2, false)) AND combined >= 0.3")
def j01_candidates(spark: SparkSession, d: str) -> DataFrame:
    return relations.candidates(c.part_cards(spark, d), CONFIG)


@query(f"WITH {PARTS} SELECT id, vector IS NOT NULL AS has_vector, coalesce(len(vector), 0) AS dimensions FROM cards")
def j02_vector_lookup(spark: SparkSession, d: str) -> DataFrame:
    return c.part_cards(spark, d).select("id", F.col("vector").isNotNull().alias("has_vector"), F.coalesce(F.size("vector"), F.lit(0)).cast("long").alias("dimensions"))


@query(f"WITH {_SIM} SELECT id, other, similarity, {fixed('(1 - similarity)', 6)} AS distance, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 5")
def j03_nearest(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.nearest(_vectors(spark, d), k=5)
    return near.select("id", "other", "similarity", to_fixed(1 - F.col("similarity"), 6).alias("distance"), "rank")


def _cards(spark: SparkSession, d: str) -> DataFrame:
    """All cards, with and without a vector; they are written once, as a build reads them many times."""
    return checkpoint(c.part_cards(spark, d))


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The documents' index entries, and an older one in which some texts differ and some are missing."""
    docs = c.document_cards(spark, d).select("id", "ord", "title", F.sha2(F.concat_ws("\x01", "title", "summary", "body").cast("binary"), 256).alias("input_hash"))
    old = docs.where(F.col("ord") % 7 != 0).withColumns({"title": F.concat("title", F.lit("!")), "input_hash": F.when(F.col("ord") % 5 == 0, F.lit("stale")).otherwise(F.col("input_hash"))})
    return docs, old


@query(f"WITH {DOCS} SELECT id, CASE WHEN ord % 7 <> 0 AND ord % 5 <> 0 THEN title || '!' ELSE title END AS title, ord % 7 <> 0 AND ord % 5 <> 0 AS reused FROM docs")
def j04_reuse(spark: SparkSession, d: str) -> DataFrame:
    new, old = _index(spark, d)
    return vectors.reuse(new, old, "id", "input_hash", ["title"]).select("id", "title", "reused")


@query(f"WITH {PARTS} SELECT id AS pair_id, CASE WHEN ord % 3 = 0 AND ord % 4 <> 0 THEN 'cached' ELSE 'classified' END AS decision FROM cards")
def j05_classification_cache(spark: SparkSession, d: str) -> DataFrame:
    cards = c.part_cards(spark, d).select(F.col("id").alias("pair_id"), "ord", validate.row_hash("id", "summary").alias("candidate_hash"), F.lit("classified").alias("decision"))
    cache = cards.where(F.col("ord") % 3 == 0).withColumns({"candidate_hash": F.when(F.col("ord") % 4 == 0, F.lit("old")).otherwise(F.col("candidate_hash")), "decision": F.lit("cached")})
    return vectors.reuse(cards, cache, "pair_id", "candidate_hash", ["decision"]).select("pair_id", "decision")


_EDGE = f"""{PARTS}, edge AS (SELECT a.id AS source, b.id AS target, a.id || '::' || b.id AS pair_id, CASE WHEN a.ord % 4 = 0 THEN 'depends_on' ELSE 'similar_to' END AS type,
  CASE WHEN a.ord % 4 = 0 THEN 'source_to_target' ELSE 'undirected' END AS direction, 0.5::DOUBLE AS score, 'semantic_fallback_v1' AS method, 'heuristic-fallback' AS classifier
  FROM cards a JOIN cards b ON b.ord = a.ord + 1)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """A relation from every card to the next."""
    cards = c.part_cards(spark, d)
    nxt = cards.select((F.col("ord") - 1).alias("ord"), F.col("id").alias("target"))
    on = F.col("ord") % 4 == 0
    return cards.join(nxt, "ord").select(
        F.concat("id", F.lit("::"), "target").alias("pair_id"), F.col("id").alias("source"), "target", F.when(on, F.lit("depends_on")).otherwise(F.lit("similar_to")).alias("type"),
        F.when(on, F.lit("source_to_target")).otherwise(F.lit("undirected")).alias("direction"), F.lit(0.5).alias("score"), F.lit("semantic_fallback_v1").alias("method"), F.lit("heuristic-fallback").alias("classifier"),
    )


@query(f"WITH {_EDGE} SELECT pair_id FROM edge JOIN part ON 'part-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') = source WHERE p_size <= 40")
def j06_blocked(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").where("p_size > 40").select(F.concat(F.lit("part-"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("source"))
    edges = _edges(spark, d)
    blocked = edges.join(part, "source", "left_semi").select(F.col("target").alias("source"), F.col("source").alias("target"))
    stop = blocked.select(relations.pair_key(F.col("source"), F.col("target")).alias("pair_id"))
    return edges.join(stop, "pair_id", "left_anti").select("pair_id")


@query(
    f"WITH {_EDGE} SELECT source AS id, target AS other, c.title, type, direction FROM edge JOIN cards c ON c.id = target UNION ALL SELECT target, source, c.title, type, "
    "CASE direction WHEN 'source_to_target' THEN 'target_to_source' ELSE direction END FROM edge JOIN cards c ON c.id = source"
)
def j07_other_endpoint(spark: SparkSession, d: str) -> DataFrame:
    return graph.other_endpoint(_edges(spark, d), c.part_cards(spark, d))


@query(f"WITH {MEMBERS} SELECT card_id, concept_id, origin, strength, k.label, k.card_count FROM members JOIN concepts k ON k.id = concept_id")
def j08_members(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d)
    k = con.concepts(m).select(F.col("id").alias("concept_id"), F.col("label").alias("k_label"), "card_count")
    return m.drop("label").join(k, "concept_id").select("card_id", "concept_id", "origin", "strength", F.col("k_label").alias("label"), "card_count")


@query(
    "SELECT CAST(page_id AS VARCHAR) AS key, CASE WHEN page_id % 3 = 0 AND page_id % 4 <> 1 THEN 'card-' || page_id WHEN page_id % 3 = 1 AND page_id % 4 <> 1 THEN 'card-' || page_id END AS card_id, "
    "CASE WHEN page_id % 3 = 2 THEN 'create' WHEN page_id % 4 = 1 THEN 'conflict' ELSE 'update' END AS action FROM pages"
)
def j09_targets(spark: SparkSession, d: str) -> DataFrame:
    """A third of the sources match by identity, a third by url, a third not; some match two cards."""
    k = F.col("page_id")
    pages = table(spark, d, "pages").select(k.cast("string").alias("key"), "page_id")
    sources = pages.select("key", F.when(k % 3 == 0, F.concat(F.lit("id:"), "key")).otherwise(F.concat(F.lit("none:"), "key")).alias("identity"), F.when(k % 3 == 1, F.concat(F.lit("u:"), "key")).otherwise(F.concat(F.lit("other:"), "key")).alias("url"))
    one = pages.select(F.concat(F.lit("card-"), "key").alias("id"), F.concat(F.lit("id:"), "key").alias("identity"), F.concat(F.lit("u:"), "key").alias("url"), "page_id")
    two = one.where(k % 4 == 1).withColumn("id", F.concat("id", F.lit("-again")))
    return ingest.resolve_targets(one.unionByName(two), sources)


_PAIRED = f"{MEMBERS}, co AS (SELECT a.concept_id AS source, b.concept_id AS target, count(*) AS support FROM members a JOIN members b ON a.card_id = b.card_id AND a.concept_id < b.concept_id GROUP BY 1, 2 HAVING count(*) >= 2)"
_CO = f"{_PAIRED}, rel AS (SELECT source, target, support, {fixed('(support::DOUBLE / least(x.card_count, y.card_count))', 6)} AS weight FROM co JOIN concepts x ON x.id = source JOIN concepts y ON y.id = target)"


@query(f"WITH {_CO} SELECT source, target, support, weight FROM rel")
def j10_concept_pairs(spark: SparkSession, d: str) -> DataFrame:
    return con.co_occurrence(_members(spark, d))


_PLACED = _POS.replace("e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)", "e AS (SELECT id, 0 AS label, vector AS v FROM cards WHERE vector IS NOT NULL)")
_CENTROID = f"{MEMBERS}, {_PLACED}, cen AS (SELECT concept_id, sum(x * strength) / sum(strength) AS x, sum(y * strength) / sum(strength) AS y FROM members JOIN pos ON pos.id = card_id GROUP BY concept_id)"


@query(f"WITH {_CENTROID} SELECT k.id, {fixed('coalesce(c.x, 0.0::DOUBLE)', 6)} AS x, {fixed('coalesce(c.y, 0.0::DOUBLE)', 6)} AS y FROM concepts k LEFT JOIN cen c ON c.concept_id = k.id")
def j11_centroids(spark: SparkSession, d: str) -> DataFrame:
    cards = c.part_cards(spark, d)
    m = con.memberships(cards, PROMOTED)
    return graph.concept_positions(m, graph.card_positions(cards), con.concepts(m))


@query(f"WITH {_CENTROID} SELECT c.id, c.title, pos.x, pos.y FROM cards c LEFT JOIN pos ON pos.id = c.id")
def j12_node_positions(spark: SparkSession, d: str) -> DataFrame:
    cards = c.part_cards(spark, d)
    return cards.select("id", "title").join(graph.card_positions(cards), "id", "left").select("id", "title", "x", "y")


@query(f"WITH {_POSTS} SELECT a.id, b.id AS parent, b.username AS parent_username FROM posts a LEFT JOIN posts b ON a.reply_to = b.id")
def j13_reply_parent(spark: SparkSession, d: str) -> DataFrame:
    return conv.with_parent(conv.posts(table(spark, d, "conversations")))


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN o_orderkey % 89 = 0 THEN 'mismatch' ELSE 'ok' END AS state FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderkey % 97 <> 0")
def j15_state_links(spark: SparkSession, d: str) -> DataFrame:
    """State rows against the rows they name, with the name they claim."""
    key = F.col("o_orderkey")
    state = table(spark, d, "orders").select("o_orderkey", F.when(key % 97 == 0, F.lit(-1).cast("long")).otherwise(F.col("o_custkey")).alias("cust"), "o_custkey")
    cust = table(spark, d, "customer").select("c_custkey", "c_name")
    claimed = F.when(key % 89 == 0, F.lit("someone")).otherwise(F.col("c_name"))
    joined = state.join(cust, F.col("cust") == F.col("c_custkey"), "left").withColumn("claimed", claimed)
    return joined.select("o_orderkey", F.when(F.col("c_custkey").isNull(), "missing").when(~F.col("claimed").eqNullSafe(F.col("c_name")), "mismatch").otherwise("ok").alias("state"))


@query(f"WITH {PARTS} SELECT id FROM cards WHERE list_has_any(cats, ['ECONOMY']) OR list_has_any(tags, ['hot', 'anvil'])")
def j16_promoted(spark: SparkSession, d: str) -> DataFrame:
    rule = con.Promoted("x", "X", "theme", ("ECONOMY",), ("Hot", " anvil "))
    return con.memberships(c.part_cards(spark, d), (rule,)).where("concept_id = 'x'").select(F.col("card_id").alias("id"))


@query(f"WITH {_EDGE}, shown AS (SELECT id FROM cards WHERE overall >= 3) SELECT pair_id FROM edge WHERE source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown)")
def j17_visible_edges(spark: SparkSession, d: str) -> DataFrame:
    shown = c.part_cards(spark, d).where(c.effective_relevance()["overall"] >= 3)
    return graph.visible_edges(_edges(spark, d), shown).select("pair_id")


# Aggregates


@query(f"WITH {DOCS}, w AS (SELECT unnest({toks(norm('body'))}) AS token FROM docs) SELECT token, count(*) AS n FROM w GROUP BY token")
def a01_term_frequency(spark: SparkSession, d: str) -> DataFrame:
    rows = c.document_cards(spark, d).select(F.explode(tokens(F.col("body"))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {DOCS}, w AS (SELECT id, unnest({toks(norm('body'))}) AS token FROM docs), n AS (SELECT id, token, count(*) AS n FROM w GROUP BY id, token), "
    "h AS (SELECT id, CAST(('0x' || sha256(token)[1:4]) AS INTEGER) % 384 AS i, CASE WHEN CAST(('0x' || sha256(token)[5:6]) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END * (1 + ln(n)) AS w FROM n), "
    "s AS (SELECT id, i, sum(w) AS w FROM h GROUP BY id, i), v AS (SELECT id, i, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS x FROM s) "
    f"SELECT id, CAST(i AS INTEGER) AS i, {fixed(fixed('x', 8), 6)} AS value FROM v WHERE x IS NOT NULL AND NOT isnan(x)"
)
def a02_token_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("id"), tokens(F.col("text")).alias("tokens"))
    return vectors.token_hash_components(docs, "id", "tokens").select("id", "i", to_fixed(F.col("value"), 6).alias("value"))


@query(f"WITH {PARTS}, {'t AS (SELECT DISTINCT id, unnest(tags) AS slug FROM cards)'} SELECT slug, count(*) AS support FROM t GROUP BY slug")
def a03_tag_support(spark: SparkSession, d: str) -> DataFrame:
    return con.tag_support(c.part_cards(spark, d))


@query(f"WITH {MEMBERS} SELECT id, card_count FROM concepts")
def a04_concept_sizes(spark: SparkSession, d: str) -> DataFrame:
    return con.concepts(_members(spark, d)).select("id", "card_count")


@query(f"WITH {_CO} SELECT source, CAST(sum(support) AS BIGINT) AS support, {fixed('max(weight)', 6)} AS strongest FROM (SELECT source, support, weight FROM rel UNION ALL SELECT target, support, weight FROM rel) GROUP BY source")
def a05_support(spark: SparkSession, d: str) -> DataFrame:
    co = con.co_occurrence(_members(spark, d))
    both = co.select("source", "support", "weight").union(co.select("target", "support", "weight"))
    return both.groupBy("source").agg(F.sum("support").alias("support"), to_fixed(F.max("weight"), 6).alias("strongest"))


@query(
    f"WITH {FEATURES}, b AS (SELECT l.id AS source, r.id AS target, {fixed(_J['cats'], 6)} AS categories, {fixed(_J['tags'], 6)} AS tags, {fixed(_J['rels'], 6)} AS relevance, {fixed(_J['acts'], 6)} AS actions, {_TAX} AS score "
    "FROM feat l JOIN feat r ON r.ord = l.ord + 1) SELECT * FROM b"
)
def a06_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Shared values of each card and the next, and their weighted score."""
    rows = relations.features(c.part_cards(spark, d))
    l, r = (rows.select(*(F.col(x).alias(f"{s}_{x}") for x in rows.columns)) for s in "lr")
    from ..functions.numeric import jaccard

    one = lambda x: to_fixed(jaccard(F.col(f"l_{x}"), F.col(f"r_{x}")), 6)
    return l.join(r, F.col("r_ord") == F.col("l_ord") + 1).select(
        F.col("l_id").alias("source"), F.col("r_id").alias("target"), one("cats").alias("categories"), one("tags").alias("tags"), one("rels").alias("relevance"), one("acts").alias("actions"), relations.taxonomy_score().alias("score")
    )


@query(
    f"WITH {PARTS} SELECT 'categories' AS facet, v AS value, count(*) AS n FROM (SELECT unnest(cats) AS v FROM cards) GROUP BY v UNION ALL SELECT 'tags', v, count(*) FROM (SELECT unnest(tags) AS v FROM cards) GROUP BY v "
    "UNION ALL SELECT 'actions', v, count(*) FROM (SELECT unnest(acts) AS v FROM cards) GROUP BY v UNION ALL SELECT 'status', status, count(*) FROM cards GROUP BY status UNION ALL SELECT 'high_relevance', 'overall', count(*) FROM cards WHERE overall >= 4"
)
def a09_facets(spark: SparkSession, d: str) -> DataFrame:
    return reader.facets(c.part_cards(spark, d))


@query(f"WITH {PARTS} SELECT status, string_agg(DISTINCT cats[1], ',' ORDER BY cats[1]) AS categories FROM cards GROUP BY status")
def a10_facet_lists(spark: SparkSession, d: str) -> DataFrame:
    cards = c.part_cards(spark, d).select(c.effective("status").alias("status"), F.get(c.effective_list("categories"), F.lit(0)).alias("v"))
    return cards.groupBy("status").agg(F.array_join(F.array_sort(F.collect_set("v")), ",").alias("categories"))


@query(f"WITH {_EDGE} SELECT id, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM (SELECT source AS id, type FROM edge UNION ALL SELECT target, type FROM edge) GROUP BY id")
def a11_relation_types(spark: SparkSession, d: str) -> DataFrame:
    return graph.relation_types(_edges(spark, d))


@query(f"WITH {MEMBERS} SELECT 'card:' || card_id AS node, count(*) AS degree FROM members GROUP BY card_id UNION ALL SELECT 'concept:' || concept_id, count(*) FROM members GROUP BY concept_id")
def a12_degrees(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d)
    return m.select(F.explode(F.array(F.concat(F.lit("card:"), "card_id"), F.concat(F.lit("concept:"), "concept_id"))).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


@query(f"WITH {DOCS} SELECT count(*) AS documents, count(*) FILTER (ord % 7 <> 0 AND ord % 5 <> 0) AS reused, count(*) FILTER (NOT (ord % 7 <> 0 AND ord % 5 <> 0)) AS rebuilt FROM docs")
def a13_index_stats(spark: SparkSession, d: str) -> DataFrame:
    new, old = _index(spark, d)
    return vectors.reuse(new, old, "id", "input_hash", []).agg(F.count(F.lit(1)).alias("documents"), F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("rebuilt"))


@query(f"WITH {PARTS} SELECT status, CASE WHEN count(*) FILTER (ord % 9 = 0) > 0 AND count(*) FILTER (ord % 9 <> 0) > 0 THEN 'llm-with-fallback' WHEN count(*) FILTER (ord % 9 = 0) > 0 THEN 'llm' ELSE 'semantic-fallback' END AS mode FROM cards GROUP BY status")
def a14_classifier_mode(spark: SparkSession, d: str) -> DataFrame:
    llm = F.col("ord") % 9 == 0
    found = c.part_cards(spark, d).groupBy(c.effective("status").alias("status")).agg(F.count_if(llm).alias("a"), F.count_if(~llm).alias("b"))
    return found.select("status", F.when((F.col("a") > 0) & (F.col("b") > 0), "llm-with-fallback").when(F.col("a") > 0, "llm").otherwise("semantic-fallback").alias("mode"))


@query(
    f"WITH {DOCS}, h AS (SELECT CAST('0x' || sha256(id || chr(1) || body)[1:15] AS HUGEINT) AS h FROM docs) "
    "SELECT sha256(count(*) || ':' || sum(h)) AS fingerprint, count(*) AS n FROM h"
)
def a15_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return search.fingerprint(c.document_cards(spark, d), "id", "body")


@query("SELECT source, count(DISTINCT lang) = 1 AS one_language, count(DISTINCT lang) AS languages FROM documents GROUP BY source")
def a16_provenance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg((F.count_distinct("lang") == 1).alias("one_language"), F.count_distinct("lang").alias("languages"))


@query("SELECT source, count(*) AS items, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes, greatest(0, 786432 - CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT)) AS left_bytes FROM documents GROUP BY source")
def a17_budgets(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"))
    return found.withColumn("left_bytes", F.greatest(F.lit(0).cast("long"), 786432 - F.col("bytes")))


@query(f"WITH {_POS} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, {fixed('((min(x) + max(x)) / 2)', 6)} AS center_x, {fixed('((min(y) + max(y)) / 2)', 6)} AS center_y FROM pos")
def a18_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = graph.bounds(graph.card_positions(_vectors(spark, d)))
    return b.withColumns({"center_x": to_fixed(F.col("center_x"), 6), "center_y": to_fixed(F.col("center_y"), 6)})


@query("SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS combined FROM conversations WHERE trim(coalesce(text, '')) <> '' GROUP BY conv_id")
def a19_combined_text(spark: SparkSession, d: str) -> DataFrame:
    return conv.combined_text(table(spark, d, "conversations")).select("conv_id", F.sha2(F.col("combined").cast("binary"), 256).alias("combined"))


@query("SELECT conv_id, CAST(CASE WHEN count(*) BETWEEN 2 AND 100 THEN 1 END AS INTEGER) AS index, CAST(CASE WHEN count(*) BETWEEN 2 AND 100 THEN count(*) END AS INTEGER) AS total FROM conversations GROUP BY conv_id")
def a20_indicator(spark: SparkSession, d: str) -> DataFrame:
    shown = table(spark, d, "conversations").groupBy("conv_id").agg(F.concat(F.lit("post 1 / "), F.count(F.lit(1)).cast("string"), F.lit(" and again 1/"), F.count(F.lit(1)).cast("string"), F.lit(" 7/3 0/9")).alias("text"))
    i = conv.indicator(F.col("text"))
    return shown.select("conv_id", i["index"].alias("index"), i["total"].alias("total"))


@query(f"SELECT event_type AS route, count(*) AS n, {fixed('sum(value)', 2)} AS total, {fixed('min(value)', 2)} AS fastest, {fixed('max(value)', 2)} AS slowest FROM events GROUP BY event_type")
def a22_route_counters(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "events").groupBy(F.col("event_type").alias("route"))
    return v.agg(F.count(F.lit(1)).alias("n"), to_fixed(F.sum("value"), 2).alias("total"), to_fixed(F.min("value"), 2).alias("fastest"), to_fixed(F.max("value"), 2).alias("slowest"))


# Ranking

_QUERY = "the station reading"


def _score_sql(field: str, weight: int) -> str:
    parts = []
    for token in sorted(set(_QUERY.split())):
        n = f"len(list_filter({field}_k, lambda w: w = '{token}'))"
        parts.append(f"CASE WHEN {n} > 0 THEN 1 + ln({n}) WHEN contains({field}, '{token}') THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END")
    return f"({' + '.join(parts)}) * {weight}"


def _hit_sql(field: str) -> str:
    return "CASE WHEN " + " OR ".join(f"contains({field}, '{k}')" for k in sorted(set(_QUERY.split()))) + f" THEN '{field}' END"


@query(
    f"WITH {DOCS}, n AS (SELECT id, docs.title AS shown, {norm('docs.title')} AS title, {norm('docs.summary')} AS summary, {norm(_META)} AS metadata, {norm('docs.body')} AS body FROM docs), "
    f"k AS (SELECT *, {toks('title')} AS title_k, {toks('summary')} AS summary_k, {toks('metadata')} AS metadata_k, {toks('body')} AS body_k FROM n), "
    f"s AS (SELECT id, shown, {_score_sql('title', 5)} + {_score_sql('summary', 3)} + {_score_sql('metadata', 2)} + {_score_sql('body', 1)} + CASE WHEN contains(title, '{_QUERY}') THEN 4 ELSE 0 END + CASE WHEN contains(summary, '{_QUERY}') THEN 2 ELSE 0 END AS x, "
    f"concat_ws(',', {_hit_sql('title')}, {_hit_sql('summary')}, {_hit_sql('metadata')}, {_hit_sql('body')}) AS matched_fields FROM k) "
    f"SELECT id, shown AS title, {fixed('x', 6)} AS score, matched_fields FROM s WHERE x > 0 ORDER BY {fixed('x', 6)} DESC, shown, id LIMIT 20"
)
def w01_search(spark: SparkSession, d: str) -> DataFrame:
    """Search without a stored index: documents that cannot match are left out before they are normalised."""
    fields, wanted = c.document_fields(), sorted(set(_QUERY.split()))
    some = c.document_cards(spark, d).where(search.may_match(list(fields.values()), wanted))
    return search.search(search.searchable(some, fields), _QUERY, wanted, 20)


@query(f"WITH {_SIM} SELECT id, count(*) AS n, {fixed('sum(similarity)', 4)} AS total FROM n WHERE rank <= 12 GROUP BY id")
def w02_neighbor_totals(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.nearest(_vectors(spark, d), k=12)
    return near.groupBy("id").agg(F.count(F.lit(1)).alias("n"), to_fixed(F.sum("similarity"), 4).alias("total"))


def _greedy_sql(edges: str, cap: int, name: str, order: str) -> str:
    """The greedy choice in rounds, as recursion: rows of `edges` under the name `name`. Edges that were taken and undecided ones go on."""
    return f"""{name}_o AS (SELECT *, row_number() OVER (ORDER BY {order}) AS o FROM {edges}),
{name}_r(k, o, u, v, taken) AS (
  SELECT 0, o, source, target, false FROM {name}_o
  UNION ALL
  SELECT k + 1, o, u, v, taken OR now FROM (
    SELECT k, o, taken, any_value(u) AS u, any_value(v) AS v, bool_and(place + used <= {cap}) AS now, bool_or(used >= {cap}) AS filled FROM (
      SELECT k, o, u, v, taken, x, row_number() OVER (PARTITION BY x, taken ORDER BY o) AS place, count(*) FILTER (WHERE taken) OVER (PARTITION BY x) AS used
      FROM (SELECT *, unnest([u, v]) AS x FROM {name}_r)
    ) GROUP BY k, o, taken
  ) WHERE (taken OR NOT filled) AND (SELECT bool_or(NOT taken) FROM {name}_r)
), {name} AS (SELECT * EXCLUDE (o) FROM {name}_o WHERE o IN (SELECT o FROM {name}_r WHERE taken))"""


_FOUND = "found AS (SELECT * FROM pairs WHERE (taxonomy >= 0.08 OR coalesce(semantic >= 0.2, false)) AND combined >= 0.3)"
_BEST = "combined DESC, source || '::' || target"


@query(f"WITH RECURSIVE {PAIRS}, {_FOUND}, {_greedy_sql('found', 12, 'best', _BEST)} SELECT source, target, taxonomy, semantic, raw, combined FROM best")
def w03_capped_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates among all cards, under the cap; each card lists some of its best partners at a time."""
    return relations.capped_candidates(_cards(spark, d), CONFIG, CONFIG.top_k)


@query(f"WITH RECURSIVE {_CO}, {_greedy_sql('rel', con.RELATION_TOP_K, 'best', 'weight DESC, support DESC, source || target')} SELECT source, target, support, weight FROM best")
def w05_capped_concepts(spark: SparkSession, d: str) -> DataFrame:
    return con.concept_relations(_members(spark, d))


@query(f"WITH {PARTS} SELECT id, CAST(row_number() OVER (ORDER BY updated_at DESC, title, id) AS INTEGER) AS place FROM cards ORDER BY 2 LIMIT 50")
def w07_listing(spark: SparkSession, d: str) -> DataFrame:
    top = reader.page(c.part_cards(spark, d), "r1", 50)[0]
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("updated_at"), "title", "id"))).select("id", "place")


@query(f"WITH {PARTS} SELECT id FROM cards ORDER BY updated_at DESC, title, id LIMIT 30 OFFSET 60")
def w08_cursor(spark: SparkSession, d: str) -> DataFrame:
    """The third page, by the cursors of the two before it."""
    cards, cursor = c.part_cards(spark, d), None
    for _ in range(3):
        found, cursor = reader.page(cards, "r1", 30, cursor)
    return found.select("id")


@query(f"WITH {PARTS} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM cards) GROUP BY tag ORDER BY n DESC, tag LIMIT 60")
def w10_top_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = c.part_cards(spark, d).select(F.explode(c.effective_list("tags")).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(60)


_DELTA = "CAST(floor((epoch_us(e.ts) - epoch_us(r.ts)) / 1e6 + 0.5) AS BIGINT)"
_ROOTS = "r AS (SELECT user_id, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS root FROM events GROUP BY user_id)"
_W12 = (
    "least(1.0::DOUBLE, floor((CASE e.event_id % 3 WHEN 0 THEN 0.45::DOUBLE WHEN 1 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN delta <= 300 THEN 0.35::DOUBLE WHEN delta <= 1800 THEN 0.25::DOUBLE WHEN delta <= 10800 THEN 0.15::DOUBLE "
    "WHEN delta <= 43200 THEN 0.08::DOUBLE WHEN delta <= 86400 THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END + 0.05::DOUBLE + 0.03::DOUBLE) * 1e3 + 0.5) / 1e3)"
)


@query(
    f"WITH {_ROOTS}, e AS (SELECT CAST(root AS VARCHAR) AS root, CAST(e.event_id AS VARCHAR) AS id, e.event_id, {_DELTA} AS delta FROM events e JOIN r USING (user_id) WHERE e.event_id <> root AND e.event_id % 3 <> 2), "
    f"s AS (SELECT root, id, delta, {_W12} AS score FROM e WHERE delta BETWEEN 0 AND 86400), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY root ORDER BY delta, score DESC, id) AS INTEGER) AS place FROM s) SELECT * FROM p WHERE place <= 8"
)
def w11_continuations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    roots = e.groupBy("user_id").agg(F.min("ts").alias("root_ts"), F.min_by("event_id", F.struct("ts", "event_id")).cast("string").alias("root"))
    k = F.col("event_id") % 3
    rows = e.join(roots, "user_id").select(
        "root", "root_ts", F.col("user_id").cast("string").alias("root_author"), F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("author"), "ts",
        F.when(k == 0, F.lit(True)).when(k == 2, F.lit(False)).alias("is_reply"), F.col("event_type").alias("text"), F.lit(True).alias("has_replies"),
    )
    return conv.continuations(rows)


@query("WITH x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) SELECT source, doc_id, n_chars FROM x WHERE k = 1")
def w14_richest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy("source").agg(F.min_by(F.struct("doc_id", "n_chars"), F.struct((-F.col("n_chars")).alias("a"), "doc_id")).alias("x")).select("source", "x.doc_id", "x.n_chars")


@query("WITH x AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY trim(coalesce(text, '')) = '', turn) AS k, role FROM conversations) SELECT conv_id, role, turn FROM x WHERE k = 1")
def w15_first_text(spark: SparkSession, d: str) -> DataFrame:
    return conv.first_text(table(spark, d, "conversations"), ["conv_id", "role"], "turn").select("conv_id", "role", "turn")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ingest.KINDS)), (F.col("doc_id") % 15).cast("int"))
    return table(spark, d, "documents").select(F.col("source").alias("repo"), F.concat("lang", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), kind.alias("kind"), (F.col("doc_id") % 10).cast("int").alias("priority"), F.col("n_chars").alias("bytes"))


@query()
def w16_packs(spark: SparkSession, d: str) -> DataFrame:
    return ingest.select_packs(_candidates(spark, d))


@query(
    "SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN 'documentation' ELSE 'source' END AS kind, CAST(doc_id % 10 * 1000 + CASE WHEN lang = 'en' THEN -700 WHEN lang = 'fr' THEN 700 WHEN lang = 'de' THEN 800 ELSE 150 END AS INTEGER) AS score FROM documents"
)
def w17_candidate_score(spark: SparkSession, d: str) -> DataFrame:
    of = F.create_map(*(F.lit(x) for x in ("en", "docs/architecture.md", "fr", "CONTRIBUTING.md", "de", "src/index.ts", "es", "src/types.ts")))
    kind = F.when(F.col("lang").isin("en", "fr"), F.lit("documentation")).otherwise(F.lit("source"))
    return table(spark, d, "documents").select("doc_id", kind.alias("kind"), ingest.candidate_score(of[F.col("lang")], kind, (F.col("doc_id") % 10).cast("int")).cast("int").alias("score"))


@query("SELECT page_id, length(list_reduce(list_prepend('', regexp_extract_all(html, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1)), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END)) AS n FROM pages")
def w18_largest_region(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.length(t.largest_region(F.col("html"))).cast("long").alias("n"))


# Sets


@query(f"WITH {_CO}, edge AS (SELECT a.id AS source, b.id AS target FROM cards a JOIN cards b ON b.ord = a.ord + 1) SELECT 'card-card' AS kind, count(*) AS n FROM edge UNION ALL SELECT 'card-concept', count(*) FROM members UNION ALL SELECT 'concept-concept', count(*) FROM rel")
def u01_edge_kinds(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d)
    return graph.edges(_edges(spark, d), m, con.co_occurrence(m)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {_CENTROID} SELECT 'card:' || c.id AS id, 'card' AS kind, c.title AS label, pos.x, pos.y FROM cards c JOIN pos ON pos.id = c.id "
    f"UNION ALL SELECT 'concept:' || k.id, 'concept', k.label, {fixed('coalesce(c.x, 0.0::DOUBLE)', 6)}, {fixed('coalesce(c.y, 0.0::DOUBLE)', 6)} FROM concepts k LEFT JOIN cen c ON c.concept_id = k.id"
)
def u02_nodes(spark: SparkSession, d: str) -> DataFrame:
    cards = c.part_cards(spark, d)
    m = con.memberships(cards, PROMOTED)
    named, placed = con.concepts(m), graph.card_positions(cards)
    return graph.nodes(cards, placed, named, graph.concept_positions(m, placed, named)).select("id", "kind", "label", "x", "y")


def _manual(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocked, overridden and pinned pairs, given in reverse order."""
    e = _edges(spark, d).withColumn("k", F.substring("source", -8, 8).try_cast("int"))
    turned = e.select("k", F.col("target").alias("source"), F.col("source").alias("target"))
    blocked = turned.where("k % 10 = 0").select("source", "target")
    none = lambda kind: F.lit(None).cast(kind)
    over = turned.where("k % 10 IN (0, 1)").select("source", "target", F.lit("extends").alias("type"), F.lit("source_to_target").alias("direction"), F.lit(0.9).alias("score"), F.lit("by hand").alias("note"))
    pinned = turned.where("k % 10 IN (1, 2)").select("source", "target", none("string").alias("type"), none("string").alias("direction"), none("double").alias("score"), F.lit("pin").alias("note"))
    return blocked, over, pinned


@query(
    f"WITH {_EDGE}, m AS (SELECT *, CAST(source[-8:] AS INTEGER) % 10 AS k FROM edge) SELECT pair_id, source, target, CASE WHEN k = 1 THEN 'extends' ELSE type END AS type, CASE WHEN k = 1 THEN 'target_to_source' ELSE direction END AS direction, "
    "CASE WHEN k = 1 THEN 0.9::DOUBLE ELSE score END AS score, CASE WHEN k IN (1, 2) THEN 'manual_pinned' ELSE method END AS method, CASE WHEN k = 1 THEN 'human' ELSE classifier END AS classifier, CASE WHEN k IN (1, 2) THEN 'pin' END AS note FROM m WHERE k <> 0"
)
def u03_overrides(spark: SparkSession, d: str) -> DataFrame:
    return relations.apply_overrides(_edges(spark, d), *_manual(spark, d))


@query(f"WITH {PARTS} SELECT id FROM cards WHERE overall >= 4 INTERSECT SELECT id FROM cards WHERE list_contains(tags, 'hot')")
def u04_intersect(spark: SparkSession, d: str) -> DataFrame:
    cards = c.part_cards(spark, d)
    return reader.filter_cards(cards, minimum=4).select("id").intersect(reader.filter_cards(cards, tags=("hot",)).select("id"))


@query(f"WITH {PARTS} SELECT id, array_to_string(list_sort(list_filter(tags, lambda x: x NOT IN ('hot', 'cold', 'red'))), ',') AS extra FROM cards")
def u05_difference(spark: SparkSession, d: str) -> DataFrame:
    return c.part_cards(spark, d).select("id", F.array_join(F.array_sort(F.array_except(c.effective_list("tags"), F.array(*map(F.lit, ("hot", "cold", "red"))))), ",").alias("extra"))


@query(f"WITH {PARTS} SELECT id, array_to_string(list_sort(list_filter(list_transform(cats, lambda x: x), lambda x: lower(x) IN ('economy', 'small', 'brand#2'))), ',') AS shared FROM cards")
def u06_shared_values(spark: SparkSession, d: str) -> DataFrame:
    """Values that two sets share whatever their case, as the left set writes them."""
    other = F.array(*map(F.lit, ("Economy ", "SMALL", "brand#2")))
    keys = c.tokens_of(other)
    shared = F.filter(c.effective_list("categories"), lambda v: F.array_contains(keys, F.lower(F.trim(v))))
    return c.part_cards(spark, d).select("id", F.array_join(F.array_sort(shared), ",").alias("shared"))


_ITEMS = "SELECT source AS bundle, lang || '/' || doc_id AS path, octet_length(encode(coalesce(text, ''))) AS bytes, sha256(coalesce(text, '')) AS sha256, doc_id FROM documents"


@query(
    f"WITH i AS ({_ITEMS}), b AS (SELECT * FROM i WHERE doc_id % 3 <> 0 UNION ALL SELECT * FROM i WHERE doc_id % 3 <> 1), n AS (SELECT bundle, path, count(*) AS n FROM b GROUP BY ALL) "
    "SELECT bundle, count(*) AS items, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(CAST(('0x' || sha256(path || ':' || sha256)[1:15]) AS HUGEINT)) AS VARCHAR) AS digest, (SELECT count(*) FROM n WHERE n.bundle IS NOT DISTINCT FROM b.bundle AND n > 1) AS duplicates FROM b GROUP BY bundle"
)
def u09_bundle_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two bundles of evidence a source put together and digested anew; a third of the paths are in both, which is an issue."""
    docs = table(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    items = docs.select("doc_id", F.col("source").alias("bundle"), F.concat("lang", F.lit("/"), "doc_id").alias("path"), F.octet_length(text).cast("long").alias("bytes"), F.sha2(text.cast("binary"), 256).alias("sha256"))
    return ingest.merge_bundles(items.where("doc_id % 3 <> 0").drop("doc_id"), items.where("doc_id % 3 <> 1").drop("doc_id"))


# Pages and urls


#: Urls of every branch with their provider, kind, canonical form and identity (null: as the canonical form says).
_SOURCES = (
    ("https://www.GitHub.com/Some-Owner/Repo.git/tree/main?x=1#top", "github", "github", "https://github.com/Some-Owner/Repo", "github:some-owner/repo"),
    ("http://github.com/a/b", "github", "github", "https://github.com/a/b", "github:a/b"),
    ("https://github.com/only-owner", None, None, None, None),
    ("https://github.com/a/b%20c", None, None, None, None),
    ("https://www.threads.net/@Me/post/Ab1?x=1", "threads", "article", "https://threads.com/@Me/post/Ab1", "threads:Ab1"),
    ("https://threads.com/share/S%201/", "threads", "article", "https://threads.com/share/S+1", None),
    ("https://threads.com/t/T1", "threads", "article", "https://threads.com/t/T1", None),
    ("https://threads.com/@Me/", None, None, None, None),
    ("ftp://example.org/a", None, None, None, None),
    ("not a url", None, None, None, None),
    ("https://Example.ORG:8443/A/b//?b=2&a=1&b=1&UTM_Source=x&ref=y#z", "generic", "article", "https://example.org:8443/A/b?a=1&b=2&b=1&ref=y", ""),
    ("HTTP://example.org:80", "generic", "article", "http://example.org/", ""),
    ("https://example.org:443/?fbclid=1&ref_url=2&Ref_Src=3&gclid=4&mc_cid=5&mc_eid=6", "generic", "article", "https://example.org/", ""),
    ("https://example.org/a?igshid=1&q=a%20b&flag", "generic", "article", "https://example.org/a?flag=&igshid=1&q=a+b", ""),
    ("https://export.arxiv.org/abs/1", "generic", "paper", "https://export.arxiv.org/abs/1", ""),
    ("https://youtu.be/x", "generic", "video", "https://youtu.be/x", ""),
    ("https://m.youtube.com/x", "generic", "article", "https://m.youtube.com/x", ""),
    ("https://docs.example.org/x/", "generic", "documentation", "https://docs.example.org/x", ""),
    ("https://example.org/en/Docs/1", "generic", "documentation", "https://example.org/en/Docs/1", ""),
    ("https://u:p@example.org/x", "generic", "article", "https://u:p@example.org/x", ""),
)


def _text_sql(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _sources_sql(*columns: int) -> str:
    rows = ((k, *(x[c] for c in columns)) for k, x in enumerate(_SOURCES))
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else _text_sql(x) for x in row) + ")" for row in rows)


_OWN_URL = (
    "regexp_extract(url, '^([a-z]+)://', 1) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || coalesce(nullif(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/') || "
    "coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&'), ''), '')"
)


def _given_urls(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, made, url): each page's own url, and beside it a made-up one of every kind."""
    made = F.get(F.array(*(F.lit(x[0]) for x in _SOURCES)), (F.col("page_id") % len(_SOURCES)).cast("int"))
    return table(spark, d, "pages").select("page_id", F.inline(F.array(F.struct(F.lit(False).alias("made"), F.col("url").alias("url")), F.struct(F.lit(True).alias("made"), made.alias("url")))))


_MADE = f"CAST(page_id % {len(_SOURCES)} AS INTEGER)"


@query(
    f"SELECT page_id, false AS made, {_OWN_URL} AS canonical, 'generic' AS provider, 'url:' || {_OWN_URL} AS identity FROM pages UNION ALL "
    f"SELECT page_id, true, m.canonical, m.provider, CASE WHEN m.identity = '' THEN 'url:' || m.canonical ELSE m.identity END FROM pages JOIN (VALUES {_sources_sql(1, 3, 4)}) m(k, provider, canonical, identity) ON m.k = {_MADE}"
)
def x11_canonical_url(spark: SparkSession, d: str) -> DataFrame:
    rows = _given_urls(spark, d).select("page_id", "made", urls.source_identity(F.col("url")).alias("s"))
    return rows.select("page_id", "made", "s.canonical", "s.provider", "s.identity")


@query(f"SELECT page_id, false AS made, 'article' AS kind FROM pages UNION ALL SELECT page_id, true, m.kind FROM pages JOIN (VALUES {_sources_sql(2)}) m(k, kind) ON m.k = {_MADE}")
def x12_source_type(spark: SparkSession, d: str) -> DataFrame:
    return _given_urls(spark, d).select("page_id", "made", urls.source_identity(F.col("url"))["source_type"].alias("kind"))


_NAMED = " ".join(f"WHEN '{k}' THEN {_text_sql(v)}" for k, v in t.ENTITIES.items())
_ENTITY_SQL = "(?i)&(?:#x[0-9a-f]+|#[0-9]+|[a-z]+);"


def decoded_sql(x: str) -> str:
    """Entities of x decoded once: the parts between them and what each stands for, put together again."""
    one = f"CASE WHEN e ILIKE '&#%' THEN ' ' ELSE coalesce(CASE lower(e[2:-2]) {_NAMED} END, e) END"
    return f"array_to_string(list_transform(list_zip(string_split_regex({x}, '{_ENTITY_SQL}'), list_transform(regexp_extract_all({x}, '{_ENTITY_SQL}'), lambda e: {one})), lambda p: p[1] || coalesce(p[2], '')), '')"


_PLAIN = (
    "array_to_string(list_filter(list_transform(string_split_regex(" + decoded_sql("regexp_replace(regexp_replace({m}, '(?i)</?(?:br|hr)\\b[^>]*>|</(?:h[1-6]|p|div|li|section|article|main|pre|tr|table|blockquote)>', chr(10), 'g'), '<[^>]+>', ' ', 'g')")
    + ", '\r?\n'), lambda x: regexp_replace(regexp_replace(x, '[\\t \\x{{00a0}}]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10))"
)


def _cleaned() -> str:
    out = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for group in map("|".join, t.ASIDE):
        out = f"regexp_replace({out}, '(?is)<(?:{group})\\b[^>]*>.*?</(?:{group})\\s*>', ' ', 'g')"
    return out


_PAGE = f"""c AS (SELECT page_id, html, {_cleaned()} AS m FROM pages),
b AS (SELECT page_id, html, list_reduce(list_prepend('', regexp_extract_all(m, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1)), lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END) AS region FROM c),
p AS (SELECT page_id, {_PLAIN.replace('{m}', 'region').replace('{{', '{').replace('}}', '}')} AS text, {_PLAIN.replace('{m}', "regexp_extract(region, '(?is)<h1{BS}b[^>]*>(.*?)</h1{BS}s*>', 1)".replace('{BS}', chr(92))).replace('{{', '{').replace('}}', '}')} AS h FROM b)"""


@query(f"WITH {_PAGE} SELECT page_id, trim(string_split(h, chr(10))[1]) AS title, sha256(text) AS text_sha256, length(text) AS n, length(text) >= 240 AND trim(string_split(h, chr(10))[1]) <> '' AS complete FROM p")
def x15_page_text(spark: SparkSession, d: str) -> DataFrame:
    region = t.page_body(F.col("html"))
    rows = table(spark, d, "pages").select("page_id", "html", region.alias("region")).select("page_id", t.plain_lines(F.col("region")).alias("text"), t.page_title(F.col("html"), F.col("region")).alias("title"))
    return rows.select("page_id", "title", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.length("text").cast("long").alias("n"), t.page_complete(F.col("title"), F.col("text")).alias("complete"))


@query("SELECT doc_id, 'own' AS blob, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM documents UNION ALL SELECT doc_id, unnest(['cut', 'wrong', 'large']), NULL FROM documents")
def x16_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Every text as a blob, and beside it one whose bytes are no text, one that is no base64, and the text where it is too large."""
    from ..sources.files import decode_blob

    own = F.concat(F.coalesce("text", F.lit("")).cast("binary"))
    blobs = F.array(*(F.struct(F.lit(k).alias("blob"), v.alias("b")) for k, v in (("own", F.base64(own)), ("cut", F.base64(F.concat(own, F.unhex(F.lit("C328"))))), ("wrong", F.concat(F.lit("%"), F.base64(own))))))
    docs = table(spark, d, "documents")
    found = docs.select("doc_id", F.inline(blobs)).select("doc_id", "blob", F.length(decode_blob(F.col("b"), 1 << 30)).cast("long").alias("n"))
    large = docs.select("doc_id", F.lit("large").alias("blob"), F.length(decode_blob(F.base64(F.concat(own, F.lit("x").cast("binary"))), 0)).cast("long").alias("n"))
    return found.unionByName(large)


@query("SELECT o_orderkey, false AS made, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders UNION ALL SELECT o_orderkey, true, CASE WHEN month(o_orderdate) IN (1, 3, 5, 7, 8, 10, 12) THEN strftime(o_orderdate, '%Y-%m') || '-31' END FROM orders")
def x18_dates(spark: SparkSession, d: str) -> DataFrame:
    """Every order's date, and beside it the 31st of its month, which not all months have."""
    raw = F.array(F.struct(F.lit(False).alias("made"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("raw")), F.struct(F.lit(True).alias("made"), F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-31")).alias("raw")))
    return table(spark, d, "orders").select("o_orderkey", F.inline(raw)).select("o_orderkey", "made", t.valid_day(F.col("raw")).alias("day"))


#: Files of every rule, and files that no rule takes, with kind and priority.
_FILES = (
    ("README.md", "readme", 0), ("a/readme", None, None), ("SECURITY.md", "security", 0), ("LICENSE", "license", 1), ("COPYING", "license", 1), ("LICENCE.txt", "license", 1), ("LICENCE", None, None),
    ("package.json", "manifest", 1), ("x/Gemfile", "manifest", 1), ("Dockerfile", "deployment", 2), ("docker-compose.yml", "deployment", 2), ("fly.toml", "deployment", 2),
    (".github/workflows/ci.yml", "deployment", 2), ("x/.github/workflows/ci.yml", "configuration", 5), ("k8s/a.yaml", "deployment", 2), ("docs/architecture.md", "documentation", 1),
    ("docs/logo.png", None, None), ("notes.mdx", "documentation", 3), ("doc/conf.py", "documentation", 3), ("src/auth/token.ts", "auth", 2), ("src/secrets.py", "security", 2), ("src/queue.py", "background_job", 3),
    ("db/a.sql", "data_model", 3), ("src/routes/a.go", "api", 4), ("src/api/a.bin", None, None), ("src/server-action.ts", "api", 4), ("config.yaml", "configuration", 5), ("x.ini", "configuration", 5),
    (".env", None, None), ("prod.env", "configuration", 5), ("src/main.rs", "entrypoint", 4), ("main.txt", None, None), ("tests/a_test.py", "test", 8), ("src/a.spec.ts", "test", 8), ("src/core/x.py", "source", 7), ("x.py", None, None),
    ("lib/a.kts", "source", 7), ("lib/a.scala", None, None), ("yarn.lock", None, None), ("bun.lockb", None, None), ("src/x.min.js", None, None), ("img.png", None, None), ("Makefile", None, None), ("src/a.", None, None),
)


@query(
    "SELECT doc_id, k.kind, CAST(k.priority AS INTEGER) AS priority FROM documents JOIN (VALUES " + ", ".join(f"({i}, {_text_sql(kind)}, {'NULL' if p is None else p})" for i, (_, kind, p) in enumerate(_FILES)) + f") k(i, kind, priority) ON k.i = doc_id % {len(_FILES)}"
)
def x19_classify_files(spark: SparkSession, d: str) -> DataFrame:
    path = F.get(F.array(*(F.lit(x[0]) for x in _FILES)), (F.col("doc_id") % len(_FILES)).cast("int"))
    k = ingest.classify_path(path)
    return table(spark, d, "documents").select("doc_id", k["kind"].alias("kind"), k["priority"].alias("priority"))


@query(f"WITH {PARTS} SELECT id, sha256(concat_ws(chr(1), 'local', 'hash', 'v1', summary)) AS content_hash FROM cards")
def x28_embedding_hash(spark: SparkSession, d: str) -> DataFrame:
    return c.part_cards(spark, d).select("id", F.sha2(F.concat_ws("\x01", F.lit("local"), F.lit("hash"), F.lit("v1"), "summary").cast("binary"), 256).alias("content_hash"))


@query("SELECT source, count(*) AS documents, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes, CAST(sum(CAST(('0x' || sha256(coalesce(text, ''))[1:15]) AS HUGEINT)) AS VARCHAR) AS digest FROM documents GROUP BY source")
def k05_manifest(spark: SparkSession, d: str) -> DataFrame:
    return release.source_manifest(table(spark, d, "documents"), "source", "text")


# Graphs, threads, builds


@query(f"WITH {_POSTS} SELECT id, conv_id || ':0' AS root, CASE WHEN turn = 0 THEN 'target_root' ELSE 'walked_parent_chain' END AS reason FROM posts")
def r02_roots(spark: SparkSession, d: str) -> DataFrame:
    return conv.roots(conv.posts(table(spark, d, "conversations")))


@query(f"WITH {_POSTS}, f AS (SELECT conv_id, min(turn) FILTER (username <> first) AS stop, max(turn) + 1 AS n FROM (SELECT *, first_value(username) OVER (PARTITION BY conv_id ORDER BY turn) AS first FROM posts) GROUP BY conv_id) SELECT conv_id, CAST(coalesce(stop, n) AS BIGINT) AS length, conv_id || ':' || (coalesce(stop, n) - 1) AS last, false AS ambiguous FROM f")
def r03_author_chain(spark: SparkSession, d: str) -> DataFrame:
    return conv.author_chains(conv.posts(table(spark, d, "conversations")))


@query(
    "SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'AMBIGUOUS_THREAD' WHEN conv_id % 5 = 1 THEN CASE WHEN n = 1 THEN 'SINGLE_POST' ELSE 'COMPLETE_THREAD' END WHEN conv_id % 5 = 2 THEN 'INCOMPLETE_THREAD' "
    "WHEN conv_id % 5 = 3 THEN CASE WHEN n = 1 THEN 'SINGLE_POST' ELSE 'COMPLETE_THREAD' END ELSE 'INCOMPLETE_THREAD' END AS status, "
    "CASE WHEN conv_id % 5 = 0 THEN 'same_author_branch' WHEN conv_id % 5 = 2 THEN 'missing_parts' WHEN conv_id % 5 = 4 THEN 'input_not_in_author_chain' END AS reason FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)"
)
def r04_completeness(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("conv_id") % 5
    n = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("detected"))
    rows = n.select(
        "conv_id", "detected", (k == 0).alias("ambiguous"), F.lit(False).alias("conflict"), F.when(k == 2, F.col("detected") + 1).when(k == 3, F.col("detected")).alias("total"), F.lit(1).alias("index"),
        F.when(k == 4, -1).otherwise(0).alias("input_at"), (k == 1).alias("coverage"), F.lit(None).cast("boolean").alias("last_has_replies"), F.lit(False).alias("single"),
    )
    return conv.completeness(rows).select("conv_id", "status", "reason")


@query(
    f"WITH RECURSIVE {PAIRS}, {_FOUND}, {_greedy_sql('found', 12, 'best', _BEST)}, {_greedy_sql('best', 3, 'few', _BEST)}, "
    "manual AS (SELECT a.id || '::' || b.id AS pair_id, a.id AS source, b.id AS target, CAST(a.id[-8:] AS INTEGER) % 10 AS k FROM cards a JOIN cards b ON b.ord = a.ord + 1), "
    f"made AS (SELECT source || '::' || target AS pair_id, source, target, CASE WHEN coalesce(semantic, 0.0::DOUBLE) >= 0.62 AND taxonomy >= 0.32 THEN 'similar_to' ELSE 'complements' END AS type, {fixed('(combined * 0.65::DOUBLE + ' + fixed('greatest(0.35::DOUBLE, least(0.78::DOUBLE, combined))', 4) + ' * 0.35::DOUBLE)', 4)} AS score "
    "FROM few WHERE combined >= 0.48), g AS (SELECT * FROM made WHERE pair_id NOT IN (SELECT pair_id FROM manual WHERE k = 0)), m AS (SELECT * FROM manual WHERE k IN (1, 2)) "
    "SELECT coalesce(g.pair_id, m.pair_id) AS pair_id, coalesce(g.source, m.source) AS source, coalesce(g.target, m.target) AS target, CASE WHEN k = 1 THEN 'extends' ELSE coalesce(type, 'similar_to') END AS type, "
    "CASE WHEN k = 1 THEN 'target_to_source' ELSE 'undirected' END AS direction, CASE WHEN k = 1 THEN 0.9::DOUBLE ELSE coalesce(score, 1.0::DOUBLE) END AS score, CASE WHEN k IS NOT NULL THEN 'manual_pinned' ELSE 'semantic_fallback_v1' END AS method, "
    "CASE WHEN k = 1 OR g.pair_id IS NULL THEN 'human' ELSE 'heuristic-fallback' END AS classifier, CASE WHEN k IS NOT NULL THEN 'pin' END AS note FROM g FULL JOIN m ON g.pair_id = m.pair_id"
)
def r08_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations of all cards, with manual entries."""
    return relations.build_relations(_cards(spark, d), CONFIG, *_manual(spark, d))[1]


@query(f"WITH {MEMBERS} SELECT card_id, concept_id, origin, strength FROM members")
def r09_memberships(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d).select("card_id", "concept_id", "origin", "strength")


_MADE_EDGES = (
    f"made AS (SELECT source || '::' || target AS pair_id, source, target, CASE WHEN coalesce(semantic, 0.0::DOUBLE) >= 0.62 AND taxonomy >= 0.32 THEN 'similar_to' ELSE 'complements' END AS type, "
    f"{fixed('(combined * 0.65::DOUBLE + ' + fixed('greatest(0.35::DOUBLE, least(0.78::DOUBLE, combined))', 4) + ' * 0.35::DOUBLE)', 4)} AS score FROM few WHERE combined >= 0.48)"
)


def _graph_edge_sql(kind: str, a: str, b: str, left: str, right: str, rest: str) -> str:
    return f"SELECT '{kind}:' || {a} || '::' || {b} AS id, '{kind}' AS kind, '{left}:' || {a} AS source, '{right}:' || {b} AS target, {rest}"


@query(
    f"WITH RECURSIVE {PAIRS}{_CO[len(PARTS):]}, {_FOUND}, {_greedy_sql('found', 12, 'best', _BEST)}, {_greedy_sql('best', 3, 'few', _BEST)}, {_MADE_EDGES}, {_greedy_sql('rel', con.RELATION_TOP_K, 'together', 'weight DESC, support DESC, source || target')} "
    + _graph_edge_sql("card-card", "source", "target", "card", "card", "type AS relation_type, 'undirected' AS direction, score AS weight, 'semantic_fallback_v1' AS method, NULL AS origin, NULL AS support FROM made UNION ALL ")
    + _graph_edge_sql("card-concept", "card_id", "concept_id", "card", "concept", "'supports', 'source_to_target', strength, NULL, origin, NULL FROM members UNION ALL ")
    + _graph_edge_sql("concept-concept", "source", "target", "concept", "concept", "'co_occurs_with', 'undirected', weight, NULL, NULL, support FROM together")
)
def r10_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the graph that the whole build makes of all cards."""
    return build_artifacts(_cards(spark, d), CONFIG, PROMOTED)["edges"]


@query(
    f"WITH {PARTS} SELECT id AS key, 'vectors_missing' AS code FROM cards WHERE vector IS NULL OR ord % 10 = 3 UNION ALL SELECT id, 'vector_dimensions' FROM cards WHERE vector IS NOT NULL AND ord % 10 = 4 "
    "UNION ALL SELECT id, 'search_repeats' FROM cards WHERE ord % 10 = 5 UNION ALL SELECT id, 'search_missing' FROM cards WHERE ord % 10 = 6 UNION ALL SELECT 'gone-' || id, 'search_unknown_card' FROM cards WHERE ord % 10 = 7"
)
def f14_artifact_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues of the artifacts of all cards, made faulty on purpose: each card needs one vector and one search entry."""
    cards, k = _cards(spark, d), F.col("ord") % 10
    members = _members(spark, d)
    made = {"relations": _edges(spark, d), "concepts": con.concepts(members), "members": members, "concept_relations": con.concept_relations(members)}
    entries = cards.where(k != 6).select(F.when(k == 7, F.array("id", F.concat(F.lit("gone-"), "id"))).when(k == 5, F.array("id", "id")).otherwise(F.array("id")).alias("x"))
    vectors_ = cards.where((k != 3) & F.col("vector").isNotNull()).select("id", F.when(k == 4, F.slice("vector", 1, 3)).otherwise(F.col("vector")).alias("vector"))
    return publishable(made | {"search": entries.select(F.explode("x").alias("id")), "vectors": vectors_}, cards, 64)


@query(f"WITH {DOCS}, f AS (SELECT id, ord, title, ord % 7 = 0 AS new, ord % 5 = 0 AS changed, ord % 3 = 0 AS seen FROM docs) SELECT id, CASE WHEN changed AND seen THEN title || '!' ELSE title END AS title, CASE WHEN new THEN '2024-06-01' ELSE '2024-01-01' END AS created_at, CASE WHEN new OR (seen AND changed) THEN '2024-06-01' ELSE '2024-01-01' END AS updated_at, CASE WHEN new THEN 'created' WHEN NOT seen THEN 'kept' WHEN changed THEN 'updated' ELSE 'checked' END AS action FROM f WHERE seen OR NOT new")
def r12_upsert(spark: SparkSession, d: str) -> DataFrame:
    docs, k = c.document_cards(spark, d), F.col("ord")
    cards = docs.where(k % 7 != 0).select("id", "title", F.lit("2024-01-01").alias("created_at"), F.lit("2024-01-01").alias("updated_at"))
    seen = docs.where(k % 3 == 0).select("id", F.when(k % 5 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")).alias("title"))
    return ingest.upsert(cards, seen, ["title"], "2024-06-01")


@query(f"WITH {PARTS}, x AS (SELECT id, ord, unnest(tags) AS tag FROM cards) SELECT id, string_agg(DISTINCT CASE WHEN tag IN ('red', 'blue') THEN 'color' ELSE tag END, ',' ORDER BY CASE WHEN tag IN ('red', 'blue') THEN 'color' ELSE tag END) AS tags FROM x GROUP BY id")
def r13_tag_migration(spark: SparkSession, d: str) -> DataFrame:
    """Cards' tags through a policy in which some tags have become aliases."""
    cards = c.part_cards(spark, d).select("id", F.explode(c.effective_list("tags")).alias("value"))
    tags = cards.select("value").distinct()
    policy = tags.select(F.col("value").alias("name"), F.when(F.col("value").isin("red", "blue"), F.lit("color")).otherwise(F.col("value")).alias("tag"), F.when(F.col("value").isin("red", "blue"), F.lit("alias")).otherwise(F.lit("canonical")).alias("kind"))
    return cards.join(validate.resolve_tags(tags, policy), "value").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


@query(
    f"WITH {_POSTS}, h AS (SELECT conv_id, CAST('0x' || sha256(id || '|' || coalesce(text, ''))[1:15] AS HUGEINT) AS h FROM posts) SELECT conv_id, sha256(count(*) || ':' || sum(h)) AS digest FROM h GROUP BY conv_id"
)
def r16_handoff_digest(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of each conversation as a digest that its posts' order does not change."""
    posts = conv.posts(table(spark, d, "conversations"))
    return validate.set_hash(posts, "conv_id", F.concat("id", F.lit("|"), F.coalesce("text", F.lit(""))))


@query(
    "WITH b AS (SELECT source, count(*) AS items, CAST(sum(n_chars) AS BIGINT) AS bytes, CAST(substring(source, 4) AS BIGINT) AS k FROM documents GROUP BY source) "
    "SELECT source, CASE WHEN k % 4 = 0 THEN 'stop' WHEN k % 3 = 2 THEN 'stop' WHEN items >= 400 THEN 'stop' WHEN bytes >= 120000 THEN 'stop' ELSE 'expand' END AS action, "
    "CASE WHEN k % 4 = 0 THEN 'plan_complete' WHEN k % 3 = 2 THEN 'round_budget_exhausted' WHEN items >= 400 THEN 'item_budget_exhausted' WHEN bytes >= 120000 THEN 'byte_budget_exhausted' ELSE 'needs_evidence' END AS reason FROM b"
)
def t04_continuation(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.sum("n_chars").alias("bytes"))
    k = F.substring("source", 4, 9).cast("long")
    rows = b.withColumns({"open_questions": k % 4, "rounds": k % 3, "max_rounds": F.lit(2).cast("long"), "max_items": F.lit(400).cast("long"), "max_bytes": F.lit(120000).cast("long")})
    return ingest.continuation(rows).select("source", "action", "reason")


@query(f"SELECT date_trunc('hour', ts) AS start, event_type AS route, count(*) AS n, {fixed('sum(value)', 2)} AS total, {fixed('max(value)', 2)} AS largest FROM events GROUP BY 1, 2")
def t07_metric_windows(spark: SparkSession, d: str) -> DataFrame:
    m = incremental.metrics(table(spark, d, "events"), "ts", "event_type", "value")
    return m.withColumns({"total": to_fixed(F.col("total"), 2), "largest": to_fixed(F.col("largest"), 2)})


@query(f"WITH {PARTS}, v AS (SELECT id, CAST(ord AS INTEGER) AS ord, vector FROM cards) SELECT id, vector IS NULL OR len(vector) = 64 AS fits FROM v")
def v04_vector_contract(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that break the contract would stop the query."""
    rows = c.part_cards(spark, d)
    return rows.select("id", F.when(F.col("vector").isNull(), True).otherwise(F.size(vectors.checked(F.col("vector"), 64)) == 64).alias("fits"))


@query(f"WITH {_EDGE} SELECT pair_id, unnest(['direction_must_be_undirected']) AS code FROM edge WHERE type = 'similar_to' AND CAST(source[-8:] AS INTEGER) % 6 = 1 UNION ALL SELECT pair_id, 'confidence_out_of_range' FROM edge WHERE CAST(source[-8:] AS INTEGER) % 11 = 0")
def f13_classifier_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.substring("source", -8, 8).try_cast("int")
    rows = _edges(spark, d).withColumns({"k": k}).withColumns({
        "direction": F.when((F.col("type") == "similar_to") & (F.col("k") % 6 == 1), F.lit("source_to_target")).otherwise(F.col("direction")),
        "confidence": F.when(F.col("k") % 11 == 0, F.lit(1.5)).otherwise(F.lit(0.5)),
        "related": F.lit(True),
        "reason": F.lit("shared values"),
    })
    return relations.classifier_issues(rows)
