"""Queries of the engine's own operators over the test tables, each with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls
from ..functions.numeric import cosine, fnv1a, jaccard, normalize_similarity, project_2d, to_fixed
from ..operators import cards as c
from ..operators import concepts as con
from ..operators import conversations as conv
from ..operators import graph, ingest, reader, relations, release, search, validate, vectors
from ..operators.cards import table
from ..streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def fixed(x: str, k: int) -> str:
    return f"(sign({x}) * floor(abs({x}) * 1e{k} + 0.5) / 1e{k} + 0.0)"


PARTS = """cards AS (
  SELECT 'part-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS id, p_partkey AS ord, p_name AS title, concat_ws(' ', p_name, p_type, p_brand) AS summary,
    'https://parts.example.org/' || replace(p_name, ' ', '/') || '/' || p_partkey AS canonical_url,
    strftime(DATE '2024-01-01' + CAST(p_partkey % 60 AS INTEGER), '%Y-%m-%d') AS created_at,
    strftime(DATE '2024-01-01' + CAST(p_partkey % 97 AS INTEGER), '%Y-%m-%d') AS updated_at,
    CASE WHEN p_size % 7 = 0 THEN [p_brand] ELSE [p_type] END AS cats,
    CASE WHEN p_size % 11 = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split(p_name, ' ') END AS tags,
    [p_type] AS nav, [p_brand] AS acts,
    CASE WHEN p_partkey % 13 = 0 THEN 5 ELSE 1 + p_size % 5 END AS overall, CAST(1 + p_partkey % 5 AS INTEGER) AS engineering,
    CASE WHEN p_size > 45 THEN 'archived' ELSE 'active' END AS status, CAST(embedding AS DOUBLE[]) AS vector
  FROM part LEFT JOIN embeddings ON vec_id = p_partkey
)"""
DOCS = """docs AS (
  SELECT 'doc-' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AS id, d.doc_id AS ord, coalesce(text, '') AS body,
    substring(string_split(coalesce(text, ''), chr(10))[1], 1, 80) AS title, substring(coalesce(text, ''), 1, 600) AS summary, lang, source,
    CASE WHEN toxic = 1 THEN 'archived' ELSE 'active' END AS status, coalesce(quality, 0) AS quality
  FROM documents d LEFT JOIN labels USING (doc_id)
)"""


def norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[\\x00-\\x1f\\x7f]', ' ', 'g'), '[\\s\\x0b\\x85\\p{{Z}}]+', ' ', 'g'))".replace("{{", "{").replace("}}", "}")


TOKEN = r"[\p{L}\p{N}]+(?:[-_+.][\p{L}\p{N}]+)*"


def toks(x: str) -> str:
    return f"list_filter(regexp_extract_all({x}, '{TOKEN}'), lambda w: length(w) > 1 OR regexp_matches(w, '\\p{{N}}'))".replace("{{", "{").replace("}}", "}")


def tokens(x: Column) -> Column:
    return t.tokenize(t.normalize_search_text(x, compatible=False))


# Projections


@query(f"WITH {PARTS} SELECT id, array_to_string(cats, ',') AS categories, array_to_string(tags, ',') AS tags, status FROM cards")
def p01_effective(spark: SparkSession, d: str) -> DataFrame:
    return c.part_cards(spark, d).select(
        "id", F.array_join(c.effective("categories"), ",").alias("categories"), F.array_join(c.effective("tags"), ",").alias("tags"), c.effective("status").alias("status")
    )


@query(f"WITH {PARTS} SELECT id, overall, engineering FROM cards")
def p02_relevance(spark: SparkSession, d: str) -> DataFrame:
    r = c.effective_relevance()
    return c.part_cards(spark, d).select("id", r["overall"].alias("overall"), r["engineering"].alias("engineering"))


@query(f"WITH {DOCS} SELECT id, sha256(regexp_replace(body, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g')) AS overview, source AS notes FROM docs")
def p03_section(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("# Card\n\n## Overview\n"), F.col("body"), F.lit("\n## Notes\n"), F.col("source"))
    return c.document_cards(spark, d).withColumn("card", body).select(
        "id", F.sha2(t.section(F.col("card"), "Overview").cast("binary"), 256).alias("overview"), t.section(F.col("card"), "Notes").alias("notes")
    )


@query(f"WITH {DOCS} SELECT id, sha256({norm('body')}) AS text_hash, length({norm('body')}) AS n FROM docs")
def p04_normalize(spark: SparkSession, d: str) -> DataFrame:
    text = t.normalize_search_text(F.col("body"))
    return c.document_cards(spark, d).select("id", F.sha2(text.cast("binary"), 256).alias("text_hash"), F.length(text).cast("long").alias("n"))


@query(f"WITH {DOCS} SELECT id, len({toks(norm('body'))}) AS n_tokens, sha256(array_to_string({toks(norm('body'))}, ' ')) AS tokens_hash FROM docs")
def p05_tokenize(spark: SparkSession, d: str) -> DataFrame:
    rows = c.document_cards(spark, d).select("id", tokens(F.col("body")).alias("k"))
    return rows.select("id", F.size("k").cast("long").alias("n_tokens"), F.sha2(F.array_join("k", " ").cast("binary"), 256).alias("tokens_hash"))


def _term_sql(field: str) -> str:
    return f"SELECT token, '{field}' AS field, id, count(*) AS n FROM (SELECT id, unnest({toks(norm(field))}) AS token FROM docs) GROUP BY id, token"


@query(f"WITH {DOCS} {' UNION ALL '.join(map(_term_sql, ('title', 'summary', 'body')))}")
def p06_term_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each token stands in each field of each document: the postings of the whole index."""
    names = ("title", "summary", "body")
    index = c.document_cards(spark, d).select("id", *(tokens(F.col(x)).alias(f"{x}_tokens") for x in names))
    return search.postings(index, "id", names)


_META = "concat_ws(' ', lang, source, status)"


@query(
    f"WITH {DOCS}, f AS (SELECT id, {norm('title')} AS a, {norm('summary')} AS b, {norm(_META)} AS m, {norm('body')} AS t FROM docs) "
    f"SELECT id, m AS metadata, len({toks('b')}) AS summary_tokens, len({toks('t')}) AS body_tokens, sha256(a || chr(1) || b || chr(1) || m || chr(1) || t) AS input_hash FROM f"
)
def p07_search_document(spark: SparkSession, d: str) -> DataFrame:
    index = search.index_documents(c.document_cards(spark, d), c.document_fields())
    return index.select("id", F.col("metadata_text").alias("metadata"), *(F.size(f"{x}_tokens").cast("long").alias(f"{x}_tokens") for x in ("summary", "body")), "input_hash")


_COMPACT = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?s)```.*?```', ' ', 'g'), "
    "'`([^`]+)`', '\\1', 'g'), '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g'), '[#>*_~|]', ' ', 'g'), '[\\s\\x0b\\x85\\p{{Z}}]+', ' ', 'g'))"
)


@query(f"WITH {DOCS} SELECT id, sha256({_COMPACT.format(x='body')}) AS compact_hash, length({_COMPACT.format(x='body')}) AS n FROM docs")
def p08_compact_markdown(spark: SparkSession, d: str) -> DataFrame:
    text = t.compact_markdown(F.col("body"))
    return c.document_cards(spark, d).select("id", F.sha2(text.cast("binary"), 256).alias("compact_hash"), F.length(text).cast("long").alias("n"))


_EMBED = (
    "concat_ws(chr(10), 'Title: ' || title, 'Summary: ' || summary, trim('Categories: ' || array_to_string(cats, ', ')), trim('Tags: ' || array_to_string(tags, ', ')), "
    "'Actions: ' || array_to_string(acts, ', '), 'Relevance: engineering=' || engineering || ', overall=' || overall)"
)


@query(f"WITH {PARTS} SELECT id, replace({_EMBED}, '#', ' ') AS text FROM cards")
def p09_embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return c.part_cards(spark, d).select("id", c.embedding_text().alias("text"))


@query(
    f"WITH {PARTS}, v AS (SELECT id, unnest(list_concat(list_concat(cats, tags), [summary || ' & more'])) AS value FROM cards) SELECT DISTINCT value, "
    f"regexp_replace(regexp_replace(replace({norm('value')}, '&', ' and '), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM v".replace("{{", "{").replace("}}", "}")
)
def p10_concept_slug(spark: SparkSession, d: str) -> DataFrame:
    value = F.explode(F.concat(c.effective_list("categories"), c.effective_list("tags"), F.array(F.concat("summary", F.lit(" & more")))))
    return c.part_cards(spark, d).select(value.alias("value")).distinct().select("value", con.slug(F.col("value")).alias("slug"))


@query("SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def p11_id_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", t.id_slug(F.col("url")).alias("slug"))


@query(f"WITH {PARTS} SELECT id, array_to_string(list_sort(list_distinct(list_transform(list_concat(cats, tags), lambda x: lower(trim(x))))), ',') AS tokens FROM cards")
def p12_taxonomy_tokens(spark: SparkSession, d: str) -> DataFrame:
    both = F.concat(c.effective_list("categories"), c.effective_list("tags"))
    return c.part_cards(spark, d).select("id", F.array_join(F.array_sort(c.tokens_of(both)), ",").alias("tokens"))


_XY = "list_sum(list_transform(v, lambda a, i: a * sin(i * 12.9898::DOUBLE))) AS x, list_sum(list_transform(v, lambda a, i: a * cos(i * 78.233::DOUBLE))) AS y"
_POS = f"""e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL), raw AS (SELECT id, label, {_XY} FROM e),
m AS (SELECT max(greatest(abs(x), abs(y))) AS m FROM raw), pos AS (SELECT id, label, {fixed('x / m', 6)} AS x, {fixed('y / m', 6)} AS y FROM raw, m)"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vector"))


@query(f"WITH {_POS} SELECT id, {fixed('x', 6)} AS x, {fixed('y', 6)} AS y FROM raw")
def p13_project(spark: SparkSession, d: str) -> DataFrame:
    p = _vectors(spark, d).select("id", project_2d(F.col("vector")).alias("p"))
    return p.select("id", to_fixed(F.col("p.x"), 6).alias("x"), to_fixed(F.col("p.y"), 6).alias("y"))


@query(f"WITH {_POS} SELECT id, x, y FROM pos")
def p14_positions(spark: SparkSession, d: str) -> DataFrame:
    return graph.card_positions(_vectors(spark, d))


@query("SELECT l_orderkey AS orderkey, l_linenumber AS line, least('part-' || lpad(CAST(l_partkey AS VARCHAR), 8, '0'), 'supp-' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0')) || '::' || greatest('part-' || lpad(CAST(l_partkey AS VARCHAR), 8, '0'), 'supp-' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0')) AS pair_key FROM lineitem")
def p15_pair_key(spark: SparkSession, d: str) -> DataFrame:
    a, b = (F.concat(F.lit(f"{n}-"), F.lpad(F.col(k).cast("string"), 8, "0")) for n, k in (("supp", "l_suppkey"), ("part", "l_partkey")))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), relations.pair_key(a, b).alias("pair_key"))


@query(
    f"WITH {PARTS} SELECT id, title, summary, canonical_url, array_to_string(cats, ',') AS categories, array_to_string(tags, ',') AS tags, array_to_string(nav, ',') AS navigation, "
    "array_to_string(acts, ',') AS actions, CAST(overall AS INTEGER) AS overall, status, created_at, updated_at FROM cards"
)
def p16_card_summary(spark: SparkSession, d: str) -> DataFrame:
    return c.part_cards(spark, d).select(*c.summary_columns())


_CAT_MEMBERS = "category AS (SELECT id, ord, unnest(cats) AS v FROM cards), tag0 AS (SELECT id, ord, unnest(tags) AS v FROM cards), okay AS (SELECT v FROM tag0 GROUP BY v HAVING count(DISTINCT id) >= 2)"


def _slug_sql(v: str) -> str:
    return f"regexp_replace(regexp_replace(replace(lower(trim({v})), '&', ' and '), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')".replace("{{", "{").replace("}}", "}")


MEMBERS = f"""{PARTS}, {_CAT_MEMBERS}, members AS (
  SELECT id AS card_id, ord, 'category-' || {_slug_sql('v')} AS concept_id, 'category' AS origin, 1.0::DOUBLE AS strength, v AS label FROM category
  UNION ALL SELECT id, ord, 'tag-' || {_slug_sql('v')}, 'tag', 0.8::DOUBLE, v FROM tag0 WHERE v IN (SELECT v FROM okay)
  UNION ALL SELECT id, ord, 'hot-things', 'promoted', 0.8::DOUBLE, 'Hot things' FROM cards WHERE list_contains(tags, 'hot')
), concepts AS (SELECT concept_id AS id, arg_min(label, ord) AS label, count(*) AS card_count FROM members GROUP BY concept_id)"""
PROMOTED = (con.Promoted("hot-things", "Hot things", "theme", (), ("hot",)),)


def _members(spark: SparkSession, d: str) -> DataFrame:
    return con.memberships(c.part_cards(spark, d), PROMOTED)


@query(
    f"WITH {MEMBERS}, k AS (SELECT card_id, string_agg(concept_id, ',' ORDER BY concept_id) AS concepts, count(*) AS n FROM members GROUP BY card_id) "
    "SELECT c.id, c.title, coalesce(k.concepts, '') AS concepts, coalesce(k.n, 0) AS n FROM cards c LEFT JOIN k ON k.card_id = c.id"
)
def p17_card_detail(spark: SparkSession, d: str) -> DataFrame:
    cards = c.part_cards(spark, d)
    k = con.memberships(cards, PROMOTED).groupBy("card_id").agg(F.array_join(F.array_sort(F.collect_list("concept_id")), ",").alias("concepts"), F.count(F.lit(1)).alias("n"))
    return cards.join(k, F.col("id") == F.col("card_id"), "left").select("id", "title", F.coalesce("concepts", F.lit("")).alias("concepts"), F.coalesce("n", F.lit(0)).alias("n"))


@query("WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS tag FROM part) SELECT tag, upper(tag[1]) || tag[2:] AS label FROM w")
def p18_tag_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("tag")).distinct().select("tag", F.concat(F.upper(F.substring("tag", 1, 1)), F.expr("substring(tag, 2)")).alias("label"))


_POSTS = """posts AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS id, role AS username, text, CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS reply_to,
    conv_id || ':0' AS root_post, turn < max(turn) OVER (PARTITION BY conv_id) AS has_replies, turn > 0 AS is_reply FROM conversations
)"""


@query(f"WITH {_POSTS} SELECT id, username, reply_to, root_post, has_replies, is_reply, length(coalesce(text, '')) AS n FROM posts")
def p20_posts(spark: SparkSession, d: str) -> DataFrame:
    return conv.posts(table(spark, d, "conversations")).select("id", "username", "reply_to", "root_post", "has_replies", "is_reply", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))


@query("SELECT event_id, unnest(['millis', 'seconds', 'text', 'word']) AS form, unnest([epoch_us(ts) // 1000000, epoch_us(ts) // 1000000, epoch_us(ts) // 1000000, NULL]) AS seconds FROM events")
def p22_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Every event's time in milliseconds, in seconds and as text, and with a word before it, which is no time."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    forms = F.array(*(F.struct(F.lit(k).alias("form"), v.alias("raw")) for k, v in (("millis", F.unix_millis("ts").cast("string")), ("seconds", F.unix_seconds("ts").cast("string")), ("text", text), ("word", F.concat(F.lit("soon "), text)))))
    return e.select("event_id", F.inline(forms)).select("event_id", "form", F.unix_seconds(t.normalize_timestamp(F.col("raw"))).alias("seconds"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE ' ' || upper(event_type) || '-X' END AS kind FROM events")
def p25_evidence_kind(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.upper("event_type"), F.when(F.col("event_type").isin("click", "view"), F.lit(" ")).otherwise(F.lit("-X")))
    return table(spark, d, "events").select("event_id", ingest.normalize_kind(raw, ("click", "view")).alias("kind"))


_POLICY = "policy AS (SELECT DISTINCT p_type AS name, lower(p_type) AS tag, 'canonical' AS kind FROM part UNION SELECT DISTINCT lower(p_brand), 'brand', 'alias' FROM part)"


@query(
    f"WITH {_POLICY}, v AS (SELECT p_type AS value FROM part UNION SELECT lower(p_type) FROM part UNION SELECT p_brand FROM part UNION SELECT p_name FROM part), r AS ("
    "SELECT value, tag, CASE kind WHEN 'canonical' THEN 0 ELSE 1 END + CASE WHEN value = name THEN 0 ELSE 2 END AS rank FROM v JOIN policy ON lower(value) = lower(name)) "
    "SELECT v.value, arg_min(r.tag, r.rank) AS tag FROM v LEFT JOIN r USING (value) GROUP BY v.value"
)
def p26_resolve_tags(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    policy = part.select(F.col("p_type").alias("name"), F.lower("p_type").alias("tag"), F.lit("canonical").alias("kind")).union(part.select(F.lower("p_brand"), F.lit("brand"), F.lit("alias"))).distinct()
    values = part.select(F.explode(F.array("p_type", F.lower("p_type"), "p_brand", "p_name")).alias("value"))
    return validate.resolve_tags(values, policy)


@query(
    "SELECT p_brand, CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_brand, ''), lambda x: CAST(ascii(x) AS BIGINT))), "
    "lambda h, b: (xor(h, b) * 16777619) % 4294967296) % 12 AS BIGINT) AS bucket FROM (SELECT DISTINCT p_brand FROM part)"
)
def p27_color_bucket(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_brand").distinct().select("p_brand", (fnv1a(F.col("p_brand")) % 12).alias("bucket"))


@query(
    f"WITH {_POS}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, least(720.0::DOUBLE / greatest(max(x) - min(x), 1e-6), 520.0::DOUBLE / greatest(max(y) - min(y), 1e-6)) AS s FROM pos) "
    f"SELECT id, {fixed('(400.0::DOUBLE + (x - (x0 + x1) / 2) * s)', 4)} AS px, {fixed('(300.0::DOUBLE + (y - (y0 + y1) / 2) * s)', 4)} AS py FROM pos, b"
)
def p28_viewport(spark: SparkSession, d: str) -> DataFrame:
    return graph.fit_viewport(graph.card_positions(_vectors(spark, d)), 800.0, 600.0, 40.0)


@query(f"WITH {PARTS} SELECT DISTINCT cats[1] AS category, CAST(greatest(1, least(5, overall)) AS INTEGER) AS relevance FROM cards")
def p29_legend(spark: SparkSession, d: str) -> DataFrame:
    score = F.greatest(F.lit(1), F.least(F.lit(5), c.effective_relevance()["overall"]))
    return c.part_cards(spark, d).select(F.get(c.effective_list("categories"), F.lit(0)).alias("category"), score.alias("relevance")).distinct()


@query("SELECT page_id, 'web:' || url AS source_identity, sha256(html) AS content_sha256, octet_length(encode(html)) AS bytes FROM pages")
def p30_source_state(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("web:"), "url").alias("source_identity"), F.sha2(F.col("html").cast("binary"), 256).alias("content_sha256"), F.octet_length("html").cast("long").alias("bytes"))


@query(
    "SELECT page_id, CASE WHEN contains(url, '.example.com') THEN 'shop:' || page_id WHEN contains(url, '.example.net') THEN 'net:' || sha256(url)[1:8] ELSE 'url:' || url END AS identity FROM pages"
)
def p32_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Rows go to their provider's builder and come together again."""
    pages = table(spark, d, "pages").withColumn("provider", F.when(F.contains("url", F.lit(".example.com")), "shop").when(F.contains("url", F.lit(".example.net")), "net").otherwise("generic"))
    build = {
        "shop": F.concat(F.lit("shop:"), F.col("page_id")),
        "net": F.concat(F.lit("net:"), F.substring(F.sha2(F.col("url").cast("binary"), 256), 1, 8)),
        "generic": F.concat(F.lit("url:"), F.col("url")),
    }
    out = F.lit(None).cast("string")
    for name, identity in build.items():
        out = F.when(F.col("provider") == name, identity).otherwise(out)
    return pages.select("page_id", out.alias("identity"))


@query(
    f"WITH {PARTS}, s AS (SELECT id, list_concat(list_concat(list_transform(cats, lambda v: 'category:' || v), list_transform(tags, lambda v: 'tag:' || v)), list_transform(acts, lambda v: 'action:' || v)) AS sig FROM cards) "
    "SELECT id, array_to_string(list_transform(sig[1:4], lambda v: regexp_replace(v, '^[a-z]+:', '')), ', ') AS shown FROM s"
)
def p33_explanation(spark: SparkSession, d: str) -> DataFrame:
    signals = lambda x, kind: F.transform(c.effective_list(x), lambda v: F.concat(F.lit(kind), v))
    named = F.concat(signals("categories", "category:"), signals("tags", "tag:"), signals("actions", "action:"))
    first = F.slice(F.array_distinct(named), 1, 4)
    return c.part_cards(spark, d).select("id", F.array_join(F.transform(first, lambda v: F.regexp_replace(v, "^[a-z]+:", "")), ", ").alias("shown"))


# Validators and filters


@query(f"WITH {PARTS}, v AS (SELECT DISTINCT id, unnest(cats) AS value FROM cards) SELECT id AS key, value FROM v WHERE value NOT IN (SELECT p_type FROM part WHERE p_type IS NOT NULL)")
def f02_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    vocab = table(spark, d, "part").select(F.col("p_type").alias("value")).distinct()
    found = validate.unknown_values(c.part_cards(spark, d), "id", c.effective_list("categories"), vocab, "categories")
    return found.select("key", F.regexp_replace("message", "^unknown value: ", "").alias("value"))


@query(f"WITH {PARTS} SELECT id, ord % 4 <> 1 AS fits FROM cards")
def f03_key_set(spark: SparkSession, d: str) -> DataFrame:
    """Whether a card's relevance has exactly the configured dimensions."""
    dims = F.when(F.col("ord") % 4 == 1, F.array(F.lit("overall"))).otherwise(F.array(F.lit("overall"), F.lit("engineering")))
    return c.part_cards(spark, d).select("id", F.array_sort(F.map_keys(c.effective_relevance())).eqNullSafe(F.array_sort(dims)).alias("fits"))


@query(
    f"WITH {PARTS} SELECT id AS key, 'tag_count' AS code FROM cards WHERE len(tags) NOT BETWEEN 1 AND 2 UNION ALL SELECT id, 'tags_not_sorted' FROM cards WHERE list_sort(tags) <> tags "
    "UNION ALL SELECT id, 'value_unknown' FROM (SELECT DISTINCT id, unnest(tags) AS v FROM cards) WHERE v IN ('old', 'new')"
)
def f04_tag_policy(spark: SparkSession, d: str) -> DataFrame:
    cards = c.part_cards(spark, d)
    known = cards.select(F.explode(c.effective_list("tags")).alias("value")).distinct().where(~F.col("value").isin("old", "new"))
    return validate.tag_policy(cards, "id", c.effective_list("tags"), known, 1, 2).select("key", "code")


@query(f"WITH {PARTS} SELECT id AS key, 'updated_before_created' AS code, 'updated_at' AS path FROM cards WHERE updated_at < created_at")
def f07_date_order(spark: SparkSession, d: str) -> DataFrame:
    return validate.date_order(c.part_cards(spark, d), "id").select("key", "code", "path")


@query(
    "WITH v AS (SELECT doc_id, 'text' AS path, sha256(text) AS value FROM documents), f AS (SELECT *, min(doc_id) OVER (PARTITION BY path, value) AS first FROM v WHERE value IS NOT NULL) "
    "SELECT CAST(doc_id AS VARCHAR) AS key, 'not_unique' AS code, path, 'first used by ' || first AS message FROM f WHERE doc_id <> first"
)
def f08_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return validate.duplicates(docs, "doc_id", "doc_id", {"text": F.sha2(F.col("text").cast("binary"), 256)})


@query(f"WITH {PARTS} SELECT id AS key, 'tags' AS field FROM cards JOIN part ON p_partkey = ord WHERE p_size % 11 = 0 AND ord % 3 = 0 UNION ALL SELECT id, 'status' FROM cards WHERE status = 'archived' AND ord % 5 = 0")
def f09_owned_changes(spark: SparkSession, d: str) -> DataFrame:
    before = c.part_cards(spark, d)
    gone = lambda x: F.struct(F.col(f"{x}.ai").alias("ai"), F.lit(None).cast(before.select(f"{x}.user").schema[0].dataType).alias("user"))
    after = before.withColumns({"tags": F.when(F.col("ord") % 3 == 0, gone("tags")).otherwise(F.col("tags")), "status": F.when(F.col("ord") % 5 == 0, gone("status")).otherwise(F.col("status"))})
    return validate.owned_changes(before, after, "id", ["tags", "status", "categories"])


#: Addresses and hosts of every rule's branch, with what is right for them.
_HOSTS = (
    ("https://a.example.org/x", True), ("http://A-b.Example.ORG:80/", True), ("https://a.example.org:443", True), ("https://a.example.org:8443/", False),
    ("ftp://a.example.org/", False), ("https://u:p@a.example.org/", False), ("https://localhost/", False), ("https://db.internal/", False),
    ("https://1.0.0.127.in-addr.arpa/", False), ("https://-a.example.org/", False), ("https://a-.example.org/", False), ("https://8.8.8.8/", False),
    ("https://[2001:4860::1]/", False), ("https://printer.local/x", False), ("https://nas.lan/", False), ("https://a.home/", True), ("https://x.onion/y?z", True),
    ("https://a.test/", False), ("https://a.invalid", False), ("https://a.example", False), ("//a.example.org/", False), ("https://a..b.org/", False),
)
_ADDRESSES = (
    ("8.8.8.8", True), ("192.0.0.9", False), ("192.0.1.0", False), ("192.0.255.1", False), ("192.1.0.1", True), ("192.88.99.1", False), ("192.88.98.1", True),
    ("198.20.0.1", True), ("198.51.100.7", False), ("203.0.113.1", False), ("203.0.114.1", True), ("256.1.1.1", False), ("01.2.3.4", False), ("1.2.3", False),
    ("2606:4700::1111", True), ("2001:4860:4860::8888", True), ("2002:808:808::1", False), ("2001:0:1::1", False), ("2001::1", False), ("2001:10::1", False),
    ("2001:20::1", False), ("2001:db8::1", False), ("2001:0db8::1", False), ("2001:DB8:1:2:3:4:5:6", False), ("::ffff:8.8.8.8", False), ("::1", False), ("fe80::1", False),
    ("fc00::1", False), ("ff02::1", False), ("4000::1", False), ("3fff:ffff::1", True), ("2606:4700:1:2:3:4:5:6", True), ("2606:4700:1:2:3:4:5", False),
    ("2606::1::2", False), ("2606:12345::1", False), ("2606:4700::1.2.3.4", True), ("2606:4700:", False), ("", False),
)


def _values(pairs: tuple) -> str:
    return ", ".join(f"({k}, {right})" for k, (_, right) in enumerate(pairs))


@query(
    "SELECT page_id, false AS made, NOT regexp_matches(split_part(split_part(url, '://', 2), '/', 1), '(^|\\.)-|-(\\.|$|[?#:])') AS safe FROM pages UNION ALL "
    f"SELECT page_id, true, h.safe FROM pages JOIN (VALUES {_values(_HOSTS)}) h(k, safe) ON k = page_id % {len(_HOSTS)}"
)
def f15_url_safety(spark: SparkSession, d: str) -> DataFrame:
    """Every page's own url, and beside it a made-up one of every kind."""
    made = F.get(F.array(*(F.lit(url) for url, _ in _HOSTS)), (F.col("page_id") % len(_HOSTS)).cast("int"))
    rows = table(spark, d, "pages").select("page_id", F.inline(F.array(F.struct(F.lit(False).alias("made"), F.col("url").alias("url")), F.struct(F.lit(True).alias("made"), made.alias("url")))))
    return rows.select("page_id", "made", urls.is_safe_public(F.col("url")).alias("safe"))


@query(
    "WITH a AS (SELECT event_id, event_id * 2654435761 % 256 AS p, event_id * 40503 % 256 AS q, event_id % 256 AS r FROM events) SELECT event_id, CASE WHEN event_id % 3 = 0 THEN h.public ELSE NOT (p IN (0, 10, 127) OR p >= 224 OR (p = 100 AND q BETWEEN 64 AND 127) "
    "OR (p = 169 AND q = 254) OR (p = 172 AND q BETWEEN 16 AND 31) OR (p = 192 AND q IN (0, 168)) OR (p = 192 AND q = 88 AND r = 99) OR (p = 198 AND q IN (18, 19)) OR (p = 198 AND q = 51 AND r = 100) OR (p = 203 AND q = 0 AND r = 113)) END AS public "
    f"FROM a JOIN (VALUES {_values(_ADDRESSES)}) h(k, public) ON k = event_id % {len(_ADDRESSES)}"
)
def f16_public_address(spark: SparkSession, d: str) -> DataFrame:
    """Made-up IPv4 addresses, and addresses of every kind for every third event."""
    e, made = F.col("event_id"), F.array(*(F.lit(address) for address, _ in _ADDRESSES))
    address = F.concat_ws(".", (e * 2654435761 % 256).cast("string"), (e * 40503 % 256).cast("string"), (e % 256).cast("string"), F.lit("7"))
    given = F.when(e % 3 == 0, made[(e % len(_ADDRESSES)).cast("int")]).otherwise(address)
    return table(spark, d, "events").select("event_id", urls.is_public_address(given).alias("public"))


@query("SELECT doc_id, doc_id % 15 IN (12, 13) AND doc_id % 4 = 0 AS low_signal FROM documents")
def f17_low_signal(spark: SparkSession, d: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ingest.KINDS)), (F.col("doc_id") % 15).cast("int"))
    path = F.concat("lang", F.lit("/"), F.when(F.col("doc_id") % 4 == 0, F.lit("__init__.py")).otherwise(F.concat("doc_id", F.lit(".py"))))
    return table(spark, d, "documents").select("doc_id", ingest.low_signal(path, kind).alias("low_signal"))


@query("SELECT page_id, page_id % 4 = 0 AS safe FROM pages")
def f18_path_safety(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    path = F.when(k % 4 == 0, F.concat(F.lit("docs/"), k)).when(k % 4 == 1, F.concat(F.lit("docs/../"), k)).when(k % 4 == 2, F.concat(F.lit("/docs/"), k)).otherwise(F.concat(F.lit("docs\\"), k))
    return table(spark, d, "pages").select("page_id", urls.is_safe_path(path).alias("safe"))


@query("SELECT CAST(doc_id AS VARCHAR) AS key, 'digest_differs' AS code FROM documents WHERE doc_id % 10 = 3 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'bytes_differ' FROM documents WHERE doc_id % 10 = 4")
def f19_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Recomputes what an evidence row claims of its text."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.sha2(F.when(k % 10 == 3, F.concat(text, F.lit("!"))).otherwise(text).cast("binary"), 256).alias("sha"), (F.octet_length(text) + F.when(k % 10 == 4, 1).otherwise(0)).alias("bytes"))
    return validate.check(rows, "doc_id", {"digest_differs": (F.col("sha") != F.sha2(F.col("text").cast("binary"), 256), "sha"), "bytes_differ": (F.col("bytes") != F.octet_length("text"), "bytes")}).select("key", "code")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, 'reference_missing' AS code FROM orders WHERE o_orderkey % 97 = 0")
def f20_foreign_key(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("cust", F.when(F.col("o_orderkey") % 97 == 0, F.lit(-1).cast("long")).otherwise(F.col("o_custkey")))
    return validate.missing_parent(orders, "o_orderkey", F.col("cust"), table(spark, d, "customer"), "c_custkey", "customer").select("key", "code")


@query(f"WITH {PARTS} SELECT id, title FROM cards WHERE list_has_any(cats, ['ECONOMY', 'SMALL']) AND overall >= 3 AND status = 'active' AND contains(lower(title || ' ' || summary || ' ' || status || ' ' || array_to_string(cats, ' ') || ' ' || array_to_string(tags, ' ') || ' ' || array_to_string(acts, ' ')), 'gear')")
def f26_facet_filter(spark: SparkSession, d: str) -> DataFrame:
    return reader.filter_cards(c.part_cards(spark, d), categories=("ECONOMY", "SMALL"), statuses=("active",), minimum=3, needle=" Gear ").select("id", "title")


@query(f"WITH {MEMBERS} SELECT DISTINCT c.id FROM cards c WHERE list_has_any(tags, ['red', 'blue']) AND overall >= 2 AND (contains(lower(title), 'bolt') OR c.id IN (SELECT card_id FROM members JOIN concepts k ON k.id = concept_id WHERE contains(lower(k.label), 'hot')))")
def f28_search_with_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Cards that match a filter and are found themselves, or by a concept that is found."""
    cards = c.part_cards(spark, d)
    members = con.memberships(cards, PROMOTED)
    named = con.concepts(members).where(F.contains(F.lower("label"), F.lit("hot"))).select(F.col("id").alias("concept_id"))
    by_concept = members.join(named, "concept_id", "left_semi").select(F.col("card_id").alias("id"))
    direct = cards.where(F.contains(F.lower("title"), F.lit("bolt"))).select("id")
    return reader.filter_cards(cards, tags=("red", "blue"), minimum=2).select("id").intersect(direct.union(by_concept))


_SIM = f"""e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (
  SELECT a.id, b.id AS other, {fixed('list_cosine_similarity(a.v, b.v)', 6)} AS similarity FROM e a JOIN e b ON a.id <> b.id
), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM s)"""


@query(f"WITH {_SIM} SELECT id, other, similarity FROM n WHERE rank <= 12 AND {fixed('(1 - similarity)', 6)} <= 0.7")
def f29_neighborhood(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.nearest(_vectors(spark, d), k=12)
    return near.where(to_fixed(1 - F.col("similarity"), 6) <= 0.7).select("id", "other", "similarity")


@query(
    "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents), "
    "m AS (SELECT doc_id, line, 'license' AS code, unnest(regexp_extract_all(x, '\\b[Ll]icensed? under\\b')) AS match FROM l UNION ALL SELECT doc_id, line, 'email', unnest(regexp_extract_all(x, '[A-Za-z0-9.]+@[A-Za-z0-9.]+')) FROM l) "
    "SELECT doc_id AS key, code, CAST(line AS INTEGER) AS line, match FROM m"
)
def f33_policy_patterns(spark: SparkSession, d: str) -> DataFrame:
    return validate.policy_patterns(table(spark, d, "documents"), "doc_id", "text", {"license": r"\b[Ll]icensed? under\b", "email": r"[A-Za-z0-9.]+@[A-Za-z0-9.]+"})


@query(f"WITH {PARTS} SELECT id, cats[1] AS now FROM cards JOIN part ON p_partkey = ord WHERE cats[1] <> p_type")
def f34_stale_plan(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a plan whose expected value is no longer the current one."""
    cards = c.part_cards(spark, d).select("id", F.get(c.effective_list("categories"), F.lit(0)).alias("now"), F.get(F.col("navigation.ai"), F.lit(0)).alias("expected"))
    return cards.where(~F.col("now").eqNullSafe(F.col("expected"))).select("id", "now")


@query(f"WITH {_POSTS}, s AS (SELECT conv_id, count(*) AS n FROM posts GROUP BY conv_id) SELECT conv_id, n = 1 AND conv_id % 2 = 1 AS unverified FROM s")
def f39_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Single posts with replies whose coverage nothing proves."""
    p = conv.posts(table(spark, d, "conversations")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return p.select("conv_id", ((F.col("n") == 1) & (F.col("conv_id") % 2 == 1)).alias("unverified"))
