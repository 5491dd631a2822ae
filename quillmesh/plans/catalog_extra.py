"""Queries on contracts, research, files and states; see catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schema, text, urls
from ..operators import cards as c, ingest, threads
from ..operators import contracts, graph, reader, relations, validate, vectors
from ..operators import conversations as conv
from ..operators.cards import table
from ..operators.rounds import shared_folder
from ..sources import files, json_walk, sinks
from ..streaming import incremental
from .catalog import _POSTS, DOCS, PARTS, query
from .catalog_more import _EDGE, _edges, _index

PART_SCHEMA = {
    "type": "object",
    "required": ["p_name", "p_type"],
    "properties": {
        "p_name": {"type": "string", "minLength": 8, "maxLength": 11, "pattern": "^[a-z ]+$"},
        "p_type": {"enum": ["ECONOMY", "SMALL", "MEDIUM", "LARGE"]},
        "p_size": {"type": "integer", "minimum": 3, "maximum": 48},
        "p_brand": {"$ref": "#/defs/brand"},
    },
    "defs": {"brand": {"oneOf": [{"pattern": "^Brand#1"}, {"pattern": "^Brand#[0-9]$"}]}},
}


@query(
    "SELECT p_partkey AS key, unnest(list_filter([CASE WHEN length(p_name) < 8 THEN 'minLength' END, CASE WHEN length(p_name) > 11 THEN 'maxLength' END, CASE WHEN p_type NOT IN ('ECONOMY', 'SMALL', 'MEDIUM', 'LARGE') THEN 'enum' END, "
    "CASE WHEN p_size < 3 THEN 'minimum' END, CASE WHEN p_size > 48 THEN 'maximum' END, CASE WHEN (CASE WHEN p_brand LIKE 'Brand#1%' THEN 1 ELSE 0 END + CASE WHEN length(p_brand) = 7 THEN 1 ELSE 0 END) <> 1 THEN 'one_of' END], lambda x: x IS NOT NULL)) AS code FROM part"
)
def f01_schema(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    found = schema.issues(F.struct("p_name", "p_type", "p_size", "p_brand"), PART_SCHEMA)
    return part.select(F.col("p_partkey").alias("key"), F.explode(found).alias("i")).select("key", "i.code")


@query(
    "WITH c AS (SELECT DISTINCT lower(p_type) AS id, upper(p_type) AS label FROM part UNION SELECT DISTINCT p_type, p_type FROM part), a AS (SELECT DISTINCT p_brand AS alias, lower(p_type) AS target FROM part WHERE p_partkey < 0 UNION SELECT lower(r_name), lower(r_name) FROM region UNION SELECT DISTINCT lower(p_type), lower(p_type) FROM part) "
    "SELECT id AS key, 'id_not_kebab' AS code FROM c WHERE NOT regexp_full_match(id, '[a-z0-9]+(-[a-z0-9]+)*') UNION ALL SELECT id, 'label_repeats' FROM (SELECT id, min(id) OVER (PARTITION BY lower(label)) AS f FROM c) WHERE id <> f "
    "UNION ALL SELECT alias, 'alias_is_canonical' FROM a WHERE alias IN (SELECT id FROM c) UNION ALL SELECT alias, 'alias_target_unknown' FROM a WHERE target NOT IN (SELECT id FROM c)"
)
def f05_policy_self_check(spark: SparkSession, d: str) -> DataFrame:
    part, region = table(spark, d, "part"), table(spark, d, "region")
    canonical = part.select(F.lower("p_type").alias("id"), F.upper("p_type").alias("label")).union(part.select("p_type", "p_type")).distinct()
    aliases = region.select(F.lower("r_name").alias("alias"), F.lower("r_name").alias("target")).union(part.select(F.lower("p_type"), F.lower("p_type"))).distinct()
    return contracts.policy_issues(canonical, aliases)


@query(
    f"WITH {DOCS} SELECT id AS key, unnest(list_filter([CASE WHEN ord % 4 = 1 THEN 'section_missing:Notes' END, CASE WHEN ord % 4 = 2 THEN 'section_order:Notes' END, CASE WHEN ord % 3 = 0 THEN 'h1_not_title' END], lambda x: x IS NOT NULL)) AS code FROM docs"
)
def f06_body(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("ord")
    head = F.when(k % 3 == 0, F.lit("Other")).otherwise(F.col("id"))
    body = F.when(k % 4 == 1, F.lit("## Summary\nx\n")).when(k % 4 == 2, F.lit("## Notes\ny\n## Summary\nx\n")).otherwise(F.lit("## Summary\nx\n## Notes\ny\n"))
    docs = c.document_cards(spark, d).select("id", F.concat(F.lit("# "), head, F.lit("\n\n"), body).alias("body"))
    return docs.select(F.col("id").alias("key"), F.explode(contracts.body_issues(F.col("body"), F.col("id"), ("Summary", "Notes"))).alias("code"))


@query(
    "SELECT CAST(o_orderkey AS VARCHAR) AS key, unnest(list_filter([CASE WHEN o_orderkey % 13 = 0 THEN 'card_differs' END, CASE WHEN o_orderkey % 17 = 0 THEN 'digest_malformed' END, CASE WHEN o_orderkey % 19 = 0 THEN 'checked_before_captured' END], lambda x: x IS NOT NULL)) AS code FROM orders"
)
def f21_state_links(spark: SparkSession, d: str) -> DataFrame:
    """Research states against the cards they name: same card, well-formed digest, dates in order."""
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders")
    cards = orders.select(k.alias("card_key"), F.concat(F.lit("card-"), k).alias("card_id"))
    states = orders.select(
        "o_orderkey", F.concat(F.lit("card-"), F.when(k % 13 == 0, k + 1).otherwise(k)).alias("state_card"), F.when(k % 17 == 0, F.lit("xyz")).otherwise(F.sha2(k.cast("string").cast("binary"), 256)).alias("digest"),
        F.lit("2024-01-02").alias("captured"), F.when(k % 19 == 0, F.lit("2024-01-01")).otherwise(F.lit("2024-01-03")).alias("checked"),
    )
    joined = states.join(cards, F.col("o_orderkey") == F.col("card_key"))
    return validate.check(joined, "o_orderkey", {
        "card_differs": (~F.col("state_card").eqNullSafe(F.col("card_id")), "card_id"),
        "digest_malformed": (~F.col("digest").rlike("^[0-9a-f]{64}$"), "digest"),
        "checked_before_captured": (F.col("checked") < F.col("captured"), "checked"),
    }).select("key", "code")


@query(
    "SELECT doc_id AS key, lang AS dimension, CASE doc_id % 6 WHEN 1 THEN 'refs_required' WHEN 2 THEN 'reason_required' WHEN 3 THEN 'ref_unknown' WHEN 4 THEN 'status_invalid' WHEN 5 THEN 'reason_not_allowed' END AS code FROM documents WHERE doc_id % 6 <> 0"
)
def f22_coverage(spark: SparkSession, d: str) -> DataFrame:
    k, docs = F.col("doc_id") % 6, table(spark, d, "documents")
    one = lambda x: F.array(F.concat(F.lit(x), "doc_id"))
    rows = docs.select(
        F.col("doc_id").alias("key"), F.col("lang").alias("dimension"), F.when(k == 2, "unavailable").when(k == 4, "great").otherwise("supported").alias("status"), F.lit("note").alias("note"),
        F.when(k.isin(1, 2), F.array().cast("array<string>")).when(k == 3, one("none-")).otherwise(one("e-")).alias("refs"), F.when(k == 5, F.lit("no access")).alias("unavailable_reason"),
    )
    return contracts.coverage_issues(rows, docs.select(F.col("doc_id").alias("key"), F.concat(F.lit("e-"), "doc_id").alias("evidence_id")))


@query("SELECT page_id, page_id % 3 <> 1 AS bound FROM pages")
def f23_binding(spark: SparkSession, d: str) -> DataFrame:
    """Analyses name the digest of the evidence they were made from; another digest does not count."""
    pages = table(spark, d, "pages").select("page_id", validate.row_hash("url", "html").alias("digest"))
    analyses = pages.select("page_id", F.when(F.col("page_id") % 3 == 1, F.lit("old")).otherwise(F.col("digest")).alias("bound_to"))
    return pages.join(analyses, "page_id").select("page_id", (F.col("digest") == F.col("bound_to")).alias("bound"))


@query("SELECT source, list_sort(list_distinct(list(lang))) <> ['de', 'en', 'es', 'fr'] AS outside FROM documents GROUP BY source")
def f25_allowed_changes(spark: SparkSession, d: str) -> DataFrame:
    """Whether a change touches something outside an allowed list, or lacks some of it."""
    changed = table(spark, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("changed"))
    allowed = F.array(*map(F.lit, ("de", "en", "es", "fr")))
    outside = (F.size(F.array_except("changed", allowed)) > 0) | (F.size(F.array_except(allowed, F.col("changed"))) > 0)
    return changed.select("source", outside.alias("outside"))


@query(f"WITH {_EDGE}, t AS (SELECT source AS id FROM edge WHERE type = 'depends_on' UNION SELECT target FROM edge WHERE type = 'depends_on') SELECT id FROM cards WHERE list_has_any(cats, ['ECONOMY', 'PROMO']) AND overall >= 2 AND id IN (SELECT id FROM t)")
def f27_graph_filter(spark: SparkSession, d: str) -> DataFrame:
    cards = c.part_cards(spark, d)
    typed = graph.relation_types(_edges(spark, d).where("type = 'depends_on'")).select("id")
    return reader.filter_cards(cards, categories=("ECONOMY", "PROMO"), minimum=2).join(typed, "id", "left_semi").select("id")


@query(f"WITH {_EDGE}, f AS (SELECT id FROM cards WHERE ord % 50 = 7), n AS (SELECT source AS id FROM edge WHERE target IN (SELECT id FROM f) UNION SELECT target FROM edge WHERE source IN (SELECT id FROM f) UNION SELECT id FROM f) SELECT pair_id FROM edge WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)")
def f30_focus(spark: SparkSession, d: str) -> DataFrame:
    """Edges among the focused cards and their neighbours."""
    edges = _edges(spark, d)
    focus = c.part_cards(spark, d).where("ord % 50 = 7").select("id")
    near = edges.join(focus.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
    back = edges.join(focus.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
    return graph.visible_edges(edges, focus.union(near).union(back).distinct()).select("pair_id")


@query("SELECT page_id AS key, CASE page_id % 4 WHEN 1 THEN 'keys_differ' WHEN 2 THEN 'provider_unknown' ELSE 'version_unknown' END AS code FROM pages WHERE page_id % 4 <> 0")
def f31_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests in JSON: exactly the known keys, a known provider and version."""
    k = F.col("page_id") % 4
    raw = F.to_json(F.struct(F.col("url"), F.when(k == 2, "other").otherwise("web").alias("provider"), F.when(k == 3, 9).otherwise(1).alias("version")))
    rows = table(spark, d, "pages").select("page_id", F.when(k == 1, F.replace(raw, F.lit('"url"'), F.lit('"link"'))).otherwise(raw).alias("raw"))
    keys = F.array_sort(F.json_object_keys("raw"))
    checks = {
        "keys_differ": (keys != F.array(*map(F.lit, ("provider", "url", "version"))), "$"),
        "provider_unknown": (~F.get_json_object("raw", "$.provider").isin("web", "repository", "posts"), "$.provider"),
        "version_unknown": (F.get_json_object("raw", "$.version") != "1", "$.version"),
    }
    return validate.check(rows, "page_id", checks).select(F.col("key").cast("long").alias("key"), "code")


@query(
    "SELECT source AS key, CASE WHEN CAST(substring(source, 4) AS BIGINT) % 3 = 0 THEN 'items_differ' WHEN CAST(substring(source, 4) AS BIGINT) % 3 = 1 THEN 'exhaustive_with_stops' END AS code FROM (SELECT DISTINCT source FROM documents) WHERE CAST(substring(source, 4) AS BIGINT) % 3 <> 2"
)
def f35_progress(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "documents").select(F.col("source").alias("key"), F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("bytes"))
    k = F.substring("key", 4, 9).cast("long") % 3
    sums = items.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total_bytes"))
    progress = sums.select("key", (F.col("n") + F.when(k == 0, 1).otherwise(0)).alias("total_items"), "total_bytes", F.lit(True).alias("exhaustive"), F.when(k == 1, F.array(F.lit("depth_limit"))).otherwise(F.array().cast("array<string>")).alias("stops"))
    return contracts.progress_issues(items, progress)


@query("SELECT page_id, page_id % 2 = 0 AS same FROM pages")
def f36_same_source(spark: SparkSession, d: str) -> DataFrame:
    """Evidence belongs to a request when both addresses are the same in canonical form."""
    url = F.col("url")
    asked = F.concat(F.regexp_replace(url, "[?#].*$", ""), F.lit("?utm_source=x#top"))
    got = F.concat(F.regexp_replace(url, "[?#].*$", ""), F.when(F.col("page_id") % 2 == 0, F.lit("?fbclid=1")).otherwise(F.lit("/more")))
    return table(spark, d, "pages").select("page_id", urls.canonical(asked).eqNullSafe(urls.canonical(got)).alias("same"))


@query("SELECT event_id, event_id % 4 IN (0, 3) AS allowed FROM events")
def f38_dns_answers(spark: SparkSession, d: str) -> DataFrame:
    """A name may be fetched when all its addresses are public."""
    k = F.col("event_id") % 4
    answers = F.when(k == 0, F.array(F.lit("8.8.8.8"), F.lit("1.1.1.1"))).when(k == 1, F.array(F.lit("8.8.8.8"), F.lit("10.0.0.1"))).when(k == 2, F.array(F.lit("fe80::1"))).otherwise(F.array(F.lit("2606:4700::1")))
    return table(spark, d, "events").select("event_id", F.forall(answers, urls.is_public_address).alias("allowed"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'selected' ELSE 'left' END AS state FROM documents")
def j14_selected_paths(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat("lang", F.lit("/"), "doc_id", F.lit(".md")).alias("path"))
    chosen = docs.where("doc_id % 4 = 0").select("path", F.lit("selected").alias("state"))
    return docs.join(chosen, "path", "left").select("doc_id", F.coalesce("state", F.lit("left")).alias("state"))


@query("SELECT page_id AS id, CAST(x.place AS INTEGER) AS place, x.type, 'https://m.example.org/' || page_id || x.tail AS url FROM pages, (VALUES (0, 'image', '/a.jpg'), (1, 'video', '/b.mp4'), (3, 'unknown', '/c')) x(place, type, tail)")
def p21_media(spark: SparkSession, d: str) -> DataFrame:
    """Media of a carousel in order, each address once."""
    at = lambda kind, tail: F.struct(F.lit(kind).alias("type"), F.concat(F.lit("https://m.example.org/"), "page_id", F.lit(tail)).alias("url"))
    rows = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.array(at("IMAGE", "/a.jpg"), at("clip_video", "/b.mp4"), at("image", "/a.jpg"), at("x", "/c")).alias("items"))
    return contracts.media_of(rows)


@query("SELECT c_custkey AS id, lower(c_name) AS full_name, array_to_string(list_sort([lower(c_mktsegment), 'a-' || c_nationkey]), ',') AS topics, c_acctbal < 0 AS archived FROM customer")
def p23_repository_metadata(spark: SparkSession, d: str) -> DataFrame:
    """A stable subset of metadata: topics sorted, missing flags false."""
    topics = F.array_sort(F.array(F.lower("c_mktsegment"), F.concat(F.lit("a-"), "c_nationkey")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("full_name"), F.array_join(topics, ",").alias("topics"), F.coalesce(F.col("c_acctbal") < 0, F.lit(False)).alias("archived"))


@query("SELECT source, string_agg(lang || '=' || CASE WHEN n < 20 THEN 'unavailable:few' ELSE 'supported' END, ';' ORDER BY lang) AS coverage FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def p24_coverage(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct("lang", F.when(F.col("n") < 20, F.lit("unavailable:few")).otherwise(F.lit("supported")).alias("s"))
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat(e["lang"], F.lit("="), e["s"]))
    return n.groupBy("source").agg(F.array_join(listed, ";").alias("coverage"))


@query("SELECT page_id, sha256('v' || url || chr(1) || 'v' || html) AS evidence_digest, 2 AS version FROM pages")
def p31_bind(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return pages.select("page_id", validate.row_hash("url", "html").alias("evidence_digest"), F.lit(2).alias("version"))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'post' WHEN 1 THEN 'share' WHEN 2 THEN 'short' WHEN 3 THEN 'other' END AS kind, CASE page_id % 5 WHEN 0 THEN 'C' || page_id WHEN 1 THEN 'S' || page_id WHEN 2 THEN 'T' || page_id END AS token, CASE page_id % 5 WHEN 0 THEN 'https://threads.com/@Me/post/C' || page_id END AS canonical FROM pages")
def x13_post_urls(spark: SparkSession, d: str) -> DataFrame:
    k, id_ = F.col("page_id") % 5, F.col("page_id").cast("string")
    url = F.concat(F.when(k == 0, "https://www.threads.net/@Me/post/C").when(k == 1, "https://threads.com/share/S").when(k == 2, "https://threads.com/t/T").when(k == 3, "https://threads.com/@Me/").otherwise("https://example.org/t/"), id_, F.lit("?x=1"))
    p = urls.post_url(url)
    return table(spark, d, "pages").select("page_id", p["kind"].alias("kind"), p["token"].alias("token"), p["canonical"].alias("canonical"))


#: Texts with entities and what they say.
_ENTITIES = (
    ("a&lt;b &amp;&nbsp;&quot;c&quot; &#39;d&apos;", "a<b & \"c\" 'd'"), ("&NDASH;&mdash;&hellip;&rsquo;&lsquo;&rdquo;&ldquo;&bull;&Copy;", "–—…’‘”“•©"), ("&amp;lt; &middot; &unknown;", "&lt; &middot; &unknown;"),
    ("&#8364;&#x20AC;&#X1f600;", "€€😀"), ("a&#0;b&#xD800;c&#1114112;d&#99999999999999999999;", "a b c d "), ("no & entity; &; &#; &#x;", "no & entity; &; &#; &#x;"), ("&lt;&lt;", "<<"), ("", ""),
)


@query("SELECT page_id, e.text FROM pages JOIN (VALUES " + ", ".join("({}, '{}')".format(k, x.replace("'", "''")) for k, (_, x) in enumerate(_ENTITIES)) + f") e(k, text) ON k = page_id % {len(_ENTITIES)}")
def x14_entities(spark: SparkSession, d: str) -> DataFrame:
    raw = F.array(*(F.lit(x) for x, _ in _ENTITIES))[(F.col("page_id") % len(_ENTITIES)).cast("int")]
    return table(spark, d, "pages").select("page_id", text.decode_entities(raw).alias("text"))


@query("SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS bytes, length(coalesce(text, '')) AS chars FROM conversations")
def x17_byte_length(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "conversations").select("conv_id", "turn", F.octet_length(t).cast("long").alias("bytes"), F.length(t).cast("long").alias("chars"))


def _folder_sql(names: tuple[str, ...]) -> str:
    return "list_has_any(parts, [" + ", ".join(f"'{x}'" for x in names) + "])"


#: Folder names of documents' paths, all that a rule names and some that none does.
_FOLDER_NAMES = [*ingest.SKIPPED_FOLDERS, *(x for _, names in ingest.FOLDER_PRIORITIES for x in names), "Docs", "BUILD", "notes", "builds", "git"]


@query(
    f"WITH p AS (SELECT doc_id, source || '/' || lang || '/' || {[*_FOLDER_NAMES]}[1 + octet_length(encode(coalesce(text, ''))) % {len(_FOLDER_NAMES)}] AS path FROM documents), s AS (SELECT *, string_split(lower(path), '/') AS parts FROM p) "
    f"SELECT doc_id, {_folder_sql(ingest.SKIPPED_FOLDERS)} AS skipped, CASE {' '.join(f'WHEN {_folder_sql(names)} THEN {place}' for place, names in ingest.FOLDER_PRIORITIES)} ELSE 8 END AS priority FROM s"
)
def x20_directories(spark: SparkSession, d: str) -> DataFrame:
    """Folders that a walk leaves out, and in what order it takes the others: by source, language and a name that a text's length chooses."""
    name = F.get(F.array(*map(F.lit, _FOLDER_NAMES)), (F.octet_length(F.coalesce("text", F.lit(""))) % len(_FOLDER_NAMES)).cast("int"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), name)
    return table(spark, d, "documents").select("doc_id", ingest.folder_skipped(path).alias("skipped"), ingest.folder_priority(path).alias("priority"))


@query("SELECT page_id, 'state/sources/web/' || regexp_replace(url, '[^a-zA-Z0-9._-]+', '--', 'g') || '.json' AS path FROM pages")
def x22_state_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", contracts.state_path(F.lit("web"), F.concat(F.lit("url:"), "url")).alias("path"))


@query(f"WITH {PARTS} SELECT id, CASE WHEN ord % 5 = 0 THEN 'old/' || id || '.md' ELSE 'content/knowledge/' || created_at[1:4] || '/' || id || '.md' END AS path FROM cards")
def x23_card_path(spark: SparkSession, d: str) -> DataFrame:
    old = F.when(F.col("ord") % 5 == 0, F.concat(F.lit("old/"), "id", F.lit(".md")))
    return c.part_cards(spark, d).select("id", contracts.card_path(F.col("id"), F.col("created_at"), old).alias("path"))


@query("SELECT page_id, regexp_replace(url, '[?#].*$', '') AS stable FROM pages")
def x24_media_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("stable"))


@query("WITH h AS (SELECT source, CAST('0x' || sha256(doc_id || ':' || coalesce(text, ''))[1:15] AS HUGEINT) AS h FROM documents) SELECT source, sha256(count(*) || ':' || sum(h)) AS digest FROM h GROUP BY source")
def x25_bundle_digest(spark: SparkSession, d: str) -> DataFrame:
    return validate.set_hash(table(spark, d, "documents"), "source", F.concat("doc_id", F.lit(":"), F.coalesce("text", F.lit(""))))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://c.example.org/' || page_id WHEN 1 THEN 'https://og.example.org/' || page_id END AS canonical FROM pages")
def x29_canonical_link(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 3
    head = F.when(k == 0, F.concat(F.lit('<link rel="canonical" href="https://c.example.org/'), "page_id", F.lit('">'))).when(k == 1, F.concat(F.lit('<meta property="og:url" content="https://og.example.org/'), "page_id", F.lit('">'))).otherwise(F.lit(""))
    return table(spark, d, "pages").select("page_id", contracts.canonical_link(F.concat(head, "html")).alias("canonical"))


@query(
    f"WITH {_POSTS}, f AS (SELECT conv_id, min(turn) FILTER (username <> head) AS stop, max(turn) + 1 AS n FROM (SELECT *, first_value(username) OVER (PARTITION BY conv_id ORDER BY turn) AS head FROM posts) GROUP BY conv_id), "
    "l AS (SELECT conv_id, n, CAST(coalesce(stop, n) AS BIGINT) AS parts FROM f), t AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (trim(coalesce(text, '')) <> '') AS text FROM posts JOIN l USING (conv_id) WHERE turn < parts GROUP BY conv_id) "
    "SELECT conv_id, parts, CASE WHEN conv_id % 2 = 0 THEN CASE WHEN parts = 1 THEN 'SINGLE_POST' ELSE 'COMPLETE_THREAD' END WHEN parts > 1 AND parts = n THEN 'COMPLETE_THREAD' ELSE 'INCOMPLETE_THREAD' END AS status, "
    "CASE WHEN conv_id % 2 = 1 AND NOT (parts > 1 AND parts = n) THEN 'conversation_coverage_unverified' END AS reason, sha256(text) AS text_sha256 FROM l LEFT JOIN t USING (conv_id)"
)
def r15_threads(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's thread: its author's chain from the root, whether that is all of it, and its text. Half of the conversations are known to be covered."""
    posts = conv.posts(table(spark, d, "conversations"))
    covered = posts.select("conv_id").distinct().select("conv_id", (F.col("conv_id") % 2 == 0).alias("coverage"))
    found = conv.extract_threads(posts, covered)
    return found.select("conv_id", F.col("detected").alias("parts"), "status", "reason", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


_SAME = "coalesce(h, a) IS NOT NULL AND NOT (h IS NOT NULL AND a IS NOT NULL AND h <> a)"


@query(
    "WITH n AS (SELECT conv_id, count(*) AS n, CASE WHEN conv_id % 7 = 5 THEN count(*) END AS h, CASE WHEN conv_id % 2 = 0 THEN count(*) + CASE WHEN conv_id % 10 = 4 THEN 1 ELSE 0 END END AS a FROM conversations GROUP BY conv_id), "
    "one AS (SELECT *, least(n, 2) AS d1, CASE WHEN h IS NOT NULL THEN least(n, 2) = h ELSE n = 2 END AS c1 FROM n), "
    f"two AS (SELECT *, least(n, 4) AS d2, CASE WHEN h <> a THEN false WHEN {_SAME} THEN least(n, 4) = coalesce(a, h) ELSE n BETWEEN 2 AND 4 END AS c2 FROM one), "
    "r AS (SELECT *, CASE WHEN c1 THEN 'page' WHEN c2 THEN 'api' ELSE 'browser' END AS method, CASE WHEN c1 THEN d1 WHEN c2 THEN d2 ELSE n END AS detected, c1 OR c2 OR h IS NOT NULL OR conv_id % 3 <> 0 OR n > 1 AS complete, "
    "CASE WHEN c1 THEN h IS NOT NULL WHEN c2 THEN coalesce(h, a) IS NOT NULL ELSE h IS NOT NULL OR conv_id % 3 <> 0 END AS sure FROM two), "
    "t AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations JOIN r USING (conv_id) WHERE turn < detected AND trim(coalesce(text, '')) <> '' AND NOT (method = 'page' AND turn = 1 AND conv_id % 4 = 1) GROUP BY conv_id) "
    "SELECT conv_id, detected, CASE WHEN complete THEN detected END AS total, CASE WHEN NOT complete THEN 'INCOMPLETE_THREAD' WHEN detected = 1 THEN 'SINGLE_POST' ELSE 'COMPLETE_THREAD' END AS status, "
    "CASE WHEN NOT complete THEN 'conversation_coverage_unverified' END AS reason, CASE WHEN complete AND sure THEN 'high' ELSE 'medium' END AS confidence, method, sha256(text) AS text_sha256 FROM r LEFT JOIN t USING (conv_id)"
)
def r15_merged_threads(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation as one author's thread from up to three sources: a page with two posts, one of them without text at times, an interface with four and a number of parts that is wrong at times, and a browser with all."""
    turns = table(spark, d, "conversations")
    posts = conv.posts(turns).withColumns({"username": F.lit("me"), "hint": F.lit(None).cast("int"), "hint_total": F.lit(None).cast("int")})
    n = turns.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    parts = lambda total: F.struct(F.lit(1).alias("index"), total.alias("total"))
    page = n.where("conv_id % 7 = 5").select("conv_id", parts(F.col("n")).alias("page"))
    none = F.lit(None).cast(threads.INDICATOR).alias("adapter")
    wrong = F.col("n") + F.when(F.col("conv_id") % 10 == 4, 1).otherwise(0)
    cut = F.when((F.col("turn") == 1) & (F.col("conv_id") % 4 == 1), F.lit(None).cast("string")).otherwise(F.col("text"))
    sources = [
        ("page", posts.where("turn < 2").withColumn("text", cut), n.select("conv_id", none, F.lit(False).alias("coverage"))),
        ("api", posts.where("turn < 4"), n.select("conv_id", F.when(F.col("conv_id") % 2 == 0, parts(wrong)).alias("adapter"), F.lit(False).alias("coverage"))),
        ("browser", posts, n.select("conv_id", none, (F.col("conv_id") % 3 != 0).alias("coverage"))),
    ]
    found = threads.merge_until_complete(sources, page)
    return found.select("conv_id", "detected", "total", "status", "reason", "confidence", "method", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


#: Files of an ingestion by what an event is, and by the half of a purchase's value.
_FILE_OF = "CASE event_type WHEN 'signup' THEN 'request' WHEN 'click' THEN 'evidence' WHEN 'view' THEN 'handoff' WHEN 'error' THEN 'judgement' WHEN 'purchase' THEN CASE WHEN value > 50 THEN 'analysis' ELSE 'plan' END END"


@query(
    f"WITH f AS (SELECT user_id, CAST(ts AS DATE) AS day, {_FILE_OF} AS kind FROM events), h AS (SELECT user_id, day, " + ", ".join(f"coalesce(bool_or(kind = '{x}'), false) AS {x}" for x in contracts.HAND_OFF_FILES) + " FROM f GROUP BY ALL) "
    "SELECT user_id, strftime(day, '%Y-%m-%d') AS day, concat_ws(',', " + ", ".join(f"CASE WHEN {x} THEN '{x}' END" for x in contracts.HAND_OFF_FILES) + ") AS files, CASE WHEN NOT request THEN 'missing-request' WHEN NOT evidence AND handoff AND NOT judgement THEN 'waiting-for-judgement' "
    "WHEN NOT evidence AND NOT handoff AND judgement THEN 'judgement-without-evidence' WHEN NOT evidence THEN 'fetch-evidence' WHEN analysis THEN 'apply-analysis' WHEN plan THEN 'expand-research' ELSE 'waiting-for-analysis' END AS stage FROM h"
)
def t03_stages(spark: SparkSession, d: str) -> DataFrame:
    """The stage of each user's ingestion of a day, every event being the arrival of a file."""
    files = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.expr(_FILE_OF).alias("kind"))
    return contracts.hand_off(files, "user_id", "day")


@query(f"WITH {DOCS} SELECT id, ord % 7 <> 0 AS known, ord % 7 <> 0 AND ord % 5 <> 0 AS reused FROM docs")
def t02_incremental(spark: SparkSession, d: str) -> DataFrame:
    """What an incremental build takes over from the index before: the second change of a delta index writes the others only."""
    new, old = _index(spark, d)
    index = incremental.DeltaIndex(spark, shared_folder(spark, "delta-index"))
    index.apply(old)
    index.apply(new)
    known, written = (x.select("id", F.lit(True).alias(n)) for x, n in ((index.read(1), "k"), (index.delta(2), "w")))
    found = new.select("id").join(known, "id", "left").join(written, "id", "left")
    return found.select("id", F.coalesce("k", F.lit(False)).alias("known"), F.col("w").isNull().alias("reused"))


@query(f"WITH {PARTS} SELECT 'title' AS mode, id FROM (SELECT id FROM cards ORDER BY title, id LIMIT 10) UNION ALL SELECT 'relevance', id FROM (SELECT id FROM cards ORDER BY overall DESC, updated_at DESC, title, id LIMIT 10) UNION ALL SELECT 'updated', id FROM (SELECT id FROM cards ORDER BY updated_at DESC, title, id LIMIT 10)")
def w09_sort_modes(spark: SparkSession, d: str) -> DataFrame:
    cards = c.part_cards(spark, d).select("id", "title", "updated_at", c.effective_relevance()["overall"].alias("overall"))
    orders = {"title": ["title", "id"], "relevance": [F.desc("overall"), F.desc("updated_at"), "title", "id"], "updated": [F.desc("updated_at"), "title", "id"]}
    out = None
    for mode, order in orders.items():
        one = cards.orderBy(*order).limit(10).select(F.lit(mode).alias("mode"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT user_id, arg_max(event_id, (CASE event_type WHEN 'purchase' THEN 200 WHEN 'signup' THEN 150 ELSE 20 END + CASE WHEN value > 10 THEN 20 ELSE 0 END, -event_id)) AS best FROM events GROUP BY user_id HAVING max(CASE event_type WHEN 'purchase' THEN 200 WHEN 'signup' THEN 150 ELSE 20 END + CASE WHEN value > 10 THEN 20 ELSE 0 END) >= 45")
def w13_best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """The first of the best-scored records of each group, where it scores enough."""
    score = F.when(F.col("event_type") == "purchase", 200).when(F.col("event_type") == "signup", 150).otherwise(20) + F.when(F.col("value") > 10, 20).otherwise(0)
    best = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct(score.alias("s"), (-F.col("event_id")).alias("i"))).alias("best"), F.max(score).alias("top"))
    return best.where("top >= 45").select("user_id", "best")


@query("SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def u07_sorted_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@query("SELECT conv_id, turn, turn % 2 = 0 AS first_source FROM conversations")
def u08_record_merge(spark: SparkSession, d: str) -> DataFrame:
    """Records of two sources put together, one with the even turns, one with all but every fourth; the first source's stays where it has text."""
    t = table(spark, d, "conversations")
    both = t.where("turn % 2 = 0").withColumn("rank", F.lit(0)).unionByName(t.where("turn % 4 <> 0").withColumn("rank", F.lit(1)))
    return conv.first_text(both, ["conv_id", "turn"], "rank").select("conv_id", "turn", (F.col("rank") == 0).alias("first_source"))


@query("SELECT page_id, lang AS source_lang FROM (SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages)")
def s11_embedded_json(spark: SparkSession, d: str) -> DataFrame:
    """A JSON script put into each page and read from it."""
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    page = F.concat("html", F.lit('<script type="application/ld+json">for(;;);{"lang": "'), lang, F.lit('"}</script>'))
    found = F.get(files.embedded_json(page), F.lit(0))
    return table(spark, d, "pages").select("page_id", F.get_json_object(found, "$.lang").alias("source_lang"))


@query(f"WITH {_POSTS} SELECT id, username, reply_to FROM posts WHERE trim(coalesce(text, '')) <> ''")
def s12_json_walk(spark: SparkSession, d: str) -> DataFrame:
    """Posts found anywhere inside nested JSON."""
    p = conv.posts(table(spark, d, "conversations")).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    inner = F.to_json(F.struct("id", F.struct("username").alias("user"), F.struct("text").alias("caption"), "reply_to"))
    # Deep in lists of different lengths, beside values that are no posts.
    wrapped = F.concat(F.lit('{"data": {"edges": [[1, {"id": "no", "text": "author"}], {"node": '), inner, F.lit("}, null], \"page\": {\"text\": \"no id\"}}}"))
    payloads = p.select(F.col("id").alias("key"), wrapped.alias("payload"))
    return json_walk.posts_in(payloads, "key", "payload").select("id", "username", "reply_to")


@query(f"WITH {PARTS} SELECT id, title, 'x' AS note FROM cards")
def s02_front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Cards written as Markdown with front matter and parsed again."""
    cards = c.part_cards(spark, d).select("id", "title")
    raw = sinks.render_card(F.struct("id", "title"), F.col("title"), [("Notes", F.lit("x"))])
    parsed = files.parse_cards(cards.select(F.col("id").alias("path"), raw.alias("raw")))
    return parsed.select("data.id", "data.title", text.section(F.col("body"), "Notes").alias("note"))


@query(f"WITH {DOCS} SELECT id, CASE WHEN ord % 2 = 0 THEN 'a' || chr(10) || 'b' ELSE 'b' END AS log FROM docs")
def k03_update_log(spark: SparkSession, d: str) -> DataFrame:
    """A line is added to a log once, however often it is applied."""
    log = F.when(F.col("ord") % 2 == 0, F.lit("a")).otherwise(F.lit(""))
    once = sinks.append_log(log, F.lit("b"))
    return c.document_cards(spark, d).select("id", sinks.append_log(once, F.lit("b")).alias("log"))


@query("SELECT time_bucket(INTERVAL '15 minutes', ts) AS start, event_type AS route, count(*) AS n FROM events GROUP BY 1, 2")
def t01_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows: an extension."""
    return incremental.metrics(table(spark, d, "events"), "ts", "event_type", "value", "15 minutes").select("start", "route", "n")


@query(f"WITH {_EDGE}, k AS (SELECT CAST(source[-8:] AS INTEGER) AS k, * FROM edge) SELECT pair_id, CASE WHEN k % 6 IN (0, 1, 2) THEN 'similar_to' ELSE 'complements' END AS kind, k % 6 IN (0, 1, 2) AS related FROM k")
def x06_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The classifier without a model, on pairs that are close in both scores or not."""
    k = F.substring("source", -8, 8).try_cast("int") % 6
    rows = _edges(spark, d).select("pair_id", "source", "target", F.when(k < 3, 0.5).otherwise(0.1).alias("taxonomy"), F.when(k < 3, 0.7).otherwise(0.3).alias("semantic"), F.lit(0.5).alias("combined"), (k < 3).alias("publishable"))
    return relations.fallback_classify(rows, relations.Config()).select("pair_id", F.col("type").alias("kind"), "related")
