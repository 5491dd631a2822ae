"""Queries over what is stored first: the search index, releases, delta files; see catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cards as c
from ..operators import contracts, release
from ..operators.cards import table
from ..operators.commits import ConflictError
from ..operators.publish import Releases, release_issues
from ..operators.rounds import shared_folder
from ..operators.search_index import SearchIndex
from ..sources import git_store
from ..streaming import hand_off
from .catalog import DOCS, SQL, _term_sql, query
from .catalog_more import _QUERY

_BUILT: dict[tuple[str, str], SearchIndex] = {}



def stored_index(spark: SparkSession, d: str) -> SearchIndex:
    """The index of all documents in two segments, built once a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        docs, fields = c.document_cards(spark, d), c.document_fields()
        index = SearchIndex(spark, shared_folder(spark, "search-index"))
        index.append(docs.where("ord % 8 <> 3"), fields)
        index.append(docs.where("ord % 8 = 3"), fields)
        _BUILT[key] = index
    return _BUILT[key]


@query(f"WITH {DOCS} SELECT count(*) AS cards, 2 AS commits FROM docs")
def w01_index_build(spark: SparkSession, d: str) -> DataFrame:
    """The stored index of all documents, added in two commits."""
    index = stored_index(spark, d)
    return index.cards().agg(F.count(F.lit(1)).alias("cards")).withColumn("commits", F.lit(index.log.head()))


@query(SQL["w01_search"])
def w01_stored_search(spark: SparkSession, d: str) -> DataFrame:
    """The same search from the stored index: only the query's buckets are read."""
    return stored_index(spark, d).search(_QUERY, sorted(set(_QUERY.split())), 20)


@query(f"WITH {DOCS} {' UNION ALL '.join(map(_term_sql, ('title', 'summary', 'body')))}")
def p06_stored_terms(spark: SparkSession, d: str) -> DataFrame:
    """Term counts of all documents from the stored postings."""
    return stored_index(spark, d).term_counts().where("field <> 'metadata'")


def _manifest_sql(group: str) -> str:
    return f"SELECT {group} AS grp, count(*) AS documents, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes, CAST(sum(CAST(('0x' || sha256(coalesce(text, ''))[1:15]) AS HUGEINT)) AS VARCHAR) AS digest FROM documents GROUP BY {group}"


def _manifest(docs: DataFrame, group: str) -> DataFrame:
    return release.source_manifest(docs, group, "text").withColumnRenamed(group, "grp")


@query(
    f"SELECT 'by_source' AS artifact, *, 2 AS number, 1 AS refused, 1 AS failed, 2 AS staged FROM ({_manifest_sql('source')}) UNION ALL SELECT 'by_lang', *, 2, 1, 1, 2 FROM ({_manifest_sql('lang')})"
)
def k02_transaction(spark: SparkSession, d: str) -> DataFrame:
    """Manifests of all documents, published together: a first release, a second that makes one artifact anew, one that comes too late, and one that fails half way. Read back from the newest."""
    docs, store = table(spark, d, "documents"), Releases(spark, shared_folder(spark, "releases"))
    store.publish({"by_source": _manifest(docs, "source"), "by_lang": _manifest(docs, "source")})
    store.publish({"by_lang": _manifest(docs, "lang")}, base=1)
    refused = failed = 0
    try:
        store.publish({"by_lang": _manifest(docs, "source")}, base=1)
    except ConflictError:
        refused = 1
    try:
        broken = _manifest(docs, "lang").withColumn("grp", F.raise_error(F.lit("half way")).cast("string"))
        store.publish({"by_source": _manifest(docs, "lang"), "by_lang": broken})
    except Exception as error:
        if "half way" not in str(error):
            raise
        failed = 1
    staged = len(set(r[0] for r in store.files().select(F.element_at(F.split("path", "/"), 2)).distinct().collect()))
    both = store.table("by_source").select(F.lit("by_source").alias("artifact"), "*").unionByName(store.table("by_lang").select(F.lit("by_lang").alias("artifact"), "*"))
    counts = {"number": store.log.head(), "refused": refused, "failed": failed, "staged": staged}
    return both.select("*", *(F.lit(v).alias(k) for k, v in counts.items()))


@query(f"SELECT *, CAST(3 AS BIGINT) AS number FROM ({_manifest_sql('source')})")
def k04_pointer(spark: SparkSession, d: str) -> DataFrame:
    """Manifests of the documents by language and by source; the pointer is moved three times, each time to a new number, and readers follow the latest."""
    docs, root = table(spark, d, "documents"), shared_folder(spark, "pointed")
    for name in ("lang", "source"):
        _manifest(docs, name).write.parquet(f"{root}/versions/{name}")
    numbers = [release.point_to(spark, root, x) for x in ("source", "lang", "source")]
    return spark.read.parquet(f"{root}/versions/{release.current_release(spark, root)}").withColumn("number", F.lit(max(numbers)).cast("long"))


@query(f"SELECT artifact, documents, bytes FROM (SELECT 'by_source' AS artifact, * FROM ({_manifest_sql('source')}) UNION ALL SELECT 'by_lang', * FROM ({_manifest_sql('lang')})) WHERE grp IS NOT NULL")
def s04_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts written as JSON and read back as previous ones; one that was never written reads as no rows."""
    docs, folder = table(spark, d, "documents"), shared_folder(spark, "artifacts")
    kind = "grp string, documents long, bytes long, digest string"
    for name in ("source", "lang"):
        _manifest(docs, name).write.json(f"{folder}/by_{name}.json")
    found = [release.previous_artifact(spark, f"{folder}/{x}.json", kind).withColumn("artifact", F.lit(x)) for x in ("by_source", "by_lang", "by_nothing")]
    return found[0].unionByName(found[1]).unionByName(found[2]).where("grp IS NOT NULL").select("artifact", "documents", "bytes")


_SAID = """SELECT doc_id + 1 AS number, CASE WHEN length(text) % 11 = 3 THEN doc_id - 1 ELSE doc_id END AS base, CASE WHEN length(text) % 13 = 4 THEN upper(lang) ELSE lang END AS artifact,
  'staged/' || CASE WHEN length(text) % 7 = 2 THEN '../' ELSE '' END || md5(coalesce(text, '')) || '/' || CASE WHEN length(text) % 9 = 5 THEN 'other' ELSE lang END AS path,
  CAST(length(text) % 17 AS BIGINT) AS files, octet_length(encode(text)) AS bytes, CASE WHEN length(text) % 5 = 1 THEN sha256(text)[1:40] ELSE sha256(text) END AS sha256 FROM documents WHERE doc_id IS NOT NULL"""
_SAFE = "coalesce(regexp_matches(path, '^staged/[0-9a-f]{32}/[a-z][a-z0-9_]*$'), false)"


@query(
    f"WITH said AS ({_SAID}), e AS (SELECT number, artifact, unnest([CASE WHEN NOT coalesce(regexp_matches(artifact, '^[a-z][a-z0-9_]*$'), false) THEN 'artifact_name_invalid' END, CASE WHEN NOT {_SAFE} THEN 'path_invalid' END, "
    f"CASE WHEN {_SAFE} AND string_split(path, '/')[-1] <> artifact THEN 'path_of_another_artifact' END, CASE WHEN NOT coalesce(regexp_matches(sha256, '^[0-9a-f]{{64}}$'), false) THEN 'sha256_malformed' END, "
    "CASE WHEN coalesce(files < 1, true) THEN 'files_missing' END, CASE WHEN coalesce(bytes < 0, true) THEN 'bytes_invalid' END]) AS code FROM said), "
    "w AS (SELECT number, base, coalesce(lag(number) OVER (ORDER BY number), 0) AS former, artifact FROM said) "
    "SELECT * FROM e WHERE code IS NOT NULL UNION ALL SELECT number, NULL, 'number_gap' FROM w WHERE number <> former + 1 UNION ALL SELECT number, NULL, 'base_is_not_former' FROM w WHERE base IS DISTINCT FROM number - 1 "
    "UNION ALL SELECT number, NULL, 'artifact_missing:en' FROM w WHERE artifact IS DISTINCT FROM 'en'"
)
def f24_release_issues(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a release of one artifact that its text describes, some of them wrongly."""
    docs, n = table(spark, d, "documents").where("doc_id IS NOT NULL"), F.length("text")
    sha = F.sha2(F.col("text").cast("binary"), 256)
    said = docs.select(
        (F.col("doc_id") + 1).alias("number"), F.when(n % 11 == 3, F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("base"), F.when(n % 13 == 4, F.upper("lang")).otherwise(F.col("lang")).alias("artifact"),
        F.concat(F.lit("staged/"), F.when(n % 7 == 2, F.lit("../")).otherwise(F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.lit("/"), F.when(n % 9 == 5, F.lit("other")).otherwise(F.col("lang"))).alias("path"),
        (n % 17).cast("long").alias("files"), F.octet_length("text").cast("long").alias("bytes"), F.when(n % 5 == 1, F.substring(sha, 1, 40)).otherwise(sha).alias("sha256"),
    )
    return release_issues(said, ("en",))


#: An event as the change of a file: its type, and a purchase's or view's value, name the file; its value says whether the file is taken away and what it is bound to.
_FILE = "CASE event_type WHEN 'signup' THEN 'request' WHEN 'click' THEN 'evidence' WHEN 'view' THEN CASE WHEN value > 20 THEN 'handoff' ELSE 'research' END WHEN 'error' THEN 'judgement' WHEN 'purchase' THEN CASE WHEN value > 50 THEN 'analysis' ELSE 'plan' END END"
_PROVIDER = "CASE user_id % 3 WHEN 0 THEN 'threads' WHEN 1 THEN 'github' ELSE 'generic_web' END"
_CENTS = "CAST(round(value * 100) AS BIGINT)"


def _file_changes(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").cast("string").alias("identity"), F.expr(_PROVIDER).alias("provider"), F.expr(_FILE).alias("file"), F.col("ts").alias("at"), F.expr(f"{_CENTS} % 3 <> 0").alias("gone"), F.expr(f"CAST({_CENTS} % 2 AS STRING)").alias("digest"))


def _any(*names: str) -> str:
    return "(" + " OR ".join(names) + ")"


_STAGES_SQL = (
    f"WITH e AS (SELECT CAST(user_id AS VARCHAR) AS identity, {_PROVIDER} AS provider, {_FILE} AS file, ts, coalesce({_CENTS} % 3 <> 0, false) AS gone, coalesce(CAST({_CENTS} % 2 AS VARCHAR), '') AS digest FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), "
    "k AS (SELECT * FROM e WHERE file IS NOT NULL), f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY identity, file ORDER BY ts DESC, gone DESC, digest DESC) = 1), "
    "h AS (SELECT identity, min(provider) AS provider, max(ts) AS last, coalesce(max(CASE WHEN file = 'handoff' THEN digest END), '') = coalesce(max(CASE WHEN file = 'judgement' THEN digest END), '') AS same, "
    + ", ".join(f"bool_or(file = '{x}' AND NOT gone) AS {x}" for x in contracts.INGESTION_FILES)
    + " FROM f GROUP BY identity), i AS (SELECT *, CASE WHEN NOT request AND " + _any(*contracts.INGESTION_FILES[1:]) + " THEN 'request_missing' WHEN provider <> 'threads' AND (handoff OR judgement) THEN 'handoff_of_other_provider' "
    "WHEN provider <> 'github' AND (plan OR research) THEN 'research_of_other_provider' WHEN plan AND analysis THEN 'plan_with_analysis' WHEN NOT evidence AND (analysis OR plan OR research) THEN 'before_evidence' "
    "WHEN NOT evidence AND judgement AND NOT handoff THEN 'judgement_without_handoff' WHEN NOT evidence AND judgement AND NOT same THEN 'judgement_of_other_evidence' WHEN evidence AND (handoff OR judgement) THEN 'handoff_not_cleared' "
    "WHEN evidence AND provider = 'github' AND NOT research THEN 'research_missing' END AS issue FROM h), s AS (SELECT *, CASE WHEN issue IS NULL THEN CASE WHEN NOT request THEN 'closed' WHEN NOT evidence AND handoff AND NOT judgement THEN 'waiting-for-analysis' "
    "WHEN NOT evidence THEN 'fetch-evidence' WHEN analysis THEN 'apply-analysis' WHEN plan THEN 'expand-research' ELSE 'waiting-for-analysis' END END AS stage FROM i) "
    "SELECT identity, provider, concat_ws(',', " + ", ".join(f"CASE WHEN {x} THEN '{x}' END" for x in contracts.INGESTION_FILES) + ") AS files, stage, "
    "CASE WHEN stage = 'waiting-for-analysis' THEN CASE WHEN NOT evidence THEN 'semantic-judgement' WHEN provider = 'github' THEN 'research-plan-or-analysis' ELSE 'analysis' END END AS waiting_for, issue, "
    "epoch_ms(last) + 36000000 <= (SELECT max(epoch_ms(ts)) - 3600000 FROM k) AND " + _any(*contracts.INGESTION_FILES) + " AS stalled FROM s"
)


@query(_STAGES_SQL)
def t03_ingestion_stages(spark: SparkSession, d: str) -> DataFrame:
    """Each user's ingestion after all events, every event being the arrival or the end of a file, from a table."""
    return hand_off.stages(_file_changes(table(spark, d, "events")), "10 HOURS", "1 HOUR").drop("last")


@query(_STAGES_SQL)
def t03_ingestion_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same ingestions kept as state by a stream over the files of events, with timers for those that stall."""
    read = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    return hand_off.stream_stages(_file_changes(read), "10 HOURS", "1 HOUR").drop("last")


#: Up to this many documents are a repository, so no tree lists more.
_BLOCK = 500
_REPO = f"coalesce(source, 'none') || '/' || CAST(doc_id // {_BLOCK} AS VARCHAR)"
_PATH = "CASE WHEN doc_id % 10 < 8 THEN 'content/knowledge/2024/doc-' || doc_id || '.md' ELSE 'assets/' || doc_id || '.md' END"
_CARDS = r"content/knowledge/[0-9]{4}/[a-z0-9-]+\.md"


def _landed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repositories of all documents as their host would answer: some trees are cut off, some are missing, some blobs are wrong."""
    docs, folder = table(spark, d, "documents").where("doc_id IS NOT NULL"), shared_folder(spark, "landed")
    block = F.expr(f"doc_id div {_BLOCK}")
    body = F.coalesce("text", F.lit("")).cast("binary")
    # A content's name is its own, so equal texts are one blob.
    base = docs.select("doc_id", F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), block.cast("string")).alias("repo"), (block % 7).alias("k"), body.alias("body"), F.sha1(body).alias("sha"), F.octet_length(body).cast("long").alias("n"))
    payload = F.struct(
        F.when(F.col("n") % 13 == 2, F.lit("utf-8")).otherwise(F.lit("base64")).alias("encoding"), F.base64("body").alias("content"), (F.col("n") + F.when(F.col("n") % 11 == 5, 1).otherwise(0)).alias("size")
    )
    blobs = base.where("n % 17 <> 4").select("sha", F.to_json(payload).alias("payload"))
    path = F.when(F.col("doc_id") % 10 < 8, F.concat(F.lit("content/knowledge/2024/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("assets/"), F.col("doc_id").cast("string"), F.lit(".md")))
    one = base.groupBy("repo", "k").agg(F.collect_list(F.struct(path.alias("path"), F.lit("blob").alias("type"), "sha")).alias("tree"))
    named = one.withColumn("tree_sha", F.sha1(F.col("repo").cast("binary")))
    trees = named.where("k <> 5").select(F.col("tree_sha").alias("sha"), F.to_json(F.struct((F.col("k") == 3).alias("truncated"), "tree")).alias("payload"))
    at = F.struct(F.sha1(F.concat(F.lit("commit "), F.col("repo")).cast("binary")).alias("sha"), F.struct(F.struct(F.col("tree_sha").alias("sha")).alias("tree")).alias("commit"), F.array().cast("array<struct<sha string>>").alias("parents"))
    commits = named.select("repo", F.lit("main").alias("ref"), F.when(F.col("k") == 6, F.lit("{}")).otherwise(F.to_json(at)).alias("payload"))
    for name, rows in (("commits", commits), ("trees", trees), ("blobs", blobs)):
        rows.write.parquet(f"{folder}/{name}")
    return tuple(spark.read.parquet(f"{folder}/{name}") for name in ("commits", "trees", "blobs"))


@query(
    f"WITH b AS (SELECT doc_id, {_REPO} AS repo, (doc_id // {_BLOCK}) % 7 AS k, {_PATH} AS path, encode(coalesce(text, '')) AS body FROM documents WHERE doc_id IS NOT NULL), n AS (SELECT *, octet_length(body) AS n FROM b), "
    "bad AS (SELECT DISTINCT repo, CASE k WHEN 6 THEN 'revision_invalid' WHEN 5 THEN 'tree_missing' ELSE 'tree_truncated' END AS error FROM b WHERE k IN (3, 5, 6)), "
    "f AS (SELECT repo, path, n + CASE WHEN n % 11 = 5 THEN 1 ELSE 0 END AS size, body, n, CASE WHEN n % 17 = 4 THEN 'blob_missing' WHEN n % 13 = 2 THEN 'blob_invalid' WHEN n + CASE WHEN n % 11 = 5 THEN 1 ELSE 0 END > 40000 THEN 'blob_too_large' WHEN n % 11 = 5 THEN 'blob_size_differs' END AS error "
    "FROM n WHERE k NOT IN (3, 5, 6) AND doc_id % 10 < 8) "
    "SELECT repo, path, CAST(CASE WHEN error = 'blob_missing' THEN NULL ELSE size END AS BIGINT) AS bytes, CASE WHEN error IS NULL THEN sha256(body) END AS text_sha256, error FROM f UNION ALL SELECT repo, NULL, NULL, NULL, error FROM bad"
)
def s06_landed_files(spark: SparkSession, d: str) -> DataFrame:
    """All documents landed as git objects and read back by the paths of cards, whole texts, with a row for each object that is refused."""
    found = git_store.files(*_landed(spark, d), _CARDS, 40_000)
    return found.select("repo", "path", "bytes", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "error")
