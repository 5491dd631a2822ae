"""The operators as queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, exact_dedup, fim, langid, licenses, mixing, quality, repair, simhash, suffix_dedup, token_counts, url_filter
from .common import held_fold, table

#: Rules of the url query: fixed values.
URL_RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]
END_OF_DOCUMENT = 50256


def tokenizer_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    return importlib.import_module("public_tokenizers").path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe.decode(bpe.encode(docs, path), path)
    return found.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        bpe.ids_sha256(F.col("token_ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return token_counts.document_token_counts(docs, end=END_OF_DOCUMENT)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.array_join("licenses", ",").alias("licenses"),
        F.array_join(F.transform("license_sentences", lambda s: F.concat(s["at"].cast("string"), F.lit(":"), s["id"])), ",").alias("sentences"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.classify(docs, model)
    return scored.select("doc_id", (held_fold(F.col("doc_id"), quality.FOLDS) == 0).alias("held_out"), "score", "predicted")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.train(docs)
    found = langid.identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", (held_fold(F.col("doc_id"), langid.FOLDS) == langid.HELD).alias("held_out"), "lang_pred", "score")


def op9_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.audit_conversations(repair.damage(turns), turns)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restore(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


def queries() -> dict:
    numbered = (op1_bpe, op2_token_counts, op3_licenses, op4_quality, op5_simhash, op6_mixing, op7_exact_dedup, op8_langid, op9_embed_dedup, op10_url_filter, op11_suffix_dedup, op12_repair, op13_fim)
    return {f.__name__: f for f in numbered}


_KNOWN = ", ".join(f"('{k}', '{v}')" for k, v in licenses.SENTENCES.items())


#: Licences in the order of the first rule that names them.
_ORDER = str(list(dict.fromkeys(r.license for r in licenses.RULES)))

#: Licences that count only where no other is found.
_ALONE = ", ".join(sorted({f"'{r.license}'" for r in licenses.RULES if r.alone}))


def _license_sql() -> str:
    """Rules are tried one after another on the bracketed identifiers, as nested replacements."""
    rest, cases = "ids", []
    for rule in licenses.RULES:
        pattern = "".join(f"<{x}>" for x in rule.sequence)
        cases.append(f"CASE WHEN contains({rest}, '{pattern}') THEN '{rule.license}' END")
        rest = f"replace({rest}, '{pattern}', '|')"
    key = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
marked AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(replace(text, chr(1), ' '), '([.;!?]+)([ \\t\\f\\r\\n]|\\z)', '\\1' || chr(1) || '\\2', 'g'),
    '(\\n[ \\t\\r*/#;-]*)(\\n)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM t
), parts AS (
  SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS nr FROM marked
), placed AS (
  SELECT doc_id, part, nr, coalesce(sum(len(string_split(part, chr(10))) - 1) OVER (PARTITION BY doc_id ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM parts
), units AS (
  SELECT doc_id, CAST(line + len(string_split(regexp_extract(part, '^[^A-Za-z0-9]*', 0), chr(10))) - 1 AS BIGINT) AS pos, nr, {key.format(x="part")} AS key FROM placed
  UNION ALL
  SELECT doc_id, pos, -1, {key.format(x="part")} FROM (SELECT doc_id, unnest(l) AS part, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM t))
), found AS (
  SELECT doc_id, pos, nr, k.id FROM units u JOIN (VALUES {_KNOWN}) k(sentence, id) ON u.key = k.sentence
), alone AS (
  SELECT * FROM found WINDOW w AS (PARTITION BY doc_id ORDER BY pos, nr) QUALIFY coalesce(lag(pos) OVER w <> pos OR lag(id) OVER w <> id, true)
), lists AS (
  SELECT doc_id, string_agg('<' || id || '>', '' ORDER BY pos, nr) AS ids, string_agg(pos || ':' || id, ',' ORDER BY pos, nr) AS sentences
  FROM alone GROUP BY doc_id
), named AS (
  SELECT doc_id, list_distinct(list_filter([{", ".join(cases)}], lambda x: x IS NOT NULL)) AS all_found, list_filter(all_found, lambda x: x NOT IN ({_ALONE})) AS others,
    CASE WHEN len(others) > 0 THEN others ELSE all_found END AS found, sentences FROM lists
)
SELECT d.doc_id, coalesce(array_to_string(list_filter({_ORDER}, lambda x: list_contains(l.found, x)), ','), '') AS licenses, coalesce(l.sentences, '') AS sentences
FROM documents d LEFT JOIN named l USING (doc_id)"""


ORACLES = {
    "op3_licenses": _license_sql(),
    "op6_mixing": """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place, md5(coalesce(text, '')) AS tie
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS w
  FROM d GROUP BY source
), c AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER o, 0) AS cap_before, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_left
  FROM s
  WINDOW o AS (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, CAST(total - cap_before AS DOUBLE) * w / w_left > cap AS clamped FROM c
), f AS (
  SELECT min_by(total - cap_before, 3.0 * source_size / w) AS rest, min_by(w_left, 3.0 * source_size / w) AS whole FROM l WHERE NOT clamped
), t AS (
  SELECT source, source_size, CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE CAST(rest AS DOUBLE) * w / whole END AS target FROM l, f
), e AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS epochs FROM t
), r AS (
  SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS extra,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY place, tie ROWS UNBOUNDED PRECEDING) AS until
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (epochs + CASE WHEN until - size / 2.0 < extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r""",
    "op7_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op9_embed_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(low.b, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(low.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN low ON low.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op10_url_filter": """
WITH p AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(action, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fit AS (
  SELECT page_id, arg_max(rhost || rpath, (length(rhost || rpath), length(rhost))) AS rule, arg_max(action, (length(rhost || rpath), length(rhost))) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fit USING (page_id)""",
}

#: The CRC-32 of a text's bytes, by the table's rule.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, octet_length(encode({x})) + 1), lambda k: CAST(('0x' || hex(encode({x}))[2 * k - 1:2 * k]) AS BIGINT))), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"""

#: Adds an edit, and up to two insertions before it, to the least paths; at the end also after the last.
ORACLES["op12_repair"] = f"""
WITH RECURSIVE crc(n, k, c) AS (
  SELECT range, 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8
), tab AS (SELECT list(c ORDER BY n) AS crc_table FROM crc WHERE k = 8),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
), coded AS (SELECT keyed.*, {_CRC.format(x="key")} % 20 AS kind FROM keyed, tab),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE kind <> 0
), placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text[1:64], sha256(text), copy) AS pos FROM damaged
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body,
    role[1:1] AS initial, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY pos) AS former
  FROM placed
), faults AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN body[-1:] NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM seen
), arcs(g, initial, h) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
adds(g, h, cost, label) AS (
  SELECT g, g, 0, '' FROM range(4) t(g) UNION ALL SELECT g, h, 3, 'I' FROM arcs WHERE initial <> 's'
  UNION ALL SELECT a.g, b.h, 6, 'II' FROM arcs a JOIN arcs b ON a.h = b.g WHERE a.initial <> 's' AND b.initial <> 's'
), steps AS (
  SELECT f.conv_id, f.pos, g, g AS h, 4 AS cost, 'D' AS label FROM faults f, range(4) t(g)
  UNION ALL SELECT conv_id, pos, g, h, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'K' FROM faults JOIN arcs USING (initial) WHERE fault IN ('none', 'truncated')
  UNION ALL SELECT conv_id, pos, g, h, CASE WHEN fault = 'truncated' THEN 6 ELSE 3 END, 'R' FROM faults, arcs WHERE arcs.initial <> 's' AND fault IN ('none', 'truncated')
), moves AS (
  SELECT s.conv_id, s.pos, a.g, s.h, a.cost + s.cost AS cost, a.label || s.label AS label FROM adds a JOIN steps s ON a.h = s.g
), least(conv_id, pos, g, best) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), {{'cost': CAST(0 AS BIGINT), 'label': ''}} FROM faults
  UNION ALL
  SELECT m.conv_id, m.pos, m.h, min({{'cost': l.best.cost + m.cost, 'label': l.best.label || m.label}})
  FROM least l JOIN moves m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.pos = l.pos + 1 AND m.g = l.g
  GROUP BY m.conv_id, m.pos, m.h
), ends AS (
  SELECT l.conv_id, min({{'cost': l.best.cost + a.cost, 'label': l.best.label || a.label}}) AS best
  FROM least l JOIN adds a USING (g) JOIN (SELECT conv_id, max(pos) AS pos FROM faults GROUP BY conv_id) n ON n.conv_id IS NOT DISTINCT FROM l.conv_id AND n.pos = l.pos
  WHERE a.h IN (0, 3) GROUP BY l.conv_id
), labels AS (
  SELECT conv_id, unnest(string_split(best.label, '')) AS label, generate_subscripts(string_split(best.label, ''), 1) AS k FROM ends WHERE best.label <> ''
), walked AS (
  SELECT *, sum(CASE WHEN label <> 'I' THEN 1 ELSE 0 END) OVER w AS pos, sum(CASE WHEN label <> 'D' THEN 1 ELSE 0 END) OVER w AS nth,
    sum(CASE WHEN label <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS n
  FROM labels WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), lines AS (
  SELECT w.conv_id, w.k, CASE WHEN label = 'K' THEN f.role WHEN (w.nth - n % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN label = 'I' THEN '' ELSE f.text END AS line
  FROM walked w LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos WHERE label <> 'D'
), hashes AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY k)) AS repaired_sha256 FROM lines GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (former IS NOT NULL AND NOT (former, initial) IN (('s', 'u'), ('u', 'a'), ('a', 'u'))) AS illegal
  FROM faults GROUP BY conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(e.best.cost, 0) AS cost, coalesce(e.best.label, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM ids i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN hashes h ON h.conv_id IS NOT DISTINCT FROM i.conv_id"""
ORACLES["op13_fim"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units
  FROM documents
), c AS (
  SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
    array_to_string(units[greatest(a, b) + 1:], '') AS suffix
  FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
