"""Judgements on how posts continue: their shape, whether they are accepted, and the thread that an accepted one makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contracts import MIN_CONFIDENCE, MIN_LABEL, MIN_METADATA

#: What a judgement holds, the labels of a candidate, and the sizes allowed: fixed values.
REQUIRED = ("selected_shortcodes", "root_only", "confidence", "complete", "rationale")
OPTIONAL = ("candidate_labels",)
LABELS, EXCLUDED = ("continuation", "followup", "unrelated", "uncertain"), ("followup", "unrelated")
MOST_ITEMS, CODE_LENGTH, RATIONALE_LENGTH = 8, 128, 1_000
#: Why a thread may be completed by a judgement: fixed values.
RECOVERABLE = ("conversation_coverage_unverified", "input_not_in_author_chain")


def first_broken(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule that is broken; null conditions count as kept."""
    return F.coalesce(*(F.when(broken, F.lit(name)) for broken, name in rules), F.lit(None).cast("string"))


def shape_issues(judgement: Column) -> Column:
    """array<string>: what is wrong with the form of a judgement, a JSON text (column string), as sorted distinct codes."""

    def once(value: Column, then) -> Column:
        """then(value), with the value computed once however often it is used."""
        return F.get(F.transform(F.array(value), then), F.lit(0))

    labels = F.from_json(F.get_json_object(judgement, "$.candidate_labels"), "array<map<string,string>>")
    known = lambda data: F.struct(
        data.alias("data"), F.json_object_keys(F.when(data.isNotNull(), judgement)).alias("keys"), F.try_variant_get(data, "$.selected_shortcodes", "array<variant>").alias("codes"), F.when(data.isNotNull(), labels).alias("labels")
    )
    return once(F.try_parse_json(judgement), lambda data: once(known(data), lambda x: _shape_issues(x["data"], x["keys"], x["codes"], x["labels"])))


def _shape_issues(data: Column, keys: Column, codes: Column, labels: Column) -> Column:
    at = lambda path, kind="variant": F.try_variant_get(data, f"$.{path}", kind)
    is_kind = lambda path, *kinds: F.coalesce(F.regexp_extract(F.schema_of_variant(at(path)), "^[A-Z]+", 0).isin(*kinds), F.lit(False))
    is_object, numbers = F.coalesce(F.schema_of_variant(data).startswith("OBJECT"), F.lit(False)), ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
    code_bad = lambda c: ~F.coalesce((F.schema_of_variant(c) == "STRING") & F.length(F.try_variant_get(c, "$", "string")).between(1, CODE_LENGTH), F.lit(False))
    share = lambda path: is_kind(path, *numbers) & F.coalesce(at(path, "double").between(0, 1), F.lit(False))
    label_bad = lambda m: (
        ~F.coalesce(F.array_sort(F.map_keys(m)) == F.array(*map(F.lit, ("confidence", "label", "shortcode"))), F.lit(False))
        | ~F.coalesce(F.try_element_at(m, F.lit("label")).isin(*LABELS), F.lit(False))
        | ~F.coalesce(F.length(F.try_element_at(m, F.lit("shortcode"))).between(1, CODE_LENGTH), F.lit(False))
        | ~F.coalesce(F.try_element_at(m, F.lit("confidence")).try_cast("double").between(0, 1), F.lit(False))
    )
    has = lambda key: F.coalesce(F.array_contains(keys, F.lit(key)), F.lit(False))
    checks = [(~has(k), f"{k}_missing") for k in REQUIRED]
    checks += [
        (F.size(F.array_except(keys, F.array(*map(F.lit, (*REQUIRED, *OPTIONAL))))) > 0, "key_unknown"),
        (~is_kind("selected_shortcodes", "ARRAY") | (F.size(codes) > MOST_ITEMS), "selected_invalid"),
        (F.exists(codes, code_bad), "shortcode_invalid"),
        (F.size(F.array_distinct(F.transform(codes, lambda c: F.try_variant_get(c, "$", "string")))) < F.size(codes), "shortcode_repeats"),
        (~is_kind("root_only", "BOOLEAN"), "root_only_invalid"),
        (~is_kind("complete", "BOOLEAN"), "complete_invalid"),
        (~share("confidence"), "confidence_invalid"),
        (~is_kind("rationale", "STRING") | (F.length(at("rationale", "string")) > RATIONALE_LENGTH), "rationale_invalid"),
        (has("candidate_labels") & (~is_kind("candidate_labels", "ARRAY") | (F.size(labels) > MOST_ITEMS)), "labels_invalid"),
        (has("candidate_labels") & F.exists(labels, label_bad), "label_invalid"),
    ]
    found = F.array_sort(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for c, k in checks))))
    return F.when(is_object, found).otherwise(F.array(F.lit("not_an_object")))


def _root_only_rules() -> list[tuple[Column, str]]:
    """What must hold before a judgement may say that nothing continues the root: every candidate is excluded with confidence."""
    codes, named = F.col("candidate_codes"), F.transform("labels", lambda x: x["shortcode"])
    sure = lambda x: F.coalesce(x["confidence"].between(MIN_LABEL, 1), F.lit(False))
    return [
        (F.size("selected") > 0, "root_only_with_selection"),
        (F.size(codes) == 0, "root_only_without_candidates"),
        (F.exists(codes, lambda x: F.coalesce(x, F.lit("")) == ""), "candidate_without_code"),
        (F.size("labels") != F.size(codes), "labels_incomplete"),
        (F.exists(named, lambda x: F.coalesce(x, F.lit("")) == "") | (F.size(F.array_distinct(named)) < F.size(named)), "labels_invalid"),
        (F.size(F.array_except(codes, named)) > 0, "labels_incomplete"),
        (F.exists("labels", lambda x: ~F.coalesce(F.lower(x["label"]).isin(*EXCLUDED), F.lit(False))), "candidate_not_excluded"),
        (F.exists("labels", lambda x: ~sure(x)), "label_confidence_below_threshold"),
    ]


def judge_selection(rows: DataFrame) -> DataFrame:
    """rows with `accepted` and `reason`, the first rule that a continuation judgement breaks.

    rows: complete, confidence, author, selected (array of codes), candidates (map of code to
    struct<is_reply, score, delta, author>); and, where judgements may be about the root alone, root_only, candidate_codes (array) and
    labels (array<struct<shortcode, label, confidence>>).
    """
    chosen = F.transform("selected", lambda s: F.try_element_at("candidates", s))
    delta = F.filter(F.transform(chosen, lambda x: x["delta"]), lambda d: d.isNotNull())
    always = [
        (~F.coalesce(F.col("complete"), F.lit(False)), "not_complete"),
        (~F.coalesce(F.col("confidence").between(MIN_CONFIDENCE, 1), F.lit(False)), "confidence_below_threshold"),
    ]
    thread = [
        (F.coalesce(F.size("selected"), F.lit(0)) < 1, "invalid_sequence"),
        (F.size(F.array_distinct("selected")) < F.size("selected"), "invalid_sequence"),
        (F.exists(chosen, lambda x: x.isNull()), "not_in_evidence"),
        (F.exists(chosen, lambda x: x["is_reply"] == F.lit(False)), "not_reply"),
        (F.get(chosen, F.lit(0))["score"] < MIN_METADATA, "metadata_too_weak"),
        (delta != F.array_sort(delta), "not_chronological"),
        (F.exists(chosen, lambda x: F.lower(x["author"]) != F.lower(F.col("author"))), "author_mismatch"),
    ]
    branch = first_broken(thread)
    if "root_only" in rows.columns:
        branch = F.when(F.coalesce(F.col("root_only"), F.lit(False)), first_broken(_root_only_rules())).otherwise(branch)
    found = rows.withColumn("reason", F.coalesce(first_broken(always), branch))
    return found.withColumn("accepted", F.col("reason").isNull())


def infer_threads(sources: DataFrame, judged: DataFrame, posts: DataFrame) -> DataFrame:
    """(key, status, complete, total, reason, method, text): sources as they are after recovery.

    sources: key, root, status, reason, indicator (null: none); judged: key, accepted, reason, root_only, selected (array of post ids); posts: id,
    text. A source whose coverage could not be verified becomes a thread of its root and the selected posts if its judgement was accepted, and
    stays incomplete, with the judgement's reason, if not. All others stay as they are; texts that are empty are left out of the whole.
    """
    may = (F.col("status") == "INCOMPLETE_THREAD") & F.col("indicator").isNull() & F.col("s.reason").isin(*RECOVERABLE)
    j = judged.select(F.col("key").alias("_k"), "accepted", F.col("reason").alias("_why"), F.coalesce("root_only", F.lit(False)).alias("root_only"), "selected")
    state = sources.alias("s").join(j, F.col("s.key") == F.col("_k"), "left").withColumns({"_may": F.coalesce(may, F.lit(False)), "_yes": F.coalesce(may & F.col("accepted"), F.lit(False))})
    parts = F.when(F.col("_yes") & ~F.col("root_only"), F.concat(F.array("root"), F.col("selected"))).otherwise(F.array("root"))
    state = state.withColumn("_parts", parts)
    each = state.where("_yes").select("key", F.posexplode("_parts").alias("at", "id")).join(posts, "id", "left").where(F.coalesce("text", F.lit("")) != "")
    # A judgement names a few posts at most.
    whole = each.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    named = F.when(F.col("root_only"), F.lit("INFERRED_SINGLE_POST_HIGH_CONFIDENCE")).otherwise(F.lit("INFERRED_THREAD_HIGH_CONFIDENCE"))
    return state.join(whole, "key", "left").select(
        "key",
        F.when(F.col("_yes"), named).otherwise(F.col("status")).alias("status"),
        (F.col("_yes") | F.col("status").isin("SINGLE_POST", "COMPLETE_THREAD")).alias("complete"),
        F.when(F.col("_yes"), F.size("_parts")).alias("total"),
        F.when(F.col("_yes"), F.lit(None)).when(F.col("_may") & F.col("_k").isNotNull(), F.col("_why")).otherwise(F.col("s.reason")).alias("reason"),
        F.when(F.col("_yes"), F.when(F.col("root_only"), F.lit("root_only")).otherwise(F.lit("continuation"))).alias("method"),
        "text",
    )
