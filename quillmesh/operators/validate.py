"""Validators: broken rules as rows of (key, code, path, message); nothing means valid."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import schema
from .contracts import body_issues

ISSUE = ("key", "code", "path", "message")


def check(rows: DataFrame, key: str, rules: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """An issue for each row and rule whose condition holds; rules: code to (condition, path)."""
    found = F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"))) for code, (cond, path) in rules.items()))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(found)).alias("i")).select(
        "key", "i.code", "i.path", F.concat_ws(" ", "i.path", F.lit("breaks"), "i.code").alias("message")
    )


def unknown_values(rows: DataFrame, key: str, values: Column, vocabulary: DataFrame, path: str) -> DataFrame:
    """An issue for each value of a list that the vocabulary (column value) lacks."""
    each = rows.select(F.col(key).cast("string").alias("key"), F.explode(values).alias("value")).distinct()
    return each.join(vocabulary.select("value"), "value", "left_anti").select(
        "key", F.lit("value_unknown").alias("code"), F.lit(path).alias("path"), F.concat(F.lit("unknown value: "), "value").alias("message")
    )


def duplicates(rows: DataFrame, key: str, order: str, paths: Mapping[str, Column]) -> DataFrame:
    """An issue for the second and later rows of a value that must be unique, naming the first.

    The first row of each value comes from a partial aggregate and not from a sorted window, so
    a value that very many rows share stays cheap.
    """
    each = rows.select(F.col(key).cast("string").alias("key"), F.col(order).alias("ord"), F.explode(F.create_map(*(x for k, v in paths.items() for x in (F.lit(k), v)))).alias("path", "value")).where("value is not null")
    first = each.groupBy("path", "value").agg(F.min(F.struct("ord", "key")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return each.join(first, ["path", "value"]).where(F.col("key") != F.col("first.key")).select(
        "key", F.lit("not_unique").alias("code"), "path", F.concat(F.lit("first used by "), "first.key").alias("message")
    )


def tag_policy(rows: DataFrame, key: str, tags: Column, canonical: DataFrame, low: int, high: int) -> DataFrame:
    """Issues of count, order and tags that are not canonical."""
    listed = rows.withColumn("_tags", tags)
    shape = check(
        listed,
        key,
        {
            "tag_count": (~F.size("_tags").between(low, high), "tags"),
            "tags_not_sorted": (~F.array_sort("_tags").eqNullSafe(F.col("_tags")), "tags"),
        },
    )
    return shape.unionByName(unknown_values(listed, key, F.col("_tags"), canonical, "tags"))


def resolve_tags(values: DataFrame, policy: DataFrame) -> DataFrame:
    """(value, tag): the controlled tag of each value, or null.

    policy: (name, tag, kind), kind "canonical" or "alias". An exact name wins over one in
    other case, and a canonical name over an alias.
    """
    named = policy.withColumn("rank", F.when(F.col("kind") == "canonical", 0).otherwise(1))
    exact = named.select(F.col("name").alias("n"), "tag", "rank")
    loose = named.select(F.lower("name").alias("n"), "tag", (F.col("rank") + 2).alias("rank"))
    v = values.select("value").distinct()
    hits = v.join(exact, F.col("value") == F.col("n")).unionByName(v.join(loose, F.lower("value") == F.col("n")))
    best = hits.groupBy("value").agg(F.min_by("tag", F.struct("rank", "tag")).alias("tag"))
    return v.join(best, "value", "left")


def date_order(rows: DataFrame, key: str) -> DataFrame:
    return check(rows, key, {"updated_before_created": (F.col("updated_at") < F.col("created_at"), "updated_at")})


def owned_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field): what a user owns and an update would change or lose."""
    a, b = before.alias("a"), after.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"))
    changed = F.array_compact(F.array(*(F.when(~F.col(f"a.{f}.user").eqNullSafe(F.col(f"b.{f}.user")), F.lit(f)) for f in fields)))
    return joined.select(F.col(f"a.{key}").alias("key"), F.explode(changed).alias("field"))


def _matches(code: str, pattern: str) -> Column:
    found = F.regexp_extract_all("line_text", F.lit(f"({pattern})"), F.lit(1))
    return F.transform(found, lambda m: F.struct(F.lit(code).alias("code"), m.alias("match")))


def policy_patterns(rows: DataFrame, key: str, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """(key, code, line, match) for each match of a pattern in a text's lines, lines from 1."""
    lines = rows.select(F.col(key).alias("key"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("at", "line_text"))
    hit = lines.where(F.col("line_text").rlike("|".join(f"(?:{p})" for p in patterns.values())))
    found = F.flatten(F.array(*(_matches(code, p) for code, p in patterns.items())))
    return hit.select("key", (F.col("at") + 1).alias("line"), F.explode(found).alias("f")).select("key", "f.code", "line", "f.match")


def missing_parent(rows: DataFrame, key: str, foreign: Column, parents: DataFrame, parent_key: str, path: str) -> DataFrame:
    """An issue for each row whose reference has no target."""
    r = rows.select(F.col(key).cast("string").alias("key"), foreign.alias("_f"))
    return r.join(parents.select(F.col(parent_key).alias("_f")), "_f", "left_anti").select(
        "key", F.lit("reference_missing").alias("code"), F.lit(path).alias("path"), F.concat(F.lit("no "), F.lit(path), F.lit(" "), F.coalesce(F.col("_f").cast("string"), F.lit("null"))).alias("message")
    )


def artifact_issues(cards: DataFrame, search: DataFrame, vectors: DataFrame, relations: DataFrame, concepts: DataFrame, members: DataFrame, concept_relations: DataFrame, directional: tuple[str, ...], types: tuple[str, ...], dimensions: int) -> DataFrame:
    """Everything that must hold between the derived tables before they are published."""

    def once(df: DataFrame, name: str) -> DataFrame:
        repeated = df.groupBy("id").count().where("count > 1").select(F.col("id").alias("key"), F.lit(f"{name}_repeats").alias("code"))
        lost = cards.select("id").join(df.select("id"), "id", "left_anti").select(F.col("id").alias("key"), F.lit(f"{name}_missing").alias("code"))
        extra = df.select("id").join(cards.select("id"), "id", "left_anti").select(F.col("id").alias("key"), F.lit(f"{name}_unknown_card").alias("code"))
        return repeated.unionByName(lost).unionByName(extra)

    def bad(df: DataFrame, key: Column, rules: Mapping[str, Column]) -> DataFrame:
        found = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(True)), F.lit(code)) for code, cond in rules.items())))
        return df.select(key.alias("key"), F.explode(found).alias("code"))

    def unknown(df: DataFrame, column: str, known: DataFrame, code: str) -> DataFrame:
        return df.select(F.col(column).alias("id")).join(known.select("id"), "id", "left_anti").select(F.col("id").alias("key"), F.lit(code).alias("code"))

    way = F.col("direction").isin("source_to_target", "target_to_source")
    is_directional = F.col("type").isin(*directional)
    parts = [
        once(search, "search"),
        once(vectors, "vectors"),
        bad(vectors, F.col("id"), {"vector_dimensions": F.size("vector") != dimensions}),
        unknown(relations, "source", cards, "relation_unknown_card"),
        unknown(relations, "target", cards, "relation_unknown_card"),
        bad(
            relations,
            F.col("pair_id"),
            {
                "relation_self": F.col("source") == F.col("target"),
                "relation_type": ~F.col("type").isin(*types),
                "relation_direction": F.when(is_directional, ~way).otherwise(F.col("direction") != "undirected"),
                "relation_method": F.col("method") == "",
            },
        ),
        relations.groupBy("pair_id").count().where("count > 1").select(F.col("pair_id").alias("key"), F.lit("relation_repeats").alias("code")),
        unknown(members, "card_id", cards, "member_unknown_card"),
        unknown(members, "concept_id", concepts, "member_unknown_concept"),
        bad(members, F.col("concept_id"), {"member_strength": ~F.col("strength").between(0, 1), "member_evidence": F.col("evidence") == ""}),
        unknown(concept_relations, "source", concepts, "concept_relation_unknown"),
        unknown(concept_relations, "target", concepts, "concept_relation_unknown"),
        bad(
            concept_relations,
            F.concat("source", F.lit("::"), "target"),
            {
                "concept_relation_self": F.col("source") == F.col("target"),
                "concept_relation_support": F.col("support") < 1,
                "concept_relation_weight": ~F.col("weight").between(0, 1),
            },
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def collection_issues(rows: DataFrame, key: str, shaped: Column, shape: dict, body: Column, title: Column, sections: tuple[str, ...], tags: Column, canonical: DataFrame, unique: Mapping[str, Column]) -> DataFrame:
    """(key, area, code): everything that is wrong with cards one by one and with the collection as a whole.

    Areas: schema (a typed value against a schema), body, dates, taxonomy, and collection (values that must be unique).
    """
    each = lambda found, area: rows.select(F.col(key).alias("key"), F.lit(area).alias("area"), F.explode(found).alias("code"))
    of = lambda issues, area: issues.select("key", F.lit(area).alias("area"), "code")
    parts = [
        each(F.transform(schema.issues(shaped, shape), lambda i: i["code"]), "schema"),
        each(body_issues(body, title, sections), "body"),
        of(date_order(rows, key), "dates"),
        of(unknown_values(rows, key, tags, canonical, "tags"), "taxonomy"),
        of(duplicates(rows, key, key, unique), "collection"),
    ]
    return reduce(DataFrame.unionByName, parts)


def require_none(issues: DataFrame, what: str) -> None:
    """Refuse to go on where any issue exists; the message holds the first few."""
    if some := issues.orderBy("key", "code").limit(5).collect():
        raise ValueError(f"{what}: " + "; ".join(f"{r['code']} {r['key']}" for r in some))


def row_hash(*columns: str | Column) -> Column:
    """SHA-256 of values in a fixed order; null and empty are told apart."""
    parts = (F.coalesce(F.concat(F.lit("v"), (F.col(c) if isinstance(c, str) else c).cast("string")), F.lit("n")) for c in columns)
    return F.sha2(F.concat_ws("\x01", *parts).cast("binary"), 256)


def set_hash(rows: DataFrame, group: str, item: Column) -> DataFrame:
    """(group, digest): a digest of a group's items whatever their order: the exact sum of their hashes."""
    part = F.conv(F.substring(F.sha2(item.cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(group).agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)), F.sum(part).cast("string")).cast("binary"), 256).alias("digest"))


def ranked_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an order that ends in something unique."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
