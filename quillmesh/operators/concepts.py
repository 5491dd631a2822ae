"""Concepts: shared categories, tags and promoted rules, their cards, and which occur together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import to_fixed
from ..functions.text import concept_slug, normalize_search_text
from . import cards as c
from .greedy import degree_capped

MIN_TAG_SUPPORT, MIN_RELATION_SUPPORT, RELATION_TOP_K = 2, 2, 8


@dataclass(frozen=True)
class Promoted:
    """A concept for all cards with any of the categories or tags."""

    id: str
    label: str
    type: str = "promoted"
    categories_any: tuple[str, ...] = ()
    tags_any: tuple[str, ...] = ()


def slug(value: Column) -> Column:
    return concept_slug(normalize_search_text(value, compatible=False))


def _values(cards: DataFrame, wrapper: str) -> DataFrame:
    return cards.select("id", "ord", F.explode(F.array_sort(F.array_distinct(c.effective_list(wrapper)))).alias("value")).withColumn("slug", slug(F.col("value"))).where("slug <> ''")


def tag_support(cards: DataFrame) -> DataFrame:
    """(slug, support): distinct cards of each normalised tag."""
    return _values(cards, "tags").select("id", "slug").distinct().groupBy("slug").agg(F.count(F.lit(1)).alias("support"))


def memberships(cards: DataFrame, promoted: tuple[Promoted, ...] = (), min_support: int = MIN_TAG_SUPPORT) -> DataFrame:
    """(card_id, ord, concept_id, origin, strength, evidence, label, type): one row a card and concept.

    Of several sources of one concept the first counts: category, tag, promoted; within
    one the first value.
    """
    cats = _values(cards, "categories").select(
        F.col("id").alias("card_id"), "ord", F.concat(F.lit("category-"), "slug").alias("concept_id"), F.lit(0).alias("rank"), F.col("value").alias("label"),
        F.lit("category").alias("type"), F.lit(1.0).alias("strength"), F.concat(F.lit("category:"), "value").alias("evidence"),
    )
    enough = tag_support(cards).where(F.col("support") >= min_support).select("slug")
    tags = _values(cards, "tags").join(enough, "slug", "left_semi").select(
        F.col("id").alias("card_id"), "ord", F.concat(F.lit("tag-"), "slug").alias("concept_id"), F.lit(1).alias("rank"), F.col("value").alias("label"),
        F.lit("tag").alias("type"), F.lit(0.8).alias("strength"), F.concat(F.lit("tag:"), "value").alias("evidence"),
    )
    found = cats.unionByName(tags)
    own_tags = F.transform(c.effective_list("tags"), slug)
    for k, rule in enumerate(promoted):
        by_cat = F.filter(F.array(*map(F.lit, rule.categories_any)).cast("array<string>"), lambda x: F.array_contains(c.effective_list("categories"), x))
        by_tag = F.filter(F.array(*map(F.lit, rule.tags_any)).cast("array<string>"), lambda x: F.array_contains(own_tags, slug(x)))
        hit = cards.withColumns({"_c": by_cat, "_t": by_tag}).withColumn("_n", F.size("_c") + F.size("_t")).where("_n > 0")
        evidence = F.concat(F.transform("_c", lambda x: F.concat(F.lit("category:"), x)), F.transform("_t", lambda x: F.concat(F.lit("tag:"), x)))
        found = found.unionByName(hit.select(
            F.col("id").alias("card_id"), "ord", F.lit(rule.id).alias("concept_id"), F.lit(2 + k).alias("rank"), F.lit(rule.label).alias("label"),
            F.lit(rule.type).alias("type"), F.least(F.lit(1.0), F.lit(0.75) + F.col("_n") * 0.05).alias("strength"), F.array_join(evidence, ",").alias("evidence"),
        ))
    first = F.min_by(F.struct("origin", "strength", "evidence", "label", "type"), F.struct("rank", "label"))
    found = found.withColumn("origin", F.when(F.col("rank") < 2, F.col("type")).otherwise(F.lit("promoted")))
    return found.groupBy("card_id", "ord", "concept_id").agg(first.alias("x")).select("card_id", "ord", "concept_id", "x.*")


def concepts(members: DataFrame) -> DataFrame:
    """(id, label, type, card_count); label and type are those of the first card."""
    first = F.min_by(F.struct("label", "type"), F.struct("ord", "label"))
    return members.groupBy("concept_id").agg(first.alias("x"), F.count(F.lit(1)).alias("card_count")).select(F.col("concept_id").alias("id"), "x.label", "x.type", "card_count")


def co_occurrence(members: DataFrame, min_support: int = MIN_RELATION_SUPPORT) -> DataFrame:
    """(source, target, support, weight): concepts that share cards, before the degree cap.

    Pairs are made within each card's sorted list, so a row is a card's pair and partial
    sums leave each task with one row a pair.
    """
    lists = members.groupBy("card_id").agg(F.array_sort(F.collect_set("concept_id")).alias("ids"))
    pairs = lists.select(F.explode(F.flatten(F.transform("ids", lambda a, i: F.transform(F.filter("ids", lambda b: b > a), lambda b: F.struct(a.alias("source"), b.alias("target")))))).alias("p"))
    support = pairs.groupBy("p.source", "p.target").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_support)
    size = concepts(members).select("id", "card_count")
    a, b = size.select(F.col("id").alias("source"), F.col("card_count").alias("m")), size.select(F.col("id").alias("target"), F.col("card_count").alias("n"))
    return support.join(a, "source").join(b, "target").select("source", "target", "support", to_fixed(F.col("support") / F.least("m", "n"), 6).alias("weight"))


def concept_relations(members: DataFrame, min_support: int = MIN_RELATION_SUPPORT, top_k: int = RELATION_TOP_K) -> DataFrame:
    order = [(-F.col("weight")).alias("w"), (-F.col("support")).alias("s"), F.concat("source", "target").alias("k")]
    return degree_capped(co_occurrence(members, min_support), top_k, order)
