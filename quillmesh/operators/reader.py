"""Read side: lists with cursors, facets, filters."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cards as c


def encode_cursor(revision: str, after: tuple[str, ...]) -> str:
    return base64.urlsafe_b64encode(json.dumps({"revision": revision, "after": after}).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, revision: str) -> tuple[str, ...]:
    data = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    if data["revision"] != revision:
        raise ValueError("the cursor belongs to another revision")
    return tuple(data["after"])


def page(cards: DataFrame, revision: str, limit: int = 50, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """Cards by latest update, title and id: a page and the cursor of the next one.

    The cursor holds the last row's sort key, so a later page is a filter and a top-k and
    not a longer and longer offset.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    rows = cards
    if cursor:
        updated, title, id_ = decode_cursor(cursor, revision)
        u, t, i = F.col("updated_at"), F.col("title"), F.col("id")
        rows = rows.where((u < updated) | ((u == updated) & ((t > title) | ((t == title) & (i > id_)))))
    top = rows.orderBy(F.desc("updated_at"), "title", "id").limit(limit + 1)
    found = top.select("updated_at", "title", "id").collect()
    more = len(found) > limit
    return top.orderBy(F.desc("updated_at"), "title", "id").limit(limit), encode_cursor(revision, tuple(found[limit - 1])) if more else None


def _named(facet: str) -> Column:
    return F.transform(c.effective_list(facet), lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))


def facets(cards: DataFrame) -> DataFrame:
    """(facet, value, n) of categories, tags, actions and status, and of cards with high relevance."""
    each = F.explode(
        F.concat(
            *(_named(x) for x in ("categories", "tags", "actions")),
            F.array(F.struct(F.lit("status").alias("facet"), c.effective("status").alias("value"))),
            F.when(c.effective_relevance()["overall"] >= c.HIGH, F.array(F.struct(F.lit("high_relevance").alias("facet"), F.lit("overall").alias("value")))).otherwise(F.array().cast("array<struct<facet:string,value:string>>")),
        )
    )
    return cards.select(each.alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


def filter_cards(cards: DataFrame, categories: tuple = (), tags: tuple = (), actions: tuple = (), statuses: tuple = (), minimum: int = 1, needle: str = "") -> DataFrame:
    """Cards with any chosen value of each facet, enough relevance, and the needle in their text."""
    keep: Column = F.coalesce(c.effective_relevance()["overall"], F.lit(0)) >= minimum
    for wrapper, chosen in (("categories", categories), ("tags", tags), ("actions", actions)):
        if chosen:
            keep = keep & F.arrays_overlap(c.effective_list(wrapper), F.array(*map(F.lit, chosen)))
    if statuses:
        keep = keep & c.effective("status").isin(*statuses)
    if needle.strip():
        hay = F.concat_ws(" ", "title", "summary", c.effective("status"), *(F.array_join(c.effective_list(x), " ") for x in ("categories", "tags", "actions")))
        keep = keep & F.contains(F.lower(hay), F.lit(needle.strip().lower()))
    return cards.where(keep)
