"""Threads put together from several sources, until each is complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .conversations import chains_and_posts, combined_text, completeness
from .rounds import checkpoint

INDICATOR = "struct<index: int, total: int>"
_POST = ("username", "text", "reply_to", "root_post", "is_reply", "has_replies", "turn")


def valid_indicator(value: Column) -> Column:
    """An indicator (index, total) where it can be one; else null."""
    return F.when((value["index"] >= 1) & (value["total"] >= value["index"]), value)


def choose_indicator(adapter: Column, page: Column, structured: Column) -> Column:
    """struct<index, total, conflict>: the adapter's indicator, else the page's, else the posts' own; none, and a conflict, where their totals differ."""
    known = F.array_compact(F.array(valid_indicator(adapter), valid_indicator(page), valid_indicator(structured)))
    apart = F.size(F.array_distinct(F.transform(known, lambda x: x["total"]))) > 1
    first = F.get(known, F.lit(0))
    return F.struct(F.when(~apart, first["index"]).alias("index"), F.when(~apart, first["total"]).alias("total"), apart.alias("conflict"))


def merge_records(records: DataFrame, more: DataFrame) -> DataFrame:
    """Posts of two sources, one row a post (conv_id, id): the first source's, unless it has no text and the other one has; a missing hint is the other's."""
    ranked = records.withColumn("_rank", F.lit(0)).unionByName(more.withColumn("_rank", F.lit(1)))
    bare = F.coalesce(F.col("text"), F.lit("")) == ""
    post = F.struct(*_POST)
    # A group has as many rows as sources tell of a post.
    merged = ranked.groupBy("conv_id", "id").agg(F.min_by(post, F.struct(bare, "_rank")).alias("_p"), F.min_by(F.struct("hint", "hint_total"), F.when(F.col("hint").isNotNull(), F.col("_rank"))).alias("_h"))
    return merged.select("conv_id", "id", "_p.*", "_h.*")


def assemble(records: DataFrame, facts: DataFrame) -> DataFrame:
    """(conv_id, detected, total, status, complete, reason, confidence, text) of each conversation, as its root asks for it.

    records: posts with conv_id, id, the columns of a post, hint and hint_total (a post's own place and number of parts, or null). facts:
    conv_id, adapter and page (indicators or null) and coverage, whether its posts are known to be all.
    """
    chain, theirs = chains_and_posts(records)
    chain = checkpoint(chain)
    members = checkpoint(records.join(theirs, "id", "left_semi"))
    own = members.groupBy("conv_id").agg(
        F.collect_set("hint_total").alias("_totals"), F.min_by("hint", "turn").alias("_root_hint"), F.max_by("has_replies", "turn").alias("last_has_replies"), F.min_by(~F.col("is_reply") & F.col("root_post").isNull(), "turn").alias("_alone")
    )
    structured = F.when(F.size("_totals") == 1, F.struct(F.coalesce("_root_hint", F.lit(1)).alias("index"), F.get("_totals", F.lit(0)).alias("total")).cast(INDICATOR))
    state = chain.join(own, "conv_id", "left").join(facts, "conv_id", "left").withColumn("i", choose_indicator(F.col("adapter"), F.col("page"), structured))
    state = state.select(
        "conv_id", "ambiguous", "i.conflict", F.col("i.total").cast("long").alias("total"), F.col("i.index").cast("long").alias("index"), F.col("length").alias("detected"), F.when(F.col("length") > 0, 0).otherwise(-1).alias("input_at"),
        F.coalesce("coverage", F.lit(False)).alias("coverage"), "last_has_replies", ((F.col("length") == 1) & F.coalesce("_alone", F.lit(False))).alias("single"),
    )
    found = completeness(state)
    sure = F.col("total").isNotNull() | F.col("coverage")
    confidence = F.when(F.col("complete") & sure, "high").when(~F.col("complete") & (F.col("status") == "AMBIGUOUS_THREAD"), "low").otherwise("medium")
    text = combined_text(members).withColumnRenamed("combined", "text")
    total = F.coalesce("total", F.when(F.col("complete"), F.col("detected")))
    return found.withColumns({"confidence": confidence, "total": total}).join(text, "conv_id", "left").select("conv_id", "detected", "total", "status", "complete", "reason", "confidence", "text")


def merge_until_complete(sources: list[tuple[str, DataFrame, DataFrame]], page: DataFrame) -> DataFrame:
    """assemble()'s rows, with method, for every conversation of the first source, from as few of the sources as make it complete.

    sources: (method, posts, facts) in the order in which they are asked; facts: conv_id, adapter, coverage. page: conv_id and the page's own indicator, column page.
    Each round merges one more source, for those conversations alone that are not complete yet; a source
    that knows nothing of a conversation leaves it as it was. What no source completes is given as the last one left it.
    """
    method, posts, facts = sources[0]
    records = checkpoint(posts)
    state = checkpoint(assemble(records, _facts(facts, page)).withColumn("method", F.lit(method)))
    for method, posts, facts in sources[1:]:
        open_ = state.where(~F.col("complete")).select("conv_id")
        asked = checkpoint(open_.join(posts.select("conv_id").unionByName(facts.select("conv_id")).distinct(), "conv_id", "left_semi"))
        if asked.isEmpty():
            continue
        mine = lambda df, asked=asked: df.join(asked, "conv_id", "left_semi")
        merged = checkpoint(merge_records(mine(records), mine(posts)))
        records = checkpoint(records.join(open_, "conv_id", "left_semi").join(asked, "conv_id", "left_anti").unionByName(merged.select(*records.columns)))
        better = assemble(merged, _facts(mine(facts), page)).withColumn("method", F.lit(method))
        state = checkpoint(state.join(asked, "conv_id", "left_anti").unionByName(better))
    return state


def _facts(facts: DataFrame, page: DataFrame) -> DataFrame:
    kind = {"adapter": F.col("adapter").cast(INDICATOR), "page": F.col("page").cast(INDICATOR)}
    return facts.join(page, "conv_id", "full_outer").withColumns(kind).select("conv_id", "adapter", "page", "coverage")
