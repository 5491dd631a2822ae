"""Posts that reply to each other: roots, one author's chain, continuations, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import to_fixed
from .rounds import checkpoint

#: What a continuation may be late by, and how many are kept: fixed values.
MAX_DELTA_SECONDS, MAX_CANDIDATES = 24 * 60 * 60, 8


def posts(conversations: DataFrame) -> DataFrame:
    """Each turn as a post that replies to the turn before."""
    last = conversations.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    id_ = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    return conversations.join(last, "conv_id").select(
        "conv_id",
        "turn",
        id_(F.col("turn")).alias("id"),
        F.col("role").alias("username"),
        "text",
        F.when(F.col("turn") > 0, id_(F.col("turn") - 1)).alias("reply_to"),
        id_(F.lit(0)).alias("root_post"),
        (F.col("turn") < F.col("_last")).alias("has_replies"),
        (F.col("turn") > 0).alias("is_reply"),
    )


def with_parent(rows: DataFrame) -> DataFrame:
    """(id, parent, parent_username): the post that each post replies to, where it is there."""
    p = rows.select(F.col("id").alias("_p"), F.col("username").alias("parent_username"))
    return rows.join(p, F.col("reply_to") == F.col("_p"), "left").select("id", F.col("_p").alias("parent"), "parent_username")


def roots(rows: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(id, root, reason): the top of each post's reply chain.

    Pointers double their reach each round, so a chain of n posts takes log2(n) joins. A
    post on a cycle, or below one, has no root; one below a missing post has none either.
    """
    parent = rows.select("id", "reply_to").join(rows.select(F.col("id").alias("_p")), F.col("reply_to") == F.col("_p"), "left")
    state = parent.select(
        "id",
        F.coalesce("_p", "id").alias("at"),
        F.col("_p").isNull().alias("done"),
        (F.col("reply_to").isNotNull() & F.col("_p").isNull()).alias("cut"),
    )
    state = checkpoint(state)
    left = state.where("not done").count()
    for _ in range(max_rounds):
        if not left:
            break
        step = state.select(F.col("id").alias("at"), F.col("at").alias("_to"), F.col("done").alias("_d"), F.col("cut").alias("_c"))
        state = checkpoint(
            state.join(step, "at").select(
                "id",
                F.when(F.col("done"), F.col("at")).otherwise(F.col("_to")).alias("at"),
                (F.col("done") | F.col("_d")).alias("done"),
                (F.col("cut") | (~F.col("done") & F.col("_c"))).alias("cut"),
            )
        )
        before, left = left, state.where("not done").count()
        if left == before:
            break  # each round settles some post unless only cycles and what hangs on them are left
    reason = (
        F.when(~F.col("done"), F.lit("cycle"))
        .when(F.col("cut"), F.lit("missing_parent"))
        .when(F.col("id") == F.col("at"), F.lit("target_root"))
        .otherwise(F.lit("walked_parent_chain"))
    )
    return state.select("id", F.when(F.col("done") & ~F.col("cut"), F.col("at")).alias("root"), reason.alias("reason"))


def climb(edges: DataFrame, tops: DataFrame) -> DataFrame:
    """(id, top, hops) of every node that its edges (id, parent; one an id) lead to one of `tops` (id), by joins that double their reach."""
    top = tops.select(F.col("id").alias("_t"))
    state = edges.join(top, F.col("parent") == F.col("_t"), "left").select("id", F.col("parent").alias("at"), F.lit(1).cast("long").alias("hops"), F.col("_t").isNotNull().alias("done"))
    state, left = checkpoint(state), None
    while (now := state.where("not done").count()) and now != left:  # each round settles some node unless only cycles are left
        left = now
        step = state.select(F.col("id").alias("at"), F.col("at").alias("_to"), F.col("hops").alias("_h"), F.col("done").alias("_d"))
        further = state.where("not done").join(step, "at").select("id", F.col("_to").alias("at"), (F.col("hops") + F.col("_h")).alias("hops"), F.col("_d").alias("done"))
        state = checkpoint(state.where("done").unionByName(further))
    return state.where("done").select("id", F.col("at").alias("top"), "hops")


def author_chains(rows: DataFrame) -> DataFrame:
    """The first of chains_and_posts()."""
    return chains_and_posts(rows)[0]


def chains_and_posts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length, last, ambiguous): from each root the one child by the same author, and so on; and (id): the posts of all chains.

    The root is the first post, by id, that replies to nothing. Where two children could follow, the one whose
    indicator (column hint) alone names the next place is taken; otherwise the chain is ambiguous. A conversation
    without a root has length 0. Chains are followed by joins that double their reach, so a conversation is never one task's group.
    """
    hinted = rows if "hint" in rows.columns else rows.withColumn("hint", F.lit(None).cast("int"))
    posts_ = checkpoint(hinted.select("conv_id", "id", F.lower("username").alias("author"), "reply_to", "hint"))
    root = posts_.where("reply_to is null").groupBy("conv_id").agg(F.min(F.struct("id", "author")).alias("r")).select("conv_id", F.col("r.id").alias("root"), F.col("r.author").alias("root_author"))
    every = posts_.select("conv_id").distinct().join(root, "conv_id", "left")
    known = posts_.select("conv_id", F.col("id").alias("parent"))
    own = posts_.join(root.where("root_author != ''"), "conv_id").where((F.col("author") == F.col("root_author")) & (F.col("id") != F.col("root")) & (F.col("reply_to") != F.col("id")))
    edges = checkpoint(own.select("conv_id", "id", F.col("reply_to").alias("parent"), "hint").join(known, ["conv_id", "parent"], "left_semi"))
    tops = root.select(F.col("root").alias("id"))
    # A reply's place in the chain is its distance from the root.
    placed = checkpoint(edges.join(climb(edges.select("id", "parent"), tops), "id"))
    hits = F.col("hint") == F.col("hops") + 1
    follow = placed.groupBy("parent").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("one"), F.count_if(hits).alias("hinted"), F.min(F.when(hits, F.col("id"))).alias("named")
    )
    follow = checkpoint(follow.select("parent", F.when(F.col("n") == 1, F.col("one")).when(F.col("hinted") == 1, F.col("named")).alias("next"), ((F.col("n") > 1) & (F.col("hinted") != 1)).alias("unclear")))
    line = climb(follow.where("next is not null").select(F.col("next").alias("id"), "parent"), tops)
    chain = line.unionByName(tops.select("id", F.col("id").alias("top"), F.lit(0).cast("long").alias("hops")))
    last = chain.groupBy("top").agg(F.max(F.struct("hops", "id")).alias("x")).select(F.col("top").alias("root"), (F.col("x.hops") + 1).alias("length"), F.col("x.id").alias("last"))
    ended = last.join(follow.select(F.col("parent").alias("last"), "unclear"), "last", "left")
    found = every.join(ended, "root", "left").select("conv_id", F.coalesce("length", F.lit(0).cast("long")).alias("length"), "last", F.coalesce("unclear", F.lit(False)).alias("ambiguous"))
    return found, chain.select("id")


def indicator(text: Column) -> Column:
    """struct<index, total> where a text names exactly one place "i / n" with 1 <= i <= n, 2 <= n <= 100."""
    found = F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(r"[^\d](\d{1,3}\s*/\s*\d{1,3})(?!\d)"), F.lit(1))
    pair = F.transform(found, lambda s: F.struct(F.regexp_extract(s, r"^(\d+)", 1).cast("int").alias("index"), F.regexp_extract(s, r"(\d+)$", 1).cast("int").alias("total")))
    good = F.array_distinct(F.filter(pair, lambda p: (p["index"] >= 1) & (p["total"] >= 2) & (p["index"] <= p["total"]) & (p["total"] <= 100)))
    return F.when(F.size(good) == 1, F.get(good, F.lit(0)))


def metadata_score(is_reply: Column, delta: Column, text: Column, has_replies: Column) -> Column:
    """How likely a post continues another, from 0 to 1 at 3 places. Shares: fixed values."""
    score = F.when(is_reply, 0.45).when(is_reply.isNull(), 0.08).otherwise(0.0)
    late = F.when(delta < 0, 0.0).when(delta <= 300, 0.35).when(delta <= 1800, 0.25).when(delta <= 10800, 0.15).when(delta <= 43200, 0.08).when(delta <= 86400, 0.04).otherwise(0.0)
    some = F.when(F.coalesce(F.trim(text), F.lit("")) != "", 0.05).otherwise(0.0)
    known = F.when(has_replies.isNotNull(), 0.03).otherwise(0.0)
    return F.least(F.lit(1.0), to_fixed(score + F.coalesce(late, F.lit(0.0)) + some + known, 3))


def continuations(rooted: DataFrame, limit: int = MAX_CANDIDATES, max_delta: int = MAX_DELTA_SECONDS) -> DataFrame:
    """The first candidates of each root: soonest, then best score, then id.

    rooted: (root, root_ts, root_author, id, author, ts, is_reply, text, has_replies), a row for each
    pair to consider.
    """
    # To the nearest second, halves away from the root.
    delta = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("root_ts").cast("timestamp"))) / 1e6 + 0.5).cast("long")
    kept = (
        rooted.withColumn("delta", delta)
        .where((F.col("id") != F.col("root")) & (F.lower("author") == F.lower("root_author")) & F.coalesce(F.col("is_reply"), F.lit(True)))
        .where((F.col("delta") >= 0) & (F.col("delta") <= max_delta))
        .withColumn("score", metadata_score(F.col("is_reply"), F.col("delta"), F.col("text"), F.col("has_replies")))
    )
    place = F.row_number().over(Window.partitionBy("root").orderBy("delta", F.desc("score"), "id"))
    return kept.withColumn("place", place).where(F.col("place") <= limit).select("root", "id", "delta", "score", "place")


def completeness(rows: DataFrame) -> DataFrame:
    """status, complete and reason from what is known of a chain.

    rows: ambiguous, conflict, total and index (the indicator, or null), detected (posts of the
    chain), input_at (place of the asked post in it from 0, or -1), coverage, last_has_replies, single.
    """
    c = F.col
    marked, found = c("total").isNotNull(), c("input_at") >= 0
    exact = (c("detected") == c("total")) & found & (c("input_at") + 1 == c("index"))
    alone = lambda n: F.when(n == 1, F.lit("SINGLE_POST")).otherwise(F.lit("COMPLETE_THREAD"))
    ended = (c("detected") > 1) & (c("last_has_replies") == False) & found  # noqa: E712
    status = (
        F.when(c("ambiguous") | c("conflict"), F.lit("AMBIGUOUS_THREAD"))
        .when(marked & exact, alone(c("total")))
        .when(marked & (c("detected") < c("total")), F.lit("INCOMPLETE_THREAD"))
        .when(marked, F.lit("AMBIGUOUS_THREAD"))
        .when(c("coverage") & found, alone(c("detected")))
        .when(c("single") & (c("input_at") == 0), F.lit("SINGLE_POST"))
        .when(ended, F.lit("COMPLETE_THREAD"))
        .otherwise(F.lit("INCOMPLETE_THREAD"))
    )
    reason = (
        F.when(c("ambiguous"), F.lit("same_author_branch"))
        .when(c("conflict"), F.lit("indicator_conflict"))
        .when(marked & exact, F.lit(None))
        .when(marked & (c("detected") < c("total")), F.lit("missing_parts"))
        .when(marked, F.lit("indicator_mismatch"))
        .when((c("coverage") & found) | (c("single") & (c("input_at") == 0)) | ended, F.lit(None))
        .when(~found, F.lit("input_not_in_author_chain"))
        .otherwise(F.lit("conversation_coverage_unverified"))
    )
    out = rows.withColumns({"status": status, "reason": reason})
    return out.withColumn("complete", F.col("status").isin("SINGLE_POST", "COMPLETE_THREAD"))


def extract_threads(rows: DataFrame, covered: DataFrame) -> DataFrame:
    """(conv_id, detected, status, complete, reason, text) of each conversation's thread, as its root asks for it.

    rows: posts with conv_id, id, username, reply_to, text, turn, has_replies (and hint); covered: conv_id, coverage (whether all
    posts are known). The thread is the author's chain from the root; its text is that of its posts in order, empty ones left out.
    """
    rows = checkpoint(rows)
    chain, members = chains_and_posts(rows)
    chain = checkpoint(chain)
    last = rows.select(F.col("id").alias("last"), F.col("has_replies").alias("last_has_replies"))
    state = chain.join(last, "last", "left").join(covered, "conv_id", "left").select(
        "conv_id", "ambiguous", F.lit(False).alias("conflict"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("long").alias("index"), F.col("length").alias("detected"),
        F.when(F.col("length") > 0, 0).otherwise(-1).alias("input_at"), F.coalesce("coverage", F.lit(False)).alias("coverage"), "last_has_replies", F.lit(False).alias("single"), "last",
    )
    text = combined_text(rows.join(members, "id", "left_semi")).withColumnRenamed("combined", "text")
    return completeness(state).join(text, "conv_id", "left").select("conv_id", "detected", "status", "complete", "reason", "text")


def first_text(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key that has text, else the first."""
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    w = Window.partitionBy(*keys).orderBy(empty, order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def combined_text(rows: DataFrame) -> DataFrame:
    """(conv_id, combined): texts that are not empty, in order, joined by blank lines."""
    some = rows.where(F.coalesce(F.trim("text"), F.lit("")) != "")
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return some.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("combined"))
