"""Walks of nested JSON as VARIANT values, level by level, in expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rounds import checkpoint

#: Nodes of a payload that are visited, and levels at most: fixed values.
NODES, LEVELS = 50_000, 500


def json_nodes(payloads: DataFrame, key: str, payload: str, nodes: int = NODES, levels: int = LEVELS) -> DataFrame:
    """(key, path, node): every object, list and value in each payload, a JSON text in column `payload`.

    path: places from the top on, members of an object by name. The first `nodes` nodes of a payload in that order
    are kept, a node before what is in it; a text that is no JSON, or null, has none. Each level is one join of its containers with their
    members, and a checkpoint. Keys tell payloads apart: rows with one key share their nodes' places.
    """
    spark = payloads.sparkSession
    level = payloads.select(F.col(key).alias("_k"), F.array().cast("array<int>").alias("path"), F.try_parse_json(F.col(payload)).alias("node")).where("node IS NOT NULL")
    found = []
    for _ in range(levels):
        level = checkpoint(level)
        if level.isEmpty():
            break
        found.append(level)
        inside = level.where(_is(F.col("node"), "OBJECT", "ARRAY"))
        each = inside.lateralJoin(spark.tvf.variant_explode(F.col("node").outer()).select(F.col("pos").alias("_pos"), F.col("value").alias("_value")))
        # What lies behind the first `nodes` places of its own container cannot be among the first of all.
        level = each.where(F.col("_pos") < nodes).select("_k", F.array_append("path", F.col("_pos")).alias("path"), F.col("_value").alias("node"))
    if not found:
        return payloads.select(F.col(key).alias(key), F.array().cast("array<int>").alias("path"), F.parse_json(F.lit("null")).alias("node")).limit(0)
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    # Names of objects' members are sorted in a VARIANT, so places are the same however a text has them.
    placed = out.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy("path"))).where(F.col("_n") <= nodes)
    return placed.select(F.col("_k").alias(key), "path", "node")


def _is(node: Column, *kinds: str) -> Column:
    kind = F.schema_of_variant(node)
    return F.coalesce(F.substring_index(F.substring_index(kind, "<", 1), "(", 1).isin(*kinds), F.lit(False))


def _said(node: Column, path: str, only_text: bool = False) -> Column:
    """What a scalar at a path says; null where it is missing, empty, false or zero."""
    value = F.try_variant_get(node, path, "variant")
    text = F.try_variant_get(node, path, "string")
    is_text = _is(value, "STRING")
    some = is_text & (text != "")
    if not only_text:
        some = some | (~is_text & ~_is(value, "OBJECT", "ARRAY", "VOID") & ~text.isin("0", "0.0", "false"))
    return F.when(some, text)


def posts_in(payloads: DataFrame, key: str, payload: str, nodes: int = NODES) -> DataFrame:
    """(key, id, username, text, reply_to) of the objects anywhere in JSON payloads that look like posts: an id, an author and a text."""
    found = json_nodes(payloads, key, payload, nodes).where(_is(F.col("node"), "OBJECT"))
    n = F.col("node")
    rows = found.select(
        key,
        F.coalesce(_said(n, "$.id"), _said(n, "$.pk"), _said(n, "$.code")).alias("id"),
        F.coalesce(_said(n, "$.username"), _said(n, "$.user.username")).alias("username"),
        F.coalesce(_said(n, "$.text", True), _said(n, "$.caption.text", True)).alias("text"),
        _said(n, "$.reply_to").alias("reply_to"),
    )
    return rows.where("id IS NOT NULL AND username IS NOT NULL AND text IS NOT NULL")
