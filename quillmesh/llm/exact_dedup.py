"""Exact deduplication by two passes over a Bloom filter of repeated hashes.

Pass one counts, for each of a few positions of a text's hash in a bit table, how many
rows have it, and keeps the positions that two or more rows share as a bitmap. Pass two
probes the bitmap: a text that repeats has all its positions there. Only such rows are
shuffled and grouped by their full hash; all others pass straight through as groups of
one. A false positive costs a little shuffling and nothing else, so results are exact.

The bitmap's size follows the row count up to `max_bits`, which bounds the broadcast.
Beyond that it fills up and more rows are grouped in vain; the result stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialise

#: Positions of a hash, and bits of the table for each row.
POSITIONS, BITS_PER_ROW = 2, 16
#: 32 MB: the most that is broadcast.
MAX_BITS = 1 << 28
#: Bits in one bitmap of Spark's bitmap functions.
BUCKET = 32768


def _positions(digest: Column, bits: int) -> list[Column]:
    """Positions from 0 to bits - 1, from different parts of a hexadecimal SHA-256."""
    return [F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("long") % bits for k in range(POSITIONS)]


def _has_bit(bitmap: Column, position: Column) -> Column:
    octet = F.substring(bitmap, ((position % BUCKET) / 8).cast("int") + 1, F.lit(1))
    return F.coalesce(F.getbit(F.conv(F.hex(octet), 16, 10).cast("long"), (position % 8).cast("int")) == 1, F.lit(False))


def repeat_filter(hashes: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap): the positions that two or more rows of `hashes` (text_sha256) have."""
    position = hashes.select(F.explode(F.array_distinct(F.array(*_positions(F.col("text_sha256"), bits)))).alias("position"))
    shared = position.groupBy("position").count().where("count >= 2")
    return shared.groupBy(F.expr(f"position div {BUCKET}").alias("bucket")).agg(
        F.expr(f"bitmap_construct_agg(position % {BUCKET})").alias("bitmap")
    )


def _probe(rows: DataFrame, shared: DataFrame, bits: int) -> DataFrame:
    """rows with _maybe: whether all positions of text_sha256 are in the bitmap. Map-side: the bitmap is broadcast."""
    names, hit = rows.columns, F.lit(True)
    for k, position in enumerate(_positions(F.col("text_sha256"), bits)):
        one = F.broadcast(shared).select(F.col("bucket").alias(f"_b{k}"), F.col("bitmap").alias(f"_m{k}"))
        rows = rows.withColumn(f"_p{k}", position).join(one, F.expr(f"_p{k} div {BUCKET}") == F.col(f"_b{k}"), "left")
        hit = hit & _has_bit(F.col(f"_m{k}"), F.col(f"_p{k}"))
    return rows.select(*names, hit.alias("_maybe"))


def _hashed(df: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    return df.select(F.col(doc_id).alias("doc_id"), digest.alias("text_sha256"), *more)


def _filtered(df: DataFrame, doc_id: str, text: str, max_bits: int) -> tuple[DataFrame, DataFrame, int]:
    hashes = materialise(_hashed(df, doc_id, text), "text-hashes")
    rows, bits = hashes.count(), BUCKET
    while bits < min(max_bits, rows * BITS_PER_ROW):
        bits *= 2
    return hashes, materialise(repeat_filter(hashes, bits), "repeat-filter"), bits


def _groups(maybe: DataFrame) -> DataFrame:
    return maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, text_sha256, keep_id, group_size, kept), a row for each row of df.

    Texts are equal when identical; null counts as empty. The largest id of a group stays;
    a null id stays only where all ids of the group are null. Rows that share both id and
    text are told apart by nothing, so all of them have the same `kept`; drop_exact() keeps
    one. Other columns of df are not read. An empty table gives no rows.
    """
    hashes, shared, bits = _filtered(df, doc_id, text, max_bits)
    probed = _probe(hashes, shared, bits)
    alone = probed.where(~F.col("_maybe")).select(
        "doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    maybe = materialise(probed.where("_maybe").select("doc_id", "text_sha256"), "possible-repeats")
    found = materialise(_groups(maybe).withColumn("n", F.col("group_size")), "text-groups")
    together = lookup(maybe, found, "text_sha256", "n").select(
        "doc_id", "text_sha256", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    )
    return alone.unionByName(together)


def drop_exact(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """df with one row of each group of equal texts, columns as before, whatever their names.

    Only rows that the filter holds for possible repeats are shuffled, by hash and id, to
    meet the group's row that stays. Where rows share id and text, any one stays.
    """
    hashes, shared, bits = _filtered(df, doc_id, text, max_bits)
    maybe = _probe(hashes, shared, bits).where("_maybe").select("doc_id", "text_sha256")
    stay = _groups(maybe).select("text_sha256", F.col("keep_id").alias("_keep"))
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    whole = _probe(_hashed(df, doc_id, text, row), shared, bits)
    held = whole.where("_maybe").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "_row")
    one = (
        held.join(stay, (F.col("_sha") == F.col("text_sha256")) & F.col("_id").eqNullSafe(F.col("_keep")), "left_semi")
        .dropDuplicates(["_sha"])
        .select("_row.*")
    )
    return whole.where(~F.col("_maybe")).select("_row.*").unionByName(one)
