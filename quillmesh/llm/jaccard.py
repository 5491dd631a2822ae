"""Near duplicates found by SimHash and checked by the exact Jaccard similarity of word shingles.

Texts with equal shingle sets are one class from there on. Each class has a few independent
fingerprints; the Gray-ordered index of simhash.py links those within a wide distance, and what any
of them links is a family. Within a family all sets are compared: a family is dealt
over tiles, every two tiles meet in a task of their own, which counts shared shingles by an
inverted list and gives a star for each component it finds, never the pairs.

A pair of similarity 0.8 differs in some eight to ten of 64 bits, so a fingerprint finds more than half of
such pairs and three find most; pairs of more similar texts are rarely missed, and a group is found by any
of its pairs. README has the measured share. No pair below the similarity links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lookup, materialise, small_batches, small_side
from .simhash import _unite, keep_one, numbered, search_links, several_fingerprints, shingle_hashes

SHINGLE = 5
#: The least similarity of near duplicates, in tenths.
TENTHS = 8
#: Fingerprints of a class, bits in which those of a family's classes may differ, and rotations of the index.
PRINTS, DISTANCE, TURNS = 3, 9, 5
#: Shingles of a tile, about; a text of more has a tile of its own.
TILE_SHINGLES = 400_000


def shingle_set(hashes: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct hashes; none of a text without words."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))


def _sketch(shingle: int, prints: int):
    @F.arrow_udf("struct<class: bigint, prints: array<bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        classes, found = [], []
        for x in texts:
            hashes = list(shingle_hashes(x.as_py(), shingle))
            classes.append(xxhash.xxh3_64_intdigest(shingle_set(hashes).tobytes()))
            found.append(several_fingerprints(hashes, prints).view(np.int64))
        return pa.StructArray.from_arrays([pa.array(np.array(classes, np.uint64).view(np.int64)), pa.array(found, pa.list_(pa.int64()))], names=["class", "prints"])

    return of


def _sets(shingle: int):
    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(list(shingle_hashes(x.as_py(), shingle))).view(np.int64) for x in texts], pa.list_(pa.int64()))

    return of


def families(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(node, component) of the classes (class, prints) that some fingerprint links with another."""
    # All of a class's fingerprints are searched for at once, each among those of its place.
    named = classes.select("class", F.posexplode("prints").alias("place", "fp"))
    prints = materialise(named.groupBy("place", "fp").agg(F.min("class").alias("first"), F.count(F.lit(1)).alias("n")), "class-fingerprints")
    links = search_links(prints.select("place", "fp"), distance, TURNS, kind="place")
    end = lambda x: prints.select("place", F.col("fp").alias(x), F.col("first").alias(f"class_{x}"))
    far = links.join(end("a"), ["place", "a"]).join(end("b"), ["place", "b"]).select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    alike = lookup(named, prints.where("n > 1"), ["place", "fp"], "n").where("class != first").select(F.col("class").alias("a"), F.col("first").alias("b"))
    return connected_components(far.unionByName(alike), "a", "b")


def similar_in_group(sizes: np.ndarray, shingles: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The first member of each member's component, where members of both sides (or of side 0 alone) are compared.

    shingles: the members' sets in a row, sizes: how many each has.
    """
    label, m = np.arange(len(sizes)), len(sizes)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(m), sizes)
    _, code = np.unique(shingles, return_inverse=True)
    order = np.argsort(code, kind="stable")
    # Of each shingle the members that hold it.
    listed = owner[order]
    first = np.searchsorted(code[order], np.arange(code.max() + 1 if len(code) else 0))
    count = np.diff(np.append(first, len(code)))
    two = bool(side.any())
    for k in range(m):
        if two and side[k]:
            continue
        mine = code[begin[k] : begin[k] + sizes[k]]
        many = count[mine]
        at = np.repeat(first[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        shared = np.bincount(listed[at], minlength=m)
        near = shared * (10 + TENTHS) >= TENTHS * (sizes + sizes[k])
        near &= (side == 1) if two else (np.arange(m) > k)
        other = np.flatnonzero(near & (shared > 0))
        _unite(label, np.full(len(other), k), other)
    return label


def similar_links(members: DataFrame, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """(a, b): links that join all members (family, class, set) of a family that are similar enough, and no others."""
    sized = members.withColumn("n", F.size("set"))
    tiles = materialise(sized.groupBy("family").agg(F.ceil(F.sum("n") / tile_shingles).cast("int").alias("tiles"), F.count(F.lit(1)).alias("rows")), "family-tiles")
    tiled = lookup(sized, tiles, "family", "rows").withColumn("tiles", F.greatest("tiles", F.lit(1)))
    mine = F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, mine).alias("s"), F.greatest(t, mine).alias("t"), (t < mine).cast("int").alias("side")))
    names = ("family", "s", "t", "side")
    dealt = tiled.select("family", "class", "set", F.inline(pairs)).repartition("family", "s", "t").sortWithinPartitions(*names, "class")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
            side, ids, sets = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5)
            begins = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            left, right = [], []
            for x, y in zip(begins.tolist(), [*begins[1:].tolist(), len(ids)], strict=True):
                if y - x < 2:
                    continue
                part = sets.slice(x, y - x)
                sizes = part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                label = similar_in_group(sizes, part.flatten().to_numpy(), side[x:y])
                child = np.flatnonzero(label != np.arange(y - x))
                left.append(ids[x:y][child])
                right.append(ids[x:y][label[child]])
            none = [np.zeros(0, np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(none + left)), pa.array(np.concatenate(none + right))], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            keys = [batch.column(k).to_numpy() for k in range(3)]
            other = np.flatnonzero(np.any([x != x[-1] for x in keys], axis=0)) if batch.num_rows else []
            # A group ends in this batch: what stands before the last group can be compared.
            same = len(held) == 1 or not batch.num_rows or all(held[0].column(k)[-1] == batch.column(k)[-1] for k in range(3))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut or not same:
                whole = pa.concat_batches([*held[:-1], batch.slice(0, cut)])
                if whole.num_rows:
                    yield found(whole)
                held = [batch.slice(cut)]
        if held and (whole := pa.concat_batches(held)).num_rows:
            yield found(whole)

    return dealt.select(*names, "class", "set").mapInArrow(compare, "a bigint, b bigint")


def components(sketches: DataFrame, rows: DataFrame, text: str, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(node, component) of the classes in sketches (_n, class, prints) that are similar to another; rows are numbered()."""
    classes = materialise(sketches.groupBy("class").agg(F.min_by(F.struct("_n", "prints"), "_n").alias("x")).select("class", "x.*"), "shingle-classes")
    if classes.isEmpty():
        return sketches.select(F.col("class").alias("node"), F.col("class").alias("component"))
    found = families(classes.select("class", "prints"), distance).select(F.col("node").alias("class"), F.col("component").alias("family"))
    need = small_side(materialise(found.join(classes.select("class", "_n"), "class"), "family-members"))
    read = rows.select("_n", F.col("_row")[text].alias("_text")).join(need, "_n")
    members = materialise(read.select("family", "class", _sets(shingle)(F.col("_text")).alias("set")), "shingle-sets")
    return connected_components(similar_links(members), "a", "b")


def drop_similar(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, prints: int = PRINTS) -> DataFrame:
    """df with one row of each component of similar texts, the one with its smallest id, null last; columns as before.

    Words are those of simhash.fingerprint(); a text of fewer words than a shingle has one
    shingle of all of them. Texts without words are alike. Of rows that share the smallest
    id exactly one stays. An empty table gives no rows.
    """
    small_batches(df.sparkSession)
    rows = numbered(df)
    read = rows.select("_n", F.col("_row")[doc_id].alias("doc_id"), _sketch(shingle, prints)(F.col("_row")[text]).alias("s"))
    sketches = materialise(read.select("_n", "doc_id", "s.*"), "sketches")
    joined = components(sketches, rows, text, shingle, distance).withColumnRenamed("node", "class")
    sizes = sketches.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    named = materialise(sizes.join(joined, "class", "left").select("class", "n", F.coalesce("component", "class").alias("component")), "named-classes")
    return keep_one(rows, materialise(lookup(sketches.select("_n", "doc_id", "class"), named, "class", "n").select("_n", "doc_id", "component"), "similar-groups"))
