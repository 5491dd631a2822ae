"""Embedding near-duplicates by an exact metric range join.

Cosine similarity of at least s is a distance of at most r = sqrt(2 - 2 s) between unit
vectors. Pivots of each label divide its vectors into cells, each vector at home in its nearest
pivot's. By the triangle inequality a vector within r of one at home in another cell is
at most 2 r farther from that cell's pivot than from its own; as the space is
Euclidean, it is even within r of the plane between the two pivots. Vectors that are so
near another cell visit it, and cells then join independently and lose no pair.

Equal vectors are one class from the start. A cell of many vectors is joined tile by
tile, each pair of tiles in a task of its own. What comes out are link counts and a star
for each component in a tile, never a group's pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lookup, materialise

SIMILARITY = 0.98
#: Vectors that a cell should hold, and the most pivots of all labels together (they are broadcast).
CELL_ROWS, MAX_PIVOTS = 2_000, 4_096
#: Vectors on either side of a task's join, and rows of it multiplied at once.
TILE_ROWS, BLOCK = 4_000, 512


def unit_rows(lists: pa.Array, dim: int) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def visits(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector's home, and whether it must be seen in each cell (its home too)."""
    d2 = np.maximum(2 - 2 * x @ pivots.T, 0)
    home = d2.argmin(axis=1)
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-12))[home]
    own = d2[np.arange(len(x)), home][:, None]
    # The first is the triangle inequality's bound, the second the distance to the plane.
    near = (np.sqrt(d2) - np.sqrt(own) <= 2 * radius) & ((d2 - own) / (2 * between) <= radius)
    near[np.arange(len(x)), home] = True
    return home, near


def join_tile(home: np.ndarray, other: np.ndarray, home_ids: np.ndarray, other_ids: np.ndarray, weight: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each home vector, counted by weight, and a star (node, centre) for each component of the tile."""
    ids = np.unique(np.concatenate([home_ids, other_ids]))
    left, right = np.searchsorted(ids, home_ids), np.searchsorted(ids, other_ids)
    label, counts = np.arange(len(ids)), np.zeros(len(home_ids), np.int64)
    for at in range(0, len(home), BLOCK):
        near = home[at : at + BLOCK] @ other.T >= least
        near &= home_ids[at : at + BLOCK, None] != other_ids[None, :]
        counts[at : at + BLOCK] = near @ weight
        i, j = np.nonzero(near)
        a, b = left[at + i], right[j]
        while True:
            la, lb = label[a], label[b]
            if (la == lb).all():
                break
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while (label[label] != label).any():
                label = label[label]
    child = np.flatnonzero(label != np.arange(len(ids)))
    return counts, ids[child], ids[label[child]]


def _classes(df: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the key of their class, null where a row links with nothing; and the classes."""
    v = F.col(embedding)
    # Numbers beyond any finite float's range in double precision would not have a finite norm.
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    good = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & finite & (norm > 0) & (norm < float("inf"))
    key = F.sha2(F.concat_ws("|", F.col(label).cast("string"), F.array_join(v.cast("array<string>"), ",")).cast("binary"), 256)
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), v.alias("v"), F.when(F.coalesce(good, F.lit(False)), key).alias("key"))
    classes = (
        rows.where("key is not null")
        .groupBy("key")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
        .withColumn("dim", F.size("v"))
    )
    return rows.select("vec_id", "key"), classes


def vector_links(classes: DataFrame, similarity: float = SIMILARITY, cell_rows: int = CELL_ROWS, max_pivots: int = MAX_PIVOTS, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(first, links) and (a, b): each class's links to other classes, counted in vectors, and stars of components.

    classes: (first, n, label, dim, v), unique in first.
    """
    spark = classes.sparkSession
    # A little more than the radius, for rounding; the similarity itself decides.
    radius = float(np.sqrt(max(0.0, 2 - 2 * similarity)) + 1e-6)
    groups = classes.groupBy("label", "dim").count()
    total = groups.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    # Only groups of over a cell need pivots, so that there are at most max_pivots of them.
    rows = max(cell_rows, -(-2 * total // max_pivots))
    large = groups.where(F.col("count") > rows).withColumn("wanted", F.ceil(F.col("count") / rows))
    sampled = classes.join(F.broadcast(large), ["label", "dim"]).where(
        F.pmod(F.xxhash64("first", F.lit(3)), F.col("count")) < F.col("wanted")
    )
    chosen = sampled.select("label", "dim", "v", "first").orderBy("first").limit(max_pivots).collect()
    pivots: dict[tuple, np.ndarray] = {}
    for r in chosen:
        x = np.array(r["v"], np.float64)
        pivots.setdefault((r["label"], r["dim"]), []).append(x / np.sqrt((x * x).sum()))
    pivots = {k: np.unique(np.stack(x), axis=0) for k, x in pivots.items()}
    shared = spark.sparkContext.broadcast(pivots)

    @F.arrow_udf("array<int>")
    def cells(label: pa.Array, dim: pa.Array, v: pa.Array) -> pa.Array:
        """A vector's cells: its home first."""
        names, dims = label.to_pylist(), dim.to_pylist()
        by: dict[tuple, list[int]] = {}
        for k, pair in enumerate(zip(names, dims, strict=True)):
            by.setdefault(pair, []).append(k)
        out: list = [[0]] * len(names)
        for pair, at in by.items():
            if (p := shared.value.get(pair)) is None:
                continue
            home, near = visits(unit_rows(v.take(pa.array(at)), pair[1]), p, radius)
            for k, h, seen in zip(at, home.tolist(), near, strict=True):
                out[k] = [h, *(j for j in np.flatnonzero(seen).tolist() if j != h)]
        return pa.array(out, pa.list_(pa.int32()))

    placed = classes.withColumn("cells", cells("label", "dim", "v")).select(
        "label", "dim", "first", "n", "v", F.posexplode("cells").alias("at", "cell")
    ).withColumn("home", F.col("at") == 0).drop("at")
    placed = materialise(placed, "vector-cells")
    sizes = placed.groupBy("label", "dim", "cell").agg(
        F.ceil(F.sum(F.col("home").cast("int")) / tile_rows).cast("int").alias("left"),
        F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("right"),
    )
    sized = placed.join(sizes, ["label", "dim", "cell"])
    mine = lambda n: F.pmod(F.xxhash64("first"), F.greatest(F.col(n), F.lit(1))).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
    # As a home vector it meets every tile of the others, as one of the others every tile of homes.
    as_home = sized.where("home").withColumns({"s": mine("left"), "t": F.explode(each("right")), "side": F.lit(0)})
    as_other = sized.where("left > 0").withColumns({"s": F.explode(each("left")), "t": mine("right"), "side": F.lit(1)})
    dealt = as_home.unionByName(as_other).select("label", "dim", "cell", "s", "t", "side", "first", "n", "v")
    schema = pa.schema([("first", pa.int64()), ("links", pa.int64()), ("b", pa.int64())])

    def join(group: pa.Table) -> pa.Table:
        side = group["side"].to_numpy()
        dim = group["dim"][0].as_py()
        first, n = group["first"].to_numpy(), group["n"].to_numpy()
        order = np.argsort(first, kind="stable")
        a, b = order[side[order] == 0], order[side[order] == 1]
        x = unit_rows(group["v"].combine_chunks(), dim)
        counts, node, centre = join_tile(x[a], x[b], first[a], first[b], n[b], similarity)
        linked = counts > 0
        return pa.table(
            {
                "first": np.concatenate([first[a][linked], node]),
                "links": np.concatenate([counts[linked], np.zeros(len(node), np.int64)]),
                "b": pa.array(np.concatenate([np.zeros(int(linked.sum()), np.int64), centre]), mask=np.concatenate([np.ones(int(linked.sum()), bool), np.zeros(len(node), bool)])),
            },
            schema=schema,
        )

    found = dealt.groupBy("label", "dim", "cell", "s", "t").applyInArrow(join, "first bigint, links bigint, b bigint")
    found = materialise(found, "vector-links")
    return (
        found.where("b is null").groupBy("first").agg(F.sum("links").alias("links")),
        found.where("b is not null").select(F.col("first").alias("a"), "b"),
    )


def near_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", similarity: float = SIMILARITY, **limits: int) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of df.

    Vectors of equal, not-null labels and equal length are linked where their cosine, in double
    precision, is at least `similarity`; equal vectors always are. A vector that is null, empty, zero or
    holds null or non-finite numbers, or without an id or a label, is linked with nothing and
    keeps itself. component_id is the smallest id that links reach; `kept` tells whether it is
    the row's own. Rows of equal id and vector count as two vectors, linked. Other columns are not
    read. An empty table gives no rows.
    """
    rows, classes = _classes(df, vec_id, embedding, label)
    rows, classes = materialise(rows, "vector-rows"), materialise(classes, "vector-classes")
    counts, edges = vector_links(classes, similarity, **limits)
    joined = connected_components(edges, "a", "b")
    named = (
        classes.select("key", "first", "n")
        .join(counts, "first", "left")
        .join(joined, F.col("first") == F.col("node"), "left")
        .select("key", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    )
    found = lookup(rows.where("key is not null"), materialise(named, "named-vectors"), "key", "n").select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
