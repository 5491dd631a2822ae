"""Mixing sources to target weights by capped water-filling.

The words of all sources are shared out by weight. A source whose share is over
`max_epochs` times its own size is clamped there and the excess is shared out again by
weight among the others, until none is above. A source's documents are then all taken
floor(target / size) times, and some of them once more: those that come first in a seeded
order, until the words left to take are nearest to none.

What is collected on the driver is one row a source. Documents that decide where the
extra copies end are found in two steps, sums by 4,096 ranges of the seeded order and
then the order within one range, so a source of any size is never sorted as a whole. Rows
alike in id and text share their place; where the words run out among them, they are numbered and so many of
them are taken as fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, materialise

MAX_EPOCHS, SEED = 3, 7
#: The plan, a row a source, is broadcast up to so many sources; beyond them it is joined by shuffling.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    """Number of words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column, seed: int = SEED) -> Column:
    """A document's place in the seeded order, a hexadecimal string."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def water_fill(sizes: list[int], weights: list[float], total: float, max_epochs: float = MAX_EPOCHS) -> list[float]:
    """Targets that share `total` by weight and are at most max_epochs times the size.

    A weight of zero gets nothing. If all sources are clamped, less than `total` is shared out.
    """
    target = [0.0] * len(sizes)
    open_, left = [k for k, w in enumerate(weights) if w > 0 and sizes[k] > 0], total
    while open_:
        whole = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / whole > max_epochs * sizes[k]]
        if not over:
            for k in open_:
                target[k] = left * weights[k] / whole
            break
        for k in over:
            target[k] = float(max_epochs * sizes[k])
        left -= sum(target[k] for k in over)
        open_ = [k for k in open_ if k not in set(over)]
    return target


def default_weight(rank: int) -> float:
    """Sources by code point, null last, weigh 1, 2, 3, repeating."""
    return float(1 + rank % 3)


def source_targets(light: DataFrame, weight=default_weight, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, epochs, extra) from rows of (source, size): one row a source."""
    spark = light.sparkSession
    found = [(r[0], int(r[1])) for r in light.groupBy("source").agg(F.sum("size")).collect()]
    found.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8")))
    sizes = [s for _, s in found]
    target = water_fill(sizes, [weight(k) for k in range(len(found))], float(sum(sizes)), max_epochs)
    rows = []
    for (name, size), t in zip(found, target, strict=True):
        epochs = int(t // size) if size else 0
        rows.append((name, size, t, epochs, t - epochs * size))
    kind = T.StructType(
        [
            T.StructField("source", light.schema["source"].dataType),
            T.StructField("source_size", T.LongType()),
            T.StructField("target", T.DoubleType()),
            T.StructField("epochs", T.LongType()),
            T.StructField("extra", T.DoubleType()),
        ]
    )
    return spark.createDataFrame(rows, kind)


def last_places(light: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, last, edge, take): the last key (place and tie) of which all rows are taken once more; and the key of which only `take` rows are, null for none."""
    part = F.substring("place", 1, 3)
    sums = light.groupBy("source", part.alias("part")).agg(F.sum("size").alias("part_size"))
    order = Window.partitionBy("source").orderBy("part")
    sums = sums.withColumn("before", F.sum("part_size").over(order) - F.col("part_size"))
    named = targets.select(F.col("source").alias("_s"), "extra")
    # The range of places in which the extra words run out: a row a source.
    edge = sums.join(named, F.col("source").eqNullSafe(F.col("_s"))).where(
        (F.col("before") < F.col("extra")) & (F.col("before") + F.col("part_size") >= F.col("extra"))
    ).select(F.col("source").alias("_s"), F.col("part").alias("_p"), "before", "extra")
    edge = materialise(edge, "mix-edges")
    near = F.broadcast(edge) if edge.count() <= BROADCAST_SOURCES else edge
    inside = light.join(near, F.col("source").eqNullSafe(F.col("_s")) & (part == F.col("_p")))
    # Rows alike are one row with a number before the order is taken.
    alike = inside.groupBy("source", "before", "extra", F.concat("place", "tie").alias("key"), "size").agg(F.count(F.lit(1)).alias("n")).where("size > 0")
    fine = Window.partitionBy("source").orderBy("key", "size")
    left = F.col("extra") - F.col("before") - (F.sum(F.col("n") * F.col("size")).over(fine) - F.col("n") * F.col("size"))
    # The k-th of n rows is taken where less than half of it would be too much.
    fits = F.least(F.col("n"), F.greatest(F.lit(0), F.ceil(left / F.col("size") + 0.5) - 1))
    taken = alike.withColumn("take", fits.cast("long")).where("take > 0")
    whole = F.col("take") == F.col("n")
    in_edge = taken.groupBy("source").agg(F.max(F.when(whole, F.col("key"))).alias("last"), F.max(F.when(~whole, F.col("key"))).alias("edge"), F.max(F.when(~whole, F.col("take"))).alias("take"))
    low = edge.select(F.col("_s").alias("source"), F.col("_p").alias("low"))
    i, l = in_edge.alias("i"), low.alias("l")
    return l.join(i, F.col("l.source").eqNullSafe(F.col("i.source")), "left").select(
        F.col("l.source").alias("source"), F.coalesce(F.col("i.last"), F.col("l.low")).alias("last"), "edge", "take"
    )


def _split_ties(tied: DataFrame) -> DataFrame:
    """Rows (_row, source, ..., take, copies) that are alike within their source: the first `take` of them get a copy more.

    They are written once and numbered by partition, so no task holds all of them.
    """
    rows = materialise(tied.withColumn("_id", F.monotonically_increasing_id()), "mix-ties").withColumn("_part", F.shiftright("_id", 33))
    sizes = rows.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("_n"))
    begins = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("source").orderBy("_part")) - F.col("_n")).select(F.col("source").alias("_s"), F.col("_part").alias("_q"), "_before")
    placed = rows.join(begins, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_q")))
    nth = F.col("_before") + F.row_number().over(Window.partitionBy("source", "_part").orderBy("_id"))
    return placed.withColumn("copies", F.col("copies") + (nth <= F.col("take")).cast("long"))


def _mixed(df: DataFrame, doc_id: str, text: str, source: str, weight, max_epochs: float, seed: int) -> DataFrame:
    """(_row, size, source_size, target, copies): df's rows as they are and what the mix makes of them."""
    keyed = df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"),
        F.col(source).alias("source"),
        words(F.col(text)).alias("size"),
        place(F.col(doc_id), seed).alias("place"),
        F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("tie"),
    )
    light = materialise(keyed.drop("_row"), "mix-sizes")
    targets = source_targets(light, weight, max_epochs)
    last = last_places(light, targets).withColumnRenamed("source", "_l")
    plan = materialise(
        targets.join(last, F.col("source").eqNullSafe(F.col("_l")), "left").select(
            F.col("source").alias("_s"), "source_size", "target", "epochs", "last", "edge", "take"
        ),
        "mix-plan",
    )
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    key = F.concat("place", "tie")
    once_more = F.coalesce(key <= F.col("last"), F.lit(False)).cast("long")
    made = ["_row", "size", "source_size", "target", "copies"]
    planned = keyed.join(plan, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("copies", F.col("epochs") + once_more)
    if plan.where("edge is not null").isEmpty():
        return planned.select(made)
    at_edge = F.coalesce(key == F.col("edge"), F.lit(False))
    return planned.where(~at_edge).select(made).unionByName(_split_ties(planned.where(at_edge).select(*made, "source", "take")).select(made))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight=default_weight, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """df's rows with size, source_size, target and copies (how often the mix takes the row).

    df's columns of these names are replaced. A source whose documents have no words has a
    target of zero. Documents without words are taken as often as others at their place,
    which adds no words. Rows that are alike in id and text share their place; where the extra words run
    out among them, so many of them are taken once more as fit, any of them. Copies depend on the seed, the ids, the texts and the weights only, so
    runs agree. An empty table gives no rows.
    """
    new = ["size", "source_size", "target", "copies"]
    mixed = _mixed(df, doc_id, text, source, weight, max_epochs, seed)
    return mixed.select(*(F.col(f"_row.`{c}`") for c in df.columns if c not in new), *new)


def sample(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight=default_weight, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of df as often as it is taken, columns as before."""
    mixed = _mixed(df, doc_id, text, source, weight, max_epochs, seed).where("copies > 0")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_n")).select("_row.*")
