"""Cards: typed documents with values that a model proposed and a user may override."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

#: Relevance dimensions of the fixture cards; from HIGH on a dimension counts.
DIMENSIONS, HIGH = ("overall", "engineering"), 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def owned(ai: Column, user: Column) -> Column:
    return F.struct(ai.alias("ai"), user.alias("user"))


def effective(wrapper: str) -> Column:
    """The user's value where there is one, an empty list included; else the model's."""
    return F.coalesce(F.col(f"{wrapper}.user"), F.col(f"{wrapper}.ai"))


def effective_list(wrapper: str) -> Column:
    return F.coalesce(effective(wrapper), F.array().cast("array<string>"))


def effective_relevance(wrapper: str = "relevance") -> Column:
    """The model's map with the user's values; keys that only the user has are dropped."""
    user = F.coalesce(F.col(f"{wrapper}.user"), F.create_map().cast("map<string,int>"))
    return F.transform_values(F.col(f"{wrapper}.ai"), lambda k, v: F.coalesce(F.try_element_at(user, k), v))


def high_dimensions(relevance: Column, dimensions: tuple[str, ...] = DIMENSIONS) -> Column:
    named = F.array(*map(F.lit, dimensions))
    return F.filter(named, lambda k: F.coalesce(F.try_element_at(relevance, k), F.lit(0)) >= HIGH)


def tokens_of(values: Column) -> Column:
    """Trimmed lower-case values without empty ones, each once."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def part_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card for each part, with its vector where there is one."""
    part, vectors = table(spark, sf_dir, "part"), table(spark, sf_dir, "embeddings")
    key, none = F.col("p_partkey"), F.array().cast("array<string>")
    map_ = "map<string,int>"
    return part.join(vectors.select(F.col("vec_id").alias("p_partkey"), F.col("embedding").cast("array<double>").alias("vector")), "p_partkey", "left").select(
        F.concat(F.lit("part-"), F.lpad(key.cast("string"), 8, "0")).alias("id"),
        key.alias("ord"),
        F.col("p_name").alias("title"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("summary"),
        F.concat(F.lit("https://parts.example.org/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/"), key).alias("canonical_url"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (key % 60).cast("int")), "yyyy-MM-dd").alias("created_at"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (key % 97).cast("int")), "yyyy-MM-dd").alias("updated_at"),
        owned(F.array("p_type"), F.when(F.col("p_size") % 7 == 0, F.array("p_brand"))).alias("categories"),
        owned(F.array_distinct(F.split("p_name", " ")), F.when(F.col("p_size") % 11 == 0, none)).alias("tags"),
        owned(F.array("p_type"), F.lit(None).cast("array<string>")).alias("navigation"),
        owned(F.array("p_brand"), F.lit(None).cast("array<string>")).alias("actions"),
        owned(
            F.create_map(F.lit("overall"), (1 + F.col("p_size") % 5).cast("int"), F.lit("engineering"), (1 + key % 5).cast("int")).cast(map_),
            F.when(key % 13 == 0, F.create_map(F.lit("overall"), F.lit(5)).cast(map_)).otherwise(F.create_map().cast(map_)),
        ).alias("relevance"),
        owned(F.lit("active"), F.when(F.col("p_size") > 45, F.lit("archived"))).alias("status"),
        "vector",
    )


def document_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card for each document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = F.coalesce("text", F.lit(""))
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("id"),
        F.col("doc_id").alias("ord"),
        F.substring(F.element_at(F.split(text, "\n"), 1), 1, 80).alias("title"),
        F.substring(text, 1, 600).alias("summary"),
        text.alias("body"),
        "lang",
        "source",
        F.when(F.col("toxic") == 1, F.lit("archived")).otherwise(F.lit("active")).alias("status"),
        F.coalesce("quality", F.lit(0)).alias("quality"),
    )


def document_fields() -> dict[str, Column]:
    """A document card's searchable texts."""
    return {"title": F.col("title"), "summary": F.col("summary"), "metadata": F.concat_ws(" ", "lang", "source", "status"), "body": F.col("body")}


def summary_columns() -> list[Column]:
    """What a list of cards shows."""
    return [
        F.col("id"),
        F.col("title"),
        F.col("summary"),
        F.col("canonical_url"),
        F.array_join(effective_list("categories"), ",").alias("categories"),
        F.array_join(effective_list("tags"), ",").alias("tags"),
        F.array_join(effective_list("navigation"), ",").alias("navigation"),
        F.array_join(effective_list("actions"), ",").alias("actions"),
        effective_relevance()["overall"].cast("int").alias("overall"),
        effective("status").alias("status"),
        F.col("created_at"),
        F.col("updated_at"),
    ]


def embedding_text(max_chars: int = 12_000) -> Column:
    """A card's labelled lines, compacted, for an embedder."""
    relevance = F.array_join(F.transform(F.array_sort(F.map_entries(effective_relevance())), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    lines = [
        F.concat(F.lit("Title: "), F.coalesce("title", "id")),
        F.concat(F.lit("Summary: "), F.coalesce("summary", F.lit(""))),
        F.concat(F.lit("Categories: "), F.array_join(effective_list("categories"), ", ")),
        F.concat(F.lit("Tags: "), F.array_join(effective_list("tags"), ", ")),
        F.concat(F.lit("Actions: "), F.array_join(effective_list("actions"), ", ")),
        F.concat(F.lit("Relevance: "), relevance),
    ]
    compact = F.filter(F.array(*map(t.compact_markdown, lines)), lambda x: x != "")
    return F.substring(F.array_join(compact, "\n"), 1, max_chars)
