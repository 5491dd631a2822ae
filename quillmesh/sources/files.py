"""Files as DataFrames: cards in Markdown, YAML settings, JSON state, encoded blobs, JSON inside pages."""

from __future__ import annotations

import json

import pyarrow as pa
import yaml
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The front matter of a card: fixed names.
CARD_SCHEMA = """
schema_version int, id string, title string, canonical_url string,
source struct<type string, url string, identity string>,
resource_kind struct<ai string, user string>, status struct<ai string, user string>,
created_at string, updated_at string, last_checked_at string, summary string,
navigation struct<categories struct<ai array<string>, user array<string>>>,
classification struct<categories struct<ai array<string>, user array<string>>, tags struct<ai array<string>, user array<string>>>,
relevance struct<ai map<string,int>, user map<string,int>>,
actions struct<ai array<string>, user array<string>>
"""


@F.arrow_udf(T.StringType())
def yaml_to_json(texts: pa.Array) -> pa.Array:
    """YAML mappings as JSON; null where the text is no mapping."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            data = yaml.safe_load(text)
        except yaml.YAMLError:
            return None
        return json.dumps(data, default=str, sort_keys=True, ensure_ascii=False) if isinstance(data, dict) else None

    return pa.array([one(t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def canonical_json(texts: pa.Array) -> pa.Array:
    """JSON with sorted keys and no spaces; null where it does not parse."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return pa.array([one(t) for t in texts.to_pylist()], pa.string())


def split_card(raw: Column) -> tuple[Column, Column]:
    """Front matter and body of a card's text, without byte-order mark and with \\n line ends; null without front matter."""
    text = F.regexp_replace(F.regexp_replace(raw, "^﻿", ""), "\r\n", "\n")
    pattern = r"(?s)\A---\n(.*?)\n---\n(.*)\z"
    has = text.rlike(pattern)
    return F.when(has, F.regexp_extract(text, pattern, 1)), F.when(has, F.regexp_extract(text, pattern, 2))


def parse_cards(files: DataFrame, path: str = "path", raw: str = "raw") -> DataFrame:
    """(file_path, raw, data, body, error) of card texts; error tells what a text lacks."""
    front, body = split_card(F.col(raw))
    parsed = files.select(F.col(path).alias("file_path"), F.col(raw).alias("raw"), front.alias("_front"), body.alias("body")).withColumn("_json", yaml_to_json("_front"))
    error = F.when(F.col("_front").isNull(), F.lit("front_matter_missing")).when(F.col("_json").isNull(), F.lit("front_matter_no_mapping"))
    return parsed.select("file_path", "raw", F.from_json("_json", CARD_SCHEMA).alias("data"), "body", error.alias("error"))


def read_cards(spark: SparkSession, folder: str) -> DataFrame:
    """All *.md below a folder but README.md, with `ord`, a number that rises with the path: a range sort, no single task."""
    found = texts(spark, folder, "*.md").where(F.element_at(F.split("path", "/"), -1) != "README.md")
    return parse_cards(found.orderBy("path")).withColumn("ord", F.monotonically_increasing_id())


def texts(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, raw) of the text files below a folder whose names fit a pattern."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.decode("content", "UTF-8").alias("raw"))


def read_state(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All *.json below a folder, one row a file, with its path."""
    return (
        spark.read.schema(schema)
        .option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .json(folder)
        .withColumn("file_path", F.col("_metadata.file_path"))
    )


def read_settings(spark: SparkSession, path: str, missing: dict | None = None) -> dict:
    """A small YAML file, on any file system that Spark reads, as a mapping on the driver; `missing` where there is none."""
    try:
        text = spark.read.text(path, wholetext=True).first()
    except AnalysisException:
        if missing is None:
            raise
        return missing
    data = yaml.safe_load(text[0]) if text else None
    if not isinstance(data, dict):
        raise ValueError(f"{path} is no mapping")
    return data


def vocabulary(spark: SparkSession, taxonomy: dict) -> DataFrame:
    """(kind, value) of a taxonomy's controlled lists and maps."""
    rows = [(kind, str(v)) for kind, values in taxonomy.items() if isinstance(values, (list, dict)) for v in values if isinstance(v, (str, int))]
    return spark.createDataFrame(rows, "kind string, value string")


def decode_blob(content: Column, max_bytes: int) -> Column:
    """Text of base64 content; null where it is too long, no UTF-8 or holds NUL."""
    data = F.try_to_binary(F.regexp_replace(content, r"\s", ""), F.lit("base64"))
    text = F.decode(data, "UTF-8")
    good = (F.octet_length(data) <= max_bytes) & F.is_valid_utf8(data.cast("string")) & ~F.contains(text, F.lit("\x00"))
    return F.when(good, text)


def embedded_json(html: Column) -> Column:
    """array<string>: what the page's JSON scripts hold, without guards and comments."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*type=[\"']application/(?:ld\+)?json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    return F.transform(found, lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"^\s*for\s*\(;;\);", ""), r"(?s)<!--|-->|^\s*/\*.*?\*/", "")))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("id", "username", "text", "reply_to")])))
def find_posts(payloads: pa.Array) -> pa.Array:
    """Objects anywhere in a JSON text that look like posts: an id, an author and a text.

    At most 50,000 nodes of a payload are visited.
    """
    kind = pa.list_(pa.struct([("id", pa.string()), ("username", pa.string()), ("text", pa.string()), ("reply_to", pa.string())]))

    def one(text: str | None) -> list | None:
        try:
            waiting, seen, out = [json.loads(text)] if text else [], 0, []
        except ValueError:
            return None
        while waiting and seen < 50_000:
            node = waiting.pop()
            seen += 1
            if isinstance(node, dict):
                user, caption = node.get("user"), node.get("caption")
                name = node.get("username") or (user.get("username") if isinstance(user, dict) else None)
                words = node.get("text") or (caption.get("text") if isinstance(caption, dict) else None)
                key = node.get("id") or node.get("pk") or node.get("code")
                if key and name and isinstance(words, str):
                    out.append({"id": str(key), "username": str(name), "text": words, "reply_to": str(node["reply_to"]) if node.get("reply_to") else None})
                waiting += reversed(list(node.values()))
            elif isinstance(node, list):
                waiting += reversed(node)
        return out

    return pa.array([one(t) for t in payloads.to_pylist()], kind)
