"""Rendered cards and JSON artifacts."""

from __future__ import annotations

import json

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.StringType())
def json_to_yaml(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else yaml.safe_dump(json.loads(t), sort_keys=False, allow_unicode=True) for t in texts.to_pylist()], pa.string())


def render_card(data: Column, title: Column, sections: list[tuple[str, Column]]) -> Column:
    """A card's Markdown: front matter, its title and its sections in order."""
    front = json_to_yaml(F.to_json(data, {"ignoreNullFields": "false"}))
    body = [F.concat(F.lit(f"## {name}\n\n"), F.coalesce(text, F.lit("")), F.lit("\n")) for name, text in sections]
    return F.concat(F.lit("---\n"), front, F.lit("---\n\n# "), title, F.lit("\n\n"), F.concat_ws("\n", *body))


def append_log(section: Column, line: Column) -> Column:
    """A log section with one more line, unless it is there already."""
    return F.when(F.contains(F.coalesce(section, F.lit("")), line), section).otherwise(F.concat_ws("\n", F.when(section != "", section), line))


def write_json(df: DataFrame, path: str, order: list[str]) -> None:
    """One JSON object a line, rows in order within and across files."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)
