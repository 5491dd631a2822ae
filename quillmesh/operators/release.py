"""Releases: manifests of written artifacts, a pointer to the current one, lineage checks."""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from .commits import create_if_absent

ARTIFACTS = ("search", "vectors", "relations", "concepts", "graph")
_SHA1, _SHA256 = re.compile(r"[0-9a-f]{40}"), re.compile(r"[0-9a-f]{64}")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(artifact, files, bytes, sha256) of each artifact below a folder.

    Files are hashed where they are read; an artifact's hash is that of its files' names and
    hashes in order, so no file passes the driver.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    each = files.select(
        F.element_at(F.split("path", "/"), -2).alias("artifact"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "length",
        F.sha2("content", 256).alias("sha"),
    )
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "sha"))), lambda x: F.concat(x["name"], F.lit(":"), x["sha"])), "\n")
    return each.groupBy("artifact").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.sha2(listed.cast("binary"), 256).alias("sha256"))


def source_manifest(docs: DataFrame, group: str, text: str) -> DataFrame:
    """(group, documents, bytes, digest): what a manifest tells of documents by their source.

    The digest is the sum of the first 60 bits of the texts' hashes: it does not depend on an order and needs no sort.
    """
    given = F.coalesce(text, F.lit(""))
    part = F.conv(F.substring(F.sha2(given.cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return docs.groupBy(group).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length(given)).alias("bytes"), F.sum(part).cast("string").alias("digest"))


def write_release(spark: SparkSession, root: str, tables: dict[str, DataFrame], source_sha: str, engine_sha: str) -> dict:
    """Write the artifacts of a new version, then its description, then the pointer to it.

    Pointers are one-row files in a folder to which only new ones are added, the last step of a release;
    readers follow the latest, so they see the old version or the new one and nothing between.
    """
    if not _SHA1.fullmatch(source_sha) or not _SHA1.fullmatch(engine_sha):
        raise ValueError("commit ids must be 40 lower-case hexadecimal digits")
    release_id = f"{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    folder = f"{root}/versions/{release_id}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    found = manifest(spark, folder).orderBy("artifact").collect()
    description = {
        "release_id": release_id,
        "source_sha": source_sha,
        "engine_sha": engine_sha,
        "artifacts": {r["artifact"]: {"files": r["files"], "bytes": r["bytes"], "sha256": r["sha256"]} for r in found},
    }
    line = spark.createDataFrame([(json.dumps(description, sort_keys=True),)], "value string")
    line.coalesce(1).write.text(f"{root}/releases/{release_id}")
    point_to(spark, root, release_id)
    return description


def point_to(spark: SparkSession, root: str, release_id: str) -> int:
    """Make a release the current one, and tell the pointer's number: one more than the latest.

    A number is created once: where another writer was faster, the next one is tried.
    """
    number = _latest(spark, root)[0] + 1
    while not create_if_absent(spark, f"{root}/current/{number:012d}.json", json.dumps({"number": number, "release_id": release_id})):
        number += 1
    return number


def _latest(spark: SparkSession, root: str) -> tuple[int, str | None]:
    try:
        found = spark.read.schema("number long, release_id string").json(f"{root}/current").agg(F.max_by("release_id", "number"), F.max("number")).first()
    except AnalysisException:
        return 0, None
    return (found[1] or 0, found[0])


def current_release(spark: SparkSession, root: str) -> str:
    """The release that readers should take."""
    if (found := _latest(spark, root)[1]) is None:
        raise ValueError("there is no release")
    return found


def read_release(spark: SparkSession, root: str, release_id: str | None = None) -> tuple[dict, dict[str, DataFrame]]:
    """A release's description and tables, after its manifest was verified against the files."""
    release_id = release_id or current_release(spark, root)
    if not re.fullmatch(r"[0-9a-zA-Z-]+", release_id):
        raise ValueError("the pointer is no release id")
    description = json.loads(spark.read.text(f"{root}/releases/{release_id}").first()[0])
    folder = f"{root}/versions/{release_id}"
    if problems := manifest_issues(description, {r["artifact"]: r.asDict() for r in manifest(spark, folder).collect()}):
        raise ValueError("; ".join(problems))
    return description, {name: spark.read.parquet(f"{folder}/{name}") for name in description["artifacts"]}


def manifest_issues(description: dict, found: dict[str, dict]) -> list[str]:
    """Where a description and what is on disk differ."""
    said, out = description.get("artifacts", {}), []
    out += [f"missing artifact: {x}" for x in sorted(set(said) - set(found))] + [f"unknown artifact: {x}" for x in sorted(set(found) - set(said))]
    for name in sorted(set(said) & set(found)):
        out += [f"{name}: {k} differs" for k in ("files", "bytes", "sha256") if said[name].get(k) != found[name][k]]
        if not _SHA256.fullmatch(str(said[name].get("sha256"))):
            out.append(f"{name}: sha256 is malformed")
    return out


def previous_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An artifact that an earlier build wrote as JSON; no rows where there is none."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def lineage_issues(source: str, published: str, parent: str | None, changed: list[str], allowed: tuple[str, ...]) -> list[str]:
    """A published commit is its source without changes, or the source's child that changes generated files only."""
    if published == source:
        return ["changes without a commit"] if changed else []
    out = [] if parent == source else ["the parent is not the source"]
    return out + [f"changed outside generated files: {p}" for p in sorted(set(changed) - set(allowed))] + ([] if changed else ["no changes"])


def public_projection(description: dict) -> dict:
    """What a release shows to readers."""
    return {k: description[k] for k in ("release_id", "source_sha", "engine_sha")} | {
        "artifacts": {k: {"sha256": v["sha256"], "bytes": v["bytes"]} for k, v in description["artifacts"].items()}
    }
