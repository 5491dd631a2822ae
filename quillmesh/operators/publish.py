"""Releases as commits: artifacts are staged, described, and made visible together or not at all.

A writer's tables go to a folder of its own; what they are (files, bytes, hash) is read back from there. Then one commit
names all artifacts of the new release: those that the writer made and the others as they were. Where another writer was
faster, the commit is made again on what that one left, unless both made the same artifact: then the later one fails. Whatever fails
takes its staged folder away. Readers follow one commit, so a release under way is never seen.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .commits import CommitLog, ConflictError, delete_folder, list_names
from .release import manifest

_NAME = re.compile(r"[a-z][a-z0-9_]*")
HISTORY = "number long, base long, changed array<string>, artifacts map<string, struct<path: string, files: long, bytes: long, sha256: string>>"


class Releases:
    """Releases below a folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/log")

    def publish(self, tables: dict[str, DataFrame], base: int | None = None) -> int:
        """Make these artifacts the newest, and tell the release's number.

        base: the release that they were made from; the present one by default. Fails with ConflictError where one of them was changed since.
        """
        for name in tables:
            if not _NAME.fullmatch(name):
                raise ValueError(f"{name!r} is no artifact's name")
        base = self.log.head() if base is None else base
        before = self.log.read(base).get("artifacts", {})
        stage = f"staged/{uuid.uuid4().hex}"
        try:
            for name, df in tables.items():
                df.write.parquet(f"{self.root}/{stage}/{name}")
            said = {r["artifact"]: {"path": f"{stage}/{r['artifact']}", "files": r["files"], "bytes": r["bytes"], "sha256": r["sha256"]} for r in manifest(self.spark, f"{self.root}/{stage}").collect()}

            def change(state: dict) -> dict:
                now = state.get("artifacts", {})
                if lost := sorted(x for x in tables if now.get(x) != before.get(x)):
                    raise ConflictError(f"changed by another release: {', '.join(lost)}")
                return {"artifacts": now | said, "changed": sorted(said)}

            return self.log.update(change)
        except BaseException:
            delete_folder(self.spark, f"{self.root}/{stage}")
            raise

    def table(self, name: str, number: int | None = None) -> DataFrame:
        """An artifact as a release has it, the newest by default."""
        artifacts = self.log.read(number).get("artifacts", {})
        if name not in artifacts:
            raise KeyError(f"the release has no artifact {name}")
        return self.spark.read.parquet(f"{self.root}/{artifacts[name]['path']}")

    def history(self) -> DataFrame:
        """(number, base, artifact, changed, path, files, bytes, sha256) of all artifacts of all releases."""
        found = self.spark.read.schema(HISTORY).option("pathGlobFilter", "*.json").json(self.log.folder) if self.log.head() else self.spark.createDataFrame([], HISTORY)
        each = found.select("number", "base", "changed", F.explode("artifacts").alias("artifact", "a"))
        return each.select("number", "base", "artifact", F.array_contains("changed", F.col("artifact")).alias("changed"), "a.*")

    def files(self) -> DataFrame:
        """(path, files, bytes, sha256) of all staged artifacts as they are now."""
        stages = [f"{self.root}/staged/{x}" for x in list_names(self.spark, f"{self.root}/staged")]
        out = None
        for stage in stages:
            name = stage.rsplit("/", 1)[1]
            one = manifest(self.spark, stage).select(F.concat(F.lit(f"staged/{name}/"), "artifact").alias("path"), "files", "bytes", "sha256")
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], "path string, files long, bytes long, sha256 string") if out is None else out

    def vacuum(self, keep: int = 10) -> list[str]:
        """Delete staged folders that none of the latest `keep` releases names; no writer may be under way."""
        kept = set()
        for number in self.log.numbers()[-keep:]:
            kept |= {a["path"].split("/")[1] for a in self.log.read(number)["artifacts"].values()}
        gone = [x for x in list_names(self.spark, f"{self.root}/staged") if x not in kept]
        for name in gone:
            delete_folder(self.spark, f"{self.root}/staged/{name}")
        return gone


def release_issues(history: DataFrame, required: tuple[str, ...] = (), files: DataFrame | None = None) -> DataFrame:
    """(number, artifact, code) of each rule that a release breaks; history as Releases.history() gives it.

    files: what is there, (path, files, bytes, sha256), to be held against what releases say. artifact is null where a whole release is meant.
    """
    hexadecimal = F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
    safe = F.coalesce(F.col("path").rlike("^staged/[0-9a-f]{32}/[a-z][a-z0-9_]*$"), F.lit(False))
    rules: dict[str, Column] = {
        "artifact_name_invalid": ~F.coalesce(F.col("artifact").rlike("^[a-z][a-z0-9_]*$"), F.lit(False)),
        "path_invalid": ~safe,
        "path_of_another_artifact": safe & (F.element_at(F.split("path", "/"), -1) != F.col("artifact")),
        "sha256_malformed": ~hexadecimal,
        "files_missing": F.coalesce(F.col("files") < 1, F.lit(True)),
        "bytes_invalid": F.coalesce(F.col("bytes") < 0, F.lit(True)),
    }
    rows = history
    if files is not None:
        there = files.select(F.col("path").alias("_p"), F.col("files").alias("_f"), F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
        rows = rows.join(there, F.col("path") == F.col("_p"), "left")
        gone = F.col("_p").isNull()
        rules |= {"artifact_gone": gone, "files_differ": ~gone & ~F.col("files").eqNullSafe(F.col("_f")), "bytes_differ": ~gone & ~F.col("bytes").eqNullSafe(F.col("_b")), "sha256_differs": ~gone & ~F.col("sha256").eqNullSafe(F.col("_s"))}
    codes = F.array_compact(F.array(*(F.when(broken, F.lit(code)) for code, broken in rules.items())))
    each = rows.select("number", "artifact", F.explode(codes).alias("code"))
    whole = history.groupBy("number").agg(F.min("base").alias("base"), F.collect_set("artifact").alias("names"), F.count(F.lit(1)).alias("n"))
    # Only numbers, a row a release, are put in order.
    former = F.lag("number").over(Window.orderBy("number"))
    whole = whole.withColumn("_former", F.coalesce(former, F.lit(0)))
    lacking = F.transform(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), "names"), lambda x: F.concat(F.lit("artifact_missing:"), x))
    odd = F.array(F.when(F.col("number") != F.col("_former") + 1, F.lit("number_gap")), F.when(~F.col("base").eqNullSafe(F.col("number") - 1), F.lit("base_is_not_former")), F.when(F.col("n") != F.size("names"), F.lit("artifact_twice")))
    more = whole.select("number", F.lit(None).cast("string").alias("artifact"), F.explode(F.concat(F.array_compact(odd), lacking)).alias("code"))
    return each.unionByName(more)
