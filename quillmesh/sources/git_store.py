"""Files of repositories from landed git objects: commits, recursive trees and blobs as JSON payloads.

What a fetcher lands are three tables: commits (repo, ref, payload), trees (sha, payload) and blobs (sha, payload),
each payload as the host of the repository answers it. Nothing is fetched here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of payloads that are read: fixed names.
_COMMIT = "sha string, commit struct<tree struct<sha string>>, parents array<struct<sha string>>"
_TREE = "truncated boolean, tree array<struct<path string, type string, sha string, size long>>"
_BLOB = "encoding string, content string, size long"
_SHA = "^[0-9a-f]{40}$"


def revisions(commits: DataFrame) -> DataFrame:
    """(repo, ref, revision, tree, parents, error): where each ref stands; revision_invalid where its payload names no commit or tree. Parents without a valid name are left out."""
    p = commits.select("repo", "ref", F.from_json("payload", _COMMIT).alias("p"))
    names = p.select("repo", "ref", F.lower("p.sha").alias("revision"), F.lower("p.commit.tree.sha").alias("tree"), F.filter(F.transform("p.parents", lambda x: F.lower(x["sha"])), lambda s: s.rlike(_SHA)).alias("parents"))
    good = F.coalesce(F.col("revision").rlike(_SHA) & F.col("tree").rlike(_SHA), F.lit(False))
    kept = [F.when(good, F.col(c)).alias(c) for c in ("revision", "tree")]
    return names.select("repo", "ref", *kept, F.when(good, F.coalesce("parents", F.array().cast("array<string>"))).alias("parents"), F.when(~good, F.lit("revision_invalid")).alias("error"))


def _tree_error(p: Column) -> Column:
    return F.when(p.isNull(), F.lit("tree_missing")).when(F.coalesce(p["truncated"], F.lit(False)), F.lit("tree_truncated")).when(p["tree"].isNull(), F.lit("tree_invalid"))


def entries(at: DataFrame, trees: DataFrame, paths: str = ".*") -> DataFrame:
    """(repo, revision, path, sha, error): the files of revisions() whose whole path fits a pattern.

    A revision whose tree is not there, is cut off by its host, or is no tree, gives one row with an error and no path: what is not
    known in full is not read at all. A path that stands twice in a tree is its last entry.
    """
    # A tree is parsed once for all the refs that stand on it; a host cuts trees off, so a payload is bounded.
    wanted = trees.join(at.where("tree IS NOT NULL").select(F.col("tree").alias("sha")).distinct(), "sha", "left_semi")
    parsed = wanted.groupBy("sha").agg(F.max("payload").alias("payload")).select(F.col("sha").alias("tree"), F.from_json("payload", _TREE).alias("p"))
    known = at.select("repo", "revision", "tree", F.col("error").alias("_e")).distinct().join(parsed, "tree", "left").withColumn("error", F.coalesce("_e", _tree_error(F.col("p"))))
    none = F.lit(None).cast("string")
    bad = known.where("error IS NOT NULL").select("repo", "revision", none.alias("path"), none.alias("sha"), "error")
    each = known.where("error IS NULL").select("repo", "revision", F.posexplode("p.tree").alias("place", "x"))
    files = each.where((F.col("x.type") == "blob") & F.col("x.path").rlike(f"^(?:{paths})$"))
    one = files.groupBy("repo", "revision", F.col("x.path").alias("path")).agg(F.max_by(F.lower("x.sha"), "place").alias("sha"))
    return one.select("repo", "revision", "path", "sha", none.alias("error")).unionByName(bad)


def blob_texts(blobs: DataFrame, max_bytes: int) -> DataFrame:
    """(sha, bytes, text, error): the text of each blob; what is no base64 or UTF-8, is over `max_bytes`, or has not the length it states, has an error instead."""
    # Texts that are too long are refused by the size they state, and not decoded.
    p = blobs.select(F.lower("sha").alias("sha"), F.from_json("payload", _BLOB).alias("p"))
    formed = F.coalesce((F.col("p.encoding") == "base64") & F.col("p.content").isNotNull() & (F.col("p.size") >= 0), F.lit(False))
    small = formed & (F.col("p.size") <= max_bytes)
    data = p.withColumn("_d", F.when(small, F.try_to_binary(F.regexp_replace("p.content", r"\s", ""), F.lit("base64"))))
    text = F.col("_d").cast("string")
    error = (
        F.when(~formed, F.lit("blob_invalid"))
        .when(~small, F.lit("blob_too_large"))
        .when(F.col("_d").isNull() | ~F.is_valid_utf8(text), F.lit("blob_invalid"))
        .when(F.octet_length("_d") != F.col("p.size"), F.lit("blob_size_differs"))
    )
    return data.select("sha", F.col("p.size").alias("bytes"), F.when(error.isNull(), text).alias("text"), error.alias("error"))


def files(commits: DataFrame, trees: DataFrame, blobs: DataFrame, paths: str = ".*", max_bytes: int = 1 << 20, parts: int = 64) -> DataFrame:
    """(repo, revision, path, sha, bytes, text, error): all files of all refs whose paths fit; bad objects are rows with an error.

    Blobs are decoded where they are read, so that texts move instead of payloads, which are longer and hardly compress. Of the copies of a
    blob one that is good counts. Very many paths may have one content: they meet it in up to `parts` tasks, to each of which the text goes once.
    """
    listed = entries(revisions(commits), trees, paths).withColumn("_part", F.pmod(F.xxhash64("repo", "revision", "path"), F.lit(parts)))
    places = listed.where("sha IS NOT NULL").select("sha", "_part").distinct()
    # Copies are merged in the tasks that read them, before anything moves.
    best = blob_texts(blobs, max_bytes).groupBy("sha").agg(F.max(F.struct(F.col("error").isNull().alias("good"), "bytes", "text", "error")).alias("b"))
    texts = places.join(best.select("sha", "b.bytes", "b.text", F.col("b.error").alias("_e"), F.lit(True).alias("_there")), "sha")
    lost = F.when(F.col("path").isNotNull() & F.col("_there").isNull(), F.lit("blob_missing"))
    return listed.join(texts, ["sha", "_part"], "left").select("repo", "revision", "path", "sha", "bytes", "text", F.coalesce("error", "_e", lost).alias("error"))
