"""Contracts of vocabularies, bodies, research and judgements, as issues or first reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least confidence of a judgement, of its labels, and least score of a first continuation: fixed values.
MIN_CONFIDENCE, MIN_LABEL, MIN_METADATA = 0.8, 0.8, 0.3
STATUSES = ("supported", "partial", "unavailable", "not_applicable")


def policy_issues(canonical: DataFrame, aliases: DataFrame, most: int = 256) -> DataFrame:
    """(key, code) of a tag policy: canonical (id, label), aliases (alias, target)."""
    bad_id = canonical.where(~F.col("id").rlike("^[a-z0-9]+(-[a-z0-9]+)*$")).select(F.col("id").alias("key"), F.lit("id_not_kebab").alias("code"))
    space = canonical.where(F.trim("label") != F.col("label")).select(F.col("id").alias("key"), F.lit("label_has_space").alias("code"))
    lower = canonical.select("id", F.lower(F.trim("label")).alias("l"))
    twice = lower.groupBy("l").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").join(lower, "l").where("id <> first").select(F.col("id").alias("key"), F.lit("label_repeats").alias("code"))
    many = canonical.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.lit("canonical").alias("key"), F.lit("too_many").alias("code"))
    a = aliases.withColumn("l", F.lower(F.trim("alias")))
    a_space = a.where((F.trim("alias") == "") | (F.trim("alias") != F.col("alias"))).select(F.col("alias").alias("key"), F.lit("alias_has_space").alias("code"))
    a_twice = a.groupBy("l").agg(F.min("alias").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").join(a, "l").where("alias <> first").select(F.col("alias").alias("key"), F.lit("alias_repeats").alias("code"))
    ids = canonical.select(F.col("id").alias("_id"))
    is_id = a.join(ids, (F.col("alias") == F.col("_id")) | (F.col("l") == F.col("_id")), "left_semi").select(F.col("alias").alias("key"), F.lit("alias_is_canonical").alias("code"))
    lost = a.join(ids, F.col("target") == F.col("_id"), "left_anti").select(F.col("alias").alias("key"), F.lit("alias_target_unknown").alias("code"))
    out = bad_id
    for part in (space, twice, many, a_space, a_twice, is_id, lost):
        out = out.unionByName(part)
    return out


def body_issues(body: Column, title: Column, sections: tuple[str, ...]) -> Column:
    """array<string>: missing sections, sections out of order, a missing first heading or one that is not the title."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.rtrim(x))
    # The place of each section's first line; 0 where there is none.
    at = [F.array_position(lines, F.lit(f"## {name}")) for name in sections]
    found = [F.when(p == 0, F.lit(f"section_missing:{name}")) for p, name in zip(at, sections, strict=True)]
    for k in range(1, len(at)):
        before = F.greatest(F.lit(0).cast("long"), *at[:k]) if k > 1 else at[0]
        found.append(F.when((at[k] > 0) & (before > 0) & (at[k] < before), F.lit(f"section_order:{sections[k]}")))
    h1 = F.trim(F.regexp_extract(body, r"(?m)^#[ \t]+(.+)$", 1))
    found += [F.when(h1 == "", F.lit("h1_missing")), F.when((h1 != "") & (h1 != title), F.lit("h1_not_title"))]
    return F.array_compact(F.array(*found))


def coverage_issues(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """(key, dimension, code) of research coverage.

    rows: key, dimension, status, note, refs (array), unavailable_reason. evidence: key, evidence_id. Covered
    dimensions cite evidence, unavailable ones a reason, others neither; what is cited exists.
    """
    covered, no_refs = F.col("status").isin("supported", "partial"), F.size("refs") == 0
    reason = F.col("unavailable_reason").isNotNull()
    checks = {
        "status_invalid": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
        "note_empty": F.coalesce(F.trim("note"), F.lit("")) == "",
        "refs_required": covered & no_refs,
        "refs_not_allowed": F.col("status").isin("unavailable", "not_applicable") & ~no_refs,
        "reason_required": (F.col("status") == "unavailable") & ~reason,
        "reason_not_allowed": (F.col("status") != "unavailable") & reason,
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items())))
    direct = rows.select("key", "dimension", F.explode(found).alias("code"))
    cited = rows.select("key", "dimension", F.explode("refs").alias("evidence_id")).join(evidence, ["key", "evidence_id"], "left_anti")
    return direct.unionByName(cited.select("key", "dimension", F.lit("ref_unknown").alias("code")).distinct())


def progress_issues(items: DataFrame, progress: DataFrame) -> DataFrame:
    """(key, code): a progress row (key, total_items, total_bytes, exhaustive, stops) against the items it sums up."""
    sums = items.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"), F.count_distinct("path").alias("paths"))
    j = progress.join(sums, "key", "left")
    checks = {
        "items_differ": F.col("total_items") != F.coalesce("n", F.lit(0)),
        "bytes_differ": F.col("total_bytes") != F.coalesce("b", F.lit(0)),
        "paths_repeat": F.coalesce(F.col("paths") < F.col("n"), F.lit(False)),
        "exhaustive_with_stops": F.col("exhaustive") != (F.size("stops") == 0),
    }
    return j.select("key", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())))).alias("code"))


#: Workspaces and their locks: fixed values.
WORKSPACE_PATHS = ("profile", "projects", "knowledge", "config", "state", "data", "releases")
WORKSPACE_VERSIONS = LOCK_VERSIONS = (1,)


def _issues(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(True)), F.lit(code)) for code, broken in checks.items())))


def workspace_issues(version: Column, workspace_id: Column, paths: Column) -> Column:
    """array<string>: what is wrong with a workspace's settings; paths is a map of its folders.

    Each folder has a relative path of its own, in canonical form.
    """
    where = F.map_values(paths)
    bad = lambda p: (p == "") | (F.trim(p) != p) | p.rlike(r"^([A-Za-z]:|/)|\\") | F.exists(F.split(p, "/"), lambda x: x.isin("", ".", ".."))
    return _issues(
        {
            "version_unsupported": ~version.isin(*WORKSPACE_VERSIONS),
            "id_invalid": ~workspace_id.rlike("^[a-z0-9][a-z0-9-]{0,63}$"),
            "paths_keys": F.array_sort(F.map_keys(paths)) != F.array(*map(F.lit, sorted(WORKSPACE_PATHS))),
            "path_invalid": F.exists(where, lambda p: F.coalesce(bad(p), F.lit(True))),
            "path_repeats": F.size(F.array_distinct(where)) < F.size(where),
        }
    )


def lock_issues(version: Column, repository: Column, commit: Column, workspace_version: Column) -> Column:
    """array<string>: what is wrong with the lock that pins a workspace's engine."""
    return _issues(
        {
            "version_unsupported": ~version.isin(*LOCK_VERSIONS),
            "repository_invalid": ~repository.rlike("^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"),
            "commit_invalid": ~commit.rlike("^[0-9a-f]{40}$"),
            "workspace_version_invalid": workspace_version < 1,
        }
    )


def hand_off_stage(request: Column, evidence: Column, handoff: Column, judgement: Column, plan: Column, analysis: Column) -> Column:
    """What an ingestion does next, by which of its files are there."""
    return (
        F.when(~request, F.lit("missing-request"))
        .when(~evidence & handoff & ~judgement, F.lit("waiting-for-judgement"))
        .when(~evidence & ~handoff & judgement, F.lit("judgement-without-evidence"))
        .when(~evidence, F.lit("fetch-evidence"))
        .when(analysis, F.lit("apply-analysis"))
        .when(plan, F.lit("expand-research"))
        .otherwise(F.lit("waiting-for-analysis"))
    )


#: Files of an ingestion: fixed values.
HAND_OFF_FILES = ("request", "evidence", "handoff", "judgement", "plan", "analysis")


def hand_off(files: DataFrame, *identity: str, kind: str = "kind") -> DataFrame:
    """(identity, files, stage) of each ingestion, from the arrival of its files (identity, kind); kinds that are unknown are no files.

    What an ingestion has is the union of what has arrived, so files that are late, repeated or out of order make
    no difference, and a stream of arrivals has the batch's stages: its state is six flags an ingestion.
    """
    have = files.groupBy(*identity).agg(*(F.coalesce(F.max(F.col(kind) == x), F.lit(False)).alias(f"_{x}") for x in HAND_OFF_FILES))
    there = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"_{x}"), F.lit(x)) for x in HAND_OFF_FILES))), ",")
    return have.select(*identity, there.alias("files"), hand_off_stage(*(F.col(f"_{x}") for x in HAND_OFF_FILES)).alias("stage"))


#: Files of an ingestion that is kept as state, with what research found so far: fixed values.
INGESTION_FILES = ("request", "handoff", "judgement", "evidence", "plan", "research", "analysis")


def ingestion_stage(provider: Column, has: dict[str, Column], same_digest: Column) -> Column:
    """struct<stage, waiting_for, issue>: what an ingestion does next, what it waits for, or why its files cannot be so.

    has: which of INGESTION_FILES are there; same_digest: the judgement is bound to the hand-off that is there. Hand-offs belong to
    threads alone, research to repositories; the first issue counts, and an ingestion with an issue has no stage. Without any file it is closed.
    """
    h, off = has, F.lit(None).cast("string")
    threads, github = (F.coalesce(provider == x, F.lit(False)) for x in ("threads", "github"))
    some = lambda *names: reduce(Column.__or__, (h[x] for x in names))
    issue = (
        F.when(~h["request"] & some(*INGESTION_FILES[1:]), F.lit("request_missing"))
        .when(~threads & some("handoff", "judgement"), F.lit("handoff_of_other_provider"))
        .when(~github & some("plan", "research"), F.lit("research_of_other_provider"))
        .when(h["plan"] & h["analysis"], F.lit("plan_with_analysis"))
        .when(~h["evidence"] & some("analysis", "plan", "research"), F.lit("before_evidence"))
        .when(~h["evidence"] & h["judgement"] & ~h["handoff"], F.lit("judgement_without_handoff"))
        .when(~h["evidence"] & h["judgement"] & ~same_digest, F.lit("judgement_of_other_evidence"))
        .when(h["evidence"] & some("handoff", "judgement"), F.lit("handoff_not_cleared"))
        .when(h["evidence"] & github & ~h["research"], F.lit("research_missing"))
    )
    stage = (
        F.when(~h["request"], F.lit("closed"))
        .when(~h["evidence"] & h["handoff"] & ~h["judgement"], F.lit("waiting-for-analysis"))
        .when(~h["evidence"], F.lit("fetch-evidence"))
        .when(h["analysis"], F.lit("apply-analysis"))
        .when(h["plan"], F.lit("expand-research"))
        .otherwise(F.lit("waiting-for-analysis"))
    )
    waits = F.when(~h["evidence"], F.lit("semantic-judgement")).when(github, F.lit("research-plan-or-analysis")).otherwise(F.lit("analysis"))
    fine = issue.isNull()
    return F.struct(F.when(fine, stage).alias("stage"), F.when(fine & (stage == "waiting-for-analysis"), waits).otherwise(off).alias("waiting_for"), issue.alias("issue"))


def canonical_link(html: Column) -> Column:
    """The page's own canonical address: its link element, else its og:url."""
    link = F.regexp_extract(html, r"(?is)<link\b[^>]*rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']+)", 1)
    og = F.regexp_extract(html, r"(?is)<meta\b[^>]*property=[\"']og:url[\"'][^>]*content=[\"']([^\"']+)", 1)
    return F.when(link != "", link).when(og != "", og)


def card_path(id_: Column, created_at: Column, existing: Column) -> Column:
    """Where a card is written: where it is, else by its year and id."""
    return F.coalesce(existing, F.concat(F.lit("content/knowledge/"), F.substring(created_at, 1, 4), F.lit("/"), id_, F.lit(".md")))


def state_path(provider: Column, identity: Column) -> Column:
    return F.concat(F.lit("state/sources/"), provider, F.lit("/"), F.regexp_replace(F.regexp_replace(identity, "^[a-z]+:", ""), "[^a-zA-Z0-9._-]+", "--"), F.lit(".json"))


def media_of(rows: DataFrame) -> DataFrame:
    """(id, place, type, url): a post's media, each address once, a carousel's children in order.

    rows: id, items array<struct<type, url>>.
    """
    each = rows.select("id", F.posexplode("items").alias("place", "m")).where("m.url is not null")
    kind = F.when(F.contains(F.lower("m.type"), F.lit("video")), "video").when(F.lower("m.type").rlike("image|photo"), "image").otherwise("unknown")
    return each.groupBy("id", "m.url").agg(F.min(F.struct("place", kind.alias("type"))).alias("f")).select("id", "f.place", "f.type", "url")
