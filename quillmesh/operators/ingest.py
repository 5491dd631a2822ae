"""Ingestion: which card a source belongs to, what is read of a repository, what an update changes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import is_safe_path
from .rounds import checkpoint

#: Kinds of evidence: fixed values.
KINDS = (
    "readme", "documentation", "manifest", "configuration", "entrypoint", "api", "data_model", "auth",
    "security", "background_job", "deployment", "license", "source", "test", "other",
)


def normalize_kind(raw: Column, known: tuple[str, ...] = KINDS) -> Column:
    """A kind in its known spelling, where it is known; else as it came."""
    tidy = F.regexp_replace(F.lower(F.trim(raw)), r"[\s-]+", "_")
    return F.when(tidy.isin(*known), tidy).otherwise(raw)


#: The most items of a kind in a first pack: fixed values.
KIND_CAPS = {
    "readme": 1, "documentation": 4, "manifest": 1, "entrypoint": 3, "source": 2, "api": 2, "data_model": 2, "auth": 2,
    "background_job": 2, "security": 1, "deployment": 1, "license": 1, "configuration": 2, "test": 2, "other": 1,
}
#: What a first pack takes in which turn, and how many of each; kinds that stand for how a project works, and how many of them: fixed values.
QUOTAS = (("readme", 1), ("documentation", 3), ("manifest", 1), ("entrypoint", 2), ("security", 1), ("license", 1))
MECHANISMS, MECHANISM_FILES = ("api", "data_model", "auth", "background_job", "source"), 4
LATE_QUOTAS = (("deployment", 1),)
MAX_ITEMS, MAX_BYTES = 14, 512 * 1024
#: Repositories whose packs, of at most MAX_ITEMS files, are broadcast.
BROADCAST_REPOS = 20_000

#: Endings of source files and of other texts, names of texts without an ending, and files that machines write: fixed values.
SOURCE_ENDINGS = (
    ".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".py", ".go", ".rs", ".java", ".kt", ".kts", ".rb", ".php", ".cs", ".swift", ".sh", ".bash",
    ".zsh", ".sql", ".graphql", ".gql", ".proto", ".svelte", ".vue", ".cts", ".mts", ".ps1",
)
TEXT_ENDINGS = (*SOURCE_ENDINGS, ".md", ".mdx", ".txt", ".json", ".jsonc", ".yaml", ".yml", ".toml", ".xml", ".ini", ".cfg", ".conf", ".env")
TEXT_NAMES = ("dockerfile", "makefile", "procfile", "gemfile", "license", "copying", "_headers")
LOCK_FILES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "bun.lockb", "poetry.lock", "cargo.lock", "go.sum")
MANIFESTS = (
    "package.json", "pyproject.toml", "requirements.txt", "go.mod", "cargo.toml", "pom.xml", "build.gradle", "build.gradle.kts",
    "composer.json", "gemfile", "mix.exs", "deno.json", "deno.jsonc", "package.swift",
)


@dataclass(frozen=True)
class FileRule:
    """Fits a file by any of its name, its path, a part of its path or its ending; `also` and `source` must hold besides."""

    kind: str
    priority: int
    name: str = ""
    path: str = ""
    parts: tuple[str, ...] = ()
    endings: tuple[str, ...] = ()
    also: str = ""
    source: bool = False

    def fits(self, low: Column, base: Column, ending: Column) -> Column:
        ways = [base.rlike(self.name)] * bool(self.name) + [low.rlike(self.path)] * bool(self.path) + [ending.isin(*self.endings)] * bool(self.endings)
        if self.parts:
            ways.append(F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, self.parts))))
        needs = [low.rlike(self.also)] * bool(self.also) + [ending.isin(*SOURCE_ENDINGS)] * self.source
        return reduce(and_, needs, reduce(or_, ways))


_DOCS = {"parts": ("docs", "doc", "documentation"), "endings": (".md", ".mdx")}
#: Kind and priority of a file, the first rule that fits: fixed values.
FILE_RULES = (
    FileRule("readme", 0, name=r"^readme(?:\.[^.]+)?$"),
    FileRule("security", 0, name=r"^(security|security-policy)(?:\.[^.]+)?$"),
    FileRule("license", 1, name=r"^(license|licence|copying)(?:\.[^.]+)?$"),
    FileRule("manifest", 1, name="^(" + "|".join(x.replace(".", r"\.") for x in MANIFESTS) + ")$"),
    FileRule("deployment", 2, name=r"^dockerfile$|^docker-compose|^(vercel|netlify|render|railway|fly)\.", path=r"^\.github/workflows(/|$)", parts=("deploy", "deployment", "k8s", "kubernetes", "helm", "terraform")),
    FileRule("documentation", 1, also="architecture|design|internals|overview", **_DOCS),
    FileRule("documentation", 3, **_DOCS),
    FileRule("auth", 2, path="auth|oauth|permission|authorization"),
    FileRule("security", 2, path="security|threat|trust|attest|secret"),
    FileRule("background_job", 3, path="job|queue|worker|inngest|scheduler|cron|background"),
    FileRule("data_model", 3, path=r"schema|model|migration|prisma|drizzle|database|(^|/)db([./]|$)"),
    FileRule("api", 4, path=r"api|route|router|controller|handler|endpoint|server[-_.]?action|(^|/)actions?([./]|$)"),
    FileRule("configuration", 5, path=r"config|settings|\.env(?:\.example|\.sample)?$", endings=(".json", ".jsonc", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf")),
    FileRule("entrypoint", 4, name=r"^(index|main|app|server|cli)\.[^/]+$", source=True),
    FileRule("test", 8, path=r"\.(test|spec)\.[^.]+$", parts=("test", "tests", "__tests__", "spec")),
    FileRule("source", 7, parts=("src", "app", "apps", "packages", "server", "client", "lib", "core"), source=True),
)
#: What a file's score gains (less is better) by its kind, the first pattern that fits its name or path: fixed values.
PREFERENCES = {
    "documentation": (
        ("path", "architecture|design|internals|overview", -700),
        ("path", "introduction|concepts?|core[-_. ]?model", -600),
        ("path", "methodology|workflow|data[-_. ]?flow|control[-_. ]?flow", -550),
        ("path", "plugins?|extensions?|custom[-_. ]?commands?", -525),
        ("path", r"^docs?/(?:index|readme)\.(?:md|mdx)$", -500),
        ("path", "usage|guide|getting[-_. ]?started", -350),
        ("path", "contributing|code[-_. ]?of[-_. ]?conduct|changelog|release[-_. ]?notes", 700),
    ),
    "deployment": (
        ("path", r"(^|/)dockerfile$|(^|/)docker-compose[^/]*$|(?:^|/)(?:deploy|deployment|k8s|kubernetes|helm|terraform)(?:/|$)", -600),
        ("name", "publish|release|deploy", -350),
        ("name", "test|mypy|ruff|lint|issue|dependabot", 700),
    ),
    "configuration": (("path", "dependabot|readthedocs", 500), ("path", "example|sample|default", -150)),
    "source": (("name", r"^__init__\.[^/]+$|(?:^|[._-])index\.[^/]+$", 800), ("name", "base|types?|constants?", 150)),
    "test": (("name", r"^__init__\.[^/]+$|(?:^|[._-])index\.[^/]+$", 800), ("name", "base|types?|constants?", 150)),
    "auth": (("path", "auth|oauth|permission|authorization", -400), ("path", "", 300)),
    "license": (("path", "^docs?/", -150),),
}


def _base(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def classify_path(path: Column) -> Column:
    """struct<kind, priority> of a file by its path; null where it is no text, written by a machine or of no use."""
    low, base = F.lower(path), _base(path)
    ending = F.regexp_extract(base, r"^.+(\.[^.]*)$", 1)
    text = (base.isin(*TEXT_NAMES) | ending.isin(*TEXT_ENDINGS)) & ~base.isin(*LOCK_FILES) & ~base.rlike(r"\.min\.(js|css)$")
    fitting = F.array(*(F.when(rule.fits(low, base, ending), F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.priority).alias("priority"))) for rule in FILE_RULES))
    return F.when(text, F.get(F.array_compact(fitting), F.lit(0)))


def low_signal(path: Column, kind: Column) -> Column:
    """Package markers and index files of sources and tests."""
    return kind.isin("source", "test") & _base(path).rlike(PREFERENCES["source"][0][1])


def candidate_score(path: Column, kind: Column, priority: Column) -> Column:
    """Lower is better: the priority, then what PREFERENCES say."""
    seen = {"path": F.lower(path), "name": _base(path)}
    gains = [F.when((kind == k) & seen[where].rlike(pattern), F.lit(gain)) for k, entries in PREFERENCES.items() for where, pattern, gain in entries]
    return priority * 1000 + F.coalesce(*gains, F.lit(0))


def _offers(scored: DataFrame) -> DataFrame:
    """(repo, turn, score, path, kind, bytes, most): when a file may be taken, and how many of its kind there may be then.

    A file has a turn with its kind's quota, one as a mechanism if it is the best of such a
    kind and among the best MECHANISM_FILES of these, and one at the end.
    """
    last = len(QUOTAS) + 1 + len(LATE_QUOTAS)
    caps = F.create_map(*(F.lit(x) for pair in KIND_CAPS.items() for x in pair))
    cap = F.coalesce(F.try_element_at(caps, F.col("kind")), F.lit(1))
    quotas = [*enumerate(QUOTAS), *enumerate(LATE_QUOTAS, len(QUOTAS) + 1)]
    turns = [F.when(F.col("kind") == kind, F.struct(F.lit(turn).alias("turn"), F.least(F.lit(n), cap).alias("most"))) for turn, (kind, n) in quotas]
    turns.append(F.struct(F.lit(last).alias("turn"), cap.alias("most")))
    usual = scored.select("repo", "score", "path", "kind", "bytes", F.inline(F.array_compact(F.array(*turns))))
    best = scored.where(F.col("kind").isin(*MECHANISMS)).groupBy("repo", "kind").agg(F.min(F.struct("score", "path", "bytes")).alias("x")).select("repo", "kind", "x.*")
    # At most one row a mechanism is left of a repository here.
    place = F.row_number().over(Window.partitionBy("repo").orderBy("score", "path"))
    chosen = best.withColumn("n", place).where(F.col("n") <= MECHANISM_FILES)
    names = ("repo", "turn", "score", "path", "kind", "bytes", "most")
    return usual.select(*names).unionByName(chosen.withColumns({"turn": F.lit(len(QUOTAS)), "most": cap}).select(*names))


def select_packs(candidates: DataFrame, max_items: int = MAX_ITEMS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(repo, path, kind, bytes, place) of each repository's first pack.

    candidates: (repo, path, kind, priority, bytes). Files are offered in turns (quotas, mechanisms, late quotas, the
    rest), within a turn by score and path; one is taken if its kind has room and its bytes fit. What
    has been passed over never fits later, so the next file of a pack is the least offer after
    the last one taken that fits now: one partial aggregate a round, at most max_items rounds for all
    repositories together. What is kept between rounds is a row a repository.
    """
    scored = candidates.where(~low_signal(F.col("path"), F.col("kind")) & F.col("bytes").between(0, max_bytes)).select(
        "repo", "path", "kind", F.col("bytes").cast("long").alias("bytes"), candidate_score(F.col("path"), F.col("kind"), F.col("priority")).cast("long").alias("score")
    )
    offers = checkpoint(_offers(scored))
    order = ("turn", "score", "path")
    nothing = "array<struct<turn:int,score:bigint,path:string,kind:string,bytes:bigint>>"
    state = checkpoint(offers.select("repo").distinct().select("repo", F.array().cast(nothing).alias("pack")))
    open_ = state
    for _ in range(max_items):
        after = F.struct(*(F.col(x) for x in order)) > F.struct(*(F.try_element_at("pack", F.lit(-1))[x].alias(x) for x in order))
        of_kind = F.size(F.filter("pack", lambda p: p["kind"] == F.col("kind")))
        used = F.reduce("pack", F.lit(0).cast("long"), lambda n, p: n + p["bytes"])
        fits = ((F.size("pack") == 0) | after) & (of_kind < F.col("most")) & (used + F.col("bytes") <= max_bytes) & ~F.exists("pack", lambda p: p["path"] == F.col("path"))
        # A row a repository: broadcast where they are counted few, so that a repository of very many files is not one task.
        side = F.broadcast(open_) if open_.count() <= BROADCAST_REPOS else open_
        found = offers.join(side, "repo").where(fits).groupBy("repo").agg(F.min(F.struct(*order, "kind", "bytes")).alias("next"))
        open_ = checkpoint(open_.join(found, "repo").select("repo", F.array_append("pack", F.col("next")).alias("pack")))
        if open_.isEmpty():
            break
        state = checkpoint(state.join(open_.withColumnRenamed("pack", "_more"), "repo", "left").select("repo", F.coalesce("_more", "pack").alias("pack")))
    packed = F.array_sort(F.transform("pack", lambda p: F.struct(p["score"].alias("score"), p["path"].alias("path"), p["kind"].alias("kind"), p["bytes"].alias("bytes"))))
    each = state.select("repo", F.posexplode(packed).alias("at", "p"))
    return each.select("repo", "p.path", "p.kind", "p.bytes", (F.col("at") + 1).cast("long").alias("place"))


#: Bounds of a selection: fixed values.
SELECTION = {"items": 20, "item_bytes": 163_840, "total_bytes": 786_432}


def expand_selection(candidates: DataFrame, selected: DataFrame, wanted: DataFrame, limits: dict[str, int] = SELECTION) -> DataFrame:
    """(repo, items, bytes, unknown, too_large, unmatched, code): what a round of expansion would fetch for each repository.

    candidates: repo, path, kind, bytes (what discovery found); selected: repo, path; wanted: repo, kind, hint (a kind or the begin of a path that the plan asks
    for; either may be null). code is the first budget or rule that the round breaks, null if it may go on. A path
    that discovery did not find is unknown; a file that no request asks for is unmatched. Repositories without a selection have no row.
    """
    joined = selected.select("repo", "path").distinct().join(candidates, ["repo", "path"], "left")
    asked = F.transform(F.collect_set(F.struct("kind", "hint")), lambda x: x)
    plans = wanted.groupBy("repo").agg(asked.alias("_asked"))
    matches = F.exists("_asked", lambda x: F.coalesce(x["kind"] == F.col("kind"), F.lit(False)) | F.coalesce(F.startswith(F.col("path"), x["hint"]), F.lit(False)))
    rows = joined.join(plans, "repo", "left").withColumn("_fits", F.coalesce(matches, F.lit(False)))
    sums = rows.groupBy("repo").agg(
        F.count(F.lit(1)).alias("items"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"),
        F.count_if(F.col("kind").isNull()).alias("unknown"),
        F.count_if(F.col("bytes") > limits["item_bytes"]).alias("too_large"),
        F.count_if(~F.col("_fits")).alias("unmatched"),
        F.count_if(~is_safe_path(F.col("path"))).alias("_unsafe"),
    )
    code = (
        F.when(F.col("items") > limits["items"], F.lit("item_budget_exceeded"))
        .when(F.col("_unsafe") > 0, F.lit("path_unsafe"))
        .when(F.col("unknown") > 0, F.lit("path_unknown"))
        .when(F.col("too_large") > 0, F.lit("item_too_large"))
        .when(F.col("bytes") > limits["total_bytes"], F.lit("byte_budget_exceeded"))
    )
    return sums.withColumn("code", code).drop("_unsafe")


#: Bounds of a tree walk: fixed values.
WALK = {"trees": 64, "entries": 4_000, "candidates": 500, "depth": 5}
#: Folders that a walk leaves out, and what others wait for by the names in their path: fixed values.
SKIPPED_FOLDERS = (
    ".git", ".cache", ".next", ".nuxt", "node_modules", "vendor", "vendors", "dist", "build", "out", "coverage", "target", "obj", "generated", "tmp", "temp",
)
FOLDER_PRIORITIES = (
    (0, ("docs", "doc", "documentation")),
    (1, ("src", "app", "apps", "packages", "server", "api", "lib", "core")),
    (2, ("config", "configs", "schema", "schemas", "migration", "migrations", ".github")),
    (4, ("test", "tests", "__tests__", "spec")),
)
OTHER_FOLDERS = 8


def _named(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, names)))


def folder_skipped(path: Column) -> Column:
    """Whether a folder, or one that it is in, is left out."""
    return _named(path, SKIPPED_FOLDERS)


def folder_priority(path: Column) -> Column:
    """A folder's place in the walk, the least first."""
    found = F.lit(OTHER_FOLDERS)
    for place, names in reversed(FOLDER_PRIORITIES):
        found = F.when(_named(path, names), F.lit(place)).otherwise(found)
    return found


def discover(trees: DataFrame, limits: dict[str, int] = WALK) -> DataFrame:
    """(repo, path, place, stops): the bounded best-first walk of every repository's tree.

    trees: (repo, parent, path, is_folder, priority), the root's path empty. Folders wait by priority, then depth,
    then path; each one's entries are met by path. Folders with a skipped name count as entries and are not
    opened. A walk stops where the next entry, file or folder is over a limit; a folder too deep is passed over. stops: why a
    walk fell short, in that order.

    All repositories walk at the same time, one folder a round, so there are no more rounds than folders may be opened. A
    round takes the least of each frontier, joins its entries, of which each repository numbers no more than may be met, and
    adds to frontiers and sums; no repository's tree comes to one task.
    """
    rows = checkpoint(trees.select("repo", "parent", "path", "is_folder", F.col("priority").cast("int").alias("priority"), (F.col("is_folder") & folder_skipped(F.col("path"))).alias("skipped")))
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")
    state = checkpoint(rows.select("repo").distinct().select("repo", zero.alias("entries"), zero.alias("files"), none.alias("stops"), F.lit(False).alias("over")))
    frontier = state.select("repo", F.lit(0).alias("priority"), F.lit(0).alias("depth"), F.lit("").alias("path"))
    found = []
    for turn in range(limits["trees"] + 1):
        first = frontier.groupBy("repo").agg(F.min(F.struct("priority", "depth", "path")).alias("x"))
        live = checkpoint(state.where(~F.col("over")).join(first, "repo").select("repo", "entries", "files", F.col("x.depth").alias("depth"), F.col("x.path").alias("parent")))
        if live.isEmpty():
            break
        if turn == limits["trees"]:
            state = state.join(live.select("repo", F.lit("tree_budget").alias("_code")), "repo", "left").select("repo", "entries", "files", F.array_compact(F.array_append("stops", F.col("_code"))).alias("stops"), "over")
            break
        by_path = Window.partitionBy("repo").orderBy("path")
        met = rows.join(live, ["repo", "parent"]).withColumn("nth", F.row_number().over(by_path)).where(F.col("nth") <= limits["entries"] + 1)
        file_ = (~F.col("is_folder")).cast("long")
        met = met.where(F.col("nth") <= limits["entries"] - F.col("entries") + 1).withColumn("_files", F.sum(file_).over(by_path.rowsBetween(Window.unboundedPreceding, 0)))
        stop = F.when(F.col("nth") > limits["entries"] - F.col("entries"), "entry_budget").when(~F.col("is_folder") & (F.col("files") + F.col("_files") > limits["candidates"]), "candidate_budget")
        met = met.withColumn("stop", stop).withColumn("_end", F.min(F.when(F.col("stop").isNotNull(), F.col("nth"))).over(Window.partitionBy("repo")))
        done = F.col("_end").isNull() | (F.col("nth") < F.col("_end"))
        opens = F.col("is_folder") & ~F.col("skipped")
        met = checkpoint(met.withColumn("done", done).withColumn("deep", F.col("done") & opens & (F.col("depth") + 1 > limits["depth"])))
        found.append(met.where("done AND NOT is_folder").select("repo", "path", F.lit(turn).alias("turn"), "nth"))
        sums = met.groupBy("repo").agg(
            F.count_if("done").alias("_entries"), F.count_if(F.col("done") & ~F.col("is_folder")).alias("_files"), F.max("deep").alias("_deep"), F.min_by("stop", F.when(F.col("stop").isNotNull(), F.col("nth"))).alias("_code")
        )
        codes = F.concat("stops", F.array_compact(F.array(F.when(F.col("_deep") & ~F.array_contains("stops", "depth_limit"), "depth_limit"), F.col("_code"))))
        state = checkpoint(
            state.join(sums, "repo", "left").select(
                "repo", (F.col("entries") + F.coalesce("_entries", zero)).alias("entries"), (F.col("files") + F.coalesce("_files", zero)).alias("files"), F.coalesce(codes, "stops").alias("stops"), (F.col("over") | F.col("_code").isNotNull()).alias("over")
            )
        )
        rest = frontier.join(live.select("repo", F.col("parent").alias("path")), ["repo", "path"], "left_anti").select("repo", "priority", "depth", "path")
        more = met.where(F.col("done") & opens & ~F.col("deep")).select("repo", "priority", (F.col("depth") + 1).alias("depth"), "path")
        frontier = checkpoint(rest.unionByName(more))
    if not found:
        return rows.select("repo", "path", F.lit(0).cast("long").alias("place"), F.lit("").alias("stops")).limit(0)
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    place = F.row_number().over(Window.partitionBy("repo").orderBy("turn", "nth")).cast("long")
    return out.withColumn("place", place).join(state.select("repo", F.array_join("stops", ",").alias("stops")), "repo").select("repo", "path", "place", "stops")


def merge_bundles(first: DataFrame, more: DataFrame) -> DataFrame:
    """(bundle, items, bytes, digest, duplicates) of bundles of evidence with what was fetched later.

    Both: (bundle, path, bytes, sha256). Items are appended; a path that a bundle then has more than once is a duplicate, which makes it
    invalid. The digest is the sum of the first 60 bits of the items' hashes, so it depends on no order.
    """
    both = first.unionByName(more)
    part = F.conv(F.substring(F.sha2(F.concat("path", F.lit(":"), "sha256").cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    # By path first: what a path adds up to is one row.
    paths = both.groupBy("bundle", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sum(part).alias("part"))
    return paths.groupBy("bundle").agg(F.sum("n").alias("items"), F.sum("bytes").alias("bytes"), F.sum("part").cast("string").alias("digest"), F.count_if(F.col("n") > 1).alias("duplicates"))


def resolve_targets(cards: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, card_id, action) of each source (key, identity, url): update, create or conflict.

    A source matches by identity, by canonical url, or both; it is a conflict when several
    cards match or the two disagree.
    """
    by = lambda name: cards.groupBy(name).agg(F.min("id").alias("_id"), F.count(F.lit(1)).alias("_n")).where(F.col(name).isNotNull())
    i = by("identity").select(F.col("identity").alias("_i"), F.col("_id").alias("i_id"), F.col("_n").alias("i_n"))
    u = by("url").select(F.col("url").alias("_u"), F.col("_id").alias("u_id"), F.col("_n").alias("u_n"))
    joined = sources.join(i, F.col("identity") == F.col("_i"), "left").join(u, F.col("url") == F.col("_u"), "left")
    several = (F.coalesce("i_n", F.lit(0)) > 1) | (F.coalesce("u_n", F.lit(0)) > 1)
    differ = F.col("i_id").isNotNull() & F.col("u_id").isNotNull() & (F.col("i_id") != F.col("u_id"))
    found = F.coalesce("i_id", "u_id")
    action = F.when(several | differ, F.lit("conflict")).when(found.isNull(), F.lit("create")).otherwise(F.lit("update"))
    return joined.select("key", F.when(~(several | differ), found).alias("card_id"), action.alias("action"))


def upsert(cards: DataFrame, analysed: DataFrame, fields: list[str], today: str) -> DataFrame:
    """cards after an analysis: new ones, and old ones whose fields changed in substance.

    Both have (id, *fields, created_at, updated_at); updated_at moves only where a field differs,
    last_checked_at for everything that was analysed. Cards without analysis stay as they are.
    """
    o, n = cards.alias("o"), analysed.alias("n")
    known, seen = F.col("o.id").isNotNull(), F.col("n.id").isNotNull()
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}"))
    action = F.when(~known, F.lit("created")).when(~seen, F.lit("kept")).when(differs, F.lit("updated")).otherwise(F.lit("checked"))
    return o.join(n, F.col("o.id") == F.col("n.id"), "full_outer").select(
        F.coalesce("o.id", "n.id").alias("id"),
        *(F.when(seen, F.col(f"n.{f}")).otherwise(F.col(f"o.{f}")).alias(f) for f in fields),
        F.coalesce("o.created_at", F.lit(today)).alias("created_at"),
        F.when(known & (~seen | ~differs), F.col("o.updated_at")).otherwise(F.lit(today)).alias("updated_at"),
        action.alias("action"),
    )


def continuation(rows: DataFrame) -> DataFrame:
    """action, reason and what is left of each research plan's budgets.

    rows: open_questions, rounds, items, bytes (done) and max_rounds, max_items, max_bytes.
    """
    left = {x: F.greatest(F.lit(0).cast("long"), F.col(f"max_{x}") - F.col(x)) for x in ("rounds", "items", "bytes")}
    reason = (
        F.when(F.col("open_questions") == 0, F.lit("plan_complete"))
        .when(left["rounds"] == 0, F.lit("round_budget_exhausted"))
        .when(left["items"] == 0, F.lit("item_budget_exhausted"))
        .when(left["bytes"] == 0, F.lit("byte_budget_exhausted"))
        .otherwise(F.lit("needs_evidence"))
    )
    out = rows.withColumns({f"left_{k}": v for k, v in left.items()}).withColumn("reason", reason)
    return out.withColumns(
        {
            "action": F.when(F.col("reason") == "needs_evidence", F.lit("expand")).otherwise(F.lit("stop")),
            "next_round": F.when(F.col("reason") == "needs_evidence", F.col("rounds") + 1),
        }
    )

