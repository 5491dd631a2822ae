"""URL rules judged by a cascade of Bloom filters.

A rule is a host and the beginning of a path. A url's possible keys are every suffix of its
host, by labels, with every beginning of its path that is as long as some rule's. The
complete set of the corpus's keys is what the cascade is made for: level 0 encodes the
listed keys, level 1 the unlisted keys of the corpus that level 0 lets through, level 2
the listed keys that level 1 lets through, and so on until nothing is let through
wrongly. For keys of that corpus, membership is then exact and takes neither a join nor
the list itself: an expression over a few bitmaps, whose size depends on the list and,
by its logarithm, on the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

BUCKET = 32768
#: The most bits of one level, 16 MB: a longer list's levels are fuller, so more of them follow.
MAX_BITS = 1 << 27
#: So many keys of a level, or fewer, are listed in the plan.
FEW_KEYS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains where the url's path starts with `path`."""

    action: str
    host: str
    path: str = ""

    @property
    def key(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to "?", "#" or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys that rules could have for a url, longest first; of equal length the longer host first."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths)]
    keys = F.flatten(F.transform(suffixes, lambda s: F.array(*(F.struct((-F.length(s) - F.length(p)).alias("n"), (-F.length(s)).alias("h"), F.concat(s, p).alias("key")) for p in starts))))
    return F.transform(F.array_sort(F.filter(keys, lambda k: k.key.isNotNull())), lambda k: k.key)


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 64 + k)), F.lit(bits)) for k in range(hashes)]


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    bitmap: bytes

    def holds(self, key: Column, number: int) -> Column:
        def all_bits(bitmap: Column) -> Column:
            hit = F.lit(True)
            for at in _positions(key, number, self.bits, self.hashes):
                octet = F.substring(bitmap, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))
                hit = hit & (F.getbit(F.conv(F.hex(octet), 16, 10).cast("int"), (at % 8).cast("int")) == 1)
            return hit

        # The plan holds the bitmap once, whatever the number of hashes.
        return F.exists(F.array(F.lit(self.bitmap)), all_bits)


@dataclass(frozen=True)
class Rest:
    """The last few keys, as they are."""

    keys: tuple[str, ...]

    def holds(self, key: Column, number: int) -> Column:
        return key.isin(list(self.keys))


def _level(keys: DataFrame, count: int, rate: float, number: int) -> Level:
    """A Bloom filter of column `key`, made by Spark's bitmap aggregates; at most max bits come to the driver."""
    hashes = max(1, min(8, ceil(-log2(rate))))
    bits = min(MAX_BITS, max(64, 8 * ceil(count * -log(rate) / log(2) ** 2 / 8)))
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), number, bits, hashes))).alias("at"))
    parts = at.groupBy(F.expr(f"at div {BUCKET}").alias("bucket")).agg(F.expr(f"bitmap_construct_agg(at % {BUCKET})").alias("bitmap"))
    bitmap = bytearray(ceil(bits / 8))
    for bucket, part in parts.collect():
        at0 = bucket * BUCKET // 8
        bitmap[at0 : at0 + len(part)] = part[: len(bitmap) - at0]
    return Level(bits, hashes, bytes(bitmap))


class Cascade:
    """Exact membership in a list for the keys of one corpus."""

    def __init__(self, levels: list[Level | Rest]) -> None:
        self.levels = levels

    def holds(self, key: Column) -> Column:
        """The last level that lets a key through tells: even ones hold listed keys."""
        found = F.lit(len(self.levels) % 2 == 1)
        for number in reversed(range(len(self.levels))):
            found = F.when(self.levels[number].holds(key, number), found).otherwise(F.lit(number % 2 == 1))
        return found


def build_cascade(listed: DataFrame, universe: DataFrame, universe_keys: int, few: int = FEW_KEYS) -> Cascade:
    """listed, universe: column `key`, repeats allowed; universe_keys: about how many.

    The corpus is read once. What level 0 lets through is as many keys as are listed, or
    so; later levels read only that.
    """
    inside = materialise(listed.select("key").distinct(), "listed-keys")
    n = inside.count()
    if not n:
        return Cascade([])
    first = _level(inside, n, min(0.5, max(n / max(universe_keys, 1), 1e-9)), 0)
    passed = universe.select("key").where(first.holds(F.col("key"), 0)).distinct()
    outside = materialise(passed.join(inside, "key", "left_anti"), "false-keys")
    levels, now, other = [first], outside, inside
    while count := now.count():
        number = len(levels)
        if count <= few:
            levels.append(Rest(tuple(sorted(r[0] for r in now.collect()))))
            break
        level = _level(now, count, 0.5, number)
        levels.append(level)
        now, other = materialise(other.where(level.holds(F.col("key"), number)), "false-keys"), now
    return Cascade(levels)


def judge_urls(df: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """df with host, path, rule and verdict.

    The longest rule that fits decides; of equally long ones that with the longer host, then
    `block`. Without a fitting rule `rule` is null and the verdict is `allow`: the cascade
    tells that no key of the url is listed. A null url, or one without "://", has an empty
    host and path. Columns of these names in df are replaced; others pass through.
    """
    spark = df.sparkSession
    parsed = df.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    lengths = sorted({len(r.path) for r in rules}) or [0]
    keys = df.select(url_host(F.col(url)).alias("h"), url_path(F.col(url)).alias("p")).select(
        F.explode(candidate_keys(F.col("h"), F.col("p"), lengths)).alias("key")
    )
    some = df.count() * len(lengths) * 4
    by = {action: _listed(spark, [r.key for r in rules if r.action == action]) for action in ("block", "allow")}
    cascades = {action: build_cascade(listed, keys, some) for action, listed in by.items()}
    own = candidate_keys(F.col("host"), F.col("path"), lengths)
    best = {a: F.get(F.filter(own, c.holds), F.lit(0)) for a, c in cascades.items()}
    # Positions in the ordered list tell which of the two is longer.
    judged = parsed.withColumns({"_own": own}).withColumns({f"_{a}": b for a, b in best.items()})
    rank = {a: F.when(F.col(f"_{a}").isNotNull(), F.array_position("_own", F.col(f"_{a}"))).otherwise(F.lit(1 << 30)) for a in best}
    blocked = F.col("_block").isNotNull() & (rank["block"] <= rank["allow"])
    return judged.withColumns(
        {
            "rule": F.when(blocked, F.col("_block")).otherwise(F.col("_allow")),
            "verdict": F.when(blocked, F.lit("block")).otherwise(F.lit("allow")),
        }
    ).drop("_own", "_block", "_allow")


def _listed(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "key string")
