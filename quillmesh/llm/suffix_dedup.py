"""Removal of passages that repeat anywhere in the corpus, by suffix arrays of shards.

A passage is a string of `window` bytes that starts in two places. Shards are made so
that equal windows meet: a window's key is the least hash of the `gram`-byte strings in it, which depends on
its bytes alone. Windows that follow each other and have the same key are one run of
bytes; a run's key that no other run has, and that occurs once in it, cannot hold a
repeat, so a bitmap of the keys that do occur again leaves most runs where they are. Equal runs are one class.

Buckets of equal keys are gathered to shards of about SHARD_BYTES. Of these only runs with a window whose first and last 64 bytes
another window of the shard has, too, can hold a repeat, and go on. A shard's suffix array is
made by Larsson-Sadakane refinement (only groups that are still unsorted are sorted again, by the
rank of what stands twice as far on), its common prefixes by Kasai's rule, all runs in step. A
window repeats if a neighbour in suffix order shares it. A bucket too large for a shard is dealt over
several, and each two of them are merged by binary search of the one's distinct windows in the
other's suffix array. Beyond MAX_TILES shards, windows of the bucket are counted by a digest of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialise, small_batches, small_side

WINDOW, GRAM = 400, 64
#: Windows that are hashed at once, windows of a run at most.
BLOCK, RUN_WINDOWS = 1 << 18, 1 << 12
#: Bytes of a shard, about, and shards of a bucket whose pairs are merged.
SHARD_BYTES, MAX_TILES = 2 << 20, 16
#: The largest bitmap of repeated keys (32 MB); beyond it more runs move in vain, with the same result.
MAX_BITS, BUCKET = 1 << 28, 32768
PLACE = np.uint64((1 << 20) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the `gram` bytes from each byte on, where there are so many; gram is a power of two and 8 at least."""
    n = len(data) - 7
    h = _mix(np.ndarray((n,), "<u8", data.tobytes(), 0, (1,)).astype(np.uint64)) if n > 0 else np.zeros(0, np.uint64)
    size = 8
    while size < gram:
        h = _mix(h[:-size] * np.uint64(0xD6E8FEB86659FD93) + h[size:]) if len(h) > size else h[:0]
        size *= 2
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, whole = 1, x
    while size * 2 <= width:
        whole = np.minimum(whole[:-size], whole[size:])
        size *= 2
    rest = width - size
    return np.minimum(whole[: len(whole) - rest], whole[rest:]) if rest else whole


def window_runs(data: np.ndarray, at: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of the windows of the texts data[at[k] : at[k + 1]]: text, begin, windows, key, and whether the key occurs twice in a run."""
    found: list[tuple[np.ndarray, ...]] = []
    grams, last = window - gram + 1, at[1:] - window
    for b in range(0, max(0, len(data) - window + 1), BLOCK):
        part = data[b : b + BLOCK + window - 1]
        h = gram_hashes(part, gram) & ~PLACE
        place = np.arange(len(h), dtype=np.uint64)
        low, high = _sliding_min(h | place, grams), _sliding_min(h | (PLACE - place), grams)
        key = low >> np.uint64(20)
        # The text that holds each window's begin; windows that reach over its end are none.
        text = np.repeat(np.arange(len(at) - 1), np.diff(np.clip(at, b, b + len(key))))
        good = np.arange(b, b + len(key)) <= last[text]
        change = np.flatnonzero((key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (good[1:] != good[:-1])) + 1
        begin = np.concatenate([[0], change])
        size = np.diff(np.append(begin, len(key)))
        keep = good[begin]
        begin, size = begin[keep], size[keep]
        # Long runs are cut.
        cuts = -(-size // RUN_WINDOWS)
        nth = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = np.repeat(begin, cuts) + nth * RUN_WINDOWS
        size = np.minimum(np.repeat(size, cuts) - nth * RUN_WINDOWS, RUN_WINDOWS)
        first, final = low[begin] & PLACE, PLACE - (high[begin + size - 1] & PLACE)
        found.append((text[begin], begin + b, size, key[begin], first != final))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))
    return tuple(np.concatenate(x) for x in zip(none, *found, strict=True))


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values in a row and where each begins, the last one's end included; null is empty."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    values = values.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    return data[at[0] : at[-1]], at - at[0]


# Suffix arrays of one shard


class Shard:
    """Runs data[at[k] : at[k + 1]], their suffix array, and the common prefix of each window with the suffix before it, up to `window`."""

    def __init__(self, data: np.ndarray, at: np.ndarray, window: int = WINDOW) -> None:
        self.at, self.window = at, window
        size = np.diff(at)
        self.end = np.repeat(at[1:], size)
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).tobytes()
        #: Eight bytes from each byte on, as numbers that sort like bytes.
        self.words = np.ndarray((len(data),), ">u8", padded, 0, (1,)).astype(np.uint64)
        self.order = self._sorted()
        self.rank = np.empty(len(data), np.int64)
        self.rank[self.order] = np.arange(len(data))
        self.shared = self._common_prefixes(size - window + 1)

    def _sorted(self) -> np.ndarray:
        n, end = len(self.words), self.end
        if not n:
            return np.zeros(0, np.int64)
        left = np.minimum(end - np.arange(n), 7).astype(np.uint64)
        # Seven bytes and how many of them there are: a suffix stands before those that it begins.
        key = (self.words >> np.uint64(8)) & ~((np.uint64(1) << (np.uint64(8) * (np.uint64(7) - left))) - np.uint64(1))
        key = (key << np.uint64(8)) | left
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        slots = np.flatnonzero(~(new & np.append(new[1:], True)))
        step, longest = 7, int(np.diff(self.at).max())
        while len(slots) and step < longest:
            at = order[slots]
            after = at + step
            second = np.where(after < end[at], rank[np.minimum(after, n - 1)] + 1, 0)
            both = rank[at] * (n + 1) + second
            way = np.argsort(both, kind="stable")
            at, both = at[way], both[way]
            order[slots] = at
            new = np.concatenate([[True], both[1:] != both[:-1]])
            rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            slots = slots[~(new & np.append(new[1:], True))]
            step *= 2
        # Suffixes that are equal to their ends stand by place, which Kasai's rule asks for.
        at = order[slots]
        order[slots] = at[np.lexsort((at, rank[at]))]
        return order

    def _common_prefixes(self, windows: np.ndarray) -> np.ndarray:
        """Kasai's rule over all runs in step: a suffix shares one byte less than the one that begins before it, at least."""
        shared = np.zeros(len(self.order) + 1, np.int64)
        runs = np.argsort(-windows, kind="stable")
        windows, begin = windows[runs], self.at[:-1][runs]
        known = np.zeros(len(runs), np.int64)
        active = np.searchsorted(-windows, -np.arange(int(windows[0]) if len(windows) else 0), side="left")
        for k, n in enumerate(active.tolist()):
            at = begin[:n] + k
            slot = self.rank[at]
            before = self.order[np.maximum(slot - 1, 0)]
            most = np.minimum(np.minimum(self.end[at] - at, self.end[before] - before), self.window)
            most[slot == 0] = 0
            known[:n] = self._extended(at, before, np.minimum(np.maximum(known[:n] - 1, 0), most), most)
            shared[slot] = known[:n]
        return shared

    def _extended(self, one: np.ndarray, two: np.ndarray, size: np.ndarray, most: np.ndarray) -> np.ndarray:
        rows = np.flatnonzero(size < most)
        while len(rows):
            differ = self.words[one[rows] + size[rows]] ^ self.words[two[rows] + size[rows]]
            # Equal bytes in front: those above the highest bit that differs.
            for shift in (1, 2, 4, 8, 16, 32):
                differ |= differ >> np.uint64(shift)
            same = (64 - np.bitwise_count(differ).astype(np.int64)) >> 3
            size[rows] = np.minimum(size[rows] + same, most[rows])
            rows = rows[(same == 8) & (size[rows] < most[rows])]
        return size

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Windows in suffix order, and for each the number of its group of equal ones."""
        at = self.order[self.order + self.window <= self.end[self.order]]
        return at, np.cumsum(self.shared[self.rank[at]] < self.window) - 1

    def repeated(self) -> np.ndarray:
        """Whether each byte begins a window that another byte of the shard begins, too."""
        full = self.shared >= self.window
        slots = np.flatnonzero(full[:-1] | full[1:])
        found = np.zeros(len(self.order), bool)
        found[self.order[slots]] = True
        return found

    def search(self, other: Shard) -> tuple[np.ndarray, np.ndarray]:
        """Whether each byte here, and there, begins a window that both shards have: binary search of distinct windows."""
        (mine, group), (theirs, other_group) = self.groups(), other.groups()
        here, there = np.zeros(len(self.order), bool), np.zeros(len(other.order), bool)
        if not len(mine) or not len(theirs):
            return here, there
        first = np.flatnonzero(np.diff(group, prepend=-1))
        ask = mine[first]
        low, high = np.zeros(len(ask), np.int64), np.full(len(ask), len(theirs))
        while (rows := np.flatnonzero(low < high)).size:
            middle = (low[rows] + high[rows]) >> 1
            less = self._compared(ask[rows], other, theirs[middle]) > 0
            low[rows] = np.where(less, middle + 1, low[rows])
            high[rows] = np.where(less, high[rows], middle)
        hit = np.flatnonzero(low < len(theirs))
        hit = hit[self._compared(ask[hit], other, theirs[low[hit]]) == 0]
        here[mine[np.isin(group, group[first[hit]])]] = True
        there[theirs[np.isin(other_group, other_group[low[hit]])]] = True
        return here, there

    def _compared(self, one: np.ndarray, other: Shard, two: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the window here is less than, equal to or greater than the one there."""
        found, rows = np.zeros(len(one), np.int8), np.arange(len(one))
        for k in range(0, self.window, 8):
            if not len(rows):
                break
            a, b = self.words[one[rows] + k], other.words[two[rows] + k]
            if k + 8 > self.window:
                cut = np.uint64(8 * (k + 8 - self.window))
                a, b = a >> cut, b >> cut
            apart = a != b
            found[rows[apart]] = np.where(a[apart] > b[apart], 1, -1)
            rows = rows[~apart]
        return found


def may_repeat(data: np.ndarray, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which runs data[at[k] : at[k + 1]] hold a window that begins and ends like another one of these runs; no other run holds a repeat."""
    gram = 1 << (min(GRAM, window).bit_length() - 1)
    size = np.maximum(np.diff(at) - window + 1, 0)
    run = np.repeat(np.arange(len(size)), size)
    begin = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size) + at[:-1][run]
    if not len(run):
        return np.zeros(0, np.int64)
    h = gram_hashes(data, gram)
    both = _mix(h[begin] + np.uint64(0xD6E8FEB86659FD93)) ^ h[begin + window - gram]
    order = np.argsort(both)
    same = both[order[1:]] == both[order[:-1]]
    again = np.append(same, False) | np.append(False, same)
    return np.unique(run[order[again]])


def _ranges(flags: np.ndarray, at: np.ndarray) -> list[list[dict]]:
    """Of each run data[at[k] : at[k + 1]] the ranges of bytes that are marked, from the run's begin on."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # The bytes after a run's last window are never marked, so no range reaches over runs.
    of = np.searchsorted(at, begin, side="right") - 1
    found: list[list[dict]] = [[] for _ in range(len(at) - 1)]
    for k, b, e in zip(of.tolist(), (begin - at[of]).tolist(), (end - at[of]).tolist(), strict=True):
        found[k].append({"begin": b, "end": e})
    return found


RANGES = "array<struct<begin: int, end: int>>"
_ARROW_RANGES = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int, weight: int, at_least: int) -> Iterator[pa.RecordBatch]:
    """Gather sorted rows to batches of whole groups (equal in the first `keys` columns) with `at_least` bytes in column `weight`, if there are so many."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(weight).nbytes
        if size < at_least:
            continue
        whole = pa.concat_batches(held)
        columns = [whole.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        other = np.flatnonzero(np.any([x != x[-1] for x in columns], axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield whole.slice(0, cut)
        held, size = [whole.slice(cut)], whole.slice(cut).column(weight).nbytes if cut else 0
    if held:
        yield pa.concat_batches(held)


def _result(classes: pa.Array, ranges: list[list[dict]]) -> pa.RecordBatch:
    some = np.array([bool(x) for x in ranges], bool)
    kept = [x for x in ranges if x]
    return pa.RecordBatch.from_arrays([classes.filter(pa.array(some)), pa.array(kept, _ARROW_RANGES)], names=["class", "ranges"])


def shard_repeats(classes: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, max_tiles: int = MAX_TILES) -> DataFrame:
    """(class, ranges): windows of the classes (key, class, twice, bytes) that another class of their key, or they themselves, have again."""
    sizes = classes.groupBy("key").agg(F.sum(F.length("bytes")).alias("size")).where(F.col("size") > shard_bytes)
    large = materialise(sizes.select("key", F.ceil(F.col("size") / shard_bytes).cast("int").alias("tiles")), "large-buckets")
    side = small_side(large)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, 1, 3, shard_bytes):
            key, twice = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            # A bucket of one class without its key again has no repeat.
            _, of, many = np.unique(key, return_inverse=True, return_counts=True)
            rows = np.flatnonzero((many[of] > 1) | twice)
            rows = rows[may_repeat(*_bytes_of(batch.column(3).take(pa.array(rows))), window)]
            if len(rows):
                batch = batch.take(pa.array(rows))
                data, at = _bytes_of(batch.column(3))
                yield _result(batch.column(1), _ranges(Shard(data, at, window).repeated(), at))

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, 3, 6, 1):
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            begins = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            for b, e in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows], strict=True):
                part = batch.slice(b, e - b)
                part = part.take(pa.array(may_repeat(*_bytes_of(part.column(6)), window)))
                if not part.num_rows:
                    continue
                sides = part.column(3).to_numpy()
                shards = []
                for one in (0, 1):
                    rows = np.flatnonzero(sides == one)
                    own = part.take(pa.array(rows))
                    data, at = _bytes_of(own.column(6))
                    if len(rows):
                        shards.append((own.column(4), at, Shard(data, at, window)))
                if keys[1, b] == keys[2, b]:
                    yield _result(shards[0][0], _ranges(shards[0][2].repeated(), shards[0][1]))
                elif len(shards) == 2:
                    for (names, at, _), flags in zip(shards, shards[0][2].search(shards[1][2]), strict=True):
                        yield _result(names, _ranges(flags, at))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                run = batch.column(1)[k].as_py()
                found = [hashlib.blake2b(run[x : x + window], digest_size=16).digest() for x in range(len(run) - window + 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(found), pa.int64())), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.binary())], names=["class", "begin", "digest"])

    names = ["key", "class", "twice", "bytes"]
    kind = f"class binary, ranges {RANGES}"
    few = classes.join(side, "key", "left_anti").select(*names).repartition("key").sortWithinPartitions("key", "class")
    found = few.mapInArrow(alone, kind)
    most = large.agg(F.max("tiles")).first()[0] or 0
    if not most:
        return found
    # Pairs of shards, each in a task of its own.
    some = classes.join(small_side(large.where(F.col("tiles") <= max_tiles)), "key")
    mine = F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, mine).alias("s"), F.greatest(t, mine).alias("t"), (t < mine).cast("int").alias("side")))
    dealt = some.select("key", "class", "twice", "bytes", F.inline(pairs)).select("key", "s", "t", "side", "class", "twice", "bytes").repartition("key", "s", "t").sortWithinPartitions("key", "s", "t", "side", "class")
    found = found.unionByName(dealt.mapInArrow(tiled, kind))
    if most > max_tiles:
        hot = classes.join(small_side(large.where(F.col("tiles") > max_tiles)), "key")
        each = materialise(hot.select("class", "bytes").mapInArrow(digests, "class binary, begin int, digest binary"), "window-digests")
        again = materialise(each.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-windows")
        marked = lookup(each, again.withColumn("again", F.lit(True)), "digest", "n").where("again")
        found = found.unionByName(marked.groupBy("class").agg(F.collect_list(F.struct("begin", (F.col("begin") + 1).alias("end"))).alias("ranges")))
    return found


def repeated_spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, max_tiles: int = MAX_TILES, max_bits: int = MAX_BITS) -> DataFrame:
    """(key, spans): ranges of bytes, which may overlap, of the texts (key, text) that a repeated string of `window` bytes covers.

    Rows of equal key and text have equal spans, which are given once; they are places of their own all the same. Texts
    without a repeat have no row.
    """
    spark = texts.sparkSession
    small_batches(spark)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, _, key, twice = window_runs(*_bytes_of(batch.column(0)), window, gram)
            key, of = np.unique(key, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(of, 1 + twice, len(key)).astype(np.int64) if len(key) else np.zeros(0, np.int64))], names=["key", "n"])

    whole = F.col("text").cast("binary").alias("text")
    counts = materialise(texts.select(whole).mapInArrow(keys, "key bigint, n bigint"), "run-keys")
    again = materialise(counts.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "repeated-keys")
    many, bits = again.count(), BUCKET
    while bits < min(max_bits, many * 16):
        bits *= 2
    place = F.pmod("key", F.lit(bits))
    rows = again.groupBy(F.floor(place / BUCKET).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("key", F.lit(BUCKET))).alias("bitmap")).collect()
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in rows:
        bitmap[r["bucket"] * BUCKET // 8 : (r["bucket"] + 1) * BUCKET // 8] = np.frombuffer(r["bitmap"], np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            data, at = _bytes_of(batch.column(1))
            text, begin, size, key, twice = window_runs(data, at, window, gram)
            spot = (key & np.uint64(bits - 1)).astype(np.int64)
            hit = np.flatnonzero((seen[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1)
            # In parts, as runs of repetitive texts hold them several times.
            for x in range(0, len(hit), 4_096):
                part = hit[x : x + 4_096]
                own = [data[b : b + n + window - 1].tobytes() for b, n in zip(begin[part].tolist(), size[part].tolist(), strict=True)]
                digest = [hashlib.blake2b(b, digest_size=16).digest() for b in own]
                columns = [batch.column(0).take(pa.array(text[part])), pa.array(begin[part] - at[text[part]]), pa.array(size[part].astype(np.int32)), pa.array(key[part].view(np.int64)), pa.array(digest, pa.binary()), pa.array(twice[part]), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["text_key", "start", "windows", "key", "class", "twice", "bytes"])

    schema = "text_key string, start bigint, windows int, key bigint, class binary, twice boolean, bytes binary"
    members = materialise(texts.select("key", whole).mapInArrow(runs, schema), "candidate-runs")
    classes = members.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"), F.first("windows").alias("windows"), F.first("bytes").alias("bytes"))
    classes = materialise(classes, "run-classes")
    found = shard_repeats(classes, window, shard_bytes, max_tiles).select("class", F.inline("ranges")).groupBy("class").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    # All windows of a class that stands in several places repeat.
    every = classes.where("n > 1").select("class", "n", F.array(F.struct(F.lit(0).alias("begin"), F.col("windows").alias("end"))).alias("ranges"))
    single = classes.where("n = 1").select("class", "n").join(found, "class")
    marked = materialise(every.unionByName(single), "repeated-classes")
    slim = members.select("text_key", "start", "class")
    near = lookup(slim, marked, "class", "n").select("text_key", "start", F.inline("ranges"))
    spans = near.select("text_key", (F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("end") + (window - 1)).alias("end")).distinct()
    return spans.groupBy(F.col("text_key").alias("key")).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def _kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
    removed, count, kept = [], [], []
    for text, ranges in zip(texts, spans.to_pylist(), strict=True):
        whole = text.as_py()
        ranges = sorted((r["begin"], r["end"]) for r in ranges or [])
        parts, at, n = [], 0, 0
        joined: list[list[int]] = []
        for b, e in ranges:
            if joined and b <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], e)
            else:
                joined.append([b, e])
        for b, e in joined:
            parts.append(whole[at:b])
            at, n = e, n + e - b
        kept.append(b"".join([*parts, whole[at:]]) if joined else whole)
        removed.append(n)
        count.append(len(joined))
    return pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], names=["n_removed", "n_spans", "kept"])


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """df with n_bytes, n_removed, n_spans (maximal removed ranges) and kept (binary: what is left); columns of these names are replaced.

    Each byte of the UTF-8 text that a string of `window` bytes covers is removed if the string starts anywhere else as well, in the
    same text or another. Null counts as empty; texts shorter than `window` stay whole. Rows alike in id and text
    are different places. An empty table gives no rows. Options are those of repeated_spans().
    """
    made = ("n_bytes", "n_removed", "n_spans", "kept")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.sha2(F.concat_ws(":", F.col(f"`{doc_id}`").cast("string"), F.sha2(whole.cast("binary"), 256)), 256)
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    spans = materialise(repeated_spans(df.select(key.alias("key"), whole.alias("text")), **options), "repeated-spans")
    # Spans of long texts are many, so their table is not marked for broadcasting.
    marked = df.select(key.alias("key"), row).join(spans, "key", "left")
    body = F.coalesce(F.col("_row")[text], F.lit("")).cast("binary")
    of = F.arrow_udf(_kept, "struct<n_removed: bigint, n_spans: bigint, kept: binary>")
    return marked.select("_row", F.octet_length(body).cast("bigint").alias("n_bytes"), of(body, F.col("spans")).alias("_k")).select(
        *(F.col("_row")[c].alias(c) for c in df.columns if c.lower() not in made), "n_bytes", "_k.n_removed", "_k.n_spans", "_k.kept"
    )
