"""SimHash near-duplicates by a Gray-ordered hierarchical index.

Fingerprints are computed from word shingles; equal ones are one row from there on. The index
holds every fingerprint in `TURNS` rotations, each of which puts another segment of the
bits in front: two fingerprints that differ in at most `distance` bits differ in at most
distance / TURNS bits of some segment, so each rotation only has to find pairs with so few
differences in front. A rotation's fingerprints are sorted by Gray rank, which puts like bit
patterns side by side, and cut into leaves of about NODE_ROWS. A leaf keeps the bits that
all its fingerprints share, FAN leaves make an upper node with the bits that they share, and so on.

From the top down, a pair of nodes is opened only while the differences in bits that both
share, in front and in all, stay within their limits; a whole group of pairs goes where they do
not. That is a join of the pair table with the nodes, level by level. Each leaf
is searched with the partners that are left to it by one task in the same way, down to single fingerprints.

What comes out of a task is a star for each component in it, not its pairs, so a group of
n fingerprints gives at most n links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lookup, materialise, small_batches, small_side

SHINGLE, DISTANCE = 4, 4
#: Rotations of the index; fingerprints of a leaf, about; nodes below a node.
TURNS, NODE_ROWS, FAN = 5, 1 << 13, 8
#: Node pairs that a task handles at once; rows that it gathers before it searches whole pairs of leaves.
AT_ONCE, LAST_AT_ONCE, GATHER_ROWS = 1 << 15, 1 << 12, 1 << 16
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles in blocks; see fingerprint()."""
    words = text.encode().lower().split() if text else []
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    n, digest = len(words) - k + 1, xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        a, b = begins[at : min(at + BLOCK, n)].tolist(), ends[at + k - 1 : min(at + BLOCK, n) + k - 1].tolist()
        yield np.fromiter((digest(joined[x:y], seed) for x, y in zip(a, b, strict=True)), np.uint64, len(a))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, unsigned.

    Words are what ASCII white space separates, A-Z in lower case. A text of fewer words
    than a shingle has one shingle of all of them; one without words has fingerprint 0.
    """
    return int(several_fingerprints(shingle_hashes(text, shingle, seed), 1)[0])


def several_fingerprints(hashes: Iterable[np.ndarray], count: int) -> np.ndarray:
    """`count` fingerprints of shingle hashes in blocks: the first of the hashes as they are, others of mixed ones."""
    n, ones = 0, np.zeros((count, 64), np.int64)
    for h in hashes:
        n += len(h)
        for k in range(count):
            ones[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64).ravel() if n else np.zeros(count, np.uint64)


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """Add `out`, the fingerprint of column `text` as a signed long. Null counts as empty."""

    small_batches(df.sparkSession)

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(x.as_py(), shingle) for x in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64), pa.int64())

    return df.withColumn(out, of(F.col(text)))


def gray_rank(fp: Column) -> Column:
    """The place of a bit pattern in the order of the Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def segments(turns: int = TURNS) -> list[tuple[int, int]]:
    """(bits before it, size) of each segment, from the highest bit on."""
    size = [64 // turns + (k < 64 % turns) for k in range(turns)]
    return [(sum(size[:k]), size[k]) for k in range(turns)]


def rotations(fp: Column, turns: int = TURNS) -> Column:
    """array<struct<turn, rot>>: fp with each segment in front."""
    turned = lambda n: F.shiftleft(fp, n).bitwiseOR(F.shiftrightunsigned(fp, 64 - n)) if n else fp
    return F.array(*(F.struct(F.lit(t).alias("turn"), turned(n).alias("rot")) for t, (n, _) in enumerate(segments(turns))))


def _front(turns: int) -> list[int]:
    """The mask of each rotation's front segment, as a signed long."""
    return [(((1 << size) - 1) << (64 - size)) - (1 << 64) for _, size in segments(turns)]


def gray_index(fps: DataFrame, turns: int = TURNS, node_rows: int = NODE_ROWS, kind: str | None = None) -> tuple[DataFrame, int]:
    """(turn, leaf, rot) of every fingerprint (column fp, distinct) in every rotation, and the number of leaves.

    Leaves are ranges of (turn, Gray rank), numbered in that order. kind: see search_links(); each kind has `turns` numbers of its own.
    """
    leaves = max(1, -(-fps.count() * turns // node_rows))
    turned = fps.select(F.inline(rotations(F.col("fp"), turns)), *([F.col(kind).alias("kind")] if kind else []))
    if kind:
        turned = turned.select((F.col("kind") * turns + F.col("turn")).cast("int").alias("turn"), "rot")
    # With the highest bit flipped, signed longs sort as unsigned ones.
    rank = gray_rank(F.col("rot")).bitwiseXOR(F.lit(-(1 << 63)))
    ranged = turned.withColumn("rank", rank).repartitionByRange(leaves, "turn", "rank")
    placed = materialise(ranged.select("turn", F.spark_partition_id().alias("leaf"), "rot"), "gray-index")
    return placed, placed.agg(F.coalesce(F.max("leaf"), F.lit(0))).first()[0] + 1


def open_leaves(index: DataFrame, leaves: int, distance: int = DISTANCE, turns: int = TURNS, report: list | None = None) -> DataFrame:
    """(turn, a, b): pairs of leaves, a <= b, that no node above and no shared bits of their own rule out.

    report, if given, gets (level, pairs met, pairs opened) of each level, from the top on.
    """
    widths = [1]
    while widths[-1] < leaves:
        widths.append(widths[-1] * FAN)
    shared = index.groupBy("turn", "leaf").agg(F.bit_and("rot").alias("all"), F.bit_or("rot").alias("some"))
    # Each leaf is below one node of every level, so that all levels are made at once.
    above = F.inline(F.array(*(F.struct(F.lit(k).alias("level"), F.expr(f"leaf div {width}").cast("int").alias("node")) for k, width in enumerate(widths))))
    kept = shared.select("turn", "all", "some", above).groupBy("level", "turn", "node").agg(F.bit_and("all").alias("all"), F.bit_or("some").alias("some"))
    levels = materialise(kept, "gray-nodes")
    pairs = levels.where(F.col("level") == len(widths) - 1).select("turn", F.col("node").alias("a"), F.col("node").alias("b"))
    front = F.array(*map(F.lit, _front(turns)))[F.col("turn") % turns]
    for number in range(len(widths) - 2, -1, -1):
        nodes = levels.where(F.col("level") == number).select("turn", "node", F.col("all").alias("pattern"), F.bitwise_not(F.col("all").bitwiseXOR(F.col("some"))).alias("mask"))
        side = lambda x, nodes=nodes: nodes.select("turn", *(F.col(c).alias(n) for c, n in (("node", x), ("pattern", f"p_{x}"), ("mask", f"m_{x}"))))
        below = lambda x: F.explode(F.sequence(F.col(x) * FAN, F.col(x) * FAN + FAN - 1))
        met = pairs.select("turn", below("a").alias("a"), "b").select("turn", "a", below("b").alias("b")).where("a <= b")
        met = met.join(side("a"), ["turn", "a"]).join(side("b"), ["turn", "b"])
        differ = F.col("p_a").bitwiseXOR(F.col("p_b")).bitwiseAND(F.col("m_a")).bitwiseAND(F.col("m_b"))
        near = (F.bit_count(differ) <= distance) & (F.bit_count(differ.bitwiseAND(front)) <= distance // turns)
        pairs = met.where(near).select("turn", "a", "b")
        if report is not None:
            report.append((number, met.count(), pairs.count()))
    return pairs


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class _Tree:
    """Levels of nodes over rows that are sorted by group and Gray rank; no node reaches over a group's end."""

    def __init__(self, begins: np.ndarray, fps: np.ndarray) -> None:
        #: Of each level: shared-bit mask, pattern, first child and the end of the children.
        self.levels = [(np.full(len(fps), ~np.uint64(0)), fps, None, None)]
        all_and, all_or = fps, fps
        while True:
            size = np.diff(np.append(begins, len(all_and)))
            nodes = -(-size // FAN)
            group = np.repeat(np.arange(len(begins)), nodes)
            nth = np.arange(len(group)) - np.repeat(np.cumsum(nodes) - nodes, nodes)
            first = begins[group] + nth * FAN
            until = np.minimum(first + FAN, (begins + size)[group])
            if len(first):
                all_and, all_or = np.bitwise_and.reduceat(all_and, first), np.bitwise_or.reduceat(all_or, first)
            mask = ~(all_and ^ all_or)
            self.levels.append((mask, all_and & mask, first, until))
            begins = np.cumsum(nodes) - nodes
            if not len(size) or nodes.max() <= FAN:
                self.top_begin, self.top_size = begins, nodes
                return

    def top_pairs(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of top nodes of the groups one[k] and two[k], and k; of a group with itself each pair once."""
        i, j = (x.ravel() for x in np.mgrid[:FAN, :FAN])
        inside = (i < self.top_size[one][:, None]) & (j < self.top_size[two][:, None]) & ((one != two)[:, None] | (i <= j))
        left, right = self.top_begin[one][:, None] + i, self.top_begin[two][:, None] + j
        return left[inside], right[inside], np.nonzero(inside)[0]


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all members of linked components the smallest label among them; label[x] is a member and at most x."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def components_of(begins: np.ndarray, one: np.ndarray, two: np.ndarray, fps: np.ndarray, distance: int = DISTANCE, front: np.ndarray | None = None, front_distance: int = DISTANCE, report: dict | None = None) -> np.ndarray:
    """The first row of each row's component, where group one[k] meets group two[k] for each k.

    Groups begin at the rows `begins` and are sorted by Gray rank. front[k]: bits of which at
    most front_distance may differ. report, if given, gets how many pairs of each level were met and opened.
    """
    label = np.arange(len(fps))
    if not len(fps) or not len(one):
        return label
    tree = _Tree(begins, fps)
    left, right, k = tree.top_pairs(one, two)
    front = np.zeros(len(one), np.uint64) if front is None else front
    zero = np.zeros(len(left), np.int64)
    stack = [(len(tree.levels) - 1, left, right, zero, zero, np.zeros(len(left), np.uint64), front[k])]
    while stack:
        level, *held = stack.pop()
        if len(held[0]) > AT_ONCE:
            stack.append((level, *(x[AT_ONCE:] for x in held)))
            held = [x[:AT_ONCE] for x in held]
        a, b, dist, ahead, seen, lead = held
        mask, pattern, first, until = tree.levels[level]
        # Only bits that no node above has compared are added.
        both = mask[a] & mask[b]
        differ = (pattern[a] ^ pattern[b]) & both & ~seen
        dist, ahead = dist + _bits(differ), ahead + _bits(differ & lead)
        near = (dist <= distance) & (ahead <= front_distance)
        if report is not None:
            met, opened = report.get(level, (0, 0))
            report[level] = met + len(a), opened + int(near.sum())
        a, b, dist, ahead, both, lead = (x[near] for x in (a, b, dist, ahead, both, lead))
        if not len(a):
            continue
        low, high = _spread(tree, level, label)
        apart = (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])
        a, b, dist, ahead, both, lead = (x[apart] for x in (a, b, dist, ahead, both, lead))
        if level == 1:
            for at in range(0, len(a), LAST_AT_ONCE):
                part = slice(at, at + LAST_AT_ONCE)
                x, y, met = _near_rows(fps, first, until, a[part], b[part], distance, lead[part], front_distance)
                _unite(label, x, y)
                if report is not None:
                    report[0] = report.get(0, (0, 0))[0] + met, report.get(0, (0, 0))[1] + len(x)
            continue
        i, j = (x.ravel() for x in np.mgrid[:FAN, :FAN])
        left, right = first[a][:, None] + i, first[b][:, None] + j
        good = (left < until[a][:, None]) & (right < until[b][:, None]) & ((a != b)[:, None] | (i <= j))
        row = np.nonzero(good)[0]
        stack.append((level - 1, left[good], right[good], dist[row], ahead[row], both[row], lead[row]))
    return label


def _near_rows(fps: np.ndarray, first: np.ndarray, until: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int, lead: np.ndarray, front_distance: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of the lowest nodes a[k] and b[k] that are near enough, and how many pairs of rows were compared."""
    place = np.arange(FAN)
    left, right = first[a][:, None] + place, first[b][:, None] + place
    inside = (left < until[a][:, None])[:, :, None] & (right < until[b][:, None])[:, None, :]
    inside &= (a != b)[:, None, None] | (place[:, None] < place[None, :])
    last = len(fps) - 1
    differ = fps[np.minimum(left, last)][:, :, None] ^ fps[np.minimum(right, last)][:, None, :]
    near = inside & (np.bitwise_count(differ) <= distance)
    k, i, j = np.nonzero(near)
    if front_distance < distance:
        ahead = np.bitwise_count(differ[k, i, j] & lead[k]) <= front_distance
        k, i, j = k[ahead], i[ahead], j[ahead]
    return left[k, i], right[k, j], int(inside.sum())


def _spread(tree: _Tree, level: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and largest label below each node of a level."""
    low = high = label
    for _, _, first, _ in tree.levels[1 : level + 1]:
        low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
    return low, high


def _search(block: np.ndarray, distance: int, turns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds and links between leaves and their partners; block: rows turn, a, leaf and rot of whole (turn, a), sorted by these, rot by Gray rank.

    Leaf a, the first of each (turn, a), meets itself and all others there. A component's centre is its least fingerprint.
    """
    begins = np.flatnonzero(np.concatenate([[True], (block[:3, 1:] != block[:3, :-1]).any(axis=0)]))
    turn, a, leaf = block[:3, begins]
    # A leaf's own part is the latest part before each that is its leaf's own.
    one = np.maximum.accumulate(np.where(leaf == a, np.arange(len(begins)), 0))
    front = np.array(_front(turns), np.int64).view(np.uint64)[turn % turns]
    rot = np.ascontiguousarray(block[3]).view(np.uint64)
    label = components_of(begins, one, np.arange(len(begins)), rot, distance, front, distance // turns)
    # Turned back, so that links are between fingerprints.
    back = np.array([n for n, _ in segments(turns)], np.uint64)[block[0] % turns]
    fps = ((rot >> back) | (rot << ((np.uint64(64) - back) & np.uint64(63)))).view(np.int64)
    child = np.flatnonzero(label != np.arange(len(label)))
    low = fps.copy()
    np.minimum.at(low, label[child], fps[child])
    member = np.union1d(child, label[child])
    centre = low[label[member]]
    apart = fps[member] != centre
    return (block[0, member] // turns)[apart], fps[member][apart], centre[apart]


def search_links(fps: DataFrame, distance: int = DISTANCE, turns: int = TURNS, node_rows: int = NODE_ROWS, kind: str | None = None) -> DataFrame:
    """(a, b): links that join all fingerprints (column fp, distinct) at most `distance` bits apart, and no others.

    A leaf meets all its partners in one task, so it moves once and its partners once each.
    kind: a column of small numbers from 0 on; fingerprints, distinct within a kind, link only with those of their kind, all
    kinds in one search, and the result is (kind, a, b).
    """
    index, leaves = gray_index(fps, turns, node_rows, kind)
    pairs = materialise(open_leaves(index, leaves, distance, turns), "leaf-pairs")
    names = ("turn", "a", "leaf")
    dealt = pairs.withColumnRenamed("b", "leaf").join(index, ["turn", "leaf"]).select(*names, "rot").repartition("turn", "a")
    met = dealt.withColumn("rank", gray_rank(F.col("rot")).bitwiseXOR(F.lit(-(1 << 63)))).sortWithinPartitions(*names, "rank")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def found(block: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(list(map(pa.array, _search(block, distance, turns))), names=["kind", "a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]))
            rows += batch.num_rows
            if rows < GATHER_ROWS:
                continue
            block = np.concatenate(held, axis=1)
            other = np.flatnonzero((block[:2] != block[:2, -1:]).any(axis=0))
            whole = int(other[-1]) + 1 if len(other) else 0
            if whole:
                yield found(block[:, :whole])
            held = [block[:, whole:]]
            rows = block.shape[1] - whole if whole else 0  # a long group is not tried again and again
        if held and (block := np.concatenate(held, axis=1)).shape[1]:
            yield found(block)

    found = met.select(*names, "rot").mapInArrow(search, "kind bigint, a bigint, b bigint")
    return found.withColumnRenamed("kind", kind) if kind else found.drop("kind")


def near_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, node_rows: int = NODE_ROWS) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of df.

    component_id is the smallest doc_id that links reach, its own included; links go
    between fingerprints at most `distance` bits apart. Null and empty texts have
    fingerprint 0 and are linked like others. A null id is never a component's unless all
    its ids are null. Rows with equal ids or texts each keep their row. Other columns of df
    are not read. An empty table gives no rows.
    """
    rows = materialise(
        fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text", "fp", shingle).drop("_text"),
        "fingerprints",
    )
    return lookup(rows, _named(rows, distance, node_rows).drop("component"), "fp", "n").select("doc_id", "fp", "component_id")


def _named(rows: DataFrame, distance: int, node_rows: int) -> DataFrame:
    """(fp, n, component, component_id) of each fingerprint in rows (doc_id, fp), n of them; component is the smallest fingerprint that links reach."""
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "fingerprint-classes")
    links = search_links(classes.select("fp"), distance, node_rows=node_rows)
    joined = connected_components(links, "a", "b")
    # Most fingerprints have no link and are their own component.
    linked = materialise(joined.join(classes, joined.node == classes.fp).select("fp", "component", "first"), "linked-fingerprints")
    least = materialise(linked.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("size")), "component-ids")
    linked = lookup(linked, least, "component", "size").select("fp", "component", "component_id")
    named = classes.join(linked, "fp", "left").select("fp", "n", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "first").alias("component_id"))
    return materialise(named, "named-fingerprints")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def numbered(df: DataFrame) -> DataFrame:
    """(_n, _row): df written once, each row packed and with a number of its own."""
    packed = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    return materialise(df.select(F.monotonically_increasing_id().alias("_n"), packed), "numbered-rows")


def keep_one(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Of numbered rows one of each component, that with the smallest id, null last.

    groups: (_n, doc_id, component), materialised; rows that are alone may be left out of it.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_n")
    first = groups.groupBy("component").agg(F.min(order).alias("x"), F.count(F.lit(1)).alias("size")).where("size > 1")
    first = materialise(first.select("component", F.col("x._n").alias("_stays"), "size"), "kept-rows")
    dropped = lookup(groups, first, "component", "size").where("_n != _stays").select("_n")
    return rows.join(small_side(materialise(dropped, "dropped-rows")), "_n", "left_anti").select("_row.*")


def drop_near(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, node_rows: int = NODE_ROWS) -> DataFrame:
    """df with one row of each component, the one with its smallest id; columns as before, whatever their names.

    Rows are told apart by a number of their own, so null and repeated ids are no harm: a
    null id comes last, and of rows that share the smallest id exactly one stays.
    """
    rows = numbered(df)
    read = rows.select("_n", F.col("_row")[doc_id].alias("doc_id"), F.col("_row")[text].alias("_text"))
    found = materialise(fingerprints(read, "_text", "fp", shingle).drop("_text"), "fingerprints")
    named = _named(found.select("doc_id", "fp"), distance, node_rows).drop("component_id")
    return keep_one(rows, materialise(lookup(found, named, "fp", "n"), "near-groups"))
