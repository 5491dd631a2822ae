"""Conversation structure repair by weighted finite-state composition.

Three machines are composed: an acceptor of a conversation's turns, a transducer of the
edits (keep, rerole, delete, insert), and an acceptor of the role sequences that are wanted.
No machine is built: the arcs that leave a pair of places are listed when a search comes
there. The composition has no useful cycle, so its shortest path is found in topological
order, from the end on, over weights (cost, labels) that are compared in that order:
putting a label in front of two label strings keeps their order, so the least string wins ties.

Where a grammar state and a label leave one next state only, no two paths between the same
states differ in a tail alone, so these weights can also be composed like matrices. That is how
conversations longer than a block are repaired: all turns are sorted and numbered, blocks of
BLOCK numbers give the weights between each two grammar states, and the few pieces of
conversations that reach over a block's end are composed FAN at a time up a tree; the
states that the best path goes through come down the tree by joins. No task holds a whole conversation, except
that its label string is one value and its hash is taken in one pass over sorted rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

#: Bits of turns in a block, bits of blocks (or groups of them) that are composed at once; weights of short turn sequences that a worker remembers.
BLOCK_BITS, FAN_BITS, REMEMBERED = 8, 6, 1 << 15
SPACE = " \t\n\x0b\x0c\r"
Weight = tuple[int, str]


@dataclass(frozen=True)
class Machine:
    """Edit costs and the grammar of role initials.

    arcs: (state, initial, next state); state 0 is the first. finals: states in which a conversation may end.
    insertable: roles that inserted and reroled turns may have. Deleting is the only edit of blank and duplicate turns.
    """

    arcs: tuple[tuple[int, str, int], ...] = ((0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2))
    finals: tuple[int, ...] = (0, 3)
    insertable: tuple[str, ...] = ("user", "assistant")
    keep: int = 0
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3

    def __post_init__(self) -> None:
        if len({x[:2] for x in self.arcs}) < len(self.arcs) or any(len(self.inserts(s)) > 1 for s in range(self.states)):
            raise ValueError("a label must leave one next state only")
        if self.insert <= 0:
            raise ValueError("inserting must cost something")

    @property
    def states(self) -> int:
        return 1 + max(x for a in self.arcs for x in (a[0], a[2]))

    def inserts(self, state: int) -> list[tuple[int, str]]:
        """(next state, role) of the turns that may be inserted in a state."""
        return [(then, role) for role in self.insertable for at, initial, then in self.arcs if at == state and role[:1] == initial]

    def edits(self, state: int, initial: str, fault: str) -> list[tuple[str, int, int, str | None]]:
        """(label, cost, next state, new role) of the edits of a turn in a state, listed as the composition comes there."""
        found: list[tuple[str, int, int, str | None]] = [("D", self.delete, state, None)]
        if fault in ("blank", "duplicate"):
            return found
        more = self.truncated if fault == "truncated" else 0
        found += [("K", self.keep + more, then, None) for at, x, then in self.arcs if at == state and x == initial]
        return found + [("R", self.rerole + more, then, role) for then, role in self.inserts(state)]


def _closed(machine: Machine, base: list[Weight | None]) -> list[Weight | None]:
    """base with turns inserted before it: a path through all states has no more than one insertion a state."""
    best = list(base)
    for _ in range(machine.states - 1):
        layer = list(best)
        for state in range(machine.states):
            for then, _role in machine.inserts(state):
                if (rest := best[then]) and (layer[state] is None or (machine.insert + rest[0], "I" + rest[1]) < layer[state]):
                    layer[state] = (machine.insert + rest[0], "I" + rest[1])
        best = layer
    return best


@lru_cache(maxsize=REMEMBERED)
def block_weights(machine: Machine, turns: tuple[tuple[str, str], ...]) -> tuple[tuple[Weight | None, ...], ...]:
    """The least weight from each grammar state to each, over turns (initial, fault); None where there is no path."""
    columns = []
    for last in range(machine.states):
        value = _closed(machine, [(0, "") if s == last else None for s in range(machine.states)])
        for initial, fault in reversed(turns):
            before: list[Weight | None] = []
            for state in range(machine.states):
                ways = [(cost + rest[0], label + rest[1]) for label, cost, then, _ in machine.edits(state, initial, fault) if (rest := value[then])]
                before.append(min(ways, default=None))
            value = _closed(machine, before)
        columns.append(value)
    return tuple(zip(*columns, strict=True))


def compose(first: list, second: list) -> list:
    """Weights over two pieces that follow each other."""
    n = len(first)
    return [[min(((a[0] + b[0], a[1] + b[1]) for m in range(n) if (a := first[i][m]) and (b := second[m][j])), default=None) for j in range(n)] for i in range(n)]


def states_between(pieces: list, entry: int, last: int) -> list[tuple[int, int]]:
    """(entry, last state) of each piece on the least path from entry to last."""
    n = len(pieces[0])
    rest = [[(0, "") if s == last else None for s in range(n)]]
    for piece in reversed(pieces):
        rest.append([min(((a[0] + b[0], a[1] + b[1]) for m in range(n) if (a := piece[i][m]) and (b := rest[-1][m])), default=None) for i in range(n)])
    rest.reverse()
    found = []
    for k, piece in enumerate(pieces):
        then = next(m for m in range(n) if (a := piece[entry][m]) and (b := rest[k + 1][m]) and (a[0] + b[0], a[1] + b[1]) == rest[k][entry])
        found.append((entry, then))
        entry = then
    return found


def apply_labels(machine: Machine, turns: list[tuple[int, str]], entry: int, labels: str) -> list[tuple[int, int, str, str | None]]:
    """(pos, nth, label, new role) of each label over turns (pos, initial); an inserted turn has the pos of the one after it, else of the last."""
    found, k, state = [], 0, entry
    for nth, label in enumerate(labels):
        pos, initial = turns[min(k, len(turns) - 1)]
        role = None
        if label in "IR":
            state, role = machine.inserts(state)[0]
        elif label == "K":
            state = next(then for at, x, then in machine.arcs if at == state and x == initial)
        found.append((pos, nth, label, role))
        k += label != "I"
    return found


def illegal(pairs: Iterator[tuple[str, str]], legal: frozenset = frozenset({("s", "u"), ("u", "a"), ("a", "u")})) -> int:
    return sum(x not in legal for x in pairs)


def _key(conv: Column) -> Column:
    """Conversations are told apart by this string; a null id is a conversation of its own."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("-"))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(_conv, pos, turn, role, text): turns (conv_id, turn, role, text) sorted and numbered from 0 without gaps.

    Null roles and texts are one space. A conversation's turns are sorted by turn (nulls first), role, the
    first 64 characters of the text, and the text's SHA-256; rows alike in all are interchangeable. Equal rows are dealt over tasks.
    """
    text = F.coalesce("text", F.lit(" "))
    named = turns.select(
        _key(F.col("conv_id")).alias("_conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.substring(text, 1, 64).alias("_head"), F.sha2(text.cast("binary"), 256).alias("_sha"), F.monotonically_increasing_id().alias("_tie")
    )
    order = ["_conv", "turn", "role", "_head", "_sha", "_tie"]
    placed = named.repartitionByRange(*order).sortWithinPartitions(*order).select("_conv", "turn", "role", "text", F.monotonically_increasing_id().alias("_n"))
    placed = materialise(placed.withColumn("_part", F.shiftright("_n", 33)), "sorted-turns")
    # A row a partition: where its numbers begin.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    begins = sizes.select("_part", (F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_begin"))
    return placed.join(F.broadcast(begins), "_part").select("_conv", (F.col("_begin") + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))).alias("pos"), "turn", "role", "text")


def turn_faults(turns: DataFrame) -> DataFrame:
    """(_conv, pos, turn, initial, fault) of numbered turns; fault: blank, duplicate, truncated or none, the first that holds.

    Blank: nothing but ASCII white space. Duplicate: role and text are those of an earlier turn. Truncated:
    the last character that is no white space is none of `.!?`.
    """
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    slim = turns.select("_conv", "pos", "turn", F.substring("role", 1, 1).alias("initial"), (end == "").alias("_blank"), F.substring(end, -1, 1).isin(".", "!", "?").alias("_ended"), same.alias("_same"))
    first = slim.groupBy("_conv", "_same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_first"))
    fault = F.when(F.col("_blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(~F.col("_ended"), "truncated").otherwise("none")
    return slim.join(first, "pos", "left").select("_conv", "pos", "turn", "initial", fault.alias("fault"))


WEIGHTS = "array<array<struct<cost: bigint, labels: string>>>"


def _rows(weights: list) -> list:
    return [[x and (x["cost"], x["labels"]) for x in row] for row in weights]


def _named(weights) -> list:
    return [[x and {"cost": x[0], "labels": x[1]} for x in row] for row in weights]


_ARROW_WEIGHTS = pa.list_(pa.list_(pa.struct([("cost", pa.int64()), ("labels", pa.string())])))


def _weigh(machine: Machine):
    @F.arrow_udf(f"struct<weights: {WEIGHTS}, illegal: bigint>")
    def weigh(blocks: pa.Array) -> pa.Array:
        weights, bad = [], []
        for turns in blocks.to_pylist():
            seen = tuple((t["initial"], t["fault"]) for t in turns)
            weights.append(_named(block_weights(machine, seen)))
            bad.append(illegal(zip((x for x, _ in seen), (x for x, _ in seen[1:]))))
        return pa.StructArray.from_arrays([pa.array(weights, _ARROW_WEIGHTS), pa.array(bad, pa.int64())], names=["weights", "illegal"])

    return weigh


def _together(groups: pa.Array) -> pa.Array:
    weights, bad = [], []
    for parts in groups.to_pylist():
        whole = _rows(parts[0]["weights"])
        for part in parts[1:]:
            whole = compose(whole, _rows(part["weights"]))
        weights.append(_named(whole))
        bad.append(sum(p["illegal"] for p in parts) + illegal((a["last"], b["first"]) for a, b in zip(parts, parts[1:])))
    return pa.StructArray.from_arrays([pa.array(weights, _ARROW_WEIGHTS), pa.array(bad, pa.int64())], names=["weights", "illegal"])


def _descend(groups: pa.Array, entries: pa.Array, lasts: pa.Array) -> pa.Array:
    found = []
    for parts, entry, last in zip(groups.to_pylist(), entries.to_pylist(), lasts.to_pylist(), strict=True):
        states = states_between([_rows(p["weights"]) for p in parts], entry, last)
        found.append([{"node": p["node"], "entry": a, "last": b} for p, (a, b) in zip(parts, states, strict=True)])
    return pa.array(found, pa.list_(pa.struct([("node", pa.int64()), ("entry", pa.int32()), ("last", pa.int32())])))


def _edits(machine: Machine):
    @F.arrow_udf("array<struct<pos: bigint, nth: int, label: string, new_role: string>>")
    def edits(blocks: pa.Array, entries: pa.Array, labels: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("pos", pa.int64()), ("nth", pa.int32()), ("label", pa.string()), ("new_role", pa.string())]))
        found = [
            [dict(zip(("pos", "nth", "label", "new_role"), x)) for x in apply_labels(machine, [(t["pos"], t["initial"]) for t in turns], entry, label)]
            for turns, entry, label in zip(blocks.to_pylist(), entries.to_pylist(), labels.to_pylist(), strict=True)
        ]
        return pa.array(found, kind)

    return edits


def shortest_repairs(faults: DataFrame, machine: Machine = Machine(), block_bits: int = BLOCK_BITS, fan_bits: int = FAN_BITS) -> tuple[DataFrame, DataFrame]:
    """Of turns with faults: (_conv, cost, audit, illegal) of each conversation, and (_conv, pos, nth, label, new_role) of each edit."""
    turn = F.struct("pos", "initial", "fault")
    blocks = faults.groupBy("_conv", F.shiftright("pos", block_bits).alias("node")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    blocks = materialise(blocks.withColumn("_w", _weigh(machine)("turns")).select("_conv", "node", "turns", "_w.*"), "turn-blocks")
    at = lambda k: F.element_at("turns", k)
    nodes = blocks.select("_conv", "node", "weights", "illegal", at(1)["pos"].alias("low"), at(-1)["pos"].alias("high"), at(1)["initial"].alias("first"), at(-1)["initial"].alias("last"))
    top = faults.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0] >> block_bits
    start = F.lit(0)
    ways = F.array_compact(F.array(*(F.when(F.col("weights")[0][s].isNotNull(), F.struct(F.col("weights")[0][s]["cost"].alias("cost"), F.col("weights")[0][s]["labels"].alias("labels"), F.lit(s).alias("last"))) for s in machine.finals)))
    best = F.array_min(ways)
    closed, trees, bits = [], [], block_bits
    while True:
        size = F.lit(1 << bits)
        # Turns are sorted, so what touches neither end of its block is a whole conversation.
        reaches = (F.col("low") % size == 0) | (F.col("high") % size == size - 1) if top else F.lit(False)
        closed.append(nodes.where(~reaches).select("_conv", "node", best.alias("best"), "illegal"))
        if not top:
            break
        part = F.struct("node", "weights", "illegal", "first", "last", "low", "high")
        grown = nodes.where(reaches).groupBy("_conv", F.shiftright("node", fan_bits).alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", part.alias("x")))).alias("parts"))
        grown = grown.withColumn("parts", F.transform("parts", lambda p: p["x"])).withColumn("_w", F.arrow_udf(_together, f"struct<weights: {WEIGHTS}, illegal: bigint>")("parts"))
        end = lambda k: F.element_at("parts", k)
        trees.append(materialise(grown.select("_conv", "node", "_w.*", "parts", end(1)["low"].alias("low"), end(-1)["high"].alias("high"), end(1)["first"].alias("first"), end(-1)["last"].alias("last")), "turn-tree"))
        nodes, top, bits = trees[-1].drop("parts"), top >> fan_bits, bits + fan_bits
    chosen = lambda df: df.select("_conv", "node", start.alias("entry"), F.col("best.last").alias("last"))
    descend = F.arrow_udf(_descend, "array<struct<node: bigint, entry: int, last: int>>")
    paths = chosen(closed[-1])
    for level in range(len(trees) - 1, -1, -1):
        met = trees[level].select("_conv", "node", "parts").join(paths, ["_conv", "node"])
        below = met.select("_conv", F.inline(descend("parts", "entry", "last")))
        paths = chosen(closed[level]).unionByName(below)
    paths = blocks.select("_conv", "node", "turns", "weights").join(paths, ["_conv", "node"])
    edits = paths.select("_conv", F.inline(_edits(machine)("turns", "entry", F.expr("weights[entry][last].labels"))))
    found = closed[0]
    for more in closed[1:]:
        found = found.unionByName(more)
    return found.select("_conv", F.col("best.cost").alias("cost"), F.col("best.labels").alias("audit"), "illegal"), edits


def repaired_turns(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """(_conv, pos, nth, role, text) of the repaired conversations, to be sorted by the first three."""
    stay = edits.where("label in ('K', 'R')").select("pos", "nth", "new_role")
    kept = turns.join(stay, "pos").select("_conv", "pos", "nth", F.coalesce("new_role", "role").alias("role"), "text")
    made = edits.where("label = 'I'").select("_conv", "pos", "nth", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return kept.unionByName(made)


def conversation_hashes(repaired: DataFrame) -> DataFrame:
    """(_conv, repaired_sha256): SHA-256 of a conversation's `role:text`, joined by line feeds; lines pass one after another and none is kept."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if conv == name:
                    digest.update(b"\n")
                else:
                    if name is not None:
                        done.append((name, digest.hexdigest()))
                    name, digest = conv, hashlib.sha256()
                digest.update(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], names=["_conv", "repaired_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digest.hexdigest()])], names=["_conv", "repaired_sha256"])

    lines = repaired.repartition("_conv").sortWithinPartitions("_conv", "pos", "nth")
    return lines.select("_conv", F.concat("role", F.lit(":"), "text").alias("line")).mapInArrow(hashes, "_conv string, repaired_sha256 string")


def damage(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): turns damaged by the CRC-32 of `conv_id:turn`, nulls being one space, modulo 20.

    0 drops a turn, 1 empties its text, 2 removes its `.`, `!` and `?`, 3 repeats it, 4 makes it the user's.
    """
    space = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    return df.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def repair(df: DataFrame, machine: Machine = Machine(), block_bits: int = BLOCK_BITS, fan_bits: int = FAN_BITS) -> tuple[DataFrame, DataFrame]:
    """Summaries and repaired turns of conversations (conv_id, turn, role, text); other columns are not read.

    Summaries: (_conv, gaps, blank, duplicate, truncated, illegal, cost, audit), a row for each conversation that has a turn.
    gaps: turn numbers missing between the least and the largest; illegal: neighbouring turns whose role initials are not su, ua or au; audit: the
    cheapest edits' initials in order, of equally cheap ones the least string. Repaired turns: see repaired_turns(); a
    conversation of which nothing is left has none. A null conv_id is one conversation. Order and nulls: see
    numbered_turns(). An empty table gives no rows.
    """
    small_batches(df.sparkSession)
    turns = numbered_turns(df.select("conv_id", "turn", "role", "text"))
    faults = materialise(turn_faults(turns), "turn-faults")
    audits, edits = shortest_repairs(faults, machine, block_bits, fan_bits)
    many = lambda x: F.count(F.when(F.col("fault") == x, 1)).alias(x)
    distinct = faults.groupBy("_conv", "turn").agg(F.lit(1).alias("x")).groupBy("_conv").agg(F.max("turn").alias("most"), F.min("turn").alias("least"), F.count("turn").alias("n"))
    gaps = distinct.select("_conv", F.coalesce(F.col("most") - F.col("least") + 1 - F.col("n"), F.lit(0)).cast("bigint").alias("gaps"))
    counts = faults.groupBy("_conv").agg(many("blank"), many("duplicate"), many("truncated"))
    return gaps.join(counts, "_conv").join(audits, "_conv"), repaired_turns(turns, edits)


def audit_conversations(df: DataFrame, original: DataFrame, machine: Machine = Machine(), block_bits: int = BLOCK_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conv_id of `original`.

    A conversation without a turn in df has zeros, an empty audit and the hash of an empty string.
    """
    summaries, repaired = repair(df, machine, block_bits, fan_bits)
    every = original.select("conv_id").distinct().withColumn("_conv", _key(F.col("conv_id")))
    none = lambda x: F.coalesce(x, F.lit(0)).cast("bigint").alias(x)
    found = every.join(summaries, "_conv", "left").join(conversation_hashes(repaired), "_conv", "left")
    return found.select(
        "conv_id", *(none(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    )
