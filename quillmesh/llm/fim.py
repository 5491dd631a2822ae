"""Fill-in-the-middle transformation by a parallel automaton scan.

A finite automaton reads a text's UTF-8 bytes and counts the units that end; for the
default one these are lines. No byte has to wait for those before it: texts are cut into
chunks, all chunks are read in step, each from every state at once, and give the state
they end in and the units they count for each state they may be entered in. Such
summaries compose associatively, which tells the state a chunk is really entered in and
how many units end before it; a cut after u units is then looked for only in the chunk
that holds it.

A text of up to `giant` characters is composed where it is read. Longer ones, and texts
that are stored in pieces because no value could hold them, become rows of chunks that
are dealt over tasks. Their summaries are composed FAN at a time to a tree, and the cuts go
down that tree by joins, level by level: no task holds more than one chunk, or FAN summaries.

Everything after the cuts is column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, small_side

#: Bytes that are read in step; characters of a row of chunks, and of a text that is not yet cut into such rows.
STEP_BYTES, CHUNK_CHARS, GIANT_CHARS = 2048, 1 << 16, 1 << 16
#: Summaries that are composed at once.
FAN = 128


@dataclass(frozen=True)
class Automaton:
    """next[state][byte] and ends[state][byte], the units (0 or 1) that this byte ends; state 0 is the first.

    open_end[state]: 1 where a text that ends in this state ends a unit.
    """

    next: np.ndarray = field(repr=False)
    ends: np.ndarray = field(repr=False)
    open_end: tuple[int, ...]

    @property
    def states(self) -> int:
        return len(self.open_end)


def line_automaton() -> Automaton:
    """Units are lines with their line feed, and what is left after the last one."""
    after = np.ones((2, 256), np.uint8)
    after[:, 10] = 0
    ends = np.zeros((2, 256), np.uint8)
    ends[:, 10] = 1
    return Automaton(after, ends, (0, 1))


@dataclass(frozen=True)
class Format:
    """Marks of prefix, suffix and middle; percent of texts that are transformed, and of these in suffix-prefix-middle order."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    percent: int = 100
    spm_percent: int = 50
    seed: int = 7

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        meets = lambda a, b: a != b and b in a or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b) + (a != b))))
        # Else a mark could be found where none was put.
        if len(set(marks)) < 3 or not all(marks) or any(meets(a, b) for a in marks for b in marks):
            raise ValueError(f"marks are empty, alike or overlap: {marks}")


def _in_step(data: np.ndarray, begin: np.ndarray, size: np.ndarray, auto: Automaton, state: np.ndarray, want: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Read chunks data[begin : begin + size] in step, row by row of state (n chunks x entry states).

    Returns the states they end in, the units counted, and, where want is given, how many bytes are read until so many units have ended.
    """
    order = np.argsort(-size, kind="stable")
    begin, size, state = begin[order], size[order], state[order].astype(np.int64)
    count, at = np.zeros(state.shape, np.int64), np.zeros(state.shape, np.int64)
    want = None if want is None else want[order]
    after, ends = auto.next.ravel(), auto.ends.ravel()
    # Chunks still being read are the first ones, as the longest come first.
    active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    for k, n in enumerate(active.tolist()):
        index = (state[:n] << 8) | data[begin[:n] + k][:, None]
        count[:n] += ends[index]
        if want is not None:
            hit = (count[:n] == want[:n]) & (at[:n] == 0)
            at[:n][hit] = k + 1
        state[:n] = after[index]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return state[back], count[back], at[back]


def chunk_summaries(data: np.ndarray, begin: np.ndarray, size: np.ndarray, auto: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """(end state, units) of each chunk, a column for each entry state."""
    every = np.tile(np.arange(auto.states), (len(begin), 1))
    return _in_step(data, begin, size, auto, every)[:2]


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and where each begins, the last one's end included."""
    texts = texts.cast(pa.large_string()).fill_null("") if len(texts) else pa.array([], pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def scan_texts(data: np.ndarray, at: np.ndarray, auto: Automaton) -> tuple[np.ndarray, ...]:
    """Chunks of the texts at data[at[k] : at[k + 1]]: their begin, size, entry state, units before them; and the units of each text."""
    size = np.diff(at)
    chunks = -(-size // STEP_BYTES)
    of = np.repeat(np.arange(len(size)), chunks)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = at[:-1][of] + nth * STEP_BYTES
    sizes = np.minimum(STEP_BYTES, at[1:][of] - begin)
    ends, counts = chunk_summaries(data, begin, sizes, auto)
    entry, before = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    last, total = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    first = np.cumsum(chunks) - chunks
    for k in range(int(chunks.max()) if len(chunks) else 0):
        row = np.flatnonzero(chunks > k)
        x = first[row] + k
        entry[x], before[x] = last[row], total[row]
        total[row] += counts[x, last[row]]
        last[row] = ends[x, last[row]]
    return of, begin, sizes, entry, before, total + np.array(auto.open_end)[last]


def find_cuts(data: np.ndarray, at: np.ndarray, scan: tuple[np.ndarray, ...], units: np.ndarray, auto: Automaton) -> np.ndarray:
    """Bytes of each text before the end of its units[k]-th unit; all of them where no byte ends it."""
    of, begin, sizes, entry, before, _ = scan
    found = np.where(units > 0, np.diff(at), 0)
    # The chunk in which it ends is the last one with fewer units before it.
    holds = np.flatnonzero(before < units[of])
    text, last = np.unique(of[holds][::-1], return_index=True)
    chunk = holds[::-1][last]
    _, count, place = _in_step(data, begin[chunk], sizes[chunk], auto, entry[chunk][:, None], (units[text] - before[chunk])[:, None])
    ended = place[:, 0] > 0
    found[text[ended]] = (begin[chunk] - at[:-1][text] + place[:, 0])[ended]
    return found


def _characters(data: np.ndarray) -> np.ndarray:
    """How many characters begin before each byte, and in all."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def _cuts_udf(auto: Automaton):
    @F.arrow_udf("struct<n: bigint, first: bigint, second: bigint>")
    def cuts(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        data, at = _cut(texts)
        scan = scan_texts(data, at, auto)
        n, chars = scan[-1], _characters(data)
        a, b = (x.to_numpy(zero_copy_only=False) % (n + 1) for x in (one, two))
        cut = [chars[at[:-1] + find_cuts(data, at, scan, u, auto)] - chars[at[:-1]] for u in (np.minimum(a, b), np.maximum(a, b))]
        return pa.StructArray.from_arrays([pa.array(x) for x in (n, *cut)], names=["n", "first", "second"])

    return cuts


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 of an id: groups of eight digits of the SHA-256 of `seed:id`; a null id is an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def split_chunks(df: DataFrame, key: str, text: str, chars: int = CHUNK_CHARS) -> DataFrame:
    """(key, at, chunk): each text as rows of `chars` characters, numbered from 0."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                whole = batch.column(1)[k].as_py()
                for at, x in enumerate(range(0, len(whole), chars)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([at], pa.int64()), pa.array([whole[x : x + chars]])], names=[key, "at", "chunk"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(split, f"`{key}` {kind}, at bigint, chunk string")


def _compose(parts: Column, states: int) -> tuple[Column, Column]:
    """(end states, units) of summaries that follow each other, for each entry state."""
    zero = F.struct(F.sequence(F.lit(0), F.lit(states - 1)).alias("ends"), F.array_repeat(F.lit(0).cast("bigint"), states).alias("counts"))
    whole = F.aggregate(
        parts,
        zero,
        lambda x, y: F.struct(
            F.transform(x["ends"], lambda s: F.get(y["ends"], s)).alias("ends"),
            F.zip_with(x["ends"], x["counts"], lambda s, c: c + F.get(y["counts"], s)).alias("counts"),
        ),
    )
    return whole["ends"], whole["counts"]


def _choose(parts: Column, entry: Column, want: Column) -> Column:
    """Of summaries that follow each other the last with fewer than `want` units before it: (node, entry, want), both as seen from there."""
    kind = "struct<state: int, seen: bigint, node: bigint, entry: int, left: bigint>"
    start = F.struct(entry.alias("state"), F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("node"), entry.alias("entry"), want.alias("left")).cast(kind)

    def step(x: Column, y: Column) -> Column:
        here = x["seen"] < want
        return F.struct(
            F.get(y["ends"], x["state"]).alias("state"),
            (x["seen"] + F.get(y["counts"], x["state"])).alias("seen"),
            F.when(here, y["node"]).otherwise(x["node"]).alias("node"),
            F.when(here, x["state"]).otherwise(x["entry"]).alias("entry"),
            F.when(here, want - x["seen"]).otherwise(x["left"]).alias("left"),
        ).cast(kind)

    return F.aggregate(parts, start, step)


def chunked_cuts(chunks: DataFrame, key: str, one: str = "_one", two: str = "_two", auto: Automaton | None = None, fan: int = FAN) -> DataFrame:
    """(key, n, first, second) of texts that are stored as chunks (key, at, chunk, and the draws `one` and `two` in each row).

    n: units of the text; first and second: characters before its two cuts, as transform() has them. Chunks are
    numbered from 0 in the order of the text; repeated rows of a chunk count once.
    A chunk that ends within a character is an error.
    """
    auto = auto or line_automaton()

    @F.arrow_udf("struct<ends: array<int>, counts: array<bigint>, chars: bigint>")
    def summary(texts: pa.Array) -> pa.Array:
        data, at = _cut(texts)
        # A row is read in pieces, too, which are composed on the spot for each entry state.
        size, states = np.diff(at), auto.states
        ends, counts = np.tile(np.arange(states), (len(size), 1)), np.zeros((len(size), states), np.int64)
        pieces = -(-size // STEP_BYTES)
        of = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = at[:-1][of] + nth * STEP_BYTES
        piece_ends, piece_counts = chunk_summaries(data, begin, np.minimum(STEP_BYTES, at[1:][of] - begin), auto)
        first = np.cumsum(pieces) - pieces
        for k in range(int(pieces.max()) if len(pieces) else 0):
            row = np.flatnonzero(pieces > k)
            x = first[row] + k
            counts[row] += np.take_along_axis(piece_counts[x], ends[row], 1)
            ends[row] = np.take_along_axis(piece_ends[x], ends[row], 1)
        chars = np.diff(_characters(data)[at])
        return pa.StructArray.from_arrays([pa.array(ends.tolist(), pa.list_(pa.int32())), pa.array(counts.tolist(), pa.list_(pa.int64())), pa.array(chars)], names=["ends", "counts", "chars"])

    @F.arrow_udf("bigint")
    def place(texts: pa.Array, entry: pa.Array, want: pa.Array) -> pa.Array:
        data, at = _cut(texts)
        state, units = (x.to_numpy(zero_copy_only=False).astype(np.int64)[:, None] for x in (entry, want))
        _, _, read = _in_step(data, at[:-1], np.diff(at), auto, state, units)
        chars = _characters(data)
        # No byte of the text's last chunk ends its last, open unit.
        end = np.where(read[:, 0] > 0, at[:-1] + read[:, 0], at[1:])
        return pa.array(chars[end] - chars[at[:-1]])

    small_batches(chunks.sparkSession)
    read = chunks.select(key, "at", one, two, summary("chunk").alias("s")).select(key, F.col("at").alias("node"), one, two, "s.*").dropDuplicates([key, "node"])
    # The lowest level, and with it the characters before each group of FAN chunks, is written once.
    levels = [materialise(read, "chunk-summaries")]
    top = levels[0].agg(F.max("node")).first()[0] or 0
    while True:
        below = levels[-1].select(key, F.expr(f"node div {fan}").alias("up"), F.struct("node", "ends", "counts", "chars").alias("part"), one, two)
        grown = below.groupBy(key, F.col("up").alias("node")).agg(F.sort_array(F.collect_list("part")).alias("parts"), F.min(one).alias(one), F.min(two).alias(two))
        ends, counts = _compose(F.col("parts"), auto.states)
        chars = F.aggregate("parts", F.lit(0).cast("bigint"), lambda x, y: x + y["chars"])
        levels.append(materialise(grown.select(key, "node", one, two, "parts", ends.alias("ends"), counts.alias("counts"), chars.alias("chars")), "summary-tree"))
        if top < fan:
            break
        top //= fan
    final = F.array(*map(F.lit, auto.open_end))
    n = F.get("counts", F.lit(0)) + F.get(final, F.get("ends", F.lit(0)))
    roots = levels[-1].select(key, n.alias("n"), F.least(F.col(one) % (n + 1), F.col(two) % (n + 1)).alias("u1"), F.greatest(F.col(one) % (n + 1), F.col(two) % (n + 1)).alias("u2"))
    roots = materialise(roots, "chunked-units")
    cut = F.array(F.struct(F.lit(0).alias("k"), F.col("u1").alias("want")), F.struct(F.lit(1).alias("k"), F.col("u2").alias("want")))
    cuts = roots.select(key, F.inline(cut)).where("want > 0").select(key, "k", "want", F.lit(0).cast("bigint").alias("node"), F.lit(0).alias("entry"), F.lit(0).cast("bigint").alias("skip"))
    for level in reversed(levels[1:]):
        met = cuts.join(level.select(key, "node", "parts"), [key, "node"])
        chosen = met.withColumn("x", _choose(F.col("parts"), F.col("entry"), F.col("want")))
        passed = F.aggregate(F.filter("parts", lambda y: y["node"] < F.col("x.node")), F.lit(0).cast("bigint"), lambda a, y: a + y["chars"])
        cuts = chosen.select(key, "k", F.col("x.left").alias("want"), F.col("x.node").alias("node"), F.col("x.entry").alias("entry"), (F.col("skip") + passed).alias("skip"))
    held = cuts.join(chunks.select(key, F.col("at").alias("node"), "chunk").dropDuplicates([key, "node"]), [key, "node"])
    found = held.select(key, "k", (F.col("skip") + place("chunk", "entry", "want")).alias("chars"))
    both = found.groupBy(key).agg(F.max(F.when(F.col("k") == 0, F.col("chars"))).alias("first"), F.max(F.when(F.col("k") == 1, F.col("chars"))).alias("second"))
    zero = F.lit(0).cast("bigint")
    return roots.select(key, "n").join(both, key, "left").select(key, "n", F.coalesce("first", zero).alias("first"), F.coalesce("second", zero).alias("second"))


def _placed(df: DataFrame, doc_id: str, text: str, form: Format, auto: Automaton | None, giant: int, chunk: int) -> DataFrame:
    """(_row, _n, _first, _second): df's row packed, its units, and characters before the two cuts."""
    auto = auto or line_automaton()
    small_batches(df.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    whole, own = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{doc_id}`")
    one, two = draws(own, form.seed)[:2]
    long = F.length(whole) > giant
    done = df.where(~long).select(row, _cuts_udf(auto)(whole, one, two).alias("_c")).select("_row", F.col("_c.n").alias("_n"), F.col("_c.first").alias("_first"), F.col("_c.second").alias("_second"))
    # Rows with equal ids and texts have equal cuts.
    key = F.sha2(F.concat_ws(":", own.cast("string"), F.sha2(whole.cast("binary"), 256)), 256)
    giants = df.where(long).select(row, key.alias("_key"), one.alias("_one"), two.alias("_two"), whole.alias("_text"))
    if giants.isEmpty():
        return done
    # Chunks are dealt over tasks by key and number as repeated ones go.
    chunks = split_chunks(giants, "_key", "_text", chunk).dropDuplicates(["_key", "at"])
    drawn = small_side(materialise(giants.groupBy("_key").agg(F.min("_one").alias("_one"), F.min("_two").alias("_two")), "giant-draws"))
    cuts = chunked_cuts(materialise(chunks.join(drawn, "_key"), "giant-chunks"), "_key", auto=auto)
    cuts = small_side(materialise(cuts.withColumnsRenamed({"n": "_n", "first": "_first", "second": "_second"}), "giant-cuts"))
    return done.unionByName(giants.select("_key", "_row").join(cuts, "_key").select("_row", "_n", "_first", "_second"))


def assemble(text: Column, form_name: Column, first: Column, second: Column, form: Format = Format()) -> Column:
    """The transformed text, first and second being characters before the cuts."""
    prefix, middle = F.substring(text, F.lit(1), first.cast("int")), F.substring(text, first.cast("int") + 1, (second - first).cast("int"))
    suffix = F.substring(text, second.cast("int") + 1, F.length(text))
    p, s, m = map(F.lit, (form.prefix, form.suffix, form.middle))
    return F.when(form_name == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form_name == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)


def restore(output: Column, form_name: Column, form: Format = Format()) -> Column:
    """The text that `output` was made of, from it and the name of its form alone."""
    marks = "|".join(rf"\Q{x}\E" for x in (form.prefix, form.suffix, form.middle))
    parts = F.split(output, marks, -1)
    at = lambda k: F.get(parts, F.lit(k))
    return F.when(form_name == "psm", F.concat(at(1), at(3), at(2))).when(form_name == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def transform(df: DataFrame, doc_id: str = "doc_id", text: str = "text", form: Format = Format(), auto: Automaton | None = None, giant: int = GIANT_CHARS, chunk: int = CHUNK_CHARS) -> DataFrame:
    """df with n, form, prefix_chars, middle_chars and output; columns of these names are replaced, all others stay.

    A null text counts as empty. A text is cut after two of its n units, drawn from the
    seed and its id; a null id draws as an empty one, and equal ids draw alike. `form` is plain,
    output is the text and the numbers are null where the text is empty, holds one of the marks, or is not
    drawn; else it is psm or spm, after the order of prefix, suffix and middle. An empty table gives no rows.
    """
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    placed = _placed(df, doc_id, text, form, auto, giant, chunk)
    whole = F.coalesce(F.col("_row")[text], F.lit(""))
    marked = F.contains(whole, F.lit(form.prefix)) | F.contains(whole, F.lit(form.suffix)) | F.contains(whole, F.lit(form.middle))
    _, _, three, four = draws(F.col("_row")[doc_id], form.seed)
    name = F.when((whole == "") | marked | (three % 100 >= form.percent), "plain").when(four % 100 < form.spm_percent, "spm").otherwise("psm")
    named = placed.withColumn("_form", name)
    cut = F.col("_form") != "plain"
    return named.select(
        *(F.col("_row")[c].alias(c) for c in df.columns if c.lower() not in made),
        F.col("_n").alias("n"),
        F.col("_form").alias("form"),
        F.when(cut, F.col("_first")).alias("prefix_chars"),
        F.when(cut, F.col("_second") - F.col("_first")).alias("middle_chars"),
        assemble(whole, F.col("_form"), F.col("_first"), F.col("_second"), form).alias("output"),
    )
