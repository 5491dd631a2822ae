"""Byte-level BPE encoding and decoding.

Pre-tokens are cut from a batch of texts at once, by character classes. Each distinct
pre-token of the batch is then looked up in two tiers: a minimal perfect hash resolves
those that are vocabulary entries; the others are merged by a heap of adjacent pairs
over a linked list of byte spans.

Null and empty texts give no ids; ids that are null give no bytes. Only the named column
is read; other columns, whatever their names, pass through, and a column that already
has the output's name is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

#: Characters handled at once; a longer text is cut before white space.
CHUNK_CHARS = 1 << 19
#: Pre-tokens up to these many bytes are merged together, by rows of at most so many cells.
WIDTHS, CELLS_AT_ONCE = (8, 16, 32, 64), 1 << 17
#: Above every rank and every heap entry of a row.
NO_PAIR = np.int64(1 << 62)

OTHER, LETTER, NUMBER, SPACE = range(4)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys, n slots.

    Keys fall in buckets; from the largest bucket on, each gets the first displacement
    that sends its keys to free slots. A bucket of one key keeps its slot itself.
    """

    def __init__(self, keys: list[bytes], seed: int = 1) -> None:
        self.n, self.seed = len(keys), seed
        self.buckets = max(1, self.n // 2)
        self.move = np.zeros(self.buckets, np.int64)
        self.key_at = np.full(self.n, -1, np.int64)
        if not self.n:
            return
        bucket, first, step = self._split(keys)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
        free, single, n = bytearray(b"\x01") * self.n, [], self.n
        starts, steps = first.tolist(), step.tolist()
        for g in map(np.ndarray.tolist, sorted(groups, key=len, reverse=True)):
            if len(g) == 1:
                single.append(g[0])
                continue
            for d in range(1, 1 << 20):
                slots = {(starts[k] + d * steps[k]) % n for k in g}
                if len(slots) == len(g) and all(free[x] for x in slots):
                    break
            else:
                raise ValueError("equal keys")
            for k in g:
                x = (starts[k] + d * steps[k]) % n
                free[x] = 0
                self.key_at[x] = k
            self.move[bucket[g[0]]] = d
        free = np.frombuffer(free, np.uint8)
        for key, slot in zip(single, np.flatnonzero(free).tolist(), strict=True):
            self.move[bucket[key]] = -slot - 1
            self.key_at[slot] = key

    def _split(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.fromiter((xxhash.xxh3_64_intdigest(k, self.seed) for k in keys), np.uint64, len(keys))
        low = (h & np.uint64(0x1FFFFF)).astype(np.int64)
        step = ((h >> np.uint64(21)) & np.uint64(0x1FFFFF)).astype(np.int64) | 1
        return (h >> np.uint64(42)).astype(np.int64) % self.buckets, low, step

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Of each string the only key that it can be, by number."""
        bucket, first, step = self._split(keys)
        move = self.move[bucket]
        return self.key_at[np.where(move < 0, -move - 1, (first + move * step) % self.n)]


class Vocabulary:
    """Ranks with their perfect hash; small and of fixed size, so it can be broadcast."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.tokens, self.hash = list(ranks), PerfectHash(list(ranks))
        self.rank_of = np.fromiter(ranks.values(), np.int64, len(ranks))
        #: Every two tokens that make a token, as one number, in an open hash table; and that token's rank.
        self.span = max(ranks.values(), default=0) + 1
        found = [
            (left * self.span + right, rank)
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None
        ]
        self._fill(np.array(found, np.int64).reshape(-1, 2))
        self.one = np.full(256, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 1:
                self.one[token[0]] = rank
        self._keys = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_keys": None}

    @property
    def keys(self) -> dict[bytes, int]:
        """rank << 32 of each token; only long pre-tokens need it."""
        if self._keys is None:
            self._keys = {token: rank << 32 for token, rank in zip(self.tokens, self.rank_of.tolist(), strict=True)}
        return self._keys

    @cached_property
    def by_rank(self) -> pa.Array:
        """The bytes of each id; null where there is none."""
        out: list[bytes | None] = [None] * self.span
        for token, rank in zip(self.tokens, self.rank_of.tolist(), strict=True):
            out[rank] = token
        return pa.array(out, pa.binary())

    def _fill(self, found: np.ndarray) -> None:
        """Put every pair into the first free slot from its own on."""
        self.slots = 1 << int(4 * len(found) + 1).bit_length()
        self.pair, self.pair_rank = np.full(self.slots, -1, np.int64), np.full(self.slots, NO_PAIR)
        at = self._slot(found[:, 0])
        while len(found):
            free = self.pair[at] < 0
            self.pair[at[free]] = found[free, 0]  # of several the last one stays
            mine = self.pair[at] == found[:, 0]
            self.pair_rank[at[mine]] = found[mine, 1]
            found, at = found[~mine], (at[~mine] + 1) % self.slots

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        mixed = pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(65 - self.slots.bit_length())).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each two ids put together, NO_PAIR where they make no token."""
        pair = left * self.span + right
        at = self._slot(pair)
        held = self.pair[at]
        out = np.where(held == pair, self.pair_rank[at], NO_PAIR)
        rest = np.flatnonzero((held != pair) & (held >= 0))
        at = at[rest]
        while len(rest):
            at = (at + 1) % self.slots
            held, sought = self.pair[at], pair[rest]
            out[rest] = np.where(held == sought, self.pair_rank[at], NO_PAIR)
            more = (held != sought) & (held >= 0)
            rest, at = rest[more], at[more]
        return out

    def resolve(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens in a row, and how many each has."""
        key, tokens = self.hash.find(pieces), self.tokens
        known = np.fromiter((tokens[k] == p for k, p in zip(key.tolist(), pieces, strict=True)), bool, len(pieces))
        missing = np.flatnonzero(~known)
        ids, size = self.merged([pieces[k] for k in missing.tolist()])
        sizes = np.ones(len(pieces), np.int64)
        sizes[missing] = size
        out = np.zeros(int(sizes.sum()), np.int32)
        begin = np.cumsum(sizes) - sizes
        out[begin[known]] = self.rank_of[key[known]]
        out[np.repeat(begin[missing] - (np.cumsum(size) - size), size) + np.arange(len(ids))] = ids
        return out, sizes

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that are no vocabulary entries, in a row, and how many each has.

        Pieces of like length are merged together; see merge_rows(). Long ones are merged one by one.
        """
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        if len(data) and self.one[np.flatnonzero(np.bincount(data, minlength=256))].min() < 0:
            raise ValueError("the vocabulary lacks a byte")
        begin, parts, shorter = np.cumsum(length) - length, [], 0
        for width in WIDTHS:
            like = np.flatnonzero((length > shorter) & (length <= width))
            shorter, rows = width, max(1, CELLS_AT_ONCE // width)
            for at in range(0, len(like), rows):
                some = like[at : at + rows]
                parts.append((some, *merge_rows(data, begin[some], length[some], width, self)))
        for k in np.flatnonzero(length > shorter).tolist():
            ids = merge(pieces[k], self)
            parts.append((np.array([k]), np.array(ids, np.int32), np.array([len(ids)])))
        sizes = np.zeros(len(pieces), np.int64)
        for some, _, size in parts:
            sizes[some] = size
        start, out = np.cumsum(sizes) - sizes, np.zeros(int(sizes.sum()), np.int32)
        for some, ids, size in parts:
            out[np.repeat(start[some] - (np.cumsum(size) - size), size) + np.arange(len(ids))] = ids
        return out, sizes


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(load_ranks(path))


def merge_rows(data: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merge pieces of at most `width` bytes (a power of two), a row each, in step; (ids in a row, how many each piece has).

    Spans are a linked list over a row's bytes: `end` is where the span that starts at a byte
    ends, `before` where the span before it starts. The pairs of a row are the leaves of its heap, a
    binary tree in which a parent is the lesser of its two children, so the root is the pair of
    lowest rank, the leftmost of equals. A merge changes three leaves and what is above them.
    """
    n, place = len(begin), np.arange(width)
    inside = place < length[:, None]
    ids = vocab.one[data[np.where(inside, begin[:, None] + place, 0)]].ravel()
    end = np.tile(place + 1, n)
    before = np.tile(np.arange(-1, width), n)
    starts = inside.ravel().copy()
    tree = np.full((n, 2 * width), NO_PAIR)
    followed = np.flatnonzero((place + 1 < length[:, None]).ravel())
    rank = vocab.pair_ranks(ids[followed], ids[followed + 1])
    leaf = np.full(n * width, NO_PAIR)
    leaf[followed] = np.where(rank < NO_PAIR, rank << 8 | followed % width, NO_PAIR)
    tree[:, width:] = leaf.reshape(n, width)
    level = width // 2
    while level:
        np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
        level //= 2
    tree = tree.ravel()
    live = np.arange(n)

    def pair_key(left: np.ndarray, right: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The leaf of the pair of spans that start at `left` and `right`."""
        rank = vocab.pair_ranks(ids[row * width + left], ids[row * width + right])
        return np.where(rank < NO_PAIR, rank << 8 | left, NO_PAIR)

    while True:
        root = tree[live * (2 * width) + 1]
        some = root < NO_PAIR
        live, root = live[some], root[some]
        if not len(live):
            break
        row, heap = live * width, live * (2 * width)
        i = root & 255
        middle = end[row + i]
        stop = end[row + middle]
        ids[row + i] = root >> 8
        end[row + i] = stop
        starts[row + middle] = False
        tree[heap + width + middle] = NO_PAIR
        tree[heap + width + i] = NO_PAIR
        on = stop < length[live]
        before[live[on] * (width + 1) + stop[on]] = i[on]
        tree[heap[on] + width + i[on]] = pair_key(i[on], stop[on], live[on])
        j = before[live * (width + 1) + i]
        back = j >= 0
        tree[heap[back] + width + j[back]] = pair_key(j[back], i[back], live[back])
        base = np.concatenate([heap, heap, heap[back]])
        node = np.concatenate([i, middle, j[back]]) + width
        while (node := node >> 1)[0]:
            at = base + 2 * node
            tree[base + node] = np.minimum(tree[at], tree[at + 1])
    return ids[starts].astype(np.int32), starts.reshape(n, width).sum(axis=1)


def merge(piece: bytes, vocab: Vocabulary) -> list[int]:
    """Merge one piece of any length: linked spans as in merge_rows(), and a heap of entries rank << 32 | start.

    An entry that is no longer its start's valid one is passed over.
    """
    n, get = len(piece), vocab.keys.get
    ids = vocab.one[np.frombuffer(piece, np.uint8)]
    rank = vocab.pair_ranks(ids[:-1], ids[1:])
    pairs = [*np.where(rank < NO_PAIR, rank << 32 | np.arange(n - 1), -1).tolist(), -1]
    ids, end, before = ids.tolist(), list(range(1, n + 2)), list(range(-1, n))
    heap = [x for x in pairs if x >= 0]
    heapify(heap)
    while heap:
        x = heappop(heap)
        i = x & 0xFFFFFFFF
        if pairs[i] != x:
            continue
        ids[i] = x >> 32
        middle = end[i]
        stop = end[i] = end[middle]
        pairs[middle] = pairs[i] = -1
        if stop < n:
            before[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                pairs[i] = r = r | i
                heappush(heap, r)
        if i:
            j = before[i]
            if (r := get(piece[j:stop])) is not None:
                pairs[j] = r = r | j
                heappush(heap, r)
            else:
                pairs[j] = -1
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = end[i]
    return out


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    shift = lambda at: at + 0x800 * (at >= 0xD800)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[shift(m.start()) : shift(m.end() - 1) + 1] = kind
    return table


def boundaries(chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """True where a pre-token begins; chars: code points of texts that begin at `starts`.

    A space before a run of letters, of numbers or of other characters belongs to the
    run; of longer white space before a run only the last character stands alone. White
    space at a text's end is one pre-token. An apostrophe that begins a pre-token takes
    a short ending from the letters after it.
    """
    n = len(chars)
    cut = np.zeros(n + 1, bool)
    if not n:
        return cut
    kind = char_classes()[chars]
    first = np.zeros(n, bool)
    first[starts[starts < n]] = True
    cut[0] = True
    cut[1:n] = (kind[1:] != kind[:-1]) | first[1:]
    run = np.flatnonzero(cut)
    # The last white space before a run of anything else in the same text.
    inner = run[1:][~first[run[1:]]]
    last = inner[kind[inner - 1] == SPACE] - 1
    cut[last] = True
    cut[last[chars[last] == 0x20] + 1] = False
    # Endings after an apostrophe.
    at = np.flatnonzero((chars == 0x27) & cut[:n])
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == LETTER) & ~first[at + 1]]
    a = chars[at + 1]
    two = at + 2 < n
    b = np.where(two, chars[np.minimum(at + 2, n - 1)], 0)
    b = np.where(two & ~first[np.minimum(at + 2, n - 1)], b, 0)
    short = np.isin(a, [ord(x) for x in "stmd"])
    long = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    for which, size in ((short, 1), (long, 2)):
        p = at[which]
        cut[p + 1] = False
        rest = p + 1 + size
        cut[rest] = True
    cut[n] = False
    return cut


#: White space after anything else, and changes of class within ASCII for texts without white space.
_SAFE = re.compile(r"(?<=\S)[ \n]|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9.,;:/=&_+-])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[.,;:/=&_+-])")


def segments(text: str, limit: int = CHUNK_CHARS) -> Iterator[str]:
    """Parts of a text, cut where a pre-token must begin."""
    at = 0
    while len(text) - at > limit and (m := _SAFE.search(text, at + limit)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


#: An odd multiplier and its powers tell pieces apart by their characters and order.
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse, modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def number_pieces(chars: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each piece of `chars`, equal for equal pieces, and the first piece of each number.

    Pieces are told apart by a 64-bit hash; that equal hashes are equal pieces is then checked
    character by character, and pieces that only share a hash get numbers of their own.
    """
    room = 1 << max(16, int(len(chars)).bit_length())
    up, down = _powers(room)
    mixed = chars.astype(np.uint64) + np.uint64(1)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    until = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * up[: len(chars)], dtype=np.uint64)])
    key = (until[begin + size] - until[begin]) * down[begin]
    _, first, code = np.unique(key, return_index=True, return_inverse=True)
    like = begin[first][code]
    same = np.ones(len(code), bool)
    if (wrong := size[first][code] != size).any():
        same &= ~wrong
    ends = np.cumsum(size)
    shift = np.repeat(like - begin, size)
    equal = chars[np.minimum(np.arange(len(shift)) + shift, len(chars) - 1)] == chars
    if not equal.all():
        same &= np.logical_and.reduceat(equal, ends - size)
    if not same.all():
        table: dict[bytes, int] = {}
        for k in np.flatnonzero(~same).tolist():
            piece = chars[begin[k] : begin[k] + size[k]].tobytes()
            if piece not in table:
                table[piece] = len(first)
                first = np.append(first, k)
            code[k] = table[piece]
    return code, first


def _encode_some(parts: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all parts in a row, and how many each has."""
    whole = "".join(parts)
    chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    part_size = np.fromiter(map(len, parts), np.int64, len(parts))
    part_end = np.cumsum(part_size)
    begin = np.flatnonzero(boundaries(chars, part_end - part_size))
    code, first = number_pieces(chars, begin, np.diff(begin, append=len(chars)))
    stop = np.append(begin[1:], len(chars))[first]
    flat, size = vocab.resolve([whole[a:b].encode() for a, b in zip(begin[first].tolist(), stop.tolist(), strict=True)])
    start = np.cumsum(size) - size
    each = size[code]
    until = np.concatenate([[0], np.cumsum(each)])
    spread = np.repeat(start[code] - until[:-1], each) + np.arange(until[-1])
    return flat[spread], np.diff(until[np.concatenate([[0], np.searchsorted(begin, part_end)])])


def encode_texts(texts: list[str | None], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and the offsets of each text's ids."""
    found, counts = [], np.zeros(len(texts), np.int64)
    parts: list[str] = []
    owner: list[int] = []
    room = CHUNK_CHARS

    def flush() -> None:
        nonlocal room
        if parts:
            ids, sizes = _encode_some(parts, vocab)
            found.append(ids)
            np.add.at(counts, owner, sizes)
        parts.clear()
        owner.clear()
        room = CHUNK_CHARS

    for k, text in enumerate(texts):
        for part in segments(text) if text else ():
            if len(part) > room:
                flush()
            parts.append(part)
            owner.append(k)
            room -= len(part)
    flush()
    flat = np.concatenate(found) if found else np.zeros(0, np.int32)
    return flat, np.concatenate([[0], np.cumsum(counts)])


def decode_ids(lists: pa.Array, vocab: Vocabulary) -> pa.Array:
    """The bytes of each list of ids."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ids = lists.drop_null().flatten()
    taken = vocab.by_rank.take(ids)
    if taken.null_count:
        raise ValueError("an id is not in the vocabulary")
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int32)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int32)
    ends = at[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), data])


@lru_cache(maxsize=4)
def _shared(application: str, path: str):
    """One broadcast of a vocabulary for all encodings and decodings of an application."""
    return SparkSession.getActiveSession().sparkContext.broadcast(vocabulary(path))


def _broadcast(spark: SparkSession, path: str):
    small_batches(spark)
    return _shared(spark.sparkContext.applicationId, path)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add `out`, the ids of column `text` by the ranks of the file `path` (array<int>).

    The file is read on the driver; its tables, whose size the vocabulary fixes, are broadcast.
    """
    vocab = _broadcast(df.sparkSession, path)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        flat, offsets = encode_texts(texts.to_pylist(), vocab.value)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))

    return df.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add `out`, the bytes of the ids in column `ids` (binary)."""
    vocab = _broadcast(df.sparkSession, path)

    @F.arrow_udf("binary")
    def data(lists: pa.Array) -> pa.Array:
        return decode_ids(lists, vocab.value)

    return df.withColumn(out, data(F.col(ids)))


def ids_sha256(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
