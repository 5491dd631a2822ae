"""A stored inverted index for the weighted search, in segments.

Each segment holds its cards' normalised texts, postings and a dictionary. Postings are rows (token, field,
block): the cards of a block of BLOCK_CARDS that have the token, how often, and the most often; a block that two tasks
read, or of very long texts, has a few such rows with other cards each. They lie in
buckets by token, which are folders, so that a query reads its tokens' buckets alone. A query token also counts, for
less, within longer tokens; these are found in the dictionary by a bucket of its 3-grams. A query token of one or two
characters is looked for in all of the dictionary's grams.

Search reads the most-often numbers first: they bound every block's score. The best blocks are
scored, and then only those that could still beat the last of the best cards.

Segments are added, never rewritten. A card that comes again, or is removed, is listed as gone in
a small table; compaction writes one segment of what is left. All of that goes through a log of commits, so readers
keep the snapshot they began with.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.numeric import to_fixed
from .commits import CommitLog, ConflictError, list_names
from .rounds import small_batches
from .search import PHRASE, SUBSTRING, WEIGHTS, searchable

#: Folders of postings and of dictionary grams; cards of a block, a power of two; tasks over which a bucket is dealt when it is written.
BUCKETS, BLOCK_CARDS, DEALT = 64, 1_024, 4
#: Blocks that are scored first; values that are pushed to a scan as a list, more are joined.
FIRST_BLOCKS, PUSHED = 64, 1_000
#: Bytes of tokens of a block that a task gathers.
BLOCK_BYTES = 32 << 20
_POSTINGS = "token string, field string, block long, top int, cards array<struct<card: long, n: int>>, segment string, bucket int"
_GRAMS = "gram string, token string, segment string, bucket int"
_GONE = "segment string, card long"


def _bucket(value: Column) -> Column:
    return (F.crc32(value.cast("binary")) % BUCKETS).cast("int")


def _buckets(values: list[str]) -> set[int]:
    """The same of values that are here."""
    return {zlib.crc32(v.encode()) % BUCKETS for v in values}


def grams(token: Column) -> Column:
    """All strings of three characters in a token, each once; a shorter token itself."""
    of = F.transform(F.sequence(F.lit(1), F.length(token) - 2), lambda k: F.substring(token, k, F.lit(3)))
    return F.when(F.length(token) > 3, F.array_distinct(of)).otherwise(F.array(token))


def _field_postings(cards: np.ndarray, lists: pa.Array, field: str, block: int) -> pa.RecordBatch:
    """A block's postings of one field from its cards' token lists."""
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.drop_null().flatten().dictionary_encode()
    rows = max(1, len(cards))
    pair, n = np.unique(words.indices.to_numpy(zero_copy_only=False) * np.int64(rows) + np.repeat(np.arange(len(size)), size), return_counts=True)
    word = pair // rows
    first = np.flatnonzero(np.diff(word, prepend=-1))
    parts = pa.StructArray.from_arrays([pa.array(cards[pair % rows]), pa.array(n.astype(np.int32))], names=["card", "n"])
    listed = pa.ListArray.from_arrays(np.append(first, len(pair)).astype(np.int32), parts)
    top = np.maximum.reduceat(n, first) if len(first) else n
    columns = [words.dictionary.take(pa.array(word[first])), pa.array([field] * len(first), pa.string()), pa.array(np.full(len(first), block)), pa.array(top.astype(np.int32)), listed]
    return pa.RecordBatch.from_arrays(columns, names=["token", "field", "block", "top", "cards"])


def block_postings(cards: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(token, field, block, top, cards) of cards (card, a token array for each of `fields`), which come in the order of `card`.

    A block is counted where it is read, so that its postings are the first that moves.
    """
    small_batches(cards.sparkSession)
    per, most = BLOCK_CARDS, BLOCK_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found() -> Iterator[pa.RecordBatch]:
            whole = pa.concat_batches(held)
            ids = whole.column(0).to_numpy()
            for k, field in enumerate(fields):
                part = _field_postings(ids, whole.column(k + 1), field, int(ids[0]) // per)
                if part.num_rows:
                    yield part

        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = batch.column(0).to_numpy() // per
            begins = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist()]
            for x, y in zip(begins, [*begins[1:], len(blocks)], strict=True):
                if held and (held[0].column(0)[0].as_py() // per != blocks[x] or sum(b.nbytes for b in held) > most):
                    yield from found()
                    held = []
                held.append(batch.slice(x, y - x))
        if held:
            yield from found()

    return cards.select("card", *fields).mapInArrow(count, "token string, field string, block long, top int, cards array<struct<card: long, n: int>>")


class SearchIndex:
    """The index below a folder. `fields` are names of searched fields, all of them with a weight."""

    def __init__(self, spark: SparkSession, folder: str, fields: tuple[str, ...] = tuple(WEIGHTS)) -> None:
        self.spark, self.folder, self.fields = spark, folder.rstrip("/"), fields
        self.log = CommitLog(spark, f"{self.folder}/log")

    # Writing

    def append(self, cards: DataFrame, fields: dict[str, Column]) -> int:
        """Add cards (id, title and what `fields` are made of), no id twice; one whose id is there already takes the other's place.

        What is written follows the cards that are added: a segment of them and the places of those they replace.
        """
        return self._add(searchable(cards, fields))

    def remove(self, ids: DataFrame) -> int:
        """Take cards (id) out; unknown ids are no harm."""
        return self._commit(lambda state: {"segments": state.get("segments", []), "gone": [*state.get("gone", []), *self._mark(state, ids)]})

    def compact(self) -> int:
        """Write one segment of all cards that are there. Fails where another writer commits meanwhile."""
        base = self.log.head()
        state = self.log.read(base)
        segment = self._write(self._live(state).select("id", "title", *(f"{f}_text" for f in self.fields)))
        return self.log.commit(base, {"segments": [segment], "gone": []})

    def _add(self, rows: DataFrame) -> int:
        segment = self._write(rows)
        new = self._cards([segment])
        return self._commit(lambda state: {"segments": [*state.get("segments", []), segment], "gone": [*state.get("gone", []), *self._mark(state, new)]})

    def _commit(self, change) -> int:
        return self.log.update(change)

    def _mark(self, state: dict, ids: DataFrame) -> list[str]:
        """Write the places of cards with these ids; the name of the table, if it has rows."""
        if not state.get("segments"):
            return []
        name = uuid.uuid4().hex
        self._live(state).join(ids.select("id"), "id", "left_semi").select("segment", "card").write.parquet(f"{self.folder}/gone/{name}")
        return [name] if not self.spark.read.schema(_GONE).parquet(f"{self.folder}/gone/{name}").isEmpty() else []

    def _write(self, rows: DataFrame) -> dict:
        """A segment's name, its blocks, and the folders that its postings and grams have."""
        segment = uuid.uuid4().hex
        rows.withColumn("card", F.monotonically_increasing_id()).write.parquet(f"{self.folder}/cards/segment={segment}")
        named = {"name": segment}
        cards = self._cards([named])
        blocks = cards.select(F.floor(F.col("card") / BLOCK_CARDS)).distinct().count()
        found = block_postings(cards.select("card", *(t.tokenize(F.col(f"{f}_text")).alias(f) for f in self.fields)), self.fields)
        # A frequent token's blocks are dealt over several tasks.
        dealt = found.withColumn("bucket", _bucket(F.col("token"))).repartition("bucket", F.pmod("block", F.lit(DEALT if blocks > FIRST_BLOCKS else 1))).sortWithinPartitions("bucket", "token", "field", "block")
        dealt.write.partitionBy("bucket").parquet(f"{self.folder}/postings/segment={segment}")
        held = lambda kind: sorted(int(x[7:]) for x in list_names(self.spark, f"{self.folder}/{kind}/segment={segment}") if x.startswith("bucket="))
        named |= {"blocks": blocks, "postings": held("postings")}
        names = self._postings([named]).select("token").distinct()
        listed = names.select(F.explode(grams(F.col("token"))).alias("gram"), "token").withColumn("bucket", _bucket(F.col("gram")))
        listed.repartition("bucket").sortWithinPartitions("bucket", "gram", "token").write.partitionBy("bucket").parquet(f"{self.folder}/grams/segment={segment}")
        return named | {"grams": held("grams")}

    # Reading

    def _read(self, kind: str, schema: str, segments: list[dict], buckets: set[int] | None = None) -> DataFrame:
        """Rows of segments, of all their buckets or of some: other folders are not even listed."""
        paths = []
        for s in segments:
            own = f"{self.folder}/{kind}/segment={s['name']}"
            paths += [f"{own}/bucket={b}" for b in s[kind] if b in buckets] if buckets is not None else [own] if kind == "cards" or s[kind] else []
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _cards(self, segments: list[dict]) -> DataFrame:
        texts = ", ".join(f"{f}_text string" for f in self.fields)
        return self._read("cards", f"id string, title string, {texts}, card long, segment string", segments)

    def _postings(self, segments: list[dict], tokens: list[str] | None = None) -> DataFrame:
        if tokens is None:
            return self._read("postings", _POSTINGS, segments)
        return self._read("postings", _POSTINGS, segments, _buckets(tokens)).where(F.col("token").isin(tokens))

    def _without(self, state: dict, rows: DataFrame) -> DataFrame:
        """rows (segment, card, ...) without the cards that are gone."""
        if not state.get("gone"):
            return rows
        gone = self.spark.read.schema(_GONE).parquet(*(f"{self.folder}/gone/{x}" for x in state["gone"]))
        return rows.join(gone, ["segment", "card"], "left_anti")

    def _live(self, state: dict) -> DataFrame:
        return self._without(state, self._cards(state["segments"]))

    def cards(self, number: int | None = None) -> DataFrame:
        """(id, title, a text a field, card, segment) of a commit, the latest by default."""
        return self._live(self.log.read(number))

    def term_counts(self, number: int | None = None) -> DataFrame:
        """(id, field, token, n): how often each token is in each field of each card."""
        state = self.log.read(number)
        each = self._postings(state["segments"]).select("segment", "field", "token", F.inline("cards"))
        return self._live(state).select("id", "segment", "card").join(each, ["segment", "card"]).select("id", "field", "token", "n")

    def holding(self, segments: list[dict], words: list[str]) -> DataFrame:
        """(word, token): tokens of the dictionary that hold a word of the query."""
        pairs = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(w[:3]).alias("first")) for w in words))
        firsts, short = sorted({w[:3] for w in words if len(w) > 2}), [w for w in words if len(w) < 3]
        of_short = reduce(or_, (F.contains("gram", F.lit(w)) for w in short), F.lit(False))
        wanted = self._read("grams", _GRAMS, segments, None if short else _buckets(firsts)).where(F.col("gram").isin(firsts) | of_short)
        met = F.when(F.length("word") < 3, F.contains("gram", F.col("word"))).otherwise((F.col("gram") == F.col("first")) & F.contains("token", F.col("word")))
        return wanted.select("gram", "token", F.inline(pairs)).where(met).select("word", "token").distinct()

    def _hits(self, segments: list[dict], words: list[str]) -> DataFrame:
        """Postings of all tokens that hold a word of the query, with the word and whether it is the token."""
        held = self.holding(segments, words)
        some = [tuple(r) for r in held.limit(PUSHED + 1).collect()]
        if len(some) <= PUSHED:
            # The list is bounded, so it may come here and go to the scan.
            postings = self._postings(segments, sorted({token for _, token in some}))
            held = F.broadcast(self.spark.createDataFrame(some, "word string, token string"))
        else:
            postings = self._postings(segments)
        return postings.join(held, "token").withColumn("exact", F.col("token") == F.col("word"))

    def search(self, query: str, query_tokens: list[str], limit: int = 20, number: int | None = None, report: dict | None = None) -> DataFrame:
        """(id, title, score, matched_fields): what search.search() gives for the cards of a commit, the latest by default.

        report, if given, gets how many blocks hold a hit and how many were scored.
        """
        if not 1 <= limit <= 100:
            raise ValueError("limit must be between 1 and 100")
        state = self.log.read(number)
        empty = "id string, title string, score double, matched_fields string"
        if not query_tokens or not state.get("segments"):
            return self.spark.createDataFrame([], empty)
        hits = self._hits(state["segments"], query_tokens)
        # So few blocks are scored at once, without bounds.
        if sum(x["blocks"] for x in state["segments"]) <= FIRST_BLOCKS:
            return self._best(state, self._scores(state, hits, query_tokens), query, limit)
        bounds = self._bounds(hits, query_tokens).cache()
        near = [tuple(r) for r in bounds.orderBy(F.desc("bound"), "segment", "block").limit(FIRST_BLOCKS).select("segment", "block").collect()]
        chosen = F.broadcast(self.spark.createDataFrame(near, "segment string, block long"))
        first = hits.join(chosen, ["segment", "block"])
        best = [r[0] for r in self._scores(state, first, query_tokens).orderBy(F.desc("base")).limit(limit).select("base").collect()]
        # Only these blocks hold a card that may still enter.
        last = best[-1] if len(best) == limit else 0.0
        still = bounds.where(F.col("bound") >= last - 1e-6).select("segment", "block")
        many = still.count()
        if report is not None:
            report.update(blocks=bounds.count(), scored=many)
        both = hits.join(F.broadcast(still) if many <= PUSHED else still, ["segment", "block"])
        return self._best(state, self._scores(state, both, query_tokens), query, limit)

    def _best(self, state: dict, scored: DataFrame, query: str, limit: int) -> DataFrame:
        """The best of the scored cards with their phrases, which only cards that could be among them are looked up for."""
        upper = F.col("base") + F.col("open")
        top = [tuple(r) for r in scored.orderBy(upper.desc()).limit(PUSHED).select("segment", "card", "base", "open").collect()]
        base = sorted((x[2] for x in top), reverse=True)
        last = base[limit - 1] if len(base) >= limit else 0.0
        wanted = [x for x in top if x[2] + x[3] >= last - 1e-6]
        cards = self._cards(state["segments"]).select("segment", "card", "id", "title", *(f"{f}_text" for f in PHRASE if f in self.fields))
        if len(top) < PUSHED or len(wanted) < len(top):
            # Nothing below these can enter, and they are few.
            cards = cards.where(F.col("card").isin(sorted({x[1] for x in wanted})) & F.col("segment").isin(sorted({x[0] for x in wanted})))
            scored = scored.where(upper >= last - 1e-6)
        both = scored.join(cards, ["segment", "card"])
        total = F.lit(0.0)
        for field in self.fields:
            total = total + F.col(f"s_{field}") * WEIGHTS[field]
        for field, bonus in PHRASE.items():
            if field in self.fields:
                total = total + F.when(F.contains(F.col(f"{field}_text"), F.lit(query)), F.lit(float(bonus))).otherwise(F.lit(0.0))
        out = both.select("id", "title", to_fixed(total, 6).alias("score"), "matched_fields")
        return out.orderBy(F.desc("score"), F.collate("title", "UNICODE"), F.collate("id", "UNICODE")).limit(limit)

    def _bounds(self, hits: DataFrame, tokens: list[str]) -> DataFrame:
        """(segment, block, bound): the most that a card of a block can score."""
        most = F.max(F.when(F.col("exact"), 1 + F.ln("top")).otherwise(F.lit(SUBSTRING)))
        per = hits.groupBy("segment", "block", "field", "word").agg(most.alias("most"))
        weight = F.create_map(*(F.lit(x) for f in self.fields for x in (f, float(WEIGHTS[f]))))
        per = per.groupBy("segment", "block", "field").agg((F.sum("most") * F.first(weight[F.col("field")])).alias("sum"), F.count(F.lit(1)).alias("words"))
        bonus = F.lit(0.0)
        for field, more in PHRASE.items():
            bonus = bonus + F.when((F.col("field") == field) & (F.col("words") == len(tokens)), F.lit(float(more))).otherwise(F.lit(0.0))
        return per.groupBy("segment", "block").agg(F.sum(F.col("sum") + bonus).alias("bound"))

    def _scores(self, state: dict, hits: DataFrame, tokens: list[str]) -> DataFrame:
        """(segment, card, s_<field>, matched_fields, base, open) of the cards in hits; base: the score without phrases, open: what these could add."""
        each = self._without(state, hits.select("segment", "field", "word", "exact", F.inline("cards")))
        of = lambda f, w: (F.col("field") == f) & (F.col("word") == w)
        sums = []
        for i, field in enumerate(self.fields):
            for k, word in enumerate(tokens):
                sums += [F.max(F.when(of(field, word) & F.col("exact"), F.col("n"))).alias(f"n_{i}_{k}"), F.max(F.when(of(field, word), F.lit(1))).alias(f"in_{i}_{k}")]
        rows = each.groupBy("segment", "card").agg(*sums)
        total, open_, matched = F.lit(0.0), F.lit(0.0), []
        for i, field in enumerate(self.fields):
            score = F.lit(0.0)
            for k in range(len(tokens)):
                n, inside = F.col(f"n_{i}_{k}"), F.col(f"in_{i}_{k}").isNotNull()
                score = score + F.when(~inside, F.lit(0.0)).when(n.isNotNull(), 1 + F.ln(n)).otherwise(F.lit(SUBSTRING))
            rows = rows.withColumn(f"s_{field}", score)
            total = total + F.col(f"s_{field}") * WEIGHTS[field]
            inside = [F.col(f"in_{i}_{k}").isNotNull() for k in range(len(tokens))]
            matched.append(F.when(reduce(lambda a, b: a | b, inside), F.lit(field)))
            if field in PHRASE:
                open_ = open_ + F.when(reduce(and_, inside), F.lit(float(PHRASE[field]))).otherwise(F.lit(0.0))
        return rows.select("segment", "card", *(f"s_{f}" for f in self.fields), F.array_join(F.array_compact(F.array(*matched)), ",").alias("matched_fields"), total.alias("base"), open_.alias("open"))


__all__ = ["ConflictError", "SearchIndex", "grams"]
