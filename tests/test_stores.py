"""Stored things: the search index, the commit log, releases and delta files."""

import threading

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import text as t
from quillmesh.operators import search
from quillmesh.operators import search_index as si
from quillmesh.operators import release
from quillmesh.operators.commits import CommitLog, ConflictError, create_if_absent
from quillmesh.operators.publish import Releases, release_issues
from quillmesh.streaming.incremental import DeltaIndex



def fields():
    return {"title": F.col("title"), "summary": F.col("summary"), "metadata": F.col("meta"), "body": F.col("body")}


WORDS = ["the", "other", "theme", "station", "stations", "reading", "rereading", "a.b", "x.a.b.c", "7", "b7", "naïve", "Ｆull", "e", "un-do"]


def cards(spark, n, salt=0):
    word = lambda k, m: WORDS[(k * 7 + m * m + salt) % len(WORDS)]
    rows = [(f"id{k:04d}", f"{word(k, 0)} {word(k, 1)}", " ".join(word(k, m) for m in range(2, 6 + k % 5)), word(k, 3), None if k % 17 == 0 else " ".join(word(k * 3, m) for m in range(k % 40))) for k in range(n)]
    return spark.createDataFrame(rows, "id string, title string, summary string, meta string, body string")


def same(index, df, query, limit, report=None):
    tokens = sorted(set(spark_tokens(df.sparkSession, query)))
    got = list(map(tuple, index.search(query, tokens, limit, report=report).collect()))
    assert got == list(map(tuple, search.search(search.searchable(df, fields()), query, tokens, limit).collect()))
    return got


def spark_tokens(spark, query):
    return spark.range(1).select(t.tokenize(t.normalize_search_text(F.lit(query)))).first()[0]


@pytest.mark.parametrize("block, first", [(1_024, 64), (8, 2)])
def test_stored_search_is_the_scan(spark, tmp_path, monkeypatch, block, first):
    monkeypatch.setattr(si, "BLOCK_CARDS", block)
    monkeypatch.setattr(si, "FIRST_BLOCKS", first)
    df, index = cards(spark, 300), si.SearchIndex(spark, str(tmp_path / "index"))
    assert index.search("the", ["the"]).count() == 0
    index.append(df.where("id < 'id0200'"), fields())
    index.append(df.where("id >= 'id0200'"), fields())
    for query, limit in (("the station", 20), ("reading the a.b", 5), ("7", 100), ("station reading", 3), ("nothing here", 10), ("the the theme un-do", 1)):
        same(index, df, query, limit)
    report = {}
    same(index, df, "naïve full", 1, report)
    assert not report or report["scored"] <= report["blocks"]


def test_append_replace_remove_compact(spark, tmp_path):
    df, index = cards(spark, 60), si.SearchIndex(spark, str(tmp_path / "index"))
    index.append(df, fields())
    other = cards(spark, 90, salt=5).where("id >= 'id0050'")
    old = index.log.head()
    index.append(other, fields())
    index.remove(spark.createDataFrame([("id0003",), ("id0055",), ("none",)], "id string"))
    now = df.where("id < 'id0050' and id <> 'id0003'").unionByName(other.where("id <> 'id0055'"))
    found = same(index, now, "the station", 30)
    assert index.cards().count() == 88 and index.cards(old).count() == 60
    terms = lambda: sorted(map(tuple, index.term_counts().where("field = 'title'").collect()))
    before = terms()
    index.compact()
    assert same(index, now, "the station", 30) == found and terms() == before and len(index.log.read()["segments"]) == 1
    # A reader of an older commit still has it.
    assert index.search("the", ["the"], 100, number=old).count() == len(same(si.SearchIndex(spark, str(tmp_path / "index")), now, "zzz", 5)) + search.search(search.searchable(df, fields()), "the", ["the"], 100).count()


def test_search_reads_its_buckets_alone(spark, tmp_path):
    index = si.SearchIndex(spark, str(tmp_path / "index"))
    index.append(cards(spark, 100), fields())
    state = index.log.read()
    read = {f.split("bucket=")[1].split("/")[0] for f in index._hits(state["segments"], ["station"]).inputFiles()}
    assert read <= {str(x) for x in si._buckets(["station", "stations"])} and len(state["segments"][0]["postings"]) > len(read)


def test_commits_are_created_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert (log.head(), log.read()) == (0, {})
    assert log.commit(0, {"a": 1}) == 1
    with pytest.raises(ConflictError):
        log.commit(0, {"a": 2})
    assert log.read()["a"] == 1 and not create_if_absent(spark, f"{log.folder}/000000000001.json", "{}")

    def writer(name):
        for k in range(5):
            log.update(lambda state: state | {"seen": [*state.get("seen", []), f"{name}{k}"]}, attempts=200)

    threads = [threading.Thread(target=writer, args=(x,)) for x in "xyz"]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert log.numbers() == list(range(1, 17)) and len(set(log.read()["seen"])) == 15
    assert [log.read(k)["base"] for k in log.numbers()] == list(range(16))
    assert not [x for x in (tmp_path / "log").iterdir() if x.name.startswith(".")]


def test_releases_conflict_roll_back_and_issues(spark, tmp_path):
    store = Releases(spark, str(tmp_path / "r"))
    one = spark.range(3)
    assert store.publish({"a": one, "b": one}) == 1
    assert store.publish({"a": spark.range(5)}, base=1) == 2
    # Another artifact may be made on an old release, the same one may not.
    assert store.publish({"b": spark.range(7)}, base=1) == 3
    with pytest.raises(ConflictError):
        store.publish({"a": spark.range(9)}, base=1)
    with pytest.raises(Exception, match="half way"):
        store.publish({"c": one, "d": one.select(F.raise_error(F.lit("half way")))})
    with pytest.raises(ValueError):
        store.publish({"../x": one})
    assert [store.table(x, n).count() for x, n in (("a", 1), ("a", None), ("b", 2), ("b", None))] == [3, 5, 3, 7]
    assert len(list((tmp_path / "r" / "staged").iterdir())) == 3 and store.log.head() == 3
    history = store.history()
    assert history.count() == 6 and release_issues(history, ("a", "b"), store.files()).count() == 0
    found = {tuple(r) for r in release_issues(history.where("number <> 2").withColumn("sha256", F.when((F.col("number") == 3) & (F.col("artifact") == "a"), F.lit("0" * 64)).otherwise(F.col("sha256"))), ("a", "c"), store.files()).collect()}
    assert found == {(3, "a", "sha256_differs"), (3, None, "number_gap"), (1, None, "artifact_missing:c"), (3, None, "artifact_missing:c")}
    assert len(store.vacuum(keep=1)) == 1 and store.table("a").count() == 5


def test_pointers_get_numbers_of_their_own(spark, tmp_path):
    root, numbers = str(tmp_path / "p"), []
    with pytest.raises(ValueError):
        release.current_release(spark, root)
    threads = [threading.Thread(target=lambda k=k: numbers.append(release.point_to(spark, root, f"v{k}"))) for k in range(6)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6] and release.point_to(spark, root, "last") == 7 and release.current_release(spark, root) == "last"


def test_deltas_follow_changes(spark, tmp_path):
    index = DeltaIndex(spark, str(tmp_path / "d"))
    make = lambda rows: spark.createDataFrame(rows, "id string, input_hash string, v int")
    keys = lambda df: sorted(map(tuple, df.select("id", "v").collect()))
    index.apply(make([("a", "1", 1), ("b", "1", 2), ("c", None, 3)]), batch=0)
    assert index.apply(make([("a", "9", 9)]), batch=0) == 1
    index.apply(make([("a", "1", 7), ("b", "2", 4), ("c", None, 8), ("d", "1", 5)]), batch=1)
    assert sorted(r["id"] for r in index.delta(2).collect()) == ["b", "d"]
    index.apply(make([("e", "1", 6)]), spark.createDataFrame([("a",), ("none",)], "id string"), batch=2)
    assert sorted((r["id"], r["_gone"]) for r in index.delta(3).collect()) == [("a", True), ("e", False)]
    want = [("b", 4), ("c", 3), ("d", 5), ("e", 6)]
    assert keys(index.read()) == want and keys(index.read(1)) == [("a", 1), ("b", 2), ("c", 3)]
    index.compact()
    assert keys(index.read()) == want and len(index.log.read()["deltas"]) == 1 and index.log.read()["batch"] == 2
    index.apply(make([("a", "1", 1)]), batch=3)
    assert keys(index.read()) == [("a", 1), *want]
