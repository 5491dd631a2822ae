"""Files from landed git objects, with objects that are cut off, missing or wrong."""

import base64
import hashlib
import json
import random

from quillmesh.sources import git_store


def _sha(x):
    return hashlib.sha1(str(x).encode()).hexdigest()


def _blob(text, **other):
    data = text if isinstance(text, bytes) else text.encode()
    return json.dumps({"encoding": "base64", "content": base64.encodebytes(data).decode(), "size": len(data)} | other)


def _commit(tree, **other):
    return json.dumps({"sha": _sha("commit" + tree).upper(), "commit": {"tree": {"sha": _sha(tree)}}, "parents": [{"sha": _sha("p")}, {"sha": "no"}, {}]} | other)


def _tree(*files, **other):
    return json.dumps({"truncated": False, "tree": [{"path": p, "type": t, "sha": s} for p, t, s in files]} | other)


def _store(spark, commits, trees, blobs):
    return (
        spark.createDataFrame(commits, "repo string, ref string, payload string"),
        spark.createDataFrame(trees, "sha string, payload string"),
        spark.createDataFrame(blobs, "sha string, payload string"),
    )


def test_each_fault_is_a_row(spark):
    commits = [("r", "main", _commit("t")), ("r", "same", _commit("t")), ("cut", "main", _commit("c")), ("lost", "main", _commit("x")), ("odd", "main", _commit("o")), ("bad", "main", "{}"), ("none", "main", None)]
    entries = [("content/a.md", "blob", _sha(1)), ("content", "tree", _sha(2)), ("content/b.md", "blob", _sha(3)), ("content/c.md", "blob", _sha(4)), ("content/d.md", "blob", _sha(5)), ("content/e.md", "blob", _sha(6)), ("content/f.md", "blob", _sha(7)), ("content/g.md", "blob", _sha(8)), ("notes/a.md", "blob", _sha(1)), ("content/h.md", "blob", _sha(9)), ("content/h.md", "blob", _sha(1))]
    trees = [(_sha("t"), _tree(*entries)), (_sha("t"), _tree(*entries)), (_sha("c"), _tree(*entries, truncated=True)), (_sha("o"), json.dumps({"tree": "no list"}))]
    blobs = [(_sha(1), _blob("é one\n" * 40)), (_sha(1), "broken"), (_sha(1), _blob("é one\n" * 40)), (_sha(3), _blob("x" * 400)), (_sha(4), _blob("four", size=5)), (_sha(5), _blob("five", encoding="utf-8")), (_sha(6), _blob(b"\xff\xfe")), (_sha(7), None)]
    found = git_store.files(*_store(spark, commits, trees, blobs), r"content/[^/]+\.md", 300).collect()
    got = {(r.repo, r.path): (r.bytes, r.text, r.error) for r in found}
    assert len(found) == len(got) == 13
    one = "é one\n" * 40
    assert got == {
        ("r", "content/a.md"): (280, one, None), ("r", "content/h.md"): (280, one, None), ("r", "content/b.md"): (400, None, "blob_too_large"), ("r", "content/c.md"): (5, None, "blob_size_differs"),
        ("r", "content/d.md"): (4, None, "blob_invalid"), ("r", "content/e.md"): (2, None, "blob_invalid"), ("r", "content/f.md"): (None, None, "blob_invalid"), ("r", "content/g.md"): (None, None, "blob_missing"),
        ("cut", None): (None, None, "tree_truncated"), ("lost", None): (None, None, "tree_missing"), ("odd", None): (None, None, "tree_invalid"), ("bad", None): (None, None, "revision_invalid"), ("none", None): (None, None, "revision_invalid"),
    }
    assert {r.parents[0] for r in git_store.revisions(_store(spark, commits, trees, blobs)[0]).where("repo = 'r'").collect()} == {_sha("p")}


def test_one_content_of_very_many_paths(spark):
    rng = random.Random(3)
    files = [(f"d/{k}.md", "blob", _sha(0 if rng.random() < 0.5 else k)) for k in range(500)]
    blobs = [(_sha(k), _blob(f"text {k}" if k else "")) for k in range(500)]
    found = git_store.files(*_store(spark, [("r", "main", _commit("t"))], [(_sha("t"), _tree(*files))], blobs)).collect()
    words = {_sha(k): f"text {k}" if k else "" for k in range(500)}
    assert sorted((r.path, r.text) for r in found) == sorted((p, words[s]) for p, _, s in files)


def test_empty_store(spark):
    assert git_store.files(*_store(spark, [], [], [])).count() == 0
