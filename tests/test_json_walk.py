"""The walk of nested JSON against a recursive one."""

import json
import random

from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from quillmesh.sources import json_walk

SF = "/root/testdata/sf0.001"


def nodes(x, path=()):
    yield path, x
    if isinstance(x, (dict, list)):
        for k, y in enumerate([x[n] for n in sorted(x)] if isinstance(x, dict) else x):
            yield from nodes(y, (*path, k))


def scalar(x):
    return None if isinstance(x, (dict, list)) or not x else ("true" if x is True else str(x))


def slow(text, limit):
    out = []
    for _, n in list(nodes(json.loads(text)))[:limit]:
        if isinstance(n, dict):
            inner = lambda a, b: n[a].get(b) if isinstance(n.get(a), dict) else None  # noqa: B023, E731
            key = scalar(n.get("id")) or scalar(n.get("pk")) or scalar(n.get("code"))
            name = scalar(n.get("username")) or scalar(inner("user", "username"))
            words = next((x for x in (n.get("text"), inner("caption", "text")) if isinstance(x, str) and x), None)
            if key and name and words:
                out.append((key, name, words, scalar(n.get("reply_to"))))
    return sorted(out, key=repr)


def make(rng, depth):
    pick = rng.random()
    if depth == 0 or pick < 0.25:
        return rng.choice([None, 0, 1, "", "x", "é漢", True, False, 12])
    if pick < 0.45:
        return [make(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    names = rng.sample(["id", "pk", "code", "username", "user", "text", "caption", "reply_to", "edges", "node"], rng.randint(1, 7))
    node = {n: make(rng, depth - 1) if rng.random() < 0.4 else rng.choice(["a", "b", 7, 0, ""]) for n in names}
    if rng.random() < 0.4:
        node |= {"user": {"username": "me"}, "caption": {"text": "hello"}, "pk": rng.randint(0, 3)}
    return node


def test_walk_is_the_recursive_one(spark):
    rng = random.Random(12)
    texts = {k: json.dumps(make(rng, 6)) for k in range(60)}
    rows = [*texts.items(), (100, "not json"), (101, None), (102, ""), (103, "{")]
    df = spark.createDataFrame(rows, "k int, j string").withColumns({x: F.lit(x) for x in ("path", "node", "_k", "_n")})
    for limit in (50_000, 25):
        got = {}
        for r in json_walk.posts_in(df, "k", "j", limit).collect():
            got.setdefault(r["k"], []).append(tuple(r)[1:])
        assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: s for k, t in texts.items() if (s := slow(t, limit))}
    assert sum(map(len, got.values())) > 5
    kept = json_walk.json_nodes(df, "k", "j", 10).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in kept} == {k: min(10, len(list(nodes(json.loads(t))))) for k, t in texts.items()}
    assert json_walk.posts_in(df.limit(0), "k", "j").count() == 0


def test_query_needs_no_python(spark):
    plan = entry_point.queries()["s12_json_walk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
