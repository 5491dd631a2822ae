"""The walk of all trees in rounds against a walk of one tree with a heap."""

import random
from heapq import heappop, heappush

import pytest

from quillmesh.operators import ingest


def walk(children, limits):
    waiting, found, stops, trees, entries = [(0, 0, "")], [], [], 0, 0
    while waiting:
        if trees >= limits["trees"]:
            return found, [*stops, "tree_budget"]
        _, depth, at = heappop(waiting)
        trees += 1
        for path, is_folder, priority in sorted(children.get(at, ())):
            if entries >= limits["entries"]:
                return found, [*stops, "entry_budget"]
            entries += 1
            if not is_folder:
                if len(found) >= limits["candidates"]:
                    return found, [*stops, "candidate_budget"]
                found.append(path)
            elif set(path.split("/")) & set(ingest.SKIPPED_FOLDERS):
                continue
            elif depth + 1 > limits["depth"]:
                stops += ["depth_limit"] * ("depth_limit" not in stops)
            else:
                heappush(waiting, (priority, depth + 1, path))
    return found, stops


def tree(rng, repo):
    rows, folders = [], [""]
    for _ in range(rng.randint(5, 60)):
        parent = rng.choice(folders)
        is_folder = rng.random() < 0.4
        name = rng.choice(["docs", "src", "a", "b", "build", "test", "tmp"]) if is_folder else f"f{rng.randint(0, 99)}.md"
        path = f"{parent}/{name}".strip("/")
        if path not in {r[2] for r in rows}:
            rows.append((repo, parent, path, is_folder, rng.choice([0, 1, 4, 8])))
            folders += [path] * is_folder
    return rows


@pytest.mark.parametrize("limits", [ingest.WALK, {"trees": 4, "entries": 15, "candidates": 6, "depth": 2}, {"trees": 1, "entries": 4000, "candidates": 500, "depth": 1}])
def test_rounds_are_the_walk(spark, limits):
    rng = random.Random(8)
    rows = [r for k in range(25) for r in tree(rng, f"repo{k}")]
    df = spark.createDataFrame(rows, "repo string, parent string, path string, is_folder boolean, priority int")
    got = {}
    for r in ingest.discover(df, limits).orderBy("repo", "place").collect():
        got.setdefault(r["repo"], ([], r["stops"]))[0].append(r["path"])
    for repo in {r[0] for r in rows}:
        children = {}
        for _, parent, path, is_folder, priority in (r for r in rows if r[0] == repo):
            children.setdefault(parent, []).append((path, is_folder, priority))
        found, stops = walk(children, limits)
        assert got.get(repo, ([], ",".join(stops) if not found else None)) == (found, ",".join(stops)), repo
    assert ingest.discover(df.limit(0)).count() == 0


def test_one_folder_of_very_many_files(spark):
    rows = spark.range(20_000).selectExpr("'r' AS repo", "'' AS parent", "concat('f', lpad(id, 6, '0')) AS path", "false AS is_folder", "8 AS priority")
    got = ingest.discover(rows).collect()
    assert len(got) == 500 and {r["stops"] for r in got} == {"candidate_budget"} and min(r["path"] for r in got) == "f000000"
