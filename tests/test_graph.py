"""Graph operators against brute force: long chains, merges, cycles, empty tables and trees of many files."""

import random

import pytest

from strandline.operators import graph as G

EDGES = "commit_id long, parent_index int, parent_id long"


def history(seed, n=120):
    """Edges of a history in which most commits have one parent, some several and a few none."""
    rng = random.Random(seed)
    out = []
    for c in range(1, n):
        parents = rng.sample(range(max(0, c - 6), c), min(c, rng.choice([0, 1, 1, 1, 1, 1, 2, 3])))
        out += [(c, i, p) for i, p in enumerate(parents)]
    return out


def values(n, edges, own):
    out = {}
    for c in range(n):
        out[c] = max([own[c], *(out[p] + 1 for a, _, p in edges if a == c)])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_values_and_reach(spark, seed):
    edges = history(seed)
    e = spark.createDataFrame(edges, EDGES)
    nodes = spark.range(120)
    assert {r["id"]: r["generation"] for r in G.generations(nodes, e).collect()} == values(120, edges, dict.fromkeys(range(120), 1))
    rng = random.Random(seed)
    times = {c: c // 3 + rng.randint(0, 9) for c in range(120)}
    t = spark.createDataFrame(list(times.items()), "id long, epoch long")
    assert {r["id"]: r["corrected"] for r in G.corrected_times(t, e).collect()} == values(120, edges, times)
    reach = {}
    for c in range(120):
        reach[c] = {c}.union(*(reach[p] for a, _, p in edges if a == c))
    seeds = spark.createDataFrame([(119,), (60,), (60,)], "id long")
    assert sorted(map(tuple, G.ancestors(e, seeds).collect())) == sorted((s, x) for s in (60, 119) for x in reach[s])
    assert {r["id"] for r in G.reachable(e, seeds).collect()} == reach[60] | reach[119]
    first = {a: p for a, i, p in edges if i == 0}
    want = []
    for s in (119, 60):
        at, depth = s, 0
        while at is not None:
            want.append((at, depth, s))
            at, depth = first.get(at), depth + 1
    assert sorted(map(tuple, G.first_parent_walk(e, seeds).collect())) == sorted(want)


def test_long_chain(spark):
    n = 50_000
    e = spark.range(1, n).selectExpr("id AS commit_id", "0 AS parent_index", "id - 1 AS parent_id")
    walk = G.first_parent_walk(e, spark.createDataFrame([(n - 1,)], "id long"))
    assert walk.count() == n and walk.filter("id != 49999 - depth").isEmpty()
    made = G.generations(spark.range(n), e)
    assert made.count() == n and made.filter("generation != id + 1").isEmpty()


def test_nothing_and_cycles(spark):
    none, nobody = spark.createDataFrame([], EDGES), spark.createDataFrame([], "id long")
    assert G.generations(nobody, none).collect() == [] and G.first_parent_walk(none, nobody).collect() == [] and G.ancestors(none, nobody).collect() == []
    assert [tuple(r) for r in G.generations(spark.range(2), none).orderBy("id").collect()] == [(0, 1), (1, 1)]
    ring = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (2, 0, 0)], EDGES)
    for f in (lambda: G.generations(spark.range(3), ring), lambda: G.first_parent_walk(ring, spark.range(1))):
        with pytest.raises(ValueError, match="cycle"):
            f()
    refs = spark.createDataFrame([("a", None, "b"), ("b", None, "c"), ("c", "1", None), ("x", None, "y"), ("y", None, "x"), ("z", None, "gone")], "name string, id string, symbolic_target string")
    assert {r["name"]: r["id"] for r in G.resolve_references(refs).collect()} == {"a": "1", "b": "1", "c": "1", "x": None, "y": None, "z": None}
    long = spark.range(3000).selectExpr("concat('r', id) AS name", "CASE WHEN id = 0 THEN 'top' END AS id", "CASE WHEN id > 0 THEN concat('r', id - 1) END AS symbolic_target")
    assert G.resolve_references(long).filter("id = 'top'").count() == 3000


def test_trees(spark):
    entries = spark.range(1_200_000).selectExpr("concat('d', id % 40) AS tree_id", "concat('f', id) AS name", "33188 AS mode", "concat('o', id) AS object_id")
    folders = spark.range(40).selectExpr("'top' AS tree_id", "concat('n', id) AS name", "16384 AS mode", "concat('d', id) AS object_id")
    top = spark.createDataFrame([("top",)], "tree_id string")
    out = G.flatten_tree(folders.unionByName(entries), top)
    assert out.count() == 1_200_000 and out.filter("path != concat('n', CAST(substring(object_id, 2) AS BIGINT) % 40, '/', name)").isEmpty()
    deep = spark.range(150).selectExpr("concat('t', id) AS tree_id", "concat('x', id) AS name", "CASE WHEN id < 149 THEN 16384 ELSE 33188 END AS mode", "concat('t', id + 1) AS object_id")
    found = G.flatten_tree(deep, deep.filter("tree_id = 't0'").select("tree_id")).collect()
    assert [r["path"] for r in found] == ["/".join(f"x{i}" for i in range(150))]
    assert G.flatten_tree(deep.limit(0), top).collect() == []
    ring = spark.createDataFrame([("a", "x", 16384, "b"), ("b", "y", 16384, "a")], "tree_id string, name string, mode int, object_id string")
    with pytest.raises(ValueError, match="itself"):
        G.flatten_tree(ring, spark.createDataFrame([("a",)], "tree_id string"))
