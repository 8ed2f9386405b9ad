import random
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from skein.operators import community, graph


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def union_find(pairs, nodes=()):
    parent = {x: x for p in pairs for x in p} | {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return sorted((x, root(x)) for x in parent)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_random(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randint(0, 120)}", f"n{rng.randint(0, 120)}") for _ in range(90)]
    pairs += [(f"p{i}", f"p{i + 1}") for i in range(40)] + [("hub", f"h{i}") for i in range(50)]
    nodes = spark.createDataFrame([("alone",), ("p3",)], "name string")
    want = [x for x in union_find([p for p in pairs if p[0] != p[1]], ["alone"])]
    assert rows(graph.connected_components(edges(spark, pairs + pairs[:9]), nodes), "node", "component") == sorted(want, key=repr)


def test_components_empty(spark):
    assert rows(graph.connected_components(edges(spark, []))) == []
    assert rows(graph.largest_component(graph.connected_components(edges(spark, [])))) == []


def test_edges_of_edge_cases(spark):
    s = spark.createDataFrame([("a", ["b", "b", "a", "", None, "c"]), ("", ["b"]), (None, ["b"]), ("d", []), ("e", None), ("", [])], "name string, premises array<string>")
    assert rows(graph.edges_of(s.where("name <> ''"))) == [("a", "b"), ("a", "c")]


def test_node_precedence_and_in_degree(spark):
    corpus = spark.createDataFrame([("a", "old"), ("b", None)], "name string, file_path string")
    theorems = spark.createDataFrame([("a", "new")], "name string, file_path string")
    premises = spark.createDataFrame([("a",), ("z",)], "name string")
    nodes = graph.node_union(corpus, theorems, premises)
    assert rows(nodes) == [("a", "new"), ("b", ""), ("z", "")]
    assert rows(graph.in_degrees(nodes, edges(spark, [("b", "a"), ("z", "a")]))) == [("a", 2), ("b", 0), ("z", 0)]


def cliques(k, size, prefix="c"):
    return [(f"{prefix}{c}_{i}", f"{prefix}{c}_{j}") for c in range(k) for i in range(size) for j in range(i)]


def ring(k, size):
    return cliques(k, size) + [(f"c{c}_0", f"c{(c + 1) % k}_1") for c in range(k)]


def members(df, key="cid"):
    out = defaultdict(set)
    for r in df.collect():
        out[r[key]].add(r["name"])
    return sorted(map(frozenset, out.values()), key=sorted)


def test_leiden_finds_ring_of_cliques(spark):
    found = community.communities(edges(spark, ring(8, 6) + cliques(1, 4, "other")))
    assert members(found) == sorted((frozenset(f"c{c}_{i}" for i in range(6)) for c in range(8)), key=sorted)
    assert rows(found) == rows(community.communities(edges(spark, list(reversed(ring(8, 6) + cliques(1, 4, "other"))))))


def test_coarsened_communities_are_connected_and_good(spark):
    pairs = ring(12, 7)
    whole = community.communities(edges(spark, pairs))
    small = community.communities(edges(spark, pairs), local_edges=60)
    assert sorted(r["name"] for r in small.collect()) == sorted(r["name"] for r in whole.collect())
    for group in members(small):
        inside = [p for p in pairs if set(p) <= group]
        assert len({r for _, r in union_find(inside, group)}) == 1
    q = [community.modularity(graph.undirected_edges(edges(spark, pairs)), g).first()[0] for g in (whole, small)]
    assert q[1] >= 0.97 * q[0] > 0.7


def test_modularity_bounds_and_value(spark):
    pairs = cliques(2, 3) + [("c0_0", "c1_0")]
    both = spark.createDataFrame([(n, int(n[1])) for n in {x for p in pairs for x in p}], "name string, cid int")
    assert abs(community.modularity(graph.undirected_edges(edges(spark, pairs)), both).first()[0] - (6 / 7 - 2 * (7 / 14) ** 2)) < 1e-12


def test_sub_communities(spark):
    pairs = cliques(2, 6, "a") + [("a0_0", "a1_0"), ("x", "y")] + cliques(1, 4, "b")
    names = sorted({x for p in pairs for x in p} | {"lone"})
    groups = spark.createDataFrame([(n, 1 if n[0] == "b" else 0) for n in names], "name string, cid int")
    found = {r["name"]: (r["top"], r["sub"]) for r in community.sub_communities(edges(spark, pairs), groups, least_size=4).collect()}
    assert found["x"] == found["lone"] == (0, -1) and {found[f"b0_{i}"] for i in range(4)} == {(1, 0)}
    assert {found[f"a0_{i}"] for i in range(6)} in ({(0, 0)}, {(0, 1)}) and found["a0_1"] != found["a1_1"]
    assert not community.sub_communities(edges(spark, pairs), groups, least_size=1000).count()


def test_leiden_small_graphs():
    assert community.leiden(0, [], [], []) == []
    assert community.leiden(1, [], [], []) == [0]
    assert community.leiden(2, [0], [1], [1.0]) == [0, 0]
    loop = community.leiden(3, [0, 0, 1], [0, 1, 2], [5.0, 1.0, 1.0])
    assert len(loop) == 3 and set(loop) <= {0, 1, 2}


def test_component_flags(spark):
    groups = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2)], "name string, cid int")
    made = graph.component_flags(edges(spark, [("a", "b"), ("b", "d")]), groups, 2)
    assert rows(made, "cid", "name", "in_lcc", "splittable") == [(1, "a", True, True), (1, "b", True, True), (1, "c", False, True), (2, "d", True, False)]
    assert made.where(F.col("cid") == 1).count() == 3


def test_written_tables_are_dropped(spark):
    from skein.sources import shared

    shared.drop_written(spark)
    assert shared.written(spark.range(3)).count() == 3
    assert shared.drop_written(spark) == 1 and shared.drop_written(spark) == 0
