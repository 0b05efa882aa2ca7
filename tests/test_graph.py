import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from marlstone.operators import graph

# A toy hierarchy, in order of insertion, and its labelled nodes.
TOY = """entity object, object organism, organism animal, animal canine, canine dog, organism pet, pet dog, dog hound,
object artifact, artifact chair, artifact toy, toy toy_dog, canine wolf, object water, water river"""
EDGES = [(*e.split(), i) for i, e in enumerate(TOY.replace("\n", " ").split(", "))]
LABELLED = ["dog", "chair", "river", "toy"]
NEAREST = {
    "animal": [None, None, ("dog", 2), ("dog", 2)], "artifact": [None, ("chair", 1), ("chair", 1), ("chair", 1)],
    "canine": [None, ("dog", 1), ("dog", 1), ("dog", 1)], "chair": [("chair", 0)] * 4, "dog": [("dog", 0)] * 4,
    "entity": [None, None, None, ("chair", 3)], "hound": [None, ("dog", 1), ("dog", 1), ("dog", 1)],
    "object": [None, None, ("chair", 2), ("chair", 2)], "organism": [None, None, ("dog", 2), ("dog", 2)],
    "pet": [None, ("dog", 1), ("dog", 1), ("dog", 1)], "river": [("river", 0)] * 4, "toy": [("toy", 0)] * 4,
    "toy_dog": [None, ("toy", 1), ("toy", 1), ("toy", 1)], "water": [None, ("river", 1), ("river", 1), ("river", 1)],
    "wolf": [None, None, ("dog", 2), ("dog", 2)],
}


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "parent string, child string, edge_seq long")


@pytest.fixture(scope="module")
def closure(edges):
    return graph.ancestor_closure(edges).cache()


def _labels(spark, nodes):
    return spark.createDataFrame([(n, True, "biotic") for n in nodes], "node string, is_nature boolean, life_category string")


@pytest.mark.parametrize("hops", [0, 1, 2, 3])
def test_nearest_toy(spark, edges, hops):
    sources = spark.createDataFrame([(n,) for n in NEAREST], "node string")
    got = {r.node: (r.resolved_node, r.hops) for r in graph.nearest_labels(sources, edges, _labels(spark, LABELLED), hops).collect()}
    assert got == {n: v[hops] for n, v in NEAREST.items() if v[hops]}


def _bfs(edges, labelled, start, hops):
    up, down = {}, {}
    for p, c, _ in edges:
        up.setdefault(c, []).append(p)
        down.setdefault(p, []).append(c)
    queue, seen = deque([(start, 0)]), {start}
    while queue:
        n, h = queue.popleft()
        if n in labelled:
            return n, h
        if h < hops:
            for m in up.get(n, []) + down.get(n, []):
                if m not in seen:
                    seen.add(m)
                    queue.append((m, h + 1))
    return None


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_random(spark, seed):
    rnd = random.Random(seed)
    edges = [(f"v{rnd.randrange(i)}", f"v{i}") for i in range(1, 60)] + [(f"v{a}", f"v{b}") for a, b in (sorted(rnd.sample(range(60), 2)) for _ in range(25))]
    edges = [(p, c, i) for i, (p, c) in enumerate(dict.fromkeys(edges))]
    labelled = {f"v{i}" for i in rnd.sample(range(60), 8)}
    sources = spark.createDataFrame([(f"v{i}",) for i in range(60)], "node string")
    out = graph.nearest_labels(sources, spark.createDataFrame(edges, "parent string, child string, edge_seq long"), _labels(spark, labelled), 3)
    got = {r.node: (r.resolved_node, r.hops) for r in out.collect()}
    assert got == {f"v{i}": w for i in range(60) if (w := _bfs(edges, labelled, f"v{i}", 3))}


def test_hierarchical_metrics(spark, closure):
    pairs = [("hound", "dog"), ("dog", "hound"), ("dog", "wolf"), ("dog", "chair"), ("dog", "dog"), ("river", "chair"), ("hound", "entity"), ("dog", None), ("dog", "no_such")]
    rows = spark.createDataFrame(pairs, "true_node string, pred_node string")
    got = {(r.true_node, r.pred_node): (r.hp, r.hr, r.hf1) for r in graph.hierarchical_metrics(rows, graph.closure_arrays(closure)).collect()}
    expected = {("hound", "dog"): (1, 0.875, 0.933333), ("dog", "hound"): (0.875, 1, 0.933333), ("dog", "wolf"): (0.833333, 0.714286, 0.769231), ("dog", "chair"): (0.5, 0.285714, 0.363636), ("dog", "dog"): (1, 1, 1), ("river", "chair"): (0.5, 0.5, 0.5), ("hound", "entity"): (1, 0.125, 0.222222), ("dog", None): (0, 0, 0), ("dog", "no_such"): (0, 0, 0)}
    for k, v in expected.items():
        assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(got[k], v, strict=True)), k


def test_wu_palmer(spark, closure):
    expected = {("hound", "dog"): ("canine", 0.769231), ("dog", "hound"): ("dog", 0.923077), ("dog", "wolf"): ("canine", 0.833333), ("dog", "chair"): ("object", 0.444444), ("river", "chair"): ("object", 0.5)}
    rows = spark.createDataFrame([*expected, ("dog", None)], "node_a string, node_b string")
    got = {(r.node_a, r.node_b): (r.lcs, r.wup) for r in graph.wu_palmer(rows, closure, "entity").collect()}
    for k in (("dog", "wolf"), ("dog", "chair"), ("river", "chair")):
        assert got[k][0] == expected[k][0] and math.isclose(got[k][1], expected[k][1], abs_tol=1e-6)
    assert got[("dog", None)] == (None, 0.0)


def test_root_and_nulls(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("c", "d", 2)], "parent string, child string, edge_seq long")
    rooted = graph.with_root(edges, "entity")
    got = graph.ancestor_closure(rooted, spark.createDataFrame([("d",), (None,), ("x",)], "node string")).collect()
    assert {(r.node, r.ancestor, r.max_depth) for r in got} == {("d", "d", 0), ("d", "c", 1), ("d", "entity", 2), ("x", "x", 0)}
    assert graph.ancestor_closure(edges.limit(0)).count() == 0


def test_annotations(spark):
    rows = [(1, "n", "Biotic", "material"), (2, "n", None, None), (3, "m", " ", "immaterial"), (4, "n", "abiotic", None), (5, None, "x", "y")]
    df = spark.createDataFrame(rows, "seq long, node string, life string, tang string")
    got = {r.node: (r.is_nature, r.life_category, r.tangibility) for r in graph.annotations(df, "node", "life", "tang", "seq").collect()}
    assert got == {"n": (False, "abiotic", "material"), "m": (True, None, "immaterial")}
    assert [tuple(r) for r in graph.annotation_conflicts(df, "node", "life", "seq").collect()] == [("n", 4, "biotic", "abiotic")]


def test_node_in_row(spark):
    rows = [("a (x.n.01)", "dog (dog.n.01)", None, "z.n.1"), (None, "b.n.1", None, None), ("st._bernard.n.01", None, None, None), ("plain", None, None, None), ("a.n.1", "b.n.2", "c.n.3", "d.n.4")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    got = [r[0] for r in df.select(graph.node_in_row([F.col(c) for c in df.columns])).collect()]
    assert got == ["dog.n.01", None, "_bernard.n.01", None, "d.n.4"]


def test_resolve_text(spark):
    cand = spark.createDataFrame([(1, 0, "Dog house", 0.9, "k"), (2, 0, "zebra", 0.5, "k"), (3, 0, "low", -1.0, "k"), (4, 0, "mutt", 0.2, "k")], "id int, idx int, text string, score double, pred_node string")
    senses = spark.createDataFrame([("dog_house", 1, "p"), ("dog_house", 2, "q"), ("low", 1, "p")], "word string, rank int, node string")
    sim = spark.createDataFrame([("p", "k", 0.5), ("q", "k", 0.5)], "node string, pred_node string, wup double")
    same = spark.createDataFrame([("mutt",)], "word string")
    got = {r.id: r.node for r in graph.resolve_text(cand, senses, sim, same).collect()}
    assert got == {1: "p", 4: "k"}


def test_closure_of_a_cycle(spark):
    """Cycles have no greatest depth: they raise, at or above the nodes asked for."""
    def edges(pairs):
        return spark.createDataFrame([(p, c, 0) for c, p in pairs], "parent string, child string, edge_seq long")

    two = edges([("a", "b"), ("b", "a"), ("x", "a")])
    for nodes in (None, spark.createDataFrame([("x",)], "node string")):
        with pytest.raises(ValueError, match="own ancestor"):
            graph.ancestor_closure(two, nodes)
    chain = edges([(f"n{i}", f"n{i + 1}") for i in range(40)])
    got = {r.ancestor: (r.min_depth, r.max_depth) for r in graph.ancestor_closure(chain, spark.createDataFrame([("n0",)], "node string")).collect()}
    assert got == {f"n{i}": (i, i) for i in range(41)}


def test_nearest_label_in_a_star(spark, monkeypatch):
    """10,000 leaves of a hub: a hop writes a row a node, never a row a pair."""
    n = 10_000
    edges = spark.range(n).selectExpr("'hub' AS parent", "concat('leaf', id) AS child", "id AS edge_seq")
    labels = spark.createDataFrame([("leaf7", True, "biotic", None), ("leaf3", False, None, None)], "node string, is_nature boolean, life_category string, tangibility string")
    written = []
    real = graph.cut

    def counted(df, label):
        out = real(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    nodes = edges.selectExpr("child AS node").unionByName(spark.createDataFrame([("hub",)], "node string"))
    got = {r.node: (r.resolved_node, r.hops) for r in graph.nearest_labels(nodes, edges, labels, 3).collect()}
    assert len(got) == n + 1 and sum(written) <= n + 1
    assert got["leaf7"] == ("leaf7", 0) and got["leaf3"] == ("leaf3", 0)
    assert got["hub"] == ("leaf3", 1) and got["leaf0"] == ("leaf3", 2)  # the smaller edge_seq is met first


def test_nearest_label_against_search(spark):
    """Random graphs against a plain breadth-first search."""
    rnd = random.Random(5)
    for _ in range(3):
        pairs = sorted({(rnd.randrange(30), rnd.randrange(30)) for _ in range(40)})
        pairs = [(a, b) for a, b in pairs if a != b]
        order = rnd.sample(range(1000), len(pairs))
        rows = [(f"v{a}", f"v{b}", s) for (a, b), s in zip(pairs, order, strict=True)]
        known = {f"v{i}" for i in rnd.sample(range(30), 5)}
        near = {}
        for a, b, s in rows:
            near.setdefault(b, []).append((0, s, a))
            near.setdefault(a, []).append((1, s, b))
        plain = {}
        for start in near:
            seen, queue = {start}, deque([(start, 0)])
            while queue:
                node, hop = queue.popleft()
                if node in known:
                    plain[start] = (node, hop)
                    break
                if hop < 3:
                    for _, _, x in sorted(near[node]):
                        if x not in seen:
                            seen.add(x)
                            queue.append((x, hop + 1))
        edges = spark.createDataFrame(rows, "parent string, child string, edge_seq long")
        labels = spark.createDataFrame([(k, True) for k in known], "node string, is_nature boolean")
        nodes = spark.createDataFrame([(k,) for k in near], "node string")
        got = {r.node: (r.resolved_node, r.hops) for r in graph.nearest_labels(nodes, edges, labels, 3).collect()}
        assert got == plain
