"""Lowering against a brute-force matcher on random small graphs."""

import itertools
import random

import pytest

from trailweave.session import query
from trailweave.sources.graph import Edges, Graph, Vertices

DIRECTIONS = {"<-[e:R]-": "I", "-[e:R]->": "O", "~[e:R]~": "S", "<~[e:R]~": "SI", "~[e:R]~>": "OS", "<-[e:R]->": "OI", "-[e:R]-": "OSI"}


def graph(spark, seed):
    rnd = random.Random(seed)
    nodes = [(i, rnd.choice([1, 2, None])) for i in range(6)]
    edges = [(f"e{k}", rnd.randrange(6), rnd.randrange(6), rnd.random() < 0.5) for k in range(9)]
    directed = [e[:3] for e in edges if e[3]]
    simple = [e[:3] for e in edges if not e[3]]
    vertices = spark.createDataFrame(nodes, "id long, k long")
    schema = "eid string, src long, dst long"

    class Mixed(Graph):
        def edge_choice(self, label):
            return super().edge_choice(None) if label == "R" else []

        def ends(self, label):
            return ("N", "N")

    made = Mixed(spark, [Vertices("N", vertices)], [Edges("D", spark.createDataFrame(directed, schema)), Edges("U", spark.createDataFrame(simple, schema), directed=False)])
    return made, dict(nodes), edges


def adjacency(edges, parts):
    out = []
    for name, a, b, directed in edges:
        if directed:
            out += [(a, b, name)] * ("O" in parts) + [(b, a, name)] * ("I" in parts)
        elif "S" in parts:
            out += [(a, b, name)] + [(b, a, name)] * (a != b)
    return out


def walks(nodes, adj, low, high, trail):
    found = []
    for start in nodes:
        level = [(start, ())]
        for depth in range(high + 1):
            if depth >= low:
                found += [(start, end, path) for end, path in level]
            level = [(v, (*path, e)) for end, path in level for u, v, e in adj if u == end and not (trail and e in path)]
    return found


@pytest.mark.parametrize("arrow", DIRECTIONS)
def test_steps_and_repeats(spark, arrow):
    for seed in (1, 2):
        made, nodes, edges = graph(spark, seed)
        adj = adjacency(edges, DIRECTIONS[arrow])
        got = query(made, f"MATCH (a:N){arrow}(b:N {{k: a.k}}) RETURN a.k AS x, b.k AS y, COUNT(*) AS n").collect()
        want = {}
        for u, v, _ in adj:
            if nodes[u] == nodes[v]:
                want[nodes[u], nodes[v]] = want.get((nodes[u], nodes[v]), 0) + 1
        assert {(r.x, r.y): r.n for r in got} == want
        for (low, high), trail in itertools.product([(0, 2), (1, 3)], (True, False)):
            mode = "TRAIL" if trail else "WALK"
            r = query(made, f"MATCH {mode} (a:N){arrow}{{{low},{high}}}(b:N) RETURN a, b, e").select("a.id", "b.id", "e").collect()
            from trailweave.session import id_text
            from pyspark.sql import functions as F

            names = {x.t: x.id for x in spark.range(6).select("id", id_text(F.col("id")).alias("t")).collect()}
            assert sorted((names[x[0]], names[x[1]], tuple(x[2])) for x in r) == sorted(walks(nodes, adj, low, high, trail))


def test_bag_semantics_of_optional_and_predicates(spark):
    made, nodes, edges = graph(spark, 5)
    out = adjacency(edges, "O")
    got = query(made, "MATCH (a:N)-[:R]-(b:N) WITH a.k AS k, b AS b OPTIONAL MATCH (b)-[:R]->(c:N) WHERE c.k = k RETURN k, c.k AS ck, COUNT(*) AS n").collect()
    want = {}
    for u, v, _ in adjacency(edges, "OSI"):
        hits = [nodes[w] for x, w, _ in out if x == v and nodes[w] == nodes[u]]
        for h in hits or ["none"]:
            key = (nodes[u], None if h == "none" else h)
            want[key] = want.get(key, 0) + 1
    assert {(r.k, r.ck): r.n for r in got} == want
    with_out = query(made, "MATCH (a:N) WHERE (a)-[:R]->() RETURN COUNT(*) AS n").collect()[0].n
    without = query(made, "MATCH (a:N) WHERE NOT (a)-[:R]->() RETURN COUNT(*) AS n").collect()[0].n
    assert with_out == len({u for u, _, _ in out}) and with_out + without == 6


def test_quantifier_left_of_the_anchor(spark):
    made, nodes, edges = graph(spark, 7)
    got = query(made, "MATCH (z:N {k: 1}) MATCH (a:N)-[e:R]->{1,2}(z) RETURN COUNT(*) AS n").collect()[0].n
    assert got == sum(nodes[end] == 1 for _, end, _ in walks(nodes, adjacency(edges, "O"), 1, 2, False))
