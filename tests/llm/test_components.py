import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparkloom.llm.components import connected_groups


def groups(edges):
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def run(spark, edges):
    return {r.vertex: r.group for r in connected_groups(spark.createDataFrame(edges, "a string, b string")).collect()}


def test_shapes(spark):
    rng = random.Random(5)
    edges = [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("hub", f"l{i}") for i in range(300)] + [(f"c{i}", f"c{(i + 1) % 31}") for i in range(31)]
    edges += [(f"d{rng.randrange(40)}", f"d{rng.randrange(40)}") for _ in range(200)] + [("x", "x"), (None, "y"), ("m", "n"), ("n", "m"), ("m", "n")]
    rng.shuffle(edges)
    assert run(spark, edges) == groups(edges)


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [("a", "a"), (None, None)]) == {}


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdefghijkl"), st.sampled_from("abcdefghijkl")), max_size=14))
def test_any_graph(spark, edges):
    assert run(spark, edges) == groups(edges)


def test_query(spark, sf):
    from sparkloom.llm.queries import QUERIES

    rows = QUERIES["p2_found"](spark, sf).collect()
    least: dict = {}
    for r in rows:
        least[r.group_claim_id] = min(least.get(r.group_claim_id, r.claim_id), r.claim_id)
    assert rows and all(k == v for k, v in least.items()) and len({r.claim_id for r in rows}) == len(rows)


@pytest.mark.parametrize("size", [3, 9])
def test_ties_and_extra_columns(spark, size):
    df = spark.createDataFrame([(f"k{i}", f"k{i % size}", "z") for i in range(size * 2)], "a string, b string, vertex string")
    got = {r.vertex: r.group for r in connected_groups(df).collect()}
    assert got == groups([(f"k{i}", f"k{i % size}") for i in range(size * 2)])
