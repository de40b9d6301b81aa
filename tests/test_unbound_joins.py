"""Joins on variables that may be unbound, against brute force over solutions."""

import random

import pytest

from loomgraph.plans.compile import Compiler
from loomgraph.sources.catalog import VirtualGraph


def values(names, rows):
    return f"VALUES ({' '.join('?' + n for n in names)}) {{ {' '.join('(' + ' '.join('UNDEF' if x is None else str(x) for x in r) + ')' for r in rows)} }}"


def compatible(a, b):
    return all(a[k] == b[k] for k in a.keys() & b.keys())


def solutions(names, rows):
    return [{n: x for n, x in zip(names, r) if x is not None} for r in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pick = lambda least: rng.choice([None, 1, 2, 3][least:])
    left = [(i, pick(0), pick(0)) for i in range(6)]
    right = [(pick(0), pick(0), 10 + i) for i in range(5)]
    a, b = solutions("xyz", left), solutions("yzw", right)
    l, r = values("xyz", left), values("yzw", right)
    c = Compiler(VirtualGraph(spark, []))

    def got(pattern, names="xyzw"):
        rows = c.query(f"SELECT {' '.join('?' + n for n in names)} WHERE {{ {pattern} }}").collect()
        return sorted((tuple(x) for x in rows), key=repr)

    def want(rows, names="xyzw"):
        return sorted((tuple(s.get(n) for n in names) for s in rows), key=repr)

    assert got(f"{l} {r}") == want([{**x, **y} for x in a for y in b if compatible(x, y)])
    assert got(f"{l} OPTIONAL {{ {r} }}") == want([s for x in a for s in ([{**x, **y} for y in b if compatible(x, y)] or [x])])
    assert got(f"{l} MINUS {{ {r} }}", "xyz") == want([x for x in a if not any(compatible(x, y) and x.keys() & y.keys() for y in b)], "xyz")
    assert got(f"{l} FILTER EXISTS {{ {r} }}", "xyz") == want([x for x in a if any(compatible(x, y) for y in b)], "xyz")
    assert got(f"{l} FILTER NOT EXISTS {{ {r} }}", "xyz") == want([x for x in a if not any(compatible(x, y) for y in b)], "xyz")


def test_no_nested_loop_after_optional(spark, sf):
    from loomgraph.sources.catalog import standard_graph

    text = "SELECT ?d ?q ?e WHERE { ?d a ex:Document OPTIONAL { ?d ex:quality ?q } ?e ex:toxic ?q }"
    plan = Compiler(standard_graph(spark, sf)).query(text)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
