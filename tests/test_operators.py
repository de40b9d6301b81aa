import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import geo, overlay, reason, search, validate
from loomgraph.operators import graph as G
from loomgraph.operators import paths as P
from loomgraph.plans import graphql
from loomgraph.plans.lanes import RDF, XSD
from loomgraph.sources import rdf
from loomgraph.sources.catalog import standard_graph
from loomgraph.streaming import live as Z


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(7)
    pairs = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(34)} | {(20, 21), (21, 20)})
    return pairs, spark.createDataFrame([(a, b, float((a * 3 + b) % 5 + 1)) for a, b in pairs], "src long, dst long, weight double")


def reach(pairs, s):
    seen, todo = {s}, [s]
    while todo:
        x = todo.pop()
        for a, b in pairs:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_graph_algorithms(edges):
    pairs, df = edges
    nodes = sorted({x for p in pairs for x in p})
    both = pairs + [(b, a) for a, b in pairs]
    assert {r.id: r.component for r in G.wcc(df).collect()} == {n: min(reach(both, n)) for n in nodes}
    assert {r.id: r.component for r in G.scc(df).collect()} == {n: min(m for m in reach(pairs, n) if n in reach(pairs, m)) for n in nodes}
    depth = {1: 0}
    for d in range(20):
        for a, b in pairs:
            if depth.get(a) == d:
                depth.setdefault(b, d + 1)
    assert {r.id: r.depth for r in G.bfs(df, [1]).collect()} == {n: depth.get(n) for n in nodes}
    dist = {n: (0.0 if n == 1 else float("inf")) for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            dist[b] = min(dist[b], dist[a] + (a * 3 + b) % 5 + 1)
    assert {r.id: r.distance if r.distance is not None else float("inf") for r in G.sssp(df, [1]).collect()} == dist
    und = {frozenset(p) for p in pairs if p[0] != p[1]}
    near = {n: {m for m in nodes if frozenset((n, m)) in und and m != n} for n in nodes}
    tri = {n: sum(1 for a, b in itertools.combinations(near[n], 2) if b in near[a]) for n in nodes}
    assert {r.id: r.triangles for r in G.triangles(df).collect()} == tri
    coef = {n: (2 * tri[n] / (len(near[n]) * (len(near[n]) - 1)) if len(near[n]) > 1 else 0.0) for n in nodes}
    assert all(abs(r.coefficient - coef[r.id]) < 1e-9 for r in G.clustering(df).collect())
    core, left, k = dict.fromkeys(nodes, 0), {n: set(near[n]) for n in nodes}, 0
    while left:
        k += 1
        while low := [n for n in left if len(left[n]) < k]:
            for n in low:
                for m in left.pop(n):
                    left.get(m, set()).discard(n)
        core.update(dict.fromkeys(left, k))
    assert {r.id: r.core for r in G.kcore(df).collect()} == core


def test_pagerank(edges):
    pairs, df = edges
    nodes = sorted({x for p in pairs for x in p})
    out = {n: [b for a, b in pairs if a == n] for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(4):
        lost = sum(rank[n] for n in nodes if not out[n])
        rank = {n: 0.15 / len(nodes) + 0.85 * (lost / len(nodes) + sum(rank[m] / len(out[m]) for m in nodes if n in out[m])) for n in nodes}
    assert all(abs(r["rank"] - rank[r.id]) < 1e-9 for r in G.pagerank(df, 4).collect())


def test_label_propagation_and_betweenness(edges):
    pairs, df = edges
    nodes = sorted({x for p in pairs for x in p})
    simple = sorted({p for p in pairs if p[0] != p[1]})
    label = {n: n for n in nodes}
    for _ in range(3):
        new = {}
        for n in nodes:
            votes = {}
            for a, b in simple:
                for x, y in ((a, b), (b, a)):
                    if x == n:
                        votes[label[y]] = votes.get(label[y], 0) + 1
            new[n] = min(votes, key=lambda v: (-votes[v], v)) if votes else label[n]
        label = new
    assert {r.id: r.label for r in G.label_propagation(df, 3).collect()} == label
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        order, dist, sigma, pred = [], {s: 0}, {s: 1}, {}
        todo = [s]
        while todo:
            x = todo.pop(0)
            order.append(x)
            for a, b in simple:
                if a == x:
                    if b not in dist:
                        dist[b], sigma[b] = dist[x] + 1, 0
                        todo.append(b)
                    if dist[b] == dist[x] + 1:
                        sigma[b] += sigma[x]
                        pred.setdefault(b, []).append(x)
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in pred.get(w, []):
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    assert all(abs(r.score - score[r.id]) < 1e-9 for r in G.betweenness(df).collect())
    assert G.fast_rp(df, 8).count() == len(nodes) and G.modularity_communities(df, 3, 2).count() == len(nodes)


def test_path_search(spark, edges):
    pairs, df = edges
    simple = {p for p in pairs if p[0] != p[1]}

    def walks(path, high):
        if len(path) > 1:
            yield path
        if len(path) <= high:
            for a, b in simple:
                if a == path[-1] and b not in path:
                    yield from walks([*path, b], high)

    every = list(walks([1], 3))
    got = P.search(spark, df.select("src", "dst"), 1, algorithm="all", high=3)
    assert got.select("path_index").distinct().count() == len(every)
    best = {}
    for w in walks([1], 6):
        best[w[-1]] = min(best.get(w[-1], 99), len(w) - 1)
    one = P.search(spark, df.select("src", "dst"), 1, algorithm="shortest", high=6).where("edge_index = length - 1")
    assert {r.edge_dst: r.length for r in one.collect()} == best


# ---------------------------------------------------------------- search


def test_text_search(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox"), (2, "quick quick fox jumps over the brown dog"), (3, "lazy dogs running"), (4, None), (5, "")], "doc_id long, text string")
    ids = lambda q, **k: {r.doc_id for r in search.bm25(docs, q, **k).collect()}
    assert ids("fox dog") == {1, 2} and ids("+fox -dog") == {1} and ids("fox AND dog") == {2} and ids('"quick brown"') == {1} and ids('"brown quick"~1') == {1} and ids("dog", language="en", stem=True) == {2, 3} and ids("") == set()
    assert search.bm25(docs, "quick", limit=1).collect()[0].doc_id == 2
    assert docs.select(search.highlight(F.col("text"), "fox").alias("h")).collect()[0].h == "The quick brown <b>fox</b>"


def test_stems():
    want = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "triplicate": "triplic", "adjustable": "adjust", "adoption": "adopt", "rate": "rate", "controll": "control"}
    assert {w: search.porter(w) for w in want} == want


def test_entities_and_ranks(spark):
    df = spark.createDataFrame([(1, "Zürich"), (2, "Zurichberg"), (3, "Zuric"), (4, "Basel")], "id long, name string")
    assert [r.id for r in search.entity_search(df, "zurich").collect()] == [1, 2, 3]
    assert [r["rank"] for r in search.competition_ranks(spark.createDataFrame([(3.0,), (3.0,), (1.0,)], "score double")).collect()] == [1, 1, 3]


# ---------------------------------------------------------------- geometry


def test_relations():
    g = geo.parse
    sq, over, inner, beside, far = (g(f"POLYGON(({a} {a}, {b} {a}, {b} {c}, {a} {c}, {a} {a}))") if not isinstance(a, str) else g(a) for a, b, c in ((0, 4, 4), (2, 6, 6), (1, 2, 2), ("POLYGON((4 0, 8 0, 8 4, 4 4, 4 0))", 0, 0), (10, 11, 11)))
    want = {(0, 1): {"sfIntersects", "sfOverlaps", "ehOverlap", "rcc8po"}, (2, 0): {"sfWithin", "sfIntersects", "ehInside", "rcc8ntpp"}, (0, 2): {"sfContains", "sfIntersects", "ehContains", "rcc8ntppi"}, (0, 3): {"sfTouches", "sfIntersects", "ehMeet", "rcc8ec"}, (0, 4): {"sfDisjoint", "ehDisjoint", "rcc8dc"}, (0, 0): {"sfEquals", "sfWithin", "sfContains", "sfIntersects", "ehEquals", "rcc8eq"}}
    shapes = [sq, over, inner, beside, far]
    for (a, b), names in want.items():
        assert {r for r in geo.RELATIONS if geo.relation(r, shapes[a], shapes[b])} == names
        m = geo.relate(shapes[a], shapes[b])
        t = geo.relate(shapes[b], shapes[a])
        assert [m[3 * i + j] for i in range(3) for j in range(3)] == [t[3 * j + i] for i in range(3) for j in range(3)]
    assert geo.relation("sfCrosses", g("LINESTRING(-1 2, 5 2)"), sq) and geo.relation("sfTouches", g("POINT(0 1)"), sq) and geo.relation("sfWithin", g("POINT(1 1)"), sq)
    hole = g("POLYGON((0 0, 9 0, 9 9, 0 9, 0 0), (2 2, 5 2, 5 5, 2 5, 2 2))")
    assert geo.relation("sfDisjoint", g("POINT(3 3)"), hole) and geo.area(hole) == 72


def test_measures():
    g = geo.parse
    assert geo.wkt(geo.convex_hull(g("MULTIPOINT(0 0, 4 0, 4 4, 0 4, 2 2)"))).count(",") == 4
    assert geo.distance(g("POINT(0 0)"), g("LINESTRING(3 -1, 3 5)")) == 3.0 and abs(geo.haversine((0, 0), (0, 1)) - 111195) < 1
    assert geo.area(geo.intersection(g("POLYGON((0 0,4 0,4 4,0 4,0 0))"), g("POLYGON((2 2,6 2,6 6,2 6,2 2))"))) == 4.0
    assert not geo.is_simple(g("LINESTRING(0 0,2 2,0 2,2 0)")) and geo.is_simple(g("LINESTRING(0 0,2 2)"))
    assert geo.parse("nonsense") is None and geo.parse("POINT EMPTY").empty() and geo.wkt(geo.parse('{"type":"Point","coordinates":[1,2]}')) == "POINT(1 2)"
    assert geo.parse("<http://x/4326> POINT(1 2)").srid == "http://x/4326"


def test_overlay_of_areas():
    """Chains of overlays of rectangles on a grid, with holes and corners that touch, against sets of cells."""
    rng = random.Random(1)
    rect = lambda: (lambda x, y: (x, y, x + rng.randrange(1, 5), y + rng.randrange(1, 5)))(rng.randrange(6), rng.randrange(6))
    shape = lambda x, y, u, v: geo.parse(f"POLYGON(({x} {y}, {u} {y}, {u} {v}, {x} {v}, {x} {y}))")
    cells = lambda x, y, u, v: {(i, j) for i in range(x, u) for j in range(y, v)}
    how = [(geo.union, set.union), (geo.difference, set.difference), (geo.intersection, set.intersection), (geo.sym_difference, set.symmetric_difference)]
    for _ in range(150):
        r = rect()
        g, c = shape(*r), cells(*r)
        for _ in range(3):
            (f, h), r = rng.choice(how), rect()
            g, c = f(g, shape(*r)), h(c, cells(*r))
            assert abs(geo.area(g) - len(c)) < 1e-9
    line = geo.parse("LINESTRING(-1 2, 5 2)")
    hole = geo.parse("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))")
    assert geo.length(geo.intersection(line, hole)) == 2.0 and geo.length(geo.difference(line, hole)) == 4.0
    (x, y), r = overlay.smallest_circle([(0, 0), (4, 0), (2, 0.5), (2, -1)])
    assert (round(x, 9), round(y, 9), round(r, 9)) == (2, 0, 2)


def test_geometry_aggregates(spark):
    df = spark.createDataFrame([(1, "POINT(0 0)"), (1, "POINT(4 0)"), (1, "POINT(2 6)"), (1, None)], "k long, g string")
    assert geo.aggregate(df, ["k"], "g", "boundingBox").collect()[0].value.startswith("POLYGON((0.0 0.0, 4.0 0.0")
    assert geo.aggregate(df, ["k"], "g", "centroid").collect()[0].value == "POINT(2.0 2.0)"
    assert geo.area(geo.parse(geo.aggregate(df, ["k"], "g", "convexHull").collect()[0].value)) == 12.0


# ---------------------------------------------------------------- reasoning, validation


def frame(spark, rows):
    return spark.createDataFrame(rows, "s string, p string, o string")


def test_rules(spark):
    given = frame(spark, [("A", reason.SUBCLASS, "B"), ("B", reason.SUBCLASS, "A"), ("B", reason.SUBCLASS, "C"), ("x", reason.TYPE, "A"), ("p", reason.DOMAIN, "D"), ("x", "p", "y"), ("t", RDF + "type", reason.OWL + "TransitiveProperty"), ("a", "t", "b"), ("b", "t", "c"), ("c", "t", "d"), ("x", reason.OWL + "sameAs", "z")])
    out = reason.materialize(given, reason.OWL_RULES, explain=True)
    got = {(r.s, r.p, r.o) for r in out.collect()}
    assert {("x", reason.TYPE, "C"), ("x", reason.TYPE, "D"), ("a", "t", "d"), ("z", "p", "y"), ("z", reason.TYPE, "C")} <= got
    assert not any(p == reason.OWL + "sameAs" and s == o for s, p, o in got)
    tree = reason.explain(("a", "t", "c"), given, out, reason.OWL_RULES)
    assert tree["kind"] == "derived" and tree["rule"] == "prp-trp" and all(x["kind"] == "asserted" for x in tree["premises"])
    assert reason.explain(("q", "q", "q"), given, out, reason.OWL_RULES)["kind"] == "unexplained"


def test_rules_over_restrictions(spark):
    """Patterns that only a later one connects: all pairs of restrictions, and the premises that belong together."""
    owl = reason.OWL
    given = [("C", owl + "someValuesFrom", "X"), ("C", owl + "onProperty", "p"), ("D", owl + "someValuesFrom", "A"), ("D", owl + "someValuesFrom", "Y"), ("D", owl + "onProperty", "p"), ("X", reason.SUBCLASS, "Y")]
    given += [("E", owl + "allValuesFrom", "X"), ("E", owl + "onProperty", "q"), ("F", owl + "allValuesFrom", "Y"), ("F", owl + "onProperty", "q"), ("G", owl + "allValuesFrom", "Y"), ("G", owl + "onProperty", "r")]
    given += [("H", owl + "hasValue", "v"), ("H", owl + "onProperty", "q"), ("I", owl + "hasValue", "v"), ("I", owl + "onProperty", "r"), ("q", reason.SUBPROPERTY, "r")]
    rules = [r for r in reason.OWL_RULES if r.name in ("scm-svf1", "scm-avf1", "scm-hv")]
    out = reason.materialize(frame(spark, given), rules, explain=True)
    got = {(r["rule"], r.s, r.o) for r in out.collect()}
    assert got == {("scm-svf1", "C", "D"), ("scm-avf1", "E", "F"), ("scm-hv", "H", "I")}
    tree = reason.explain(("C", reason.SUBCLASS, "D"), frame(spark, given), out, rules)
    assert tree["kind"] == "derived" and {x["triple"] for x in tree["premises"]} == {given[0], given[1], given[3], given[4], given[5]}


def test_on_read(spark):
    schema = frame(spark, [("p", reason.SUBPROPERTY, "q"), ("q", reason.DOMAIN, "Q"), ("is", reason.SUBPROPERTY, reason.TYPE), ("A", reason.SUBCLASS, "B")])
    data = frame(spark, [("x", "p", "y"), ("z", "q", "y"), ("w", "is", "A"), ("C", reason.SUBCLASS, "D"), ("v", reason.TYPE, "C")])
    got = {(r.s, r.p, r.o) for r in reason.rdfs_on_read(data, schema).collect()}
    assert ("x", "q", "y") in got and ("z", reason.TYPE, "Q") in got and ("w", reason.TYPE, "B") in got
    assert ("x", reason.TYPE, "Q") not in got and ("v", reason.TYPE, "D") not in got


def test_classification(spark):
    axioms = spark.createDataFrame([("sub", "Cat", "Animal", None), ("some", "Cat", "eats", "Mouse"), ("sub", "Mouse", "Animal", None), ("from", "eats", "Animal", "Hunter"), ("and", "Animal", "Hunter", "Predator")], "kind string, a string, b string, c string")
    got = {(r["sub"], r["sup"]) for r in reason.classify(axioms).collect()}
    assert {("Cat", "Hunter"), ("Cat", "Predator")} <= got and ("Mouse", "Hunter") not in got


SHAPES = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix ex: <http://e/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
ex:S sh:targetClass ex:P ; sh:property [ sh:path ex:age ; sh:datatype xsd:integer ; sh:minCount 1 ; sh:maxCount 1 ; sh:minInclusive 0 ] ;
  sh:property [ sh:path ( ex:knows ex:age ) ; sh:minInclusive 10 ] ; sh:property [ sh:path ex:knows ; sh:class ex:P ] ; sh:property [ sh:path ex:name ; sh:pattern "^[A-Z]" ; sh:uniqueLang true ] ."""
DATA = """@prefix ex: <http://e/> . ex:a a ex:P ; ex:age 5 ; ex:name "Al"@en, "Bo"@en . ex:b a ex:P ; ex:age -1, 7 ; ex:knows ex:a, ex:z . ex:c a ex:P ; ex:name "x" . ex:z ex:age 3 ."""


def test_shacl(spark):
    shapes = validate.from_triples(rdf.parse_turtle(SHAPES))
    report = validate.validate(rdf.frame(spark, rdf.parse_turtle(DATA)), shapes)
    got = {(r.focus[-1], r.component) for r in report.collect()}
    assert got == {("b", "maxCount"), ("b", "minInclusive"), ("c", "minCount"), ("b", "class"), ("c", "pattern"), ("a", "uniqueLang")}
    assert not validate.conforms(report)
    changed = rdf.frame(spark, rdf.parse_turtle("<http://e/c> <http://e/age> 1 ."))
    assert {r.focus[-1] for r in validate.validate(rdf.frame(spark, rdf.parse_turtle(DATA)), shapes, changed).collect()} == {"c"}


def test_logical_shapes(spark):
    data = rdf.frame(spark, rdf.parse_turtle(DATA))
    one, two = {"property": [{"path": "http://e/name", "minCount": 1}]}, {"property": [{"path": "http://e/knows", "minCount": 1}]}
    bad = lambda **k: {r.focus[-1] for r in validate.violations(data, {"targetClass": ["http://e/P"], **k}).collect()}
    assert bad(**{"or": [one, two]}) == set() and bad(**{"and": [one, two]}) == {"a", "b", "c"} and bad(**{"not": [one]}) == {"a", "c"} and bad(**{"xone": [one, two]}) == set()


def test_typing(spark):
    data = rdf.frame(spark, rdf.parse_turtle("@prefix e: <http://e/> . e:a e:n 1 ; e:k e:b . e:b e:n 2 ; e:k e:a . e:c e:n 3 ; e:k e:d . e:d e:k e:c ."))
    shapes = {"S": [{"path": "http://e/n", "datatype": XSD + "integer"}, {"path": "http://e/k", "shape": "S", "min": 0, "max": None}]}
    pairs = data.select(F.col("s").alias("node"), F.lit("S").alias("shape")).distinct()
    got = {r.node.lex[-1] for r in validate.type_nodes(data, shapes, pairs).collect()}
    # A reference that does not hold is no match of the open arc, so c stays; d has no number.
    assert got == {"a", "b", "c"}


# ---------------------------------------------------------------- streams, adapters


def test_zsets(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x long")
    b = spark.createDataFrame([(1,), (3,)], "x long")
    assert {(r.x, r[Z.W]) for r in Z.diff(a, b).collect()} == {(1, -1), (2, -1), (3, 1)}
    d = Z.distinct_delta(Z.zset(a), Z.diff(a, b))
    assert {(r.x, r[Z.W]) for r in d.collect()} == {(2, -1), (3, 1)}
    state = Z.aggregate(Z.zset(a), ["x"], {})
    new, delta = Z.aggregate_delta(state, Z.diff(a, b), ["x"], {})
    assert {(r.x, r.n) for r in new.collect()} == {(1, 1), (3, 1)} and delta.count() == 4


def test_watermarked_stream(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/[e]vents.parquet")
    out = Z.tumbling(stream, "ts", "1 day", ["event_type"], [F.count("*").alias("n")], late="1 hour")
    out.writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("days").agg(F.sum("n")).collect()[0][0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_graphql(spark, sf):
    g = standard_graph(spark, sf)
    assert "type Customer {" in graphql.sdl(g) and "nation: Nation" in graphql.sdl(g)
    rows = graphql.execute(g, '{ c: Customer(first: 3, after: "http://example.org/customer/5", where: {not: {segment: {eq: "BUILDING"}}}) { id segment } }')["c"].collect()
    assert len(rows) == 3 and all(r.segment != "BUILDING" for r in rows) and int(rows[0].id.rsplit("/", 1)[1]) > 5
    for bad in ("{ Nothing { id } }", "{ Customer { nothing } }", "{ Customer(where: {name: {like: 3}}) { id } }"):
        with pytest.raises(graphql.GraphQLError):
            graphql.execute(g, bad)
