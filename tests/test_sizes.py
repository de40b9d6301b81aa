"""Work that must grow no faster than the input."""

from loomgraph import suite
from loomgraph.operators import geo, search
from loomgraph.plans.compile import Compiler, Options
from loomgraph.sources.catalog import standard_graph


def test_equal_geometries_are_worked_out_once(spark):
    count = iter(range(10_000))
    numbered = geo._column(lambda x: next(count), "long")
    df = spark.range(500).selectExpr("cast(id % 3 as string) AS g").coalesce(1).select("g", numbered("g").alias("n")).distinct()
    assert df.count() == 3


def test_relations_share_a_matrix(monkeypatch):
    calls, real = [], geo.relate
    monkeypatch.setattr(geo, "relate", lambda a, b: calls.append(1) or real(a, b))
    geo._matrix.cache_clear()
    a, b = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))"
    assert [r for r in geo.RELATIONS if geo._named(r, a, b)] == ["sfContains", "sfIntersects", "ehContains", "rcc8ntppi"]
    assert len(calls) == 1
    assert geo._named("sfWithin", "nonsense", b) is None and geo._named("sfDisjoint", "POINT EMPTY", b)


def test_unions_take_parts_through_few_steps(monkeypatch):
    seen, real = [], geo.union
    monkeypatch.setattr(geo, "union", lambda a, b: seen.append(len(a.coordinates()) + len(b.coordinates())) or real(a, b))
    squares = [geo.parse(f"POLYGON(({x} 0, {x + 1} 0, {x + 1} 1, {x} 1, {x} 0))") for x in range(0, 128, 2)]
    assert geo.area(geo._merge(squares)) == 64 and sum(seen) < 4000


def plan(spark, sf, name):
    return Compiler(standard_graph(spark, sf)).query(suite.QUERIES[name][0])._jdf.queryExecution().executedPlan().toString()


def test_equality_in_optional_is_a_key(spark, sf):
    assert "NestedLoop" not in plan(spark, sf, "keyed_optional")


def test_exists_beyond_a_value_reads_the_largest(spark, sf):
    assert "max(v_r" in plan(spark, sf, "exists_in_or")
    c = Compiler(standard_graph(spark, sf))
    part, supplier = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("part", "supplier"))
    for op, holds in (("<", lambda r, b: r < b), (">=", lambda r, b: r >= b)):
        for test in (f"?r {op} ?b * 0.2", f"?b * 0.2 {'>' if op == '<' else '<='} ?r"):
            for word in ("EXISTS", "NOT EXISTS"):
                ours = c.query(f"SELECT ?k {{ ?s a ex:Supplier ; ex:suppkey ?k ; ex:acctbal ?b FILTER {word} {{ ?p a ex:Part ; ex:retailprice ?r FILTER({test}) }} }}").collect()
                want = [s.s_suppkey for s in supplier if any(holds(p.p_retailprice, s.s_acctbal * 0.2) for p in part) == (word == "EXISTS")]
                assert sorted(r.k for r in ours) == sorted(want)


def test_counts_over_joins_form_no_pairs(spark, sf):
    text = plan(spark, sf, "optional_join")
    assert "n0" in text and "n1" in text
    pattern = '?c a ex:Customer ; ex:nation ?n OPTIONAL { ?c ex:segment ?x FILTER(?x = "BUILDING") } { ?d a ex:Customer ; ex:segment ?x ; ex:nation ?n }'
    for keys in ("", "?n", "?n ?x"):
        group = f"GROUP BY {keys}" if keys else ""
        ask = f"SELECT {keys} (COUNT(*) AS ?k) {{ {pattern} }} {group}"
        graph = standard_graph(spark, sf)
        rows = [sorted(map(tuple, Compiler(graph, Options(factor_counts=f)).query(ask).collect()), key=repr) for f in (True, False)]
        assert rows[0] == rows[1] and rows[0]


def test_negated_path_reads_tables_of_its_subject(spark, sf):
    text = plan(spark, sf, "path_negated")
    assert "nation.parquet" in text and "orders.parquet" not in text and "lineitem.parquet" not in text


def test_only_words_like_the_query_are_stemmed(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The Resting capability of notes"), (2, "rested notes relational"), (3, "nothing here"), (4, None)], "doc_id long, text string")
    found = lambda q: sorted(r.doc_id for r in search.bm25(docs, q, language="en", stem=True).collect())
    assert found("rest") == [1, 2] and found("notes -relate") == [1] and found("+capable +rests") == [1] and found('"resting capability"') == [1]
    monkeypatch.setattr(search, "_porter_all", None)  # stems of all words are for phrases only
    assert found("rest note") == [1, 2]


def test_a_word_begins_like_its_stem():
    for w in "ability capability relational flies agreed hopping hoping sensibility vietnamization sky happy possibly conflated sized feudalism radically".split():
        s = search.porter(w)
        assert w.startswith(s[: len(s) - (2 if s.endswith(("bl", "ble")) else 1)])
