import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph import suite
from loomgraph.operators import registry
from loomgraph.plans.compile import Compiler, Options
from loomgraph.sources.catalog import standard_graph
from tools.compare import normal

SQL = suite.oracle_sql()
#: Slow ones that other tests cover on small graphs.
SLOW = {"algo_kcore", "algo_scc", "algo_wcc"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in suite.queries() if n in SQL and n not in SLOW])
def test_against_sql(spark, sf, duck, name):
    ours, theirs = suite.queries()[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)


@pytest.mark.parametrize("name", ["bgp_star_join", "optional_chain", "exists_join", "group_avg", "filter_in", "values_undef", "union_align", "having", "minus"])
def test_plans_agree(spark, sf, name):
    """Merged typed plans, unmerged ones and plans over term structs give the same rows."""
    text = suite.QUERIES[name][0]
    graph = standard_graph(spark, sf)
    want = normal(suite.rounded(Compiler(graph).query(text)).toPandas().astype(str))
    for options in (Options(merge_stars=False, factor_counts=False), Options(factor_counts=False)):
        assert normal(suite.rounded(Compiler(graph, options).query(text)).toPandas().astype(str)) == want


@pytest.mark.parametrize("text", [
    'SELECT ?c ?name WHERE { ?c a ex:Customer ; ex:name ?name ; ex:nation ?n . ?n ex:name "NATION_3" }',
    "SELECT ?n (COUNT(?c) AS ?k) WHERE { ?c a ex:Customer ; ex:nation ?n } GROUP BY ?n",
    "SELECT ?c ?b WHERE { ?c a ex:Supplier ; ex:acctbal ?b FILTER(?b > 5000) }",
])
def test_terms_agree(spark, sf, text):
    graph = standard_graph(spark, sf)
    typed, terms = Compiler(graph).query(text), Compiler(graph, Options(typed=False)).query(text)

    def plain(df):
        def cell(x):
            try:
                return round(float(x), 4)
            except (TypeError, ValueError):
                return x

        return sorted(tuple(cell(x) for x in r) for r in df.collect())

    assert plain(typed) == plain(terms)


def test_filters_reach_the_scan(spark, sf):
    df = Compiler(standard_graph(spark, sf)).query('SELECT ?k WHERE { ?c a ex:Customer ; ex:custkey ?k ; ex:acctbal ?b FILTER(?b > 9000) }')
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c_acctbal,9000.0)" in plan and "c_mktsegment" not in plan and "Join" not in plan


def test_star_is_one_scan(spark, sf):
    df = Compiler(standard_graph(spark, sf)).query("SELECT ?a ?b ?c WHERE { ?x a ex:Part ; ex:name ?a ; ex:size ?b ; ex:brand ?c }")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_registry_is_part_of_the_suite():
    assert set(registry.queries()) <= set(suite.queries()) and len(suite.queries()) > 120


def test_bindings(spark, sf):
    c = Compiler(standard_graph(spark, sf))
    rows = c.query("SELECT ?k WHERE { ?c ex:custkey ?k ; ex:segment ?s }", {"s": "BUILDING"})
    assert rows.count() == spark.read.parquet(f"{sf}/customer.parquet").where(F.col("c_mktsegment") == "BUILDING").count()
