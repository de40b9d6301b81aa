"""Queries of the operators that stand beside the query language, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import builtins as B
from ..plans import graphql
from ..plans.compile import Compiler, Options
from ..plans.lanes import RDF, XSD
from ..sources import mapping
from ..sources.catalog import EX, VirtualGraph, standard_graph
from ..streaming import live as Z
from . import geo, reason, search, validate
from . import graph as G
from . import paths as P
from .tables import Rounds

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _ALL[name] = (f, sql)
        return f

    return put


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items() if s}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _ask(text: str, options: Options | None = None) -> Query:
    from ..suite import rounded

    return lambda spark, sf: rounded(Compiler(standard_graph(spark, sf), options).query(text))


def knows(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst) of the customers' graph."""
    m = next(m for m in standard_graph(spark, sf).maps if m.name == "knows")
    return m.df()


_N = "n AS (SELECT count(*) AS n FROM customer)"
_E = f"{_N}, e AS (SELECT DISTINCT o_custkey AS s, (o_orderkey * 7 + 1) % n AS d FROM orders, n WHERE o_custkey <> (o_orderkey * 7 + 1) % n), v AS (SELECT s AS id FROM e UNION SELECT d FROM e)"
_U = "u AS (SELECT DISTINCT least(s, d) AS a, greatest(s, d) AS b FROM e), w AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u)"

# ---------------------------------------------------------------- algorithms


def _pagerank_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS r FROM v)", "g AS (SELECT s, count(*) AS k FROM e GROUP BY s)"]
    for i in range(1, rounds + 1):
        steps.append(f"r{i} AS (SELECT v.id, 0.15 / (SELECT count(*) FROM v) + 0.85 * (coalesce(x.r, 0) + coalesce((SELECT sum(r) FROM r{i - 1} WHERE id NOT IN (SELECT s FROM g)), 0) / (SELECT count(*) FROM v)) AS r FROM v LEFT JOIN (SELECT e.d AS id, sum(r{i - 1}.r / g.k) AS r FROM e JOIN g ON e.s = g.s JOIN r{i - 1} ON r{i - 1}.id = e.s GROUP BY e.d) x ON x.id = v.id)")
    return f"WITH {_E}, {', '.join(steps)} SELECT id, round(r * 1000000, 3) AS score FROM r{rounds}"


_add("algo_pagerank", _pagerank_sql(5))(lambda spark, sf: G.pagerank(knows(spark, sf), 5).select("id", F.round(F.col("rank") * 1_000_000, 3).alias("score")))
_add("algo_degrees", f"WITH {_E} SELECT id, (SELECT count(*) FROM e WHERE s = id) AS out_degree, (SELECT count(*) FROM e WHERE d = id) AS in_degree FROM v")(lambda spark, sf: G.degrees(knows(spark, sf)))
_add("algo_bfs", f"WITH RECURSIVE {_E}, r AS (SELECT 1::BIGINT AS id, 0::BIGINT AS depth UNION SELECT e.d, r.depth + 1 FROM r JOIN e ON e.s = r.id WHERE r.depth < 12) SELECT v.id, min(depth) AS depth FROM v LEFT JOIN r ON r.id = v.id GROUP BY v.id")(lambda spark, sf: G.bfs(knows(spark, sf), [1]))
_add("algo_triangles", f"WITH {_E}, {_U}, t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b) SELECT v.id, count(t.p) AS triangles FROM v LEFT JOIN (SELECT p AS id, p FROM t UNION ALL SELECT q, p FROM t UNION ALL SELECT r, p FROM t) t ON t.id = v.id GROUP BY v.id")(lambda spark, sf: G.triangles(knows(spark, sf)))
_add("algo_clustering", f"WITH {_E}, {_U}, t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b), c AS (SELECT id, count(*) AS n FROM (SELECT p AS id FROM t UNION ALL SELECT q FROM t UNION ALL SELECT r FROM t) GROUP BY id), k AS (SELECT a AS id, count(*) AS n FROM w GROUP BY a) SELECT v.id, round(CASE WHEN k.n >= 2 THEN 2.0 * coalesce(c.n, 0) / (k.n * (k.n - 1)) ELSE 0 END, 6)::DOUBLE AS coefficient FROM v LEFT JOIN k ON k.id = v.id LEFT JOIN c ON c.id = v.id")(lambda spark, sf: G.clustering(knows(spark, sf)).select("id", F.round("coefficient", 6).alias("coefficient")))


def _unrolled(name: str, first: str, step: Callable[[str], str], rounds: int) -> str:
    """Materialised rounds of a step; their number passes what the tables need."""
    parts = [f"{name}0 AS MATERIALIZED ({first})"]
    for i in range(1, rounds + 1):
        parts.append(f"{name}{i} AS MATERIALIZED ({step(f'{name}{i - 1}')})")
    return ", ".join(parts)


_WCC = _unrolled("c", "SELECT id, id AS c FROM v", lambda x: f"SELECT l.id, least(l.c, coalesce(min(m.c), l.c)) AS c FROM {x} l LEFT JOIN w ON w.a = l.id LEFT JOIN {x} m ON m.id = w.b GROUP BY l.id, l.c", 16)
_add("algo_wcc", f"WITH {_E}, {_U}, {_WCC} SELECT id, c AS component FROM c16")(lambda spark, sf: G.wcc(knows(spark, sf)))
_add("algo_scc", f"WITH RECURSIVE {_E}, r AS (SELECT s, d FROM e UNION SELECT r.s, e.d FROM r JOIN e ON e.s = r.d) SELECT v.id, least(v.id, coalesce(min(x.d), v.id)) AS component FROM v LEFT JOIN (SELECT a.s, a.d FROM r a JOIN r b ON a.s = b.d AND a.d = b.s) x ON x.s = v.id GROUP BY v.id")(lambda spark, sf: G.scc(knows(spark, sf)))
# A node's core number is the fixpoint of the h-index of its neighbours' numbers.
_CORE = _unrolled("k", "SELECT a AS id, count(*) AS c FROM w GROUP BY a", lambda x: f"SELECT id, max(least(c, i)) AS c FROM (SELECT w.a AS id, m.c, row_number() OVER (PARTITION BY w.a ORDER BY m.c DESC) AS i FROM w JOIN {x} m ON m.id = w.b) GROUP BY id", 40)
_add("algo_kcore", f"WITH {_E}, {_U}, {_CORE} SELECT id, c::BIGINT AS core FROM k40")(lambda spark, sf: G.kcore(knows(spark, sf)))
_VOTES = "SELECT l.id, coalesce(arg_max(t.label, (t.n, -t.label)), l.label) AS label FROM {x} l LEFT JOIN (SELECT y.a AS id, m.label, count(*) AS n FROM y JOIN {x} m ON m.id = y.b GROUP BY 1, 2) t ON t.id = l.id GROUP BY l.id, l.label"
_LABELS = _unrolled("l", "SELECT id, id AS label FROM v", lambda x: _VOTES.format(x=x), 5)
_add("algo_label_propagation", f"WITH {_E}, y AS (SELECT s AS a, d AS b FROM e UNION ALL SELECT d, s FROM e), {_LABELS} SELECT id, label FROM l5")(lambda spark, sf: G.label_propagation(knows(spark, sf), 5))
_add("algo_sssp", f"WITH RECURSIVE {_E}, r AS (SELECT 1::BIGINT AS id, 0::BIGINT AS c UNION SELECT e.d, r.c + e.d % 5 + 1 FROM r JOIN e ON e.s = r.id WHERE r.c < 40) SELECT v.id, min(r.c)::DOUBLE AS distance FROM v LEFT JOIN r ON r.id = v.id GROUP BY v.id")(
    lambda spark, sf: G.sssp(knows(spark, sf).withColumn("weight", (F.col("dst") % 5 + 1).cast("double")), [1])
)
_add("algo_louvain")(lambda spark, sf: G.modularity_communities(knows(spark, sf)))
# A sampling operator: sources drawn from all nodes by a hash, scores scaled.
_add("algo_betweenness")(lambda spark, sf: G.betweenness(knows(spark, sf), node_cap=64))
_add("algo_fastrp")(lambda spark, sf: G.fast_rp(knows(spark, sf), 16))
_add(
    "algo_similarity",
    f"WITH {_E}, p AS (SELECT a.s AS id, b.s AS other, count(*) AS c FROM e a JOIN e b ON a.d = b.d AND a.s <> b.s GROUP BY 1, 2), g AS (SELECT s, count(*) AS k FROM e GROUP BY s), j AS (SELECT p.id, p.other, p.c / (x.k + y.k - p.c)::DOUBLE AS v FROM p JOIN g x ON x.s = p.id JOIN g y ON y.s = p.other) SELECT id, other, round(v, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, other) AS r FROM j) WHERE r <= 10",
)(lambda spark, sf: G.node_similarity(knows(spark, sf)).select("id", "other", F.round("similarity", 6).alias("similarity")))
_add("service_pagerank", _pagerank_sql(5).replace("SELECT id, round(r * 1000000, 3) AS score", "SELECT 'http://example.org/customer/' || id AS n, round(r, 4) AS s"))(_ask("SELECT ?n ?s WHERE { SERVICE algo:pageRank { [] algo:predicate ex:knows ; algo:iterations 5 ; algo:node ?n ; algo:score ?s } }"))
_add(
    "service_path_search",
    f"WITH RECURSIVE {_E}, r AS (SELECT 1::BIGINT AS id, 0::BIGINT AS depth UNION SELECT e.d, r.depth + 1 FROM r JOIN e ON e.s = r.id WHERE r.depth < 12) SELECT 'http://example.org/customer/' || id AS t, min(depth) AS l FROM r WHERE id <> 1 GROUP BY id",
)(_ask('SELECT DISTINCT ?t ?l WHERE { SERVICE path:search { [] path:source <http://example.org/customer/1> ; path:predicate ex:knows ; path:algorithm "shortest" ; path:maxLength 12 ; path:target ?t ; path:length ?l } }'))
_add(
    "path_all",
    f"WITH RECURSIVE {_E}, r AS (SELECT [s, d] AS p FROM e WHERE s = 1 UNION ALL SELECT list_append(r.p, e.d) FROM r JOIN e ON e.s = r.p[-1] WHERE NOT list_contains(r.p, e.d) AND len(r.p) < 4) SELECT (len(p) - 1)::BIGINT AS length, count(*) AS k FROM r GROUP BY 1",
)(lambda spark, sf: P.search(spark, knows(spark, sf), 1, algorithm="all", high=3).where("edge_index = 0").groupBy(F.col("length").cast("long").alias("length")).agg(F.count("*").alias("k")))

_WAYS = f"WITH RECURSIVE {_E}, r AS (SELECT 1::BIGINT AS id, 0::BIGINT AS c UNION SELECT e.d, r.c + e.d % 5 + 1 FROM r JOIN e ON e.s = r.id WHERE r.c < 40), b AS (SELECT id, min(c) AS c FROM r GROUP BY id), o AS (SELECT e.s, e.d FROM e JOIN b x ON x.id = e.s JOIN b y ON y.id = e.d WHERE x.c + e.d % 5 + 1 = y.c)"
_cost = lambda spark, sf: knows(spark, sf).withColumn("weight", F.col("dst") % 5 + 1)
_add("path_cheapest", f"{_WAYS} SELECT id AS target, c::DOUBLE AS cost FROM b WHERE id <> 1")(lambda spark, sf: P.search(spark, _cost(spark, sf), 1, weighted=True).where("edge_index = length - 1").select(F.col("edge_dst").alias("target"), "cost"))
_add("path_all_cheapest", f"{_WAYS}, w AS (SELECT 1::BIGINT AS id, '1' AS p UNION SELECT o.d, w.p || '-' || o.d FROM w JOIN o ON o.s = w.id) SELECT id AS target, count(*) AS k FROM w WHERE id <> 1 GROUP BY id")(
    lambda spark, sf: P.search(spark, _cost(spark, sf), 1, algorithm="allShortest", weighted=True).where("edge_index = length - 1").groupBy(F.col("edge_dst").alias("target")).agg(F.count("*").alias("k"))
)
_add("path_chain", "SELECT max(n_nationkey)::BIGINT AS length, max(n_nationkey)::DOUBLE AS cost FROM nation")(
    lambda spark, sf: P.search(spark, _t(spark, sf, "nation").select(F.col("n_nationkey").alias("src"), (F.col("n_nationkey") + 1).alias("dst")), 0, _t(spark, sf, "nation").agg(F.max("n_nationkey")).collect()[0][0]).where("edge_index = 0").select("length", "cost")
)

# ---------------------------------------------------------------- search

_TOK = r"toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents WHERE text IS NOT NULL)"


def _bm25_sql(words: list[str], where: str, limit: str = "") -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(words))
    ds = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(words)))
    score = " + ".join(f"ln(1 + (docs - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(words)))
    return f"WITH {_TOK}, r AS (SELECT doc_id, t, len(t) AS n, {tf} FROM toks), s AS (SELECT count(*) AS docs, avg(n) AS mean, {ds} FROM r) SELECT doc_id, round({score}, 4) AS score FROM r, s WHERE {where} {limit}"


_add("text_bm25", _bm25_sql(["the", "and"], "f0 > 0 OR f1 > 0"))(lambda spark, sf: search.bm25(_t(spark, sf, "documents"), "the and").select("doc_id", F.round("score", 4).alias("score")))
_add("text_must", _bm25_sql(["of", "the"], "f0 > 0 AND f1 > 0"))(lambda spark, sf: search.bm25(_t(spark, sf, "documents"), "+of +the").select("doc_id", F.round("score", 4).alias("score")))
_add("text_phrase", _bm25_sql(["of", "the"], "contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')"))(lambda spark, sf: search.bm25(_t(spark, sf, "documents"), '"of the"').select("doc_id", F.round("score", 4).alias("score")))
_add("text_not", _bm25_sql(["the"], "f0 > 0 AND NOT list_contains(t, 'of')"))(lambda spark, sf: search.bm25(_t(spark, sf, "documents"), "the -of").select("doc_id", F.round("score", 4).alias("score")))
_add("text_postings", f"WITH {_TOK} SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS places FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY term")(lambda spark, sf: search.postings(_t(spark, sf, "documents")).groupBy("term").agg(F.count("*").alias("docs"), F.sum(F.size("positions")).alias("places")))
_add("text_stemmed")(lambda spark, sf: search.bm25(_t(spark, sf, "documents"), "resting heins erations", language="en", stem=True))
_MARK = r"regexp_replace({x}, '(?i)(^|[^\p{{L}}\p{{N}}])(the|of)([^\p{{L}}\p{{N}}]|$)', '\1ꙮ\2ꚙ\3', 'g')"
# Two passes, since neighbours share the character between them; letters mark what is done.
_add("text_highlight", f"SELECT doc_id, replace(replace({_MARK.format(x=_MARK.format(x='text'))}, 'ꙮ', '<b>'), 'ꚙ', '</b>') AS h FROM documents WHERE text IS NOT NULL")(lambda spark, sf: _t(spark, sf, "documents").where("text is not null").select("doc_id", search.highlight(F.col("text"), "the of").alias("h")))
_add("entity_search", "SELECT n_nationkey AS k, CASE WHEN lower(n_name) = 'nation_1' THEN 3.0 WHEN starts_with(lower(n_name), 'nation_1') THEN 2.0 ELSE 1.0 END::DOUBLE AS score FROM nation WHERE starts_with(lower(n_name), 'nation_1') OR levenshtein(lower(n_name), 'nation_1') <= 1")(lambda spark, sf: search.entity_search(_t(spark, sf, "nation"), "Nátion_1", "n_name", limit=100).select(F.col("n_nationkey").alias("k"), "score"))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    """The query set: every vector whose id is divisible by 20."""
    return _t(spark, sf, "embeddings").where("vec_id % 20 = 0").select("vec_id", "embedding")


_VECTORS = "SELECT query, vec_id, round(score, 4) AS score, rank FROM (SELECT q.vec_id AS query, e.vec_id, {f}(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {f}(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 10"
_add("vector_search", _VECTORS.format(f="list_cosine_similarity"))(lambda spark, sf: search.vector_topk(_t(spark, sf, "embeddings"), _queries(spark, sf)).select("query", "vec_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank")))
_add("vector_search_dot", _VECTORS.format(f="list_inner_product"))(lambda spark, sf: search.vector_topk(_t(spark, sf, "embeddings"), _queries(spark, sf), metric="dot").select("query", "vec_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank")))
_HYBRID = (
    f"WITH t AS ({_bm25_sql(['the', 'of'], 'f0 > 0 OR f1 > 0')}), b AS (SELECT doc_id, rank() OVER (ORDER BY score DESC) AS r FROM (SELECT * FROM t ORDER BY score DESC, doc_id LIMIT 100)), "
    "n AS (SELECT q.vec_id AS query, e.vec_id AS doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS r FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0), "
    "u AS (SELECT query, doc_id, r FROM n WHERE r <= 100 UNION ALL SELECT query, doc_id, b.r FROM b, (SELECT DISTINCT query FROM n)), "
    "f AS (SELECT query, doc_id, round(sum(1.0::DOUBLE / (60 + r)), 8) AS score FROM u GROUP BY 1, 2) "
    "SELECT query, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS k FROM f) WHERE k <= 10"
)
_add("hybrid_search", _HYBRID)(lambda spark, sf: search.hybrid(_t(spark, sf, "documents"), "the of", _t(spark, sf, "embeddings"), _queries(spark, sf)))
_add(
    "rank_fusion",
    "WITH a AS (SELECT p_partkey AS k, rank() OVER (ORDER BY p_size DESC) AS r FROM part), b AS (SELECT p_partkey AS k, rank() OVER (ORDER BY p_retailprice DESC) AS r FROM part) SELECT k, round(sum(s), 6) AS score FROM (SELECT k, 1.0::DOUBLE / (60 + r) AS s FROM a UNION ALL SELECT k, 1.0::DOUBLE / (60 + r) FROM b) GROUP BY k",
)(lambda spark, sf: search.fuse_rrf([search.competition_ranks(_t(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col(c).alias("score"))) for c in ("p_size", "p_retailprice")], "k").select("k", F.round("score", 6).alias("score")))

# ---------------------------------------------------------------- geometry


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """Points made of customer keys."""
    k = F.col("c_custkey")
    return _t(spark, sf, "customer").select(k.alias("id"), (k * 37 % 360 - 180 + F.lit(0.25)).cast("double").alias("lon"), (k * 53 % 170 - 85 + F.lit(0.5)).cast("double").alias("lat"))


_PLACES = "p AS (SELECT c_custkey AS id, (c_custkey * 37 % 360 - 180 + 0.25)::DOUBLE AS lon, (c_custkey * 53 % 170 - 85 + 0.5)::DOUBLE AS lat FROM customer)"
_add("geo_within_box", f"WITH {_PLACES} SELECT id FROM p WHERE lon >= -10 AND lat >= 30 AND lon <= 40 AND lat <= 60")(lambda spark, sf: _places(spark, sf).where(geo.within_box(F.col("lon"), F.col("lat"), (-10, 30, 40, 60))).select("id"))
_add(
    "geo_nearby",
    f"WITH {_PLACES}, d AS (SELECT id, 2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(50 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(50)) * pow(sin(radians(10 - lon) / 2), 2)))) AS m FROM p) SELECT id, round(m / 1000, 3) AS km FROM d WHERE m <= 1500000",
)(lambda spark, sf: geo.nearby(_places(spark, sf), "lon", "lat", (10.0, 50.0), 1_500_000.0).select("id", F.round(F.col("distance") / 1000, 3).alias("km")))
_add(
    "geo_relations",
    f"WITH {_PLACES} SELECT id, (lon > 0 AND lon < 90 AND lat > 0 AND lat < 45) AS inside, NOT (lon >= 0 AND lon <= 90 AND lat >= 0 AND lat <= 45) AS apart FROM p",
)(lambda spark, sf: (lambda p: p.select("id", geo.function("sfWithin", p["g"], p["b"]).alias("inside"), geo.function("sfDisjoint", p["g"], p["b"]).alias("apart")))(_places(spark, sf).select("id", F.format_string("POINT(%s %s)", F.col("lon").cast("string"), F.col("lat").cast("string")).alias("g"), F.lit("POLYGON((0 0, 90 0, 90 45, 0 45, 0 0))").alias("b"))))
_add(
    "geo_join",
    f"WITH {_PLACES}, b AS (SELECT n_nationkey AS k, (n_nationkey * 14 - 170)::DOUBLE AS x, (n_nationkey * 6 - 70)::DOUBLE AS y FROM nation) SELECT id, k FROM p JOIN b ON lon >= x AND lon <= x + 20 AND lat >= y AND lat <= y + 20",
)(lambda spark, sf: _geo_join(spark, sf))


def _geo_join(spark: SparkSession, sf: str) -> DataFrame:
    points = _places(spark, sf).select("id", F.format_string("POINT(%s %s)", F.col("lon").cast("string"), F.col("lat").cast("string")).alias("geom"))
    x, y = F.col("n_nationkey") * 14 - 170, F.col("n_nationkey") * 6 - 70
    boxes = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.format_string("POLYGON((%1$d %2$d, %3$d %2$d, %3$d %4$d, %1$d %4$d, %1$d %2$d))", x, y, x + 20, y + 20).alias("geom_b"))
    return geo.spatial_join(points, boxes, "sfIntersects", cell=10.0).select("id", "k")


_add(
    "geo_measures",
    "SELECT n_nationkey AS k, round(((n_nationkey % 5) + 1) * 2.0, 4)::DOUBLE AS area, round(2 * (((n_nationkey % 5) + 1) + 2), 4)::DOUBLE AS perimeter, 2::BIGINT AS dimension FROM nation",
)(lambda spark, sf: _t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.format_string("POLYGON((0 0, %1$d 0, %1$d 2, 0 2, 0 0))", F.col("n_nationkey") % 5 + 1).alias("g")).select("k", F.round(geo.function("area", F.col("g")), 4).alias("area"), F.round(geo.function("perimeter", F.col("g")), 4).alias("perimeter"), geo.function("dimension", F.col("g")).alias("dimension")))
_add("geo_aggregate")(lambda spark, sf: geo.aggregate(_places(spark, sf).select((F.col("id") % 7).alias("k"), F.format_string("POINT(%s %s)", F.col("lon").cast("string"), F.col("lat").cast("string")).alias("g")), ["k"], "g", "convexHull"))

# ---------------------------------------------------------------- reasoning, validation


def _places_in(spark: SparkSession, sf: str) -> DataFrame:
    """(s, p, o): what lies in what, and what things are."""
    nation, customer = _t(spark, sf, "nation"), _t(spark, sf, "customer")
    iri = lambda kind, c: F.concat(F.lit(kind + "/"), F.col(c).cast("string"))
    a = nation.select(iri("nation", "n_nationkey").alias("s"), F.lit("in").alias("p"), iri("region", "n_regionkey").alias("o"))
    b = customer.select(iri("customer", "c_custkey"), F.lit("in"), iri("nation", "c_nationkey"))
    c = customer.select(iri("customer", "c_custkey"), F.lit(RDF + "type"), F.concat(F.lit("class/"), F.col("c_mktsegment")))
    return a.union(b).union(c)


def _schema(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "s string, p string, o string")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_CLASSES = [(f"class/{x}", reason.SUBCLASS, "class/Client") for x in _SEGMENTS] + [("class/Client", reason.SUBCLASS, "class/Agent")]
_add(
    "rdfs_subclass",
    "SELECT o, count(*) AS k FROM (SELECT unnest(['class/' || c_mktsegment, 'class/Client', 'class/Agent']) AS o FROM customer) GROUP BY o",
)(lambda spark, sf: reason.rdfs_on_read(_places_in(spark, sf), _schema(spark, _CLASSES)).where(F.col("p") == RDF + "type").groupBy("o").agg(F.count("*").alias("k")))
_add(
    "owl_transitive",
    "SELECT 'customer/' || c_custkey AS s, 'region/' || n_regionkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey",
)(lambda spark, sf: reason.materialize(_places_in(spark, sf).where("p = 'in'").union(_schema(spark, [("in", RDF + "type", reason.OWL + "TransitiveProperty")])), [r for r in reason.OWL_RULES if r.name == "prp-trp"]).where("p = 'in'").select("s", "o"))
_add(
    "owl_inverse",
    "SELECT 'nation/' || n_nationkey AS o, 'region/' || n_regionkey AS s FROM nation UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer",
)(lambda spark, sf: reason.materialize(_places_in(spark, sf).where("p = 'in'").union(_schema(spark, [("in", reason.OWL + "inverseOf", "holds")])), [r for r in reason.OWL_RULES if r.name.startswith("prp-inv")]).where("p = 'holds'").select("s", "o"))
_add(
    "custom_rule",
    "SELECT 'customer/' || c_custkey AS s, 'region/' || n_regionkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'",
)(lambda spark, sf: reason.materialize(_places_in(spark, sf), [reason.rule("builds", f"(?c <{RDF}type> class/BUILDING) (?c in ?n) (?n in ?r) -> (?c buildsIn ?r)")]).select("s", "o"))


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    return standard_graph(spark, sf).triples(None, None, {EX + "document/", EX + "customer/"})


_add("shacl_min_count", "SELECT 'http://example.org/document/' || d.doc_id AS focus FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)")(
    lambda spark, sf: validate.violations(_typed(spark, sf), {"targetClass": [EX + "Document"], "property": [{"path": EX + "quality", "minCount": 1}]}).select("focus")
)
_add("shacl_datatype", "SELECT count(*) AS k FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")(
    lambda spark, sf: validate.violations(_typed(spark, sf), {"targetClass": [EX + "Document"], "property": [{"path": EX + "text", "datatype": XSD + "string"}]}).agg(F.count("*").alias("k"))
)
_add("shacl_range", "SELECT 'http://example.org/customer/' || c_custkey AS focus FROM customer WHERE c_acctbal < 0")(
    lambda spark, sf: validate.violations(_typed(spark, sf), {"targetClass": [EX + "Customer"], "property": [{"path": EX + "acctbal", "minInclusive": 0}]}).select("focus")
)
_add("shacl_report", "SELECT component, count(*) AS k FROM (SELECT 'in' AS component FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT 'maxExclusive' FROM customer WHERE c_acctbal >= 5000) GROUP BY component")(
    lambda spark, sf: validate.violations(_typed(spark, sf), {"targetClass": [EX + "Customer"], "property": [{"path": EX + "segment", "in": ["BUILDING", "MACHINERY"]}, {"path": EX + "acctbal", "maxExclusive": 5000, "maxCount": 1}, {"path": EX + "nation", "nodeKind": "IRI", "minCount": 1}]}).groupBy("component").agg(F.count("*").alias("k"))
)

# ---------------------------------------------------------------- increments, windows


def _halves(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(column) % 2 == 0), df.where(F.col(column) % 2 == 1)


@_add("zset_diff", "SELECT k, sum(w)::BIGINT AS w FROM (SELECT o_custkey AS k, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS w FROM orders WHERE o_orderstatus IN ('F', 'O')) GROUP BY k HAVING sum(w) <> 0")
def _zset_diff(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders")
    return Z.diff(o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"))).withColumnRenamed(Z.W, "w")


@_add("zset_join_delta", "SELECT count(*) AS k, sum(w)::BIGINT AS w FROM (SELECT o_custkey, o_orderkey, c_nationkey, 1 AS w FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 1 OR c_custkey % 2 = 1)")
def _zset_join(spark: SparkSession, sf: str) -> DataFrame:
    a, da = _halves(_t(spark, sf, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o")), "o")
    b, db = _halves(_t(spark, sf, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n")), "c")
    return Z.join_delta(Z.zset(a), Z.zset(da), Z.zset(b), Z.zset(db), ["c"]).agg(F.count("*").alias("k"), F.sum(Z.W).alias("w"))


@_add("zset_aggregate", "SELECT o_orderstatus AS s, count(*) AS n, sum(o_custkey)::BIGINT AS t FROM orders GROUP BY 1")
def _zset_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _halves(_t(spark, sf, "orders").select(F.col("o_orderstatus").alias("s"), "o_custkey", "o_orderkey"), "o_orderkey")
    state = Z.aggregate(Z.zset(a), ["s"], {"t": "o_custkey"})
    new, _ = Z.aggregate_delta(state, Z.zset(b), ["s"], {"t": "o_custkey"})
    return new


_add("window_tumbling", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(
    lambda spark, sf: Z.tumbling(_t(spark, sf, "events"), "ts", "1 day", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")]).drop("window_end")
)
_add("window_session", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS window_start, count(*) AS n FROM s GROUP BY user_id, s")(
    lambda spark, sf: Z.sessions(_t(spark, sf, "events"), "ts", "6 hours", ["user_id"], [F.count("*").alias("n")]).drop("window_end")
)
_add("as_of_join", "SELECT e.event_id AS id, p.event_id AS last FROM events e ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS r FROM events WHERE event_type = 'purchase') WHERE r = 1) p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'click'")(
    lambda spark, sf: (lambda e: Z.as_of(e.where("event_type = 'click'").select(F.col("event_id").alias("id"), "user_id", "ts"), e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last")), "user_id", "ts", ["last"]).select("id", "last"))(_t(spark, sf, "events"))
)


@_add("stream_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """Counts kept by micro-batches of a file stream: each batch's signed counts are added to the state."""
    rounds = Rounds(spark, "stream", keep=1000)
    schema = _t(spark, sf, "events").schema
    state: list[DataFrame] = [rounds.save(spark.createDataFrame([], "event_type string, n long"))]

    def update(batch: DataFrame, _: int) -> None:
        change = Z.aggregate(Z.zset(batch.select("event_type")), ["event_type"], {})
        state[0] = rounds.save(state[0].unionByName(change).groupBy("event_type").agg(F.sum("n").alias("n")))

    # A file stream reads folders and globs, not a file's own name.
    pattern = f"{sf}/[e]vents.parquet"
    stream = spark.readStream.schema(schema).parquet(pattern)
    Z.follow(stream, update, f"{rounds.root}/checkpoint").awaitTermination()
    return state[0]


# ---------------------------------------------------------------- named graphs


def _named(spark: SparkSession, sf: str) -> Compiler:
    """Each customer's triples in a graph of its own, the nations' names in their regions' graphs."""
    word = lambda c: F.struct(F.lit(2).cast("tinyint").alias("kind"), F.col(c).alias("lex"), F.lit(XSD + "string").alias("dt"), F.lit(None).cast("string").alias("lang"))
    node = lambda kind, c: F.concat(F.lit(EX + kind + "/"), F.col(c).cast("string"))
    iri = lambda c: F.struct(F.lit(0).cast("tinyint").alias("kind"), c.alias("lex"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))
    row = lambda g, s, p, o: F.struct(g.alias("g"), iri(s).alias("s"), F.lit(EX + p).alias("p"), o.alias("o"))
    c, n = _t(spark, sf, "customer"), _t(spark, sf, "nation")
    own, me = node("graph/customer", "c_custkey"), node("customer", "c_custkey")
    rows = c.select(F.explode(F.array(row(own, me, "segment", word("c_mktsegment")), row(own, me, "nation", iri(node("nation", "c_nationkey"))))).alias("x"))
    rows = rows.union(n.select(row(node("graph/region", "n_regionkey"), node("nation", "n_nationkey"), "name", word("n_name")).alias("x")))
    return Compiler(VirtualGraph(spark, [], rows.select("x.*")))


def _among(text: str) -> Query:
    return lambda spark, sf: _named(spark, sf).query(text)


_R = f"<{EX}graph/region/"
_add("from_graphs", "SELECT 'http://example.org/nation/' || n_nationkey AS n, n_name AS x FROM nation WHERE n_regionkey IN (1, 3)")(_among(f"SELECT ?n ?x FROM {_R}1> FROM {_R}3> {{ ?n ex:name ?x }}"))
_add("from_named", "SELECT 'http://example.org/graph/region/' || n_regionkey AS g, n_name AS x FROM nation WHERE n_regionkey IN (0, 2)")(_among(f"SELECT ?g ?x FROM NAMED {_R}0> FROM NAMED {_R}2> {{ GRAPH ?g {{ ?n ex:name ?x }} }}"))
_add("from_both", "SELECT a.n_name AS x, count(*) AS k FROM nation a, nation b WHERE a.n_regionkey = 1 AND b.n_regionkey = 2 GROUP BY a.n_name")(_among(f"SELECT ?x (COUNT(*) AS ?k) FROM {_R}1> FROM NAMED {_R}2> {{ ?n ex:name ?x GRAPH ?g {{ ?m ex:name ?y }} }} GROUP BY ?x"))
_add("graph_variable", "SELECT 'http://example.org/graph/customer/' || c_custkey AS g, c_mktsegment AS s, 'http://example.org/nation/' || c_nationkey AS n FROM customer")(_among("SELECT ?g ?s ?n { GRAPH ?g { ?c ex:segment ?s OPTIONAL { ?c ex:nation ?n } } }"))
_add("graph_names", "SELECT count(*) AS k FROM (SELECT c_custkey AS a, 0 AS b FROM customer UNION SELECT n_regionkey, 1 FROM nation)")(_among("SELECT (COUNT(?g) AS ?k) { GRAPH ?g {} }"))
_add("graph_join", "SELECT n_name AS x, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")(_among("SELECT ?x (COUNT(?g) AS ?k) { GRAPH ?g { ?c ex:nation ?n } GRAPH ?h { ?n ex:name ?x } } GROUP BY ?x"))


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("s.lex").alias("s"), "p", F.col("o.lex").alias("o"), F.coalesce(F.col("o.dt"), F.lit("")).alias("dt"))


_add("construct_triples", f"SELECT DISTINCT 'http://example.org/region/' || n_regionkey AS s, 'http://example.org/hasNation' AS p, 'http://example.org/nation/' || n_nationkey AS o, '' AS dt FROM nation UNION ALL SELECT 'http://example.org/nation/' || n_nationkey, 'http://example.org/called', n_name, '{XSD}string' FROM nation")(
    lambda spark, sf: _flat(Compiler(standard_graph(spark, sf)).query("CONSTRUCT { ?r ex:hasNation ?n . ?n ex:called ?x } WHERE { ?n a ex:Nation ; ex:region ?r ; ex:name ?x }"))
)
_add("describe_iri", f"SELECT 'http://example.org/nation/' || n_nationkey AS s, unnest(['{RDF}type', 'http://example.org/name', 'http://example.org/region']) AS p, unnest(['http://example.org/Nation', n_name, 'http://example.org/region/' || n_regionkey]) AS o, unnest(['', '{XSD}string', '']) AS dt FROM nation WHERE n_nationkey = 3")(
    lambda spark, sf: _flat(Compiler(standard_graph(spark, sf)).query("DESCRIBE <http://example.org/nation/3>"))
)

# ---------------------------------------------------------------- adapters


_add("graphql_filter", "SELECT 'http://example.org/customer/' || c_custkey AS id, c_name AS name, round(c_acctbal, 4) AS acctbal FROM customer WHERE c_acctbal > 9000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")(
    lambda spark, sf: graphql.execute(standard_graph(spark, sf), '{ Customer(where: {acctbal: {gt: 9000}, segment: {in: ["BUILDING", "MACHINERY"]}}) { id name acctbal } }')["Customer"].withColumn("acctbal", F.round("acctbal", 4))
)
_add("graphql_nested", "SELECT c_name AS name, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey ORDER BY c_acctbal DESC, c_custkey LIMIT 20")(
    lambda spark, sf: graphql.execute(standard_graph(spark, sf), "{ Customer(first: 20, orderBy: {field: acctbal, desc: true}) { name nation { name region { name } } } }")["Customer"].select("name", F.col("nation.name").alias("nation"), F.col("nation.region.name").alias("region"))
)


def _mapped(spark: SparkSession, sf: str) -> list[mapping.Map]:
    doc = {
        "prefixes": {"ex": EX},
        "mappings": {
            "nation": {"sources": [[f"{sf}/nation.parquet~parquet"]], "s": "ex:nation/$(n_nationkey)", "po": [["a", "ex:Nation"], ["ex:name", "$(n_name)"], ["ex:label", "$(n_name)", "en~lang"], {"p": "ex:region", "o": {"mapping": "region", "condition": {"function": "equal", "parameters": [["str1", "$(n_regionkey)"], ["str2", "$(r_regionkey)"]]}}}]},
            "region": {"sources": [[f"{sf}/region.parquet~parquet"]], "s": "ex:region/$(r_regionkey)", "po": [["a", "ex:Region"], ["ex:name", "$(r_name)"]]},
        },
    }
    return mapping.from_yarrrml(doc)


_add("mapping_quads", "SELECT p, count(*) AS k FROM (SELECT unnest(['http://example.org/name', 'http://example.org/label', 'http://example.org/region', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) AS p FROM nation UNION ALL SELECT unnest(['http://example.org/name', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) FROM region) GROUP BY p")(
    lambda spark, sf: mapping.quads(spark, _mapped(spark, sf)).groupBy("p").agg(F.count("*").alias("k"))
)
_add("mapping_direct", "SELECT count(*) * 3 AS k, count(DISTINCT n_nationkey) AS s FROM nation")(
    lambda spark, sf: mapping.direct(_t(spark, sf, "nation"), "http://example.org/n/", "n_nationkey").agg(F.count("*").alias("k"), F.count_distinct("s").alias("s"))
)


@_add("user_functions", "SELECT c_custkey AS k, upper(c_mktsegment) || '!' AS x FROM customer")
def _user(spark: SparkSession, sf: str) -> DataFrame:
    B.register("http://example.org/shout", lambda c: F.concat(F.upper(c), F.lit("!")))
    return Compiler(standard_graph(spark, sf)).query("SELECT ?k (ex:shout(?s) AS ?x) WHERE { ?c ex:custkey ?k ; ex:segment ?s }")


@_add("history_state", "SELECT count(*) AS k FROM nation WHERE n_regionkey <> 1")
def _history(spark: SparkSession, sf: str) -> DataFrame:
    """Insert every nation's region, delete those of one region, read both states back."""
    from ..dataset import Dataset

    rounds = Rounds(spark, "dataset")
    d = Dataset(spark, rounds.root)
    rows = standard_graph(spark, sf).triples([EX + "region"], None, {EX + "nation/"}).withColumn("g", F.lit(None).cast("string"))
    d.commit(insert=rows.select("g", "s", "p", "o"))
    d.update("DELETE { ?n ex:region ?r } WHERE { ?n ex:region ?r FILTER(?r = <http://example.org/region/1>) }")
    return d.query("SELECT (COUNT(*) AS ?k) WHERE { ?n ex:region ?r }")
