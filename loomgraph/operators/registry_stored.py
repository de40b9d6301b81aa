"""Registered queries of stored datasets, documents, mappings, results, functions and relations, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..plans.compile import Compiler, register_aggregate
from ..plans.lanes import INTEGER
from ..sources import mapping, rdf, sinks
from ..sources.catalog import EX, standard_graph
from ..streaming import live
from . import geo, reason, validate
from .registry import _add, _ask, _t
from .tables import Rounds


def _folder(spark: SparkSession, name: str) -> str:
    return Rounds(spark, name).root


def _stored(spark: SparkSession, sf: str) -> Dataset:
    """Customers' segments and nations, nations' names and regions; the segments in a named graph as well."""
    d = Dataset(spark, _folder(spark, "stored"))
    graph = standard_graph(spark, sf)
    rows = graph.triples([EX + "segment", EX + "nation"], None, {EX + "customer/"}).unionByName(graph.triples([EX + "name", EX + "region"], None, {EX + "nation/"}))
    rows = rows.withColumn("g", F.lit(None).cast("string"))
    d.commit(insert=rows.unionByName(rows.where(F.col("p") == EX + "segment").withColumn("g", F.lit(EX + "segments"))), note="load")
    return d


_BUILD = "DELETE { ?c ex:segment ?s } INSERT { ?c ex:was ?s . ?c ex:builds true } WHERE { ?c ex:segment ?s FILTER(?s = \"BUILDING\") }"
_B = "count(*) FILTER (WHERE c_mktsegment = 'BUILDING')"


# ---------------------------------------------------------------- updates and versions


@_add("update_modify", f"SELECT unnest(['http://example.org/segment', 'http://example.org/was', 'http://example.org/builds']) AS p, unnest([count(*) - {_B}, {_B}, {_B}]) AS k FROM customer")
def _modify(spark: SparkSession, sf: str) -> DataFrame:
    d = _stored(spark, sf)
    d.update(_BUILD)
    return d.query("SELECT ?p (COUNT(*) AS ?k) WHERE { ?c ?p ?o FILTER(?p IN (ex:segment, ex:was, ex:builds)) } GROUP BY ?p")


@_add("update_using", "SELECT n_name AS x, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY' GROUP BY 1")
def _using(spark: SparkSession, sf: str) -> DataFrame:
    """WITH and USING read and write other graphs than the default one."""
    d = _stored(spark, sf)
    d.update("INSERT { GRAPH ex:machines { ?c ex:marked ex:yes } } WHERE { GRAPH ex:segments { ?c ex:segment \"MACHINERY\" } }")
    return d.query("SELECT ?x (COUNT(*) AS ?k) WHERE { GRAPH ex:machines { ?c ex:marked ?y } ?c ex:nation ?n . ?n ex:name ?x } GROUP BY ?x")


@_add("update_graphs", "SELECT unnest(['http://example.org/copy', 'http://example.org/moved', 'http://example.org/sum']) AS g, count(*) AS k FROM customer UNION ALL SELECT 'http://example.org/sum2', count(*) + 1 FROM customer")
def _graphs(spark: SparkSession, sf: str) -> DataFrame:
    """COPY, MOVE, ADD, CLEAR and DROP of graphs."""
    d = _stored(spark, sf)
    d.update("COPY ex:segments TO ex:copy ; COPY ex:segments TO ex:gone ; MOVE ex:gone TO ex:moved ; ADD ex:copy TO ex:sum ; INSERT DATA { GRAPH ex:sum2 { ex:a ex:segment \"x\" } } ; ADD ex:sum TO ex:sum2 ; CLEAR GRAPH ex:segments ; DROP SILENT GRAPH ex:nothing")
    return d.query("SELECT ?g (COUNT(*) AS ?k) WHERE { GRAPH ?g { ?c ex:segment ?s } } GROUP BY ?g")


@_add("delete_insert_data", "SELECT 'http://example.org/nation/' || n_nationkey AS n, CASE n_nationkey WHEN 3 THEN 'Three' ELSE n_name END AS x FROM nation WHERE n_nationkey <> 4")
def _data(spark: SparkSession, sf: str) -> DataFrame:
    d = _stored(spark, sf)
    d.update('DELETE WHERE { <http://example.org/nation/4> ?p ?o } ; DELETE { ?n ex:name ?x } INSERT { ?n ex:name "Three" } WHERE { ?n ex:name ?x FILTER(?n = <http://example.org/nation/3>) }')
    return d.query("SELECT ?n ?x WHERE { ?n ex:name ?x }")


@_add("dataset_diff", f"SELECT op, p, k FROM (SELECT unnest([-1, 1, 1]) AS op, unnest(['http://example.org/segment', 'http://example.org/was', 'http://example.org/builds']) AS p, {_B} AS k FROM customer) WHERE k > 0")
def _diff(spark: SparkSession, sf: str) -> DataFrame:
    d = _stored(spark, sf)
    d.update(_BUILD)
    return d.diff(1, 2).groupBy(F.col("op").cast("int").alias("op"), "p").agg(F.count("*").alias("k"))


@_add("dataset_preview", f"SELECT op, k FROM (SELECT unnest([-1, 1]) AS op, unnest([{_B}, 2 * {_B}]) AS k FROM customer) WHERE k > 0")
def _preview(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).preview(_BUILD).groupBy(F.col("op").cast("int").alias("op")).agg(F.count("*").alias("k"))


@_add("time_travel", "SELECT c_mktsegment AS s, count(*) AS k FROM customer GROUP BY 1")
def _travel(spark: SparkSession, sf: str) -> DataFrame:
    """A pinned state is read after later commits and a compaction."""
    d = _stored(spark, sf)
    d.pin("start")
    d.update("DELETE WHERE { ?c ex:segment ?s }")
    d.compact()
    return d.query("SELECT ?s (COUNT(*) AS ?k) WHERE { ?c ex:segment ?s } GROUP BY ?s", at="start")


@_add("compacted_state", f"SELECT unnest(['http://example.org/segment', 'http://example.org/was', 'http://example.org/builds', 'http://example.org/nation']) AS p, unnest([count(*) - {_B}, 0, {_B} + 1, count(*)]) AS k FROM customer")
def _compacted(spark: SparkSession, sf: str) -> DataFrame:
    """A base, and a tail of the log that inserts and deletes over it."""
    d = _stored(spark, sf)
    d.update(_BUILD)
    d.compact()
    d.update("DELETE WHERE { ?c ex:was ?s } ; INSERT DATA { ex:new ex:builds true }")
    known = spark.createDataFrame([(EX + x,) for x in ("segment", "was", "builds", "nation")], "p string")
    found = d.query("SELECT ?p (COUNT(*) AS ?k) WHERE { ?c ?p ?o } GROUP BY ?p")
    return known.join(found, "p", "left").select("p", F.coalesce("k", F.lit(0).cast("long")).alias("k"))


@_add("commit_log", f"SELECT 1::BIGINT AS seq, 3 * (SELECT count(*) FROM customer) + 2 * (SELECT count(*) FROM nation) AS inserted, 0::BIGINT AS deleted, 'load' AS note UNION ALL SELECT 2, 2 * {_B}, {_B}, 'mark' FROM customer")
def _log(spark: SparkSession, sf: str) -> DataFrame:
    d = _stored(spark, sf)
    d.update(_BUILD, note="mark")
    return d.commits()


@_add("quad_history", "SELECT unnest([1, 2])::BIGINT AS seq, unnest([1, -1]) AS op, 'http://example.org/nation/4' AS s FROM region WHERE r_regionkey = 0")
def _history(spark: SparkSession, sf: str) -> DataFrame:
    d = _stored(spark, sf)
    d.update("DELETE { ?n ex:name ?x } WHERE { ?n ex:name ?x FILTER(?n = <http://example.org/nation/4>) }")
    return d.history(s=EX + "nation/4", p=EX + "name").select("seq", F.col("op").cast("int").alias("op"), F.col("s.lex").alias("s"))


@_add("branch_state", "SELECT count(*) AS k FROM nation")
def _branch(spark: SparkSession, sf: str) -> DataFrame:
    d = _stored(spark, sf)
    b = d.branch(_folder(spark, "branch"))
    d.update("DELETE WHERE { ?n ex:name ?x }")
    return b.query("SELECT (COUNT(*) AS ?k) WHERE { ?n ex:name ?x }")


@_add("patch_round_trip", f"SELECT count(*) - {_B} AS k FROM customer")
def _patch(spark: SparkSession, sf: str) -> DataFrame:
    """The patch from one state to another, applied to a branch of the first."""
    d = _stored(spark, sf)
    d.update(_BUILD)
    b = d.branch(_folder(spark, "branch"), 1)
    b.patch("\n".join(r[0] for r in d.patch_text(1, 2).collect()))
    return b.query("SELECT (COUNT(*) AS ?k) WHERE { ?c ex:segment ?s }")


@_add("view_rows", "SELECT c_mktsegment AS s, count(*) AS k FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1")
def _view(spark: SparkSession, sf: str) -> DataFrame:
    """A view, refreshed since a commit touched what it reads."""
    d = _stored(spark, sf)
    d.create_view("segments", "SELECT ?s (COUNT(*) AS ?k) WHERE { ?c ex:segment ?s } GROUP BY ?s")
    d.update(_BUILD)
    d.refresh_view("segments")
    return d.read_view("segments", allow_stale=False)


@_add("view_service", "SELECT c_mktsegment AS s, count(*) AS k FROM customer GROUP BY 1")
def _view_service(spark: SparkSession, sf: str) -> DataFrame:
    d = _stored(spark, sf)
    d.create_view("segments", "SELECT ?s (COUNT(*) AS ?k) WHERE { ?c ex:segment ?s } GROUP BY ?s")
    return d.read_view("segments")


@_add("footprint_skip", "SELECT * FROM (VALUES ('name', false), ('segment', true), ('any', true)) x(q, touched)")
def _footprint(spark: SparkSession, sf: str) -> DataFrame:
    """Which queries a commit concerns."""
    d = _stored(spark, sf)
    d.update(_BUILD)
    asked = {"name": "SELECT ?x { ?n ex:name ?x }", "segment": "SELECT ?x { ?n ex:segment ?x }", "any": "SELECT ?x { ?n ?p ?x }"}
    return spark.createDataFrame([(k, d.touches(q, 1)) for k, q in asked.items()], "q string, touched boolean")


@_add("live_events", f"SELECT s, w FROM (SELECT 'BUILDING' AS s, -{_B} AS w FROM customer UNION ALL SELECT 'FRESH', 1::BIGINT) WHERE w <> 0")
def _live(spark: SparkSession, sf: str) -> DataFrame:
    """The second event of a live query: what a commit took off and brought."""
    d = _stored(spark, sf)
    q = live.live(d, "SELECT ?c ?s WHERE { ?c ex:segment ?s }")
    q.advance(1)
    d.update(_BUILD + ' ; INSERT DATA { ex:new ex:segment "FRESH" }')
    return q.advance(d.head).groupBy("s").agg(F.sum(live.W).alias("w"))


@_add("saved_query", "SELECT c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3' AND c_acctbal > 1000")
def _saved(spark: SparkSession, sf: str) -> DataFrame:
    """A stored query with typed parameters and a default."""
    d = Dataset(spark, _folder(spark, "saved"), standard_graph(spark, sf).maps)
    d.put_query("rich", "SELECT ?k WHERE { ?c a ex:Customer ; ex:custkey ?k ; ex:acctbal ?b ; ex:nation ?n . ?n ex:name ?x FILTER(?b > ?least) }", {"least": 1000})
    return d.run("rich", x="NATION_3")


@_add("initial_bindings", "SELECT c_custkey AS k FROM customer WHERE c_nationkey = 3")
def _bindings(spark: SparkSession, sf: str) -> DataFrame:
    from ..plans import algebra as A

    return Compiler(standard_graph(spark, sf)).query("SELECT ?k WHERE { ?c a ex:Customer ; ex:custkey ?k ; ex:nation ?n }", {"n": A.Iri(EX + "nation/3")}).select("k")


# ---------------------------------------------------------------- documents, mappings, results


@_add("nquads_lines", "SELECT '<http://example.org/nation/' || n_nationkey || '> <http://example.org/name> \"' || n_name || '\" .' AS value FROM nation UNION ALL SELECT '<http://example.org/nation/' || n_nationkey || '> <http://example.org/region> <http://example.org/region/' || n_regionkey || '> .' FROM nation")
def _lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = standard_graph(spark, sf).triples([EX + "name", EX + "region"], None, {EX + "nation/"}).withColumn("g", F.lit(None).cast("string"))
    return rdf.lines(rows)


@_add("nquads_read", "SELECT 'http://example.org/graph/' || c_nationkey AS g, 'http://example.org/segment' AS p, c_mktsegment AS o, count(*) AS k FROM customer GROUP BY 1, 2, 3")
def _read(spark: SparkSession, sf: str) -> DataFrame:
    """Written as N-Quads by every executor and read back."""
    path = _folder(spark, "lines") + "/quads"
    c = _t(spark, sf, "customer")
    spell = F.format_string("<http://example.org/customer/%d> <http://example.org/segment> \"%s\" <http://example.org/graph/%d> .", "c_custkey", "c_mktsegment", "c_nationkey")
    c.select(spell.alias("value")).write.text(path)
    return rdf.read_lines(spark, path).groupBy("g", "p", F.col("o.lex").alias("o")).agg(F.count("*").alias("k"))


def _documents(spark: SparkSession, sf: str, syntax: str) -> DataFrame:
    """Nations written in a syntax and read back, a document a file."""
    path = _folder(spark, syntax) + f"/nations.{syntax}"
    rows = standard_graph(spark, sf).triples([EX + "name", EX + "region"], None, {EX + "nation/"}).withColumn("g", F.lit(None).cast("string"))
    rdf.write(rows.coalesce(1), path, syntax)
    if syntax == "jsonld":  # an object a line
        text = spark.read.text(path).collect()
        back = rdf.frame(spark, [q for r in text if r[0].strip() for q in rdf.parse_text(r[0], syntax)])
    else:
        back = rdf.frame(spark, [q for r in spark.read.text(path, wholetext=True).collect() for q in rdf.parse_text(r[0], syntax)])
    return back.select(F.col("s.lex").alias("s"), "p", F.col("o.lex").alias("o"))


_NATIONS = "SELECT 'http://example.org/nation/' || n_nationkey AS s, unnest(['http://example.org/name', 'http://example.org/region']) AS p, unnest([n_name, 'http://example.org/region/' || n_regionkey]) AS o FROM nation"
for _syntax in ("turtle", "trig", "jsonld"):
    _add(f"document_{_syntax}", _NATIONS)(lambda spark, sf, s=_syntax: _documents(spark, sf, s))

_SEGMENTS = "SELECT 'http://example.org/customer/' || c_custkey AS s, c_mktsegment AS o FROM customer"


@_add("csv_source", _SEGMENTS)
def _csv(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV source behind a mapping of templates and references."""
    path = _folder(spark, "csv") + "/customer"
    _t(spark, sf, "customer").select("c_custkey", "c_mktsegment").write.option("header", True).csv(path)
    doc = {"prefixes": {"ex": EX}, "mappings": {"c": {"sources": [[f"{path}~csv"]], "s": "ex:customer/$(c_custkey)", "po": [["ex:segment", "$(c_mktsegment)"]]}}}
    return mapping.quads(spark, mapping.from_yarrrml(doc)).select(F.col("s.lex").alias("s"), F.col("o.lex").alias("o"))


@_add("json_source", _SEGMENTS)
def _json(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON Lines source with a nested reference."""
    path = _folder(spark, "json") + "/customer"
    _t(spark, sf, "customer").select("c_custkey", F.struct("c_mktsegment").alias("market")).write.json(path)
    maps = [mapping.Map("c", mapping.Source("jsonl", path), mapping.Term("template", EX + "customer/{c_custkey}"), [], [(mapping.Term("constant", EX + "segment"), mapping.Term("reference", "market.c_mktsegment", "literal"))])]
    return mapping.quads(spark, maps).select(F.col("s.lex").alias("s"), F.col("o.lex").alias("o"))


_R2RML = """@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix ex: <http://example.org/> .
<#c> rr:logicalTable [ rr:sqlQuery "SELECT c_custkey, c_mktsegment, c_nationkey FROM customers WHERE c_acctbal > 0" ] ;
  rr:subjectMap [ rr:template "http://example.org/customer/{c_custkey}" ; rr:class ex:Customer ] ;
  rr:predicateObjectMap [ rr:predicate ex:segment ; rr:objectMap [ rr:column "c_mktsegment" ; rr:language "en" ] ] ;
  rr:predicateObjectMap [ rr:predicate ex:nation ; rr:objectMap [ rr:parentTriplesMap <#n> ; rr:joinCondition [ rr:child "c_nationkey" ; rr:parent "n_nationkey" ] ] ] .
<#n> rr:logicalTable [ rr:tableName "nations" ] ; rr:subjectMap [ rr:template "http://example.org/nation/{n_nationkey}" ] .
"""


@_add("r2rml_query", "SELECT 'http://example.org/customer/' || c_custkey AS s, unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://example.org/segment', 'http://example.org/nation']) AS p, unnest(['http://example.org/Customer', c_mktsegment, 'http://example.org/nation/' || c_nationkey]) AS o, unnest(['', 'en', '']) AS lang FROM customer WHERE c_acctbal > 0")
def _r2rml(spark: SparkSession, sf: str) -> DataFrame:
    """A SQL query and a table as sources, a class, a language and a join between triples maps."""
    _t(spark, sf, "customer").createOrReplaceTempView("customers")
    _t(spark, sf, "nation").createOrReplaceTempView("nations")
    return mapping.quads(spark, mapping.from_turtle(_R2RML)).select(F.col("s.lex").alias("s"), "p", F.col("o.lex").alias("o"), F.coalesce("o.lang", F.lit("")).alias("lang"))


def _solution(spark: SparkSession, sf: str):
    c = Compiler(standard_graph(spark, sf))
    return c.compile(_pattern("SELECT ?n ?x ?r WHERE { ?n a ex:Nation ; ex:name ?x OPTIONAL { ?n ex:region ?r FILTER(?r != <http://example.org/region/1>) } }"))


def _pattern(text: str):
    from ..plans.parser import parse

    return parse(text).pattern


_IRI = "'http://example.org/nation/' || n_nationkey"
_REG = "'http://example.org/region/' || n_regionkey"
_add("results_csv", f"SELECT {_IRI} || ',' || n_name || ',' || CASE WHEN n_regionkey = 1 THEN '' ELSE {_REG} END AS value FROM nation")(lambda spark, sf: sinks.csv_rows(_solution(spark, sf)))
_add("results_tsv", f"SELECT '<' || {_IRI} || '>' || chr(9) || '\"' || n_name || '\"' || chr(9) || CASE WHEN n_regionkey = 1 THEN '' ELSE '<' || {_REG} || '>' END AS value FROM nation")(lambda spark, sf: sinks.csv_rows(_solution(spark, sf), "\t"))
_add("results_json", f"""SELECT '{{"n":{{"type":"uri","value":"' || {_IRI} || '"}},"x":{{"type":"literal","value":"' || n_name || '"}}' || CASE WHEN n_regionkey = 1 THEN '' ELSE ',"r":{{"type":"uri","value":"' || {_REG} || '"}}' END || '}}' AS value FROM nation""")(lambda spark, sf: sinks.json_rows(_solution(spark, sf)))
_add("void_description", "SELECT 'urn:dataset#class=http://example.org/Nation' AS s, 'entities' AS p, count(*)::VARCHAR AS o FROM nation UNION ALL SELECT 'urn:dataset#property=http://example.org/region', 'triples', count(*)::VARCHAR FROM nation UNION ALL SELECT 'urn:dataset#property=http://example.org/name', 'triples', ((SELECT count(*) FROM nation) + (SELECT count(*) FROM region))::VARCHAR")(
    lambda spark, sf: sinks.void(_small(spark, sf)).where("p rlike '(entities|triples)$' and s rlike '(Nation|region|name)$'").select("s", F.regexp_extract("p", "[a-zA-Z]+$", 0).alias("p"), "o")
)


def _small(spark: SparkSession, sf: str):
    from ..sources.catalog import VirtualGraph

    return VirtualGraph(spark, [m for m in standard_graph(spark, sf).maps if m.name in ("nation", "region")])


@_add("stored_mapping", "SELECT count(*) AS k FROM nation")
def _stored_mapping(spark: SparkSession, sf: str) -> DataFrame:
    d = Dataset(spark, _folder(spark, "mapped"))
    m = mapping.Mappings(d)
    _t(spark, sf, "nation").createOrReplaceTempView("nations")
    m.put("nations", '@prefix rr: <http://www.w3.org/ns/r2rml#> . <#n> rr:logicalTable [ rr:tableName "nations" ] ; rr:subjectMap [ rr:template "http://example.org/nation/{n_nationkey}" ] ; rr:predicateObjectMap [ rr:predicate <http://example.org/name> ; rr:objectMap [ rr:column "n_name" ] ] .')
    m.run("nations")
    m.run("nations", replace=True)
    return d.query("SELECT (COUNT(*) AS ?k) WHERE { ?n ex:name ?x }")


# ---------------------------------------------------------------- language

_add("cross_product", "SELECT count(*) AS k FROM region, nation")(_ask("SELECT (COUNT(*) AS ?k) WHERE { ?a a ex:Region . ?b a ex:Nation }"))
_add("triple_terms", "SELECT n_name AS x, 'http://example.org/nation/' || n_nationkey AS s, 'http://example.org/name' AS p, true AS y FROM nation")(
    _ask("SELECT (OBJECT(?t) AS ?x) (SUBJECT(?t) AS ?s) (PREDICATE(?t) AS ?p) (isTRIPLE(?t) AS ?y) WHERE { ?n a ex:Nation ; ex:name ?m BIND(TRIPLE(?n, ex:name, ?m) AS ?t) }")
)
_add("text_languages", "SELECT doc_id AS k, lang AS l, lang = 'en' AS e, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' AS d, text AS x, lang || '-x' AS y FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")(
    _ask("SELECT ?k (LANG(?t) AS ?l) (LANGMATCHES(LANG(?t), \"en\") AS ?e) (DATATYPE(?t) AS ?d) (STR(?t) AS ?x) (LANG(STRLANG(STR(?t), CONCAT(LANG(?t), \"-x\"))) AS ?y) WHERE { ?a ex:docId ?k ; ex:text ?t }")
)
_add("encoded_names", "SELECT c_custkey AS k, replace(replace(c_name || '/' || c_mktsegment, '#', '%23'), '/', '%2F') AS u, 36::BIGINT AS n, true AS b FROM customer")(
    _ask("SELECT ?k (ENCODE_FOR_URI(CONCAT(?x, \"/\", ?s)) AS ?u) (STRLEN(STRUUID()) AS ?n) (isIRI(UUID()) AS ?b) WHERE { ?c ex:custkey ?k ; ex:name ?x ; ex:segment ?s }")
)
_add("blank_subjects", "SELECT l_linestatus AS s, count(*) AS k, true AS b FROM lineitem GROUP BY 1")(_ask("SELECT ?s (COUNT(*) AS ?k) (MIN(isBLANK(?l)) AS ?b) WHERE { ?l a ex:Lineitem ; ex:linestatus ?s } GROUP BY ?s"))
_add("typed_literals", "SELECT c_custkey AS k, 'http://www.w3.org/2001/XMLSchema#decimal' AS d, c_custkey + 1 AS n FROM customer")(
    _ask("SELECT ?k (DATATYPE(STRDT(STR(?k), xsd:decimal)) AS ?d) (xsd:integer(STR(?k)) + 1 AS ?n) WHERE { ?c a ex:Customer ; ex:custkey ?k }")
)


@_add("custom_aggregate", "SELECT c_nationkey AS k, bit_xor(c_custkey)::BIGINT AS x FROM customer GROUP BY 1")
def _aggregate(spark: SparkSession, sf: str) -> DataFrame:
    register_aggregate(EX + "xor", F.bit_xor, INTEGER)
    out = Compiler(standard_graph(spark, sf)).query("SELECT ?n (AGG <http://example.org/xor>(?c) AS ?x) WHERE { ?a ex:custkey ?c ; ex:nation ?n } GROUP BY ?n")
    return out.select(F.regexp_extract("n", r"\d+$", 0).cast("int").alias("k"), F.col("x").cast("long").alias("x"))


# ---------------------------------------------------------------- reasoning, validation


@_add("el_classes", "SELECT 'customer/' || c_custkey AS sub, unnest(['nation/' || n_nationkey, 'region/' || n_regionkey, 'world']) AS sup FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _classes(spark: SparkSession, sf: str) -> DataFrame:
    """Subclasses over three levels."""
    c, n = _t(spark, sf, "customer"), _t(spark, sf, "nation")
    row = lambda a, b: [F.lit("sub").alias("kind"), a.alias("a"), b.alias("b"), F.lit(None).cast("string").alias("c")]
    name = lambda kind, col: F.concat(F.lit(kind + "/"), F.col(col).cast("string"))
    axioms = c.select(*row(name("customer", "c_custkey"), name("nation", "c_nationkey"))).union(n.select(*row(name("nation", "n_nationkey"), name("region", "n_regionkey")))).union(n.select(*row(name("region", "n_regionkey"), F.lit("world"))).distinct())
    return reason.classify(axioms).where("sub like 'customer/%' and sub != sup").select("sub", "sup")


@_add("shacl_changed", "SELECT 'http://example.org/customer/' || c_custkey AS focus FROM customer WHERE c_acctbal < 0 AND c_nationkey = 3")
def _changed(spark: SparkSession, sf: str) -> DataFrame:
    """Only targets that a change concerns are validated."""
    graph = standard_graph(spark, sf)
    rows = graph.triples(None, None, {EX + "customer/"})
    nation = graph.triples([EX + "nation"], None, {EX + "customer/"}).where(F.col("o.lex") == EX + "nation/3")
    shape = {"targetClass": [EX + "Customer"], "property": [{"path": EX + "acctbal", "minInclusive": 0}, {"path": EX + "nation", "minCount": 1}]}
    return validate.validate(rows, [shape], nation).select("focus")


@_add("shacl_qualified", "SELECT 'http://example.org/region/' || r_regionkey AS focus, 'qualifiedMaxCount' AS component FROM region WHERE (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_name LIKE 'NATION_1%') > 2 UNION ALL SELECT 'http://example.org/region/' || r_regionkey, 'qualifiedMinCount' FROM region WHERE (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_name LIKE 'NATION_1%') < 2")
def _qualified(spark: SparkSession, sf: str) -> DataFrame:
    """How many of a region's nations have a name of a pattern."""
    graph = standard_graph(spark, sf)
    rows = graph.triples(None, None, {EX + "region/"}).unionByName(graph.triples([EX + "name", EX + "region"], None, {EX + "nation/"}))
    shapes = [{"targetClass": [EX + "Region"], "property": [{"path": ("inverse", EX + "region"), "qualifiedValueShape": {"property": [{"path": EX + "name", "pattern": "^NATION_1"}]}, "qualifiedMinCount": 2, "qualifiedMaxCount": 2}]}]
    return validate.validate(rows, shapes).select("focus", "component")


@_add("shacl_sparql", "SELECT 'http://example.org/nation/' || n_nationkey AS focus, n_name AS value FROM nation WHERE n_regionkey = 2")
def _shacl_sparql(spark: SparkSession, sf: str) -> DataFrame:
    rows = standard_graph(spark, sf).triples(None, None, {EX + "nation/"})
    shape = {"targetClass": [EX + "Nation"], "sparql": ["SELECT $this ?value WHERE { $this ex:region <http://example.org/region/2> ; ex:name ?value }"]}
    return validate.validate(rows, [shape]).select("focus", "value")


def _triples(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "s string, p string, o string")


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    """What segment and nation each customer is of, as types."""
    c = _t(spark, sf, "customer")
    me = F.concat(F.lit("customer/"), F.col("c_custkey").cast("string"))
    kinds = F.array(F.concat(F.lit("segment/"), "c_mktsegment"), F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")))
    return c.select(me.alias("s"), F.lit(reason.TYPE).alias("p"), F.explode(kinds).alias("o"))


_REST, _FIRST, _NIL = reason.RDF + "rest", reason.RDF + "first", reason.RDF + "nil"


@_add("owl_classes", "SELECT 'customer/' || c_custkey AS s, unnest(list_filter(['both', 'either'], lambda x: CASE x WHEN 'both' THEN c_mktsegment = 'BUILDING' AND c_nationkey = 3 ELSE c_mktsegment = 'BUILDING' OR c_nationkey = 3 END)) AS o FROM customer")
def _owl_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Intersections and unions of classes in lists."""
    lists = [(f"{k}{i}", p, o) for k in ("i", "u") for i, (x, nxt) in enumerate((("segment/BUILDING", f"{k}1"), ("nation/3", _NIL))) for p, o in ((_FIRST, x), (_REST, nxt))]
    schema = _triples(spark, [("both", reason.OWL + "intersectionOf", "i0"), ("either", reason.OWL + "unionOf", "u0"), *lists])
    rules = [r for r in reason.OWL_RULES if r.name.startswith(("list", "cls-int", "cls-uni"))]
    out = reason.materialize(_segments(spark, sf).where("o in ('segment/BUILDING', 'nation/3')").union(schema), rules)
    return out.where(F.col("o").isin("both", "either")).select("s", "o")


@_add("owl_chain", "SELECT 'customer/' || c_custkey AS s, 'region/' || n_regionkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _owl_chain(spark: SparkSession, sf: str) -> DataFrame:
    """A property chain of two steps."""
    c, n = _t(spark, sf, "customer"), _t(spark, sf, "nation")
    name = lambda kind, col: F.concat(F.lit(kind + "/"), F.col(col).cast("string"))
    rows = c.select(name("customer", "c_custkey").alias("s"), F.lit("of").alias("p"), name("nation", "c_nationkey").alias("o")).union(n.select(name("nation", "n_nationkey"), F.lit("within"), name("region", "n_regionkey")))
    schema = _triples(spark, [("lies", reason.OWL + "propertyChainAxiom", "l0"), ("l0", _FIRST, "of"), ("l0", _REST, "l1"), ("l1", _FIRST, "within"), ("l1", _REST, _NIL)])
    return reason.materialize(rows.union(schema), [r for r in reason.OWL_RULES if r.name == "prp-spo2"]).where("p = 'lies'").select("s", "o")


@_add("owl_inconsistent", "SELECT 'cax-dw' AS rule, 'customer/' || c_custkey AS s, 'segment/BUILDING' AS o FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (3, 4)")
def _owl_inconsistent(spark: SparkSession, sf: str) -> DataFrame:
    """Members of a class and of a subclass of a disjoint one."""
    schema = _triples(spark, [("segment/BUILDING", reason.OWL + "disjointWith", "north"), ("nation/3", reason.SUBCLASS, "north"), ("nation/4", reason.SUBCLASS, "north")])
    return reason.inconsistencies(_segments(spark, sf).union(schema), [r for r in reason.OWL_RULES if r.name == "rdfs9"])


# ---------------------------------------------------------------- relations


_LO, _HI = "(k % 7 - 2)", "(k % 7 - 1 + k % 5)"
_CASES = {
    "sfEquals": "{lo} = 0 AND {hi} = 4", "sfDisjoint": "{lo} > 4 OR {hi} < 0", "sfTouches": "{lo} = 4 OR {hi} = 0", "sfWithin": "{lo} <= 0 AND {hi} >= 4", "sfContains": "{lo} >= 0 AND {hi} <= 4", "sfIntersects": "{lo} <= 4 AND {hi} >= 0", "sfCrosses": "false",
    "sfOverlaps": "{lo} < 4 AND {hi} > 0 AND NOT ({lo} <= 0 AND {hi} >= 4) AND NOT ({lo} >= 0 AND {hi} <= 4)",
    "ehEquals": "{lo} = 0 AND {hi} = 4", "ehDisjoint": "{lo} > 4 OR {hi} < 0", "ehMeet": "{lo} = 4 OR {hi} = 0", "ehOverlap": "{lo} < 4 AND {hi} > 0 AND NOT ({lo} <= 0 AND {hi} >= 4) AND NOT ({lo} >= 0 AND {hi} <= 4)",
    "ehCovers": "{lo} >= 0 AND {hi} <= 4 AND ({lo} = 0) <> ({hi} = 4)", "ehCoveredBy": "{lo} <= 0 AND {hi} >= 4 AND ({lo} = 0) <> ({hi} = 4)", "ehInside": "{lo} < 0 AND {hi} > 4", "ehContains": "{lo} > 0 AND {hi} < 4",
    "rcc8eq": "{lo} = 0 AND {hi} = 4", "rcc8dc": "{lo} > 4 OR {hi} < 0", "rcc8ec": "{lo} = 4 OR {hi} = 0", "rcc8po": "{lo} < 4 AND {hi} > 0 AND NOT ({lo} <= 0 AND {hi} >= 4) AND NOT ({lo} >= 0 AND {hi} <= 4)",
    "rcc8tppi": "{lo} >= 0 AND {hi} <= 4 AND ({lo} = 0) <> ({hi} = 4)", "rcc8tpp": "{lo} <= 0 AND {hi} >= 4 AND ({lo} = 0) <> ({hi} = 4)", "rcc8ntpp": "{lo} < 0 AND {hi} > 4", "rcc8ntppi": "{lo} > 0 AND {hi} < 4",
}
_add("geo_relations", "SELECT k, unnest([" + ", ".join(f"'{r}'" for r in _CASES) + "]) AS relation, unnest([" + ", ".join(c.format(lo=_LO, hi=_HI) for c in _CASES.values()) + "]) AS holds FROM (SELECT p_partkey AS k FROM part)")(lambda spark, sf: _relations(spark, sf))


def _relations(spark: SparkSession, sf: str) -> DataFrame:
    """All twenty-four relations of a square of four with squares along its diagonal."""
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.expr(_LO).cast("int").alias("a"), F.expr(_HI).cast("int").alias("b"))
    square = F.format_string("POLYGON((%1$d %1$d, %2$d %1$d, %2$d %2$d, %1$d %2$d, %1$d %1$d))", "a", "b")
    fixed = F.lit("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))")
    shapes = p.select("k", square.alias("g"))
    rows = F.array(*[F.struct(F.lit(r).alias("relation"), geo.function(r, fixed, F.col("g")).alias("holds")) for r in _CASES])
    return shapes.select("k", F.explode(rows).alias("x")).select("k", "x.*")


_add("geo_accessors", "SELECT p_partkey AS k, p_size + 1.0::DOUBLE AS area, 2.0::DOUBLE * (p_size + 2) AS length, 2::BIGINT AS dimension, 'POLYGON' AS kind, true AS simple FROM part")(
    lambda spark, sf: _t(spark, sf, "part").select("p_partkey", F.format_string("POLYGON((0 0, %1$d 0, %1$d 1, 0 1, 0 0))", F.col("p_size") + 1).alias("g")).select(
        F.col("p_partkey").alias("k"), geo.function("area", F.col("g")).alias("area"), geo.function("perimeter", F.col("g")).alias("length"), geo.function("dimension", F.col("g")).cast("long").alias("dimension"), geo.function("geometryType", F.col("g")).alias("kind"), geo.function("isSimple", F.col("g")).alias("simple")
    )
)


_COMMON = "greatest(0, least(4, k % 7 + 1) - greatest(0, k % 7 - 1)) * 2.0::DOUBLE"
_add("geo_overlay", f"SELECT k, {_COMMON} AS common, 20 - {_COMMON} AS whole, 16 - {_COMMON} AS first, 20 - 2 * {_COMMON} AS one FROM (SELECT p_partkey AS k FROM part)")(lambda spark, sf: _overlays(spark, sf, "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"))
# The hole takes what lies between 1 and 3; the second area is as high as it.
_IN_HOLE = "greatest(0, least(3, k % 7 + 1) - greatest(1, k % 7 - 1)) * 2.0::DOUBLE"
_add("geo_overlay_hole", f"SELECT k, {_COMMON} - {_IN_HOLE} AS common, 16 - {_COMMON} + {_IN_HOLE} AS whole, 12 - {_COMMON} + {_IN_HOLE} AS first, 16 - 2 * ({_COMMON} - {_IN_HOLE}) AS one FROM (SELECT p_partkey AS k FROM part)")(lambda spark, sf: _overlays(spark, sf, "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))"))


def _overlays(spark: SparkSession, sf: str, fixed: str) -> DataFrame:
    """Areas of the four overlays of a fixed area with squares of two that move across it."""
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.expr("cast(p_partkey % 7 - 1 as int)").alias("a"), F.expr("cast(p_partkey % 7 + 1 as int)").alias("b"))
    g, f = F.format_string("POLYGON((%1$d 1, %2$d 1, %2$d 3, %1$d 3, %1$d 1))", "a", "b"), F.lit(fixed)
    area = lambda how: F.coalesce(geo.function("area", geo.function(how, f, g)), F.lit(0.0))
    return p.select("k", area("intersection").alias("common"), area("union").alias("whole"), area("difference").alias("first"), area("symDifference").alias("one"))


_add("geo_aggregate_union", "SELECT p_partkey % 7 AS k, count(DISTINCT p_size)::DOUBLE AS area FROM part GROUP BY 1")(
    lambda spark, sf: geo.aggregate(_t(spark, sf, "part").select((F.col("p_partkey") % 7).alias("k"), F.format_string("POLYGON((%1$d 0, %2$d 0, %2$d 1, %1$d 1, %1$d 0))", F.col("p_size"), F.col("p_size") + 1).alias("g")), ["k"], "g", "union").select("k", geo.function("area", F.col("value")).alias("area"))
)
_add("geo_aggregate_box", "SELECT p_partkey % 7 AS k, max(p_size) - min(p_size) + 1.0::DOUBLE AS area FROM part GROUP BY 1")(
    lambda spark, sf: geo.aggregate(_t(spark, sf, "part").select((F.col("p_partkey") % 7).alias("k"), F.format_string("POLYGON((%1$d 0, %2$d 0, %2$d 1, %1$d 1, %1$d 0))", F.col("p_size"), F.col("p_size") + 1).alias("g")), ["k"], "g", "boundingBox").select("k", geo.function("area", F.col("value")).alias("area"))
)
