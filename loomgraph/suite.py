"""Registered queries: query text over the tables' virtual graph, beside SQL for the same rows.

Doubles are rounded to four places on both sides, since sums of floating-point
numbers depend on the order in which partitions are added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plans.compile import Compiler, Options
from .sources.catalog import standard_graph

PLACES = 4


def rounded(df: DataFrame) -> DataFrame:
    """Doubles and decimals as doubles of four places."""
    kinds = (T.DoubleType, T.FloatType, T.DecimalType)
    return df.select(*[F.round(F.col(f"`{f.name}`").cast("double"), PLACES).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f"`{f.name}`") for f in df.schema])


def sparql(text: str, options: Options | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """A query function over the standard virtual graph."""
    return lambda spark, sf_dir: rounded(Compiler(standard_graph(spark, sf_dir), options).query(text))


def _iri(kind: str, column: str) -> str:
    return f"'http://example.org/{kind}/' || {column}"


_TABLES = {
    "region": ("Region", "name:r_name"),
    "nation": ("Nation", "name:n_name region:n_regionkey"),
    "customer": ("Customer", "name:c_name acctbal:c_acctbal segment:c_mktsegment custkey:c_custkey nation:c_nationkey"),
    "supplier": ("Supplier", "name:s_name acctbal:s_acctbal suppkey:s_suppkey nation:s_nationkey"),
    "part": ("Part", "name:p_name brand:p_brand type:p_type size:p_size retailprice:p_retailprice partkey:p_partkey"),
    "orders": ("Order", "status:o_orderstatus totalprice:o_totalprice orderdate:o_orderdate priority:o_orderpriority orderkey:o_orderkey customer:o_custkey"),
    "lineitem": ("Lineitem", "linenumber:l_linenumber quantity:l_quantity extendedprice:l_extendedprice discount:l_discount tax:l_tax returnflag:l_returnflag linestatus:l_linestatus shipdate:l_shipdate order:l_orderkey part:l_partkey supplier:l_suppkey"),
    "events": ("Event", "ts:ts eventType:event_type value:value props:props eventId:event_id user:user_id"),
    "documents": ("Document", "text:text lang:lang source:source nchars:n_chars docId:doc_id"),
    "labels": ("", "quality:quality toxic:toxic"),
    "embeddings": ("Vector", "embedding:embedding label:label vecId:vec_id"),
    "benchmark": ("Item", "question:text"),
    "pages": ("Page", "url:url html:html"),
    "conversations": ("Turn", "turn:turn role:role said:text conversation:conv_id"),
}
_CELLS = [f"SELECT 'http://example.org/{p}' AS p, count({'CASE WHEN lang IS NOT NULL THEN text END' if (t, c) == ('documents', 'text') else c}) AS k FROM {t}" for t, (_, cs) in _TABLES.items() for p, c in (x.split(":") for x in cs.split())]
_TYPES = [f"SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, count(*) AS k FROM {t}" for t, (c, _) in _TABLES.items() if c]
_KNOWS = "SELECT 'http://example.org/knows' AS p, count(DISTINCT (o_custkey, (o_orderkey * 7 + 1) % n)) AS k FROM orders, (SELECT count(*) AS n FROM customer) WHERE o_custkey <> (o_orderkey * 7 + 1) % n"
_PREDICATES = " UNION ALL ".join([*_CELLS, *_TYPES, _KNOWS])

#: name: (query text, SQL)
QUERIES: dict[str, tuple[str, str | None]] = {
    # ------------------------------------------------------------ basic graph patterns
    "chain_join_group": (
        "SELECT ?n (SUM(?p) AS ?total) (COUNT(*) AS ?orders) WHERE { ?o ex:customer/ex:nation/ex:name ?n ; ex:totalprice ?p } GROUP BY ?n ORDER BY DESC(?total)",
        "SELECT n_name AS n, round(sum(o_totalprice), 4) AS total, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    ),
    "bgp_star_join": (
        'SELECT ?c ?name ?bal ?n WHERE { ?c a ex:Customer ; ex:name ?name ; ex:acctbal ?bal ; ex:nation ?x . ?x ex:name ?n ; ex:region ?r . ?r ex:name "ASIA" }',
        f"SELECT {_iri('customer', 'c_custkey')} AS c, c_name AS name, round(c_acctbal, 4) AS bal, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    ),
    "bgp_chain_join": (
        "SELECT ?r (COUNT(*) AS ?lines) WHERE { ?l ex:order ?o . ?o ex:customer ?c . ?c ex:nation ?n . ?n ex:region ?g . ?g ex:name ?r } GROUP BY ?r",
        "SELECT r_name AS r, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "bgp_constant_subject": (
        "SELECT ?name ?seg WHERE { <http://example.org/customer/7> ex:name ?name ; ex:segment ?seg }",
        "SELECT c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey = 7",
    ),
    "bgp_constant_object": (
        "SELECT ?c ?name WHERE { ?c ex:nation <http://example.org/nation/3> ; a ex:Customer ; ex:name ?name }",
        f"SELECT {_iri('customer', 'c_custkey')} AS c, c_name AS name FROM customer WHERE c_nationkey = 3",
    ),
    "bgp_variable_class": (
        "SELECT ?x ?n ?name WHERE { ?x ex:nation ?n ; ex:name ?name ; ex:acctbal ?b FILTER(?b > 9000) }",
        f"SELECT {_iri('customer', 'c_custkey')} AS x, {_iri('nation', 'c_nationkey')} AS n, c_name AS name FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT {_iri('supplier', 's_suppkey')}, {_iri('nation', 's_nationkey')}, s_name FROM supplier WHERE s_acctbal > 9000",
    ),
    "root_scan": ("SELECT ?c ?n WHERE { ?c a ex:Customer ; ex:name ?n }", f"SELECT {_iri('customer', 'c_custkey')} AS c, c_name AS n FROM customer"),
    "distinct_join": (
        "SELECT DISTINCT ?n WHERE { ?o ex:customer ?c . ?c ex:nation ?n }",
        f"SELECT DISTINCT {_iri('nation', 'c_nationkey')} AS n FROM orders JOIN customer ON o_custkey = c_custkey",
    ),
    "distinct_obj": ("SELECT (COUNT(DISTINCT ?c) AS ?k) WHERE { ?o ex:customer ?c }", "SELECT count(DISTINCT o_custkey) AS k FROM orders"),
    "reduced_scan": ("SELECT REDUCED ?s WHERE { ?c ex:segment ?s }", "SELECT DISTINCT c_mktsegment AS s FROM customer"),
    "ask_exists": ('ASK { ?r a ex:Region ; ex:name "EUROPE" }', "SELECT count(*) > 0 AS answer FROM region WHERE r_name = 'EUROPE'"),
    "ask_none": ('ASK { ?r a ex:Region ; ex:name "ATLANTIS" }', "SELECT count(*) > 0 AS answer FROM region WHERE r_name = 'ATLANTIS'"),
    "union_align": (
        "SELECT ?x ?bal ?size WHERE { { ?x a ex:Supplier ; ex:acctbal ?bal } UNION { ?x a ex:Part ; ex:size ?size } }",
        f"SELECT {_iri('supplier', 's_suppkey')} AS x, round(s_acctbal, 4) AS bal, NULL::BIGINT AS size FROM supplier UNION ALL SELECT {_iri('part', 'p_partkey')}, NULL, p_size FROM part",
    ),
    "values_star": (
        "SELECT ?c ?name ?seg WHERE { VALUES ?c { <http://example.org/customer/1> <http://example.org/customer/10> <http://example.org/customer/100> } ?c ex:name ?name ; ex:segment ?seg }",
        f"SELECT {_iri('customer', 'c_custkey')} AS c, c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey IN (1, 10, 100)",
    ),
    "values_undef": (
        'SELECT ?seg ?st (COUNT(*) AS ?k) WHERE { VALUES (?seg ?st) { ("BUILDING" UNDEF) (UNDEF "F") } ?c ex:segment ?seg . ?o ex:customer ?c ; ex:status ?st } GROUP BY ?seg ?st',
        "SELECT c_mktsegment AS seg, o_orderstatus AS st, sum((c_mktsegment = 'BUILDING')::INT + (o_orderstatus = 'F')::INT)::BIGINT AS k FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' OR o_orderstatus = 'F' GROUP BY 1, 2",
    ),
    # ------------------------------------------------------------ filters and expressions
    "filter_range_topk": (
        "SELECT ?o ?p WHERE { ?o ex:totalprice ?p FILTER(?p > 1000) } ORDER BY DESC(?p) ?o LIMIT 10",
        f"SELECT {_iri('order', 'o_orderkey')} AS o, round(o_totalprice, 4) AS p FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    ),
    "filter_in": (
        'SELECT ?c ?s WHERE { ?c ex:segment ?s FILTER(?s IN ("BUILDING", "MACHINERY")) }',
        f"SELECT {_iri('customer', 'c_custkey')} AS c, c_mktsegment AS s FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    ),
    "filter_not_in": (
        'SELECT (COUNT(*) AS ?k) WHERE { ?c ex:segment ?s FILTER(?s NOT IN ("BUILDING", "MACHINERY")) }',
        "SELECT count(*) AS k FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')",
    ),
    "filter_contains": ('SELECT (COUNT(*) AS ?k) WHERE { ?p a ex:Part ; ex:name ?n FILTER(CONTAINS(?n, "1")) }', "SELECT count(*) AS k FROM part WHERE contains(p_name, '1')"),
    "filter_regex_iri": (
        'SELECT (COUNT(*) AS ?k) WHERE { ?s a ex:Customer ; ex:name ?o FILTER(REGEX(STR(?s), "customer/1[0-9]{2}$")) }',
        f"SELECT count(*) AS k FROM customer WHERE regexp_matches({_iri('customer', 'c_custkey')}, 'customer/1[0-9]{{2}}$')",
    ),
    "filter_regex_flags": ('SELECT ?p WHERE { ?x a ex:Part ; ex:partkey ?p ; ex:type ?t FILTER(REGEX(?t, "^e.*5$", "i")) }', "SELECT p_partkey AS p FROM part WHERE regexp_matches(p_type, '^e.*5$', 'i')"),
    "filter_logic": (
        'SELECT ?k WHERE { ?o ex:orderkey ?k ; ex:status ?s ; ex:totalprice ?p FILTER((?s = "O" || ?p > 400000) && !(?p < 1500)) }',
        "SELECT o_orderkey AS k FROM orders WHERE (o_orderstatus = 'O' OR o_totalprice > 400000) AND NOT o_totalprice < 1500",
    ),
    "filter_dates": (
        'SELECT (COUNT(*) AS ?k) WHERE { ?l ex:shipdate ?d FILTER(?d >= "1995-01-01T00:00:00Z"^^xsd:dateTime && ?d < "1996-01-01T00:00:00Z"^^xsd:dateTime) }',
        "SELECT count(*) AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01'",
    ),
    "filter_strings_pair": (
        "SELECT (COUNT(*) AS ?k) WHERE { ?c a ex:Customer ; ex:segment ?n ; ex:nation ?x . ?x ex:name ?m FILTER(?n < ?m) }",
        "SELECT count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment < n_name",
    ),
    "filter_strlen_two": (
        "SELECT (COUNT(*) AS ?k) WHERE { ?c a ex:Customer ; ex:name ?n ; ex:nation ?x . ?x ex:name ?m FILTER(STRLEN(?n) > STRLEN(?m) + 3) }",
        "SELECT count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE length(c_name) > length(n_name) + 3",
    ),
    "filter_if_coalesce": (
        'SELECT ?k ?band ?q WHERE { ?d ex:docId ?k ; ex:nchars ?n OPTIONAL { ?d ex:quality ?l } BIND(IF(?n > 2000, "long", "short") AS ?band) BIND(COALESCE(?l, -1) AS ?q) }',
        "SELECT d.doc_id AS k, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS band, coalesce(quality, -1)::BIGINT AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "filter_bound": (
        "SELECT (COUNT(*) AS ?k) WHERE { ?d a ex:Document OPTIONAL { ?d ex:quality ?q } FILTER(!BOUND(?q)) }",
        "SELECT count(*) AS k FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL",
    ),
    "lang_filter": ('SELECT (COUNT(*) AS ?k) WHERE { ?d ex:text ?t FILTER(LANGMATCHES(LANG(?t), "en")) }', "SELECT count(*) AS k FROM documents WHERE text IS NOT NULL AND (lower(lang) = 'en' OR starts_with(lower(lang), 'en-'))"),
    "lang_group": ("SELECT ?g (COUNT(*) AS ?k) WHERE { ?d ex:text ?t BIND(LANG(?t) AS ?g) } GROUP BY ?g", "SELECT lower(lang) AS g, count(*) AS k FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY 1"),
    "expr_strings": (
        'SELECT ?k (UCASE(?n) AS ?u) (SUBSTR(?n, 3, 4) AS ?m) (CONCAT(?n, "/", STR(?k)) AS ?c) (STRBEFORE(?n, "_") AS ?b) (STRAFTER(?n, "_") AS ?a) (REPLACE(?n, "[0-9]", "x") AS ?r) (STRSTARTS(?n, "N") AS ?s) (STRENDS(?n, "1") AS ?e) (ENCODE_FOR_URI(CONCAT(?n, " ~*")) AS ?w) WHERE { ?x a ex:Nation ; ex:name ?n BIND(STRLEN(?n) AS ?k) }',
        "SELECT length(n_name) AS k, upper(n_name) AS u, substring(n_name, 3, 4) AS m, n_name || '/' || length(n_name) AS c, CASE WHEN contains(n_name, '_') THEN split_part(n_name, '_', 1) ELSE '' END AS b, CASE WHEN contains(n_name, '_') THEN substring(n_name, instr(n_name, '_') + 1) ELSE '' END AS a, regexp_replace(n_name, '[0-9]', 'x', 'g') AS r, starts_with(n_name, 'N') AS s, ends_with(n_name, '1') AS e, url_encode(n_name || ' ~*') AS w FROM nation",
    ),
    "expr_numbers": (
        "SELECT ?k (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) (?b * 2 - 1 AS ?m) (?k / 4 AS ?q) (-?k AS ?n) (fn:numeric-mod(?k, 7) AS ?o) WHERE { ?x a ex:Supplier ; ex:suppkey ?k ; ex:acctbal ?b }",
        "SELECT s_suppkey AS k, round(abs(s_acctbal), 4) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, floor(s_acctbal + 0.5) AS r, round(s_acctbal * 2 - 1, 4) AS m, round(s_suppkey / 4.0, 4)::DOUBLE AS q, -s_suppkey AS n, s_suppkey % 7 AS o FROM supplier",
    ),
    "expr_dates": (
        "SELECT ?k (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?t) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?i) (TZ(?d) AS ?z) WHERE { ?e ex:eventId ?k ; ex:ts ?d }",
        "SELECT event_id AS k, year(ts) AS y, month(ts) AS m, day(ts) AS t, hour(ts) AS h, minute(ts) AS i, 'Z' AS z FROM events",
    ),
    "expr_hashes": (
        "SELECT ?n (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) WHERE { ?x a ex:Region ; ex:name ?n }",
        "SELECT r_name AS n, md5(r_name) AS a, sha1(r_name) AS b, sha256(r_name) AS c FROM region",
    ),
    "expr_casts": (
        'SELECT ?k (xsd:integer(?b) AS ?i) (xsd:string(?k) AS ?s) (xsd:double(STR(?k)) AS ?d) (xsd:integer("x1") AS ?bad) (xsd:boolean(?k) AS ?t) WHERE { ?x a ex:Supplier ; ex:suppkey ?k ; ex:acctbal ?b }',
        "SELECT s_suppkey AS k, trunc(s_acctbal)::BIGINT AS i, s_suppkey::VARCHAR AS s, s_suppkey::DOUBLE AS d, NULL::BIGINT AS bad, s_suppkey <> 0 AS t FROM supplier",
    ),
    "expr_terms": (
        "SELECT ?k (ISIRI(?x) AS ?i) (ISLITERAL(?k) AS ?l) (ISNUMERIC(?k) AS ?n) (STR(DATATYPE(?k)) AS ?d) (SAMETERM(?k, ?k) AS ?s) (STR(?x) AS ?t) WHERE { ?x a ex:Nation ; ex:name ?k }",
        f"SELECT n_name AS k, true AS i, true AS l, false AS n, 'http://www.w3.org/2001/XMLSchema#string' AS d, true AS s, {_iri('nation', 'n_nationkey')} AS t FROM nation",
    ),
    "expr_math": (
        "SELECT ?k (math:sqrt(?k) AS ?s) (math:pow(?k, 2) AS ?p) (math:exp(?k / 100.0) AS ?e) (math:log10(?k + 1) AS ?l) (math:sin(?k) AS ?n) (math:atan2(?k, 2) AS ?t) (afn:max(?k, 10) AS ?m) WHERE { ?x a ex:Supplier ; ex:suppkey ?k }",
        "SELECT s_suppkey AS k, round(sqrt(s_suppkey), 4) AS s, round(pow(s_suppkey, 2), 4) AS p, round(exp(s_suppkey / 100.0), 4) AS e, round(log10(s_suppkey + 1), 4) AS l, round(sin(s_suppkey), 4) AS n, round(atan2(s_suppkey, 2), 4) AS t, greatest(s_suppkey, 10) AS m FROM supplier",
    ),
    "expr_bind_group": (
        "SELECT ?band (COUNT(*) AS ?k) WHERE { ?p a ex:Part ; ex:size ?z BIND(FLOOR(?z / 10) * 10 AS ?band) } GROUP BY ?band ORDER BY ?band",
        "SELECT (floor(p_size / 10) * 10)::DOUBLE AS band, count(*) AS k FROM part GROUP BY 1",
    ),
    "expr_order_key": (
        "SELECT ?k ?z WHERE { ?p ex:partkey ?k ; ex:size ?z } ORDER BY DESC(ABS(?z - 25)) ?k LIMIT 10",
        "SELECT p_partkey AS k, p_size AS z FROM part ORDER BY abs(p_size - 25) DESC, p_partkey LIMIT 10",
    ),
    "expr_agg_arg": (
        "SELECT ?s (SUM(?z * 12) AS ?m) WHERE { ?p ex:brand ?s ; ex:size ?z } GROUP BY ?s ORDER BY DESC(?m) ?s LIMIT 5",
        "SELECT p_brand AS s, sum(p_size * 12)::BIGINT AS m FROM part GROUP BY p_brand ORDER BY m DESC, s LIMIT 5",
    ),
    "expr_exists_value": (
        "SELECT ?k (EXISTS { ?d ex:toxic 1 } AS ?t) WHERE { ?d ex:docId ?k }",
        "SELECT doc_id AS k, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS t FROM documents",
    ),
    "let_assign": ("SELECT ?k ?twice WHERE { ?x ex:suppkey ?k LET(?twice := ?k * 2) LET(?twice := ?k + ?k) }", "SELECT s_suppkey AS k, s_suppkey * 2 AS twice FROM supplier"),
    # ------------------------------------------------------------ joins
    "optional_chain": (
        "SELECT ?k ?b ?n WHERE { ?d ex:docId ?k OPTIONAL { ?d ex:quality ?b OPTIONAL { ?d ex:toxic ?n FILTER(?n = 1) } } }",
        "SELECT d.doc_id AS k, quality::BIGINT AS b, CASE WHEN toxic = 1 THEN 1 END::BIGINT AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "optional_filter": (
        "SELECT ?k ?q WHERE { ?d ex:docId ?k ; ex:nchars ?n OPTIONAL { ?d ex:quality ?q FILTER(?n > 1000) } }",
        "SELECT d.doc_id AS k, quality::BIGINT AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND n_chars > 1000",
    ),
    "optional_count": ("SELECT (COUNT(*) AS ?k) WHERE { ?c a ex:Customer OPTIONAL { ?o ex:customer ?c } }", "SELECT count(*) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey"),
    "minus": ("SELECT (COUNT(*) AS ?k) WHERE { ?c a ex:Customer MINUS { ?o ex:customer ?c } }", "SELECT count(*) AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "minus_disjoint": ("SELECT (COUNT(*) AS ?k) WHERE { ?c a ex:Customer MINUS { ?x a ex:Region } }", "SELECT count(*) AS k FROM customer"),
    "not_exists": ("SELECT ?k WHERE { ?c ex:custkey ?k FILTER NOT EXISTS { ?o ex:customer ?c } }", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "exists_join": (
        'SELECT (COUNT(*) AS ?k) WHERE { ?o a ex:Order ; ex:customer ?c FILTER EXISTS { ?c ex:nation ?n . ?n ex:region ?r . ?r ex:name "ASIA" } }',
        "SELECT count(*) AS k FROM orders WHERE EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey = o_custkey AND r_name = 'ASIA')",
    ),
    "exists_correlated": (
        "SELECT (COUNT(*) AS ?k) WHERE { ?c a ex:Customer ; ex:acctbal ?b FILTER EXISTS { ?o ex:customer ?c ; ex:totalprice ?p FILTER(?p > ?b * 40) } }",
        "SELECT count(*) AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)",
    ),
    "semijoin": ("SELECT ?k WHERE { ?c ex:custkey ?k SEMIJOIN { ?o ex:customer ?c ; ex:status \"F\" } }", "SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "antijoin": ("SELECT ?k WHERE { ?c ex:custkey ?k ANTIJOIN { ?o ex:customer ?c ; ex:status \"F\" } }", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "keyed_equality": (
        "SELECT (COUNT(*) AS ?k) WHERE { ?p a ex:Part ; ex:size ?a . ?s a ex:Supplier ; ex:suppkey ?b FILTER(?a = ?b) }",
        "SELECT count(*) AS k FROM part JOIN supplier ON p_size = s_suppkey",
    ),
    "keyed_optional": (
        "SELECT (COUNT(*) AS ?k) (COUNT(?b) AS ?m) WHERE { ?p a ex:Part ; ex:size ?a OPTIONAL { ?s a ex:Supplier ; ex:suppkey ?b FILTER(?a = ?b) } }",
        "SELECT count(*) AS k, count(s_suppkey) AS m FROM part LEFT JOIN supplier ON p_size = s_suppkey",
    ),
    "theta_join": (
        "SELECT (COUNT(*) AS ?k) WHERE { ?a a ex:Nation ; ex:name ?x ; ex:region ?r . ?b a ex:Nation ; ex:name ?y ; ex:region ?r FILTER(?x < ?y) }",
        "SELECT count(*) AS k FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name",
    ),
    "lateral_topk": (
        "SELECT ?n ?k ?p WHERE { ?c a ex:Customer ; ex:custkey ?n LATERAL { SELECT ?c ?k ?p WHERE { ?o ex:customer ?c ; ex:orderkey ?k ; ex:totalprice ?p } ORDER BY DESC(?p) ?k LIMIT 2 } }",
        "SELECT o_custkey AS n, o_orderkey AS k, round(o_totalprice, 4) AS p FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2",
    ),
    "two_hop_count": (
        "SELECT (COUNT(*) AS ?k) WHERE { ?a ex:part ?p . ?b ex:part ?p }",
        "SELECT sum(n * n)::BIGINT AS k FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)",
    ),
    "count_join_star": (
        "SELECT (COUNT(*) AS ?k) WHERE { ?l ex:order ?o ; ex:quantity ?q . ?o ex:customer ?c }",
        "SELECT count(*) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    ),
    # ------------------------------------------------------------ groups
    "group_avg": (
        "SELECT ?n (AVG(?b) AS ?m) (COUNT(?c) AS ?k) WHERE { ?c a ex:Customer ; ex:nation ?n ; ex:acctbal ?b } GROUP BY ?n ORDER BY DESC(?k) ?n LIMIT 10",
        f"SELECT {_iri('nation', 'c_nationkey')} AS n, round(avg(c_acctbal), 4) AS m, count(*) AS k FROM customer GROUP BY c_nationkey ORDER BY k DESC, c_nationkey LIMIT 10",
    ),
    "group_many": (
        "SELECT ?f ?s (SUM(?q) AS ?a) (AVG(?p) AS ?b) (MIN(?p) AS ?c) (MAX(?p) AS ?d) (COUNT(*) AS ?e) WHERE { ?l ex:returnflag ?f ; ex:linestatus ?s ; ex:quantity ?q ; ex:extendedprice ?p } GROUP BY ?f ?s",
        "SELECT l_returnflag AS f, l_linestatus AS s, round(sum(l_quantity), 4) AS a, round(avg(l_extendedprice), 4) AS b, round(min(l_extendedprice), 4) AS c, round(max(l_extendedprice), 4) AS d, count(*) AS e FROM lineitem GROUP BY 1, 2",
    ),
    "having": ("SELECT ?s (COUNT(*) AS ?k) WHERE { ?c ex:segment ?s } GROUP BY ?s HAVING(COUNT(*) > 290)", "SELECT c_mktsegment AS s, count(*) AS k FROM customer GROUP BY 1 HAVING count(*) > 290"),
    "count_distinct": ("SELECT ?s (COUNT(DISTINCT ?n) AS ?k) WHERE { ?c ex:segment ?s ; ex:nation ?n } GROUP BY ?s", "SELECT c_mktsegment AS s, count(DISTINCT c_nationkey) AS k FROM customer GROUP BY 1"),
    "count_distinct_star": ("SELECT (COUNT(DISTINCT *) AS ?k) WHERE { ?c ex:segment ?s ; ex:nation ?n }", "SELECT count(*) AS k FROM (SELECT DISTINCT c_custkey, c_mktsegment, c_nationkey FROM customer)"),
    "sum_distinct": ("SELECT (SUM(DISTINCT ?z) AS ?a) (AVG(DISTINCT ?z) AS ?b) WHERE { ?p ex:size ?z }", "SELECT sum(DISTINCT p_size)::BIGINT AS a, round(avg(DISTINCT p_size), 4) AS b FROM part"),
    "sample": ("SELECT ?r (SAMPLE(?n) AS ?x) WHERE { ?a a ex:Nation ; ex:region ?r ; ex:name ?n } GROUP BY ?r", f"SELECT {_iri('region', 'n_regionkey')} AS r, min(n_name) AS x FROM nation GROUP BY n_regionkey"),
    "group_concat": (
        'SELECT ?r (GROUP_CONCAT(?n; SEPARATOR="|") AS ?x) WHERE { ?a a ex:Nation ; ex:region ?r ; ex:name ?n } GROUP BY ?r',
        f"SELECT {_iri('region', 'n_regionkey')} AS r, string_agg(n_name, '|' ORDER BY n_name) AS x FROM nation GROUP BY n_regionkey",
    ),
    "median": ("SELECT ?s (MEDIAN(?b) AS ?m) WHERE { ?c ex:segment ?s ; ex:acctbal ?b } GROUP BY ?s", "SELECT c_mktsegment AS s, round(median(c_acctbal), 4) AS m FROM customer GROUP BY 1"),
    "mode": (
        "SELECT ?b (MODE(?z) AS ?m) WHERE { ?p ex:brand ?b ; ex:size ?z } GROUP BY ?b",
        "SELECT b, z::DOUBLE AS m FROM (SELECT p_brand AS b, p_size AS z, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS r FROM part GROUP BY 1, 2) WHERE r = 1",
    ),
    "stdev": (
        "SELECT ?s (STDEV(?b) AS ?a) (STDEV_POP(?b) AS ?c) (VARIANCE(?b) AS ?d) (VAR_POP(?b) AS ?e) WHERE { ?c ex:segment ?s ; ex:acctbal ?b } GROUP BY ?s",
        "SELECT c_mktsegment AS s, round(stddev_samp(c_acctbal), 4) AS a, round(stddev_pop(c_acctbal), 4) AS c, round(var_samp(c_acctbal), 4) AS d, round(var_pop(c_acctbal), 4) AS e FROM customer GROUP BY 1",
    ),
    "aggregate_errors": (
        "SELECT ?g (SUM(?q) AS ?s) (COUNT(?q) AS ?k) WHERE { ?d ex:source ?g OPTIONAL { ?d ex:quality ?q } } GROUP BY ?g",
        "SELECT source AS g, CASE WHEN count(*) = count(quality) THEN sum(quality)::BIGINT END AS s, count(quality) AS k FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE source IS NOT NULL GROUP BY 1",
    ),
    "subquery_agg": (
        "SELECT ?c ?k WHERE { { SELECT ?c (COUNT(?o) AS ?k) WHERE { ?o ex:customer ?c } GROUP BY ?c } FILTER(?k > 15) }",
        f"SELECT {_iri('customer', 'o_custkey')} AS c, count(*) AS k FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    ),
    "order_by_full": ("SELECT ?c ?n WHERE { ?c a ex:Customer ; ex:name ?n } ORDER BY ?n", f"SELECT {_iri('customer', 'c_custkey')} AS c, c_name AS n FROM customer"),
    "order_lcase": ("SELECT ?k ?n WHERE { ?c ex:custkey ?k ; ex:name ?n } ORDER BY LCASE(?n) ?k LIMIT 20 OFFSET 5", "SELECT c_custkey AS k, c_name AS n FROM customer ORDER BY lower(c_name), c_custkey LIMIT 20 OFFSET 5"),
    # ------------------------------------------------------------ composite values
    "fold_list": (
        "SELECT ?r (cdt:size(?l) AS ?k) (cdt:get(?l, 1) AS ?first) WHERE { { SELECT ?r (FOLD(?n ORDER BY ?n) AS ?l) WHERE { ?a a ex:Nation ; ex:region ?r ; ex:name ?n } GROUP BY ?r } }",
        f"SELECT {_iri('region', 'n_regionkey')} AS r, count(*) AS k, min(n_name) AS first FROM nation GROUP BY n_regionkey",
    ),
    "fold_map": (
        "SELECT ?r (cdt:get(?m, ?top) AS ?x) WHERE { { SELECT ?r (FOLD(?n, ?n) AS ?m) (MAX(?n) AS ?top) WHERE { ?a a ex:Nation ; ex:region ?r ; ex:name ?n } GROUP BY ?r } }",
        f"SELECT {_iri('region', 'n_regionkey')} AS r, max(n_name) AS x FROM nation GROUP BY n_regionkey",
    ),
    "unfold_list": (
        'SELECT ?k ?x ?i WHERE { ?s ex:suppkey ?k UNFOLD("[3, 4, 5]"^^cdt:List AS ?x, ?i) FILTER(?k < ?x) }',
        "SELECT s_suppkey AS k, x::BIGINT AS x, i::BIGINT AS i FROM supplier, (VALUES (3, 1), (4, 2), (5, 3)) v(x, i) WHERE s_suppkey < x",
    ),
    "unfold_map": (
        'SELECT ?k ?x ?y WHERE { ?s ex:suppkey ?k UNFOLD("{1: 10, 2: 20}"^^cdt:Map AS ?x, ?y) FILTER(?k = ?x) }',
        "SELECT s_suppkey AS k, x::BIGINT AS x, y::BIGINT AS y FROM supplier, (VALUES (1, 10), (2, 20)) v(x, y) WHERE s_suppkey = x",
    ),
    "cdt_functions": (
        "SELECT ?k (cdt:size(?l) AS ?a) (cdt:contains(?l, ?k) AS ?b) (cdt:head(cdt:reverse(?l)) AS ?c) (cdt:size(cdt:tail(?l)) AS ?d) (cdt:get(cdt:concat(?l, ?l), 5) AS ?e) (cdt:head(cdt:subseq(?l, 2, 1)) AS ?f) WHERE { ?s ex:suppkey ?k BIND(cdt:List(1, 2, ?k) AS ?l) }",
        "SELECT s_suppkey AS k, 3::BIGINT AS a, true AS b, s_suppkey AS c, 2::BIGINT AS d, 2::BIGINT AS e, 2::BIGINT AS f FROM supplier",
    ),
    # ------------------------------------------------------------ whole graph
    "count_all": ("SELECT (COUNT(*) AS ?k) WHERE { ?s ?p ?o }", f"SELECT sum(k)::BIGINT AS k FROM ({_PREDICATES})"),
    "predicate_counts": ("SELECT ?p (COUNT(*) AS ?k) WHERE { ?s ?p ?o } GROUP BY ?p", f"SELECT p, sum(k)::BIGINT AS k FROM ({_PREDICATES}) GROUP BY p"),
    "spo_of_class": ("SELECT (COUNT(*) AS ?k) WHERE { { SELECT ?s ?p ?o WHERE { ?s ?p ?o . ?s a ex:Nation } } }", "SELECT count(*) * 3 AS k FROM nation"),
    "class_counts": (
        "SELECT ?t (COUNT(?s) AS ?k) WHERE { ?s a ?t } GROUP BY ?t ORDER BY DESC(?k)",
        " UNION ALL ".join(f"SELECT 'http://example.org/{c}' AS t, count(*) AS k FROM {t}" for c, t in (("Region", "region"), ("Nation", "nation"), ("Customer", "customer"), ("Supplier", "supplier"), ("Part", "part"), ("Order", "orders"), ("Lineitem", "lineitem"), ("Event", "events"), ("Document", "documents"), ("Vector", "embeddings"), ("Item", "benchmark"), ("Page", "pages"), ("Turn", "conversations"))),
    ),
    "spo_filter": (
        "SELECT ?p (COUNT(DISTINCT ?s) AS ?k) WHERE { ?s a ex:Supplier . ?s ?p ?o } GROUP BY ?p",
        " UNION ALL ".join(f"SELECT '{p}' AS p, count(*) AS k FROM supplier" for p in ("http://example.org/name", "http://example.org/acctbal", "http://example.org/suppkey", "http://example.org/nation", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type")),
    ),
    "class_predicate_list": (
        "SELECT DISTINCT ?p WHERE { ?s a ex:Region . ?s ?p ?o }",
        "SELECT * FROM (VALUES ('http://example.org/name'), ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type')) v(p)",
    ),
    # ------------------------------------------------------------ paths
    "path_seq_inv": (
        "SELECT ?n (COUNT(*) AS ?k) WHERE { ?n ^ex:nation/^ex:customer ?o } GROUP BY ?n",
        f"SELECT {_iri('nation', 'c_nationkey')} AS n, count(*) AS k FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey",
    ),
    "path_alt": (
        "SELECT (COUNT(*) AS ?k) WHERE { ?n a ex:Nation ; ex:name|ex:region ?x }",
        "SELECT count(*) * 2 AS k FROM nation",
    ),
    "path_optional": (
        "SELECT ?x WHERE { <http://example.org/nation/3> ex:region? ?x }",
        f"SELECT {_iri('nation', '3')} AS x UNION ALL SELECT {_iri('region', 'n_regionkey')} FROM nation WHERE n_nationkey = 3",
    ),
    "path_plus": (
        "SELECT (COUNT(*) AS ?k) WHERE { <http://example.org/customer/1> ex:knows+ ?x }",
        "WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer), e AS (SELECT DISTINCT o_custkey AS s, (o_orderkey * 7 + 1) % n AS d FROM orders, n WHERE o_custkey <> (o_orderkey * 7 + 1) % n), r AS (SELECT d FROM e WHERE s = 1 UNION SELECT e.d FROM r JOIN e ON r.d = e.s) SELECT count(*) AS k FROM r",
    ),
    "path_star": (
        "SELECT (COUNT(*) AS ?k) WHERE { <http://example.org/customer/1> ex:knows* ?x }",
        "WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer), e AS (SELECT DISTINCT o_custkey AS s, (o_orderkey * 7 + 1) % n AS d FROM orders, n WHERE o_custkey <> (o_orderkey * 7 + 1) % n), r AS (SELECT 1::BIGINT AS d UNION SELECT e.d FROM r JOIN e ON r.d = e.s) SELECT count(*) AS k FROM r",
    ),
    "path_bounded": (
        "SELECT (COUNT(*) AS ?k) WHERE { <http://example.org/customer/1> ex:knows{1,2} ?x }",
        "WITH n AS (SELECT count(*) AS n FROM customer), e AS (SELECT DISTINCT o_custkey AS s, (o_orderkey * 7 + 1) % n AS d FROM orders, n WHERE o_custkey <> (o_orderkey * 7 + 1) % n) SELECT (SELECT count(*) FROM e WHERE s = 1) + (SELECT count(*) FROM e a JOIN e b ON a.d = b.s WHERE a.s = 1) AS k",
    ),
    "path_negated": (
        "SELECT (COUNT(*) AS ?k) WHERE { ?x a ex:Nation . ?x !(ex:name|rdf:type) ?y }",
        "SELECT count(*) AS k FROM nation",
    ),
    "path_zero_constant": (
        "SELECT ?x WHERE { <http://example.org/nation/3> ex:knows* ?x }",
        "SELECT 'http://example.org/nation/3' AS x",
    ),
    "path_zero_nodes": (
        "SELECT (COUNT(*) AS ?k) WHERE { ?c a ex:Customer . ?c ex:knows? ?x }",
        "WITH n AS (SELECT count(*) AS n FROM customer), e AS (SELECT DISTINCT o_custkey AS s, (o_orderkey * 7 + 1) % n AS d FROM orders, n WHERE o_custkey <> (o_orderkey * 7 + 1) % n) SELECT (SELECT count(*) FROM e JOIN customer ON s = c_custkey) + (SELECT count(*) FROM customer) AS k",
    ),
    "path_zero_graph": (
        "SELECT ?x WHERE { ?x ex:region? <http://example.org/region/1> }",
        "SELECT 'http://example.org/nation/' || n_nationkey AS x FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'http://example.org/region/1'",
    ),
    # ------------------------------------------------------------ what differs by row
    "exists_in_or": (
        "SELECT ?k WHERE { ?c a ex:Customer ; ex:custkey ?k ; ex:acctbal ?b FILTER(?k < 0 || EXISTS { ?p a ex:Part ; ex:retailprice ?r FILTER(?r > ?b) }) }",
        "SELECT c_custkey AS k FROM customer WHERE c_acctbal < (SELECT max(p_retailprice) FROM part)",
    ),
    "exists_in_bind": (
        "SELECT ?k ?e WHERE { ?n a ex:Nation ; ex:name ?k ; ex:region ?r BIND(IF(EXISTS { ?m ex:region ?r ; ex:name ?l FILTER(?l > ?k) }, 1, 0) AS ?e) }",
        "SELECT n_name AS k, CASE WHEN EXISTS (SELECT 1 FROM nation m WHERE m.n_regionkey = n.n_regionkey AND m.n_name > n.n_name) THEN 1 ELSE 0 END::BIGINT AS e FROM nation n",
    ),
    "optional_join": (
        "SELECT ?k ?q (COUNT(*) AS ?c) WHERE { ?d a ex:Document ; ex:docId ?k OPTIONAL { ?d ex:quality ?q } ?e ex:toxic ?q } GROUP BY ?k ?q",
        "SELECT k, t AS q, sum(n)::BIGINT AS c FROM (SELECT d.doc_id AS k, x.toxic AS t, x.n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id, (SELECT toxic, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY 1) x WHERE l.quality IS NULL OR l.quality = x.toxic) GROUP BY 1, 2",
    ),
    "optional_optional": (
        "SELECT ?k ?q ?l WHERE { ?d a ex:Document ; ex:docId ?k OPTIONAL { ?d ex:quality ?q } OPTIONAL { VALUES (?q ?l) { (0 \"low\") (1 \"high\") } } }",
        "SELECT d.doc_id AS k, x.q::BIGINT AS q, x.l FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id, (VALUES (0, 'low'), (1, 'high')) x(q, l) WHERE l.quality IS NULL OR l.quality = x.q",
    ),
    "minus_optional": (
        "SELECT ?k WHERE { ?d a ex:Document ; ex:docId ?k OPTIONAL { ?d ex:quality ?q } MINUS { VALUES ?q { 1 } } }",
        "SELECT d.doc_id AS k FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL OR l.quality <> 1",
    ),
    "group_concat_order": (
        "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=\",\" ORDER BY DESC(?n)) AS ?x) WHERE { ?c a ex:Nation ; ex:region ?r ; ex:name ?n } GROUP BY ?r",
        "SELECT 'http://example.org/region/' || n_regionkey AS r, string_agg(n_name, ',' ORDER BY n_name DESC) AS x FROM nation GROUP BY n_regionkey",
    ),
    "fold_order": (
        "SELECT (STR(FOLD(?k ORDER BY ?r DESC(?k))) AS ?x) WHERE { ?n a ex:Nation ; ex:region ?r ; ex:name ?k }",
        "SELECT '[\"' || string_agg(n_name, '\",\"' ORDER BY n_regionkey, n_name DESC) || '\"]' AS x FROM nation",
    ),
    "fold_unbound": (
        "SELECT (cdt:size(FOLD(?q)) AS ?x) WHERE { ?d a ex:Document OPTIONAL { ?d ex:quality ?q } }",
        "SELECT count(*) AS x FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    ),
    "list_mixed": (
        "SELECT ?n (cdt:get(?l, 1) + 1 AS ?a) (DATATYPE(cdt:get(?l, 2)) AS ?b) (cdt:contains(?l, \"x\") AS ?c) (STR(?l) AS ?t) WHERE { ?r a ex:Region ; ex:name ?n BIND(\"[1, 'x', true, null, 2.5]\"^^cdt:List AS ?l) }",
        "SELECT r_name AS n, 2.0::DOUBLE AS a, 'http://www.w3.org/2001/XMLSchema#string' AS b, true AS c, '[1,\"x\",true,null,2.5E0]' AS t FROM region",
    ),
    "times_with_zones": (
        'SELECT ?k (HOURS(?d) AS ?h) (DAY(?d) AS ?y) (TZ(?d) AS ?z) (TIMEZONE(?d) AS ?t) WHERE { VALUES (?k ?d) { (1 "2011-01-10T14:45:13.815-05:00"^^xsd:dateTime) (2 "2011-01-10T23:45:13Z"^^xsd:dateTime) (3 "2011-01-10T01:45:13"^^xsd:dateTime) (4 "2011-01-10T01:45:13+05:30"^^xsd:dateTime) } }',
        "SELECT k::BIGINT AS k, h::BIGINT AS h, y::BIGINT AS y, z, t FROM (VALUES (1, 14, 10, '-05:00', '-PT5H'), (2, 23, 10, 'Z', 'PT0S'), (3, 1, 10, '', NULL), (4, 1, 10, '+05:30', 'PT5H30M')) x(k, h, y, z, t)",
    ),
    "times_compared": (
        'SELECT ?a ?b WHERE { VALUES (?a ?d) { (1 "2011-01-10T14:45:13-05:00"^^xsd:dateTime) (2 "2011-01-10T19:45:13Z"^^xsd:dateTime) (3 "2011-01-10T19:45:14+01:00"^^xsd:dateTime) } VALUES (?b ?e) { (1 "2011-01-10T14:45:13-05:00"^^xsd:dateTime) (2 "2011-01-10T19:45:13Z"^^xsd:dateTime) (3 "2011-01-10T19:45:14+01:00"^^xsd:dateTime) } FILTER(?d <= ?e) }',
        "SELECT a::BIGINT AS a, b::BIGINT AS b FROM (VALUES (1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3)) x(a, b)",
    ),
    # ------------------------------------------------------------ property functions
    "property_text": (
        'SELECT ?k WHERE { (?d ?score) text:query (ex:text "+of +the") . ?d ex:docId ?k }',
        r"SELECT doc_id AS k FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL) WHERE list_contains(t, 'of') AND list_contains(t, 'the')",
    ),
    "property_split": (
        "SELECT ?n ?l ?c WHERE { ?x a ex:Region ; ex:name ?m . ?x apf:splitIRI (?n ?l) . ?c apf:concat (?m \"!\") }",
        "SELECT 'http://example.org/region/' || r_regionkey AS n, '' AS l, r_name || '!' AS c FROM region",
    ),
    "geo_functions": (
        'SELECT ?k (geof:area(?g) AS ?a) (geof:sfWithin("POINT(1 1)"^^geo:wktLiteral, ?g) AS ?w) WHERE { ?x a ex:Supplier ; ex:suppkey ?k BIND(STRDT(CONCAT("POLYGON((0 0, ", STR(?k), " 0, ", STR(?k), " 2, 0 2, 0 0))"), geo:wktLiteral) AS ?g) FILTER(?k > 0) }',
        "SELECT s_suppkey AS k, s_suppkey * 2.0::DOUBLE AS a, s_suppkey > 1 AS w FROM supplier WHERE s_suppkey > 0",
    ),
    # ------------------------------------------------------------ vectors
    "vector_topk": (
        "SELECT ?k (vec:cosine(?e, ?q) AS ?score) WHERE { <http://example.org/vector/7> ex:embedding ?q . ?v ex:vecId ?k ; ex:embedding ?e } ORDER BY DESC(?score) ?k LIMIT 10",
        "SELECT a.vec_id AS k, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, a.vec_id LIMIT 10",
    ),
    "vector_functions": (
        "SELECT ?k (vec:dot(?e, ?e) AS ?d) (vec:euclidean(?e, ?q) AS ?u) (vec:dimension(?e) AS ?n) WHERE { <http://example.org/vector/7> ex:embedding ?q . ?v ex:vecId ?k ; ex:embedding ?e }",
        "SELECT a.vec_id AS k, round(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]), 4) AS d, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS u, len(a.embedding) AS n FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .operators import registry, registry_stored  # noqa: F401

    return {name: sparql(text) for name, (text, _) in QUERIES.items()} | registry.queries()


def oracle_sql() -> dict[str, str]:
    from .operators import registry, registry_stored  # noqa: F401

    return {name: sql for name, (_, sql) in QUERIES.items() if sql} | registry.oracle_sql()
