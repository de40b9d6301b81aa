"""Virtual graphs: mappings from tables to triples that stay unmaterialised."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lanes import DYN, RDF, Lane, natural, to_dyn

EX = "http://example.org/"
TYPE = RDF + "type"


@dataclass
class ObjectMap:
    """One predicate of a row: a column, its lane, and for language strings the tag's column."""

    predicate: str
    column: str
    prefix: str | None = None  # an IRI with this prefix
    lane: Lane | None = None
    lang: str | None = None


@dataclass
class TriplesMap:
    """Rows of a table as subjects."""

    name: str
    table: Callable[[], DataFrame]
    prefix: str | None  # None: a blank node for each row
    key: str | None
    classes: list[str]
    objects: list[ObjectMap]
    graph: str | None = None
    _df: DataFrame | None = field(default=None, repr=False)

    def df(self) -> DataFrame:
        if self._df is None:
            self._df = self.table()
        return self._df

    def subject(self) -> tuple[Column, Lane]:
        if self.prefix is None:
            # A row without a key is its own identity; the digest is only made if the subject is read.
            df = self.df()
            return F.sha2(F.to_json(F.struct(*[df[c] for c in df.columns])), 256), Lane("bnode")
        return F.col(self.key), Lane("iri", prefix=self.prefix)

    def object(self, o: ObjectMap) -> tuple[Column, Lane]:
        if o.prefix is not None:
            return F.col(o.column), Lane("iri", prefix=o.prefix)
        if o.lang is not None:
            return F.when(F.col(o.column).isNotNull() & F.col(o.lang).isNotNull(), F.struct(F.col(o.column).alias("lex"), F.lower(F.col(o.lang)).alias("lang"))), Lane("lang")
        return F.col(o.column), o.lane or natural(self.df().schema[o.column].dataType)

    def predicates(self) -> set[str]:
        return {o.predicate for o in self.objects} | ({TYPE} if self.classes else set())


@dataclass(frozen=True)
class Named:
    """The named graphs that a variable ranges over: all, or those of a query's dataset."""

    var: str
    allowed: tuple[str, ...] | None = None


#: A query's graph: the default one, one by name, several as one, or a variable's.
Scope = str | tuple[str, ...] | Named | None


def within(graph: str | None, scope: Scope) -> bool:
    """Whether a mapping's graph belongs to the scope."""
    if scope is None or isinstance(scope, str):
        return graph == scope
    if isinstance(scope, tuple):
        return graph in scope
    return graph is not None and (scope.allowed is None or graph in scope.allowed)


class VirtualGraph:
    """A set of triples maps, and optionally quads as term structs (g, s, p, o)."""

    def __init__(self, spark: SparkSession, maps: list[TriplesMap], quads: DataFrame | None = None, quads_of: Callable[[list[str] | None], DataFrame] | None = None):
        self.spark = spark
        self.maps = maps
        self.quads = quads
        self.quads_of = quads_of  # the quads of some predicates, where a store can read these alone

    def with_quads(self, quads: DataFrame) -> VirtualGraph:
        return VirtualGraph(self.spark, self.maps, quads)

    def triples(self, predicates: list[str] | None = None, graph: Scope = None, prefixes: set | None = None, native: bool = False) -> DataFrame | None:
        """All triples (s, p, o) as term structs; only sources of a wanted predicate and subject prefix are read; ``native`` subjects stay key columns.

        Of several graphs a triple comes once; of named graphs it comes with its graph (g).
        """
        parts = []
        named = isinstance(graph, Named)
        for m in self.maps:
            if not within(m.graph, graph) or prefixes is not None and m.prefix not in prefixes:
                continue
            s, lane = m.subject()
            subject = s if native else to_dyn(s, lane)
            wanted = [o for o in m.objects if predicates is None or o.predicate in predicates]
            items = []
            for o in wanted:
                c, l = m.object(o)
                items.append(F.struct(F.lit(o.predicate).alias("p"), to_dyn(c, l).alias("o")))
            if predicates is None or TYPE in predicates:
                items += [F.struct(F.lit(TYPE).alias("p"), to_dyn(F.lit(c), Lane("iri")).alias("o")) for c in m.classes]
            if items:
                # One scan a table: its cells are exploded, not unioned.
                rows = m.df().select(subject.alias("s"), F.explode(F.array(*items)).alias("_x")).where(F.col("_x.o").isNotNull() & F.col("s").isNotNull())
                parts.append(rows.select("s", F.col("_x.p").alias("p"), F.col("_x.o").alias("o"), *([F.lit(m.graph).alias("g")] if named else [])))
        if self.quads is not None:
            g = F.col("g")
            held = g.isNull() if graph is None else g == graph if isinstance(graph, str) else g.isin(*graph) if isinstance(graph, tuple) else g.isNotNull() if graph.allowed is None else g.isin(*graph.allowed)
            q = (self.quads if self.quads_of is None else self.quads_of(predicates)).where(held)
            if predicates is not None:
                q = q.where(F.col("p").isin(*predicates))
            parts.append(q.select("s", "p", "o", *(["g"] if named else [])))
        out = None
        for part in parts:
            out = part if out is None else out.unionByName(part)
        if out is not None and isinstance(graph, tuple) and len(graph) > 1:
            out = out.distinct()
        return out

    def graph_names(self) -> DataFrame:
        """(g): every named graph that has a triple."""
        names = self.spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in sorted({m.graph for m in self.maps if m.graph})]).cast("array<string>")).alias("g"))
        return names if self.quads is None else names.union(self.quads.select("g").where("g is not null")).distinct()

    def predicate_counts(self) -> DataFrame:
        """Triples by predicate without building a term: one count of cells a table."""
        parts = []
        for m in self.maps:
            counts = [F.count(m.object(o)[0]).alias(f"c{i}") for i, o in enumerate(m.objects)]
            names = [o.predicate for o in m.objects]
            if m.classes:
                counts.append((F.count("*") * len(m.classes)).alias(f"c{len(names)}"))
                names.append(TYPE)
            row = m.df().agg(*counts)
            parts.append(row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("p"), F.col(f"c{i}").alias("c")) for i, n in enumerate(names)])).alias("x")).select("x.p", "x.c"))
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        if self.quads is not None:
            out = out.union(self.quads.groupBy("p").agg(F.count("*").alias("c")).select("p", "c"))
        return out.groupBy("p").agg(F.sum("c").alias("c")).where("c > 0")

    def class_counts(self) -> DataFrame:
        """(c, n): subjects by class, a count of keys for each table."""
        out = None
        for m in self.maps:
            if m.classes:
                n = F.count("*" if m.key is None else m.key)
                part = m.df().agg(n.alias("n")).select(F.explode(F.array(*[F.lit(c) for c in m.classes])).alias("c"), "n")
                out = part if out is None else out.union(part)
        if out is None:
            return self.spark.createDataFrame([], "c string, n long")
        return out.groupBy("c").agg(F.sum("n").alias("n")).where("n > 0")


def term_columns() -> list[str]:
    return ["s", "p", "o"]


def _columns(prefix: str, names: dict[str, str]) -> list[ObjectMap]:
    return [ObjectMap(prefix + p, c) for p, c in names.items()]


def standard_graph(spark: SparkSession, sf_dir: str) -> VirtualGraph:
    """The virtual graph over the driver's tables."""

    def t(name: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def knows() -> DataFrame:
        customers = t("customer")().agg(F.count("*").alias("n"))
        # The count is one row: a scalar, joined by a broadcast of one row.
        return t("orders")().join(F.broadcast(customers)).select(F.col("o_custkey").alias("src"), F.pmod(F.col("o_orderkey") * 7 + 1, F.col("n")).alias("dst")).where("src != dst").distinct()

    ref = lambda p, c, to: ObjectMap(EX + p, c, prefix=EX + to)
    maps = [
        TriplesMap("region", t("region"), EX + "region/", "r_regionkey", [EX + "Region"], _columns(EX, {"name": "r_name"})),
        TriplesMap("nation", t("nation"), EX + "nation/", "n_nationkey", [EX + "Nation"], [*_columns(EX, {"name": "n_name"}), ref("region", "n_regionkey", "region/")]),
        TriplesMap("customer", t("customer"), EX + "customer/", "c_custkey", [EX + "Customer"], [*_columns(EX, {"name": "c_name", "acctbal": "c_acctbal", "segment": "c_mktsegment", "custkey": "c_custkey"}), ref("nation", "c_nationkey", "nation/")]),
        TriplesMap("supplier", t("supplier"), EX + "supplier/", "s_suppkey", [EX + "Supplier"], [*_columns(EX, {"name": "s_name", "acctbal": "s_acctbal", "suppkey": "s_suppkey"}), ref("nation", "s_nationkey", "nation/")]),
        TriplesMap("part", t("part"), EX + "part/", "p_partkey", [EX + "Part"], _columns(EX, {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "retailprice": "p_retailprice", "partkey": "p_partkey"})),
        TriplesMap("orders", t("orders"), EX + "order/", "o_orderkey", [EX + "Order"], [*_columns(EX, {"status": "o_orderstatus", "totalprice": "o_totalprice", "orderdate": "o_orderdate", "priority": "o_orderpriority", "orderkey": "o_orderkey"}), ref("customer", "o_custkey", "customer/")]),
        TriplesMap(
            "lineitem", t("lineitem"), None, None, [EX + "Lineitem"],
            [*_columns(EX, {"linenumber": "l_linenumber", "quantity": "l_quantity", "extendedprice": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "returnflag": "l_returnflag", "linestatus": "l_linestatus", "shipdate": "l_shipdate"}),
             ref("order", "l_orderkey", "order/"), ref("part", "l_partkey", "part/"), ref("supplier", "l_suppkey", "supplier/")],
        ),
        TriplesMap("events", t("events"), EX + "event/", "event_id", [EX + "Event"], [*_columns(EX, {"ts": "ts", "eventType": "event_type", "value": "value", "props": "props", "eventId": "event_id"}), ref("user", "user_id", "user/")]),
        TriplesMap("documents", t("documents"), EX + "document/", "doc_id", [EX + "Document"], [ObjectMap(EX + "text", "text", lang="lang"), *_columns(EX, {"lang": "lang", "source": "source", "nchars": "n_chars", "docId": "doc_id"})]),
        TriplesMap("labels", t("labels"), EX + "document/", "doc_id", [], _columns(EX, {"quality": "quality", "toxic": "toxic"})),
        TriplesMap("embeddings", t("embeddings"), EX + "vector/", "vec_id", [EX + "Vector"], _columns(EX, {"embedding": "embedding", "label": "label", "vecId": "vec_id"})),
        TriplesMap("benchmark", t("benchmark"), EX + "item/", "item_id", [EX + "Item"], _columns(EX, {"question": "text"})),
        TriplesMap("pages", t("pages"), EX + "page/", "page_id", [EX + "Page"], _columns(EX, {"url": "url", "html": "html"})),
        TriplesMap("conversations", t("conversations"), None, None, [EX + "Turn"], [*_columns(EX, {"turn": "turn", "role": "role", "said": "text"}), ref("conversation", "conv_id", "conversation/")]),
        TriplesMap("knows", knows, EX + "customer/", "src", [], [ref("knows", "dst", "customer/")]),
    ]
    return VirtualGraph(spark, maps)


__all__ = ["DYN", "EX", "ObjectMap", "TriplesMap", "VirtualGraph", "standard_graph"]
