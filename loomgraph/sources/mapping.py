"""Relational mappings: sources, term maps, R2RML, RML and YARRRML documents, direct mapping.

A mapping is a list of ``Map`` objects.  ``virtual`` makes it a graph that stays
unmaterialised where subjects are ``prefix + {column}`` templates and objects are
columns or such templates; ``quads`` writes out any mapping, one ``select`` for
each triples map with its cells exploded, and joins for referenced maps.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lanes import RDF, TERM, XSD, lexical, natural
from .catalog import ObjectMap, TriplesMap, VirtualGraph
from .rdf import parse_turtle

RR, RML, QL = "http://www.w3.org/ns/r2rml#", "http://semweb.mmlab.be/ns/rml#", "http://semweb.mmlab.be/ns/ql#"
RML2 = "http://w3id.org/rml/"

# ---------------------------------------------------------------- sources


@dataclass
class Source:
    """csv, tsv, json, jsonl, parquet, table or query."""

    kind: str
    ref: str
    iterator: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        if self.kind in ("csv", "tsv"):
            # An empty cell is null; a quoted one too.
            return spark.read.options(header=True, sep="\t" if self.kind == "tsv" else ",", nullValue="", emptyValue="", multiLine=True, escape='"', **self.options).csv(self.ref)
        if self.kind in ("json", "jsonl"):
            df = spark.read.options(multiLine=self.kind == "json", **self.options).json(self.ref)
            for step in re.findall(r"\.([\w-]+)|\['([^']+)'\]|(\[\*\])", self.iterator or ""):
                name = step[0] or step[1]
                if name:
                    df = df.select(F.col(f"`{name}`").alias("_x"))
                    if not isinstance(df.schema["_x"].dataType, T.ArrayType):
                        df = df.select("_x.*") if isinstance(df.schema["_x"].dataType, T.StructType) else df
                else:
                    inner = df.select(F.explode("_x").alias("_x")) if "_x" in df.columns else df
                    df = inner.select("_x.*") if "_x" in inner.columns and isinstance(inner.schema["_x"].dataType, T.StructType) else inner
            return df
        if self.kind == "parquet":
            return spark.read.parquet(self.ref)
        return spark.table(self.ref) if self.kind == "table" else spark.sql(self.ref)


def csvw(spark: SparkSession, path: str, metadata: dict) -> DataFrame:
    """A CSV file with the column names and datatypes of its CSVW description."""
    table = metadata.get("tables", [metadata])[0]
    dialect = table.get("dialect", metadata.get("dialect", {}))
    df = spark.read.options(header=dialect.get("header", True), sep=dialect.get("delimiter", ","), nullValue="", multiLine=True).csv(path)
    kinds = {"integer": "bigint", "int": "int", "long": "bigint", "decimal": "decimal(38,18)", "number": "double", "double": "double", "float": "float", "boolean": "boolean", "date": "date", "dateTime": "timestamp", "datetime": "timestamp"}
    cols = []
    for name, c in zip(df.columns, table["tableSchema"]["columns"]):
        dt = c.get("datatype", "string")
        dt = dt.get("base", "string") if isinstance(dt, dict) else dt
        value = F.col(f"`{name}`")
        if c.get("separator"):
            value = F.split(value, re.escape(c["separator"]))
        elif dt in kinds:
            value = value.try_cast(kinds[dt])
        title = c.get("titles", name)
        cols.append(F.coalesce(value, F.lit(c["default"])).alias(c.get("name", title)) if "default" in c else value.alias(c.get("name", title if isinstance(title, str) else title[0])))
    return df.select(*cols)


# ---------------------------------------------------------------- term maps

FUNCTIONS: dict[str, Callable[..., Column]] = {
    "http://users.ugent.be/~bjdmeest/function/grel.ttl#toUpperCase": F.upper,
    "http://users.ugent.be/~bjdmeest/function/grel.ttl#toLowerCase": F.lower,
    "http://users.ugent.be/~bjdmeest/function/grel.ttl#string_trim": F.trim,
    "http://users.ugent.be/~bjdmeest/function/grel.ttl#array_join": lambda *a: F.concat(*a),
}


@dataclass
class Term:
    """constant, reference, template, function (IRI and argument terms) or fresh (a blank node for each row)."""

    how: str
    value: Any = None
    kind: str = "iri"  # iri, bnode, literal
    dt: str | None = None
    lang: str | None = None


@dataclass
class Join:
    parent: str
    keys: list[tuple[str, str]]  # child column, parent column


@dataclass
class Map:
    name: str
    source: Source
    subject: Term
    classes: list[str] = field(default_factory=list)
    objects: list[tuple[Term, Term | Join]] = field(default_factory=list)
    graph: Term | None = None


def reference(df: DataFrame, name: str) -> Column:
    """A column; dots go into structs."""
    if name in df.columns:
        return F.col(f"`{name}`")
    first, *rest = name.split(".")
    return reduce(lambda c, part: c[part], rest, F.col(f"`{first}`"))


def iri_safe(c: Column) -> Column:
    """Percent-encoded but for unreserved characters and letters beyond ASCII."""
    plain = F.regexp_like(c, F.lit(r"^[\w.~-]*$"))
    encoded = F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    pieces = F.transform(F.split(c, ""), lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), x).otherwise(F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))))
    return F.when(plain, c).when(c.rlike(r"[^\x00-\x7f]"), F.array_join(pieces, "")).otherwise(encoded)


def template(df: DataFrame, text: str, safe: bool) -> Column:
    """``text{column}text`` with backslash escapes; null if a column is."""
    parts = []
    for plain, name in re.findall(r"((?:[^{}\\]|\\.)+)|\{((?:[^{}\\]|\\.)+)\}", text):
        if plain:
            parts.append(F.lit(re.sub(r"\\(.)", r"\1", plain)))
        else:
            c = _text(df, re.sub(r"\\(.)", r"\1", name))
            parts.append(iri_safe(c) if safe else c)
    return F.concat(*parts)


def _type_of(df: DataFrame, name: str) -> T.DataType:
    return df.select(reference(df, name).alias("x")).schema["x"].dataType


def _text(df: DataFrame, name: str) -> Column:
    return lexical(reference(df, name), natural(_type_of(df, name)))


def term(df: DataFrame, t: Term, base: str = "") -> Column:
    """The term struct that a term map makes of a row."""
    dt, lang = t.dt, t.lang
    if t.how == "constant":
        lex = F.lit(t.value)
    elif t.how == "reference":
        lex = _text(df, t.value)
        dt = dt or natural(_type_of(df, t.value)).dt
    elif t.how == "template":
        lex = template(df, t.value, t.kind == "iri")
    elif t.how == "function":
        f, args = t.value
        lex = FUNCTIONS[f](*[term(df, a)["lex"] for a in args])
    else:
        lex = F.sha2(F.to_json(F.struct(*[df[c] for c in df.columns])), 256)
    if t.kind == "iri" and t.how == "reference":
        lex = F.when(lex.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), lex).otherwise(F.concat(F.lit(base), lex))
    code = {"iri": 0, "bnode": 1, "literal": 2}[t.kind]
    shown = F.lit(None).cast("string") if code < 2 else F.lit(RDF + "langString" if lang else dt or XSD + "string")
    return F.when(lex.isNotNull(), F.struct(F.lit(code).cast("tinyint").alias("kind"), lex.alias("lex"), shown.alias("dt"), F.lit(lang).cast("string").alias("lang"))).cast(TERM)


def quads(spark: SparkSession, maps: list[Map], base: str = "") -> DataFrame:
    """The quads of a mapping, each once."""
    frames = {m.name: m.source.read(spark) for m in maps}
    out = None

    def add(df: DataFrame) -> None:
        nonlocal out
        out = df if out is None else out.unionByName(df)

    for m in maps:
        df = frames[m.name]
        g = term(df, m.graph, base)["lex"] if m.graph else F.lit(None).cast("string")
        s = term(df, m.subject, base)
        cells = [F.struct(F.lit(RDF + "type").alias("p"), term(df, Term("constant", c)).alias("o")) for c in m.classes]
        for p, o in m.objects:
            if isinstance(o, Term):
                many = o.how == "reference" and isinstance(_type_of(df, o.value), T.ArrayType)
                if many:  # a list is many values
                    each = df.withColumn("_each", F.explode(reference(df, o.value)))
                    add(each.select(g.alias("g"), s.alias("s"), term(df, p, base)["lex"].alias("p"), term(each, Term("reference", "_each", o.kind, o.dt, o.lang), base).alias("o")))
                else:
                    cells.append(F.struct(term(df, p, base)["lex"].alias("p"), term(df, o, base).alias("o")))
        if cells:
            add(df.select(g.alias("g"), s.alias("s"), F.explode(F.array(*cells)).alias("_x")).select("g", "s", F.col("_x.p").alias("p"), F.col("_x.o").alias("o")))
        for p, o in m.objects:
            if isinstance(o, Join):
                parent = next(x for x in maps if x.name == o.parent)
                other = frames[o.parent]
                child = df.select(g.alias("g"), s.alias("s"), term(df, p, base)["lex"].alias("p"), *[reference(df, a).alias(f"_k{i}") for i, (a, _) in enumerate(o.keys)])
                far = other.select(term(other, parent.subject, base).alias("o"), *[reference(other, b).alias(f"_k{i}") for i, (_, b) in enumerate(o.keys)])
                if o.keys:
                    add(child.join(far, [f"_k{i}" for i in range(len(o.keys))]).select("g", "s", "p", "o"))
                else:  # without a condition both sides are one row
                    add(df.select(g.alias("g"), s.alias("s"), term(df, p, base)["lex"].alias("p"), term(df, parent.subject, base).alias("o")))
    return out.where("s is not null and p is not null and o is not null").distinct()


def virtual(spark: SparkSession, maps: list[Map]) -> VirtualGraph:
    """The mapping as an unmaterialised graph; it must be of the simple form."""
    out = []
    prefix = lambda t: m[1] if t.how == "template" and (m := re.fullmatch(r"([^{}\\]*)\{[^{}]+\}", t.value)) else None
    column = lambda t: re.search(r"\{([^{}]+)\}", t.value)[1]
    for m in maps:
        objects = []
        for p, o in m.objects:
            if isinstance(o, Join):
                parent = next(x for x in maps if x.name == o.parent)
                if len(o.keys) != 1 or prefix(parent.subject) is None or column(parent.subject) != o.keys[0][1]:
                    raise ValueError(f"map {m.name!r}: this join is no key; write the mapping out with quads()")
                objects.append(ObjectMap(p.value, o.keys[0][0], prefix=prefix(parent.subject)))
            elif o.how == "reference" and o.kind == "literal" and o.lang is None and o.dt is None:
                objects.append(ObjectMap(p.value, o.value))
            elif prefix(o) is not None:
                objects.append(ObjectMap(p.value, column(o), prefix=prefix(o)))
            else:
                raise ValueError(f"map {m.name!r}: an object is not of the simple form; write the mapping out with quads()")
        if m.subject.how != "fresh" and prefix(m.subject) is None:
            raise ValueError(f"map {m.name!r}: the subject is not of the simple form")
        fresh = m.subject.how == "fresh"
        out.append(TriplesMap(m.name, lambda m=m: m.source.read(spark), None if fresh else prefix(m.subject), None if fresh else column(m.subject), m.classes, objects))
    return VirtualGraph(spark, out)


# ---------------------------------------------------------------- documents


def from_turtle(text: str, tables: str = "") -> list[Map]:
    """An R2RML or RML document; ``tables`` is the folder of its file sources."""
    graph: dict[str, dict[str, list]] = {}
    for _, s, p, o in parse_turtle(text):
        graph.setdefault(s["lex"], {}).setdefault(p, []).append(o)

    def get(node: str, *names: str) -> list[dict]:
        return [o for n in names for ns in ((RR, RML, RML2) if ":" not in n else ("",)) for o in graph.get(node, {}).get(ns + n, [])]

    def one(node: str, *names: str) -> str | None:
        found = get(node, *names)
        return found[0]["lex"] if found else None

    def a_term(node: str, default: str) -> Term:
        kind = {"IRI": "iri", "URI": "iri", "BlankNode": "bnode", "Literal": "literal"}.get((one(node, "termType") or "").rsplit("#", 1)[-1].rsplit("/", 1)[-1])
        lang, dt = one(node, "language"), one(node, "datatype")
        constant = get(node, "constant")
        if constant:
            o = constant[0]
            return Term("constant", o["lex"], kind or ("literal" if o["kind"] == 2 else "iri"), o["dt"] if o["kind"] == 2 else None, o["lang"])
        if (ref := one(node, "column", "reference")) is not None:
            return Term("reference", ref.strip('"').removeprefix("$."), kind or ("literal" if default == "object" else "iri"), dt, lang)
        if (t := one(node, "template")) is not None:
            return Term("template", t.replace('"', ""), kind or ("literal" if lang or dt else "iri"), dt, lang)
        return Term("fresh", None, "bnode")

    def short(node: str, shortcut: str, full: str, default: str) -> list[Term]:
        out = [Term("constant", o["lex"], "literal" if o["kind"] == 2 else "iri", o["dt"] if o["kind"] == 2 else None, o["lang"]) for o in get(node, shortcut)]
        return out + [a_term(o["lex"], default) for o in get(node, full)]

    maps = []
    for name in graph:
        logical = get(name, "logicalTable", "logicalSource")
        if not logical:
            continue
        node = logical[0]["lex"]
        if (table := one(node, "tableName")) is not None:
            source = Source("table", table.strip('"'))
        elif (query := one(node, "sqlQuery", "query")) is not None:
            source = Source("query", query)
        else:
            ref = one(node, "source") or ""
            ref = one(ref, "path") or ref
            form = (one(node, "referenceFormulation") or "").rsplit("#", 1)[-1].rsplit("/", 1)[-1]
            kind = "json" if form == "JSONPath" else ref.rsplit(".", 1)[-1] if ref.endswith((".tsv", ".parquet", ".jsonl")) else "csv"
            source = Source(kind, f"{tables}/{ref}" if tables and "/" not in ref else ref, one(node, "iterator"))
        subject = short(name, "subject", "subjectMap", "subject")[0]
        smap = get(name, "subjectMap")
        classes = [o["lex"] for o in get(smap[0]["lex"], "class")] if smap else []
        graphs = short(smap[0]["lex"], "graph", "graphMap", "subject") if smap else []
        objects: list[tuple[Term, Term | Join]] = []
        for pom in get(name, "predicateObjectMap"):
            for p in short(pom["lex"], "predicate", "predicateMap", "subject"):
                for o in get(pom["lex"], "objectMap"):
                    parent = one(o["lex"], "parentTriplesMap")
                    if parent is not None:
                        keys = [(one(j["lex"], "child").strip('"').removeprefix("$."), one(j["lex"], "parent").strip('"').removeprefix("$.")) for j in get(o["lex"], "joinCondition")]
                        objects.append((p, Join(parent, keys)))
                    else:
                        objects.append((p, a_term(o["lex"], "object")))
                objects += [(p, Term("constant", o["lex"], "literal" if o["kind"] == 2 else "iri", o["dt"] if o["kind"] == 2 else None, o["lang"])) for o in get(pom["lex"], "object")]
        maps.append(Map(name, source, subject, classes, objects, graphs[0] if graphs else None))
    return maps


def from_yarrrml(doc: dict[str, Any], tables: str = "") -> list[Map]:
    """A YARRRML document that is already read into dictionaries (any YAML or JSON reader does)."""
    prefixes = doc.get("prefixes", {}) | {"rdf": RDF, "xsd": XSD}

    def expand(x: str) -> str:
        prefix, sep, local = x.partition(":")
        return prefixes[prefix] + local if sep and prefix in prefixes else x

    def a_term(x: Any, default: str) -> Term:
        if isinstance(x, list):
            value, extra = x[0], x[1] if len(x) > 1 else None
            t = a_term(value, default)
            if extra:
                t.kind = "literal"
                t.lang, t.dt = (extra[:-5], None) if extra.endswith("~lang") else (None, expand(extra))
            return t
        if isinstance(x, dict):
            if "mapping" in x:
                raise ValueError("a mapping reference is an object")
            t = a_term(x["value"], default)
            t.dt, t.lang = expand(x["datatype"]) if "datatype" in x else t.dt, x.get("language", t.lang)
            t.kind = "iri" if x.get("type") == "iri" else t.kind
            return t
        iri = str(x).endswith("~iri")
        x = str(x).removesuffix("~iri")
        m = re.fullmatch(r"\$\(([^()]+)\)", x)
        kind = "iri" if iri or default != "object" else "literal"
        if m:
            return Term("reference", m[1], kind)
        if "$(" in x:
            text = re.sub(r"\$\(([^()]+)\)", r"{\1}", expand(x))
            return Term("template", text, kind)
        return Term("constant", expand(x), "iri" if expand(x) != x or iri or default != "object" else "literal")

    maps = []
    for name, m in doc["mappings"].items():
        src = m.get("sources", m.get("source"))
        src = src[0] if isinstance(src, list) and isinstance(src[0], list | dict) else src
        src = doc.get("sources", {}).get(src, src) if isinstance(src, str) else src
        access, form = (src["access"], src.get("referenceFormulation", "csv")) if isinstance(src, dict) else src[0].rsplit("~", 1)
        iterator = src.get("iterator") if isinstance(src, dict) else src[1] if len(src) > 1 else None
        kind = {"jsonpath": "json", "csv": "csv", "tsv": "tsv", "parquet": "parquet", "sql": "query"}[form]
        subject = m.get("s", m.get("subject", m.get("subjects")))
        objects: list[tuple[Term, Term | Join]] = []
        classes = []
        for po in m.get("po", m.get("predicateobjects", [])):
            ps, os = (po[0], po[1:] if len(po) == 3 else po[1]) if isinstance(po, list) else (po.get("p", po.get("predicates")), po.get("o", po.get("objects")))
            os = [list(os)] if isinstance(po, list) and len(po) == 3 else os if isinstance(os, list) else [os]
            for p in ps if isinstance(ps, list) else [ps]:
                for o in os:
                    if p == "a":
                        classes.append(expand(o))
                    elif isinstance(o, dict) and "mapping" in o:
                        cond = o.get("condition", {}).get("parameters", [])
                        pick = lambda c: [re.sub(r"^\$\(|\)$", "", x[1]) for x in c]
                        names = pick(cond)
                        objects.append((a_term(p, "predicate"), Join(o["mapping"], [(names[0], names[1])] if names else [])))
                    else:
                        objects.append((a_term(p, "predicate"), a_term(o, "object")))
        maps.append(Map(name, Source(kind, f"{tables}/{access}" if tables and "/" not in access else access, iterator), Term("fresh", None, "bnode") if subject is None else a_term(subject, "subject"), classes, objects))
    return maps


def direct(df: DataFrame, base: str, key: str | None = None, graph: str | None = None) -> DataFrame:
    """The default mapping of a table: ``base`` + key as subject, ``base`` + column as predicate, a triple a cell (the key's too)."""
    if not base:
        raise ValueError("a base IRI is needed")
    subject = Term("template", base.replace("{", "\\{") + "{" + key + "}") if key else Term("fresh", None, "bnode")
    s = term(df, subject)
    cells = [F.struct(F.lit(base + c).alias("p"), term(df, Term("reference", c, "literal")).alias("o")) for c in df.columns]
    rows = df.select(F.lit(graph).cast("string").alias("g"), s.alias("s"), F.explode(F.array(*cells)).alias("_x"))
    return rows.select("g", "s", F.col("_x.p").alias("p"), F.col("_x.o").alias("o")).where("s is not null and o is not null")


class Mappings:
    """Saved mapping documents with versions, on a ``Dataset``."""

    def __init__(self, dataset):
        self.dataset = dataset

    def put(self, name: str, text: str, kind: str = "turtle") -> int:
        saved = self.dataset._read_json("mappings")
        versions = saved.get(name, [])
        self.dataset._write_json("mappings", saved | {name: [*versions, {"text": text, "kind": kind}]})
        return len(versions) + 1

    def list(self) -> dict[str, int]:
        return {k: len(v) for k, v in self.dataset._read_json("mappings").items()}

    def get(self, name: str, version: int | None = None) -> dict:
        return self.dataset._read_json("mappings")[name][(version or 0) - 1]

    def delete(self, name: str) -> None:
        self.dataset._write_json("mappings", {k: v for k, v in self.dataset._read_json("mappings").items() if k != name})

    def run(self, name: str, tables: str = "", graph: str | None = None, replace: bool = False, base: str = "") -> int:
        """Write the mapping's quads into the dataset; ``replace`` takes the graph's others away."""
        m = self.get(name)
        maps = from_turtle(m["text"], tables) if m["kind"] == "turtle" else from_yarrrml(json.loads(m["text"]), tables)
        rows = quads(self.dataset.spark, maps, base)
        if graph is not None:
            rows = rows.withColumn("g", F.lit(graph))
        old = None
        if replace:
            state = self.dataset.quads()
            old = state.where(F.col("g").isNull() if graph is None else F.col("g") == graph)
        return self.dataset.commit(rows, old, f"mapping {name}")
