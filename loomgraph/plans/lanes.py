"""Static descriptions of a variable's column, and conversions between them.

A *lane* says what a column holds, so that most values stay native columns:

* ``iri``   a key column behind an IRI prefix (an empty prefix: whole IRIs)
* ``bnode`` a label column
* ``lit``   a native column of one datatype
* ``lang``  struct<lex, lang>
* ``dyn``   a term struct, for variables whose kind differs by row
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
LIST, MAP = "http://w3id.org/awslabs/neptune/SPARQL-CDTs/List", "http://w3id.org/awslabs/neptune/SPARQL-CDTs/Map"
VECTOR = "urn:loomgraph:vector"
TERM = "struct<kind:tinyint,lex:string,dt:string,lang:string>"
INTEGERS = {XSD + x for x in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte")}
NUMERIC = INTEGERS | {XSD + x for x in ("decimal", "double", "float")}


@dataclass(frozen=True)
class Lane:
    kind: str
    prefix: str = ""
    dt: str = XSD + "string"
    nullable: bool = False
    elem: Any = None  # element lane of a list

    def null(self, nullable: bool = True) -> Lane:
        return replace(self, nullable=self.nullable or nullable)


DYN = Lane("dyn")
STRING = Lane("lit")
INTEGER = Lane("lit", dt=XSD + "integer")
DECIMAL = Lane("lit", dt=XSD + "decimal")
DOUBLE = Lane("lit", dt=XSD + "double")
BOOLEAN = Lane("lit", dt=XSD + "boolean")
DATETIME = Lane("lit", dt=XSD + "dateTime")
DATE = Lane("lit", dt=XSD + "date")
FULL_IRI = Lane("iri")


def natural(kind: T.DataType) -> Lane:
    """The lane of a source column."""
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return INTEGER
    if isinstance(kind, T.FloatType | T.DoubleType):
        return DOUBLE
    if isinstance(kind, T.DecimalType):
        return DECIMAL
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, T.DateType):
        return DATE
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return DATETIME
    if isinstance(kind, T.ArrayType):
        return Lane("lit", dt=VECTOR)
    return STRING


def family(lane: Lane) -> str:
    """num, str, bool, dateTime, date, iri, bnode, lang, dyn, list, map, vector or other."""
    if lane.kind != "lit":
        return lane.kind
    if lane.dt in NUMERIC:
        return "num"
    return {XSD + "string": "str", XSD + "boolean": "bool", XSD + "dateTime": "dateTime", XSD + "date": "date", LIST: "list", MAP: "map", VECTOR: "vector"}.get(lane.dt, "other")


def lexical(col: Column, lane: Lane) -> Column:
    """STR() of a column."""
    f = family(lane)
    if f == "iri":
        return F.concat(F.lit(lane.prefix), col.cast("string")) if lane.prefix else col.cast("string")
    if f in ("dyn", "lang"):
        return col["lex"]
    if f == "dateTime":
        return F.concat(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(col, "SSSSSS") == "000000", "").otherwise(F.concat(F.lit("."), F.regexp_replace(F.date_format(col, "SSSSSS"), "0+$", ""))), F.lit("Z"))
    if f == "list" and isinstance(lane.elem, Lane) and lane.elem.kind == "dyn":
        return F.concat(F.lit("["), F.array_join(F.transform(col, _element_text), ","), F.lit("]"))
    if f in ("list", "map", "vector"):
        return F.to_json(col)
    if lane.dt in (XSD + "double", XSD + "float"):
        return double_lexical(col)
    return col.cast("string")


def _element_text(x: Column) -> Column:
    """A term inside a list's lexical form."""
    bare = x["dt"].isin(*NUMERIC, XSD + "boolean", LIST, MAP)
    quoted = F.concat(F.lit('"'), F.replace(F.replace(x["lex"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(x.isNull(), "null").when(x["kind"] == 0, F.concat(F.lit("<"), x["lex"], F.lit(">"))).when(bare, x["lex"]).otherwise(quoted)


def term(lex: Column, dt: str) -> Column:
    """The struct of a literal."""
    return F.struct(F.lit(2).cast("tinyint").alias("kind"), lex.alias("lex"), F.lit(dt).alias("dt"), F.lit(None).cast("string").alias("lang")).cast(TERM)


def double_lexical(col: Column) -> Column:
    """Canonical xsd:double: one digit before the point, upper-case E."""
    text = F.format_string("%.16e", col.cast("double"))
    short = col.cast("double").cast("string")
    plain = F.regexp_replace(short, r"\.0$", "")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(short, "E.*$", ""), r"[-.]", ""), "^0+", ""), "0+$", "")
    exponent = F.regexp_extract(text, r"e([+-]\d+)$", 1).cast("int")
    body = F.concat(F.when(col < 0, "-").otherwise(""), F.substring(digits, 1, 1), F.lit("."), F.when(F.length(digits) > 1, F.expr("''")).otherwise("0"), F.substring(digits, 2, 40), F.lit("E"), exponent.cast("string"))
    return F.when(F.isnan(col.cast("double")), "NaN").when(F.abs(col.cast("double")) == float("inf"), F.when(col > 0, "INF").otherwise("-INF")).when(col == 0, "0.0E0").otherwise(F.when(plain.isNull(), None).otherwise(body))


def to_dyn(col: Column, lane: Lane) -> Column:
    """The term struct of a column; null stays null."""
    if lane.kind == "dyn":
        return col
    if lane.kind == "iri":
        s = F.struct(F.lit(0).cast("tinyint").alias("kind"), lexical(col, lane).alias("lex"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))
    elif lane.kind == "bnode":
        s = F.struct(F.lit(1).cast("tinyint").alias("kind"), col.cast("string").alias("lex"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))
    elif lane.kind == "lang":
        s = F.struct(F.lit(2).cast("tinyint").alias("kind"), col["lex"].alias("lex"), F.lit(RDF + "langString").alias("dt"), col["lang"].alias("lang"))
    else:
        s = F.struct(F.lit(2).cast("tinyint").alias("kind"), lexical(col, lane).alias("lex"), F.lit(lane.dt).alias("dt"), F.lit(None).cast("string").alias("lang"))
    return F.when(col.isNotNull(), s).cast(TERM)


def dyn_number(col: Column) -> Column:
    """The numeric value of a term, null if it has none."""
    return F.when((col["kind"] == 2) & col["dt"].isin(*NUMERIC), col["lex"].try_cast("double"))


def dyn_time(col: Column) -> Column:
    """The instant of a date or dateTime term, null if it is none."""
    return F.when((col["kind"] == 2) & col["dt"].isin(XSD + "dateTime", XSD + "date"), col["lex"].try_cast("timestamp"))


def sort_values(col: Column, lane: Lane) -> list[Column]:
    """What is compared to sort: unbound, blank nodes, IRIs, then literals by value."""
    f = family(lane)
    if f == "dyn":
        rank = F.when(col.isNull(), 0).when(col["kind"] == 1, 1).when(col["kind"] == 0, 2).otherwise(3)
        return [rank, dyn_number(col), dyn_time(col), col["lex"]]
    if f == "lang":
        return [col["lex"], col["lang"]]
    if f == "iri":
        return [lexical(col, lane)]
    if f in ("list", "map"):
        return [lexical(col, lane)]
    return [col]


def order_keys(col: Column, lane: Lane, up: bool) -> list[Column]:
    """Sort keys in one direction."""
    return [k.asc_nulls_first() if up else k.desc_nulls_last() for k in sort_values(col, lane)]
