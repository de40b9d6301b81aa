"""Built-in and library functions as column expressions.

Every function takes and returns ``Val``: a column with its lane.  What would be
an error in the query language is null here, so nothing raises while running.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import geo
from ..plans import lanes as L
from ..plans.lanes import BOOLEAN, DATE, DATETIME, DECIMAL, DOUBLE, DYN, FULL_IRI, INTEGER, RDF, STRING, XSD, Lane

FN = "http://www.w3.org/2005/xpath-functions#"
MATH = "http://www.w3.org/2005/xpath-functions/math#"
AFN = "http://jena.apache.org/ARQ/function#"
CDT = "http://w3id.org/awslabs/neptune/SPARQL-CDTs/"
VEC = "urn:loomgraph:vector#"


@dataclass(frozen=True)
class Val:
    col: Column
    lane: Lane
    const: Any = None  # the value of a literal

    @property
    def family(self) -> str:
        return L.family(self.lane)


class FunctionError(ValueError):
    """A function that does not exist or cannot take its arguments."""


# ---------------------------------------------------------------- conversions


def string(v: Val) -> Column:
    return L.lexical(v.col, v.lane)


def number(v: Val) -> Column:
    f = v.family
    if f == "num":
        return v.col
    if f == "dyn":
        return L.dyn_number(v.col)
    return F.lit(None).cast("double")


def boolean(v: Val) -> Column:
    """The effective boolean value."""
    f = v.family
    if f == "bool":
        return v.col
    if f == "num":
        return (v.col != 0) & ~F.isnan(v.col.cast("double"))
    if f == "str":
        return v.col != ""
    if f == "lang":
        return v.col["lex"] != ""
    if f == "dyn":
        text = v.col["dt"].isin(XSD + "string", RDF + "langString")
        return F.when(v.col["dt"] == XSD + "boolean", v.col["lex"].isin("true", "1")).when(text, v.col["lex"] != "").otherwise(L.dyn_number(v.col) != 0)
    return F.lit(None).cast("boolean")


def typed(col: Column, dt: str) -> Column:
    kind = {XSD + "double": "double", XSD + "float": "double", XSD + "decimal": "decimal(38,18)", XSD + "boolean": "boolean", XSD + "dateTime": "timestamp", XSD + "date": "date"}.get(dt)
    if dt in L.INTEGERS:
        kind = "bigint"
    return col.try_cast(kind) if kind else col


def literal(lex: str, dt: str, lang: str | None = None) -> Val:
    if lang is not None:
        return Val(F.struct(F.lit(lex).alias("lex"), F.lit(lang).alias("lang")), Lane("lang"), lex)
    if dt in L.INTEGERS:
        return Val(F.lit(int(lex)).cast("bigint"), INTEGER, int(lex))
    if dt in (XSD + "double", XSD + "float"):
        return Val(F.lit(float(lex.replace("INF", "inf"))), Lane("lit", dt=dt), float(lex.replace("INF", "inf")))
    if dt == XSD + "decimal":
        return Val(F.lit(lex).cast("decimal(38,18)"), DECIMAL, lex)
    if dt == XSD + "boolean":
        return Val(F.lit(lex in ("true", "1")), BOOLEAN, lex in ("true", "1"))
    if dt == XSD + "dateTime":
        return Val(F.lit(lex).try_cast("timestamp"), DATETIME, lex)
    if dt == XSD + "date":
        return Val(F.lit(lex).try_cast("date"), DATE, lex)
    if dt == L.LIST:
        return cdt_list(lex)
    if dt == L.MAP:
        return cdt_map(lex)
    return Val(F.lit(lex), Lane("lit", dt=dt), lex)


# ---------------------------------------------------------------- composites


def _cdt_parse(text: str) -> Any:
    """A list or map literal with numbers, strings, booleans, nulls and nested values."""
    at = 0

    def space() -> None:
        nonlocal at
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1

    def value() -> Any:
        nonlocal at
        space()
        if text[at] in "[{":
            close, is_map = ("]", False) if text[at] == "[" else ("}", True)
            at += 1
            items: list = []
            while True:
                space()
                if text[at] == close:
                    at += 1
                    return {a: b for a, b in zip(items[::2], items[1::2])} if is_map else items
                items.append(value())
                space()
                if is_map and text[at] == ":":
                    at += 1
        if text[at] in "\"'":
            quote, end = text[at], at + 1
            while text[end] != quote:
                end += 2 if text[end] == "\\" else 1
            out = text[at + 1 : end]
            at = end + 1
            return out
        m = re.match(r"[^\s,:\]}]+", text[at:])
        if not m:
            raise FunctionError(f"not a composite literal: {text!r}")
        at += m.end()
        word = m[0]
        if word in ("null", "true", "false"):
            return {"null": None, "true": True, "false": False}[word]
        return float(word) if re.search(r"[.eE]", word) else int(word)

    return value()


def _element(values: list) -> tuple[Lane, str]:
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {bool} and kinds:
        return BOOLEAN, "boolean"
    if kinds <= {int} and kinds:
        return INTEGER, "bigint"
    if kinds <= {float} and kinds:
        return DOUBLE, "double"
    if kinds <= {str}:
        return STRING, "string"
    return L.DYN, L.TERM


def _cell(x: Any, lane: Lane, kind: str) -> Column:
    """An element in its lane; elements of several kinds are terms."""
    if x is None or lane != L.DYN:
        return F.lit(x).cast(kind)
    if isinstance(x, list | dict):
        return L.term(F.lit(_cdt_text(x)), L.LIST if isinstance(x, list) else L.MAP)
    dt = "boolean" if isinstance(x, bool) else "integer" if isinstance(x, int) else "double" if isinstance(x, float) else "string"
    v = literal(str(x).lower() if isinstance(x, bool) else str(x), XSD + dt)
    return L.to_dyn(v.col, v.lane)


def _cdt_text(x: Any) -> str:
    """The literal form of a nested value."""
    if isinstance(x, list):
        return "[" + ", ".join(map(_cdt_text, x)) + "]"
    if isinstance(x, dict):
        return "{" + ", ".join(f"{_cdt_text(a)}: {_cdt_text(b)}" for a, b in x.items()) + "}"
    if isinstance(x, str):
        return '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return "null" if x is None else str(x).lower()


def cdt_list(lex: str) -> Val:
    items = _cdt_parse(lex)
    lane, kind = _element(items)
    return Val(F.array(*[_cell(x, lane, kind) for x in items]).cast(f"array<{kind}>"), Lane("lit", dt=L.LIST, elem=lane))


def cdt_map(lex: str) -> Val:
    items = _cdt_parse(lex)
    (kl, kk), (vl, vk) = _element(list(items)), _element(list(items.values()))
    cells = [_cell(x, lane, kind) for pair in items.items() for x, lane, kind in zip(pair, (kl, vl), (kk, vk))]
    return Val(F.create_map(*cells).cast(f"map<{kk},{vk}>") if cells else F.create_map().cast("map<string,string>"), Lane("lit", dt=L.MAP, elem=(kl, vl)))


# ---------------------------------------------------------------- operators


def _promote(a: Val, b: Val) -> Lane:
    order = [INTEGER, DECIMAL, DOUBLE]

    def rank(v: Val) -> int:
        return 0 if v.lane.dt in L.INTEGERS else 1 if v.lane.dt == XSD + "decimal" else 2

    return order[max(rank(a), rank(b))]


def compare(op: str, a: Val, b: Val) -> Column:
    fa, fb = a.family, b.family
    ops: dict[str, Callable[[Column, Column], Column]] = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    f = ops[op]
    if fa == fb == "num":
        return f(a.col, b.col)
    if fa == "iri" and fb == "iri":
        if a.lane.prefix == b.lane.prefix:
            return f(a.col, b.col)
        return f(string(a), string(b))
    if "num" in (fa, fb) and "dyn" in (fa, fb):
        return f(number(a), number(b))
    if "dyn" in (fa, fb):
        x, y = L.to_dyn(a.col, a.lane), L.to_dyn(b.col, b.lane)
        nx, ny = L.dyn_number(x), L.dyn_number(y)
        same_kind = (x["kind"] == y["kind"]) & F.coalesce(x["dt"] == y["dt"], F.lit(True)) & F.coalesce(x["lang"] == y["lang"], F.lit(True))
        tx, ty = L.dyn_time(x), L.dyn_time(y)
        equal = F.when(nx.isNotNull() & ny.isNotNull(), nx == ny).when(tx.isNotNull() & ty.isNotNull() & same_kind, tx == ty).otherwise((x["lex"] == y["lex"]) & same_kind)
        if op == "=":
            return equal
        if op == "!=":
            return ~equal
        return F.when(nx.isNotNull() & ny.isNotNull(), f(nx, ny)).when(tx.isNotNull() & ty.isNotNull() & same_kind, f(tx, ty)).when(same_kind & (x["kind"] == 2), f(x["lex"], y["lex"]))
    if fa == "lang" or fb == "lang":
        if fa == fb:
            same = a.col["lang"] == b.col["lang"]
            return F.when(same, f(a.col["lex"], b.col["lex"])).otherwise(F.lit(op == "!=") if op in ("=", "!=") else F.lit(None).cast("boolean"))
        return F.lit(op == "!=") if op in ("=", "!=") else F.lit(None).cast("boolean")
    if {fa, fb} == {"date", "dateTime"} or fa == fb and fa not in ("other",):
        if fa == "map":
            return f(F.to_json(a.col), F.to_json(b.col))
        return f(a.col, b.col)
    if fa == fb and a.lane.dt == b.lane.dt:
        return f(a.col, b.col) if op in ("=", "!=") else F.lit(None).cast("boolean")
    return F.lit(op == "!=") if op in ("=", "!=") and "iri" in (fa, fb) else F.lit(None).cast("boolean")


def same_term(a: Val, b: Val) -> Column:
    if a.lane.kind == b.lane.kind == "lit":
        return (a.col == b.col) if a.lane.dt == b.lane.dt else F.lit(False)
    x, y = L.to_dyn(a.col, a.lane), L.to_dyn(b.col, b.lane)
    return F.when(x.isNotNull() & y.isNotNull(), x.eqNullSafe(y))


def arithmetic(op: str, a: Val, b: Val) -> Val:
    if "dyn" in (a.family, b.family):
        a, b = Val(number(a).cast("double"), DOUBLE), Val(number(b).cast("double"), DOUBLE)
    if a.family != "num" or b.family != "num":
        return Val(F.lit(None).cast("double"), DOUBLE)
    lane = _promote(a, b)
    if op == "/":
        if lane == DOUBLE:
            return Val(F.try_divide(a.col.cast("double"), b.col.cast("double")), DOUBLE)
        return Val(F.try_divide(a.col.cast("decimal(28,8)"), b.col.cast("decimal(28,8)")).cast("decimal(38,18)"), DECIMAL)
    f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
    kind = {INTEGER: "bigint", DECIMAL: "decimal(28,9)", DOUBLE: "double"}[lane]
    out = f(a.col.cast(kind), b.col.cast(kind))
    return Val(out.cast("decimal(38,18)") if lane == DECIMAL else out, lane)


# ---------------------------------------------------------------- registry

Function = Callable[..., Val]
FUNCTIONS: dict[str, Function] = {}
USER: dict[str, Function] = {}


def function(*names: str) -> Callable[[Function], Function]:
    def add(f: Function) -> Function:
        for n in names:
            FUNCTIONS[n] = f
        return f

    return add


def register(iri: str, f: Callable[..., Column], result: Lane = STRING, effectful: bool = False) -> None:
    """An application's scalar function over native columns; ``effectful`` ones are never moved or merged."""
    USER[iri] = lambda *args: Val(f(*[a.col for a in args]), result)


def call(name: str, args: list[Val]) -> Val:
    f = USER.get(name) or FUNCTIONS.get(name)
    if f is None and name.startswith(XSD):
        return cast(args[0], name)
    if f is None:
        raise FunctionError(f"no function {name!r}")
    return f(*args)


def cast(v: Val, dt: str) -> Val:
    lex = string(v)
    if dt == XSD + "string":
        return Val(lex, STRING)
    if dt == XSD + "boolean":
        if v.family == "num":
            return Val(v.col != 0, BOOLEAN)
        return Val(F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False), BOOLEAN)
    if v.family == "bool":
        v, lex = Val(v.col.cast("int"), INTEGER), v.col.cast("int").cast("string")
    if dt in L.INTEGERS:
        if v.family == "num":
            return Val(v.col.try_cast("bigint"), INTEGER)
        return Val(F.when(lex.rlike(r"^\s*[+-]?\d+\s*$"), lex.try_cast("bigint")), INTEGER)
    if dt in (XSD + "double", XSD + "float"):
        return Val((v.col if v.family == "num" else lex).try_cast("double"), Lane("lit", dt=dt))
    if dt == XSD + "decimal":
        return Val((v.col if v.family == "num" else F.when(~lex.rlike("[eE]"), lex)).try_cast("decimal(38,18)"), DECIMAL)
    if dt == XSD + "dateTime":
        return Val((v.col if v.family in ("date", "dateTime") else lex).try_cast("timestamp"), DATETIME)
    if dt == XSD + "date":
        return Val((v.col if v.family in ("date", "dateTime") else lex).try_cast("date"), DATE)
    raise FunctionError(f"no cast to {dt}")


def _text(f: Callable[..., Column], lane: Lane = STRING) -> Function:
    def run(*args: Val) -> Val:
        out = f(*[string(a) for a in args])
        if lane == STRING and args and args[0].family == "lang":
            return Val(F.struct(out.alias("lex"), args[0].col["lang"].alias("lang")), Lane("lang"))
        return Val(out, lane)

    return run


def _int(v: Val) -> Column:
    return number(v).cast("int")


# strings
FUNCTIONS["STR"] = lambda v: Val(string(v), STRING)
FUNCTIONS["STRLEN"] = FUNCTIONS[FN + "string-length"] = FUNCTIONS[AFN + "strlen"] = _text(lambda s: F.char_length(s).cast("bigint"), INTEGER)
FUNCTIONS["UCASE"] = FUNCTIONS[FN + "upper-case"] = _text(F.upper)
FUNCTIONS["LCASE"] = FUNCTIONS[FN + "lower-case"] = _text(F.lower)
FUNCTIONS["CONCAT"] = FUNCTIONS[FN + "concat"] = lambda *a: Val(F.concat(*[string(x) for x in a]) if a else F.lit(""), STRING)
FUNCTIONS["CONTAINS"] = FUNCTIONS[FN + "contains"] = _text(lambda s, t: F.contains(s, t), BOOLEAN)
FUNCTIONS["STRSTARTS"] = FUNCTIONS[FN + "starts-with"] = _text(lambda s, t: F.startswith(s, t), BOOLEAN)
FUNCTIONS["STRENDS"] = FUNCTIONS[FN + "ends-with"] = _text(lambda s, t: F.endswith(s, t), BOOLEAN)
FUNCTIONS["STRBEFORE"] = FUNCTIONS[FN + "substring-before"] = _text(lambda s, t: F.when(F.contains(s, t), F.substring(s, F.lit(1), F.position(t, s) - 1)).when(s.isNotNull() & t.isNotNull(), ""))
FUNCTIONS["STRAFTER"] = FUNCTIONS[FN + "substring-after"] = _text(lambda s, t: F.when(F.contains(s, t), F.substring(s, F.position(t, s) + F.char_length(t), F.char_length(s))).when(s.isNotNull() & t.isNotNull(), ""))


def _substr(v: Val, start: Val, size: Val | None = None) -> Val:
    s, at = string(v), _int(start)
    if size is None:
        out = F.substring(s, F.greatest(at, F.lit(1)), F.char_length(s))
    else:
        end = at + _int(size)
        first = F.greatest(at, F.lit(1))
        out = F.substring(s, first, F.greatest(end - first, F.lit(0)))
    return _text(lambda _: out)(v)


FUNCTIONS["SUBSTR"] = FUNCTIONS[FN + "substring"] = FUNCTIONS[AFN + "substring1"] = _substr
# zero-based, up to an end
FUNCTIONS[AFN + "substr"] = FUNCTIONS[AFN + "substring"] = lambda v, a, b=None: Val(F.substring(string(v), _int(a) + 1, (_int(b) - _int(a)) if b is not None else F.char_length(string(v))), STRING)
_FLAGS = {"i": "i", "s": "s", "m": "m", "x": "x", "q": ""}


def _pattern(p: Val, flags: Val | None) -> str | Column:
    if flags is None:
        return string(p)
    if p.const is None or flags.const is None:
        return F.concat(F.lit("(?"), string(flags), F.lit(")"), string(p))
    if "q" in flags.const:
        return F.lit(re.escape(p.const))
    return F.lit(f"(?{''.join(_FLAGS.get(x, '') for x in flags.const)})" * bool(flags.const) + p.const)


FUNCTIONS["REGEX"] = FUNCTIONS[FN + "matches"] = lambda v, p, f=None: Val(F.regexp_like(string(v), _pattern(p, f)), BOOLEAN)
FUNCTIONS["REPLACE"] = FUNCTIONS[FN + "replace"] = lambda v, p, r, f=None: _text(lambda s: F.regexp_replace(s, _pattern(p, f), string(r)))(v)
FUNCTIONS["ENCODE_FOR_URI"] = FUNCTIONS[FN + "encode-for-uri"] = lambda v: Val(F.replace(F.replace(F.replace(F.url_encode(string(v)), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")), STRING)
FUNCTIONS[FN + "string-join"] = lambda v, sep=None: Val(F.array_join(v.col.cast("array<string>"), sep.const if sep else ""), STRING)
FUNCTIONS[FN + "normalize-space"] = _text(lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
FUNCTIONS[AFN + "strjoin"] = lambda sep, *a: Val(F.concat_ws(sep.const, *[string(x) for x in a]), STRING)
FUNCTIONS[AFN + "sprintf"] = lambda f, *a: Val(F.format_string(f.const, *[x.col for x in a]), STRING)
FUNCTIONS[AFN + "localname"] = lambda v: Val(F.regexp_extract(string(v), r"([A-Za-z_][^/#:]*)?$", 0), STRING)
FUNCTIONS[AFN + "namespace"] = lambda v: Val(F.regexp_replace(string(v), r"([A-Za-z_][^/#:]*)?$", ""), STRING)


def _normalize(v: Val, form: Val | None = None) -> Val:
    import pandas as pd

    name = (form.const if form is not None else None) or "NFC"

    def normal(s):
        import unicodedata

        return s.map(lambda x: None if x is None else unicodedata.normalize(name, x))

    normal.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return Val(F.pandas_udf(normal, "string")(string(v)), STRING)


FUNCTIONS[FN + "normalize-unicode"] = _normalize

# terms
FUNCTIONS["LANG"] = lambda v: Val(v.col["lang"] if v.family == "lang" else F.when(v.col["kind"] == 2, F.coalesce(v.col["lang"], F.lit(""))) if v.family == "dyn" else F.when(v.col.isNotNull(), "") if v.lane.kind == "lit" else F.lit(None).cast("string"), STRING)
FUNCTIONS["LANGMATCHES"] = lambda v, r: Val(F.when(string(r) == "*", string(v) != "").otherwise((F.lower(string(v)) == F.lower(string(r))) | F.startswith(F.lower(string(v)), F.concat(F.lower(string(r)), F.lit("-")))), BOOLEAN)
FUNCTIONS["HASLANG"] = lambda v: Val(FUNCTIONS["LANG"](v).col != "", BOOLEAN)
FUNCTIONS["HASLANGDIR"] = lambda v: Val(FUNCTIONS["LANG"](v).col.contains("--"), BOOLEAN)
FUNCTIONS["LANGDIR"] = lambda v: Val(F.regexp_extract(FUNCTIONS["LANG"](v).col, "--(ltr|rtl)$", 1), STRING)
FUNCTIONS["STRLANG"] = lambda v, t: Val(F.struct(string(v).alias("lex"), F.lower(string(t)).alias("lang")), Lane("lang"))
FUNCTIONS["STRLANGDIR"] = lambda v, t, d: Val(F.struct(string(v).alias("lex"), F.concat(F.lower(string(t)), F.lit("--"), string(d)).alias("lang")), Lane("lang"))
FUNCTIONS["STRDT"] = lambda v, d: Val(typed(string(v), d.const), Lane("lit", dt=d.const))
FUNCTIONS["DATATYPE"] = lambda v: Val(
    F.when(v.col["kind"] == 2, v.col["dt"]) if v.family == "dyn" else F.when(v.col.isNotNull(), F.lit(RDF + "langString" if v.family == "lang" else v.lane.dt)) if v.lane.kind in ("lit", "lang") else F.lit(None).cast("string"), FULL_IRI
)
FUNCTIONS["IRI"] = FUNCTIONS["URI"] = lambda v: v if v.family == "iri" else Val(string(v), FULL_IRI)
FUNCTIONS["BNODE"] = FUNCTIONS[AFN + "bnode"] = lambda v=None: Val(F.sha2(string(v), 256) if v is not None else F.uuid(), Lane("bnode"))
FUNCTIONS["SAMETERM"] = lambda a, b: Val(same_term(a, b), BOOLEAN)


def _kind_test(static: set[str], code: int) -> Function:
    def run(v: Val) -> Val:
        if v.family == "dyn":
            return Val(v.col["kind"] == code, BOOLEAN)
        return Val(F.when(v.col.isNotNull(), F.lit(v.lane.kind in static)), BOOLEAN)

    return run


FUNCTIONS["ISIRI"] = FUNCTIONS["ISURI"] = _kind_test({"iri"}, 0)
FUNCTIONS["ISBLANK"] = _kind_test({"bnode"}, 1)
FUNCTIONS["ISLITERAL"] = _kind_test({"lit", "lang"}, 2)
FUNCTIONS["ISNUMERIC"] = lambda v: Val(L.dyn_number(v.col).isNotNull() if v.family == "dyn" else F.when(v.col.isNotNull(), F.lit(v.family == "num")), BOOLEAN)
FUNCTIONS["TRIPLE"] = lambda s, p, o: Val(F.struct(*[L.to_dyn(x.col, x.lane).alias(n) for n, x in zip("spo", (s, p, o))]), Lane("lit", dt="urn:triple"))
FUNCTIONS["SUBJECT"] = lambda v: Val(v.col["s"], DYN)
FUNCTIONS["PREDICATE"] = lambda v: Val(v.col["p"], DYN)
FUNCTIONS["OBJECT"] = lambda v: Val(v.col["o"], DYN)
FUNCTIONS["ISTRIPLE"] = lambda v: Val(F.when(v.col.isNotNull(), F.lit(v.lane.dt == "urn:triple")), BOOLEAN)


# numbers
def _numeric(f: Callable[[Column], Column], keep: bool = True, lane: Lane = DOUBLE) -> Function:
    def run(v: Val) -> Val:
        if v.family == "num" and v.lane.dt in L.INTEGERS and keep:
            return Val(f(v.col).cast("bigint"), INTEGER)
        if v.family == "num" and v.lane.dt == XSD + "decimal" and keep:
            return Val(f(v.col).cast("decimal(38,18)"), DECIMAL)
        return Val(f(number(v).cast("double")).cast("double"), lane)

    return run


FUNCTIONS["ABS"] = FUNCTIONS[FN + "abs"] = _numeric(F.abs)
FUNCTIONS["CEIL"] = FUNCTIONS[FN + "ceiling"] = _numeric(F.ceil)
FUNCTIONS["FLOOR"] = FUNCTIONS[FN + "floor"] = _numeric(F.floor)
FUNCTIONS["ROUND"] = FUNCTIONS[FN + "round"] = _numeric(lambda x: F.floor(x + F.lit(0.5)))
FUNCTIONS[FN + "round-half-to-even"] = lambda v, p=None: _numeric(lambda x: F.bround(x, p.const if p else 0))(v)
FUNCTIONS["RAND"] = lambda: Val(F.rand(), DOUBLE)
FUNCTIONS[FN + "numeric-mod"] = lambda a, b: Val(F.try_mod(a.col, b.col), _promote(a, b))
FUNCTIONS[FN + "numeric-integer-divide"] = lambda a, b: Val(F.try_divide(a.col.cast("double"), b.col.cast("double")).cast("bigint"), INTEGER)
FUNCTIONS[FN + "format-number"] = lambda v, p: Val(F.format_number(number(v), len(p.const.partition(".")[2])), STRING)
FUNCTIONS[FN + "not"] = lambda v: Val(~boolean(v), BOOLEAN)
FUNCTIONS[FN + "boolean"] = lambda v: Val(boolean(v), BOOLEAN)
FUNCTIONS[FN + "error"] = lambda *a: Val(F.lit(None).cast("string"), STRING)
FUNCTIONS[FN + "collation-key"] = FUNCTIONS[AFN + "collation"] = lambda *a: Val(F.lower(string(a[-1])), STRING)
for _name, _f in {"sqrt": F.sqrt, "exp": F.exp, "log": F.log, "log10": F.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan}.items():
    FUNCTIONS[MATH + _name] = _numeric(_f, keep=False)
FUNCTIONS[MATH + "exp10"] = _numeric(lambda x: F.pow(F.lit(10.0), x), keep=False)
FUNCTIONS[MATH + "pow"] = lambda a, b: Val(F.pow(number(a), number(b)), DOUBLE)
FUNCTIONS[MATH + "atan2"] = lambda a, b: Val(F.atan2(number(a), number(b)), DOUBLE)
FUNCTIONS[MATH + "pi"] = FUNCTIONS[AFN + "pi"] = lambda: Val(F.pi(), DOUBLE)
FUNCTIONS[MATH + "e"] = FUNCTIONS[AFN + "e"] = lambda: Val(F.e(), DOUBLE)
FUNCTIONS[AFN + "sqrt"] = FUNCTIONS[MATH + "sqrt"]
FUNCTIONS[AFN + "min"] = lambda *a: Val(F.least(*[x.col for x in a]) if len(a) > 1 else a[0].col, reduce(_promote_lane, a).lane if len(a) > 1 else a[0].lane)
FUNCTIONS[AFN + "max"] = lambda *a: Val(F.greatest(*[x.col for x in a]) if len(a) > 1 else a[0].col, reduce(_promote_lane, a).lane if len(a) > 1 else a[0].lane)
FUNCTIONS[AFN + "evenInteger"] = lambda v: Val(number(v) % 2 == 0, BOOLEAN)


def _promote_lane(a: Val, b: Val) -> Val:
    return Val(a.col, _promote(a, b))


# hashes, ids
FUNCTIONS["MD5"] = _text(F.md5)
FUNCTIONS["SHA1"] = FUNCTIONS[AFN + "sha1sum"] = _text(F.sha1)
for _bits in (256, 384, 512):
    FUNCTIONS[f"SHA{_bits}"] = _text(lambda s, n=_bits: F.sha2(s, n))
FUNCTIONS["UUID"] = FUNCTIONS[AFN + "uuid"] = lambda: Val(F.concat(F.lit("urn:uuid:"), F.uuid()), FULL_IRI)
FUNCTIONS["STRUUID"] = FUNCTIONS[AFN + "struuid"] = lambda: Val(F.uuid(), STRING)
FUNCTIONS[AFN + "langeq"] = FUNCTIONS["LANGMATCHES"]
FUNCTIONS[AFN + "version"] = lambda: Val(F.lit("0.1.0"), STRING)


# dates
_ZONE = r"(Z|[+-]\d\d:\d\d)$"


def _time(v: Val) -> Column:
    return v.col if v.family in ("dateTime", "date") else string(v).try_cast("timestamp")


def zoned(v: Val) -> Val:
    """A dateTime literal in another zone, or in none, as a term, which keeps its lexical form."""
    if v.family == "dateTime" and isinstance(v.const, str) and not v.const.endswith("Z"):
        return Val(F.when(v.col.isNotNull(), L.term(F.lit(v.const), XSD + "dateTime")), L.DYN)
    return v


def _written(v: Val) -> Column | None:
    """The lexical form of a time where it may have a zone of its own; None for columns of instants, which are UTC."""
    if v.family in ("dateTime", "date"):
        return F.lit(v.const) if isinstance(v.const, str) else None
    return string(v)


def _local(v: Val) -> Column:
    """The time on the clock of the value's own zone."""
    text = _written(v)
    return _time(v) if text is None else F.regexp_replace(text, _ZONE, "").try_cast("timestamp")


def _zone(v: Val) -> Column:
    """The zone as written, empty if there is none."""
    text = _written(v)
    return F.when(_time(v).isNotNull(), F.lit("Z") if text is None and v.family == "dateTime" else F.lit("") if text is None else F.regexp_extract(text, _ZONE, 1))


def _offset(v: Val) -> Val:
    z = _zone(v)
    hours, minutes = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    some = F.concat(F.when(F.startswith(z, F.lit("-")), "-").otherwise(""), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
    return Val(F.when(z == "Z", "PT0S").when(z != "", F.when((hours == 0) & (minutes == 0), "PT0S").otherwise(some)), Lane("lit", dt=XSD + "dayTimeDuration", nullable=True))


def _part(f: Callable[[Column], Column]) -> Function:
    return lambda v: Val(f(_local(v)).cast("bigint"), INTEGER)


for _name, _f in {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOURS": F.hour, "MINUTES": F.minute}.items():
    FUNCTIONS[_name] = _part(_f)
    for _kind in ("dateTime", "date", "time"):
        FUNCTIONS[FN + f"{_name.lower()}-from-{_kind}"] = FUNCTIONS[_name]
        FUNCTIONS[FN + f"{_name.lower().rstrip('s')}-from-{_kind}"] = FUNCTIONS[_name]
FUNCTIONS["SECONDS"] = lambda v: Val((F.unix_micros(_local(v).cast("timestamp")) % 60_000_000 / F.lit(1_000_000)).cast("decimal(38,18)"), DECIMAL)
FUNCTIONS[FN + "seconds-from-dateTime"] = FUNCTIONS[FN + "seconds-from-time"] = FUNCTIONS["SECONDS"]
FUNCTIONS["TIMEZONE"] = FUNCTIONS[AFN + "timezone"] = FUNCTIONS[FN + "timezone-from-dateTime"] = FUNCTIONS[FN + "timezone-from-date"] = _offset
FUNCTIONS["TZ"] = lambda v: Val(_zone(v), STRING)
FUNCTIONS["NOW"] = FUNCTIONS[AFN + "now"] = FUNCTIONS[AFN + "nowtz"] = lambda: Val(F.current_timestamp(), DATETIME)
FUNCTIONS[AFN + "system-timezone"] = FUNCTIONS[FN + "implicit-timezone"] = lambda: Val(F.lit("PT0S"), Lane("lit", dt=XSD + "dayTimeDuration"))
FUNCTIONS[AFN + "date"] = lambda v: Val(F.to_date(_time(v)), DATE)
FUNCTIONS[FN + "dateTime"] = lambda d, t: Val(F.concat(string(d), F.lit("T"), string(t)).try_cast("timestamp"), DATETIME)


def _duration(unit: str) -> Function:
    """The components of years, months, days, hours, minutes and seconds of a normalised duration."""

    def run(v: Val) -> Val:
        s = string(v)
        sign = F.when(F.startswith(s, F.lit("-")), -1).otherwise(1)

        def field(pattern: str) -> Column:
            return F.coalesce(F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")).try_cast("double"), F.lit(0.0))

        months = field(r"^-?P[^T]*?(\d+)Y") * 12 + field(r"^-?P[^T]*?(\d+)M")
        seconds = field(r"(\d+)D") * 86400 + field(r"T.*?(\d+)H") * 3600 + field(r"T.*?(\d+)M") * 60 + field(r"([\d.]+)S")
        value = {
            "years": F.floor(months / 12), "months": months % 12, "days": F.floor(seconds / 86400), "hours": F.floor(seconds % 86400 / 3600),
            "minutes": F.floor(seconds % 3600 / 60), "seconds": seconds % 60,
        }[unit]
        out = F.when(F.regexp_like(s, F.lit(r"^-?P")), sign * value)
        return Val(out.cast("decimal(38,18)"), DECIMAL) if unit == "seconds" else Val(out.cast("bigint"), INTEGER)

    return run


for _unit in ("years", "months", "days", "hours", "minutes", "seconds"):
    FUNCTIONS[FN + f"{_unit}-from-duration"] = _duration(_unit)


def _adjust(v: Val, tz: Val | None = None) -> Val:
    """Wall-clock time in another zone (P[-]T… durations); instants keep their order."""
    m = re.fullmatch(r"(-?)PT(?:(\d+)H)?(?:(\d+)M)?(?:0S)?", tz.const if tz is not None and tz.const else "PT0S")
    minutes = (int(m[2] or 0) * 60 + int(m[3] or 0)) * (-1 if m[1] else 1) if m else 0
    return Val(_time(v).cast("timestamp") + F.make_dt_interval(mins=F.lit(minutes)), DATETIME)


for _kind in ("dateTime", "date", "time"):
    FUNCTIONS[FN + f"adjust-{_kind}-to-timezone"] = _adjust
FUNCTIONS[AFN + "adjust-to-timezone"] = _adjust


# lists and maps
def _cdt(name: str) -> Callable[[Function], Function]:
    return function(CDT + name)


@_cdt("List")
def _list(*args: Val) -> Val:
    if not args:
        return Val(F.array().cast("array<string>"), Lane("lit", dt=L.LIST, elem=STRING))
    lane = args[0].lane
    for a in args[1:]:
        lane = _promote(Val(a.col, lane), a) if a.family == "num" and L.family(lane) == "num" else lane if a.lane.dt == lane.dt and a.lane.kind == lane.kind else DYN
    cells = [L.to_dyn(a.col, a.lane) for a in args] if lane is DYN else [a.col for a in args]
    return Val(F.array(*cells), Lane("lit", dt=L.LIST, elem=lane))


@_cdt("Map")
def _map(*args: Val) -> Val:
    if not args:
        return Val(F.create_map().cast("map<string,string>"), Lane("lit", dt=L.MAP, elem=(STRING, STRING)))
    keys, values = _list(*args[::2]), _list(*args[1::2])
    return Val(F.map_from_arrays(keys.col, values.col), Lane("lit", dt=L.MAP, elem=(keys.lane.elem, values.lane.elem)))


def _as(lane: Lane | None, x: Val) -> Column:
    """A value in the lane of a list's or map's elements."""
    return L.to_dyn(x.col, x.lane) if lane is not None and lane.kind == "dyn" else x.col


def _concat(*lists: Val) -> Val:
    if len({x.lane.elem for x in lists}) == 1:
        return Val(F.concat(*[x.col for x in lists]), lists[0].lane)
    same = [F.transform(x.col, lambda c, l=x.lane.elem or STRING: L.to_dyn(c, l)) for x in lists]
    return Val(F.concat(*same), Lane("lit", dt=L.LIST, elem=L.DYN))


@_cdt("get")
def _get(v: Val, k: Val) -> Val:
    if v.family == "map":
        return Val(F.try_element_at(v.col, _as(v.lane.elem[0], k)), v.lane.elem[1])
    return Val(F.when(k.col >= 1, F.get(v.col, (k.col - 1).cast("int"))), v.lane.elem or STRING)


FUNCTIONS[CDT + "head"] = lambda v: Val(F.get(v.col, 0), v.lane.elem or STRING)
FUNCTIONS[CDT + "tail"] = lambda v: Val(F.when(F.size(v.col) > 0, F.slice(v.col, F.lit(2), F.greatest(F.size(v.col), F.lit(1)))), v.lane)
FUNCTIONS[CDT + "size"] = lambda v: Val(F.size(v.col).cast("bigint"), INTEGER)
FUNCTIONS[CDT + "reverse"] = lambda v: Val(F.reverse(v.col), v.lane)
FUNCTIONS[CDT + "concat"] = _concat
FUNCTIONS[CDT + "contains"] = lambda v, x: Val(F.coalesce(F.array_contains(v.col, _as(v.lane.elem, x)), F.lit(False)), BOOLEAN)
FUNCTIONS[CDT + "containsKey"] = lambda v, x: Val(F.map_contains_key(v.col, _as(v.lane.elem[0], x)), BOOLEAN)
FUNCTIONS[CDT + "keys"] = lambda v: Val(F.map_keys(v.col), Lane("lit", dt=L.LIST, elem=v.lane.elem[0]))
FUNCTIONS[CDT + "merge"] = lambda a, b: Val(F.map_concat(a.col, F.map_filter(b.col, lambda k, _: ~F.map_contains_key(a.col, k))), a.lane)
FUNCTIONS[CDT + "put"] = lambda m, k, v: Val(F.map_concat(F.map_filter(m.col, lambda x, _: x != _as(m.lane.elem[0], k)), F.create_map(_as(m.lane.elem[0], k), _as(m.lane.elem[1], v))), m.lane)
FUNCTIONS[CDT + "remove"] = lambda m, k: Val(F.map_filter(m.col, lambda x, _: x != _as(m.lane.elem[0], k)), m.lane)


@_cdt("subseq")
def _subseq(v: Val, start: Val, size: Val | None = None) -> Val:
    at = start.col.cast("int")
    n = size.col.cast("int") if size is not None else F.size(v.col)
    return Val(F.when((at >= 1) & (at <= F.size(v.col) + 1), F.slice(v.col, at, n)), v.lane)


# vectors
def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


FUNCTIONS[VEC + "dot"] = lambda a, b: Val(_dot(a.col, b.col), DOUBLE)
FUNCTIONS[VEC + "cosine"] = lambda a, b: Val(F.try_divide(_dot(a.col, b.col), F.sqrt(_dot(a.col, a.col)) * F.sqrt(_dot(b.col, b.col))), DOUBLE)
FUNCTIONS[VEC + "euclidean"] = lambda a, b: Val(F.sqrt(F.aggregate(F.zip_with(a.col.cast("array<double>"), b.col.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)), DOUBLE)
FUNCTIONS[VEC + "dimension"] = lambda a: Val(F.size(a.col).cast("bigint"), INTEGER)


# geometry
GEOF = "http://www.opengis.net/def/function/geosparql/"
for _name, (_, _kind) in (geo.UNARY | geo.BINARY).items():
    FUNCTIONS[GEOF + _name] = lambda *args, n=_name, k=_kind: Val(geo.function(n, *[number(a).cast("double") if a.family == "num" else string(a) for a in args[: 1 if n in geo.UNARY else 2]]), {"double": DOUBLE, "boolean": BOOLEAN, "long": INTEGER}.get(k, Lane("lit", dt="http://www.opengis.net/ont/geosparql#wktLiteral") if n not in ("asGeoJSON", "getSRID", "geometryType", "relate") else STRING))
