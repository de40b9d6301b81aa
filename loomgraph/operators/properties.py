"""Property functions: predicates that compute instead of matching triples.

A list of arguments arrives as first/rest patterns; ``split`` gathers them.  The
functions that make rows of their own give a ``Solution`` to be joined; those
that bind a variable from bound ones extend the solution of the other patterns.
Applications register their own with ``register_property``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F

from ..functions import builtins as B
from ..functions.builtins import Val
from ..plans import algebra as A
from ..plans import lanes as L
from ..plans.lanes import DOUBLE, INTEGER, RDF, STRING
from . import geo, search
from .tables import Rounds

LIST = "http://jena.apache.org/ARQ/list#"
APF = "http://jena.apache.org/ARQ/property#"
TEXT = "urn:loomgraph:text#"
SPATIAL = "http://jena.apache.org/spatial#"
WGS = "http://www.w3.org/2003/01/geo/wgs84_pos#"

#: IRI: function of (compiler, subject arguments, object arguments) that gives a Solution.
PROPERTIES: dict[str, Callable] = {}
#: IRI: function of (compiler, solution, subject arguments, object arguments) that gives an extended Solution.
BINDERS: dict[str, Callable] = {}


def register_property(iri: str, f: Callable) -> None:
    PROPERTIES[iri] = f


def split(triples: list) -> tuple[list, list]:
    """(other patterns, calls): calls are (IRI, subject arguments, object arguments)."""
    if not any(isinstance(p, A.Iri) and (p.value in PROPERTIES or p.value in BINDERS) for _, p, _ in triples):
        return triples, []
    cells: dict[Any, dict[str, Any]] = {}
    for s, p, o in triples:
        if isinstance(s, A.Var) and s.name.startswith(".") and isinstance(p, A.Iri) and p.value in (RDF + "first", RDF + "rest"):
            cells.setdefault(s, {})[p.value] = o
    used: set = set()

    def arguments(t: Any) -> list:
        if t not in cells and t != A.Iri(RDF + "nil"):
            return [t]
        out = []
        while t in cells:
            used.add(t)
            out.append(cells[t][RDF + "first"])
            t = cells[t][RDF + "rest"]
        return out

    calls = [(p.value, arguments(s), arguments(o)) for s, p, o in triples if isinstance(p, A.Iri) and (p.value in PROPERTIES or p.value in BINDERS)]
    rest = [t for t in triples if not (isinstance(t[1], A.Iri) and (t[1].value in PROPERTIES or t[1].value in BINDERS)) and t[0] not in used]
    return rest, calls


def apply(c: Any, base: Any, calls: list) -> Any:
    for iri, left, right in calls:
        if iri in BINDERS:
            base = BINDERS[iri](c, base if base is not None else c.unit(), left, right)
        else:
            made = PROPERTIES[iri](c, left, right)
            base = made if base is None else c.join(base, made)
    return base


# ---------------------------------------------------------------- lists


def _elements(c: Any):
    """(list, i, member) of every list, by walking rest links from all cells at once."""
    from ..plans.compile import col_of

    def edges(p: str, a: str, b: str):
        s = c.compile(A.Bgp([(A.Var(".s"), A.Iri(RDF + p), A.Var(".o"))]))
        return s.df.select(L.to_dyn(F.col(col_of(".s")), s.lanes[".s"]).alias(a), L.to_dyn(F.col(col_of(".o")), s.lanes[".o"]).alias(b))

    rounds = Rounds(c.spark, "lists", keep=10_000)
    rest, first = rounds.save(edges("rest", "node", "next")), edges("first", "node", "member")
    walk = rounds.save(rest.select(F.col("node").alias("list"), "node", F.lit(0).cast("long").alias("i")))
    parts = [walk]
    while True:
        step = walk.join(rest, "node").where(F.col("next.lex") != RDF + "nil").select("list", F.col("next").alias("node"), (F.col("i") + 1).alias("i"))
        walk = rounds.save(step)
        if walk.isEmpty():
            break
        parts.append(walk)
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.join(first, "node").select("list", "i", "member")


def _rows(c: Any, df: Any, columns: list[tuple[Any, str, Any]]) -> Any:
    """A solution of the columns; constants are filters."""
    from ..plans.compile import Solution, col_of

    cols, lanes = [], {}
    for t, name, lane in columns:
        v = Val(F.col(name), lane)
        if isinstance(t, A.Var):
            cols.append(v.col.alias(col_of(t.name)))
            lanes[t.name] = lane
        elif lane.kind == "dyn":
            k = c._term(t)
            df = df.where(B.compare("=", v, k))
        else:
            df = df.where(B.compare("=", v, c._term(t)))
    return Solution(df.select(*cols), lanes)


PROPERTIES[LIST + "member"] = lambda c, s, o: _rows(c, _elements(c), [(s[0], "list", L.DYN), (o[0], "member", L.DYN)])
PROPERTIES[LIST + "index"] = lambda c, s, o: _rows(c, _elements(c), [(s[0], "list", L.DYN), (o[0], "i", INTEGER), (o[1], "member", L.DYN)])
PROPERTIES[LIST + "length"] = lambda c, s, o: _rows(c, _elements(c).groupBy("list").agg(F.count("*").alias("n")), [(s[0], "list", L.DYN), (o[0], "n", INTEGER)])


def _members(c: Any, s: list, o: list) -> Any:
    """Container membership: rdf:_1, rdf:_2, and so on."""
    df = c.graph.triples(None, c.active).where(F.col("p").rlike("^" + RDF.replace(".", r"\.") + r"_\d+$"))
    return _rows(c, df, [(s[0], "s", L.DYN), (o[0], "o", L.DYN)])


PROPERTIES["http://www.w3.org/2000/01/rdf-schema#member"] = _members

# ---------------------------------------------------------------- binders


def _bind(c: Any, base: Any, t: Any, v: Val) -> Any:
    """Bind a variable, or compare with what it (or a constant) is."""
    from ..plans.compile import Solution, col_of

    if isinstance(t, A.Var) and t.name not in base.lanes:
        return Solution(base.df.withColumn(col_of(t.name), v.col), {**base.lanes, t.name: v.lane.null()})
    have = base.val(t.name) if isinstance(t, A.Var) else c._term(t)
    return Solution(base.df.where(F.coalesce(B.compare("=", have, v), F.lit(False))), base.lanes)


def _split_iri(c: Any, base: Any, s: list, o: list) -> Any:
    v = c.expr(s[0], base)
    base = _bind(c, base, o[0], B.FUNCTIONS[B.AFN + "namespace"](v))
    return _bind(c, base, o[1], B.FUNCTIONS[B.AFN + "localname"](c.expr(s[0], base)))


BINDERS[APF + "splitIRI"] = _split_iri
BINDERS[APF + "concat"] = lambda c, base, s, o: _bind(c, base, s[0], B.FUNCTIONS["CONCAT"](*[c.expr(x, base) for x in o]))
BINDERS[APF + "str"] = lambda c, base, s, o: _bind(c, base, s[0], B.FUNCTIONS["STR"](c.expr(o[0], base)))
BINDERS[APF + "assign"] = lambda c, base, s, o: _bind(c, base, s[0], c.expr(o[0], base))

# ---------------------------------------------------------------- text, places


def _text(c: Any, s: list, o: list) -> Any:
    """``?s text:query (predicate "query" limit "lang:xx" "highlight:s:… | e:…")``; ``(?s ?score ?literal)`` on the left."""
    from ..plans.compile import Solution, col_of

    predicate = o[0] if isinstance(o[0], A.Iri) else None
    rest = o[1:] if predicate is not None else o
    if predicate is None:
        raise ValueError("text:query needs the predicate whose texts it searches")
    words = rest[0].lex
    limit = next((int(x.lex) for x in rest[1:] if x.dt.endswith("integer")), None)
    language = next((x.lex[5:] for x in rest[1:] if x.lex.startswith("lang:")), None)
    marks = next((x.lex[10:] for x in rest[1:] if x.lex.startswith("highlight:")), None)
    base = c.compile(A.Bgp([(A.Var(".s"), predicate, A.Var(".t"))]))
    text = B.string(base.val(".t"))
    docs = base.df.select(F.col(col_of(".s")).alias("k"), text.alias("t"))
    found = search.bm25(docs, words, "t", "k", language, language is not None, limit)
    lanes = {}
    if isinstance(s[0], A.Var):
        lanes[s[0].name] = ("k", base.lanes[".s"])
    if len(s) > 1:
        lanes[s[1].name] = ("score", DOUBLE)
    if len(s) > 2:
        found = found.join(docs, "k")
        if marks is not None:
            parts = dict(x.split(":", 1) for x in marks.replace(" ", "").split("|") if ":" in x)
            found = found.withColumn("t", search.highlight(F.col("t"), words, parts.get("s", "<b>"), parts.get("e", "</b>"), int(parts["z"]) if "z" in parts else None))
        lanes[s[2].name] = ("t", STRING)
    out = Solution(found.select(*[F.col(k).alias(col_of(v)) for v, (k, _) in lanes.items()]), {v: lane for v, (_, lane) in lanes.items()})
    if isinstance(s[0], A.Iri):
        out = Solution(found.where(c._compared("=", Val(F.col("k"), base.lanes[".s"]), c._term(s[0]))).select(*[F.col(k).alias(col_of(v)) for v, (k, _) in lanes.items()]), {v: lane for v, (_, lane) in lanes.items()})
    return out


PROPERTIES[TEXT + "query"] = _text


def _number(t: A.Lit) -> float:
    return float(t.lex)


def _places(c: Any) -> tuple[Any, Any]:
    """Latitude and longitude of the resources that have both."""
    s = c.compile(A.Bgp([(A.Var(".s"), A.Iri(WGS + "lat"), A.Var(".a")), (A.Var(".s"), A.Iri(WGS + "long"), A.Var(".o"))]))
    from ..plans.compile import col_of

    df = s.df.select(F.col(col_of(".s")).alias("k"), B.number(s.val(".a")).cast("double").alias("lat"), B.number(s.val(".o")).cast("double").alias("lon"))
    return df, s.lanes[".s"]


def _nearby(c: Any, s: list, o: list) -> Any:
    """``?s spatial:nearby (lat lon radius [unit] [limit])``, kilometres by default."""
    df, lane = _places(c)
    unit = next((x.lex.rsplit("/", 1)[-1] for x in o[3:] if isinstance(x, A.Lit) and not x.dt.endswith("integer")), next((x.value.rsplit("/", 1)[-1] for x in o[3:] if isinstance(x, A.Iri)), "kilometre"))
    limit = next((int(x.lex) for x in o[3:] if isinstance(x, A.Lit) and x.dt.endswith("integer")), None)
    metres = _number(o[2]) * (geo.UNITS.get(unit) or 1000.0)
    return _rows(c, geo.nearby(df, "lon", "lat", (_number(o[1]), _number(o[0])), metres, limit), [(s[0], "k", lane)])


def _within_box(c: Any, s: list, o: list) -> Any:
    """``?s spatial:withinBox (latMin lonMin latMax lonMax)``."""
    df, lane = _places(c)
    a, b, x, y = map(_number, o[:4])
    return _rows(c, df.where(geo.within_box(F.col("lon"), F.col("lat"), (b, a, y, x))), [(s[0], "k", lane)])


PROPERTIES[SPATIAL + "nearby"] = PROPERTIES[SPATIAL + "nearbyGeom"] = _nearby
PROPERTIES[SPATIAL + "withinBox"] = PROPERTIES[SPATIAL + "intersectBox"] = _within_box
