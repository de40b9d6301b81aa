"""Validation: SHACL shapes as violation queries, and typing of nodes by ShEx-like shapes.

A shape is a dictionary (``from_triples`` reads it from a shapes graph).  Every
constraint is one query over the triples (s, p, o as term structs) that gives
the focus nodes and values that break it; the report is their union.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lanes import RDF, XSD

SH = "http://www.w3.org/ns/shacl#"
_REPORT = ["focus", "path", "value", "component", "severity", "shape", "message"]
_KINDS = {"IRI": [0], "BlankNode": [1], "Literal": [2], "BlankNodeOrIRI": [0, 1], "BlankNodeOrLiteral": [1, 2], "IRIOrLiteral": [0, 2]}


def targets(triples: DataFrame, shape: dict[str, Any]) -> DataFrame:
    """(focus) of targetClass, targetNode, targetSubjectsOf, targetObjectsOf."""
    out = None

    def add(df: DataFrame) -> None:
        nonlocal out
        out = df if out is None else out.union(df)

    for c in shape.get("targetClass", []):
        add(triples.where((F.col("p") == RDF + "type") & (F.col("o.lex") == c)).select(F.col("s").alias("focus")))
    for n in shape.get("targetNode", []):
        add(triples.sparkSession.range(1).select(F.struct(F.lit(0).cast("tinyint").alias("kind"), F.lit(n).alias("lex"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang")).alias("focus")))
    for p in shape.get("targetSubjectsOf", []):
        add(triples.where(F.col("p") == p).select(F.col("s").alias("focus")))
    for p in shape.get("targetObjectsOf", []):
        add(triples.where(F.col("p") == p).select(F.col("o").alias("focus")))
    if out is None:
        raise ValueError("a shape without targets")
    return out.distinct()


def values(triples: DataFrame, focus: DataFrame, path: Any) -> DataFrame:
    """(focus, value): a predicate, ("inverse", p), ("seq", [...]), ("alt", [...]) or ("plus"/"star"/"opt", p)."""
    if isinstance(path, str):
        edges = triples.where(F.col("p") == path).select(F.col("s").alias("focus"), F.col("o").alias("value"))
        return focus.join(edges, "focus")
    kind, arg = path
    if kind == "inverse":
        edges = triples.where(F.col("p") == arg).select(F.col("o").alias("focus"), F.col("s").alias("value"))
        return focus.join(edges, "focus")
    if kind == "alt":
        out = values(triples, focus, arg[0])
        for x in arg[1:]:
            out = out.union(values(triples, focus, x))
        return out.distinct()
    if kind == "seq":
        out = values(triples, focus, arg[0])
        for x in arg[1:]:
            nxt = values(triples, out.select(F.col("value").alias("focus")).distinct(), x).withColumnsRenamed({"focus": "_m", "value": "_v"})
            out = out.join(nxt, out["value"] == nxt["_m"]).select("focus", F.col("_v").alias("value")).distinct()
        return out
    own = focus.select("focus", F.col("focus").alias("value"))
    if kind == "opt":
        return own.union(values(triples, focus, arg)).distinct()
    from .paths import closure

    class _Holder:
        spark = triples.sparkSession

    edges = triples.where(F.col("p") == arg).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    found = closure(_Holder, edges, focus.select(F.col("focus").alias("src"))).select(F.col("src").alias("focus"), F.col("dst").alias("value"))
    return found if kind == "plus" else found.union(own).distinct()


def _number(v: Column) -> Column:
    return F.when(v["kind"] == 2, v["lex"].try_cast("double"))


def _value_tests(shape: dict[str, Any]) -> list[tuple[str, Column]]:
    """(component, condition of a bad value) of what looks at one value alone."""
    v, out = F.col("value"), []
    test = lambda name, good: out.append((name, ~F.coalesce(good, F.lit(False))))
    if "datatype" in shape:
        dt = shape["datatype"]
        well = {XSD + "integer": r"^[+-]?\d+$", XSD + "decimal": r"^[+-]?(\d+\.?\d*|\.\d+)$", XSD + "boolean": r"^(true|false|0|1)$", XSD + "double": r"^([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)$", XSD + "date": r"^-?\d{4,}-\d\d-\d\d(Z|[+-]\d\d:\d\d)?$", XSD + "dateTime": r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$"}.get(dt)
        test("datatype", (v["kind"] == 2) & (v["dt"] == dt) & (v["lex"].rlike(well) if well else F.lit(True)))
    if "nodeKind" in shape:
        test("nodeKind", v["kind"].isin(_KINDS[shape["nodeKind"].removeprefix(SH)]))
    for name, f in (("minInclusive", lambda x, n: x >= n), ("maxInclusive", lambda x, n: x <= n), ("minExclusive", lambda x, n: x > n), ("maxExclusive", lambda x, n: x < n)):
        if name in shape:
            test(name, f(_number(v), F.lit(float(shape[name]))))
    if "minLength" in shape:
        test("minLength", (v["kind"] != 1) & (F.char_length(v["lex"]) >= shape["minLength"]))
    if "maxLength" in shape:
        test("maxLength", (v["kind"] != 1) & (F.char_length(v["lex"]) <= shape["maxLength"]))
    if "pattern" in shape:
        flags = f"(?{shape['flags']})" if shape.get("flags") else ""
        test("pattern", (v["kind"] != 1) & v["lex"].rlike(flags + shape["pattern"]))
    if "languageIn" in shape:
        langs = [x.lower() for x in shape["languageIn"]]
        some = F.lit(False)
        for x in langs:
            some = some | (v["lang"] == x) | F.startswith(v["lang"], F.lit(x + "-"))
        test("languageIn", some)
    if "in" in shape:
        test("in", v["lex"].isin(*[str(x) for x in shape["in"]]))
    return out


def violations(triples: DataFrame, shape: dict[str, Any], focus: DataFrame | None = None) -> DataFrame:
    """The report rows of one shape and its property shapes."""
    spark = triples.sparkSession
    focus = targets(triples, shape) if focus is None else focus
    parts: list[DataFrame] = []
    name = shape.get("name", "")

    def report(df: DataFrame, component: str, s: dict[str, Any], value: Column | None = None) -> None:
        path = s.get("path")
        parts.append(
            df.select(
                F.col("focus.lex").alias("focus"), F.lit(path if isinstance(path, str) or path is None else repr(path)).alias("path"), (F.lit(None).cast("string") if value is None else value).alias("value"),
                F.lit(component).alias("component"), F.lit(s.get("severity", shape.get("severity", "Violation"))).alias("severity"), F.lit(s.get("name", name)).alias("shape"), F.lit(s.get("message")).cast("string").alias("message"),
            )
        )

    def check(s: dict[str, Any], found: DataFrame, nodes: DataFrame) -> None:
        bad = _value_tests(s)
        if bad:
            # One pass over the values: each carries the components that it breaks.
            marks = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in bad]))
            broken = found.select("focus", "value", F.explode(marks).alias("_c"))
            for n, _ in bad:
                report(broken.where(F.col("_c") == n), n, s, F.col("value.lex"))
        if "minCount" in s or "maxCount" in s:
            counts = found.groupBy("focus").agg(F.count_distinct("value").alias("n"))
            if s.get("minCount"):
                report(nodes.join(counts, "focus", "left").where(F.coalesce("n", F.lit(0)) < s["minCount"]), "minCount", s)
            if "maxCount" in s:
                report(counts.where(F.col("n") > s["maxCount"]), "maxCount", s)
        if "class" in s:
            typed = triples.where((F.col("p") == RDF + "type") & (F.col("o.lex") == s["class"])).select(F.col("s").alias("value")).distinct()
            report(found.join(typed, "value", "left_anti"), "class", s, F.col("value.lex"))
        if "hasValue" in s:
            report(nodes.join(found.where(F.col("value.lex") == str(s["hasValue"])).select("focus"), "focus", "left_anti"), "hasValue", s)
        if s.get("uniqueLang"):
            report(found.where(F.col("value.lang").isNotNull()).groupBy("focus", F.col("value.lang").alias("value")).count().where("count > 1"), "uniqueLang", s, F.col("value"))
        for key, cond in (("equals", None), ("disjoint", None), ("lessThan", "<"), ("lessThanOrEquals", "<=")):
            if key in s:
                other = values(triples, nodes, s[key]).withColumnRenamed("value", "_o")
                if key == "disjoint":
                    report(found.join(other, "focus").where(F.col("value") == F.col("_o")), key, s, F.col("value.lex"))
                elif key == "equals":
                    report(found.join(other.withColumnRenamed("_o", "value"), ["focus", "value"], "left_anti"), key, s, F.col("value.lex"))
                    report(other.withColumnRenamed("_o", "value").join(found, ["focus", "value"], "left_anti"), key, s, F.col("value.lex"))
                else:
                    a, b = _number(F.col("value")), _number(F.col("_o"))
                    a, b = F.when(a.isNotNull() & b.isNotNull(), a.cast("string")).otherwise(F.col("value.lex")), F.when(a.isNotNull() & b.isNotNull(), b.cast("string")).otherwise(F.col("_o.lex"))
                    n, m = _number(F.col("value")), _number(F.col("_o"))
                    good = F.when(n.isNotNull() & m.isNotNull(), n < m if cond == "<" else n <= m).otherwise(a < b if cond == "<" else a <= b)
                    report(found.join(other, "focus").where(~F.coalesce(good, F.lit(False))), key, s, F.col("value.lex"))
        if "node" in s:
            inner = violations(triples, {**s["node"], "name": s["node"].get("name", name)}, found.select(F.col("value").alias("focus")).distinct()).select(F.col("focus").alias("_bad")).distinct()
            report(found.join(inner, F.col("value.lex") == F.col("_bad"), "left_semi"), "node", s, F.col("value.lex"))
        if "qualifiedValueShape" in s:
            inner = violations(triples, {**s["qualifiedValueShape"]}, found.select(F.col("value").alias("focus")).distinct()).select(F.col("focus").alias("_bad")).distinct()
            good = found.join(inner, F.col("value.lex") == F.col("_bad"), "left_anti").groupBy("focus").agg(F.count_distinct("value").alias("n"))
            counted = nodes.join(good, "focus", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            if s.get("qualifiedMinCount"):
                report(counted.where(F.col("n") < s["qualifiedMinCount"]), "qualifiedMinCount", s)
            if "qualifiedMaxCount" in s:
                report(counted.where(F.col("n") > s["qualifiedMaxCount"]), "qualifiedMaxCount", s)
        for query in s.get("sparql", []):
            # A row of the query is a violation of its ?this; $PATH stands for the shape's predicate.
            from ..plans.compile import Compiler, Options
            from ..sources.catalog import VirtualGraph

            text = re.sub(r"\$this\b", "?this", query).replace("$PATH", f"<{s['path']}>" if isinstance(s.get("path"), str) else "$PATH")
            rows = Compiler(VirtualGraph(spark, [], triples.withColumn("g", F.lit(None).cast("string")).select("g", "s", "p", "o")), Options(typed=False)).query(text)
            found_by = rows.select(F.col("this").alias("_this"), (F.col("value") if "value" in rows.columns else F.lit(None)).cast("string").alias("_value"))
            report(nodes.join(found_by, F.col("focus.lex") == F.col("_this")), "sparql", s, F.col("_value"))
        for key in ("not", "and", "or", "xone"):
            if key in s:
                bad_of = [violations(triples, {**x}, found.select(F.col("value").alias("focus")).distinct()).select(F.col("focus").alias("_bad")).distinct().withColumn("_k", F.lit(i)) for i, x in enumerate(s[key] if isinstance(s[key], list) else [s[key]])]
                joined = bad_of[0]
                for x in bad_of[1:]:
                    joined = joined.union(x)
                failed = found.join(joined, F.col("value.lex") == F.col("_bad"), "left").groupBy("focus", "value").agg(F.count_distinct("_k").alias("n"))
                total = len(bad_of)
                cond = {"not": F.col("n") == 0, "and": F.col("n") > 0, "or": F.col("n") == total, "xone": F.col("n") != total - 1}[key]
                report(failed.where(cond), key, s, F.col("value.lex"))

    own = focus.select("focus", F.col("focus").alias("value"))
    if not shape.get("deactivated"):
        check({k: v for k, v in shape.items() if k not in ("minCount", "maxCount")}, own, focus)
        for p in shape.get("property", []):
            if not p.get("deactivated"):
                check(p, values(triples, focus, p["path"]), focus)
        if shape.get("closed"):
            allowed = [p["path"] for p in shape.get("property", []) if isinstance(p["path"], str)] + list(shape.get("ignoredProperties", []))
            extra = triples.join(focus, triples["s"] == focus["focus"], "left_semi").where(~F.col("p").isin(*allowed) if allowed else F.lit(True)).select(F.col("s").alias("focus"), F.col("o").alias("value"))
            report(extra, "closed", shape, F.col("value.lex"))
    if not parts:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in _REPORT))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def validate(triples: DataFrame, shapes: list[dict[str, Any]], changed: DataFrame | None = None) -> DataFrame:
    """The report of all shapes; with ``changed`` (s) only focus nodes that changed are looked at."""
    out = None
    for s in shapes:
        focus = None
        if changed is not None:
            focus = targets(triples, s).join(changed.select(F.col("s").alias("focus")).distinct(), "focus", "left_semi")
        part = violations(triples, s, focus)
        out = part if out is None else out.unionByName(part)
    return out


def conforms(report: DataFrame) -> bool:
    return report.where("severity = 'Violation'").isEmpty()


def from_triples(rows: list[tuple]) -> list[dict[str, Any]]:
    """Shapes from a (small) shapes graph of quads as the RDF readers give them."""
    graph: dict[str, dict[str, list]] = {}
    for _, s, p, o in rows:
        graph.setdefault(s["lex"], {}).setdefault(p, []).append(o)

    def items(head: str) -> list:
        out = []
        while head != RDF + "nil":
            out += graph[head][RDF + "first"]
            head = graph[head][RDF + "rest"][0]["lex"]
        return out

    def path(o: dict) -> Any:
        node = graph.get(o["lex"], {})
        if o["kind"] == 0:
            return o["lex"]
        if RDF + "first" in node:
            return ("seq", [path(x) for x in items(o["lex"])])
        for key, kind in (("inversePath", "inverse"), ("zeroOrMorePath", "star"), ("oneOrMorePath", "plus"), ("zeroOrOnePath", "opt")):
            if SH + key in node:
                return (kind, path(node[SH + key][0]))
        return ("alt", [path(x) for x in items(node[SH + "alternativePath"][0]["lex"])])

    def shape(name: str) -> dict[str, Any]:
        out: dict[str, Any] = {"name": name}
        for p, os in graph.get(name, {}).items():
            if not p.startswith(SH):
                continue
            key, first = p[len(SH) :], os[0]["lex"]
            if key == "path":
                out[key] = path(os[0])
            elif key == "property":
                out[key] = [shape(o["lex"]) for o in os]
            elif key in ("node", "not", "qualifiedValueShape"):
                out[key] = shape(first)
            elif key in ("and", "or", "xone"):
                out[key] = [shape(o["lex"]) for o in items(first)]
            elif key in ("in", "languageIn", "ignoredProperties"):
                out[key] = [o["lex"] for o in items(first)]
            elif key.startswith("target"):
                out[key] = [o["lex"] for o in os]
            elif key in ("minCount", "maxCount", "minLength", "maxLength", "qualifiedMinCount", "qualifiedMaxCount"):
                out[key] = int(first)
            elif key == "sparql":
                out[key] = [c["lex"] for o in os for c in graph.get(o["lex"], {}).get(SH + "select", [])]
            elif key in ("deactivated", "closed", "uniqueLang"):
                out[key] = first == "true"
            elif key == "severity":
                out[key] = first[len(SH) :]
            else:
                out[key] = first
        return out

    return [shape(s) for s, ps in graph.items() if any(p.startswith(SH + "target") for p in ps)]


def type_nodes(triples: DataFrame, shapes: dict[str, list[dict[str, Any]]], pairs: DataFrame) -> DataFrame:
    """(node, shape) pairs that hold, ShEx's greatest fixpoint.

    ``shapes[name]`` is a list of triple constraints: path, min, max and one of
    datatype, nodeKind or ``shape`` (a reference).  All pairs of nodes and shapes
    are assumed; a round takes away those that the others no longer support.
    """
    from .tables import Rounds

    rounds = Rounds(triples.sparkSession, "shex", keep=10_000)
    triples = rounds.save(triples)
    wanted = pairs
    while True:  # the nodes that references can reach
        more = wanted
        for name, constraints in shapes.items():
            for c in constraints:
                if "shape" in c:
                    nodes = wanted.where(F.col("shape") == name).select(F.col("node").alias("focus"))
                    more = more.union(values(triples, nodes, c["path"]).select(F.col("value").alias("node"), F.lit(c["shape"]).alias("shape")))
        more = rounds.save(more.distinct())
        if more.count() == wanted.count():
            break
        wanted = more
    now = rounds.save(wanted.distinct())
    while True:
        gone = None
        for name, constraints in shapes.items():
            nodes = now.where(F.col("shape") == name).select(F.col("node").alias("focus"))
            for c in constraints:
                found = values(triples, nodes, c["path"])
                for _, bad in _value_tests({k: v for k, v in c.items() if k in ("datatype", "nodeKind", "pattern", "in")}):
                    found = found.where(~bad)
                if "shape" in c:
                    found = found.join(now.where(F.col("shape") == c["shape"]).select(F.col("node").alias("value")), "value", "left_semi")
                counts = nodes.join(found.groupBy("focus").agg(F.count_distinct("value").alias("n")), "focus", "left")
                n = F.coalesce("n", F.lit(0))
                broken = n < c.get("min", 1)
                if c.get("max", 1) is not None:
                    broken = broken | (n > c.get("max", 1))
                part = counts.where(broken).select(F.col("focus").alias("node"), F.lit(name).alias("shape"))
                gone = part if gone is None else gone.union(part)
        nxt = rounds.save(now.join(gone.distinct(), ["node", "shape"], "left_anti"))
        if nxt.count() == now.count():
            return nxt.join(pairs.distinct(), ["node", "shape"], "left_semi")
        now = nxt
