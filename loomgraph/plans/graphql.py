"""A read adapter for GraphQL: types are the classes of a virtual graph, fields their predicates.

``query { Customer(first: 10, where: {acctbal: {gt: 100}}, orderBy: {field: acctbal, desc: true}) { id name nation { name } } }``

A request becomes one plan: the root's rows, filters on native columns, and a
left join for each nested reference.  ``after`` continues behind a key.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import TriplesMap, VirtualGraph

_TOKEN = re.compile(r'\s*(?:#[^\n]*\n\s*|,\s*)*("(?:[^"\\]|\\.)*"|-?\d+\.\d+|-?\d+|[A-Za-z_]\w*|[{}()\[\]:!$=])')


class GraphQLError(ValueError):
    """A request that the schema does not allow."""


def _parse(text: str) -> list[dict]:
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise GraphQLError(f"unexpected text: {text[at:at + 20]!r}")
        tokens.append(m[1])
        at = m.end()
    pos = 0

    def take(x: str) -> bool:
        nonlocal pos
        if pos < len(tokens) and tokens[pos] == x:
            pos += 1
            return True
        return False

    def value() -> Any:
        nonlocal pos
        if take("{"):
            out = {}
            while not take("}"):
                name = tokens[pos]
                pos += 1
                take(":")
                out[name] = value()
            return out
        if take("["):
            items = []
            while not take("]"):
                items.append(value())
            return items
        x = tokens[pos]
        pos += 1
        if x[0] == '"':
            return re.sub(r"\\(.)", r"\1", x[1:-1])
        if re.fullmatch(r"-?\d+", x):
            return int(x)
        if re.fullmatch(r"-?\d+\.\d+", x):
            return float(x)
        return {"true": True, "false": False, "null": None}.get(x, x)

    def selection() -> list[dict]:
        nonlocal pos
        out = []
        while not take("}"):
            name = tokens[pos]
            pos += 1
            alias = name
            if take(":"):
                name = tokens[pos]
                pos += 1
            args = {}
            if take("("):
                while not take(")"):
                    key = tokens[pos]
                    pos += 1
                    take(":")
                    args[key] = value()
            out.append({"name": name, "alias": alias, "args": args, "fields": selection() if take("{") else []})
        return out

    if tokens[0] == "query":
        pos = 1
        if tokens[pos] not in "{(":
            pos += 1
    if not take("{"):
        raise GraphQLError("a selection is needed")
    return selection()


def _local(iri: str) -> str:
    return re.split(r"[/#]", iri)[-1]


def _types(graph: VirtualGraph) -> dict[str, TriplesMap]:
    return {_local(m.classes[0]): m for m in graph.maps if m.classes and m.prefix}


def sdl(graph: VirtualGraph) -> str:
    """The schema in the definition language."""
    types = _types(graph)
    kinds = {"bigint": "Int", "int": "Int", "smallint": "Int", "double": "Float", "float": "Float", "boolean": "Boolean"}
    out = []
    for name, m in types.items():
        fields = ["  id: ID!"]
        for o in m.objects:
            target = next((n for n, t in types.items() if o.prefix is not None and t.prefix == o.prefix), None)
            kind = target or ("ID" if o.prefix else kinds.get(m.df().schema[o.column].dataType.simpleString(), "String"))
            fields.append(f"  {_local(o.predicate)}: {kind}")
        out.append(f"type {name} {{\n" + "\n".join(fields) + "\n}")
    roots = "\n".join(f"  {n}(id: ID, first: Int, after: ID, where: {n}Filter, orderBy: {n}Order): [{n}!]!" for n in types)
    return "\n\n".join([*out, f"type Query {{\n{roots}\n}}"])


_OPS = {"eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "in": lambda c, v: c.isin(*v), "notIn": lambda c, v: ~c.isin(*v), "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v}


def _condition(m: TriplesMap, where: dict):
    out = F.lit(True)
    for name, ops in where.items():
        if name in ("and", "or", "not"):
            parts = [_condition(m, w) for w in (ops if isinstance(ops, list) else [ops])]
            both = parts[0]
            for p in parts[1:]:
                both = both & p if name == "and" else both | p
            out = out & (~both if name == "not" else both)
            continue
        o = next((o for o in m.objects if _local(o.predicate) == name), None)
        if o is None and name != "id":
            raise GraphQLError(f"no field {name!r}")
        for op, v in ops.items():
            if op not in _OPS:
                raise GraphQLError(f"no operator {op!r}")
            out = out & _OPS[op](F.col(m.key if o is None else o.column), v)
    return out


def execute(graph: VirtualGraph, text: str) -> dict[str, DataFrame]:
    """A DataFrame for each root field; nested objects are structs."""
    types = _types(graph)

    def rows(m: TriplesMap, df: DataFrame, fields: list[dict]) -> tuple[DataFrame, list]:
        cols = []
        for k, f in enumerate(fields):
            if f["name"] == "id":
                cols.append(F.concat(F.lit(m.prefix), F.col(m.key).cast("string")).alias(f["alias"]))
                continue
            if f["name"] == "__typename":
                cols.append(F.lit(_local(m.classes[0])).alias(f["alias"]))
                continue
            o = next((o for o in m.objects if _local(o.predicate) == f["name"]), None)
            if o is None:
                raise GraphQLError(f"no field {f['name']!r}")
            if not f["fields"]:
                c = F.col(o.column)
                cols.append((F.concat(F.lit(o.prefix), c.cast("string")) if o.prefix else c).alias(f["alias"]))
                continue
            target = next((t for t in types.values() if t.prefix == o.prefix), None)
            if target is None:
                raise GraphQLError(f"{f['name']!r} has no fields")
            inner, inner_cols = rows(target, target.df(), f["fields"])
            inner = inner.select(F.col(target.key).alias(f"_k{k}_{o.column}"), F.struct(*inner_cols).alias(f"_n{k}_{o.column}"))
            df = df.join(inner, df[o.column] == inner[f"_k{k}_{o.column}"], "left")
            cols.append(F.col(f"_n{k}_{o.column}").alias(f["alias"]))
        return df, cols

    out = {}
    for root in _parse(text):
        if root["name"] not in types:
            raise GraphQLError(f"no type {root['name']!r}")
        m, args = types[root["name"]], root["args"]
        df = m.df()
        if "where" in args:
            df = df.where(_condition(m, args["where"]))
        if "id" in args:
            df = df.where(F.col(m.key) == F.lit(str(args["id"]).removeprefix(m.prefix)).try_cast(df.schema[m.key].dataType))
        order = args.get("orderBy")
        if order:
            o = next(o for o in m.objects if _local(o.predicate) == order["field"])
            keys = [F.desc(o.column) if order.get("desc") else F.asc(o.column), F.asc(m.key)]
        else:
            keys = [F.asc(m.key)]
            if "after" in args:
                df = df.where(F.col(m.key) > F.lit(str(args["after"]).removeprefix(m.prefix)).try_cast(df.schema[m.key].dataType))
        if "first" in args:
            df = df.orderBy(*keys).limit(args["first"])
        df, cols = rows(m, df, root["fields"])
        out[root["alias"]] = df.select(*cols)
    return out
