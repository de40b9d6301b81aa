"""The query algebra: patterns, expressions and query forms as plain dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

# ---------------------------------------------------------------- terms


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class BNode:
    label: str


@dataclass(frozen=True)
class Lit:
    """A literal; ``value`` is the native Python value where the datatype has one."""

    lex: str
    dt: str = "http://www.w3.org/2001/XMLSchema#string"
    lang: str | None = None


@dataclass(frozen=True)
class TripleTerm:
    s: Any
    p: Any
    o: Any


# ---------------------------------------------------------------- paths


@dataclass(frozen=True)
class Path:
    """op: seq, alt, inv, neg, star, plus, opt, range, distinct, multi, shortest."""

    op: str
    args: tuple
    low: int = 0
    high: int | None = None


# ---------------------------------------------------------------- expressions


@dataclass(frozen=True)
class Call:
    """A function, operator or constructor by upper-case name or IRI."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Exists:
    pattern: Any
    negated: bool = False


@dataclass(frozen=True)
class Agg:
    name: str
    arg: Any = None
    distinct: bool = False
    separator: str = " "
    order: tuple = ()
    value: Any = None


# ---------------------------------------------------------------- patterns


@dataclass
class Bgp:
    triples: list = field(default_factory=list)  # (s, p, o), p may be a Path


@dataclass
class Join:
    left: Any
    right: Any


@dataclass
class LeftJoin:
    left: Any
    right: Any
    expr: Any = None


@dataclass
class Union:
    left: Any
    right: Any


@dataclass
class Minus:
    left: Any
    right: Any


@dataclass
class HalfJoin:
    left: Any
    right: Any
    anti: bool = False


@dataclass
class Lateral:
    left: Any
    right: Any


@dataclass
class Filter:
    inner: Any
    expr: Any


@dataclass
class Extend:
    inner: Any
    var: str
    expr: Any
    assign: bool = False  # LET: joins if already bound


@dataclass
class Unfold:
    inner: Any
    expr: Any
    var: str
    second: str | None = None


@dataclass
class Values:
    vars: list
    rows: list


@dataclass
class Graph:
    name: Any
    inner: Any


@dataclass
class Service:
    name: Any
    inner: Any
    silent: bool = False


@dataclass
class Group:
    inner: Any
    keys: list  # (var or None, expr)
    aggs: list  # (var, Agg)


@dataclass
class OrderBy:
    inner: Any
    keys: list  # (expr, ascending)


@dataclass
class Project:
    inner: Any
    vars: list


@dataclass
class Distinct:
    inner: Any


@dataclass
class Slice:
    inner: Any
    offset: int = 0
    limit: int | None = None


# ---------------------------------------------------------------- forms


@dataclass
class Query:
    form: str  # select, ask, construct, describe
    pattern: Any
    template: list = field(default_factory=list)
    describe: list = field(default_factory=list)
    graphs: list = field(default_factory=list)
    named: list = field(default_factory=list)


@dataclass
class Update:
    """kind: insert_data, delete_data, modify, load, clear, drop, create, add, move, copy."""

    kind: str
    delete: list = field(default_factory=list)
    insert: list = field(default_factory=list)
    pattern: Any = None
    source: Any = None
    target: Any = None
    silent: bool = False


def variables(node: Any) -> list[str]:
    """In-scope variables, in order of appearance."""
    out: dict[str, None] = {}

    def add(x: Any) -> None:
        if isinstance(x, Var) and not x.name.startswith("."):
            out[x.name] = None
        elif isinstance(x, TripleTerm):
            add(x.s), add(x.p), add(x.o)

    def walk(n: Any) -> None:
        if isinstance(n, Bgp):
            for t in n.triples:
                for x in t:
                    add(x)
        elif isinstance(n, Join | LeftJoin | Union | Lateral):
            walk(n.left), walk(n.right)
        elif isinstance(n, Minus | HalfJoin):
            walk(n.left)
        elif isinstance(n, Filter | OrderBy | Distinct | Slice):
            walk(n.inner)
        elif isinstance(n, Extend):
            walk(n.inner)
            out[n.var] = None
        elif isinstance(n, Unfold):
            walk(n.inner)
            out[n.var] = None
            if n.second:
                out[n.second] = None
        elif isinstance(n, Values):
            out.update(dict.fromkeys(n.vars))
        elif isinstance(n, Graph | Service):
            add(n.name)
            walk(n.inner)
        elif isinstance(n, Group):
            out.update(dict.fromkeys([k for k, _ in n.keys if k] + [v for v, _ in n.aggs]))
        elif isinstance(n, Project):
            out.update(dict.fromkeys(n.vars))

    walk(node)
    return list(out)
