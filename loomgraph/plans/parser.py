"""A recursive-descent parser from query text to the algebra."""

from __future__ import annotations

import re
from typing import Any

from . import algebra as A

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
PREFIXES = {
    "rdf": RDF,
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": XSD,
    "owl": "http://www.w3.org/2002/07/owl#",
    "sh": "http://www.w3.org/ns/shacl#",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "ex": "http://example.org/",
    "fn": "http://www.w3.org/2005/xpath-functions#",
    "math": "http://www.w3.org/2005/xpath-functions/math#",
    "afn": "http://jena.apache.org/ARQ/function#",
    "cdt": "http://w3id.org/awslabs/neptune/SPARQL-CDTs/",
    "geo": "http://www.opengis.net/ont/geosparql#",
    "geof": "http://www.opengis.net/def/function/geosparql/",
    "vec": "urn:loomgraph:vector#",
    "path": "urn:loomgraph:path#",
    "algo": "urn:loomgraph:algo#",
    "text": "urn:loomgraph:text#",
    "list": "http://jena.apache.org/ARQ/list#",
    "apf": "http://jena.apache.org/ARQ/property#",
    "spatial": "http://jena.apache.org/spatial#",
    "wgs": "http://www.w3.org/2003/01/geo/wgs84_pos#",
    "view": "urn:loomgraph:view#",
}

_TOKEN = re.compile(
    r"""
    (?P<skip>\s+|\#[^\n]*)
  | (?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  | (?P<triple><<\(?|\)?>>)
  | (?P<var>[?$]\w+)
  | (?P<str>\"\"\"(?:(?:\"|\"\")?(?:[^\"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<num>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
  | (?P<bnode>_:\w[\w.\-]*)
  | (?P<pname>[A-Za-z][\w\-.]*?:(?:[\w\-%]|\.(?=[\w\-%])|\\.)*|:(?:[\w\-%]|\.(?=\w))+)
  | (?P<word>[A-Za-z_]\w*)
  | (?P<op>\^\^|&&|\|\||!=|<=|>=|:=|[-+*/|^?!=<>(){}\[\];,.:])
    """,
    re.X | re.S,
)
_UNESCAPE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT", "MEDIAN", "MODE", "STDEV", "STDEV_SAMP", "STDEV_POP", "VARIANCE", "VAR_SAMP", "VAR_POP", "FOLD"}


class QuerySyntaxError(ValueError):
    """Text that is no query of this language."""


def unescape(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _UNESCAPE.get(m[1], m[1]), text, flags=re.S)


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.prefixes = PREFIXES | (prefixes or {})
        self.base = ""
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            if not (m := _TOKEN.match(text, at)):
                raise QuerySyntaxError(f"unexpected text: {text[at:at + 30]!r}")
            at = m.end()
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
        self.at = 0
        self.fresh = 0
        self.pending: list[tuple[str, A.Agg]] = []

    # ------------------------------------------------------------ tokens

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def is_word(self, *words: str) -> bool:
        kind, x = self.peek()
        return kind == "word" and x.upper() in words

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += 1
            return True
        return False

    def op(self, x: str) -> bool:
        if self.peek() == ("op", x):
            self.at += 1
            return True
        return False

    def need(self, x: str) -> None:
        if not (self.op(x) if not x.isalpha() else self.word(x)):
            raise QuerySyntaxError(f"{x!r} is missing before {self.peek()[1]!r}")

    def new_var(self) -> A.Var:
        self.fresh += 1
        return A.Var(f".{self.fresh}")

    # ------------------------------------------------------------ terms

    def resolve(self, iri: str) -> str:
        return iri if re.match(r"[A-Za-z][\w+.-]*:", iri) or not self.base else self.base + iri

    def iri(self) -> str:
        kind, x = self.next()
        if kind == "iri":
            return self.resolve(unescape(x[1:-1]))
        if kind == "pname":
            prefix, _, local = x.partition(":")
            if prefix not in self.prefixes:
                raise QuerySyntaxError(f"no prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise QuerySyntaxError(f"an IRI is needed, not {x!r}")

    def literal(self) -> A.Lit | None:
        kind, x = self.peek()
        if kind == "str":
            self.at += 1
            body = unescape(x[3:-3] if x[:3] in ('"""', "'''") else x[1:-1])
            if self.peek()[0] == "lang":
                return A.Lit(body, RDF + "langString", self.next()[1][1:].lower())
            if self.op("^^"):
                return A.Lit(body, self.iri())
            return A.Lit(body)
        sign = ""
        if kind == "op" and x in "+-" and self.peek(1)[0] == "num":
            sign, (kind, x) = ("-" if x == "-" else ""), self.peek(1)
            self.at += 1
        if kind == "num":
            self.at += 1
            return A.Lit(sign + x, XSD + ("double" if "e" in x.lower() else "decimal" if "." in x else "integer"))
        if kind == "word" and x in ("true", "false"):
            self.at += 1
            return A.Lit(x, XSD + "boolean")
        return None

    def term(self) -> Any:
        kind, x = self.peek()
        if kind == "var":
            self.at += 1
            return A.Var(x[1:])
        if kind in ("iri", "pname"):
            return A.Iri(self.iri())
        if kind == "bnode":
            self.at += 1
            return A.Var("." + x[2:])
        if kind == "triple":
            self.at += 1
            s, p, o = self.term(), self.verb(), self.term()
            self.at += 1
            return A.TripleTerm(s, p, o)
        if kind == "op" and x == "[" and self.peek(1) == ("op", "]"):
            self.at += 2
            return self.new_var()
        if (lit := self.literal()) is not None:
            return lit
        raise QuerySyntaxError(f"a term is needed, not {x!r}")

    def verb(self) -> Any:
        if self.peek() == ("word", "a"):
            self.at += 1
            return A.Iri(RDF + "type")
        return self.term()

    # ------------------------------------------------------------ paths

    def path(self) -> Any:
        if self.peek()[0] == "var":
            return A.Var(self.next()[1][1:])
        return self.path_alt()

    def path_alt(self) -> Any:
        parts = [self.path_seq()]
        while self.op("|"):
            parts.append(self.path_seq())
        return parts[0] if len(parts) == 1 else A.Path("alt", tuple(parts))

    def path_seq(self) -> Any:
        parts = [self.path_elt()]
        while self.op("/"):
            parts.append(self.path_elt())
        return parts[0] if len(parts) == 1 else A.Path("seq", tuple(parts))

    def path_elt(self) -> Any:
        if self.op("^"):
            return A.Path("inv", (self.path_elt(),))
        if self.op("!"):
            items = [self.negated()] if not self.op("(") else None
            if items is None:
                items = []
                while not self.op(")"):
                    items.append(self.negated())
                    self.op("|")
            p: Any = A.Path("neg", tuple(items))
        elif self.op("("):
            p = self.path_alt()
            self.need(")")
        elif self.is_word("DISTINCT", "MULTI", "SHORTEST"):
            name = self.next()[1].lower()
            self.need("(")
            p = A.Path(name, (self.path_alt(),))
            self.need(")")
        else:
            p = self.verb()
        while True:
            if self.op("*"):
                p = A.Path("star", (p,))
            elif self.op("+"):
                p = A.Path("plus", (p,))
            elif self.op("?"):
                p = A.Path("opt", (p,))
            elif self.peek() == ("op", "{") and (self.peek(1)[0] == "num" or self.peek(1)[1] in ",*+"):
                self.at += 1
                if self.op("*") or self.op("+"):
                    p = A.Path("star" if self.tokens[self.at - 1][1] == "*" else "plus", (p,))
                else:
                    low = int(self.next()[1]) if self.peek()[0] == "num" else 0
                    high: int | None = low
                    if self.op(","):
                        high = int(self.next()[1]) if self.peek()[0] == "num" else None
                    p = A.Path("range", (p,), low, high)
                self.need("}")
            else:
                return p

    def negated(self) -> Any:
        return A.Path("inv", (self.verb(),)) if self.op("^") else self.verb()

    # ------------------------------------------------------------ triples

    def triples(self, out: list) -> None:
        s = self.node(out)
        if self.peek() in (("op", "."), ("op", "}")):
            return
        self.properties(s, out)

    def properties(self, s: Any, out: list) -> None:
        while True:
            p = self.path()
            while True:
                o = self.node(out)
                out.append((s, p, o))
                if not self.op(","):
                    break
            more = False
            while self.op(";"):
                more = True
            if not more or self.peek()[1] in (".", "}", "]"):
                return

    def node(self, out: list) -> Any:
        if self.op("["):
            v = self.new_var()
            if not self.op("]"):
                self.properties(v, out)
                self.need("]")
            return v
        if self.op("("):
            items = []
            while not self.op(")"):
                items.append(self.node(out))
            head: Any = A.Iri(RDF + "nil")
            for x in reversed(items):
                v = self.new_var()
                out += [(v, A.Iri(RDF + "first"), x), (v, A.Iri(RDF + "rest"), head)]
                head = v
            return head
        return self.term()

    # ------------------------------------------------------------ groups

    def group(self) -> Any:
        self.need("{")
        if self.is_word("SELECT"):
            p = self.select()
            self.need("}")
            return p
        now: Any = None
        filters: list = []

        def join(x: Any) -> None:
            nonlocal now
            now = x if now is None else A.Join(now, x)

        while not self.op("}"):
            if self.word("OPTIONAL"):
                inner = self.group()
                expr = None
                if isinstance(inner, A.Filter):
                    inner, expr = inner.inner, inner.expr
                now = A.LeftJoin(now if now is not None else A.Bgp(), inner, expr)
            elif self.word("MINUS"):
                now = A.Minus(now or A.Bgp(), self.group())
            elif self.word("SEMIJOIN", "ANTIJOIN"):
                anti = self.tokens[self.at - 1][1].upper() == "ANTIJOIN"
                now = A.HalfJoin(now or A.Bgp(), self.group(), anti)
            elif self.word("LATERAL"):
                now = A.Lateral(now or A.Bgp(), self.group())
            elif self.word("FILTER"):
                filters.append(self.constraint())
            elif self.word("BIND"):
                self.need("(")
                e = self.expr()
                self.need("AS")
                now = A.Extend(now or A.Bgp(), self.next()[1][1:], e)
                self.need(")")
            elif self.word("LET"):
                self.need("(")
                v = self.next()[1][1:]
                self.need(":=")
                now = A.Extend(now or A.Bgp(), v, self.expr(), True)
                self.need(")")
            elif self.word("UNFOLD"):
                self.need("(")
                e = self.expr()
                self.need("AS")
                v, second = self.next()[1][1:], None
                if self.op(","):
                    second = self.next()[1][1:]
                self.need(")")
                now = A.Unfold(now or A.Bgp(), e, v, second)
            elif self.word("VALUES"):
                join(self.values())
            elif self.word("GRAPH"):
                join(A.Graph(self.term(), self.group()))
            elif self.word("SERVICE"):
                silent = self.word("SILENT")
                join(A.Service(self.term(), self.group(), silent))
            elif self.peek() == ("op", "{"):
                p = self.group()
                while self.word("UNION"):
                    p = A.Union(p, self.group())
                join(p)
            elif self.op("."):
                pass
            else:
                triples: list = []
                while True:
                    self.triples(triples)
                    if not self.op(".") or self.peek()[1] in ("}", "{") or self.peek()[0] == "word" and self.peek()[1] != "a":
                        break
                if isinstance(now, A.Bgp):
                    now.triples += triples
                elif isinstance(now, A.Join) and isinstance(now.right, A.Bgp):
                    now.right.triples += triples
                else:
                    join(A.Bgp(triples))
        out = now if now is not None else A.Bgp()
        for f in filters:
            out = A.Filter(out, f if not isinstance(out, A.Filter) else f)
        if isinstance(out, A.Filter) and isinstance(out.inner, A.Filter):
            inner, expr = out.inner, out.expr
            while isinstance(inner, A.Filter):
                expr, inner = A.Call("&&", (inner.expr, expr)), inner.inner
            out = A.Filter(inner, expr)
        return out

    def values(self) -> A.Values:
        names = []
        single = self.peek()[0] == "var"
        if single:
            names = [self.next()[1][1:]]
        else:
            self.need("(")
            while not self.op(")"):
                names.append(self.next()[1][1:])
        self.need("{")
        rows = []
        while not self.op("}"):
            if single:
                rows.append([None if self.word("UNDEF") else self.term()])
            else:
                self.need("(")
                row = []
                while not self.op(")"):
                    row.append(None if self.word("UNDEF") else self.term())
                rows.append(row)
        return A.Values(names, rows)

    # ------------------------------------------------------------ expressions

    def constraint(self) -> Any:
        if self.is_word("EXISTS", "NOT"):
            return self.primary()
        if self.op("("):
            e = self.expr()
            self.need(")")
            return e
        return self.primary()

    def expr(self) -> Any:
        e = self.conj()
        while self.op("||"):
            e = A.Call("||", (e, self.conj()))
        return e

    def conj(self) -> Any:
        e = self.rel()
        while self.op("&&"):
            e = A.Call("&&", (e, self.rel()))
        return e

    def rel(self) -> Any:
        e = self.add()
        for op in ("=", "!=", "<=", ">=", "<", ">"):
            if self.op(op):
                return A.Call(op, (e, self.add()))
        if self.word("IN"):
            return A.Call("IN", (e, *self.arguments()))
        if self.is_word("NOT") and self.peek(1)[1].upper() == "IN":
            self.at += 2
            return A.Call("!", (A.Call("IN", (e, *self.arguments())),))
        return e

    def add(self) -> Any:
        e = self.mul()
        while True:
            if self.op("+"):
                e = A.Call("+", (e, self.mul()))
            elif self.op("-"):
                e = A.Call("-", (e, self.mul()))
            else:
                return e

    def mul(self) -> Any:
        e = self.unary()
        while True:
            if self.op("*"):
                e = A.Call("*", (e, self.unary()))
            elif self.op("/"):
                e = A.Call("/", (e, self.unary()))
            else:
                return e

    def unary(self) -> Any:
        if self.op("!"):
            return A.Call("!", (self.unary(),))
        if self.peek()[1] in "+-" and self.peek()[0] == "op" and self.peek(1)[0] != "num":
            op = self.next()[1]
            return A.Call("u" + op, (self.unary(),))
        return self.primary()

    def arguments(self) -> tuple:
        self.need("(")
        out = []
        while not self.op(")"):
            out.append(self.expr())
            self.op(",")
        return tuple(out)

    def primary(self) -> Any:
        kind, x = self.peek()
        if self.op("("):
            e = self.expr()
            self.need(")")
            return e
        if kind == "var":
            self.at += 1
            return A.Var(x[1:])
        if kind == "triple":
            return self.term()
        if (lit := self.literal()) is not None:
            return lit
        if kind in ("iri", "pname"):
            iri = self.iri()
            return A.Call(iri, self.arguments()) if self.peek() == ("op", "(") else A.Iri(iri)
        if kind == "word":
            name = x.upper()
            if name == "NOT":
                self.at += 2
                return A.Exists(self.group(), True)
            if name == "EXISTS":
                self.at += 1
                return A.Exists(self.group())
            self.at += 1
            if name == "AGG":
                iri = self.iri()
                self.need("(")
                distinct = self.word("DISTINCT")
                a = A.Agg(iri, self.expr(), distinct)
                self.need(")")
                return self.hold(a)
            if name in AGGREGATES:
                return self.hold(self.aggregate(name))
            return A.Call(name, self.arguments())
        raise QuerySyntaxError(f"an expression is needed, not {x!r}")

    def aggregate(self, name: str) -> A.Agg:
        self.need("(")
        distinct = self.word("DISTINCT")
        if self.op("*"):
            self.need(")")
            return A.Agg(name, None, distinct)
        arg, value, sep, order = self.expr(), None, " ", []
        if self.op(","):
            value = self.expr()
        while not self.op(")"):
            if self.word("ORDER"):
                self.need("BY")
                order = self.order_keys()
            else:
                self.need(";")
                if self.word("SEPARATOR"):
                    self.need("=")
                    sep = unescape(self.next()[1][1:-1])
        return A.Agg(name, arg, distinct, sep, tuple(order), value)

    def hold(self, agg: A.Agg) -> A.Var:
        """An aggregate's place in an expression."""
        for v, a in self.pending:
            if a == agg:
                return A.Var(v)
        v = f".agg{len(self.pending)}_{self.at}"
        self.pending.append((v, agg))
        return A.Var(v)

    def order_keys(self) -> list:
        keys = []
        while True:
            if self.is_word("ASC", "DESC"):
                up = self.next()[1].upper() == "ASC"
                self.need("(")
                e = self.expr()
                self.need(")")
                keys.append((e, up))
            elif self.peek()[0] == "var" or self.peek() == ("op", "("):
                keys.append((self.primary(), True))
            elif self.peek()[0] in ("iri", "pname") or self.peek()[0] == "word" and self.peek(1) == ("op", "(") and not self.is_word("LIMIT", "OFFSET", "HAVING", "VALUES"):
                keys.append((self.primary(), True))
            else:
                return keys

    # ------------------------------------------------------------ forms

    def select(self) -> Any:
        outer, self.pending = self.pending, []
        self.need("SELECT")
        distinct = self.word("DISTINCT", "REDUCED")
        star = self.op("*")
        items: list[tuple[str, Any]] = []
        while not star and (self.peek()[0] == "var" or self.peek() == ("op", "(")):
            if self.op("("):
                e = self.expr()
                self.need("AS")
                items.append((self.next()[1][1:], e))
                self.need(")")
            else:
                items.append((self.next()[1][1:], None))
        self.dataset()
        self.word("WHERE")
        p = self.modified(self.group(), items, star)
        self.pending = outer
        return A.Distinct(p) if distinct and not isinstance(p, A.Slice) else A.Slice(A.Distinct(p.inner), p.offset, p.limit) if distinct else p

    def modified(self, p: Any, items: list, star: bool) -> Any:
        keys: list = []
        grouped = False
        if self.word("GROUP"):
            self.need("BY")
            grouped = True
            while True:
                if self.peek()[0] == "var":
                    v = self.next()[1][1:]
                    keys.append((v, A.Var(v)))
                elif self.op("("):
                    e, v = self.expr(), None
                    if self.word("AS"):
                        v = self.next()[1][1:]
                    self.need(")")
                    keys.append((v, e))
                elif self.peek()[0] in ("iri", "pname") or self.peek()[0] == "word" and self.peek(1) == ("op", "(") and not self.is_word("HAVING"):
                    keys.append((None, self.primary()))
                else:
                    break
        having = []
        if self.word("HAVING"):
            while self.peek() == ("op", "("):
                having.append(self.constraint())
        order = []
        if self.word("ORDER"):
            self.need("BY")
            order = self.order_keys()
        if grouped or self.pending:
            p = A.Group(p, keys, list(self.pending))
        for h in having:
            p = A.Filter(p, h)
        for v, e in items:
            if e is not None:
                p = A.Extend(p, v, e)
        if order:
            p = A.OrderBy(p, order)
        offset, limit = 0, None
        while self.is_word("LIMIT", "OFFSET"):
            if self.next()[1].upper() == "LIMIT":
                limit = int(self.next()[1])
            else:
                offset = int(self.next()[1])
        if self.word("VALUES"):
            p = A.Join(p, self.values())
        names = [v for v, _ in items] if not star else [v for v in A.variables(p) if not v.startswith(".")]
        p = A.Project(p, names)
        return A.Slice(p, offset, limit) if offset or limit is not None else p

    def dataset(self) -> tuple[list, list]:
        graphs, named = [], []
        while self.word("FROM"):
            (named if self.word("NAMED") else graphs).append(self.iri())
        self.graphs, self.named = graphs, named
        return graphs, named

    def prologue(self) -> None:
        while self.is_word("PREFIX", "BASE"):
            if self.next()[1].upper() == "BASE":
                self.base = self.next()[1][1:-1]
            else:
                name = self.next()[1].rstrip(":")
                self.prefixes[name] = self.resolve(self.next()[1][1:-1])

    def query(self) -> A.Query:
        self.graphs, self.named = [], []
        self.prologue()
        if self.is_word("SELECT"):
            p = self.select()
            out = A.Query("select", p)
        elif self.word("ASK"):
            self.dataset()
            self.word("WHERE")
            out = A.Query("ask", self.modified(self.group(), [], True))
        elif self.word("CONSTRUCT"):
            if self.peek() == ("op", "{"):
                template = self.quads()
                self.dataset()
                self.word("WHERE")
                out = A.Query("construct", self.modified(self.group(), [], True), template)
            else:
                self.dataset()
                self.need("WHERE")
                at = self.at
                template = self.quads()
                self.at = at
                out = A.Query("construct", self.modified(self.group(), [], True), template)
        elif self.word("DESCRIBE"):
            what = []
            while self.peek()[0] in ("var", "iri", "pname"):
                what.append(self.term())
            self.op("*")
            self.dataset()
            where = self.word("WHERE") or self.peek() == ("op", "{")
            out = A.Query("describe", self.modified(self.group(), [], True) if where else A.Bgp(), describe=what)
        else:
            raise QuerySyntaxError(f"no query form: {self.peek()[1]!r}")
        out.graphs, out.named = self.graphs, self.named
        if self.at < len(self.tokens):
            raise QuerySyntaxError(f"unexpected {self.peek()[1]!r}")
        return out

    def quads(self) -> list:
        """(graph or None, s, p, o) of a template or data block."""
        self.need("{")
        out = []
        while not self.op("}"):
            if self.word("GRAPH"):
                g = self.term()
                out += [(g, *t[1:]) for t in self.quads()]
                continue
            if self.op("."):
                continue
            triples: list = []
            self.triples(triples)
            out += [(None, *t) for t in triples]
        return out

    def updates(self) -> list[A.Update]:
        out = []
        while True:
            self.prologue()
            if self.at >= len(self.tokens):
                return out
            out.append(self.update())
            self.op(";")

    def graph_ref(self) -> Any:
        if self.word("DEFAULT"):
            return None
        if self.word("ALL", "NAMED"):
            return self.tokens[self.at - 1][1].upper()
        self.word("GRAPH")
        return self.iri()

    def update(self) -> A.Update:
        if self.word("INSERT"):
            if self.word("DATA"):
                return A.Update("insert_data", insert=self.quads())
            insert = self.quads()
            return self._modify([], insert, None)
        if self.word("DELETE"):
            if self.word("DATA"):
                return A.Update("delete_data", delete=self.quads())
            if self.word("WHERE"):
                at = self.at
                quads = self.quads()
                self.at = at
                return A.Update("modify", delete=quads, pattern=self.group())
            delete = self.quads()
            insert = self.quads() if self.word("INSERT") else []
            return self._modify(delete, insert, None)
        if self.word("WITH"):
            g = self.iri()
            delete = self.quads() if self.word("DELETE") else []
            insert = self.quads() if self.word("INSERT") else []
            return self._modify(delete, insert, g)
        if self.word("LOAD"):
            silent = self.word("SILENT")
            source = self.iri()
            return A.Update("load", source=source, target=self.graph_ref() if self.word("INTO") else None, silent=silent)
        if self.word("CLEAR", "DROP", "CREATE"):
            kind = self.tokens[self.at - 1][1].lower()
            silent = self.word("SILENT")
            return A.Update(kind, target=self.graph_ref(), silent=silent)
        if self.word("ADD", "MOVE", "COPY"):
            kind = self.tokens[self.at - 1][1].lower()
            silent = self.word("SILENT")
            source = self.graph_ref()
            self.need("TO")
            return A.Update(kind, source=source, target=self.graph_ref(), silent=silent)
        raise QuerySyntaxError(f"no update: {self.peek()[1]!r}")

    def _modify(self, delete: list, insert: list, graph: str | None) -> A.Update:
        using = []
        while self.word("USING"):
            self.word("NAMED")
            using.append(self.iri())
        self.need("WHERE")
        pattern = self.group()
        named = graph or (using[0] if using else None)
        if graph:
            delete = [(A.Iri(graph) if g is None else g, *t) for g, *t in delete]
            insert = [(A.Iri(graph) if g is None else g, *t) for g, *t in insert]
        return A.Update("modify", delete, insert, A.Graph(A.Iri(named), pattern) if named else pattern)


def parse(text: str, prefixes: dict[str, str] | None = None) -> A.Query:
    return Parser(text, prefixes).query()


def parse_update(text: str, prefixes: dict[str, str] | None = None) -> list[A.Update]:
    return Parser(text, prefixes).updates()
