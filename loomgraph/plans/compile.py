"""Compile the algebra to DataFrames.

Patterns over the same subject and table become one scan.  Variables keep the
lanes that the mapping gives them, so joins run on native key columns, filters
reach the Parquet readers, and only variables whose kind differs by row are term
structs.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import builtins as B
from ..functions.builtins import Val
from ..sources.catalog import TYPE, Named, Scope, TriplesMap, VirtualGraph, within
from . import algebra as A
from . import lanes as L
from .lanes import BOOLEAN, DECIMAL, DOUBLE, DYN, INTEGER, STRING, XSD, Lane
from .parser import parse


class CompileError(ValueError):
    """A query that this compiler cannot express."""


def col_of(var: str) -> str:
    return "v_" + var.replace(".", "__")


@dataclass
class Solution:
    """Rows with one column a variable (``col_of``); null is unbound."""

    df: DataFrame
    lanes: dict[str, Lane]

    def val(self, var: str) -> Val:
        if var not in self.lanes:
            return Val(F.lit(None).cast("string"), STRING)
        return Val(F.col(col_of(var)), self.lanes[var])


@dataclass
class Options:
    """Switches; every one keeps the answers."""

    merge_stars: bool = True
    factor_counts: bool = True
    typed: bool = True  # False: all variables are term structs
    aggregate_errors: str = "spec"  # how aggregates read errors: "spec", "own" or "skip"
    inferred: bool = False


AGGREGATE_IRIS: dict[str, Any] = {}


def register_aggregate(iri: str, f: Any, lane: Lane) -> None:
    """An application's aggregate: ``f`` takes a column and gives an aggregate column."""
    AGGREGATE_IRIS[iri] = (f, lane)


class Compiler:
    def __init__(self, graph: VirtualGraph, options: Options | None = None, services: dict[str, Any] | None = None):
        self.graph = graph
        self.spark: SparkSession = graph.spark
        self.options = options or Options()
        self.services = services or {}
        self.active: Scope = None
        self.named: tuple[str, ...] | None = None  # FROM NAMED; None: all named graphs
        self.serial = 0

    # ------------------------------------------------------------ entry

    def query(self, text: str, bindings: dict[str, Any] | None = None) -> DataFrame:
        """Rows of a SELECT; the triples of CONSTRUCT and DESCRIBE; one boolean for ASK."""
        q = parse(text)
        pattern = self._bind(q.pattern, bindings) if bindings else q.pattern
        if q.graphs or q.named:
            # A dataset of its own: without FROM the default graph is empty, without FROM NAMED there are no named ones.
            self.active, self.named = q.graphs[0] if len(q.graphs) == 1 else tuple(q.graphs), tuple(q.named)
        if q.form == "select":
            return self.rows(self.compile(pattern))
        if q.form == "ask":
            return self.compile(pattern).df.limit(1).agg((F.count("*") > 0).alias("answer"))
        if q.form == "construct":
            return self.construct(q.template, pattern)
        return self.describe(q.describe, pattern)

    def _bind(self, p: Any, bindings: dict[str, Any]) -> Any:
        names = list(bindings)
        terms = [x if isinstance(x, A.Iri | A.Lit) else A.Lit(str(x).lower() if isinstance(x, bool) else str(x), XSD + {bool: "boolean", int: "integer", float: "double"}.get(type(x), "string")) for x in bindings.values()]

        def walk(n: Any) -> Any:
            if isinstance(n, A.Bgp | A.Join | A.LeftJoin | A.Union | A.Graph):
                return A.Join(A.Values(names, [terms]), n)
            if hasattr(n, "inner"):
                return replace(n, inner=walk(n.inner))
            return A.Join(A.Values(names, [terms]), n)

        return walk(p)

    def rows(self, s: Solution) -> DataFrame:
        """One plain column a variable: IRIs whole, literals native."""
        out = []
        for v, lane in s.lanes.items():
            c = F.col(col_of(v))
            if lane.kind in ("iri", "bnode"):
                c = L.lexical(c, lane)
            elif lane.kind in ("dyn", "lang"):
                c = c["lex"]
            elif lane.dt == XSD + "decimal":
                c = c.cast("decimal(38,18)")
            out.append(c.alias(v))
        return s.df.select(*out)

    # ------------------------------------------------------------ patterns

    def compile(self, n: Any) -> Solution:
        name = "_" + type(n).__name__.lower()
        if not hasattr(self, name):
            raise CompileError(f"no plan for {type(n).__name__}")
        return getattr(self, name)(n)

    def unit(self) -> Solution:
        return Solution(self.spark.range(1).select(), {})

    def _bgp(self, n: A.Bgp) -> Solution:
        if not n.triples:
            return self.unit()
        from ..operators import properties

        triples, calls = properties.split(n.triples)
        if calls:
            return properties.apply(self, self._bgp(A.Bgp(triples)) if triples else None, calls)
        simple, others = [], []
        for s, p, o in n.triples:
            if isinstance(p, A.Path) and p.op == "seq":
                mids = [s, *[self._fresh() for _ in p.args[1:]], o]
                for a, part, b in zip(mids, p.args, mids[1:]):
                    (others if isinstance(part, A.Path) and part.op != "inv" or isinstance(part, A.Var) else simple).append((b, part.args[0], a) if isinstance(part, A.Path) and part.op == "inv" and isinstance(part.args[0], A.Iri) else (a, part, b))
            elif isinstance(p, A.Path) and p.op == "inv" and isinstance(p.args[0], A.Iri):
                simple.append((o, p.args[0], s))
            elif isinstance(p, A.Iri):
                simple.append((s, p, o))
            else:
                others.append((s, p, o))
        parts = self._stars(simple) + [self._special(t, self._prefixes(t[0], simple)) for t in others]
        return self._connect(parts)

    def _prefixes(self, s: Any, simple: list) -> set | None:
        """The subject prefixes that patterns with known predicates leave to a subject; None if there are none."""
        if isinstance(s, A.Iri):
            return {m.prefix for m in self._maps() if m.prefix and s.value.startswith(m.prefix)}
        found: set | None = None
        for a, p, o in simple:
            if a == s:
                here = {m.prefix for m in self._maps() if self._offers(m, p.value, o)}
                found = here if found is None else found & here
        return None if found is None or None in found else found

    def _connect(self, parts: list[Solution]) -> Solution:
        """Join in an order in which each part shares variables with what is there already."""
        now, rest = parts[0], parts[1:]
        while rest:
            i = next((i for i, p in enumerate(rest) if set(p.lanes) & set(now.lanes)), 0)
            now = self.join(now, rest.pop(i))
        return now

    def _fresh(self) -> A.Var:
        self.serial += 1
        return A.Var(f".p{self.serial}")

    def _maps(self) -> list[TriplesMap]:
        return [m for m in self.graph.maps if within(m.graph, self.active)]

    def _stars(self, triples: list) -> list[Solution]:
        """One solution a subject, by the tables whose predicates can be there."""
        if not triples:
            return []
        if not self.options.typed or self.graph.quads is not None or isinstance(self.active, tuple | Named):
            return [self._scan(t) for t in triples]
        groups: dict[Any, list] = {}
        for k, (s, p, o) in enumerate(triples):
            groups.setdefault(s if self.options.merge_stars or not isinstance(s, A.Var) else (s, k), []).append((s, p, o))
        maps = self._maps()
        # Which subject prefixes can each variable have?  Start from predicates, narrow by references.
        possible: dict[Any, set] = {}

        def narrow(term: Any, found: set) -> bool:
            if isinstance(term, A.Iri):
                return False
            before = possible.get(term)
            now = found if before is None else before & found
            possible[term] = now
            return now != before

        def prefix_of(m: TriplesMap) -> str:
            return m.prefix if m.prefix is not None else f"_:{m.name}"

        changed = True
        while changed:
            changed = False
            for s, p, o in triples:
                fits = [m for m in maps if self._offers(m, p.value, o)]
                if isinstance(s, A.Iri):
                    fits = [m for m in fits if m.prefix is not None and s.value.startswith(m.prefix)]
                elif s in possible:
                    fits = [m for m in fits if prefix_of(m) in possible[s]]
                changed |= narrow(s, {prefix_of(m) for m in fits})
                if isinstance(o, A.Var) and p.value != TYPE:
                    refs = {x.prefix for m in fits for x in m.objects if x.predicate == p.value}
                    if None not in refs:
                        changed |= narrow(o, refs)
        out = []
        for group in groups.values():
            subject = group[0][0]
            prefixes = {subject.value.rsplit("/", 1)[0] + "/"} if isinstance(subject, A.Iri) else possible[subject]
            options = []
            for prefix in sorted(prefixes):
                mine = [m for m in maps if prefix_of(m) == prefix]
                held: dict[str, list] = {}
                for t in group:
                    m = next((m for m in mine if self._offers(m, t[1].value, t[2])), None)
                    if m is None:
                        break
                    held.setdefault(m.name, []).append(t)
                else:
                    tables = [self._table(next(m for m in mine if m.name == name), ts) for name, ts in held.items()]
                    options.append(self._connect(tables))
            if not options:
                options = [self._nothing(group)]
            now = options[0]
            for other in options[1:]:
                now = self.union(now, other)
            out.append(now)
        return out

    def _offers(self, m: TriplesMap, predicate: str, o: Any) -> bool:
        if predicate == TYPE:
            return bool(m.classes) and (isinstance(o, A.Var) or isinstance(o, A.Iri) and o.value in m.classes)
        return any(x.predicate == predicate for x in m.objects)

    def _nothing(self, triples: list) -> Solution:
        names = dict.fromkeys(x.name for t in triples for x in t if isinstance(x, A.Var))
        df = self.spark.range(0).select(*[F.lit(None).cast("string").alias(col_of(v)) for v in names])
        return Solution(df, {v: Lane("iri") for v in names})

    def _table(self, m: TriplesMap, triples: list) -> Solution:
        """One scan: a row is a solution of all these patterns."""
        df = m.df()
        subject = triples[0][0]
        conds: list[Column] = []
        cols: dict[str, tuple[Column, Lane]] = {}
        if isinstance(subject, A.Var):
            c, lane = m.subject()
            used = m.prefix is not None or not subject.name.startswith(".")
            if used:
                cols[subject.name] = (c, lane)
            if m.prefix is not None:
                conds.append(c.isNotNull())
        else:
            conds.append(F.col(m.key) == F.lit(subject.value[len(m.prefix) :]).try_cast(df.schema[m.key].dataType))
        for _, p, o in triples:
            if p.value == TYPE:
                if isinstance(o, A.Var):
                    classes = F.explode(F.array(*[F.lit(c) for c in m.classes])) if len(m.classes) > 1 else F.lit(m.classes[0])
                    cols[o.name] = (classes, Lane("iri"))
                continue
            x = next(x for x in m.objects if x.predicate == p.value)
            c, lane = m.object(x)
            if isinstance(o, A.Var):
                conds.append(c.isNotNull())
                if o.name in cols:
                    conds.append(self._same(Val(*cols[o.name]), Val(c, lane)))
                else:
                    cols[o.name] = (c, lane)
            else:
                conds.append(self._constant(Val(c, lane), o, df.schema[x.column].dataType))
        for c in conds:
            df = df.where(c)
        return Solution(df.select(*[c.alias(col_of(v)) for v, (c, _) in cols.items()]), {v: lane for v, (_, lane) in cols.items()})

    def _constant(self, v: Val, term: Any, kind: Any) -> Column:
        if isinstance(term, A.Iri):
            if v.lane.kind != "iri" or not term.value.startswith(v.lane.prefix):
                return F.lit(False)
            return v.col == F.lit(term.value[len(v.lane.prefix) :]).try_cast(kind)
        k = B.literal(term.lex, term.dt, term.lang)
        if v.family == "num" and k.family == "num":
            return v.col == k.col
        return F.coalesce(B.compare("=", v, k), F.lit(False))

    def _scan(self, t: tuple, prefixes: set | None = None) -> Solution:
        """A pattern over term structs; subjects of one known prefix stay native keys."""
        s, p, o = t
        predicate = p.value if isinstance(p, A.Iri) else None
        native = prefixes is not None and len(prefixes) == 1 and self.options.typed and self.graph.quads is None and isinstance(s, A.Var)
        df = self.graph.triples([predicate] if predicate else None, self.active, prefixes if self.graph.quads is None else None, native)
        if df is None:
            return self._nothing([t, (A.Var(self.active.var),)] if isinstance(self.active, Named) else [t])
        here = [(A.Var(self.active.var), F.col("g"), Lane("iri"))] if isinstance(self.active, Named) else []
        cols: dict[str, tuple[Column, Lane]] = {}
        for term, c, lane in (*here, (s, F.col("s"), Lane("iri", prefix=next(iter(prefixes))) if native else DYN), (p, F.col("p"), Lane("iri")), (o, F.col("o"), DYN)):
            if isinstance(term, A.Var):
                if term.name in cols:
                    df = df.where(self._same(Val(*cols[term.name]), Val(c, lane)))
                else:
                    cols[term.name] = (c, lane)
            elif isinstance(term, A.Iri):
                df = df.where((c == term.value) if lane.kind == "iri" else (c["kind"] == 0) & (c["lex"] == term.value))
            elif isinstance(term, A.Lit):
                k = B.literal(term.lex, term.dt, term.lang)
                df = df.where(B.compare("=", Val(c, lane), k) if k.family == "num" else c.eqNullSafe(L.to_dyn(k.col, k.lane)))
        return Solution(df.select(*[c.alias(col_of(v)) for v, (c, _) in cols.items()]), {v: lane for v, (_, lane) in cols.items()})

    def _special(self, t: tuple, prefixes: set | None = None) -> Solution:
        s, p, o = t
        if isinstance(p, A.Var):
            return self._scan(t, prefixes)
        from ..operators.paths import path_solution

        return path_solution(self, s, p, o, prefixes)

    # ------------------------------------------------------------ joins

    def _keys(self, a: Val, b: Val) -> tuple[Column, Column] | None:
        """Two columns that are equal where both hold the same term; None if they never do."""
        if a.lane.kind == "iri" and b.lane.kind == "iri":
            if a.lane.prefix == b.lane.prefix:
                return a.col, b.col
            if a.lane.prefix and b.lane.prefix and not a.lane.prefix.startswith(b.lane.prefix) and not b.lane.prefix.startswith(a.lane.prefix):
                return None
            return B.string(a), B.string(b)
        if a.lane.kind == b.lane.kind == "bnode":
            return a.col, b.col
        if a.lane.kind == b.lane.kind == "lit":
            if a.family == b.family == "num":
                if a.lane.dt == b.lane.dt or a.lane.dt in L.INTEGERS and b.lane.dt in L.INTEGERS:
                    return a.col, b.col
                return a.col.cast("double"), b.col.cast("double")
            return (a.col, b.col) if a.lane.dt == b.lane.dt else None
        return L.to_dyn(a.col, a.lane), L.to_dyn(b.col, b.lane)

    def _same(self, a: Val, b: Val) -> Column:
        """Whether two columns hold the same term."""
        keys = self._keys(a, b)
        return F.lit(False) if keys is None else keys[0] == keys[1]

    def _loose(self, left: Solution, right: Solution, shared: list[str]) -> list[str]:
        """Shared variables that may be unbound, and so go with anything."""
        return [v for v in shared if left.lanes[v].nullable or right.lanes[v].nullable]

    def _spread(self, left: Solution, right: Solution, loose: list[str]) -> tuple[DataFrame, DataFrame, list[Column]]:
        """Both sides with rows for the keys by which they can meet, so that compatible rows meet once, by equality.

        For each variable a bound row on the left looks for its own term and for
        rows without one, an unbound row for any; a row on the right can be found
        as its own term (or as one without) and, if the left has unbound rows, as any.
        """
        l, r, on = left.df, right.df, []
        for i, v in enumerate(loose):
            a, b = Val(F.col(col_of(v)), left.lanes[v]), Val(F.col("r_" + col_of(v)), right.lanes[v])
            keys = self._keys(a, b) or (F.lit("left"), F.lit("right"))
            own, none, every = 0, 1, 2
            spot = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
            nothing = [F.when(F.lit(False), k) for k in keys]
            mine = F.array(spot(own, keys[0]), spot(none, nothing[0])) if right.lanes[v].nullable else F.array(spot(own, keys[0]))
            l = l.withColumn(f"l__{i}", F.explode(F.when(a.col.isNull(), F.array(spot(every, nothing[0]))).otherwise(mine)))
            theirs = F.when(b.col.isNull(), spot(none, nothing[1])).otherwise(spot(own, keys[1]))
            r = r.withColumn(f"r__{i}", F.explode(F.array(theirs, spot(every, nothing[1]))) if left.lanes[v].nullable else theirs)
            on += [F.col(f"l__{i}.kind") == F.col(f"r__{i}.kind"), F.col(f"l__{i}.key").eqNullSafe(F.col(f"r__{i}.key"))]
        return l, r, on

    def _equal(self, left: Solution, right: Solution, shared: list[str]) -> list[Column]:
        return [self._same(Val(F.col(col_of(v)), left.lanes[v]), Val(F.col("r_" + col_of(v)), right.lanes[v])) for v in shared]

    def join(self, left: Solution, right: Solution, how: str = "inner", extra: Any = None) -> Solution:
        shared = [v for v in left.lanes if v in right.lanes]
        renamed = right.df.select(*[F.col(col_of(v)).alias(("r_" if v in left.lanes else "") + col_of(v)) for v in right.lanes]) if right.lanes else right.df
        loose = self._loose(left, right, shared)
        conds = self._equal(left, right, [v for v in shared if v not in loose])
        start = left.df
        if loose:
            if how == "left":
                start = start.withColumn("l__row", F.monotonically_increasing_id())
            start, renamed, more = self._spread(Solution(start, left.lanes), Solution(renamed, right.lanes), loose)
            conds += more
        lanes = dict(left.lanes)
        for v, lane in right.lanes.items():
            if v not in lanes:
                lanes[v] = lane.null(how == "left")
        if extra is not None:
            both = Solution(None, {**left.lanes, **right.lanes})  # type: ignore[arg-type]
            # Each conjunct as it is, so that equalities are seen as keys; what is an error does not hold.
            conds += [B.boolean(self.expr(e, both)) for e in _conjuncts(extra)]
        if not left.lanes and how == "inner":
            return Solution(right.df if not right.lanes else left.df.crossJoin(renamed), lanes) if right.lanes else left
        if loose and how == "left":
            renamed = renamed.withColumn("r__met", F.lit(True))
        if conds:
            on = conds[0]
            for c in conds[1:]:
                on = on & c
            df = start.join(renamed, on, how)
        else:
            df = left.df.crossJoin(renamed) if how == "inner" else left.df.join(renamed, F.lit(True), how)
        if loose and how == "left":
            # Of a row that met nothing one of its keys is left, of others only what met.
            by = Window.partitionBy("l__row")
            met = F.max(F.col("r__met").isNotNull()).over(by)
            df = df.withColumn("l__met", met).withColumn("l__first", F.row_number().over(by.orderBy(F.col("r__met").asc_nulls_last())))
            df = df.where(F.col("r__met").isNotNull() | (~F.col("l__met") & (F.col("l__first") == 1)))
        out = []
        for v, lane in lanes.items():
            c = F.col(col_of(v))
            if v in shared and left.lanes[v].nullable:
                if left.lanes[v].kind == right.lanes[v].kind and left.lanes[v].prefix == right.lanes[v].prefix:
                    c = F.coalesce(c, F.col("r_" + col_of(v)))
                    lanes[v] = replace(left.lanes[v], nullable=right.lanes[v].nullable or how == "left")
                else:
                    c = F.coalesce(L.to_dyn(c, left.lanes[v]), L.to_dyn(F.col("r_" + col_of(v)), right.lanes[v]))
                    lanes[v] = replace(DYN, nullable=right.lanes[v].nullable or how == "left")
            out.append(c.alias(col_of(v)))
        return Solution(df.select(*out), lanes)

    def half(self, left: Solution, right: Solution, anti: bool, extra: list | None = None, need_shared: bool = False) -> Solution:
        shared = [v for v in left.lanes if v in right.lanes]
        if need_shared and not shared:  # MINUS removes only where some variable is bound on both sides
            return left
        right, extra = self._furthest(left, right, shared, extra or [])
        loose = self._loose(left, right, shared)
        keep = {v: lane for v, lane in right.lanes.items() if v in shared or extra}
        renamed = right.df.select(*[F.col(col_of(v)).alias(("r_" if v in left.lanes else "") + col_of(v)) for v in keep]) if keep else right.df
        conds = self._equal(left, right, [v for v in shared if v not in loose])
        for e in extra:
            conds += [B.boolean(self.expr(x, Solution(None, {**right.lanes, **left.lanes}))) for x in _conjuncts(e)]  # type: ignore[arg-type]
        how = "left_anti" if anti else "left_semi"

        def joined(df: DataFrame, other: DataFrame, conds: list[Column], how: str) -> DataFrame:
            on = F.lit(True)
            for i, c in enumerate(conds):
                on = on & c if i else c
            return df.join(other, on, how)

        if not loose:
            return Solution(joined(left.df, renamed, conds, how), left.lanes)
        bound = need_shared and len(loose) == len(shared)
        if anti:
            # No row that is compatible in any of the ways: all equal, or some unbound on a side.
            df = left.df
            for ways in itertools.product(*[["equal", *(["right"] if right.lanes[v].nullable else []), *(["left"] if left.lanes[v].nullable else [])] for v in loose]):
                if bound and "equal" not in ways:
                    continue
                now = list(conds)
                for v, way in zip(loose, ways):
                    mine, theirs = F.col(col_of(v)), F.col("r_" + col_of(v))
                    now.append(self._equal(left, right, [v])[0] if way == "equal" else theirs.isNull() if way == "right" else mine.isNull())
                df = joined(df, renamed, now, how)
            return Solution(df, left.lanes)
        start, other, more = self._spread(Solution(left.df.withColumn("l__row", F.monotonically_increasing_id()), left.lanes), Solution(renamed, right.lanes), loose)
        return Solution(joined(start, other, conds + more, how).dropDuplicates(["l__row"]).select(*[col_of(v) for v in left.lanes]), left.lanes)

    def _furthest(self, left: Solution, right: Solution, shared: list[str], extra: list) -> tuple[Solution, list]:
        """Whether a row has a match beyond it (one comparison by <, <=, > or >=) is known from the largest or smallest value of each key."""
        e = extra[0] if len(extra) == 1 else None
        if not isinstance(e, A.Call) or e.name not in ("<", "<=", ">", ">="):
            return right, extra
        inside = [not _free(x) & set(left.lanes) and bool(_free(x) & set(right.lanes)) for x in e.args]
        outside = [not (_free(x) & set(right.lanes)) - set(left.lanes) for x in e.args]
        for mine, other in ((0, 1), (1, 0)):
            if inside[mine] and outside[other]:
                value, bound = self.expr(e.args[mine], right), self.expr(e.args[other], left)
                if value.family != bound.family or value.family not in ("num", "str"):
                    break
                most = F.max if (e.name[0] == ">") == (mine == 0) else F.min
                self.serial += 1
                name = f".m{self.serial}"
                keys = [col_of(v) for v in shared]
                found = most(value.col).alias(col_of(name))
                df = right.df.groupBy(*keys).agg(found) if keys else F.broadcast(right.df.agg(found))
                args = (A.Var(name), e.args[1]) if mine == 0 else (e.args[0], A.Var(name))
                return Solution(df, {**{v: right.lanes[v] for v in shared}, name: value.lane.null()}), [A.Call(e.name, args)]
        return right, extra

    def union(self, a: Solution, b: Solution) -> Solution:
        lanes: dict[str, Lane] = {}
        ca, cb = [], []
        for v in [*a.lanes, *[v for v in b.lanes if v not in a.lanes]]:
            la, lb = a.lanes.get(v), b.lanes.get(v)
            x, y = F.col(col_of(v)), F.col(col_of(v))
            if la is None or lb is None:
                lane = (la or lb).null()  # type: ignore[union-attr]
                kind = (a if la else b).df.schema[col_of(v)].dataType
                if la is None:
                    x = F.lit(None).cast(kind)
                else:
                    y = F.lit(None).cast(kind)
            elif (la.kind, la.prefix, la.dt if la.kind == "lit" else "") == (lb.kind, lb.prefix, lb.dt if lb.kind == "lit" else ""):
                lane = la.null(lb.nullable)
            elif la.kind == lb.kind == "iri":
                lane = Lane("iri", nullable=la.nullable or lb.nullable)
                x, y = L.lexical(x, la), L.lexical(y, lb)
            else:
                lane = replace(DYN, nullable=la.nullable or lb.nullable)
                x, y = L.to_dyn(x, la), L.to_dyn(y, lb)
            lanes[v] = lane
            ca.append(x.alias(col_of(v)))
            cb.append(y.alias(col_of(v)))
        return Solution(a.df.select(*ca).unionByName(b.df.select(*cb)), lanes)

    def _join(self, n: A.Join) -> Solution:
        left = self.compile(n.left)
        if isinstance(n.right, A.Service) or isinstance(n.right, A.Graph):
            return self.join(left, self.compile(n.right))
        return self.join(left, self.compile(n.right))

    def _leftjoin(self, n: A.LeftJoin) -> Solution:
        return self.join(self.compile(n.left), self.compile(n.right), "left", n.expr)

    def _union(self, n: A.Union) -> Solution:
        return self.union(self.compile(n.left), self.compile(n.right))

    def _minus(self, n: A.Minus) -> Solution:
        return self.half(self.compile(n.left), self.compile(n.right), True, need_shared=True)

    def _halfjoin(self, n: A.HalfJoin) -> Solution:
        return self.half(self.compile(n.left), self.compile(n.right), n.anti)

    def _lateral(self, n: A.Lateral) -> Solution:
        """Per left row: with a limit inside, the first k of each correlation key by a window."""
        left = self.compile(n.left)
        inner, offset, limit = n.right, 0, None
        if isinstance(inner, A.Slice):
            inner, offset, limit = inner.inner, inner.offset, inner.limit
        if limit is None and not offset:
            return self.join(left, self.compile(inner))
        names = None
        if isinstance(inner, A.Project):
            names, inner = inner.vars, inner.inner
        keys: list = []
        if isinstance(inner, A.OrderBy):
            keys, inner = inner.keys, inner.inner
        right = self.compile(inner)
        by = [F.col(col_of(v)) for v in right.lanes if v in left.lanes]
        sort = [c for e, up in keys for c in self._sort(self.expr(e, right), up)] or [F.lit(0)]
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*sort))
        df = right.df.withColumn("__k", rank).where((F.col("__k") > offset) & (F.col("__k") <= offset + (limit if limit is not None else 1 << 30))).drop("__k")
        keep = {v: lane for v, lane in right.lanes.items() if names is None or v in names or v in left.lanes}
        return self.join(left, Solution(df.select(*[col_of(v) for v in keep]), keep))

    # ------------------------------------------------------------ filters

    def _filter(self, n: A.Filter) -> Solution:
        s = self.compile(n.inner)
        for e in _conjuncts(n.expr):
            s = self._one_filter(s, e)
        return s

    def _one_filter(self, s: Solution, e: Any) -> Solution:
        negated = False
        while isinstance(e, A.Call) and e.name == "!" and isinstance(e.args[0], A.Exists):
            e, negated = e.args[0], not negated
        if isinstance(e, A.Exists):
            return self._exists(s, e.pattern, e.negated != negated)
        s, e = self._lift(s, e)
        return Solution(s.df.where(B.boolean(self.expr(e, s))).select(*[col_of(v) for v in s.lanes if not v.startswith(".ex")]), {v: x for v, x in s.lanes.items() if not v.startswith(".ex")})

    def _exists(self, s: Solution, pattern: Any, anti: bool) -> Solution:
        """Decorrelated: filters inside that read outer variables move to the join's condition."""
        p, outer = self._decorrelated(pattern)
        return self.half(s, self.compile(p), anti, outer)

    def _decorrelated(self, p: Any) -> tuple[Any, list]:
        """The pattern without the filters that read variables from outside, and these."""
        outer: list = []
        while isinstance(p, A.Filter):
            inside = set(A.variables(p.inner))
            kept = None
            for e in _conjuncts(p.expr):
                if _free(e) - inside:
                    outer.append(e)
                else:
                    kept = e if kept is None else A.Call("&&", (kept, e))
            if kept is not None:
                p = A.Filter(p.inner, kept)
                break
            p = p.inner
        return p, outer

    def _lift(self, s: Solution, e: Any) -> tuple[Solution, Any]:
        """EXISTS inside an expression becomes a marker: which of the distinct outer values that it reads have a match."""
        if isinstance(e, A.Exists):
            self.serial += 1
            mark = f".ex{self.serial}"
            p, outer = self._decorrelated(e.pattern)
            right = self.compile(p)
            read = [v for v in s.lanes if v in right.lanes or any(v in _free(x) for x in outer)]
            keys = Solution(s.df.select(*[col_of(v) for v in read]).distinct() if read else self.spark.range(1).select(), {v: s.lanes[v] for v in read})
            found = self.half(keys, right, False, outer).df.select(*[F.col(col_of(v)).alias("x_" + col_of(v)) for v in read], F.lit(True).alias(col_of(mark)))
            on = F.lit(True)
            for i, v in enumerate(read):
                c = F.col(col_of(v)).eqNullSafe(F.col("x_" + col_of(v)))
                on = on & c if i else c
            df = s.df.join(found, on, "left").withColumn(col_of(mark), F.coalesce(F.col(col_of(mark)), F.lit(False)))
            var = A.Var(mark)
            return Solution(df.select(*[col_of(v) for v in s.lanes], col_of(mark)), {**s.lanes, mark: BOOLEAN}), A.Call("!", (var,)) if e.negated else var
        if isinstance(e, A.Call):
            args = []
            for a in e.args:
                s, a = self._lift(s, a)
                args.append(a)
            return s, A.Call(e.name, tuple(args))
        return s, e

    # ------------------------------------------------------------ assignment

    def _extend(self, n: A.Extend) -> Solution:
        s = self.compile(n.inner)
        s, e = self._lift(s, n.expr)
        v = B.zoned(self.expr(e, s))
        if n.assign and n.var in s.lanes:
            return Solution(s.df.where(F.coalesce(self._same(s.val(n.var), v), F.lit(False))), s.lanes)
        lanes = {k: x for k, x in s.lanes.items() if not k.startswith(".ex")}
        return Solution(s.df.withColumn(col_of(n.var), v.col).select(*[col_of(k) for k in [*[x for x in lanes if x != n.var], n.var]]), {**{k: x for k, x in lanes.items() if k != n.var}, n.var: v.lane.null()})

    def _unfold(self, n: A.Unfold) -> Solution:
        s = self.compile(n.inner)
        v = self.expr(n.expr, s)
        keep = [col_of(k) for k in s.lanes]
        if v.family == "map":
            kl, vl = v.lane.elem
            df = s.df.select(*keep, F.explode(v.col).alias(col_of(n.var), col_of(n.second or ".u")))
            lanes = {**s.lanes, n.var: kl}
            if n.second:
                lanes[n.second] = vl.null()
        else:
            df = s.df.select(*keep, F.posexplode(v.col).alias("__i", col_of(n.var)))
            lanes = {**s.lanes, n.var: (v.lane.elem or (DOUBLE if v.family == "vector" else STRING)).null()}
            if n.second:
                df = df.withColumn(col_of(n.second), (F.col("__i") + 1).cast("bigint"))
                lanes[n.second] = INTEGER
        return Solution(df.select(*[col_of(k) for k in lanes]), lanes)

    def _values(self, n: A.Values) -> Solution:
        lanes: dict[str, Lane] = {}
        cells: list[list[Column]] = [[] for _ in n.rows]
        for i, v in enumerate(n.vars):
            vals = [None if r[i] is None else B.zoned(self._term(r[i])) for r in n.rows]
            known = [x for x in vals if x is not None]
            kinds = {(x.lane.kind, x.lane.dt if x.lane.kind == "lit" else "") for x in known}
            if len(kinds) == 1:
                lane = known[0].lane
                cols = [F.lit(None) if x is None else x.col for x in vals]
                if lane.kind == "iri" and (m := self._common_prefix([r[i] for r in n.rows if r[i] is not None])):
                    prefix, kind = m
                    lane = Lane("iri", prefix=prefix)
                    cols = [F.lit(None) if r[i] is None else F.lit(r[i].value[len(prefix) :]).cast(kind) for r in n.rows]
            else:
                lane = DYN
                cols = [F.lit(None).cast(L.TERM) if x is None else L.to_dyn(x.col, x.lane) for x in vals]
            lanes[v] = lane.null(any(x is None for x in vals))
            for row, c in zip(cells, cols):
                row.append(c.alias(col_of(v)))
        if not n.rows:
            return Solution(self.spark.range(0).select(*[F.lit(None).cast("string").alias(col_of(v)) for v in n.vars]), {v: Lane("iri") for v in n.vars})
        df = self.spark.range(1).select(F.explode(F.array(*[F.struct(*row) for row in cells])).alias("x")).select("x.*")
        return Solution(df, lanes)

    def _common_prefix(self, terms: list) -> tuple[str, Any] | None:
        """The subject template that all these IRIs invert, with its key's type."""
        for m in self._maps():
            if m.prefix and all(t.value.startswith(m.prefix) and "/" not in t.value[len(m.prefix) :] for t in terms):
                kind = m.df().schema[m.key].dataType
                if kind.simpleString() in ("int", "bigint") and all(t.value[len(m.prefix) :].isdigit() for t in terms):
                    return m.prefix, kind
        return None

    def _graph(self, n: A.Graph) -> Solution:
        before = self.active
        try:
            if isinstance(n.name, A.Iri):
                if self.named is not None and n.name.value not in self.named:
                    return self._nothing([[A.Var(v) for v in A.variables(n.inner)]])
                self.active = n.name.value
                return self.compile(n.inner)
            v = n.name.name
            if self._columnar(n.inner):
                self.active = Named(v, self.named)
                return self.compile(n.inner)
            names = self.graph.graph_names()
            if self.named is not None:
                names = names.where(F.col("g").isin(*self.named))
            every = Solution(names.select(F.col("g").alias(col_of(v))), {v: Lane("iri")})
            if isinstance(n.inner, A.Bgp) and not n.inner.triples:
                return every
            # What a graph gives as a whole (groups, limits, paths) is worked out graph by graph.
            out = None
            for (g,) in sorted(names.collect()):
                self.active = g
                one = Solution(self.spark.range(1).select(F.lit(g).alias(col_of(v))), {v: Lane("iri")})
                s = self.join(self.compile(n.inner), one)
                out = s if out is None else self.union(out, s)
            return out if out is not None else self._nothing([[n.name, *[A.Var(x) for x in A.variables(n.inner)]]])
        finally:
            self.active = before

    def _columnar(self, n: Any) -> bool:
        """Whether each solution's patterns can be joined on their graph, as one more column of every scan."""
        from ..operators import properties

        if isinstance(n, A.Bgp):
            plain = lambda p: not isinstance(p, A.Path) or p.op == "inv" and isinstance(p.args[0], A.Iri) or p.op == "seq" and all(plain(x) for x in p.args)
            return bool(n.triples) and all(plain(t[1]) for t in n.triples) and not properties.split(n.triples)[1]
        if isinstance(n, A.Join | A.LeftJoin | A.Union | A.HalfJoin):
            return self._columnar(n.left) and self._columnar(n.right)
        return isinstance(n, A.Filter | A.Extend) and self._columnar(n.inner)

    def _service(self, n: A.Service) -> Solution:
        """Magic services by IRI; others through registered callables."""
        from ..operators.services import run_service

        return run_service(self, n)

    # ------------------------------------------------------------ modifiers

    def _project(self, n: A.Project) -> Solution:
        s = self.compile(n.inner)
        cols, lanes = [], {}
        for v in n.vars:
            c = s.val(v)
            cols.append(c.col.alias(col_of(v)))
            lanes[v] = c.lane if v in s.lanes else c.lane.null()
        return Solution(s.df.select(*cols), lanes)

    def _distinct(self, n: A.Distinct) -> Solution:
        s = self.compile(n.inner)
        return Solution(s.df.distinct(), s.lanes)

    def _sort(self, v: Val, up: bool) -> list[Column]:
        return L.order_keys(v.col, v.lane, up)

    def _orderby(self, n: A.OrderBy) -> Solution:
        s = self.compile(n.inner)
        return Solution(s.df.orderBy(*[c for e, up in n.keys for c in self._sort(self.expr(e, s), up)]), s.lanes)

    def _slice(self, n: A.Slice) -> Solution:
        s = self._ordered(n.inner)
        df = s.df
        if n.offset:
            df = df.offset(n.offset)
        if n.limit is not None:
            df = df.limit(n.limit)
        return Solution(df, s.lanes)

    def _ordered(self, n: Any) -> Solution:
        return self.compile(n)

    # ------------------------------------------------------------ groups

    def _group(self, n: A.Group) -> Solution:
        if self.options.factor_counts and (done := self._counted(n) or self._factored(n) or self._tallied(n)) is not None:
            return done
        s = self.compile(n.inner)
        keys, lanes = [], {}
        for i, (v, e) in enumerate(n.keys):
            name = v or f".key{i}"
            k = self.expr(e, s)
            keys.append(k.col.alias(col_of(name)))
            lanes[name] = k.lane
        aggs = []
        for v, a in n.aggs:
            c, lane = self.aggregate(a, s)
            aggs.append(c.alias(col_of(v)))
            lanes[v] = lane
        df = s.df.groupBy(*keys).agg(*aggs) if aggs else s.df.select(*keys).distinct()
        return Solution(df, lanes)

    def _counted(self, n: A.Group) -> Solution | None:
        """COUNT(*) of the pattern ``?s ?p ?o``, whole or by ?p: cells are counted by column, no triple is built; of ``?s a ?t`` by ?t: rows of tables."""
        if not isinstance(n.inner, A.Bgp) or len(n.inner.triples) != 1 or len(n.aggs) != 1 or self.active is not None:
            return None
        t, (var, agg) = n.inner.triples[0], n.aggs[0]
        by_class = isinstance(t[1], A.Iri) and t[1].value == TYPE and isinstance(t[0], A.Var) and isinstance(t[2], A.Var) and t[0] != t[2]
        if agg.name != "COUNT" or agg.arg is not None or agg.distinct or not by_class and (not all(isinstance(x, A.Var) for x in t) or len(set(t)) < 3):
            return None
        if any(m.graph for m in self.graph.maps) or self.graph.quads is not None:
            return None
        if by_class:
            if len(n.keys) != 1 or n.keys[0][1] != t[2] or not n.keys[0][0]:
                return None
            key = n.keys[0][0]
            return Solution(self.graph.class_counts().select(F.col("c").alias(col_of(key)), F.col("n").cast("bigint").alias(col_of(var))), {key: Lane("iri"), var: INTEGER})
        counts = self.graph.predicate_counts()
        if not n.keys:
            return Solution(counts.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias(col_of(var))), {var: INTEGER})
        if len(n.keys) == 1 and n.keys[0][1] == t[1] and n.keys[0][0]:
            key = n.keys[0][0]
            return Solution(counts.select(F.col("p").alias(col_of(key)), F.col("c").cast("bigint").alias(col_of(var))), {key: Lane("iri"), var: INTEGER})
        return None

    def _factored(self, n: A.Group) -> Solution | None:
        """COUNT(*) over a join of two parts on one variable: counts by key on both sides are multiplied, no pair is formed."""
        if n.keys or len(n.aggs) != 1 or not isinstance(n.inner, A.Bgp):
            return None
        var, agg = n.aggs[0]
        if agg.name != "COUNT" or agg.arg is not None or agg.distinct or len(n.inner.triples) < 2:
            return None
        subjects = list(dict.fromkeys(t[0] for t in n.inner.triples))
        if len(subjects) != 2 or not all(isinstance(t[1], A.Iri) for t in n.inner.triples):
            return None
        parts = [self._bgp(A.Bgp([t for t in n.inner.triples if t[0] == x])) for x in subjects]
        shared = [v for v in parts[0].lanes if v in parts[1].lanes]
        if len(shared) != 1 or any(p.lanes[shared[0]].nullable for p in parts):
            return None
        counted = [Solution(p.df.groupBy(col_of(shared[0])).agg(F.count("*").alias(col_of(f".n{i}"))), {shared[0]: p.lanes[shared[0]], f".n{i}": INTEGER}) for i, p in enumerate(parts)]
        both = self.join(*counted)
        total = F.coalesce(F.sum(F.col(col_of(".n0")) * F.col(col_of(".n1"))), F.lit(0)).cast("bigint")
        return Solution(both.df.agg(total.alias(col_of(var))), {var: INTEGER})

    def _tallied(self, n: A.Group) -> Solution | None:
        """COUNT(*) over a join, by variables or not: each side is counted by what is shared and asked for first, and the counts of what meets are multiplied."""
        if not isinstance(n.inner, A.Join) or isinstance(n.inner.right, A.Service | A.Graph) or not all(isinstance(e, A.Var) for _, e in n.keys):
            return None
        if not n.aggs or any(a.name != "COUNT" or a.arg is not None or a.distinct for _, a in n.aggs):
            return None
        sides = [self.compile(n.inner.left), self.compile(n.inner.right)]
        wanted = {e.name for _, e in n.keys} | set(sides[0].lanes) & set(sides[1].lanes)
        counted = []
        for i, side in enumerate(sides):
            lanes = {v: lane for v, lane in side.lanes.items() if v in wanted}
            name = f".n{i}"
            df = side.df.groupBy(*[col_of(v) for v in lanes]).agg(F.count(F.lit(1)).alias(col_of(name)))
            counted.append(Solution(df if lanes else df.where(F.col(col_of(name)) > 0), {**lanes, name: INTEGER}))
        both = self.join(*counted)
        keys, lanes = [], {}
        for i, (v, e) in enumerate(n.keys):
            k = self.expr(e, both)
            keys.append(k.col.alias(col_of(v or f".key{i}")))
            lanes[v or f".key{i}"] = k.lane
        total = F.coalesce(F.sum(F.col(col_of(".n0")) * F.col(col_of(".n1"))), F.lit(0)).cast("bigint")
        df = both.df.groupBy(*keys).agg(*[total.alias(col_of(v)) for v, _ in n.aggs])
        return Solution(df, {**lanes, **{v: INTEGER for v, _ in n.aggs}})

    def aggregate(self, a: A.Agg, s: Solution) -> tuple[Column, Lane]:
        if a.name == "COUNT" and a.arg is None:
            if a.distinct:
                return F.countDistinct(F.struct(*[F.col(col_of(v)) for v in s.lanes])), INTEGER
            return F.count(F.lit(1)), INTEGER
        v = self.expr(a.arg, s)
        if a.name == "COUNT":
            return (F.countDistinct(v.col) if a.distinct else F.count(v.col)), INTEGER
        if a.name in AGGREGATE_IRIS:
            f, lane = AGGREGATE_IRIS[a.name]
            return f(v.col), lane
        if a.name == "SAMPLE":
            return F.min(v.col), v.lane.null()
        if a.name == "FOLD":
            return self._fold(a, v, s)
        if a.name == "GROUP_CONCAT":
            text = B.string(v)
            items = F.collect_set(text) if a.distinct else F.collect_list(text)
            if a.order:
                items = F.filter(self._in_order(a.order, text, s), lambda x: x.isNotNull())
                items = F.array_distinct(items) if a.distinct else items
            else:
                items = F.sort_array(items)
            return self._guard(F.array_join(items, a.separator), v), STRING.null()
        if a.name in ("MIN", "MAX"):
            f = F.min if a.name == "MIN" else F.max
            if v.family == "dyn":
                rank = F.struct(F.when(v.col["kind"] == 1, 1).when(v.col["kind"] == 0, 2).otherwise(3).alias("r"), L.dyn_number(v.col).alias("n"), v.col["lex"].alias("l"), v.col.alias("t"))
                return self._guard(f(F.when(v.col.isNotNull(), rank))["t"], v, loose=True), DYN.null()
            return self._guard(f(v.col), v, loose=True), v.lane.null()
        num = v if v.family == "num" else Val(B.number(v).cast("double"), DOUBLE.null())
        x = num.col
        integer = num.lane.dt in L.INTEGERS
        if a.name == "SUM":
            c = F.sum_distinct(x) if a.distinct else F.sum(x)
            lane = INTEGER if integer else num.lane
            return self._guard(F.coalesce(c, F.lit(0)).cast("bigint" if integer else "double" if lane.dt != XSD + "decimal" else "decimal(38,18)"), num), lane.null()
        if a.name == "AVG":
            mean = F.avg(x.cast("double")) if not a.distinct else F.try_divide(F.sum_distinct(x.cast("double")), F.countDistinct(x).cast("double"))
            return self._guard(F.when(F.count(F.lit(1)) == 0, 0.0).otherwise(mean), num), DOUBLE.null()
        d = x.cast("double")
        sample = F.array_distinct(F.collect_list(d)) if a.distinct else F.collect_list(d)
        if a.name == "MEDIAN":
            if not a.distinct:
                return self._guard(F.coalesce(F.median(d), F.lit(0.0)), num), DECIMAL.null()
            order = F.sort_array(sample)
            n = F.size(order)
            return self._guard(F.when(n == 0, 0.0).otherwise((F.get(order, F.floor((n - 1) / 2).cast("int")) + F.get(order, F.floor(n / 2).cast("int"))) / 2), num), DECIMAL.null()
        if a.name == "MODE":
            return self._guard(F.coalesce(F.mode(d, True), F.lit(0.0)), num), DECIMAL.null()
        stats = {"STDEV": (F.stddev_samp, True), "STDEV_SAMP": (F.stddev_samp, True), "STDEV_POP": (F.stddev_pop, False), "VARIANCE": (F.var_samp, True), "VAR_SAMP": (F.var_samp, True), "VAR_POP": (F.var_pop, False)}
        if a.name in stats:
            f, needs_two = stats[a.name]
            if a.distinct:
                n = F.size(sample)
                mean = F.aggregate(sample, F.lit(0.0), lambda p, q: p + q) / n
                ss = F.aggregate(sample, F.lit(0.0), lambda p, q: p + (q - mean) * (q - mean))
                c = F.try_divide(ss, (n - 1 if needs_two else n).cast("double"))
                c = F.sqrt(c) if a.name.startswith("STDEV") else c
            else:
                c = F.when(F.count(d) > (1 if needs_two else 0), f(d))
            return self._guard(c, num), DOUBLE.null()
        raise CompileError(f"no aggregate {a.name}")

    def _guard(self, c: Column, v: Val, loose: bool = False) -> Column:
        """An aggregate over an error is unbound (unless errors are skipped)."""
        if not v.lane.nullable and v.family != "dyn" or self.options.aggregate_errors == "skip" or loose and self.options.aggregate_errors == "own":
            return c
        return F.when(F.count(F.lit(1)) == F.count(v.col), c)

    def _fold(self, a: A.Agg, v: Val, s: Solution) -> tuple[Column, Lane]:
        if a.value is not None:
            w = self.expr(a.value, s)
            pair = F.struct(v.col.alias("k"), w.col.alias("v"))
            pairs = self._in_order(a.order, pair, s) if a.order else F.sort_array(F.collect_list(pair))
            pairs = F.filter(pairs, lambda x: x["k"].isNotNull())
            # The last value of a key stays.
            merged = F.map_from_entries(F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"])))
            return merged, Lane("lit", dt=L.MAP, elem=(v.lane, w.lane))
        # Unbound elements stay as nulls.
        items = self._in_order(a.order, v.col, s) if a.order else F.transform(F.sort_array(F.collect_list(F.struct(v.col.alias("x")))), lambda x: x["x"])
        return (F.array_distinct(items) if a.distinct else items), Lane("lit", dt=L.LIST, elem=v.lane)

    def _in_order(self, order: list, value: Column, s: Solution) -> Column:
        """A group's values as a list in the order of the keys, each in its own direction; ties by value."""
        keys, ups = [], []
        for e, up in order:
            k = self.expr(e, s)
            found = L.sort_values(k.col, k.lane)
            keys += found
            ups += [up] * len(found)
        rows = F.collect_list(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], value.alias("x")))
        if len(set(ups)) == 1:
            return F.transform(F.sort_array(rows, ups[0]), lambda x: x["x"])

        def before(x: Column, y: Column) -> Column:
            out = F
            for i, up in enumerate([*ups, True]):
                a, b = (x["x"], y["x"]) if i == len(ups) else (x[f"k{i}"], y[f"k{i}"])
                less = F.coalesce(a < b, a.isNull() & b.isNotNull())
                more = F.coalesce(a > b, a.isNotNull() & b.isNull())
                out = out.when(less, -1 if up else 1).when(more, 1 if up else -1)
            return out.otherwise(0)

        return F.transform(F.array_sort(rows, before), lambda x: x["x"])

    # ------------------------------------------------------------ expressions

    def _term(self, t: Any) -> Val:
        if isinstance(t, A.Iri):
            return Val(F.lit(t.value), Lane("iri"), t.value)
        return B.literal(t.lex, t.dt, t.lang)

    def expr(self, e: Any, s: Solution) -> Val:
        if isinstance(e, A.Var):
            return s.val(e.name)
        if isinstance(e, A.Iri | A.Lit):
            return self._term(e)
        if not isinstance(e, A.Call):
            raise CompileError(f"no expression {e!r}")
        name = e.name
        if name == "BOUND":
            return Val(s.val(e.args[0].name).col.isNotNull() if e.args[0].name in s.lanes else F.lit(False), BOOLEAN)
        args = [self.expr(a, s) for a in e.args]
        nullable = any(a.lane.nullable for a in args)
        if name in ("=", "!=", "<", "<=", ">", ">="):
            return Val(self._compared(name, *args), BOOLEAN)
        if name in ("+", "-", "*", "/"):
            out = B.arithmetic(name, *args)
            return Val(out.col, out.lane.null(nullable or name == "/"))
        if name == "&&":
            return Val(B.boolean(args[0]) & B.boolean(args[1]), BOOLEAN)
        if name == "||":
            return Val(B.boolean(args[0]) | B.boolean(args[1]), BOOLEAN)
        if name == "!":
            return Val(~B.boolean(args[0]), BOOLEAN)
        if name == "u-":
            return Val(-args[0].col, args[0].lane)
        if name == "u+":
            return args[0]
        if name == "IN":
            if all(a.const is not None and a.family == args[0].family for a in args[1:]) and args[0].family in ("num", "str") and len(args) > 1:
                return Val(args[0].col.isin(*[a.col for a in args[1:]]), BOOLEAN)
            out = F.lit(False)
            for a in args[1:]:
                out = out | self._compared("=", args[0], a)
            return Val(out, BOOLEAN)
        if name == "IF":
            yes, no, lane = self._unify(args[1], args[2])
            test = B.boolean(args[0])
            return Val(F.when(test, yes).when(~test, no), lane.null())
        if name == "COALESCE":
            out, lane = args[0].col, args[0].lane
            for a in args[1:]:
                x, y, lane = self._unify(Val(out, lane), a)
                out = F.coalesce(x, y)
            return Val(out, replace(lane, nullable=all(a.lane.nullable for a in args)))
        if name == B.FN + "apply":
            return B.call(args[0].const, args[1:])
        out = B.call(name, args)
        return Val(out.col, out.lane.null(nullable), out.const)

    def _compared(self, op: str, a: Val, b: Val) -> Column:
        # A constant IRI against a template is compared by its key.
        for x, y in ((a, b), (b, a)):
            if x.lane.kind == "iri" and x.lane.prefix and y.const is not None and y.lane.kind == "iri":
                if not y.const.startswith(x.lane.prefix):
                    return F.when(x.col.isNotNull(), F.lit(op == "!="))
                return B.compare(op, Val(x.col.cast("string"), STRING), Val(F.lit(y.const[len(x.lane.prefix) :]), STRING))
        return B.compare(op, a, b)

    def _unify(self, a: Val, b: Val) -> tuple[Column, Column, Lane]:
        if a.family == b.family == "num":
            lane = B._promote(a, b)
            kind = {INTEGER: "bigint", DECIMAL: "decimal(38,18)", DOUBLE: "double"}[lane]
            return a.col.cast(kind), b.col.cast(kind), lane
        if (a.lane.kind, a.lane.prefix, a.lane.dt) == (b.lane.kind, b.lane.prefix, b.lane.dt):
            return a.col, b.col, a.lane
        if a.lane.kind == b.lane.kind == "iri":
            return B.string(a), B.string(b), Lane("iri")
        return L.to_dyn(a.col, a.lane), L.to_dyn(b.col, b.lane), DYN

    # ------------------------------------------------------------ graphs out

    def construct(self, template: list, pattern: Any) -> DataFrame:
        """(g, s, p, o) terms of a template, each once; a template's blank nodes are skolemised by row."""
        s = self.compile(pattern)
        row = F.sha2(F.to_json(F.struct(*[F.col(col_of(v)) for v in s.lanes])) if s.lanes else F.lit(""), 256)

        def part(t: Any) -> Column:
            if isinstance(t, A.Var) and t.name.startswith(".") and t.name not in s.lanes:
                return L.to_dyn(F.sha2(F.concat(F.lit(t.name), row), 256), Lane("bnode"))
            v = s.val(t.name) if isinstance(t, A.Var) else self._term(t)
            return L.to_dyn(v.col, v.lane)

        items = [F.struct((F.lit(None).cast("string") if g is None else part(g)["lex"]).alias("g"), part(a).alias("s"), part(p)["lex"].alias("p"), part(o).alias("o")) for g, a, p, o in template]
        out = s.df.select(F.explode(F.array(*items)).alias("x")).select("x.*")
        return out.where("s is not null and p is not null and o is not null and s.kind < 2").distinct()

    def describe(self, what: list, pattern: Any) -> DataFrame:
        """Triples whose subject is described; blank-node objects are followed as far as they lead."""
        iris = [t.value for t in what if isinstance(t, A.Iri)]
        prefixes = {m.prefix for m in self._maps() for i in iris if m.prefix and i.startswith(m.prefix)} if len(iris) == len(what) and self.graph.quads is None else None
        found = self.graph.triples(None, self.active, prefixes)
        if found is None:
            return self.spark.createDataFrame([], f"s {L.TERM}, p string, o {L.TERM}")
        wanted = self.spark.range(1).select(F.explode(F.array(*[F.lit(i) for i in iris]).cast("array<string>")).alias("lex"))
        s = self.compile(pattern)
        for t in what:
            if isinstance(t, A.Var) and t.name in s.lanes:
                wanted = wanted.union(s.df.select(L.lexical(F.col(col_of(t.name)), s.lanes[t.name])))
        out = found.join(wanted.distinct().withColumnRenamed("lex", "_w"), F.col("s.lex") == F.col("_w"), "left_semi")
        if self.graph.quads is not None:
            from ..operators.tables import Rounds

            rounds = Rounds(self.spark, "described", keep=1000)
            seen = part = out = rounds.save(out)
            while True:
                nodes = part.where("o.kind = 1").select(F.col("o.lex").alias("_w")).distinct().join(seen.where("s.kind = 1").select(F.col("s.lex").alias("_x")).distinct(), F.col("_w") == F.col("_x"), "left_anti")
                part = rounds.save(found.join(nodes, (F.col("s.kind") == 1) & (F.col("s.lex") == F.col("_w")), "left_semi"))
                if part.isEmpty():
                    break
                seen = out = out.union(part)
        return out.distinct()


def _conjuncts(e: Any) -> list:
    return [y for x in e.args for y in _conjuncts(x)] if isinstance(e, A.Call) and e.name == "&&" else [e]


def _free(e: Any) -> set[str]:
    if isinstance(e, A.Var):
        return {e.name}
    if isinstance(e, A.Call):
        return set().union(*[_free(a) for a in e.args]) if e.args else set()
    return set()
