"""Property paths and path search.

Closures run semi-naively: only pairs found in the last round are extended, and
pairs seen before are taken off by an anti join.  Each round is written to the
shared folder.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import algebra as A
from ..plans import lanes as L
from ..plans.lanes import DYN, Lane
from .tables import Rounds


def edges(c: Any, p: Any) -> tuple[DataFrame, Lane]:
    """(src, dst) of a path in one lane; duplicates stay (bag semantics)."""
    from ..plans.compile import Solution, col_of

    if isinstance(p, A.Iri):
        s = c.compile(A.Bgp([(A.Var(".a"), p, A.Var(".b"))]))
        la, lb = s.lanes[".a"], s.lanes[".b"]
        a, b = F.col(col_of(".a")), F.col(col_of(".b"))
        if (la.kind, la.prefix) == (lb.kind, lb.prefix) and la.kind == "iri":
            return s.df.select(a.alias("src"), b.alias("dst")), replace(la, nullable=False)
        return s.df.select(L.to_dyn(a, la).alias("src"), L.to_dyn(b, lb).alias("dst")), DYN
    if p.op == "inv":
        df, lane = edges(c, p.args[0])
        return df.select(F.col("dst").alias("src"), F.col("src").alias("dst")), lane
    if p.op == "neg":
        return _negated(c, p), DYN
    if p.op == "alt":
        df, lane = edges(c, p.args[0])
        for x in p.args[1:]:
            more, other = edges(c, x)
            df, more, lane = unify(df, lane, more, other)
            df = df.unionByName(more)
        return df, lane
    if p.op == "seq":
        df, lane = edges(c, p.args[0])
        for x in p.args[1:]:
            more, other = edges(c, x)
            df, more, lane = unify(df, lane, more, other)
            df = step(df, more)
        return df, lane
    if p.op in ("distinct", "multi", "shortest"):
        df, lane = edges(c, p.args[0])
        return (df if p.op == "multi" else df.distinct()), lane
    df, lane = edges(c, p.args[0])
    if p.op == "opt":
        df, lane, same = every(c, df, lane)
        return same.union(df).distinct(), lane
    if p.op == "range":
        if p.low == 0:
            df, lane, out = every(c, df, lane)
        else:
            out = None
        power = None
        for i in range(1, (p.high if p.high is not None else p.low) + 1):
            power = df if power is None else step(power, df)
            if i >= p.low:
                out = power if out is None else out.union(power)
        if p.high is None:
            tail = closure(c, df)
            if p.low == 0:
                return out.union(tail).distinct(), lane
            return power.union(step(power, tail)).distinct(), lane
        return out, lane
    if p.op == "star":
        df, lane, same = every(c, df, lane)
        return same.union(closure(c, df)).distinct(), lane
    return closure(c, df), lane


def empty_too(p: Any) -> bool:
    """Whether a path may have no edge."""
    if not isinstance(p, A.Path):
        return False
    if p.op in ("star", "opt") or p.op == "range" and p.low == 0:
        return True
    if p.op == "alt":
        return any(empty_too(x) for x in p.args)
    return p.op in ("seq", "inv", "distinct", "multi", "shortest", "plus", "range") and all(empty_too(x) for x in p.args)


def every(c: Any, df: DataFrame, lane: Lane) -> tuple[DataFrame, Lane, DataFrame]:
    """The edges, and every node with itself, in one lane: nodes are the graph's subjects and objects.

    While a path's start is known (``c.path_nodes``) only those nodes can matter:
    subjects of known mappings stay native keys, and a constant is its own pair.
    """
    known = getattr(c, "path_nodes", None)
    if isinstance(known, set) and c.graph.quads is None:
        maps = [m for m in c._maps() if m.prefix in known]
        if known == {lane.prefix} and lane.kind == "iri" and maps:
            nodes = df.select("src")
            for m in maps:
                nodes = nodes.union(m.df().select(m.subject()[0].cast(df.schema["src"].dataType).alias("src")))
            nodes = nodes.where("src is not null").distinct()
            return df, lane, nodes.select("src", F.col("src").alias("dst"))
    elif known is not None and not isinstance(known, set):
        df, lane = fitted(df, lane, known)
        return df, lane, c.spark.range(1).select(_constant(known, lane, df.schema["src"].dataType).alias("src")).select("src", F.col("src").alias("dst"))
    found = c.graph.triples(None, c.active, known if isinstance(known, set) and c.graph.quads is None else None)
    if found is None:
        found = c.spark.createDataFrame([], f"s {L.TERM}, p string, o {L.TERM}")
    nodes = found.select(F.explode(F.array("s", "o")).alias("src"))
    df = df.select(*[L.to_dyn(F.col(x), lane).alias(x) for x in ("src", "dst")])
    nodes = Rounds(c.spark, "nodes").save(nodes.union(df.select("src")).union(df.select("dst")).distinct())
    return df, DYN, nodes.select("src", F.col("src").alias("dst"))


def fitted(df: DataFrame, lane: Lane, term: Any) -> tuple[DataFrame, Lane]:
    """The edges in a lane that can hold the term."""
    if lane.kind == "iri" and not isinstance(term, A.Iri):
        return df.select(*[L.to_dyn(F.col(x), lane).alias(x) for x in ("src", "dst")]), DYN
    if lane.kind == "iri" and lane.prefix:
        rest = term.value[len(lane.prefix) :] if term.value.startswith(lane.prefix) else ""
        if not (rest.isdigit() if df.schema["src"].dataType.simpleString() != "string" else rest):
            return df.select(*[L.lexical(F.col(x), lane).alias(x) for x in ("src", "dst")]), Lane("iri")
    return df, lane


def zero(df: DataFrame) -> DataFrame:
    """Every node of the edges with itself."""
    nodes = df.select(F.explode(F.array("src", "dst")).alias("src")).distinct()
    return nodes.select("src", F.col("src").alias("dst"))


def step(a: DataFrame, b: DataFrame) -> DataFrame:
    mid = b.select(F.col("src").alias("mid"), F.col("dst").alias("end"))
    return a.join(mid, a["dst"] == mid["mid"]).select("src", F.col("end").alias("dst"))


def unify(a: DataFrame, la: Lane, b: DataFrame, lb: Lane) -> tuple[DataFrame, DataFrame, Lane]:
    if (la.kind, la.prefix) == (lb.kind, lb.prefix):
        return a, b, la
    to = lambda d, l: d.select(L.to_dyn(F.col("src"), l).alias("src"), L.to_dyn(F.col("dst"), l).alias("dst"))
    return to(a, la), to(b, lb), DYN


def closure(c: Any, df: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Pairs reachable by one or more edges; with ``starts`` (src) from these only."""
    rounds = Rounds(c.spark, "closure")
    df = rounds.save(df.distinct())
    first = df if starts is None else df.join(starts, "src", "left_semi")
    found = rounds.save(first)
    parts, frontier = [found], found
    while not frontier.isEmpty():
        new = step(frontier, df).distinct()
        for p in parts:
            new = new.join(p, ["src", "dst"], "left_anti")
        frontier = rounds.save(new)
        parts.append(frontier)
        if len(parts) > 8:  # few files to read back, and a bounded plan
            merged = parts[0]
            for p in parts[1:]:
                merged = merged.union(p)
            parts = [rounds.save(merged)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _negated(c: Any, p: Any, prefixes: set | None = None) -> DataFrame:
    """(src, dst) of all other predicates than these; ``prefixes``: what other patterns leave to the source."""
    forward = [x.value for x in p.args if isinstance(x, A.Iri)]
    backward = [x.args[0].value for x in p.args if isinstance(x, A.Path)]
    out = None
    for named, start, end in ((forward, "s", "o"), (backward, "o", "s")):
        if named or start == "s" and not backward:
            # Only tables that hold another predicate are read, and of these only those of the subjects that are left.
            wanted = None if c.graph.quads is not None else sorted(set().union(*[m.predicates() for m in c.graph.maps]) - set(named))
            part = c.graph.triples(wanted, c.active, prefixes if start == "s" and c.graph.quads is None else None)
            if part is None:
                part = c.spark.createDataFrame([], f"s {L.TERM}, p string, o {L.TERM}")
            part = part.where(~F.col("p").isin(*named)).select(F.col(start).alias("src"), F.col(end).alias("dst"))
            out = part if out is None else out.unionByName(part)
    return out


def path_solution(c: Any, s: Any, p: Any, o: Any, prefixes: set | None = None) -> Any:
    """A path pattern; a constant end keeps the search to what it reaches; ``prefixes``: what other patterns leave to the subject."""
    from ..plans.compile import Solution, col_of

    if isinstance(s, A.Var) and not isinstance(o, A.Var):
        s, o, p, prefixes = o, s, A.Path("inv", (p,)), None
    inner = p.args[0] if isinstance(p, A.Path) and p.op == "inv" else p
    before = getattr(c, "path_nodes", None)
    # Only a path that is one step with its repetition begins and ends at the same known node.
    single = isinstance(inner, A.Path) and inner.op in ("star", "opt", "range")
    c.path_nodes = (None if isinstance(s, A.Var) else s) if single and not isinstance(s, A.Var) else prefixes if single and p is inner else None
    try:
        if not isinstance(s, A.Var) and isinstance(inner, A.Path) and inner.op in ("plus", "star"):
            base, lane = edges(c, A.Path("inv", inner.args) if inner is not p else inner.args[0])
            base, lane = fitted(base, lane, s)
            start = c.spark.range(1).select(_constant(s, lane, base.schema["src"].dataType).alias("src"))
            df = closure(c, base, start)
            if inner.op == "star":
                df = df.union(start.select("src", F.col("src").alias("dst"))).distinct()
        else:
            df, lane = (_negated(c, p, prefixes), DYN) if isinstance(p, A.Path) and p.op == "neg" else edges(c, p)
            if not isinstance(s, A.Var):
                df, lane = fitted(df, lane, s)
                here = _constant(s, lane, df.schema["src"].dataType)
                df = df.where(F.col("src").eqNullSafe(here))
                if empty_too(p) and not single:  # a node that the graph does not have is its own end, too
                    one = c.spark.range(1).select(here.alias("src"), here.alias("dst"))
                    df = df.union(one.join(df.where("src <=> dst").select("src").distinct(), "src", "left_anti"))
    finally:
        c.path_nodes = before
    cols = {}
    if isinstance(s, A.Var):
        cols[s.name] = F.col("src")
    if isinstance(o, A.Var):
        if isinstance(s, A.Var) and o.name == s.name:
            df = df.where("src = dst")
        else:
            cols[o.name] = F.col("dst")
    else:
        df, lane = fitted(df, lane, o)
        df = df.where(F.col("dst").eqNullSafe(_constant(o, lane, df.schema["dst"].dataType)))
    return Solution(df.select(*[x.alias(col_of(v)) for v, x in cols.items()]), dict.fromkeys(cols, lane))


def _constant(t: Any, lane: Lane, kind: Any) -> Any:
    if lane.kind == "iri":
        return F.lit(t.value[len(lane.prefix) :] if t.value.startswith(lane.prefix) else None).try_cast(kind)
    from ..functions import builtins as B

    v = B.Val(F.lit(t.value), Lane("iri")) if isinstance(t, A.Iri) else B.literal(t.lex, t.dt, t.lang)
    return L.to_dyn(v.col, v.lane)


def _cheapest(rounds: Rounds, df: DataFrame, source: Column) -> DataFrame:
    """(id, cost, hops, pred): the cheapest way to each node, with fewest edges among equals, by relaxing what improved."""
    if not df.where("_w < 0").isEmpty():
        raise ValueError("weights must not be negative")
    best = rounds.save(df.sparkSession.range(1).select(source.alias("id"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast(df.schema["src"].dataType).alias("pred")))
    changed = best
    while not changed.isEmpty():
        offer = changed.join(df, changed["id"] == df["src"]).groupBy("dst").agg(F.min(F.struct((F.col("cost") + F.col("_w")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("src").alias("pred"))).alias("o"))
        better = F.col("cost").isNull() | (F.struct(F.col("o.cost"), F.col("o.hops")) < F.struct("cost", "hops"))
        both = best.join(offer, best["id"] == offer["dst"], "full").withColumn("_new", F.col("o").isNotNull() & better)
        pick = lambda c: F.when(F.col("_new"), F.col(f"o.{c}")).otherwise(F.col(c)).alias(c)
        now = rounds.save(both.select(F.coalesce("id", "dst").alias("id"), pick("cost"), pick("hops"), pick("pred"), "_new"), temporary=True)
        best, changed = now.drop("_new"), now.where("_new").drop("_new")
    return best


def _walked_back(rounds: Rounds, best: DataFrame, ends: DataFrame) -> DataFrame:
    """(nodes, edges, at, cost): the paths that the predecessors give, from their ends to the source."""
    back = rounds.save(best.select(F.col("id").alias("to"), "pred"))
    open_ = ends.where("pred is not null").select(F.array("id").alias("nodes"), F.col("id").alias("at"), "cost", F.col("pred").alias("to"))
    done = None
    while True:
        open_ = rounds.save(open_.select(F.concat(F.array("to"), "nodes").alias("nodes"), "at", "cost", "to").join(back, "to").select("nodes", "at", "cost", "pred").withColumnRenamed("pred", "to"))
        whole = open_.where("to is null").drop("to")
        done = whole if done is None else done.unionByName(whole)
        open_ = open_.where("to is not null")
        if open_.isEmpty():
            break
    edge = lambda i: F.struct(F.element_at("nodes", i).alias("a"), F.element_at("nodes", i + 1).alias("b"))
    return done.select("nodes", F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), edge).alias("edges"), "at", "cost")


def search(spark: Any, df: DataFrame, source: Any, target: Any | None = None, algorithm: str = "shortest", direction: str = "forward", low: int = 1, high: int | None = None, k: int = 1, weighted: bool = False) -> DataFrame:
    """Paths from ``source`` as (path_index, edge_index, edge_src, edge_dst, length, cost).

    ``df`` has src, dst and, if weighted, weight.  ``algorithm``: ``shortest`` (one
    a target), ``allShortest``, ``kShortest`` (simple paths by cost) or ``all``
    (simple paths of ``low`` to ``high`` edges).  Without ``high`` the shortest ones
    may have any length; simple paths by number have ten edges at most.

    One shortest path a target follows predecessors; all shortest ones walk the
    edges that lie on some shortest path only, so neither enumerates others.
    """
    if direction != "forward":
        back = df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(["weight"] if weighted else []))
        df = back if direction == "backward" else df.unionByName(back).distinct()
    if high is None and algorithm in ("shortest", "allShortest"):
        rounds = Rounds(spark, "paths", keep=3)
        kind = df.schema["src"].dataType
        edges = rounds.save(df.where("src != dst").groupBy("src", "dst").agg(F.min(F.col("weight").cast("double") if weighted else F.lit(1.0)).alias("_w")))
        rounds = Rounds(spark, "paths", keep=3)
        best = _cheapest(rounds, edges, F.lit(source).cast(kind))
        best = Rounds(spark, "paths").save(best)
        ends = best if target is None else best.where(F.col("id") == F.lit(target).cast(kind))
        if algorithm == "shortest":
            return _numbered(_walked_back(Rounds(spark, "paths", keep=1000), best, ends).where(F.size("edges") >= low))
        cost = lambda end, name: best.select(F.col("id").alias(end), F.col("cost").alias(name))
        on = edges.join(cost("src", "_a"), "src").join(cost("dst", "_b"), "dst").where(F.abs(F.col("_a") + F.col("_w") - F.col("_b")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("_b")))
        df = on.select("src", "dst", F.col("_w").alias("weight"))
        weighted, algorithm, high = True, "all", 1 << 30
        return search(spark, df, source, target, algorithm, "forward", low, high, k, weighted)
    high = 10 if high is None else high
    rounds = Rounds(spark, "paths", keep=1000)
    df = df.withColumn("_w", F.col("weight").cast("double") if weighted else F.lit(1.0))
    e = F.struct(F.col("src").alias("a"), F.col("dst").alias("b"))
    kind = df.schema["src"].dataType
    frontier = df.where(F.col("src") == F.lit(source).cast(kind)).where("src != dst").select(F.array("src", "dst").alias("nodes"), F.array(e).alias("edges"), F.col("dst").alias("at"), F.col("_w").alias("cost"))
    frontier = rounds.save(frontier)
    done = [frontier]
    reached = frontier.select("at").distinct()
    edge = df.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("_w").alias("_c"), F.struct(F.col("src").alias("a"), F.col("dst").alias("b")).alias("e"))
    for _ in range(2, high + 1):
        nxt = frontier.join(edge, "at").where(~F.array_contains("nodes", F.col("to")))
        nxt = nxt.select(F.concat("nodes", F.array("to")).alias("nodes"), F.concat("edges", F.array("e")).alias("edges"), F.col("to").alias("at"), (F.col("cost") + F.col("_c")).alias("cost"))
        if algorithm in ("shortest", "allShortest") and not weighted:
            nxt = nxt.join(reached, "at", "left_anti")
            if algorithm == "shortest":
                nxt = nxt.groupBy("at").agg(F.min_by(F.struct("nodes", "edges", "cost"), F.struct("cost", "nodes")).alias("x")).select("x.nodes", "x.edges", "at", "x.cost")
        frontier = rounds.save(nxt)
        if frontier.isEmpty():
            break
        done.append(frontier)
        if algorithm in ("shortest", "allShortest") and not weighted:
            reached = rounds.save(reached.union(frontier.select("at")).distinct())
            if target is not None and not frontier.where(F.col("at") == F.lit(target).cast(kind)).isEmpty():
                break
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    out = out.where(F.size("edges") >= low)
    if target is not None:
        out = out.where(F.col("at") == F.lit(target).cast(kind))
    from pyspark.sql import Window

    order = Window.partitionBy("at").orderBy("cost", F.size("edges"), "nodes")
    if algorithm == "shortest":
        out = out.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    elif algorithm == "allShortest":
        out = out.withColumn("_r", F.rank().over(Window.partitionBy("at").orderBy("cost"))).where("_r = 1")
    elif algorithm == "kShortest":
        out = out.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return _numbered(out)


def _numbered(out: DataFrame) -> DataFrame:
    """One row an edge; the index tells a result's paths apart."""
    out = out.withColumn("path_index", F.sha2(F.to_json("nodes"), 256))
    rows = out.select("path_index", F.posexplode("edges").alias("edge_index", "e"), F.size("edges").cast("long").alias("length"), "cost")
    return rows.select("path_index", F.col("edge_index").cast("long").alias("edge_index"), F.col("e.a").alias("edge_src"), F.col("e.b").alias("edge_dst"), "length", "cost")
