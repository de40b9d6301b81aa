"""Services inside queries: path search, graph algorithms, saved views, and an application's own.

``SERVICE path:search { [] path:source S ; path:target T ; path:algorithm "shortest" ; … }``
``SERVICE algo:pageRank { [] algo:predicate ex:knows ; algo:node ?n ; algo:score ?s }``
``SERVICE view:read { [] view:name "n" ; view:bind ?a }``

Any other service IRI is looked up among the callables that the application
registered; without one the call fails, or is one empty solution if ``SILENT``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import algebra as A
from ..plans.lanes import DOUBLE, INTEGER, Lane, natural
from . import graph as G
from . import paths as P

PATH, ALGO, VIEW = "urn:loomgraph:path#", "urn:loomgraph:algo#", "urn:loomgraph:view#"


def _settings(inner: Any) -> dict[str, list]:
    """The predicates of a service block and their objects."""
    out: dict[str, list] = {}
    if not isinstance(inner, A.Bgp):
        from ..plans.compile import CompileError

        raise CompileError("a service block holds one list of settings")
    for _, p, o in inner.triples:
        out.setdefault(p.value.rsplit("#", 1)[-1], []).append(o)
    return out


def _value(settings: dict[str, list], name: str, default: Any = None) -> Any:
    if name not in settings:
        return default
    t = settings[name][0]
    if isinstance(t, A.Lit):
        return int(t.lex) if t.dt.endswith("integer") else float(t.lex) if t.dt.endswith(("decimal", "double")) else {"true": True, "false": False}.get(t.lex, t.lex)
    return t


def _edges(c: Any, s: dict[str, list]) -> tuple[DataFrame, Lane]:
    """The edges (src, dst[, weight]) that a block selects."""
    named = s.get("predicate", [])
    if named:
        df, lane = P.edges(c, named[0] if len(named) == 1 else A.Path("alt", tuple(named)))
    else:
        df, lane = P.edges(c, A.Path("neg", tuple(s.get("excludePredicate", []))))
        df = df.where("dst.kind < 2")
    if "weight" in s:
        from ..plans.compile import col_of

        # The weight of an edge is a property of its target.
        w = c.compile(A.Bgp([(A.Var(".n"), s["weight"][0], A.Var(".w"))]))
        weights = w.df.select(F.col(col_of(".n")).alias("dst"), F.col(col_of(".w")).cast("double").alias("weight"))
        df = df.join(weights, "dst", "left").select("src", "dst", F.coalesce("weight", F.lit(float(_value(s, "defaultWeight", 1.0)))).alias("weight"))
    return df, lane


def _native(t: Any, lane: Lane) -> Any:
    return t.value[len(lane.prefix) :] if isinstance(t, A.Iri) else t


def _path_search(c: Any, s: dict[str, list]) -> tuple[DataFrame, dict[str, Lane]]:
    df, lane = _edges(c, s)
    kind = df.schema["src"].dataType
    target = _value(s, "target")
    k = _value(s, "k", 1)
    found = P.search(
        c.spark, df, _native(_value(s, "source"), lane), None if target is None or isinstance(target, A.Var) else _native(target, lane), _value(s, "algorithm", "shortest"), _value(s, "direction", "forward"),
        _value(s, "minLength", 1), _value(s, "maxLength"), k, "weight" in s,
    )
    limit = _value(s, "limit")
    if limit is not None:
        keep = found.select("path_index", "length", "cost").distinct().orderBy("cost", "length", "path_index").limit(limit)
        found = found.join(keep.select("path_index"), "path_index", "left_semi")
    ends = found.groupBy("path_index").agg(F.max_by("edge_dst", "edge_index").alias("target"))
    found = found.join(ends, "path_index") if isinstance(target, A.Var) else found.withColumn("target", F.lit(None).cast(kind))
    columns = {"pathIndex": ("path_index", Lane("lit")), "edgeIndex": ("edge_index", INTEGER), "edgeSubject": ("edge_src", lane), "edgeObject": ("edge_dst", lane), "length": ("length", INTEGER), "cost": ("cost", DOUBLE), "target": ("target", lane)}
    return found, columns


#: Algorithm: (function of edges and settings, its columns beside the node).
ALGORITHMS: dict[str, tuple[Callable[[DataFrame, dict], DataFrame], dict[str, str]]] = {
    "pageRank": (lambda e, s: G.pagerank(e, _value(s, "iterations", 20), _value(s, "damping", 0.85)), {"score": "rank"}),
    "wcc": (lambda e, s: G.wcc(e), {"component": "component"}),
    "scc": (lambda e, s: G.scc(e), {"component": "component"}),
    "bfs": (lambda e, s: G.bfs(e, s["_sources"]), {"depth": "depth"}),
    "sssp": (lambda e, s: G.sssp(e if "weight" in e.columns else e.withColumn("weight", F.lit(1.0)), s["_sources"]), {"distance": "distance"}),
    "kcore": (lambda e, s: G.kcore(e), {"core": "core"}),
    "labelPropagation": (lambda e, s: G.label_propagation(e, _value(s, "maxIterations", 10), "weight" in e.columns, not _value(s, "undirected", False)), {"label": "label"}),
    "triangles": (lambda e, s: G.triangles(e), {"count": "triangles"}),
    "clustering": (lambda e, s: G.clustering(e), {"coefficient": "coefficient"}),
    "degree": (lambda e, s: G.degrees(e), {"out": "out_degree", "in": "in_degree"}),
    "nodeSimilarity": (lambda e, s: G.node_similarity(e, _value(s, "metric", "jaccard"), _value(s, "topK", 10), _value(s, "minimum", 0.0)), {"other": "other", "similarity": "similarity"}),
    "louvain": (lambda e, s: G.modularity_communities(e, _value(s, "maxIterations", 20), _value(s, "maxLevels", 5)), {"community": "community"}),
    "betweenness": (lambda e, s: G.betweenness(e, s.get("_sources") or None), {"score": "score"}),
    "fastRP": (lambda e, s: G.fast_rp(e, _value(s, "dimension", 32), _value(s, "seed", 42)), {"embedding": "embedding"}),
}
_NODES = {"component", "label", "other", "community"}


def _algorithm(c: Any, name: str, s: dict[str, list]) -> tuple[DataFrame, dict[str, tuple[str, Lane]]]:
    from ..plans.compile import CompileError

    if name not in ALGORITHMS:
        raise CompileError(f"no algorithm {name!r}")
    edges, lane = _edges(c, s)
    if lane.kind == "dyn":  # nodes of several kinds are compared by their text
        edges = edges.select(F.col("src.lex").alias("src"), F.col("dst.lex").alias("dst"), *[x for x in edges.columns if x == "weight"])
        lane = Lane("iri")
    f, outputs = ALGORITHMS[name]
    s = {**s, "_sources": [_native(t, lane) for t in s.get("source", [])]}
    df = f(edges, s)
    columns = {"node": ("id", lane)}
    for public, column in outputs.items():
        columns[public] = (column, lane if column in _NODES else natural(df.schema[column].dataType))
    return df, columns


def run_service(c: Any, n: A.Service) -> Any:
    from ..plans.compile import CompileError, Solution, col_of

    iri = n.name.value if isinstance(n.name, A.Iri) else None
    if iri == VIEW + "read":
        s = _settings(n.inner)
        df = c.services[VIEW](_value(s, "name"))
        binds = [t for t in s.get("bind", [])]
        cols = dict(zip([v.name for v in binds], df.columns))
        return Solution(df.select(*[F.col(x).alias(col_of(v)) for v, x in cols.items()]), {v: natural(df.schema[x].dataType).null() for v, x in cols.items()})
    if iri == PATH + "search" or iri and iri.startswith(ALGO):
        s = _settings(n.inner)
        df, columns = _path_search(c, s) if iri == PATH + "search" else _algorithm(c, iri[len(ALGO) :], s)
        cols, lanes = [], {}
        for name, (column, lane) in columns.items():
            for t in s.get(name, []):
                if isinstance(t, A.Var):
                    cols.append(F.col(column).alias(col_of(t.name)))
                    lanes[t.name] = lane.null()
        out = Solution(df.select(*cols), lanes)
        for name, (column, lane) in columns.items():  # a fixed node is a filter
            for t in s.get(name, []) if name == "node" else []:
                if isinstance(t, A.Iri):
                    out = Solution(df.where(F.col(column) == F.lit(_native(t, lane)).try_cast(df.schema[column].dataType)).select(*cols), lanes)
        return out
    if iri in c.services:
        found = c.services[iri](c, n.inner)
        if isinstance(found, Solution):
            return found
        return Solution(found.select(*[F.col(x).alias(col_of(x)) for x in found.columns]), {x: natural(found.schema[x].dataType).null() for x in found.columns})
    if n.silent:
        return c.unit()
    raise CompileError(f"no service {iri or n.name!r}")
