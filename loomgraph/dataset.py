"""A dataset: mapped tables and stored quads, with queries, updates, versions, views and saved queries.

Stored quads are a table of changes ``(seq, op, g, s, p, o)``, one folder a
commit, and bases, whole states that ``compact`` (or every ``COMPACT_EVERY``th
commit) writes, partitioned by a hash of the predicate.  The state at a commit is
the nearest base before it, less what the changes since then delete, with what
they insert: only that tail of the log is summed, and a pattern of known
predicates reads their partitions alone.  A commit writes only what changes the
state, so sums are -1, 0 or 1.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import algebra as A
from .plans.compile import Compiler, Options, Solution
from .plans.lanes import TERM
from .operators.tables import Rounds
from .plans.parser import parse, parse_update
from .sources import rdf, sinks
from .sources.catalog import VirtualGraph

QUAD = ["g", "s", "p", "o"]
CHANGES = f"seq long, op int, g string, s {TERM}, p string, o {TERM}"
INFERRED = "urn:x-loomgraph:inferred"
#: Commits after which a new base is written, and its partitions.
COMPACT_EVERY, PARTS = 16, 64


class Dataset:
    """``folder`` is where commits go (a path that all executors reach)."""

    def __init__(self, spark: SparkSession, folder: str, maps: list | None = None, options: Options | None = None):
        self.spark, self.folder, self.maps, self.options = spark, folder.rstrip("/"), maps or [], options or Options()
        self.services: dict[str, Any] = {"urn:loomgraph:view#": self.read_view}
        self.load_paths: list[str] | None = None  # folders and files that LOAD may read
        self.guard: Callable[[DataFrame], DataFrame] | None = None  # a report of what a commit would break

    # ------------------------------------------------------------ files

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, sub: str) -> list[str]:
        p, fs = self._fs(f"{self.folder}/{sub}")
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _read_json(self, name: str) -> dict:
        p, fs = self._fs(f"{self.folder}/{name}.json")
        if not fs.exists(p):
            return {}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(str(p)).collect()) or "{}")

    def _write_json(self, name: str, value: dict) -> None:
        p, fs = self._fs(f"{self.folder}/{name}.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    # ------------------------------------------------------------ versions

    @property
    def head(self) -> int:
        names = [int(x[4:]) for x in self._names("changes") if x.startswith("seq=")]
        return max(names, default=0)

    def changes(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """The change log (seq, op, g, s, p, o): op is 1 for an insertion, -1 for a deletion."""
        if not self._names("changes"):
            return self.spark.createDataFrame([], CHANGES)
        out = self.spark.read.schema(CHANGES).parquet(f"{self.folder}/changes").where(F.col("seq") > after)
        return out if upto is None else out.where(F.col("seq") <= upto)

    def _base(self, at: int) -> int:
        """The last base that is not after a commit; 0 without one."""
        return max([b for b in (int(x[4:]) for x in self._names("base") if x.startswith("seq=")) if b <= at], default=0)

    def quads(self, at: int | None = None, predicates: list[str] | None = None) -> DataFrame:
        """The state at a commit (the last by default), of some predicates if given."""
        at = self.head if at is None else at
        base = self._base(at)
        known = F.lit(True) if predicates is None else F.col("p").isin(*predicates)
        net = self.changes(base, at).where(known).groupBy(*QUAD).agg(F.sum("op").alias("n"))
        if not base:
            return net.where("n > 0").select(*QUAD)
        stored = self.spark.read.schema(f"g string, s {TERM}, p string, o {TERM}, part int").parquet(f"{self.folder}/base/seq={base}").where(known)
        if predicates is not None:
            stored = stored.where(F.col("part").isin(*[_part(F.lit(x)) for x in predicates]))
        if at == base:
            return stored.select(*QUAD)
        return _minus(stored.select(*QUAD), net.where("n < 0").select(*QUAD)).unionByName(net.where("n > 0").select(*QUAD))

    def compact(self) -> None:
        """Write the state as a base, which later reads begin with."""
        at = self.head
        if at and self._base(at) != at:
            self.quads(at).withColumn("part", _part(F.col("p"))).repartition("part", F.pmod(F.xxhash64("s"), F.lit(8))).write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/base/seq={at}")

    def commit(self, insert: DataFrame | None = None, delete: DataFrame | None = None, note: str = "") -> int:
        """One commit of the effective changes; returns its number (the old head if nothing changes)."""
        state = self.quads()
        parts = []
        if delete is not None:
            gone = delete.select(*QUAD).distinct()
            if insert is not None:  # what is deleted and inserted stays
                gone = _minus(gone, insert.select(*QUAD))
            parts.append(_semi(state, gone).withColumn("op", F.lit(-1)))
        if insert is not None:
            parts.append(_minus(insert.select(*QUAD).distinct(), state).withColumn("op", F.lit(1)))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        seq = self.head + 1
        path = f"{self.folder}/pending/{seq}"
        out.write.mode("overwrite").parquet(path)
        staged = self.spark.read.schema(out.schema).parquet(path)
        p, fs = self._fs(path)
        if staged.isEmpty():
            fs.delete(p, True)
            return seq - 1
        if self.guard is not None:
            broken = self.guard(_apply(state, staged)).limit(5).collect()
            if broken:
                fs.delete(p, True)
                raise ValueError(f"the commit is refused: {broken}")
        target, _ = self._fs(f"{self.folder}/changes/seq={seq}")
        fs.mkdirs(target.getParent())
        fs.rename(p, target)
        if note:
            self._write_json("notes", self._read_json("notes") | {str(seq): note})
        if seq - self._base(seq) >= COMPACT_EVERY:
            self.compact()
        return seq

    def preview(self, text: str) -> DataFrame:
        """The changes (op, quad) that an update would make, without making them."""
        insert, delete = self._effects(parse_update(text)[0])
        state = self.quads()
        out = None
        for df, op, keep in ((delete, -1, _semi), (insert, 1, lambda a, b: _minus(a, b))):
            if df is not None:
                part = (keep(state, df.select(*QUAD)) if op < 0 else keep(df.select(*QUAD).distinct(), state)).withColumn("op", F.lit(op))
                out = part if out is None else out.unionByName(part)
        return out

    def commits(self) -> DataFrame:
        """(seq, inserted, deleted, note)."""
        notes = self._read_json("notes")
        df = self.changes().groupBy("seq").agg(F.count_if(F.col("op") == 1).alias("inserted"), F.count_if(F.col("op") == -1).alias("deleted"))
        known = self.spark.createDataFrame([(int(k), v) for k, v in notes.items()] or [(0, "")], "seq long, note string")
        return df.join(known, "seq", "left")

    def diff(self, a: int, b: int) -> DataFrame:
        """(op, quad) that lead from one state to another, without what cancels out."""
        lo, hi = min(a, b), max(a, b)
        net = self.changes(lo, hi).groupBy(*QUAD).agg(F.sum("op").alias("op")).where("op != 0")
        return net.withColumn("op", F.col("op") * (1 if a <= b else -1))

    def history(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """The changes of matching quads, in order."""
        df = self.changes()
        for column, value in ((F.col("s.lex"), s), (F.col("p"), p), (F.col("o.lex"), o)):
            if value is not None:
                df = df.where(column == value)
        return df.orderBy("seq")

    def pin(self, name: str, at: int | None = None) -> None:
        self._write_json("pins", self._read_json("pins") | {name: self.head if at is None else at})

    def branch(self, folder: str, at: int | None = None) -> Dataset:
        """A dataset of its own that begins with a state of this one."""
        other = Dataset(self.spark, folder, self.maps, self.options)
        state = self.quads(at)
        if not state.isEmpty():
            other.commit(insert=state, note="branch")
        return other

    # ------------------------------------------------------------ queries

    def graph(self, at: int | str | None = None, inferred: DataFrame | None = None) -> VirtualGraph:
        at = self._read_json("pins")[at] if isinstance(at, str) else at
        quads = self.quads(at) if self._names("changes") else None
        if inferred is not None:
            quads = inferred if quads is None else quads.unionByName(inferred).distinct()
        of = (lambda predicates: self.quads(at, predicates)) if quads is not None and inferred is None else None
        return VirtualGraph(self.spark, self.maps, quads, of)

    def compiler(self, at: int | str | None = None, inferred: DataFrame | None = None) -> Compiler:
        return Compiler(self.graph(at, inferred), self.options, self.services)

    def query(self, text: str, bindings: dict[str, Any] | None = None, at: int | str | None = None, inferred: DataFrame | None = None) -> DataFrame:
        return self.compiler(at, inferred).query(text, bindings)

    def select(self, text: str, bindings: dict[str, Any] | None = None, at: int | str | None = None) -> Solution:
        """The solution with its lanes, for the result writers."""
        c = self.compiler(at)
        return c.compile(c._bind(parse(text).pattern, bindings) if bindings else parse(text).pattern)

    def ask(self, text: str) -> bool:
        return bool(self.query(text).collect()[0][0])

    def cursor(self, text: str) -> Iterator:
        """Rows one by one; a partition at a time is held."""
        return self.query(text).toLocalIterator()

    def put_query(self, name: str, text: str, defaults: dict[str, Any] | None = None) -> None:
        self._write_json("queries", self._read_json("queries") | {name: {"text": text, "defaults": defaults or {}}})

    def run(self, name: str, **parameters: Any) -> DataFrame:
        saved = self._read_json("queries")[name]
        return self.query(saved["text"], saved["defaults"] | parameters)

    def similar_queries(self, words: str, limit: int = 5) -> DataFrame:
        """Saved queries whose name and text match best."""
        from .operators.search import bm25

        rows = [(k, f"{k} {v['text']}") for k, v in self._read_json("queries").items()]
        return bm25(self.spark.createDataFrame(rows or [("", None)], "doc_id string, text string"), words, limit=limit)

    # ------------------------------------------------------------ views

    def create_view(self, name: str, text: str) -> None:
        """Materialise a query; the view knows the commit that it was made at."""
        seq = self.head
        self.query(text).write.mode("overwrite").parquet(f"{self.folder}/views/{name}/{seq}")
        self._write_json("views", self._read_json("views") | {name: {"text": text, "seq": seq}})

    def refresh_view(self, name: str) -> None:
        v = self._read_json("views")[name]
        if v["seq"] != self.head and self.touches(v["text"], v["seq"]):
            self.create_view(name, v["text"])
        elif v["seq"] != self.head:  # nothing that the query reads has changed
            self._write_json("views", self._read_json("views") | {name: v | {"fresh": self.head}})

    def read_view(self, name: str, allow_stale: bool = True) -> DataFrame:
        v = self._read_json("views")[name]
        if not allow_stale and max(v["seq"], v.get("fresh", 0)) != self.head:
            raise ValueError(f"view {name!r} is older than the last commit")
        return self.spark.read.parquet(f"{self.folder}/views/{name}/{v['seq']}")

    def drop_view(self, name: str) -> None:
        p, fs = self._fs(f"{self.folder}/views/{name}")
        fs.delete(p, True)
        self._write_json("views", {k: v for k, v in self._read_json("views").items() if k != name})

    def touches(self, text: str, after: int) -> bool:
        """Whether changes since a commit have a predicate that the query reads."""
        found = footprint(parse(text).pattern)
        delta = self.changes(after)
        return not (delta if found is None else delta.where(F.col("p").isin(*found))).isEmpty()

    # ------------------------------------------------------------ updates

    def update(self, text: str, note: str = "") -> int:
        """Run update operations, one commit each."""
        seq = self.head
        for u in parse_update(text):
            try:
                insert, delete = self._effects(u)
            except (ValueError, OSError):
                if u.silent:
                    continue
                raise
            if insert is not None or delete is not None:
                seq = self.commit(insert, delete, note)
        return seq

    def _constant(self, quads: list) -> DataFrame:
        return rdf.frame(self.spark, [(None if g is None else rdf._cell(g)["lex"], rdf._cell(s), p.value, rdf._cell(o)) for g, s, p, o in quads])

    def _effects(self, u: A.Update) -> tuple[DataFrame | None, DataFrame | None]:
        if u.kind == "insert_data":
            return self._constant(u.insert), None
        if u.kind == "delete_data":
            return None, self._constant(u.delete)
        if u.kind == "modify":
            c = self.compiler()
            make = lambda t: c.construct(t, u.pattern) if t else None
            return make(u.insert), make(u.delete)
        if u.kind == "load":
            path = u.source.removeprefix("file://")
            if self.load_paths is not None and not any(os.path.normpath(path) == os.path.normpath(x) or os.path.normpath(path).startswith(os.path.normpath(x).rstrip("/") + "/") for x in self.load_paths):
                raise ValueError(f"loading {path!r} is not allowed")
            rows = rdf.read(self.spark, path)
            return (rows if u.target is None else rows.withColumn("g", F.lit(u.target))), None
        state = self.quads()
        of = lambda g: state.where(F.col("g").isNull() if g is None else F.lit(True) if g == "ALL" else F.col("g").isNotNull() if g == "NAMED" else F.col("g") == g)
        if u.kind in ("clear", "drop"):
            return None, of(u.target)
        if u.kind == "create":
            return None, None
        if u.source == u.target:
            return None, None
        moved = of(u.source).withColumn("g", F.lit(u.target).cast("string"))
        if u.kind == "add":
            return moved, None
        gone = of(u.target)
        return moved, gone if u.kind == "copy" else gone.unionByName(of(u.source))

    # ------------------------------------------------------------ documents

    def load(self, path: str, syntax: str | None = None, graph: str | None = None, base: str = "") -> int:
        rows = rdf.read(self.spark, path, syntax, base)
        return self.commit(insert=rows if graph is None else rows.withColumn("g", F.lit(graph)), note=f"load {path}")

    def dump(self, path: str, syntax: str | None = None) -> None:
        rdf.write(self.quads(), path, syntax)

    def void(self) -> DataFrame:
        return sinks.void(self.graph())

    def patch(self, text: str) -> int:
        """Apply an RDF patch: A and D lines, in one commit; TA gives it up."""
        insert, delete = [], []
        for line in text.splitlines():
            word, _, rest = line.strip().partition(" ")
            if word == "TA":
                return self.head
            if word in ("A", "D"):
                (insert if word == "A" else delete).extend(rdf._one_line(rest))
        return self.commit(rdf.frame(self.spark, insert) if insert else None, rdf.frame(self.spark, delete) if delete else None, "patch") if insert or delete else self.head

    def patch_text(self, a: int, b: int) -> DataFrame:
        """(value): the lines of a patch from one state to another."""
        d = self.diff(a, b)
        g = F.when(F.col("g").isNotNull(), F.concat(F.lit(" <"), F.col("g"), F.lit(">"))).otherwise("")
        return d.select(F.concat(F.when(F.col("op") > 0, "A ").otherwise("D "), rdf.term_text(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), rdf.term_text(F.col("o")), g, F.lit(" .")).alias("value"))


def _same(a: str, b: str):
    on = F.lit(True)
    for c in QUAD:
        on = on & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return on


def _part(p: Column) -> Column:
    return F.pmod(F.xxhash64(p), F.lit(PARTS)).cast("int")


def _minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.alias("a").join(b.alias("b"), _same("a", "b"), "left_anti")


def _semi(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.alias("a").join(b.alias("b"), _same("a", "b"), "left_semi")


def _apply(state: DataFrame, staged: DataFrame) -> DataFrame:
    return _minus(state, staged.where("op = -1").select(*QUAD)).unionByName(staged.where("op = 1").select(*QUAD))


def footprint(pattern: Any) -> list[str] | None:
    """The predicates that a pattern reads; None if it may read any."""
    found: set[str] = set()
    any_ = False

    def path(p: Any) -> None:
        nonlocal any_
        if isinstance(p, A.Iri):
            found.add(p.value)
        elif isinstance(p, A.Path) and p.op != "neg":
            for x in p.args:
                path(x)
        else:
            any_ = True

    def walk(n: Any) -> None:
        nonlocal any_
        if isinstance(n, A.Bgp):
            for _, p, _ in n.triples:
                path(p)
        elif isinstance(n, A.Service):
            any_ = True
        elif hasattr(n, "__dataclass_fields__"):
            for f in n.__dataclass_fields__:
                walk(getattr(n, f))
        elif isinstance(n, list | tuple):
            for x in n:
                walk(x)

    walk(pattern)
    return None if any_ else sorted(found)


def _colours(q: DataFrame, seeds: list[tuple[int, str, str]]) -> DataFrame:
    """(side, n, c): blank nodes' colours, hashes of the statements about them with their neighbours' colours, until no class is split any more."""
    spark, rounds = q.sparkSession, Rounds(q.sparkSession, "colours")
    given = spark.createDataFrame(seeds, "side int, n string, seed string")
    nodes = q.select("side", F.explode(F.array("s", "o")).alias("t")).where("t.kind = 1").select("side", F.col("t.lex").alias("n")).distinct()
    now = rounds.save(nodes.join(given, ["side", "n"], "left").select("side", "n", F.coalesce("seed", F.lit("_")).alias("c")))
    classes = 0
    while True:
        count = now.agg(F.count_distinct("side", "c")).collect()[0][0]
        if count == classes:
            return now
        classes, j = count, _named(q, now)
        out = j.where("s.kind = 1").select("side", F.col("s.lex").alias("n"), F.concat_ws("\x01", F.lit(">"), "p", "_o", F.coalesce("g", F.lit(""))).alias("e"))
        into = j.where("o.kind = 1").select("side", F.col("o.lex").alias("n"), F.concat_ws("\x01", F.lit("<"), "p", "_s", F.coalesce("g", F.lit(""))).alias("e"))
        about = out.union(into).groupBy("side", "n").agg(F.array_join(F.sort_array(F.collect_list("e")), "\x02").alias("e"))
        # The colour before goes in, so classes are only ever split.
        now = rounds.save(now.join(about, ["side", "n"]).select("side", "n", F.sha2(F.concat_ws("\x03", "c", "e"), 256).alias("c")), temporary=True)


def _named(q: DataFrame, colours: DataFrame) -> DataFrame:
    """The statements with _s and _o: colours of blank nodes, else the terms."""
    name = lambda t, c: F.when(t["kind"] == 1, c).otherwise(F.concat_ws("|", t["kind"].cast("string"), t["lex"], F.coalesce(t["dt"], F.lit("")), F.coalesce(t["lang"], F.lit(""))))
    side = lambda end: colours.select(F.col("side").alias(f"_{end}d"), F.col("n").alias(f"_{end}n"), F.col("c").alias(f"_{end}c"))
    for end in "so":
        q = q.join(side(end), (F.col("side") == F.col(f"_{end}d")) & (F.col(f"{end}.kind") == 1) & (F.col(f"{end}.lex") == F.col(f"_{end}n")), "left")
    return q.withColumn("_s", name(F.col("s"), F.col("_sc"))).withColumn("_o", name(F.col("o"), F.col("_oc")))


def compare(a: DataFrame, b: DataFrame) -> bool:
    """Whether two sets of quads are equal up to the names of blank nodes.

    Colours are refined to the end.  Where they leave blank nodes alike, one of the
    smallest such class is told apart and each of the other graph's is tried as its
    partner, so regular structures are compared by their statements, too.
    """
    rows = a.select(*QUAD).distinct().withColumn("side", F.lit(0)).unionByName(b.select(*QUAD).distinct().withColumn("side", F.lit(1)))
    q = Rounds(a.sparkSession, "compared").save(rows)

    def same(seeds: list[tuple[int, str, str]]) -> bool:
        colours = _colours(q, seeds)
        differ = _named(q, colours).groupBy(F.coalesce("g", F.lit("")), "_s", "p", "_o").agg(F.sum(1 - 2 * F.col("side")).alias("n")).where("n != 0")
        if not differ.isEmpty():
            return False
        alike = colours.groupBy("c").agg(F.count("*").alias("k"), F.min(F.when(F.col("side") == 0, F.col("n"))).alias("one")).where("k > 2").orderBy("k", "c").limit(1).collect()
        if not alike:
            return True
        mark = f"#{len(seeds)}"
        partners = colours.where((F.col("side") == 1) & (F.col("c") == alike[0]["c"])).select("n").toLocalIterator()
        return any(same([*seeds, (0, alike[0]["one"], mark), (1, r["n"], mark)]) for r in partners)

    return same([])


__all__ = ["Dataset", "compare", "footprint"]
