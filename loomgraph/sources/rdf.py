r"""RDF documents as quads (g, s, p, o) and back.

N-Triples and N-Quads are lines: they are read and written by Spark's text
source and regular expressions, split over executors like any text.  The other
syntaxes have state that runs through a document, so a document is one task's
work; many documents are read side by side.  Compressed files are decoded by the
codecs of their names.
"""

from __future__ import annotations

import json
import re
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import algebra as A
from ..plans.lanes import RDF, TERM, XSD
from ..plans.parser import Parser, QuerySyntaxError

QUADS = f"g string, s {TERM}, p string, o {TERM}"
_STRING = XSD + "string"

#: name: (extensions, media type)
FORMATS = {
    "ntriples": (("nt",), "application/n-triples"),
    "nquads": (("nq",), "application/n-quads"),
    "turtle": (("ttl",), "text/turtle"),
    "trig": (("trig",), "application/trig"),
    "n3": (("n3",), "text/n3"),
    "rdfxml": (("rdf", "owl", "xml"), "application/rdf+xml"),
    "jsonld": (("jsonld",), "application/ld+json"),
    "jsonld-streaming": (("jsonlds",), "application/ld+json;profile=streaming"),
    "rdfjson": (("rj",), "application/rdf+json"),
    "trix": (("trix",), "application/trix"),
}


def by_extension(path: str) -> str:
    name = re.sub(r"\.(gz|bz2|zst|lz4|snappy|deflate)$", "", path)
    ext = name.rsplit(".", 1)[-1].lower()
    found = next((k for k, (exts, _) in FORMATS.items() if ext in exts), None)
    if found is None:
        raise ValueError(f"no syntax for {path!r}")
    return found


def by_media_type(media: str) -> str:
    found = next((k for k, (_, m) in FORMATS.items() if m == media.replace(" ", "")), None)
    if found is None:
        raise ValueError(f"no syntax for {media!r}")
    return found


# ---------------------------------------------------------------- lines

_IRI = r"<([^>]*)>"
_NODE = r"(?:<[^>]*>|_:[^\s]+)"
_LITERAL = r'"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?'
_LINE = rf"^\s*({_NODE})\s+<([^>]*)>\s+({_NODE}|{_LITERAL})\s*({_NODE})?\s*\.\s*(?:#.*)?$"


def _unescape(c: Column) -> Column:
    """Backslash escapes; a text without backslashes is left alone."""

    def slow(texts):
        from ..plans.parser import unescape

        return texts.map(lambda x: None if x is None else unescape(x))

    slow.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.when(F.contains(c, F.lit("\\")), F.pandas_udf(slow, "string")(c)).otherwise(c)


def _plain_unescape(c: Column) -> Column:
    """The common escapes in the JVM; \\u sequences take the Python way."""
    hold = ""
    out = F.replace(c, F.lit("\\\\"), F.lit(hold))
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"')):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.replace(out, F.lit(hold), F.lit("\\"))
    return F.when(c.rlike(r"\\[uUbf']"), _unescape(c)).otherwise(out)


def _term(c: Column) -> Column:
    iri = F.struct(F.lit(0).cast("tinyint").alias("kind"), F.substring(c, F.lit(2), F.char_length(c) - 2).alias("lex"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))
    node = F.struct(F.lit(1).cast("tinyint").alias("kind"), F.substring(c, F.lit(3), F.char_length(c)).alias("lex"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))
    tail = F.regexp_extract(c, r'"(\^\^<[^>]*>|@[A-Za-z0-9-]+)?$', 1)
    lex = F.substring(c, F.lit(2), F.char_length(c) - F.char_length(tail) - 2)
    lang = F.when(F.startswith(tail, F.lit("@")), F.lower(F.substring(tail, F.lit(2), F.char_length(tail))))
    dt = F.when(F.startswith(tail, F.lit("@")), RDF + "langString").when(F.startswith(tail, F.lit("^")), F.substring(tail, F.lit(4), F.char_length(tail) - 4)).otherwise(_STRING)
    lit = F.struct(F.lit(2).cast("tinyint").alias("kind"), _plain_unescape(lex).alias("lex"), dt.alias("dt"), lang.alias("lang"))
    return F.when(F.startswith(c, F.lit("<")), iri).when(F.startswith(c, F.lit("_:")), node).otherwise(lit).cast(TERM)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples or N-Quads; comments and lines that are no statement are left out."""
    lines = spark.read.text(path).where(F.col("value").rlike(_LINE))
    part = lambda i: F.regexp_extract("value", _LINE, i)
    rows = lines.select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"), part(4).alias("g"))
    return rows.select(F.when(F.col("g") != "", F.regexp_replace("g", "^(<|_:)|>$", "")).alias("g"), _term(F.col("s")).alias("s"), "p", _term(F.col("o")).alias("o"))


# ---------------------------------------------------------------- documents


def _cell(t: Any) -> dict:
    if isinstance(t, A.Iri):
        return {"kind": 0, "lex": t.value, "dt": None, "lang": None}
    if isinstance(t, A.Var):
        return {"kind": 1, "lex": t.name.lstrip("."), "dt": None, "lang": None}
    if isinstance(t, A.Lit):
        return {"kind": 2, "lex": t.lex, "dt": t.dt, "lang": t.lang}
    raise QuerySyntaxError(f"no term of a document: {t!r}")


class _Document(Parser):
    """Turtle and TriG (and the part of N3 that is Turtle)."""

    def quads_of(self) -> Iterator[tuple]:
        self.prefixes = {}
        while self.at < len(self.tokens):
            kind, x = self.peek()
            if (kind, x.lower()) in (("lang", "@prefix"), ("word", "prefix")):
                self.at += 1
                name = self.next()[1]
                if name == ":" or self.peek() == ("op", ":"):
                    self.op(":")
                self.prefixes[name.rstrip(":")] = self.resolve(self.next()[1][1:-1])
                self.op(".")
            elif (kind, x.lower()) in (("lang", "@base"), ("word", "base")):
                self.at += 1
                self.base = self.next()[1][1:-1]
                self.op(".")
            elif self.op("{"):
                yield from self._graph(None)
            elif self.word("GRAPH") or self.peek(1) == ("op", "{"):
                g = self.term()
                self.need("{")
                yield from self._graph(g)
            else:
                yield from self._statement(None)
                self.op(".")

    def _statement(self, g: Any) -> Iterator[tuple]:
        out: list = []
        self.triples(out)
        for s, p, o in out:
            if not isinstance(p, A.Iri):
                raise QuerySyntaxError(f"no predicate: {p!r}")
            yield (None if g is None else _cell(g)["lex"], _cell(s), p.value, _cell(o))

    def _graph(self, g: Any) -> Iterator[tuple]:
        while not self.op("}"):
            yield from self._statement(g)
            self.op(".")


def parse_turtle(text: str, base: str = "") -> list[tuple]:
    d = _Document(text)
    d.base = base
    return list(d.quads_of())


_XML_RDF = "{" + RDF + "}"
_XML = "{http://www.w3.org/XML/1998/namespace}"


def parse_rdfxml(text: str, base: str = "") -> list[tuple]:
    root = ET.fromstring(text)
    out: list[tuple] = []
    serial = iter(range(1 << 30))
    blank = lambda: {"kind": 1, "lex": f"x{next(serial)}", "dt": None, "lang": None}
    iri = lambda x: {"kind": 0, "lex": x if re.match(r"[A-Za-z][\w+.-]*:", x) else base + x, "dt": None, "lang": None}
    name = lambda tag: tag[1:].replace("}", "", 1)

    def lit(text: str, dt: str | None, lang: str | None) -> dict:
        return {"kind": 2, "lex": text, "dt": dt or (RDF + "langString" if lang else _STRING), "lang": lang.lower() if lang else None}

    def node(e: ET.Element, lang: str | None) -> dict:
        lang = e.get(_XML + "lang", lang)
        about, ident, nid = e.get(_XML_RDF + "about"), e.get(_XML_RDF + "ID"), e.get(_XML_RDF + "nodeID")
        s = iri(about) if about is not None else iri("#" + ident) if ident else {"kind": 1, "lex": nid, "dt": None, "lang": None} if nid else blank()
        if e.tag != _XML_RDF + "Description":
            out.append((None, s, RDF + "type", iri(name(e.tag))))
        for k, v in e.attrib.items():
            if not k.startswith((_XML_RDF, _XML)):
                out.append((None, s, name(k), lit(v, None, lang)))
            elif k == _XML_RDF + "type":
                out.append((None, s, RDF + "type", iri(v)))
        count = 0
        for p in e:
            predicate = name(p.tag)
            if p.tag == _XML_RDF + "li":
                count += 1
                predicate = f"{RDF}_{count}"
            inner = p.get(_XML + "lang", lang)
            resource, nid, kind = p.get(_XML_RDF + "resource"), p.get(_XML_RDF + "nodeID"), p.get(_XML_RDF + "parseType")
            if resource is not None:
                o = iri(resource)
            elif nid is not None:
                o = {"kind": 1, "lex": nid, "dt": None, "lang": None}
            elif kind == "Collection":
                items = [node(x, inner) for x in p]
                o = iri(RDF + "nil")
                for x in reversed(items):
                    head = blank()
                    out.extend([(None, head, RDF + "first", x), (None, head, RDF + "rest", o)])
                    o = head
            elif kind == "Resource":
                o = blank()
                holder = ET.Element(_XML_RDF + "Description", {_XML_RDF + "nodeID": o["lex"]})
                holder.extend(list(p))
                node(holder, inner)
            elif kind == "Literal":
                o = lit((p.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in p), RDF + "XMLLiteral", None)
            elif len(p):
                o = node(p[0], inner)
            else:
                o = lit(p.text or "", p.get(_XML_RDF + "datatype"), inner if p.get(_XML_RDF + "datatype") is None else None)
            out.append((None, s, predicate, o))
        return s

    for e in root if root.tag == _XML_RDF + "RDF" else [root]:
        node(e, root.get(_XML + "lang"))
    return out


def parse_trix(text: str, base: str = "") -> list[tuple]:
    local = lambda e: e.tag.rsplit("}", 1)[-1]

    def term(e: ET.Element) -> dict:
        k, t = local(e), e.text or ""
        if k == "uri":
            return {"kind": 0, "lex": t.strip(), "dt": None, "lang": None}
        if k == "id":
            return {"kind": 1, "lex": t.strip(), "dt": None, "lang": None}
        lang = e.get(_XML + "lang")
        return {"kind": 2, "lex": t, "dt": e.get("datatype") or (RDF + "langString" if lang else _STRING), "lang": lang.lower() if lang else None}

    out = []
    for graph in ET.fromstring(text):
        g = None
        for e in graph:
            if local(e) == "triple":
                s, p, o = (term(x) for x in e)
                out.append((g, s, p["lex"], o))
            else:
                g = (e.text or "").strip()
    return out


def parse_rdfjson(text: str, base: str = "") -> list[tuple]:
    out = []
    for s, ps in json.loads(text).items():
        subject = {"kind": 1, "lex": s[2:], "dt": None, "lang": None} if s.startswith("_:") else {"kind": 0, "lex": s, "dt": None, "lang": None}
        for p, os in ps.items():
            for o in os:
                v, lang = o["value"], o.get("lang")
                if o["type"] == "literal":
                    term = {"kind": 2, "lex": v, "dt": o.get("datatype") or (RDF + "langString" if lang else _STRING), "lang": lang.lower() if lang else None}
                else:
                    term = {"kind": 1 if o["type"] == "bnode" else 0, "lex": v.removeprefix("_:"), "dt": None, "lang": None}
                out.append((None, subject, p, term))
    return out


def parse_jsonld(text: str, base: str = "") -> list[tuple]:
    """JSON-LD with inline contexts (terms, prefixes, @vocab, @base, @type, @language, @list, @reverse, @graph)."""
    out: list[tuple] = []
    serial = iter(range(1 << 30))

    def expand(x: str, ctx: dict, vocab: bool) -> str:
        d = ctx.get(x)
        if vocab and d is not None:
            x = d if isinstance(d, str) else d.get("@id", x)
        if x.startswith(("@", "_:")) or "://" in x:
            return x
        prefix, sep, rest = x.partition(":")
        if sep and prefix in ctx:
            p = ctx[prefix]
            return expand((p if isinstance(p, str) else p["@id"]), ctx, False) + rest
        if sep:
            return x
        return ctx.get("@vocab", "") + x if vocab else ctx.get("@base", base) + x

    def node_term(x: str) -> dict:
        return {"kind": 1, "lex": x[2:], "dt": None, "lang": None} if x.startswith("_:") else {"kind": 0, "lex": x, "dt": None, "lang": None}

    def value(v: Any, d: Any, ctx: dict, g: str | None) -> dict:
        kind = d.get("@type") if isinstance(d, dict) else None
        if isinstance(v, dict):
            if "@value" in v:
                lang, dt = v.get("@language"), v.get("@type")
                raw = v["@value"]
                if dt is None and not isinstance(raw, str):
                    return value(raw, None, ctx, g)
                return {"kind": 2, "lex": raw if isinstance(raw, str) else json.dumps(raw), "dt": expand(dt, ctx, True) if dt else RDF + "langString" if lang else _STRING, "lang": lang.lower() if lang else None}
            if "@list" in v:
                return listed(v["@list"], d, ctx, g)
            return node(v, ctx, g)
        if isinstance(v, bool):
            return {"kind": 2, "lex": str(v).lower(), "dt": XSD + "boolean", "lang": None}
        if isinstance(v, int):
            return {"kind": 2, "lex": str(v), "dt": XSD + "integer", "lang": None}
        if isinstance(v, float):
            return {"kind": 2, "lex": f"{v:E}".replace("E+0", "E").replace("E-0", "E-"), "dt": XSD + "double", "lang": None}
        if kind in ("@id", "@vocab"):
            return node_term(expand(v, ctx, kind == "@vocab"))
        lang = d.get("@language") if isinstance(d, dict) and "@language" in d else ctx.get("@language") if kind is None else None
        return {"kind": 2, "lex": v, "dt": expand(kind, ctx, True) if kind else RDF + "langString" if lang else _STRING, "lang": lang.lower() if lang else None}

    def listed(items: list, d: Any, ctx: dict, g: str | None) -> dict:
        head = node_term(RDF + "nil")
        for x in reversed(items):
            cell = node_term(f"_:l{next(serial)}")
            out.extend([(g, cell, RDF + "first", value(x, d, ctx, g)), (g, cell, RDF + "rest", head)])
            head = cell
        return head

    def node(x: dict, ctx: dict, g: str | None) -> dict:
        if "@context" in x:
            for c in x["@context"] if isinstance(x["@context"], list) else [x["@context"]]:
                if isinstance(c, dict):
                    ctx = ctx | c
        ident = x.get("@id", next((x[k] for k, d in ctx.items() if d == "@id" and k in x), None))
        s = node_term(expand(ident, ctx, False)) if ident is not None else node_term(f"_:n{next(serial)}")
        for k, vs in x.items():
            d = ctx.get(k)
            p = expand(k, ctx, True)
            if p == "@graph":
                for y in vs if isinstance(vs, list) else [vs]:
                    node(y, ctx, s["lex"] if ident is not None else g)
                continue
            if p == "@type":
                for y in vs if isinstance(vs, list) else [vs]:
                    out.append((g, s, RDF + "type", node_term(expand(y, ctx, True))))
                continue
            if p == "@reverse":
                for q, ys in vs.items():
                    for y in ys if isinstance(ys, list) else [ys]:
                        out.append((g, node(y, ctx, g), expand(q, ctx, True), s))
                continue
            if p.startswith("@") or vs is None or ":" not in p:
                continue
            if isinstance(d, dict) and "@reverse" in d:
                for y in vs if isinstance(vs, list) else [vs]:
                    out.append((g, value(y, {"@type": "@id"}, ctx, g), expand(d["@reverse"], ctx, True), s))
                continue
            if isinstance(d, dict) and d.get("@container") == "@list":
                out.append((g, s, p, listed(vs if isinstance(vs, list) else [vs], d, ctx, g)))
                continue
            if isinstance(d, dict) and d.get("@container") == "@language":
                for lang, y in vs.items():
                    out.append((g, s, p, value({"@value": y, "@language": lang}, None, ctx, g)))
                continue
            for y in vs if isinstance(vs, list) else [vs]:
                if y is not None:
                    out.append((g, s, p, value(y, d, ctx, g)))
        return s

    found = json.loads(text)
    for x in found if isinstance(found, list) else [found]:
        if set(x) <= {"@context", "@graph"}:
            ctx = x.get("@context") or {}
            for y in x.get("@graph", []):
                node({"@context": ctx} | y, {}, None)
        else:
            node(x, {}, None)
    return out


PARSERS: dict[str, Callable[..., list[tuple]]] = {"turtle": parse_turtle, "trig": parse_turtle, "n3": parse_turtle, "rdfxml": parse_rdfxml, "trix": parse_trix, "rdfjson": parse_rdfjson, "jsonld": parse_jsonld, "jsonld-streaming": parse_jsonld}


def parse_text(text: str, syntax: str, base: str = "") -> list[tuple]:
    """The quads of one document in memory."""
    if syntax in ("ntriples", "nquads"):
        return [q for line in text.splitlines() for q in _one_line(line)]
    return PARSERS[syntax](text, base)


def _one_line(line: str) -> list[tuple]:
    m = re.match(_LINE, line)
    if not m:
        return []
    cell = lambda x: _cell(Parser(x).term())
    g = cell(m[4])["lex"] if m[4] else None
    return [(g, cell(m[1]), m[2], cell(m[3]))]


def frame(spark: SparkSession, quads: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(g, tuple(s.values()), p, tuple(o.values())) for g, s, p, o in quads], QUADS)


def read(spark: SparkSession, path: str, syntax: str | None = None, base: str = "") -> DataFrame:
    """Quads of the documents at a path; blank nodes are told apart by document."""
    syntax = syntax or by_extension(path)
    if syntax in ("ntriples", "nquads"):
        return read_lines(spark, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, text in zip(b["name"], b["value"]):
                mark = uuid.uuid5(uuid.NAMESPACE_URL, name).hex[:8]
                rows = PARSERS[syntax](text, base)
                for _, s, _, o in rows:
                    for t in (s, o):
                        if t["kind"] == 1 and not t["lex"].endswith("." + mark):
                            t["lex"] = f"{t['lex']}.{mark}"
                yield pd.DataFrame({"g": [r[0] for r in rows], "s": [r[1] for r in rows], "p": [r[2] for r in rows], "o": [r[3] for r in rows]})

    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), "value")
    return docs.mapInPandas(run, QUADS)


# ---------------------------------------------------------------- writing


def _escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def term_text(t: Column) -> Column:
    """A term in N-Triples."""
    tail = F.when(t["lang"].isNotNull(), F.concat(F.lit("@"), t["lang"])).when(t["dt"].isNull() | (t["dt"] == _STRING), "").otherwise(F.concat(F.lit("^^<"), t["dt"], F.lit(">")))
    return F.when(t["kind"] == 0, F.concat(F.lit("<"), t["lex"], F.lit(">"))).when(t["kind"] == 1, F.concat(F.lit("_:"), t["lex"])).otherwise(F.concat(F.lit('"'), _escaped(t["lex"]), F.lit('"'), tail))


def lines(quads: DataFrame) -> DataFrame:
    """(value): N-Quads lines (N-Triples where no graph is named)."""
    g = F.when(F.col("g").isNotNull(), F.concat(F.lit(" <"), F.col("g"), F.lit(">"))).otherwise("")
    return quads.select(F.concat(term_text(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), term_text(F.col("o")), g, F.lit(" .")).alias("value"))


def write(quads: DataFrame, path: str, syntax: str | None = None, mode: str = "errorifexists") -> None:
    """Dump quads: lines by every executor; Turtle and TriG group a subject's statements; RDF/JSON and JSON-LD make an object a subject and line."""
    syntax = syntax or "nquads"
    if syntax == "ntriples":
        quads = quads.withColumn("g", F.lit(None).cast("string"))
    if syntax in ("ntriples", "nquads"):
        lines(quads).write.mode(mode).text(path)
        return
    if syntax in ("turtle", "trig", "n3"):
        by = quads.groupBy("g", "s").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<"), F.col("p"), F.lit("> "), term_text(F.col("o"))))), " ;\n  ").alias("b"))
        block = F.concat(term_text(F.col("s")), F.lit(" "), F.col("b"), F.lit(" ."))
        if syntax == "trig":
            block = F.when(F.col("g").isNotNull(), F.concat(F.lit("GRAPH <"), F.col("g"), F.lit("> {\n"), block, F.lit("\n}"))).otherwise(block)
        by.select(block.alias("value")).write.mode(mode).text(path)
        return
    if syntax in ("jsonld", "jsonld-streaming"):
        o = F.col("o")
        v = F.when(o["kind"] == 0, F.to_json(F.struct(o["lex"].alias("@id")))).when(o["kind"] == 1, F.to_json(F.struct(F.concat(F.lit("_:"), o["lex"]).alias("@id")))).when(o["lang"].isNotNull(), F.to_json(F.struct(o["lex"].alias("@value"), o["lang"].alias("@language")))).otherwise(F.to_json(F.struct(o["lex"].alias("@value"), o["dt"].alias("@type"))))
        s = F.col("s")
        subject = F.when(s["kind"] == 1, F.concat(F.lit("_:"), s["lex"])).otherwise(s["lex"])
        per = quads.groupBy("g", subject.alias("i"), "p").agg(F.array_join(F.sort_array(F.collect_list(v)), ",").alias("v"))
        member = F.concat(F.lit('"'), _escaped(F.col("p")), F.lit('":['), F.col("v"), F.lit("]"))
        node = per.groupBy("g", "i").agg(F.array_join(F.sort_array(F.collect_list(member)), ",").alias("m"))
        text = F.concat(F.lit('{"@id":"'), _escaped(F.col("i")), F.lit('",'), F.col("m"), F.lit("}"))
        text = F.when(F.col("g").isNotNull(), F.concat(F.lit('{"@id":"'), _escaped(F.col("g")), F.lit('","@graph":['), text, F.lit("]}"))).otherwise(text)
        node.select(text.alias("value")).write.mode(mode).text(path)
        return
    raise ValueError(f"{syntax!r} is not written")
