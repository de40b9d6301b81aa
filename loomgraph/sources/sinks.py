"""Results in the standard exchange formats, and descriptions of a dataset.

Writers of rows run on the executors: a row is a line of the output, so any
number of rows can be written; head and foot are the driver's.
"""

from __future__ import annotations

import json
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import lanes as L
from ..plans.compile import Solution, col_of
from ..plans.lanes import RDF, XSD

VOID = "http://rdfs.org/ns/void#"


def _terms(s: Solution) -> DataFrame:
    return s.df.select(*[L.to_dyn(F.col(col_of(v)), lane).alias(v) for v, lane in s.lanes.items()])


def _json_cell(v: str) -> Column:
    t = F.col(f"`{v}`")
    kind = F.when(t["kind"] == 0, "uri").when(t["kind"] == 1, "bnode").otherwise("literal")
    dt = F.when((t["kind"] == 2) & (t["dt"] != XSD + "string") & t["lang"].isNull(), t["dt"])
    body = F.to_json(F.struct(kind.alias("type"), t["lex"].alias("value"), t["lang"].alias("xml:lang"), dt.alias("datatype")))
    return F.when(t.isNotNull(), F.concat(F.lit(json.dumps(v) + ":"), body))


def json_rows(s: Solution) -> DataFrame:
    """(value): one binding object a row."""
    return _terms(s).select(F.concat(F.lit("{"), F.concat_ws(",", *[_json_cell(v) for v in s.lanes]), F.lit("}")).alias("value"))


def results_json(s: Solution) -> str:
    """A whole result document, for results that fit one process."""
    rows = ",\n".join(r[0] for r in json_rows(s).toLocalIterator())
    return f'{{"head":{{"vars":{json.dumps(list(s.lanes))}}},"results":{{"bindings":[\n{rows}\n]}}}}'


def results_xml(s: Solution) -> str:
    out = ['<?xml version="1.0"?>', '<sparql xmlns="http://www.w3.org/2005/sparql-results#">', "<head>" + "".join(f'<variable name="{v}"/>' for v in s.lanes) + "</head>", "<results>"]
    for row in _terms(s).toLocalIterator():
        cells = ""
        for v, t in zip(s.lanes, row):
            if t is None:
                continue
            tag = {0: "uri", 1: "bnode"}.get(t["kind"])
            extra = f' xml:lang="{t["lang"]}"' if t["lang"] else f' datatype="{escape(t["dt"])}"' if t["dt"] and t["dt"] != XSD + "string" else ""
            cells += f'<binding name="{v}">' + (f"<{tag}>{escape(t['lex'])}</{tag}>" if tag else f"<literal{extra}>{escape(t['lex'])}</literal>") + "</binding>"
        out.append(f"<result>{cells}</result>")
    return "\n".join([*out, "</results>", "</sparql>"])


def csv_rows(s: Solution, sep: str = ",") -> DataFrame:
    """(value): plain values in CSV, terms in TSV."""
    from .rdf import term_text

    cells = []
    for v in s.lanes:
        t = F.col(f"`{v}`")
        if sep == "\t":
            cells.append(F.coalesce(term_text(t), F.lit("")))
        else:
            lex = F.when(t["kind"] == 1, F.concat(F.lit("_:"), t["lex"])).otherwise(t["lex"])
            quoted = F.concat(F.lit('"'), F.replace(lex, F.lit('"'), F.lit('""')), F.lit('"'))
            cells.append(F.coalesce(F.when(lex.rlike(r'[",\r\n]'), quoted).otherwise(lex), F.lit("")))
    return _terms(s).select(F.concat_ws(sep, *cells).alias("value"))


def write_results(s: Solution, path: str, syntax: str = "json") -> None:
    """Rows as lines by every executor: JSON bindings, CSV or TSV (no head line), or Parquet of native columns."""
    if syntax == "json":
        json_rows(s).write.text(path)
    elif syntax in ("csv", "tsv"):
        csv_rows(s, "," if syntax == "csv" else "\t").write.text(path)
    elif syntax == "parquet":
        s.df.select(*[F.col(col_of(v)).alias(v) for v in s.lanes]).write.parquet(path)
    else:
        raise ValueError(f"no results in {syntax!r}")


def text_table(s: Solution, limit: int = 50) -> str:
    """The first rows as a table of text."""
    rows = [["" if t is None else t["lex"] for t in r] for r in _terms(s).limit(limit).collect()]
    width = [max(len(x) for x in col) for col in zip(list(s.lanes), *rows)] if s.lanes else []
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, width)) + " |"
    return "\n".join([line(list(s.lanes)), "|" + "|".join("-" * (w + 2) for w in width) + "|", *map(line, rows)])


def void(graph) -> DataFrame:
    """(s, p, o): a VoID description: triples, entities by class, triples and subjects by predicate."""
    triples = graph.triples()
    whole = triples.agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"), F.count_distinct("p").alias("properties"))
    stats = whole.select(F.explode(F.array(*[F.struct(F.lit("urn:dataset").alias("s"), F.lit(VOID + p).alias("p"), F.col(c).cast("string").alias("o")) for c, p in (("n", "triples"), ("subjects", "distinctSubjects"), ("objects", "distinctObjects"), ("properties", "properties"))])).alias("x")).select("x.*")
    classes = triples.where(F.col("p") == RDF + "type").groupBy(F.col("o.lex").alias("c")).agg(F.count("*").alias("n"))
    props = triples.groupBy("p").agg(F.count("*").alias("n"))
    part = lambda df, key, kind, target, count: df.select(F.explode(F.array(F.struct(F.concat(F.lit(f"urn:dataset#{kind}="), F.col(key)).alias("s"), F.lit(VOID + target).alias("p"), F.col(key).alias("o")), F.struct(F.concat(F.lit(f"urn:dataset#{kind}="), F.col(key)).alias("s"), F.lit(VOID + count).alias("p"), F.col("n").cast("string").alias("o")))).alias("x")).select("x.*")
    return stats.union(part(classes, "c", "class", "class", "entities")).union(part(props, "p", "property", "property", "triples"))
