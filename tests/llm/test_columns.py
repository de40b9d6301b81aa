"""Extra columns with dots in their names, and names that differ from the operators' own in case only."""

import corpus_pipeline
import public_tokenizers
from loomgraph.llm import decontaminate, line_dedup, near_dedup, packing, quality, shared, substring_dedup

from .conftest import ODD


def test_operators_take_any_names(spark, documents):
    docs, plain = documents(ODD, extra="odd"), documents(ODD)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert "a.b" in docs.columns and "TEXT" in docs.columns and "Doc_Id" in docs.columns
    bench = spark.createDataFrame([(1, ODD[-1][1][:200])], "item_id long, text string")
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    for f in (
        lambda d: near_dedup.near_duplicates(d),
        lambda d: substring_dedup.dedup_substrings(d),
        lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "start", "length", "ids_crc32"),
        lambda d: decontaminate.contaminated(d, bench),
        lambda d: quality.ranked(d, labels, shared.SharedTables(spark, "t")),
        lambda d: line_dedup.dedup_lines(d).select("_lines.*"),
    ):
        assert rows(f(docs)) == rows(f(plain))
    assert line_dedup.dedup_lines(docs).columns == [*[c for c in docs.columns if c != "_lines"], "_lines"]


def test_stages_take_any_names(spark, documents, folder):
    docs = documents(ODD, extra="odd")
    bench = spark.createDataFrame([(1, ODD[-1][1][:200])], "item_id long, text string")
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    sf = folder(documents(ODD), labels=labels, benchmark=bench)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        kept = [tuple(r) for r in out.collect()]
        assert kept and all(r[docs.columns.index("_lines")] == "x" and r[docs.columns.index("a.b")] == "x" for r in kept)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= len(ODD)
