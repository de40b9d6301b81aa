import __spark_entry__
import corpus_pipeline
from loomgraph.llm import near_dedup

from .conftest import ODD
from .test_dedup import components, lines
from .test_packing import check, whole

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stages(spark, docs, sf_dir, tmp_path):
    """The result of each stage, written and read as the driver does."""
    out = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], sf_dir).write.parquet(f"{tmp_path}/stage{k}")
        out.append(spark.read.parquet(f"{tmp_path}/stage{k}"))
    return out


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_each_stage(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = stages(spark, docs, sf, tmp_path)
    assert all(df.columns == COLUMNS for df in out[:5])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {i for i, _ in rows_of(out[1])}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good) and any(i not in kept for i, q in labels.items() if q == 0)
    # Line dedup against brute force on its own input.
    import hashlib

    want = {i: sha for i, _, _, sha in lines(rows_of(out[1]))}
    after = rows_of(out[2])
    assert {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in after} == want
    assert all(r.n_chars == len(r.text) for r in out[2].collect() if r.text is not None)
    comps = components(after, k=5)
    assert {i for i, _ in rows_of(out[3])} == {i for i, c in comps.items() if i == c}
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = rows_of(out[4])
    assert not any(b in (t or "") for b in bench for _, t in left)
    assert len(left) >= 0.85 * out[3].count()
    check([(i, whole(t)) for i, t in left], out[5].collect())


def test_odd_documents(spark, folder, documents, sf):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None)], "item_id long, text string")
    docs = documents(ODD, extra=True)
    pieces = corpus_pipeline.run(spark, folder(docs, labels=labels, benchmark=bench))
    ids = {r[0] for r in pieces.select("doc_id").distinct().collect()}
    comps = components([(i, t) for i, t in ODD], k=5)
    assert ids == {None} | {i for i, c in comps.items() if i == c}
    assert near_dedup.near_duplicates(docs).where(F.col("doc_id").isNull()).count() == 1


def test_empty(spark, folder, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert corpus_pipeline.run(spark, folder(documents([]), labels=labels, benchmark=bench)).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"
