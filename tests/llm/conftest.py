import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (id, text) pairs; a frame with extra columns whose names clash with inner ones."""

    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t)) for i, t in rows], SCHEMA)
        if extra:
            for name in ("_id", "_text", "_row", "_lines", "_x", "_d", "key", "h1", "n", "label", "score"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
            if extra == "odd":  # names with dots and names that differ in case only
                df = df.selectExpr("*", "'x' AS `a.b`", "'x' AS `text.c`").toDF(*df.columns, "a.b", "text.c")
                df = df.withColumn("_p", F.lit("x")).withColumn("_q", F.lit(3)).toDF(*df.columns, "TEXT", "Doc_Id")
        return df

    return make


@pytest.fixture
def folder(spark, tmp_path):
    """A data folder with the given documents (and other tables)."""

    def make(docs, **tables):
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


#: Texts that every operator must take: null, empty, blank, one word, ties and repeated rows.
ODD = [(None, "a row without an id, long enough to be a line"), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (6, "Ünïcödé 漢字 🙂 text"), (6, "Ünïcödé 漢字 🙂 text"), (7, "x" * 50_000), (8, "long words here " * 5_000)]
