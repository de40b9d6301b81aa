"""Line dedup: drop lines that many documents share.

Every document's distinct keys (ends stripped, A-Z lower-cased) are hashed to 128
bits and written once to a table of (id, hash).  Distinct documents per hash are
counted with map-side partial sums, so a line that a third of all documents hold
reaches its reducer as one row per task.  The hashes over the threshold are a
table of their own, so adaptive execution may broadcast them if they are few or
split the skewed side of the join if they are not.  Every document is
reassembled from its own lines in their order.

Defined results: null or empty texts are one empty line; every input row is a
document of its own for the counts only through its ``doc_id`` (rows that repeat
an id count once); rows with a null id take part in no count and lose nothing;
ties (several lines of one document with a key) all stay in the largest id.
A text of any length is split whole.  Other columns pass through untouched,
whatever their names; one named ``_lines`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared


def _key(line: Column) -> Column:
    return shared.lower_ascii(F.btrim(line, F.lit(shared.SPACES)))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the struct column ``_lines`` (n_lines, n_dropped, kept)."""
    tables = shared.SharedTables(docs.sparkSession, "lines")
    placed, at = shared.numbered(docs)
    own = placed.select(F.struct(*placed.columns).alias("_row"))
    text, key, names = at[text], at[key], {c for c in at if c != "_lines"}
    lines = F.split(F.coalesce(F.col(f"_row.{text}"), F.lit("")), "\n", -1)
    keys = F.array_distinct(F.filter(F.transform(lines, _key), lambda k: F.char_length(k) >= min_chars))
    rows = own.where(F.col(f"_row.{key}").isNotNull() & F.col(f"_row.{text}").isNotNull())
    held = tables.keep(rows.select(F.col(f"_row.{key}").alias("_d"), F.explode(keys).alias("_k")).select("_d", F.xxhash64(F.lit(11), "_k").alias("h1"), F.xxhash64(F.lit(29), "_k").alias("h2")))
    once = held if _unique(placed, key) else held.distinct()
    frequent = tables.keep(once.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("_d").alias("last")).where(F.col("n") >= min_docs).select("h1", "h2", "last"))
    lost = held.join(frequent, ["h1", "h2"]).where(F.col("_d") < F.col("last")).groupBy("_d").agg(F.collect_set("h1").alias("_lost"))
    # Inside one document 64 bits tell lines apart.
    kept = F.when(F.col("_lost").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("_lost"), F.xxhash64(F.lit(11), _key(x)))))
    out = own.join(lost, F.col(f"_row.{key}") == lost["_d"], "left").withColumn("_kept", kept)
    return out.select(
        *[F.col("_row")[at[c]].alias(c) for c in docs.columns if c in names],
        F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size("_kept")).cast("long").alias("n_dropped"), F.array_join("_kept", "\n").alias("kept")).alias("_lines"),
    )


def _unique(docs: DataFrame, key: str) -> bool:
    """Whether no two rows share an id."""
    return docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(shared.exact(shared.documents(spark, sf_dir), "doc_id", "text"))
    return out.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2(F.col("_lines.kept"), 256).alias("kept_sha256"))


SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, coalesce(keyed.doc_id < hot.last, false) AS gone FROM keyed LEFT JOIN hot USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
