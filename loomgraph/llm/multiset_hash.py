r"""Document fingerprints: a homomorphic multiset hash over paragraphs (native).

Every paragraph (line) is hashed into a wide vector; a document's fingerprint is
the sum of its paragraphs' vectors, lane by lane, modulo powers of two.  So the
order of paragraphs does not matter, and a paragraph is inserted or deleted by
adding or subtracting its vector (``combine``).

A paragraph's vector has two parts.  Eight lanes modulo 2**30 are hashes of the
whole paragraph: they decide equality.  Ninety-six lanes modulo 2**24 are the
sum, over the paragraph's pairs of neighbouring words (with a mark at both ends
of the paragraph), of random signs, so an edit changes few in any text.  Words
are cut after ``LONGEST`` letters, and after each letter of scripts that write no
spaces.  Two documents' lanes then have an inner product that estimates how many
pairs they share, which gives ``likeness`` (0 to 1; equal fingerprints have 1).

Everything is DataFrame functions.  The pairs of a document are exploded and
counted in the same task before one row a document is shuffled; two counts share
one long, so 48 sums make 96 lanes and cannot overflow.

The query's *next* document is found without a global sort: quantiles of the ids
(a bounded list), and even steps between them that follow the number of rows,
cut the rows into ordered buckets, the first rows of a bucket are also dealt to
the end of the bucket before, and a window inside each bucket sees the next row;
texts are shuffled once.

Defined results: null and empty texts have the fingerprint of one empty
paragraph; rows that repeat an id are rows of their own, ordered by text; null
ids come first; a single row is its own next document; an empty table gives no
rows; a text of any length is hashed whole; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

HASHES = 2
SUMS = 48
EXACT = 4
LONGEST = 24
#: What is followed by a cut inside a word: Thai to Khmer letters, CJK, kana, Hangul, or too many letters.
CUT = rf"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u9FFF\uAC00-\uD7AF]|\S{{{LONGEST}}}(?=\S)"
#: Quantiles of the ids, rows for each bucket between them, and buckets between two quantiles.
COARSE, ROWS_A_BUCKET, FINE = 384, 20_000, 512
_LOW31 = (1 << 31) - 1
_HALVES = ((1 << 30) - 1) << 32 | (1 << 30) - 1
_TWO = (1 << 31) | 1
_WIDE = 1 << 24
_ORDER = 1 << 36


def _exact(text: Column) -> list[Column]:
    paragraphs = F.split(text, "\n", -1)

    def lane(i: int) -> Column:
        # Two lanes modulo 2**30 in one long, with room for a carry between them.
        return F.aggregate(paragraphs, F.lit(0).cast("long"), lambda a, p: (a + F.xxhash64(F.lit(i), p).bitwiseAND(_HALVES)).bitwiseAND(_HALVES))

    return [lane(i) for i in range(EXACT)]


def _words(text: Column) -> Column:
    """Words of all paragraphs; a line feed stands before, between and behind paragraphs."""
    cut = F.regexp_replace(F.replace(text, F.lit("\t"), F.lit(" ")), CUT, "$0 ")
    return F.split(F.concat(F.lit("\n "), F.replace(cut, F.lit("\n"), F.lit(" \n ")), F.lit(" \n")), " ", -1)


def fingerprints(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row for each row of ``texts`` (whose other columns must tell rows apart): these columns, ``exact`` and packed ``counts``."""
    keys = [c for c in texts.columns if c != text]
    whole = F.coalesce(F.col(text), F.lit(""))
    # What is computed once a row must lie below the explode, not beside it.
    rows = texts.select(*keys, *[c.alias(f"_e{i}") for i, c in enumerate(_exact(whole))], _words(whole).alias("_ws"))
    by = [*keys, *[f"_e{i}" for i in range(EXACT)]]
    pairs = F.arrays_zip(F.slice("_ws", F.lit(1), F.size("_ws") - 1).alias("a"), F.slice("_ws", F.lit(2), F.size("_ws") - 1).alias("b"))
    rows = rows.select(*by, F.explode(pairs).alias("_p")).select(*by, F.xxhash64(F.lit(101), "_p.a", "_p.b").alias("_h0"), F.xxhash64(F.lit(202), "_p.a", "_p.b").alias("_h1"))
    sums = [F.sum(F.shiftrightunsigned(f"_h{j % HASHES}", j // HASHES).bitwiseAND(_TWO)).alias(f"_s{j}") for j in range(SUMS)]
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *sums)
    return out.select(*keys, F.array(*[half for i in range(EXACT) for half in (F.col(f"_e{i}").bitwiseAND((1 << 30) - 1), F.shiftright(f"_e{i}", 32))]).alias("exact"), F.array("_n", *[f"_s{j}" for j in range(SUMS)]).alias("counts"))


def lanes(counts: Column) -> Column:
    """Sums of signs modulo 2**24: twice the ones less all, for the low and the high half of each count."""
    n, packed = counts[0], F.slice(counts, 2, SUMS)
    low = F.transform(packed, lambda p: F.pmod(2 * p.bitwiseAND(_LOW31) - n, F.lit(_WIDE)))
    high = F.transform(packed, lambda p: F.pmod(2 * F.shiftright(p, 31) - n, F.lit(_WIDE)))
    return F.concat(low, high)


def combine(a: Column, b: Column, minus: bool = False) -> Column:
    """The fingerprint (struct of exact and lanes) with another's paragraphs inserted, or deleted."""
    sign = -1 if minus else 1
    return F.struct(
        F.zip_with(a["exact"], b["exact"], lambda x, y: F.pmod(x + sign * y, F.lit(1 << 30))).alias("exact"),
        F.zip_with(a["lanes"], b["lanes"], lambda x, y: F.pmod(x + sign * y, F.lit(_WIDE))).alias("lanes"),
    )


def to_string(exact: Column, lanes: Column) -> Column:
    return F.concat(
        F.array_join(F.transform(exact, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""),
        F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), ""),
    )


def _centred(lanes: Column) -> Column:
    return F.transform(lanes, lambda x: F.when(x >= _WIDE // 2, x - _WIDE).otherwise(x).cast("double"))


def likeness(exact_a: Column, lanes_a: Column, exact_b: Column, lanes_b: Column) -> Column:
    """1 for equal fingerprints, else twice the inner product over the squared lengths, within 0 and 1."""
    a, b = _centred(lanes_a), _centred(lanes_b)
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero, lambda s, x: s + x)
    size = F.aggregate(a, zero, lambda s, x: s + x * x) + F.aggregate(b, zero, lambda s, x: s + x * x)
    near = F.when(size == 0, zero).otherwise(F.greatest(zero, F.least(F.lit(1.0), 2 * dot / size)))
    return F.when((exact_a == exact_b) & (lanes_a == lanes_b), F.lit(1.0)).otherwise(F.least(near, F.lit(0.999999)))


def with_next(docs: DataFrame, coarse: int = COARSE, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """doc_id, text, key, next_key, next_text; keys follow the order of (doc_id, text)."""
    figures = docs.agg(F.percentile_approx("doc_id", [i / coarse for i in range(1, coarse)], 20_000).alias("c"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).collect()[0]
    least = figures["least"] if figures["least"] is not None else 0
    cuts = sorted({least, *(figures["c"] or [])})
    ends = [*cuts[1:], (figures["most"] or 0) + 1]
    # Between two quantiles the ids are cut evenly, so that buckets follow the number of rows.
    fine = min(FINE, max(1, -(-figures["n"] // (coarse * rows_a_bucket))))
    among = lambda values, i: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), i)
    part = F.greatest(F.lit(1), F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("doc_id"))))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if fine == 1:
        rows = rows.withColumn("_b", F.coalesce(part, F.lit(1)).cast("long"))
    else:
        inside = F.floor((F.col("doc_id") - among(cuts, F.col("_c"))).cast("double") / (among(ends, F.col("_c")) - among(cuts, F.col("_c"))) * fine)
        rows = rows.withColumn("_c", F.coalesce(part, F.lit(1))).withColumn("_b", F.col("_c") * fine + F.when(F.col("doc_id").isNull(), 0).otherwise(F.least(inside, F.lit(fine - 1)))).drop("_c")
    # One row a bucket, coarse * FINE at most: its first id, and the buckets beside it.
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"))).alias("first")
    buckets = rows.groupBy("_b").agg(first)
    line, every = Window.orderBy("_b"), Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    buckets = buckets.select("_b", F.col("first.id").alias("_first"), F.coalesce(F.lag("_b").over(line), F.last("_b").over(every)).alias("_before"), F.coalesce(F.lead("_b").over(line), F.first("_b").over(every)).alias("_next"))
    own, behind = F.struct(F.col("_b").alias("b"), F.lit(0).alias("m"), F.col("_next").alias("n")), F.struct(F.col("_before").alias("b"), F.lit(1).alias("m"), F.lit(None).cast("long").alias("n"))
    rows = rows.join(F.broadcast(buckets), "_b").withColumn("_x", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("_first")), F.array(own, behind)).otherwise(F.array(own))))
    rows = rows.select("doc_id", "text", F.col("_x.b").alias("_b"), F.col("_x.m").alias("_m"), F.col("_x.n").alias("_next"))
    order = Window.partitionBy("_b").orderBy("_m", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumn("_i", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order)).withColumn("_after", F.lead("_m").over(order)).where("_m = 0")
    here = F.col("_b") * _ORDER
    return rows.select("doc_id", "text", (here + F.col("_i")).alias("key"), F.when(F.col("_after") == 1, F.col("_next") * _ORDER + 1).otherwise(here + F.col("_i") + 1).alias("next_key"), "next_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = shared.SharedTables(spark, "fingerprints")
    rows = with_next(shared.exact(shared.documents(spark, sf_dir), "doc_id", "text"))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    both = rows.select(
        "doc_id", "key", "next_key", n.cast("long").alias("n_chars"), F.explode(F.array(F.struct(F.lit(0).alias("w"), F.col("text").alias("t")), F.struct(F.lit(1).alias("w"), edited.alias("t")))).alias("_x")
    ).select("doc_id", "key", "next_key", "n_chars", F.col("_x.w").alias("w"), F.when(F.col("_x.w") == 1, F.sha2(F.col("_x.t"), 256)).alias("sha"), F.col("_x.t").alias("_t"))
    made = tables.keep(fingerprints(both, "_t"))
    own = made.where("w = 0").select("key", "next_key", "doc_id", "n_chars", "exact", "counts")
    edit = made.where("w = 1").select("key", F.col("sha").alias("edited_sha256"), F.col("exact").alias("e_exact"), F.col("counts").alias("e_counts"))
    after = made.where("w = 0").select(F.col("key").alias("next_key"), F.col("exact").alias("n_exact"), F.col("counts").alias("n_counts"))
    wide = own.join(edit, "key").join(after, "next_key").select("doc_id", "n_chars", "edited_sha256", "exact", "e_exact", "n_exact", lanes(F.col("counts")).alias("l"), lanes(F.col("e_counts")).alias("e"), lanes(F.col("n_counts")).alias("a"))
    return wide.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        to_string(F.col("exact"), F.col("l")).alias("fingerprint"),
        to_string(F.col("e_exact"), F.col("e")).alias("edited_fingerprint"),
        F.round(likeness(F.col("exact"), F.col("l"), F.col("e_exact"), F.col("e")), 6).alias("near_edited"),
        F.round(likeness(F.col("exact"), F.col("l"), F.col("n_exact"), F.col("a")), 6).alias("near_next"),
    )
