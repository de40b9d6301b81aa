r"""Substring dedup: relative Lempel-Ziv factors against all earlier documents.

The reference is every document with a smaller id, cut into *blocks* that depend
on content alone: each run of ``window`` words selects the least hash of its
``gram``-word grams as its anchor, and the consecutive runs that select one
anchor form a block.  Equal passages select equal anchors wherever they stand,
so an index of blocks by anchor is all that parsing has to look at, and there is
about one block for twenty words.

A document is factored against the index.  A block whose words occur as a block
of an earlier document refers to that block's first occurrence (document and
place).  Where an anchor is known but the words around it differ, a factor may
end or begin inside the block, so there the block's windows are hashed and
looked up one by one, which extends the factors beside it to the last word that
agrees.  The parse then goes through a document's references from left to right:
a factor (reference document, place there, length) runs on for as long as the
next block or window is the next one of the same reference, and a new factor
begins where it is not.  Factors may overlap at their boundaries, as windows do.
Every factor has ``window`` words at least and is a duplicate span; a word goes
if a factor covers it.

Counts per block and window are summed before they are shuffled, and rows are
matched by equi-joins that adaptive execution splits where they are skewed, so a
passage that a third of the documents share is no hot task.  Anchors, blocks and
windows are matched by 128 bits of hash.

Defined results: null and empty texts have no words; rows that repeat an id are
one document for the comparison (they never remove each other's words) and each
gives its own row; rows with a null id lose nothing and take nothing; an empty
table gives no rows; a text of any length is factored whole; other columns do not
matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .textwords import Words, blocks, grams, mix, utf8

WINDOW = 50
GRAM = 8
_CHUNK = 65_536


def _least(grams_: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` grams, where its first least one is."""
    n = len(grams_) - width + 1
    out = np.empty(max(0, n), dtype=np.int64)
    for at in range(0, n, _CHUNK):
        part = grams_[at : min(n, at + _CHUNK) + width - 1]
        out[at : at + _CHUNK] = np.lib.stride_tricks.sliding_window_view(part, width).argmin(axis=1) + np.arange(at, at + len(part) - width + 1)
    return out


def _ranges(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word ranges start:end."""
    base = np.uint64(0x9FB21C651E98DF25)
    back = np.uint64(pow(int(base), -1, 1 << 64))
    powers = np.full(len(words) + 1, base, dtype=np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    inverse = np.full(len(words) + 1, back, dtype=np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(mix(words ^ np.uint64(0x2545F4914F6CDD1D)) * powers[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _blocks_of(window: int, gram: int, by: list[str]):
    width = window - gram + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b[by].to_numpy()
            for first, texts in blocks(utf8(t) for t in b["_text"]):
                words = Words(texts)
                hashes = words.hashes()
                every = grams(hashes, gram)
                least = _least(every, width)
                out = []
                for i, (s, e) in enumerate(zip(words.bounds[:-1], words.bounds[1:])):
                    n = int(e - s) - window + 1
                    if n <= 0:
                        continue
                    anchor = least[s : s + n]
                    begin = np.flatnonzero(np.diff(anchor, prepend=-1))
                    size = np.diff(begin, append=n)
                    out.append((np.full(len(begin), first + i), every[anchor[begin]], s + begin, size, begin))
                if out:
                    doc, a, at, size, begin = (np.concatenate(x) for x in zip(*out))
                    c = _ranges(hashes, at, at + size + window - 1)
                    yield pd.DataFrame({"a": a.view(np.int64), "c": c.view(np.int64), **{k: ids[doc, j] for j, k in enumerate(by)}, "w": begin.astype(np.int32), "n": size.astype(np.int32)})

    return shared.lean(run)


def _windows_of(window: int, by: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, text, wanted in zip(b[by].to_numpy(), b["_text"], b["wanted"]):
                hashes = Words([utf8(text)]).hashes()
                a = np.concatenate([np.full(x["n"], x["a"], dtype=np.int64) for x in wanted])
                at = np.concatenate([np.arange(x["w"], x["w"] + x["n"]) for x in wanted])
                keep = at + window <= len(hashes)
                a, at = a[keep], at[keep]
                yield pd.DataFrame({"a": a, "h": _ranges(hashes, at, at + window).view(np.int64), **dict(zip(by, i)), "w": at.astype(np.int32)})

    return shared.lean(run)


def parse(pieces: list[dict], window: int) -> list[tuple[int, int, int, int]]:
    """Factors (start, length, reference, place there) of a document, from its known blocks and windows (w, n starts, ref, at)."""
    out: list[list[int]] = []
    for x in sorted(pieces, key=lambda x: x["w"]):
        w, n, ref, at = x["w"], x["n"], x["ref"], x["at"]
        if out and w == out[-1][0] + out[-1][1] and ref == out[-1][2] and at == out[-1][3] + out[-1][1]:
            out[-1][1] += n
        else:
            out.append([w, n, ref, at])
    return [(w, n + window - 1, ref, at) for w, n, ref, at in out]


def kept_words(text: bytes, factors: list[tuple[int, int, int, int]]) -> tuple[list[bytes], int]:
    """Words that no factor covers, and how many words there were."""
    words = text.split()
    if not factors:
        return words, len(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, _, _ in factors:
        change[start] += 1
        change[start + length] -= 1
    gone = np.cumsum(change[:-1]) > 0
    return [x for x, g in zip(words, gone) if not g], len(words)


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` and the columns that tell its rows apart: ids that repeat take a hash of the text along."""
    if docs.where("_id is not null").groupBy("_id").count().where("count > 1").isEmpty():
        return docs, ["_id"]
    return docs.withColumn("_t", F.xxhash64("_text")), ["_id", "_t"]


def references(docs: DataFrame, by: list[str], window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(``by``, pieces): the runs of window starts (w, n) of each document whose words also start in an earlier one, with the first such document and place (ref, at).

    ``docs`` has the columns _id and _text; ``by`` tells its rows apart.
    """
    tables = shared.SharedTables(docs.sparkSession, "factors")
    known = docs.where("_id is not null")
    if len(by) > 1:
        known = known.dropDuplicates(by)
    keys = "".join(f"{k} long, " for k in by)
    rows = tables.keep(known.where(F.octet_length("_text") >= 2 * window - 1).mapInPandas(_blocks_of(window, gram, by), f"a long, c long, {keys}w int, n int"))
    # Both sides of every join are tables: adaptive execution can then split a hot anchor's rows.
    anchors = tables.keep(rows.groupBy("a").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).where("lo < hi").select("a"))
    rows = tables.keep(rows.join(anchors, "a"))
    first = F.min(F.struct("_id", "w")).alias("first")
    classes = tables.keep(rows.groupBy("a", "c").agg(first))
    several = tables.keep(classes.groupBy("a").agg(F.count("*").alias("classes")).where("classes > 1").select("a", F.lit(True).alias("several")))
    classes = tables.keep(classes.join(several, "a", "left"))
    rows = tables.keep(rows.join(classes, ["a", "c"]))
    piece = F.struct("w", "n", F.col("first._id").alias("ref"), F.col("first.w").alias("at")).alias("piece")
    whole = rows.where("first._id < _id").select(*by, piece)
    wanted = rows.where("first._id = _id and several").groupBy(*by).agg(F.collect_list(F.struct("a", "w", "n")).alias("wanted"))
    windows = tables.keep(known.join(wanted, by).mapInPandas(_windows_of(window, by), f"a long, h long, {keys}w int"))
    least = tables.keep(windows.groupBy("a", "h").agg(first, F.max("_id").alias("last")).where("first._id < last").select("a", "h", "first"))
    edges = windows.join(least, ["a", "h"]).where("first._id < _id").withColumn("n", F.lit(1)).select(*by, piece)
    return whole.union(edges).groupBy(*by).agg(F.collect_list("piece").alias("pieces"))


def _each(b: pd.DataFrame, window: int) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Each text with its factors."""
    for text, pieces in zip(b["_text"], b["pieces"]):
        yield utf8(text), [] if pieces is None else parse(pieces, window)


def _digest(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, lost, sha = [], [], []
            for text, found in _each(b, window):
                kept, words = kept_words(text, found)
                n.append(words)
                lost.append(words - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pd.DataFrame({"doc_id": b["_id"], "n_words": n, "n_removed": lost, "kept_sha256": sha})

    return shared.lean(run)


def _texts(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = [b" ".join(kept_words(text, found)[0]).decode("utf-8", "surrogatepass") for text, found in _each(b, window)]
            yield pd.DataFrame({"_id": b["_id"], "text": kept})

    return shared.lean(run)


def _factors(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *f) for i, (_, found) in zip(b["_id"], _each(b, window)) for f in found]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ref_id", "ref_start"])

    return shared.lean(run)


def _parsed(docs: DataFrame, window: int, gram: int, text: str, key: str) -> DataFrame:
    """(_id, _text, pieces) of every row."""
    rows, by = _keyed(shared.exact(docs, key, text).select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")))
    return rows.join(references(rows, by, window, gram), by, "left").select("_id", "_text", "pieces")


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, start, length, ref_id, ref_start) in words: each document's factors of ``window`` words or more against the earlier documents."""
    return _parsed(docs, window, gram, text, key).where("pieces is not null").withColumn("_text", F.lit("")).mapInPandas(_factors(window), "doc_id long, start int, length int, ref_id long, ref_start int")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text): the words that stay, joined by one space."""
    return _parsed(docs, window, gram, text, key).mapInPandas(_texts(window), "_id long, text string").withColumnRenamed("_id", "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _parsed(shared.documents(spark, sf_dir), WINDOW, GRAM, "text", "doc_id")
    return parsed.mapInPandas(_digest(WINDOW), "doc_id long, n_words long, n_removed long, kept_sha256 string")
