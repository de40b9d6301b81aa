"""Language identification with hyperdimensional profiles.

Letters get random vectors of +1 and -1.  A trigram's vector binds the letters'
vectors, rotated by their places, by multiplication; a text's vector bundles
(sums) the vectors of its trigrams; a language's prototype bundles the
normalised vectors of its training texts.  Texts are compared with prototypes by
cosine.  What every language shares is taken off first: the mean prototype.

Training reads at most about ``sample`` texts a language (a documented bound; a
hash of the id selects them) and sums integer vectors, so the order of tasks
does not matter.  Prediction sees the whole text and nothing else.

Defined results: null texts and texts without letters are ``und`` with score 0;
rows without a language teach nothing; with nothing learned all texts are
``und``; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

DIM = 512
SAMPLE = 1500
LETTERS = 64
_SCALE = 4096
_STATE: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    if not _STATE:
        kind = np.zeros(0x110000, dtype=np.uint8)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                kind[c] = c - 96 if 97 <= c <= 122 else 27 + (c * 2_654_435_761 >> 7) % (LETTERS - 27)
        base = np.random.RandomState(11).choice(np.array([-1, 1], dtype=np.int8), (LETTERS, DIM))
        _STATE["kind"] = kind
        _STATE["v"] = np.stack([np.roll(base, 2 - i, axis=1) for i in range(3)])
    return _STATE["kind"], _STATE["v"]


def bundle(text: str | None) -> np.ndarray | None:
    """The unit vector of a text; None without letters."""
    kind, vectors = _tables()
    if not text:
        return None
    code = kind[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    if not code.any():
        return None
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    code = np.concatenate([[0], code[keep], [0]]).astype(np.int32)
    tri = (code[:-2] * LETTERS + code[1:-1]) * LETTERS + code[2:]
    tri, count = np.unique(tri, return_counts=True)
    weight = np.sqrt(count).astype(np.float32)
    total = np.zeros(DIM, dtype=np.float32)
    for at in range(0, len(tri), 4096):
        t = tri[at : at + 4096]
        bound = vectors[0][t // (LETTERS * LETTERS)] * vectors[1][t // LETTERS % LETTERS] * vectors[2][t % LETTERS]
        total += weight[at : at + 4096] @ bound.astype(np.float32)
    return total / max(1e-6, float(np.sqrt(total @ total)))


def _learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b["lang"], b["text"]):
            if (v := bundle(text)) is not None:
                sums[lang] = sums.get(lang, 0) + np.rint(v * _SCALE).astype(np.int64)
    for lang, v in sums.items():
        yield pd.DataFrame({"lang": lang, "i": np.arange(DIM, dtype=np.int32), "x": v})


def learn(docs: DataFrame, sample: int = SAMPLE, held_out_mod: int | None = 3) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    if held_out_mod:
        rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % held_out_mod != 1)
    share = {r["lang"]: min(1.0, sample / r["count"]) for r in rows.groupBy("lang").count().collect()}
    if not share:
        return [], np.zeros((0, DIM))
    limit = F.create_map(*[F.lit(x) for lang, s in share.items() for x in (lang, int(1_000_000 * s))])
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < F.element_at(limit, F.col("lang"))).select("lang", "text")
    sums = chosen.mapInPandas(shared.lean(_learn), "lang string, i int, x long").groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    langs = sorted({r["lang"] for r in sums})
    out = np.zeros((len(langs), DIM))
    for r in sums:
        out[langs.index(r["lang"]), r["i"]] = r["x"]
    out /= np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))
    return langs, out


def identify(docs: DataFrame, langs: list[str], prototypes: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with the struct ``_lang`` (lang_pred, score)."""
    shared_part = prototypes.mean(axis=0) if len(langs) > 1 else np.zeros(DIM)
    own = prototypes - shared_part
    own = (own / np.maximum(1e-9, np.linalg.norm(own, axis=1, keepdims=True))).astype(np.float32)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores = [], []
        for t in texts:
            v = bundle(t) if langs else None
            if v is None:
                names.append("und")
                scores.append(0.0)
                continue
            v = v - shared_part
            cos = own @ v.astype(np.float32) / max(1e-9, float(np.sqrt(v @ v)))
            best = int(np.argmax(cos))
            names.append(langs[best])
            scores.append(round(float(np.clip((1 + cos[best]) / 2, 0, 1)), 6))
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.withColumn("_lang", predict(text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.exact(shared.documents(spark, sf_dir), "doc_id", "text", "lang")
    langs, prototypes = learn(docs)
    return identify(docs.select("doc_id", "text"), langs, prototypes).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "_lang.lang_pred", "_lang.score"
    )
