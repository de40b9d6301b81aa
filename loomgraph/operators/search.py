r"""Full-text, vector, hybrid and entity search.

Text search reads the documents twice: once for the collection's figures (number
of texts, mean length, texts per query term; one row), once to score.  Nothing is
exploded and nothing but the figures leaves an executor.  ``postings`` makes the
inverted table for repeated use.

A text query has words, ``+must`` and ``-not`` words, and phrases
``"a b"`` or ``"a b"~n`` (the words in any order within n more positions).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
WORD = r"[\p{L}\p{N}]+"

# ---------------------------------------------------------------- analysis

# Common short words of each language.
STOP = {
    "en": "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split(),
    "fr": "au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous".split(),
    "de": "aber als am an auch auf aus bei bin bis bist da das dem den der des die du ein eine einem einen einer es für hat ich im in ist mit nicht oder sie sind so und von was wie wir zu zum zur".split(),
    "es": "al como con de del el ella en es esta este la las lo los más no o para pero por que se si sin su sus un una y ya".split(),
    "it": "a al alla che con da dal della di e gli ha i il in la le lo ma nel non per più se si sono su tra un una".split(),
}
# Endings that the light stemmers take off, longest first.
ENDINGS = {
    "fr": "issements issement atrices ations ateurs atrice ation ateur euses ments ment euse ives ive ité és ées ée er es e s x".split(),
    "de": "ungen heiten keiten ung heit keit isch lich ern em er en es e s n".split(),
    "es": "amientos imientos amiento imiento aciones ación adora ador ancia mente idad iva ivo osa oso es as os a o e".split(),
    "it": "amenti imenti amento imento azioni azione atrice atore mente ità iva ivo osa oso i e a o".split(),
    "pt": "amentos imentos amento imento ações ação adora ador mente idade iva ivo osa oso es as os a o e".split(),
    "nl": "heden heid ingen ing en s e".split(),
    "sv": "heterna heten arna erna orna ande arne aste anden ades heter andet en ar er or as es at a e s".split(),
    "ru": "иями ями ами иях ого ему ыми ими ией ев ов ие ье еи ии ей ой ий ям ем ам ом ах ях ию ью ия ья а е и й о у ы ь ю я".split(),
}


def _cut(word: Column, endings: list[str]) -> Column:
    """The word without its longest ending, if three letters stay."""
    return F.regexp_replace(word, f"(?<=.{{3}})(?:{'|'.join(sorted(endings, key=lambda e: -len(e)))})$", "")


def porter(word: str) -> str:
    """Porter's English stem."""

    def shape(w: str) -> str:
        out = ""
        for i, c in enumerate(w):
            vowel = c in "aeiou" or c == "y" and i > 0 and out[-1] == "c"
            out += "v" if vowel else "c"
        return out

    def m(w: str) -> int:
        return len(re.findall("v+c+", shape(w)))

    def double(w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c"

    def cvc(w: str) -> bool:
        return shape(w).endswith("cvc") and w[-1] not in "wxy"

    def swap(w: str, rules: str, least: int) -> str:
        for rule in rules.split():
            old, _, new = rule.partition(":")
            if w.endswith(old):
                return w[: -len(old)] + new if m(w[: -len(old)]) > least else w
        return w

    w = word
    if len(w) < 3 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in shape(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and "v" in shape(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif m(w) == 1 and cvc(w):
            w += "e"
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    w = swap(w, "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble", 0)
    w = swap(w, "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:", 0)
    for end in "ement ance ence able ible ment ant ent ism ate iti ous ive ize er ic al ou".split():
        if w.endswith(end):
            w = w[: -len(end)] if m(w[: -len(end)]) > 1 else w
            break
    else:
        if w.endswith(("sion", "tion")) and m(w[:-3]) > 1:
            w = w[:-3]
    if w.endswith("e") and (m(w[:-1]) > 1 or m(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and m(w) > 1:
        w = w[:-1]
    return w


def _porter_all(words: Column) -> Column:
    """Stems of a list of words."""

    def stems(lists: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def stem(w: str) -> str:
            if w not in known:
                if len(known) > 200_000:
                    known.clear()
                known[w] = porter(w)
            return known[w]

        return lists.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return F.pandas_udf(stems, "array<string>")(words)


def _stem_counts(tokens: Column, terms: list[str], never: list[str]) -> Column:
    """[number of tokens, of each term, of all unwanted ones] by Porter's stems.

    A word begins like its stem but for the stem's last letter (two in -ble, from
    -bility), so only words that begin like a wanted one go to Python.
    """
    starts = list(dict.fromkeys(w[: max(0, len(w) - (2 if w.endswith(("bl", "ble")) else 1))] for w in [*terms, *never]))
    known: dict[str, str] = {}

    def stem(w: str) -> str:
        if w not in known:
            if len(known) > 200_000:
                known.clear()
            known[w] = porter(w)
        return known[w]

    def counts(lists: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for words, n in zip(lists, sizes):
            found = Counter(map(stem, words))
            out.append([n, *[found[w] for w in terms], sum(found[w] for w in never)])
        return pd.Series(out)

    near = F.filter(tokens, lambda w: reduce(lambda a, b: a | b, [F.startswith(w, F.lit(x)) for x in starts]))
    return F.pandas_udf(counts, "array<int>")(near, F.size(tokens))


def _count(tokens: Column | str, word: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == F.lit(word)))


def analyze(text: Column, language: str | None = None, stem: bool = False) -> Column:
    """The tokens of a text: lower-cased words; with a language without elisions, possessives and common words."""
    lowered = F.lower(text)
    if language in ("fr", "it"):
        lowered = F.regexp_replace(lowered, r"(?<![\p{L}])(?:l|m|t|qu|n|s|j|d|c|un|dell|all|nell|sull)['’]", " ")
    if language == "en":
        lowered = F.regexp_replace(lowered, r"['’]s(?![\p{L}])", "")
    tokens = F.regexp_extract_all(lowered, F.lit(f"({WORD})"), 1)
    if language in STOP:
        tokens = F.filter(tokens, lambda w: ~w.isin(*STOP[language]))
    if stem and language == "en":
        tokens = _porter_all(tokens)
    elif stem and language in ENDINGS:
        tokens = F.transform(tokens, lambda w: _cut(w, ENDINGS[language]))
    return tokens


# ---------------------------------------------------------------- text queries


@dataclass
class TextQuery:
    should: list[str] = field(default_factory=list)
    must: list[str] = field(default_factory=list)
    never: list[str] = field(default_factory=list)
    phrases: list[tuple[list[str], int]] = field(default_factory=list)

    @property
    def terms(self) -> list[str]:
        return list(dict.fromkeys(self.should + self.must + [w for p, _ in self.phrases for w in p]))


def parse_query(text: str, language: str | None = None, stem: bool = False) -> TextQuery:
    def words(x: str) -> list[str]:
        found = [w for w in re.findall(r"[^\W_]+", x.lower()) if w not in STOP.get(language or "", ())]
        if stem and language == "en":
            return [porter(w) for w in found]
        if stem and language in ENDINGS:
            cut = re.compile(f"(?<=...)(?:{'|'.join(sorted(ENDINGS[language], key=lambda e: -len(e)))})$")
            return [cut.sub("", w) for w in found]
        return found

    q = TextQuery()
    for sign, phrase, slop, word in re.findall(r'([+-]?)(?:"([^"]*)"(?:~(\d+))?|(\S+))', text):
        if phrase:
            q.phrases.append((words(phrase), int(slop or 0)))
        elif word not in ("AND", "OR"):
            (q.must if sign == "+" else q.never if sign == "-" else q.should).extend(words(word))
    if re.search(r"\bAND\b", text):
        q.must, q.should = q.must + q.should, []
    return q


def _phrase(tokens: Column, words: list[str], slop: int) -> Column:
    if not slop:
        return F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.lit(" " + " ".join(words) + " "))
    width = len(words) + slop
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)))

    def inside(i: Column) -> Column:
        part = F.slice(tokens, i, F.lit(width))
        out = F.lit(True)
        for w in dict.fromkeys(words):
            out = out & (_count(part, w) >= words.count(w))
        return out

    return F.exists(starts, inside)


def bm25(docs: DataFrame, query: str, text: str = "text", key: str = "doc_id", language: str | None = None, stem: bool = False, limit: int | None = None) -> DataFrame:
    """(key, score) of the matching texts, best first if there is a limit."""
    q = parse_query(query, language, stem)
    rows = docs.where(F.col(text).isNotNull())
    if not q.terms:
        return rows.select(key, F.lit(0.0).alias("score")).limit(0)
    tf = {w: _count("_t", w) for w in q.terms}
    if stem and language == "en" and not q.phrases:
        rows = rows.select(key, _stem_counts(analyze(F.col(text), language), q.terms, q.never).alias("_c"))
        rows = rows.select(key, F.col("_c")[0].alias("_n"), *[F.col("_c")[i + 1].alias(f"_f{i}") for i in range(len(tf))], (F.col("_c")[len(tf) + 1] > 0).alias("_not"))
    else:
        rows = rows.select(key, analyze(F.col(text), language, stem).alias("_t"))
        rows = rows.select(key, F.size("_t").alias("_n"), *[c.alias(f"_f{i}") for i, c in enumerate(tf.values())], *[_phrase(F.col("_t"), w, s).alias(f"_p{i}") for i, (w, s) in enumerate(q.phrases)], F.arrays_overlap("_t", F.array(*[F.lit(w) for w in q.never])).alias("_not") if q.never else F.lit(False).alias("_not"))
    figures = rows.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_mean"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(tf))])
    # One row of figures: a join with a broadcast of one row.
    rows = rows.join(F.broadcast(figures))
    score = F.lit(0.0)
    for i in range(len(tf)):
        f, d = F.col(f"_f{i}"), F.col(f"_d{i}")
        idf = F.log(1 + (F.col("_docs") - d + 0.5) / (d + 0.5))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / F.col("_mean")))
    found = {w: F.col(f"_f{i}") > 0 for i, w in enumerate(tf)}
    need = ~F.col("_not")
    for w in q.must:
        need = need & found[w]
    for i in range(len(q.phrases)):
        need = need & F.col(f"_p{i}")
    if q.should and not q.must and not q.phrases:
        some = F.lit(False)
        for w in q.should:
            some = some | found[w]
        need = need & some
    out = rows.where(need).select(key, score.alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), key).limit(limit)


def postings(docs: DataFrame, text: str = "text", key: str = "doc_id", language: str | None = None, stem: bool = False) -> DataFrame:
    """(term, key, positions): the inverted table."""
    rows = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(analyze(F.col(text), language, stem)).alias("pos", "term"))
    return rows.groupBy("term", key).agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def highlight(text: Column, query: str, start: str = "<b>", end: str = "</b>", size: int | None = None) -> Column:
    """The text with the query's words marked; with ``size`` the fragment around the first one."""
    words = parse_query(query).terms
    pattern = rf"(?i)(?<![\p{{L}}\p{{N}}])({'|'.join(map(re.escape, words))})(?![\p{{L}}\p{{N}}])"
    if size is not None:
        at = F.char_length(F.regexp_extract(text, rf"(?is)^(.*?){pattern[4:]}", 1))
        text = F.substring(text, F.greatest(F.lit(1), at - size // 4), F.lit(size))
    return F.regexp_replace(text, pattern, f"{start}$1{end}")


# ---------------------------------------------------------------- vectors

#: Query vectors that one pass takes along; more are searched in blocks.
QUERIES_AT_ONCE = 1024
VECTORS_AT_ONCE = 8192


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    if metric == "dot":
        return x @ q.T
    if metric == "euclidean":
        return -np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * x @ q.T))
    n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None]
    return np.divide(x @ q.T, n, out=np.full(n.shape, -np.inf), where=n > 0)


def _best(names: np.ndarray, matrix: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, metric: str) -> Iterator[pd.DataFrame]:
    """The best ``k`` of a block of vectors for each of a block of queries."""
    s = _scores(x, matrix, metric)
    for j, name in enumerate(names):
        order = np.lexsort((ids, -s[:, j]))[:k]
        yield pd.DataFrame({"query": name, "_id": ids[order], "score": s[order, j]})


def vector_topk(vectors: DataFrame, queries: dict[int, list[float]] | DataFrame, k: int = 10, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, key, score, rank): the exact ``k`` best of each query.

    Queries are a small dict, or a table with the columns ``key`` and ``vector``.
    A dict travels with the scan, every batch keeping its own best first.  A table
    is dealt to blocks of about ``QUERIES_AT_ONCE``, the vectors to blocks of
    ``VECTORS_AT_ONCE``, and every block meets every other, so no task holds more
    than one of each and the driver none.
    """
    rows = vectors.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v")).where("_v is not null")
    if isinstance(queries, DataFrame):
        wanted = queries.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v")).where("_v is not null")

        def blocks(df: DataFrame, most: int, name: str) -> DataFrame:
            n = max(1, -(-df.count() // most))
            return df.groupBy(F.pmod(F.xxhash64("_id"), F.lit(n)).alias("_b")).agg(F.collect_list(F.struct("_id", "_v")).alias(name)).select(name)

        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for xs, qs in zip(b["x"], b["q"]):
                    yield from _best(np.array([r["_id"] for r in qs]), np.stack([r["_v"] for r in qs]).astype(float), np.array([r["_id"] for r in xs]), np.stack([r["_v"] for r in xs]).astype(float), k, metric)

        pairs = blocks(rows, VECTORS_AT_ONCE, "x").crossJoin(blocks(wanted, QUERIES_AT_ONCE, "q"))
        out = pairs.mapInPandas(meet, "query long, _id long, score double")
    else:
        out = None
        items = list(queries.items())
        for at in range(0, len(items), QUERIES_AT_ONCE):
            names = np.array([i for i, _ in items[at : at + QUERIES_AT_ONCE]], dtype=np.int64)
            matrix = np.array([v for _, v in items[at : at + QUERIES_AT_ONCE]], dtype=float)

            def run(batches: Iterator[pd.DataFrame], names: np.ndarray = names, matrix: np.ndarray = matrix) -> Iterator[pd.DataFrame]:
                for b in batches:
                    if len(b):
                        yield from _best(names, matrix, b["_id"].to_numpy(), np.stack(b["_v"].to_numpy()).astype(float), k, metric)

            part = rows.mapInPandas(run, "query long, _id long, score double")
            out = part if out is None else out.union(part)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("_id", key)


def competition_ranks(df: DataFrame, score: str = "score") -> DataFrame:
    """``df`` with rank: equal scores share a rank, the next one skips."""
    return df.withColumn("rank", F.rank().over(Window.orderBy(F.desc(score))))


def fuse_rrf(lists: list[DataFrame], key: str, k: int = 60, weights: list[float] | None = None, limit: int | None = None) -> DataFrame:
    """(key, score): reciprocal ranks of ranked lists (key, rank), summed."""
    weights = weights or [1.0] * len(lists)
    every = None
    for df, w in zip(lists, weights):
        part = df.select(key, (F.lit(w) / (F.lit(k) + F.col("rank"))).alias("s"))
        every = part if every is None else every.union(part)
    out = every.groupBy(key).agg(F.sum("s").alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), key).limit(limit)


def hybrid(docs: DataFrame, query: str, vectors: DataFrame, queries: DataFrame, limit: int = 10, depth: int = 100, key: str = "doc_id", vector_key: str = "vec_id") -> DataFrame:
    """(query, key, score): for each query vector its ranks and the text's ranks of the best ``depth`` of each, fused; the text's list is ``depth`` rows."""
    best = bm25(docs, query, key=key, limit=None).withColumn("score", F.round("score", 4)).orderBy(F.desc("score"), key).limit(depth)
    text = F.broadcast(competition_ranks(best).select(key, "rank"))
    near = vector_topk(vectors, queries, depth, key=vector_key).select("query", F.col(vector_key).alias(key), "rank")
    lists = near.union(queries.select(F.col(vector_key).cast("long").alias("query")).distinct().join(text).select("query", key, "rank"))
    fused = lists.groupBy("query", key).agg(F.round(F.sum(F.lit(1.0) / (F.lit(60) + F.col("rank"))), 8).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return fused.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")


# ---------------------------------------------------------------- entities


def _folding() -> tuple[str, str]:
    """Letters with marks and their base letters, by Unicode decomposition."""
    plain = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250)}
    pairs = [(a, b) for a, b in plain.items() if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without marks."""
    return F.lower(F.translate(text, *_folding()))


def entity_search(names: DataFrame, name: str, column: str = "name", typos: int = 1, limit: int = 10) -> DataFrame:
    """Rows whose folded name equals, starts with or is within ``typos`` edits of the given one, best first."""
    plain = unicodedata.normalize("NFD", name)
    wanted = "".join(c for c in plain if not unicodedata.combining(c)).lower()
    folded = fold(F.col(column))
    distance = F.levenshtein(folded, F.lit(wanted), typos)
    score = F.when(folded == wanted, 3.0).when(F.startswith(folded, F.lit(wanted)), 2.0).when(distance >= 0, 1.0)
    return names.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), column).limit(limit)
