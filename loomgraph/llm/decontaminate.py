r"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (title-case words inside a sentence) and
units (known words after a number) are replaced with typed placeholders, case
and punctuation go; a run of names, or of numbers with a number word, is one slot.
Windows of eight template tokens are hashed and joined with the benchmark's, and
so are windows of the plain words without case, for copies whose capitals are
others and for items of few literal words.  Windows of one document and one item
whose diagonals differ by ``DRIFT`` at most are chained in order; slots must be filled consistently (one value of the item, one
value of the document, both ways), so a question with other numbers or names is
caught and a jumble of matching placeholders is not.  An item counts as leaked
if the windows cover at least ``coverage`` of its tokens.

The document side is a map over whole texts.  The benchmark's window hashes go
with it as a filter when there are at most ``FILTER`` of them (their number is
counted first); beyond that all windows meet in a shuffled join, with the same
result.

Defined results: null and empty texts and items have no tokens and match
nothing; items with fewer tokens than a window are one window (three tokens at
least); windows with under three literal words say nothing and are left out;
rows that repeat an id are reported once; a null id is reported as null; an
empty table on either side gives no rows; other columns do not matter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .textwords import blocks, grams, mix, range_hashes, utf8

WINDOW = 8
SHORTEST = 3
COVERAGE = 0.5
FILTER = 2_000_000
LITERALS = 3
DRIFT = 32
NUM, NAME, UNIT = (np.uint64(x) for x in (0x1111, 0x2222, 0x3333))
UNITS = (
    "km m cm mm mi mile miles ft foot feet in inch inches yd yards kg g mg lb lbs pound pounds oz ton tons l ml liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents "
    "percent pct degree degrees celsius fahrenheit mph kmh watt watts kw volt volts joule joules calories kcal kb mb gb tb hz"
).split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen twenty thirty forty fifty sixty hundred thousand million".split()

_KIND = np.zeros(256, dtype=np.int8)  # 1 letters, 2 digits
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_STOP = np.zeros(256, dtype=np.int64)
_STOP[list(b'.!?:\n"')] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _hashes(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return range_hashes(buf, start, start + size)


def _known(words: list[str]) -> np.ndarray:
    text = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    size = np.array([len(w) for w in words])
    return np.sort(_hashes(text, np.cumsum(size + 1) - size - 1, size))


_UNIT_HASHES, _NUMBER_HASHES = _known(UNITS), _known(NUMBERS)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, x)
    return (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == x) if len(known) else np.zeros(len(x), dtype=bool)


class Templates:
    """Template tokens of a block of texts: ``tokens`` are hashes of placeholders or literal words, ``slots`` the values of placeholders (0 for literals)."""

    def __init__(self, texts: list[bytes]):
        buf = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        kind = _KIND[buf]
        change = np.flatnonzero(np.diff(kind, prepend=0, append=0))
        start, end = change[:-1], change[1:]
        word = kind[start] > 0 if len(start) else np.zeros(0, dtype=bool)
        start, end = start[word], end[word]
        lower = _LOWER[buf]
        if len(buf) > 1:  # capitals of the Latin-1 supplement
            high = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
            lower[1:][high] += 32
        value = _hashes(lower, start, end - start)
        at = np.cumsum([0] + [len(t) + 1 for t in texts])
        bounds = np.searchsorted(start, at)
        opening = np.zeros(len(start), dtype=bool)
        opening[bounds[:-1][bounds[:-1] < len(start)]] = True
        number = (kind[start] == 2) | _among(value, _NUMBER_HASHES) if len(start) else np.zeros(0, dtype=bool)
        if len(start):
            stops = np.concatenate([[0], np.cumsum(_STOP[buf])])
            gap = np.zeros(len(start), dtype=np.int64)
            gap[1:] = start[1:] - end[:-1]
            opening[1:] |= stops[start[1:]] > stops[end[:-1]]
            upper = ((buf[start] >= 65) & (buf[start] <= 90)) | ((buf[start] == 0xC3) & (lower[np.minimum(start + 1, len(buf) - 1)] != buf[np.minimum(start + 1, len(buf) - 1)]))
            second = np.minimum(start + 1 + (buf[start] == 0xC3), len(buf) - 1)
            title = upper & (end - start >= 2) & (lower[second] == buf[second])
            name = title & ~opening & ~number
            unit = np.zeros(len(start), dtype=bool)
            unit[1:] = _among(value[1:], _UNIT_HASHES) & number[:-1] & ~opening[1:]
            # 1,234.5 is one number
            digits = kind[start] == 2
            joined = np.zeros(len(start), dtype=bool)
            joined[1:] = digits[1:] & digits[:-1] & (gap[1:] == 1) & np.isin(buf[np.maximum(start[1:] - 1, 0)], list(b".,"))
            # New York is one name, twenty five one number
            apart = np.concatenate([[True], (gap[1:] != 1) | ~np.isin(buf[np.maximum(start[1:] - 1, 0)], list(b" -"))]) | opening
            name &= ~unit
            joined[1:] |= ~apart[1:] & (name[1:] & name[:-1] | number[1:] & number[:-1] & ~(digits[1:] & digits[:-1]))
            joined[bounds[:-1][bounds[:-1] < len(start)]] = False
            self.plain, self.plain_bounds = mix(value), bounds
            kept = np.flatnonzero(~joined)
            value = mix(np.add.reduceat(value * (np.uint64(1) + joined.astype(np.uint64) * np.uint64(2)), kept)) if joined.any() else mix(value)
            number, name, unit = number[kept], name[kept], unit[kept]
            bounds = np.searchsorted(kept, bounds)
            self.tokens = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, value)))
            self.slots = np.where(number | unit | name, value, np.uint64(0))
        else:
            self.tokens = self.slots = self.plain = np.zeros(0, dtype=np.uint64)
            self.plain_bounds = bounds
        self.bounds = bounds
        self.literal = np.concatenate([[0], np.cumsum(self.slots == 0)])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k tokens (those across texts too), and which hold enough literal words."""
        h = grams(self.tokens, k)
        return h, (self.literal[k : k + len(h)] - self.literal[: len(h)] >= min(LITERALS, k))

    def kinds(self) -> list[tuple]:
        """(plain, windows, slots, bounds) of the template tokens and of the plain words."""

        def plain(k: int) -> tuple[np.ndarray, np.ndarray]:
            h = grams(self.plain, k, 1)
            return h, np.ones(len(h), dtype=bool)

        return [(False, self.windows, self.slots, self.bounds), (True, plain, np.zeros(len(self.plain), dtype=np.uint64), self.plain_bounds)]


_ROW = "h long, _id long, at int, slots binary"


def _rows(lengths: list[int], known: np.ndarray | None):
    """Windows of these lengths; only those whose hashes are ``known``, if given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["_id"].astype("Int64")
            for first, texts in blocks(utf8(t) for t in b["_text"]):
                t = Templates(texts)
                for k, (_, windows, slots, bounds) in ((k, kind) for k in lengths for kind in t.kinds()):
                    h, good = windows(k)
                    if known is not None:
                        good &= _among(h, known)
                    at = np.flatnonzero(good)
                    doc = np.searchsorted(bounds, at, side="right") - 1
                    inside = at + k <= bounds[doc + 1] if len(at) else np.zeros(0, dtype=bool)
                    at, doc = at[inside], doc[inside]
                    if len(at):
                        yield pd.DataFrame({"h": h[at].view(np.int64), "_id": ids.iloc[first + doc].array, "at": (at - bounds[doc]).astype(np.int32), "slots": [slots[i : i + k].tobytes() for i in at]})

    return shared.lean(run)


def _items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for item, text in zip(b["item_id"], b["_text"]):
            t = Templates([utf8(text)])
            for plain, windows, slots, _ in t.kinds():
                n = len(slots)
                k = min(WINDOW, n)
                if k >= SHORTEST:
                    h, good = windows(k)
                    out += [(int(np.int64(h[i].view(np.int64))), item, plain, int(i), n, k, slots[i : i + k].tobytes()) for i in np.flatnonzero(good)]
        yield pd.DataFrame(out, columns=["h", "item_id", "plain", "item_at", "item_tokens", "k", "item_slots"])


def _chain(rows: list[tuple], base: int) -> tuple[int, bool]:
    """Covered tokens, and whether a slot's value differs, of the windows that fit in order beside those of the diagonal ``base``."""
    there: dict[int, int] = {}
    back: dict[int, int] = {}
    places: list[int] = []  # covered tokens of the item, and the document's beside them
    partner: list[int] = []
    differs = False
    for item_at, at, k, pairs in sorted(rows, key=lambda r: (abs(r[1] - r[0] - base), r[0], r[1])):
        lo, hi = bisect_left(places, item_at), bisect_left(places, item_at + k)
        if (lo and partner[lo - 1] >= at) or (hi < len(places) and partner[hi] < at + k) or any(y - x != at - item_at for x, y in zip(places[lo:hi], partner[lo:hi])):
            continue
        if all(there.get(x, y) == y and back.get(y, x) == x for x, y in pairs) and len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(set(pairs)):
            there.update(pairs)
            back.update((y, x) for x, y in pairs)
            differs |= any(x != y for x, y in pairs)
            places[lo:hi] = range(item_at, item_at + k)
            partner[lo:hi] = range(at, at + k)
    return len(places), differs


def _aligned(found: pd.Series) -> pd.DataFrame:
    """How many tokens of the item the best chain of consistent windows covers, and whether a slot's value differs."""
    best = []
    for rows in found:
        read = []
        for r in rows:
            a, b = np.frombuffer(r["item_slots"], dtype=np.uint64), np.frombuffer(r["slots"], dtype=np.uint64)
            read.append((r["item_at"], r["at"], len(a), [(int(x), int(y)) for x, y in zip(a, b) if x]))
        best.append(max((_chain(read, d) for d in sorted({r[1] - r[0] for r in read})), key=lambda c: (c[0], not c[1])))
    return pd.DataFrame(best, columns=["matched", "reparameterised"])


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text", key: str = "doc_id", filter_size: int = FILTER) -> DataFrame:
    """(doc_id, item_id, matched_tokens, item_tokens, coverage, reparameterised) of each leaked item in each document."""
    tables = shared.SharedTables(docs.sparkSession, "templates")
    rows = shared.exact(docs, key, text).select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).where("_text is not null")
    items = shared.exact(benchmark, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("_text")).where("_text is not null")
    index = tables.keep(items.mapInPandas(shared.lean(_items), "h long, item_id long, plain boolean, item_at int, item_tokens int, k int, item_slots binary"))
    lengths = sorted(r[0] for r in index.select("k").distinct().collect()) or [WINDOW]
    known = None
    if index.count() <= filter_size:
        hashes = index.select("h").distinct().toPandas()["h"].to_numpy(dtype=np.int64)
        known = np.sort(hashes.view(np.uint64))
    found = rows.mapInPandas(_rows(lengths, known), _ROW).join(index, "h").where(F.octet_length("slots") == F.octet_length("item_slots"))
    # Two grids of diagonals, so that any DRIFT of them lie in one cell of a grid.
    cell = F.floor((F.col("at") - F.col("item_at") + F.col("_grid") * DRIFT) / (2 * DRIFT))
    cells = found.withColumn("_grid", F.explode(F.array(F.lit(0), F.lit(1)))).groupBy("_id", "item_id", "plain", "item_tokens", "_grid", cell.alias("_cell"))
    checked = cells.agg(F.collect_set(F.struct("item_at", "at", "item_slots", "slots")).alias("found")).withColumn("_a", F.pandas_udf(_aligned, "matched long, reparameterised boolean")("found"))
    leaked = checked.where(F.col("_a.matched") >= F.lit(coverage) * F.col("item_tokens"))
    part = F.round(F.col("_a.matched") / F.col("item_tokens"), 6)
    best = leaked.groupBy("_id", "item_id").agg(F.max(F.struct(part.alias("part"), (~F.col("_a.reparameterised")).alias("same"), F.col("_a.matched").alias("m"), F.col("item_tokens").cast("long").alias("n"))).alias("b"))
    return best.select(
        F.col("_id").alias("doc_id"),
        "item_id",
        F.col("b.m").alias("matched_tokens"),
        F.col("b.n").alias("item_tokens"),
        F.col("b.part").alias("coverage"),
        (~F.col("b.same")).alias("reparameterised"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
