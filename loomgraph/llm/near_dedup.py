r"""MinHash near-dedup with HyperMinHash registers.

A document's set is its distinct word shingles.  Texts with equal sets are one
class, and only the class's smallest id goes on.  A representative's set becomes
128 registers: a hash picks the bucket, and the bucket's least remainder is
stored as its count of leading zeros and ten mantissa bits.  Four registers form
a band, 32 bands a document; with similarity 0.8 a pair shares no band with
probability 5e-8.  Candidates first pass the collision-corrected estimate of
their Jaccard index and are then confirmed on full sets.

No group is expanded into its pairs.  Sizes travel with the rows of a group, and
a row stays only while its group holds a set of a like size in another component
(told by classes of sizes, a few a group).  First every member of a band group is
compared with the group's smallest id (one pair a row), and the confirmed links
are contracted to components.  Groups that hold several components yet are
looked at again.  Groups over ``HOT`` rows come from shingles that many documents
share; their documents take an exact way instead, a prefix filter: a linked pair
must share one among the first fifth of its shingles in any order that all sets
follow, and theirs puts the rarest first (by the counts of 2**18 classes of
hashes, a table of fixed size), so that common lines bring nobody together.  In a few rounds those
of a group that share a MinHash (another one each round) are compared with the
first of them, which gathers copies; what is still apart after that is joined by
classes of sizes, a group's largest component with what lies outside it only, and
a pair with several groups in the first of them.  Pairs are compared on full sets
only if their sizes, 1024-bit parity maps and registers allow the similarity; the
maps are exact: a bit that differs is an element that differs.

Texts become registers and sets in Python, a megabyte of them at a time; pairs
are made, estimated and confirmed by DataFrame functions, one row at a time.

Components are found by alternating large-star and small-star rounds; every
round is written to the shared folder.  Links, components and sketches never
reach the driver.

Defined results: null and empty texts and texts without words have no shingles,
are linked with nothing and kept; with fewer words than a shingle has, the whole
sequence is one; rows that repeat an id count as that one document; rows with a
null id have no component and are kept; an empty table gives no rows; other
columns do not matter; a text of any length is one set, held once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .textwords import Words, blocks, grams, mix, utf8

BUCKETS = 128
ROWS = 4
MANTISSA = 10
HOT = 48
#: Rounds in which members of a group that share a MinHash are compared with one of them.
LEADS = 1
#: Standard errors that an estimate may lie under the threshold.
SLACK = 6.0
#: Bits of a shingle's class: how often each class occurs orders the prefix filter.
SKETCH = 18
#: Tables of classes that are added up at once.
FAN = 16
#: Classes of sizes within the ratio of two like sets, and the ratios that a class of the last join spans.
FINE = 3
SPAN = 2
#: Longs of a set's parity map.
LONGS = 16
#: No remainder fell into the bucket.
_EMPTY = np.uint16(0xFFFF)
_EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(57)
#: The lowest bit of each of a long's four registers.
_LANES = 0x0001000100010001


def shingle_blocks(texts: list[bytes], k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The sorted distinct shingle hashes of consecutive texts, with the first one's position."""
    for first, block in blocks(texts):
        words = Words(block, lower=True)
        hashes = words.hashes()
        every = grams(hashes, k)
        out = []
        for s, e in zip(words.bounds[:-1], words.bounds[1:]):
            if e - s >= k:
                out.append(np.unique(every[s : e - k + 1]))
            elif e > s:
                out.append(grams(hashes[s:e], int(e - s), salt=int(e - s)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        yield first, out


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash: per bucket the leading zeros of its least remainder and the mantissa bits after them."""
    out = np.full(BUCKETS, _EMPTY, dtype=np.uint16)
    at = np.searchsorted(shingles, _EDGES)
    end = np.append(at[1:], len(shingles))
    full = end > at
    rest = shingles[at[full]] << np.uint64(7)
    top = np.maximum(rest, np.uint64(1 << 7))
    zeros = 63 - np.floor(np.log2(top.astype(np.longdouble))).astype(np.int64)
    fraction = (top << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out[full] = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | fraction).astype(np.uint16)
    return out


def collision(regs: np.ndarray) -> float:
    """How likely a full register equals another one of an unequal remainder."""
    full = regs[regs != _EMPTY]
    return float((0.5 ** ((full >> MANTISSA) + 1.0)).mean()) / (1 << MANTISSA) if len(full) else 0.0


def parity(shingles: np.ndarray) -> np.ndarray:
    """A bit for each of 1024 classes of hashes: whether an odd number of shingles falls into it."""
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (64 * LONGS - 1), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def least(shingles: np.ndarray) -> np.ndarray:
    """The MinHash of each round."""
    salts = mix(np.arange(1, LEADS + 1, dtype=np.uint64))
    return np.array([mix(shingles ^ s).min() if len(shingles) else 0 for s in salts], dtype=np.uint64).view(np.int64)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One key for each band that has a full register."""
    bands = regs.reshape(-1, ROWS)
    full = (bands != _EMPTY).any(axis=1)
    packed = np.ascontiguousarray(bands).view("<u8").ravel()
    return mix(packed + np.arange(len(bands), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[full].view(np.int64)


def _set_lanes(longs: Column) -> Column:
    """How many of the longs' registers have a bit set."""

    def count(z: Column) -> Column:
        for shift in (8, 4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(_LANES))

    return F.aggregate(longs, F.lit(0), lambda n, z: n + count(z))


def estimate(a: str, b: str) -> tuple[Column, Column]:
    """Collision-corrected Jaccard estimate of two rows' registers (columns regs, free, chance with these endings), and the registers that it rests on."""
    used = F.lit(BUCKETS) - F.aggregate(F.zip_with(f"free{a}", f"free{b}", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda n, z: n + z)
    same = used - _set_lanes(F.zip_with(f"regs{a}", f"regs{b}", lambda x, y: x.bitwiseXOR(y)))
    chance = (F.col(f"chance{a}") + F.col(f"chance{b}")) / 2
    return F.greatest(F.lit(0.0), (same / F.greatest(F.lit(1), used) - chance) / (1 - chance)), used


def _sketch(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["_id"].astype("Int64")
            for first, found in shingle_blocks([utf8(t) for t in b["_text"]], k):
                n, s1, s2, bands = [], [], [], []
                for x in found:
                    n.append(len(x))
                    s1.append(np.add.reduce(mix(x)).astype(np.uint64).view(np.int64) if len(x) else 0)
                    s2.append(np.add.reduce(mix(x ^ np.uint64(0x5851F42D4C957F2D))).astype(np.uint64).view(np.int64) if len(x) else 0)
                    bands.append(band_keys(registers(x)))
                yield pd.DataFrame({"_id": ids.iloc[first : first + len(n)].array, "n": n, "s1": s1, "s2": s2, "bands": bands})

    return shared.lean(run)


_SETS = "_id long, n long, bits array<long>, mins array<long>, regs array<long>, free array<long>, chance double, set array<long>"


def _sets(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["_id"].to_numpy()
            for first, found in shingle_blocks([utf8(t) for t in b["_text"]], k):
                regs = [registers(x) for x in found]
                yield pd.DataFrame(
                    {
                        "_id": ids[first : first + len(found)],
                        "n": [len(x) for x in found],
                        "bits": [parity(x) for x in found],
                        "mins": [least(x) for x in found],
                        "regs": [r.view(np.int64) for r in regs],
                        "free": [np.packbits(r == _EMPTY).view(np.int64) for r in regs],
                        "chance": [collision(r) for r in regs],
                        "set": [x.view(np.int64) for x in found],
                    }
                )

    return shared.lean(run)


_CLASSES = "classes binary, counts binary"


def _classes_of(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - SKETCH)).astype(np.int32)


def _class_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each class of hashes occurs in a task's sets: one row."""
    counts = np.zeros(1 << SKETCH, dtype=np.int64)
    for b in batches:
        for x in b["set"]:
            np.add.at(counts, _classes_of(np.asarray(x, dtype=np.int64)), 1)
    some = np.flatnonzero(counts)
    yield pd.DataFrame({"classes": [some.astype(np.int32).tobytes()], "counts": [counts[some].tobytes()]})
    shared.release()


def _class_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    counts = np.zeros(1 << SKETCH, dtype=np.int64)
    for c, n in zip(rows["classes"], rows["counts"]):
        counts[np.frombuffer(c, dtype=np.int32)] += np.frombuffer(n, dtype=np.int64)
    some = np.flatnonzero(counts)
    return pd.DataFrame({"classes": [some.astype(np.int32).tobytes()], "counts": [counts[some].tobytes()], "part": [key[0]]})


def _rarest(counts: np.ndarray, percent: int):
    """The prefix of each set: one shingle more than may be missing in a linked one, those of rare classes first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = []
            for x in b["set"]:
                h = np.asarray(x, dtype=np.int64)
                size = len(h) - -(-len(h) * percent // 100) + 1
                keys.append(h[np.lexsort((h, counts[_classes_of(h)]))[:size]])
            yield pd.DataFrame({"_id": b["_id"], "n": b["n"], "keys": keys})

    return shared.lean(run)


class NearDedup:
    """One run over a table of documents."""

    def __init__(self, docs: DataFrame, k: int, percent: int, text: str = "text", key: str = "doc_id"):
        self.spark = docs.sparkSession
        self.tables = shared.SharedTables(self.spark, "near")
        self.docs = shared.exact(docs, key, text).select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
        self.k, self.percent = k, percent

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept of every row."""
        sketch = self.tables.keep(self.docs.mapInPandas(_sketch(self.k), "_id long, n long, s1 long, s2 long, bands array<long>"))
        classes = sketch.where("n > 0 and _id is not null").groupBy("n", "s1", "s2").agg(F.min("_id").alias("rep"))
        classes = self.tables.keep(classes)
        owners = sketch.join(classes, ["n", "s1", "s2"]).where(F.col("_id") == F.col("rep"))
        rows = owners.select(F.explode("bands").alias("key"), "_id", "n")
        groups = rows.groupBy("key").agg(F.count("*").alias("rows"), F.min("_id").alias("lead")).where("rows > 1 and lead is not null")
        held = self.tables.keep(rows.join(groups, "key").withColumn("comp", F.col("_id")))
        held = self.partnered(held)
        self.tables.drop(self.tables.count - 1)
        needed = held.select("_id").distinct()
        self.sets = self.tables.keep(self.docs.join(needed, "_id", "left_semi").mapInPandas(_sets(self.k), _SETS))
        firsts = held.where("_id = lead").select("key", F.col("n").alias("m"))
        links = self.confirmed(held.where("_id != lead").join(firsts, "key").where(self.sized("n", "m")).select(F.col("lead").alias("a"), F.col("_id").alias("b")).distinct())
        comps = self.components(links)
        mixed = self.mixed(held.select("key", "_id", "n", "rows"), comps)
        first = self.tables.count
        small = mixed.where(F.col("rows") <= HOT).select("key", "_id", "n")
        hot = mixed.where(F.col("rows") > HOT).select("_id").distinct()
        rows = self.tables.keep(small.union(self.prefixes(hot)))
        for number in range(first, self.tables.count):
            self.tables.drop(number)
        for turn in range(LEADS + 1):
            open_rows = self.mixed(rows, comps)
            if open_rows.isEmpty():
                break
            at = self.tables.count
            found = self.confirmed(self.leads(open_rows, turn) if turn < LEADS else self.across(open_rows))
            self.tables.drop(at)
            if not found.isEmpty():
                links = links.union(found)
                comps = self.components(links)
        whole = sketch.select("_id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left")
        whole = whole.join(comps.withColumnRenamed("_id", "rep"), "rep", "left")
        component = F.when(F.col("_id").isNotNull(), F.coalesce("comp", "rep", "_id"))
        return whole.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))

    def mixed(self, rows: DataFrame, comps: DataFrame) -> DataFrame:
        """``rows`` with comp, of the keys that hold several components; without partners of a like size they go."""
        return self.partnered(rows.join(comps, "_id", "left").withColumn("comp", F.coalesce("comp", "_id")))

    def level(self, n: str) -> Column:
        """The logarithm of a size: sets of like sizes differ by less than one."""
        return F.log(F.col(n).cast("double")) / max(1e-6, 1.001 * math.log(100 / self.percent))

    def partnered(self, rows: DataFrame) -> DataFrame:
        """The rows (key, n, comp) whose key holds a row of another component and of a like size."""
        rows = rows.withColumn("_z", F.floor(FINE * self.level("n")))
        sizes = rows.groupBy("key", "_z").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        keys = sizes.groupBy("key").agg(F.collect_list(F.struct("_z", "lo", "hi")).alias("_near"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi")
        other = lambda s: (F.abs(s["_z"] - F.col("_z")) <= FINE) & ((s["lo"] != F.col("comp")) | (s["hi"] != F.col("comp")))
        return self.tables.keep(rows.join(keys.select("key", "_near"), "key").where(F.exists("_near", other)).drop("_near", "_z"))

    def sized(self, n: str, m: str) -> Column:
        """Whether sets of these sizes can be so alike."""
        return 100 * F.least(n, m) >= self.percent * F.greatest(n, m)

    def alike(self, n: str, m: str, differ: Column) -> Column:
        """Whether sets of these sizes can be so alike if ``differ`` elements at least are in one of them only: the union has (n + m + differ) / 2 then."""
        return 100 * (F.col(n) + F.col(m) - differ) >= self.percent * (F.col(n) + F.col(m) + differ)

    def sided(self, rows: DataFrame, mark: str, *more: str | Column) -> DataFrame:
        """One side of a join of a key's rows, with sizes and parity maps."""
        bits = self.sets.select("_id", F.col("n").alias(f"n{mark}"), *[F.col("bits")[i].alias(f"{mark}{i}") for i in range(LONGS)])
        return rows.select("key", "_id", F.col("comp").alias(f"c{mark}"), *more).join(bits, "_id").withColumnRenamed("_id", mark)

    def paired(self, x: DataFrame, y: DataFrame, also: Column, last: Callable[[], Column] = lambda: F.lit(True)) -> DataFrame:
        """Pairs (a, b) of a key's rows in different components that can be links."""
        differ = sum((F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(1, LONGS)), F.bit_count(F.col("x0").bitwiseXOR(F.col("y0"))))
        pairs = x.join(y, (x["key"] == y["key"]) & (F.col("cx") != F.col("cy")) & also & self.sized("nx", "ny") & self.alike("nx", "ny", differ) & last())
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def leads(self, rows: DataFrame, turn: int) -> DataFrame:
        """Pairs of each row and the first one of its key with the same MinHash."""
        rows = rows.join(self.sets.select("_id", F.col("mins")[turn].alias("m")), "_id")
        lead = rows.groupBy("key", "m").agg(F.min(F.struct("_id", "comp", "n")).alias("l"), F.count("*").alias("c")).where("c > 1")
        pairs = rows.join(lead.select("key", "m", F.col("l._id").alias("y"), F.col("l.comp").alias("cy"), F.col("l.n").alias("ny")), ["key", "m"])
        return pairs.where(F.col("comp") != F.col("cy")).where(self.sized("n", "ny")).select(F.col("y").alias("a"), F.col("_id").alias("b")).distinct()

    def across(self, rows: DataFrame) -> DataFrame:
        """Pairs of a key's rows in different components and of like sizes; its largest component is never paired within itself."""
        sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("c"))
        major = self.tables.keep(sizes.groupBy("key").agg(F.max_by("comp", F.struct("c", F.col("comp"))).alias("major")))
        # A row has few keys: its rarest shingles and its bands.
        own = self.tables.keep(rows.groupBy("_id").agg(F.collect_set("key").alias("own")))
        rows = rows.join(major, "key").join(own, "_id")
        x, y = self.sided(rows.where("comp != major"), "x", F.col("own").alias("ox")), self.sided(rows, "y", "major", F.col("own").alias("oy"))
        # Classes of sizes split a key's rows; the smaller side goes to each class that sets of like sizes may lie in.
        at = lambda n, more: F.floor((self.level(n) + more) / SPAN)
        x, y = x.withColumn("zx", F.explode(F.sequence(at("nx", -1), at("nx", 1)))), y.withColumn("zy", at("ny", 0))
        once = ((F.col("cy") == F.col("major")) | (F.col("x") < F.col("y"))) & (F.col("zx") == F.col("zy"))
        return self.paired(x, y, once, lambda: F.array_min(F.array_intersect("ox", "oy")) == x["key"])

    def prefixes(self, hot: DataFrame) -> DataFrame:
        """(key, _id, n): the shingles of which a linked pair must share one, rarest first."""
        sets = self.tables.keep(self.sets.join(hot, "_id").select("_id", "n", "set"))
        parts = sets.rdd.getNumPartitions()
        sums = self.tables.keep(sets.mapInPandas(_class_counts, _CLASSES).withColumn("part", F.spark_partition_id()))
        while parts > FAN:
            sums = self.tables.keep(sums.groupBy(F.floor(F.col("part") / FAN).cast("int").alias("part")).applyInPandas(_class_sums, f"{_CLASSES}, part int"))
            parts = -(-parts // FAN)
        counts = np.zeros(1 << SKETCH, dtype=np.int64)
        for r in sums.toLocalIterator():
            counts[np.frombuffer(r["classes"], dtype=np.int32)] += np.frombuffer(r["counts"], dtype=np.int64)
        return sets.mapInPandas(_rarest(counts, self.percent), "_id long, n long, keys array<long>").select(F.explode("keys").alias("key"), "_id", "n")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are links, as a table: by sizes, parity maps and estimates first, then by full sets."""
        light, side = ("n", "bits", "regs", "free", "chance"), lambda cols, mark: self.sets.select(F.col("_id").alias(mark), *[F.col(c).alias(f"{c}_{mark}") for c in cols])
        share = self.percent / 100
        near, used = estimate("_a", "_b")
        differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, z: n + z)
        rest = F.greatest(F.lit(1), used)
        likely = near >= share - SLACK * F.sqrt(share * (1 - share) / rest) - 1 / rest
        maybe = pairs.join(side(light, "a"), "a").join(side(light, "b"), "b").where(self.sized("n_a", "n_b")).where(self.alike("n_a", "n_b", differ)).where(likely)
        at = self.tables.count + 1
        maybe = self.tables.keep(maybe.select("a", "b"))
        whole = maybe.join(side(("n", "set"), "a"), "a").join(side(("n", "set"), "b"), "b")
        out = self.tables.keep(whole.where((100 + self.percent) * F.size(F.array_intersect("set_a", "set_b")) >= self.percent * (F.col("n_a") + F.col("n_b"))).select("a", "b"))
        self.tables.drop(at)
        return out

    def components(self, links: DataFrame) -> DataFrame:
        """(_id, comp) of every id that has a link; comp is the smallest id reachable."""
        edges, before = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), None
        last, rows = None, links.count()
        while True:
            both = edges.union(edges.select("v", "u"))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u")
            small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).where("u != v").distinct()
            edges = self.tables.keep(small, rows)
            if last:
                self.tables.drop(last)
            last = self.tables.count
            state = tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.countDistinct("u")).collect()[0])
            # A star forest that another round leaves alone: every node has one parent.
            if state == before and state[0] == state[2]:
                break
            before, rows = state, state[0]
        roots = edges.select(F.col("v").alias("_id"), F.col("v").alias("comp")).distinct()
        return edges.select(F.col("u").alias("_id"), F.col("v").alias("comp")).union(roots)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard index of ``percent`` in a hundred at least."""
    return NearDedup(docs, k, percent, text, key).run()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.documents(spark, sf_dir), k=4)


SQL = None
