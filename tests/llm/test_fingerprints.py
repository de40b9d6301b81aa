import hashlib
import random

from pyspark.sql import functions as F

from loomgraph.llm import multiset_hash as M

from .conftest import ODD


def brute(rows):
    """(doc_id, n_chars, edited sha) in order of (id, text), nulls first."""
    rows = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        cut = len(t) // 4
        after = rows[(k + 1) % len(rows)][1]
        out.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, r[1], r[2])


def test_edits_and_equality(spark, folder, documents):
    rows = ODD + [(20 + i, f"paragraph {i % 5}\nand another line {i % 3}\nmore words, all the same.") for i in range(60)]
    got = M.query(spark, folder(documents(rows, extra=True))).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=key) == sorted(brute(rows), key=key)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    text = dict(reversed([(i, t or "") for i, t in rows]))
    by_print = {}
    for r in got:
        if r.doc_id is not None:
            by_print.setdefault(r.fingerprint, set()).add(text[r.doc_id])
    assert all(len(v) == 1 for v in by_print.values()) and len(by_print) == len({t for i, t in text.items() if i is not None})


def test_single_and_empty(spark, folder, documents, tmp_path):
    one = M.query(spark, folder(documents([(5, "abcdefgh")]))).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    documents([]).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert M.query(spark, f"{tmp_path}/none").count() == 0


def test_homomorphic(spark):
    texts = [("a", "one line, here\nsecond line e.\nthird"), ("b", "third\none line, here\nsecond line e."), ("c", "one line, here\nsecond line e."), ("d", "third"), ("e", "third\nthird")]
    df = M.fingerprints(spark.createDataFrame(texts, "k string, text string")).select("k", F.struct("exact", M.lanes(F.col("counts")).alias("lanes")).alias("f"))
    got = {r.k: r.f for r in df.collect()}
    assert got["a"] == got["b"] and got["d"] != got["e"]
    pairs = spark.createDataFrame([(got["c"], got["d"], got["a"])], f"x {df.schema['f'].dataType.simpleString()}, y {df.schema['f'].dataType.simpleString()}, z {df.schema['f'].dataType.simpleString()}")
    row = pairs.select(M.combine(F.col("x"), F.col("y")).alias("p"), M.combine(F.col("z"), F.col("y"), True).alias("m")).collect()[0]
    assert row.p == got["a"] and row.m == got["c"]


def test_likeness_orders_edits(spark, folder, documents, sf):
    got = M.query(spark, sf).where("n_chars > 1000").agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).collect()[0]
    assert got.e > 0.6 > 0.25 > got.n


def test_every_edited_text_is_near(spark, folder, documents):
    """Three quarters stay, so each document is like its edit, whatever its marks and line ends are."""
    rng = random.Random(5)
    plain = lambda n: [f"{rng.choice('bcdfgk')}{rng.randrange(10_000)}" for _ in range(n)]
    rows = [(i, " ".join(plain(300))) for i in range(8)]
    rows += [(10 + i, " ".join(f"{w} {m}" for w in plain(200))) for i, m in enumerate(("$$$", "***", "&&&"))]
    rows += [(20, "\t".join(plain(300))), (21, "".join(chr(0x4E00 + rng.randrange(5_000)) for _ in range(400))), (22, "".join(plain(300)))]
    got = M.query(spark, folder(documents(rows))).collect()
    assert len(got) == len(rows) and all(r.near_edited > 0.4 for r in got), sorted((r.near_edited, r.doc_id) for r in got)[:3]
    assert all(r.near_next < 0.4 for r in got if r.doc_id < 9)


def test_next_row_over_many_buckets(spark, documents):
    """The next row is found whatever the buckets are: few, many, empty ones between, repeated and null ids."""
    rng = random.Random(7)
    rows = [(i, f"t{k}") for k, i in enumerate(rng.sample(range(1000), 150))] + [(10**12 + i, f"far{i}") for i in range(40)] + [(5, "a"), (5, "b"), (5, "b"), (None, "x"), (None, None)]
    want = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for coarse, most in ((384, 20_000), (4, 5), (1, 3), (7, 1)):
        got = sorted(M.with_next(documents(rows).select("doc_id", "text"), coarse, most).collect(), key=lambda r: r.key)
        assert [(r.doc_id, r.text) for r in got] == want
        assert [r.next_text for r in got] == [t for _, t in want[1:]] + [want[0][1]]
        assert [r.next_key for r in got] == [r.key for r in got[1:]] + [got[0].key]


def test_lanes_against_plain_sums(spark):
    """Exact lanes and signed lanes of whole texts, one paragraph, pair and bit at a time."""
    texts = ["one two\nthree four five", "", "a", "tab\tand  blanks \n\nend", "x" * 60, "same same same\nsame same"]
    hashes = lambda rows, *seeds: {r.p: list(r.h) for r in spark.createDataFrame([(p,) for p in rows], "p string").select("p", F.array(*[F.xxhash64(F.lit(s), "p") for s in seeds]).alias("h")).collect()}
    got = {r.text: r for r in M.fingerprints(spark.createDataFrame([(t, t) for t in texts], "k string, text string")).select(F.col("k").alias("text"), "exact", M.lanes(F.col("counts")).alias("lanes")).collect()}
    exact = hashes({p for t in texts for p in t.split("\n")}, *range(M.EXACT))
    pairs = set()
    words = {}
    for t in texts:
        cut = []
        for w in ("\n " + t.replace("\t", " ").replace("\n", " \n ") + " \n").split(" "):
            cut += [w[i : i + M.LONGEST] for i in range(0, len(w), M.LONGEST)] or [""]
        words[t] = cut
        pairs.update(zip(cut[:-1], cut[1:]))
    found = spark.createDataFrame(list(pairs), "a string, b string").select("a", "b", F.xxhash64(F.lit(101), "a", "b").alias("x"), F.xxhash64(F.lit(202), "a", "b").alias("y")).collect()
    bits = {(r.a, r.b): (r.x, r.y) for r in found}
    for t in texts:
        low = [sum(exact[p][i] & (1 << 30) - 1 for p in t.split("\n")) % (1 << 30) for i in range(M.EXACT)]
        high = [sum(exact[p][i] >> 32 & (1 << 30) - 1 for p in t.split("\n")) % (1 << 30) for i in range(M.EXACT)]
        assert list(got[t].exact) == [x for pair in zip(low, high) for x in pair]
        lanes = []
        for up in (0, 31):
            for j in range(M.SUMS):
                lanes.append(sum(1 if bits[p][j % M.HASHES] >> (j // M.HASHES + up) & 1 else -1 for p in zip(words[t][:-1], words[t][1:])) % (1 << 24))
        assert list(got[t].lanes) == lanes
