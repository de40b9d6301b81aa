import hashlib
import itertools
import random
import re

from loomgraph.llm import line_dedup, near_dedup, substring_dedup

from .conftest import ODD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(text, k):
    w = WORDS.findall(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset({tuple(w)}) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def components(rows, k=4, percent=80):
    sets, parent = {}, {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, k))
            parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        for x, y in itertools.product(sets[a], sets[b]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a2, b2 = find(a), find(b)
                parent[max(a2, b2)] = min(a2, b2)
    return {i: find(i) for i in sets}


def near_rows(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 8, 30, 120]))] for _ in range(25)]
    common = " ".join(rng.choice(vocab) for _ in range(40))
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        text = " ".join(words)
        rows.append((i * 3, (common + " " + text) if i % 4 == 0 else text.upper() if i % 7 == 0 else text))
    return rows


def test_near_dedup(spark, folder, documents):
    for seed in (1, 2):
        rows = near_rows(seed)
        got = {r.doc_id: r for r in near_dedup.near_duplicates(documents(rows, extra=True), k=4).collect()}
        want = components(rows)
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.kept == (i == want[i]) for i, r in got.items())
        assert all(r.n_shingles == len(shingles(dict(rows)[i], 4)) for i, r in got.items())


def test_near_dedup_hot_groups(spark, documents, monkeypatch):
    """Groups over the limit take the prefix filter: the same links."""
    monkeypatch.setattr(near_dedup, "HOT", 3)
    rows = near_rows(5, 200)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(rows), k=4).collect()}
    assert got == components(rows)


def test_rows_without_partners_go(spark, documents):
    """A key's rows stay while it holds a set of a like size in another component; far sizes are not carried on."""
    rng = random.Random(8)
    rows = [(rng.randrange(12), i, max(1, int(1.3 ** rng.uniform(0, 30)))) for i in range(150)]
    comps = {i: min(i, i - i % 3) for _, i, _ in rows if i % 5}
    run = near_dedup.NearDedup(documents([]), k=4, percent=80)
    frame = spark.createDataFrame(rows, "key long, _id long, n long")
    got = {(r.key, r._id): r.comp for r in run.mixed(frame, spark.createDataFrame(list(comps.items()), "_id long, comp long")).collect()}
    partners = lambda row, ratio: any(k == row[0] and comps.get(j, j) != comps.get(row[1], row[1]) and min(m, row[2]) >= ratio * max(m, row[2]) for k, j, m in rows)
    assert {r[:2] for r in rows if partners(r, 0.8)} <= set(got) <= {r[:2] for r in rows if partners(r, 0.8**1.4)} != {r[:2] for r in rows}
    assert all(c == comps.get(i, i) for (_, i), c in got.items())


def test_near_dedup_at_the_threshold(spark, documents, monkeypatch):
    """Sets within each other, with sizes at, just over and just under the least ratio."""
    rows = []
    for b, sizes in enumerate([(4, 5), (8, 10), (64, 80, 100, 125), (79, 100), (41, 52, 65), (400, 500, 624), (1, 2), (1199, 1500, 1876)]):
        rows += [(b * 10 + i, " ".join(f"b{b}x{w}" for w in range(n + 3))) for i, n in enumerate(sizes)]
    for hot in (near_dedup.HOT, 1):
        monkeypatch.setattr(near_dedup, "HOT", hot)
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(rows), k=4).collect()}
        assert got == components(rows)


def test_near_dedup_odd(spark, folder, documents):
    got = near_dedup.query(spark, folder(documents(ODD, extra=True))).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].kept and by[1][0].n_shingles == 0 and by[2][0].component_id == 2
    assert by[5][0].component_id == 4 and not by[5][0].kept
    assert by[None][0].component_id is None and by[None][0].kept
    assert len(by[6]) == 2 and all(r.component_id == 6 and r.kept for r in by[6])
    assert near_dedup.near_duplicates(documents([])).count() == 0


def estimated(a, b):
    """The estimate of two arrays of registers, one register at a time."""
    pairs = [(int(x), int(y)) for x, y in zip(a, b) if x != near_dedup._EMPTY or y != near_dedup._EMPTY]
    if not pairs:
        return 0.0, 0
    chance = (near_dedup.collision(a) + near_dedup.collision(b)) / 2
    return max(0.0, (sum(x == y for x, y in pairs) / len(pairs) - chance) / (1 - chance)), len(pairs)


def test_registers(spark):
    import numpy as np

    rng = np.random.RandomState(0)
    rows, want = [], []
    for share, n in ((0.5, 4000), (0.8, 4000), (0.95, 4000), (0.8, 60), (0.5, 3), (0.0, 0)):
        a = rng.randint(0, 1 << 62, n).astype(np.uint64) * np.uint64(4)
        b = np.concatenate([a[: int(n * share)], rng.randint(0, 1 << 62, n - int(n * share)).astype(np.uint64) * np.uint64(4)])
        ra, rb = near_dedup.registers(np.unique(a)), near_dedup.registers(np.unique(b))
        near, used = estimated(ra, rb)
        assert n < 4000 or used == near_dedup.BUCKETS and abs(near - share / (2 - share)) < 0.17
        want.append((near, used))
        rows.append([x for r in (ra, rb) for x in (r.view(np.int64).tolist(), np.packbits(r == near_dedup._EMPTY).view(np.int64).tolist(), near_dedup.collision(r))])
    df = spark.createDataFrame(rows, "regs_a array<long>, free_a array<long>, chance_a double, regs_b array<long>, free_b array<long>, chance_b double").coalesce(1)
    got = [tuple(r) for r in df.select(*near_dedup.estimate("_a", "_b")).collect()]
    assert all(abs(g[0] - w[0]) < 1e-9 and g[1] == w[1] for g, w in zip(got, want, strict=True))


def substrings(rows, window=50):
    seen = {}
    for i, t in rows:
        w = WORDS.findall(t or "")
        for at in range(len(w) - window + 1):
            g = tuple(w[at : at + window])
            if i is not None:
                seen[g] = min(seen.get(g, i), i)
    out = []
    for i, t in rows:
        w = WORDS.findall(t or "")
        gone = set()
        for at in range(len(w) - window + 1):
            if i is not None and seen[tuple(w[at : at + window])] < i:
                gone.update(range(at, at + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def substring_rows(seed):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(60)]
    passage = [[rng.choice(vocab) for _ in range(rng.choice([49, 50, 51, 70, 200]))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passage)
            s = rng.randrange(0, 5)
            words += [rng.choice(vocab) for _ in range(rng.randrange(0, 30))] + p[s : len(p) - rng.randrange(0, 5)]
        rows.append((i, " \t".join(words)))
    rows += [(200 + i, "same words " * 60) for i in range(4)]
    return rows


def test_substring_dedup(spark, folder, documents):
    rows = substring_rows(1) + ODD + [(300, "z " * 80), (300, "same words " * 60), (301, "y " * 30 + "same words " * 60)]
    got = substring_dedup.query(spark, folder(documents(rows, extra=True))).collect()
    assert order([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got]) == order(substrings(rows))


def test_substring_texts(spark, documents):
    rows = substring_rows(2)
    got = {r.doc_id: r.text for r in substring_dedup.dedup_substrings(documents(rows)).collect()}
    assert [(i, hashlib.sha256(got[i].encode()).hexdigest()) for i, _ in rows] == [(r[0], r[3]) for r in substrings(rows)]
    assert substring_dedup.dedup_substrings(documents([])).count() == 0


def test_factors(spark, documents):
    """Each factor stands at its place in an earlier document; together they cover the duplicate windows and nothing else."""
    rows = substring_rows(3)
    words = {i: WORDS.findall(t) for i, t in rows}
    covered = {i: set() for i in words}
    for f in substring_dedup.factors(documents(rows)).collect():
        assert f.ref_id < f.doc_id and f.length >= 50
        assert words[f.doc_id][f.start : f.start + f.length] == words[f.ref_id][f.ref_start : f.ref_start + f.length]
        covered[f.doc_id].update(range(f.start, f.start + f.length))
    assert {i: len(c) for i, c in covered.items()} == {r[0]: r[2] for r in substrings(rows)}


def test_a_copied_passage_is_one_factor(spark, documents):
    rng = random.Random(9)
    own = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    passage = own(400)
    rows = [(1, own(30) + passage + own(80)), (2, own(90) + passage[37:361] + own(70)), (3, passage[10:60])]
    got = sorted(tuple(f) for f in substring_dedup.factors(documents([(i, " ".join(w)) for i, w in rows])).collect())
    assert got == [(2, 90, 324, 1, 67), (3, 0, 50, 1, 40)]
    assert substring_dedup.factors(documents([])).count() == 0


SPACES = " \t\n\x0b\x0c\r"


def lines(rows, least=20, docs=3):
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n") if i is not None and t is not None else []:
            k = lower(x.strip(SPACES))
            if len(k) >= least:
                held.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if i is None or not (len(held.get(k := lower(x.strip(SPACES)), ())) >= docs and i < max(held[k]))]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_line_dedup(spark, folder, documents):
    rng = random.Random(4)
    common = ["  All rights reserved by us  ", "all rights reserved BY US", "Exactly twenty chars", "nineteen characters", "ÀLL RIGHTS reserved, yes sir", "\tCookie notice: we use cookies\r"]
    rows = ODD + [(i + 10, "\n".join(rng.choice(common + [f"own line number {i} of text"]) for _ in range(rng.randrange(0, 6)))) for i in range(60)] + [(9, "All rights reserved by us"), (9, "All rights reserved by us")]
    got = line_dedup.query(spark, folder(documents(rows, extra=True))).collect()
    assert order([(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got]) == order(lines(rows))
    out = line_dedup.dedup_lines(documents(rows, extra=True))
    assert [c for c in out.columns if c != "_lines"] == [c for c in documents(rows, extra=True).columns if c != "_lines"]
    assert line_dedup.dedup_lines(documents([])).count() == 0
