import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import language, lm_score, quality

from .conftest import ODD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# ---------------------------------------------------------------- language


def test_language_accuracy(spark, sf):
    got = language.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and lang is not null and n_chars > 100 and lang_pred != 'und'")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).collect()[0]
    assert n > 20 and right >= 0.85


def test_language_odd(spark, folder, documents):
    got = language.query(spark, folder(documents(ODD + [(50 + i, "the quick brown fox and the dog " * 3) for i in range(9)], extra=True))).collect()
    assert len(got) == len(ODD) + 9
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.score <= 1 and (r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1))
    assert by[1][0].lang_pred == by[2][0].lang_pred == by[3][0].lang_pred == "und"
    assert by[4][0].lang_pred == "en" and by[4][0].score == by[5][0].score and len(by[6]) == 2


def test_language_ignores_labels(spark, folder, documents, tmp_path):
    rows = [(i, f"some english words number {i} with text and more") for i in range(30)] + [(30 + i, f"einige deutsche wörter nummer {i} und noch mehr") for i in range(30)]
    base = documents(rows)
    marked = base.withColumn("lang", F.when(F.col("doc_id") < 30, "en").otherwise("de"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    other = marked.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    marked.write.parquet(f"{tmp_path}/a/documents.parquet")
    other.write.parquet(f"{tmp_path}/b/documents.parquet")
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in language.query(spark, f"{tmp_path}/{x}").collect()} for x in "ab")
    assert a == b and all(a[i][0] == ("en" if i < 30 else "de") for i in range(60))


def test_language_empty(spark, folder, documents, tmp_path):
    assert language.query(spark, folder(documents([]))).count() == 0
    documents([(1, "text")]).withColumn("lang", F.lit(None).cast("string")).write.parquet(f"{tmp_path}/u/documents.parquet")
    assert [r.lang_pred for r in language.query(spark, f"{tmp_path}/u").collect()] == ["und"]


def test_binding_keeps_order():
    a, b = language.bundle("abc"), language.bundle("cab")
    assert float(a @ b) < 0.9 and abs(float(a @ language.bundle("ABC")) - 1) < 1e-5


# ---------------------------------------------------------------- language model


def brute_base(rows, mod=7, left=2):
    counts, held = {}, {}
    toks = lambda t: WORDS.findall(lower(t or "")) + [None]
    for k, (i, t) in enumerate(rows):
        held[k] = i is not None and zlib.crc32(str(i).encode()) % mod == left
        if i is not None and not held[k]:
            for w in toks(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for k, (i, t) in enumerate(rows):
        ws = toks(t)
        out.append((i, held[k], len(ws), sum(w in counts for w in ws), n, round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws), 6)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def test_base_scores(spark, folder, documents):
    rng = random.Random(2)
    rows = ODD + [(10 + i, " ".join(rng.choice(["Alpha", "beta", "gamma", f"rare{i}", "the"]) for _ in range(rng.randrange(0, 60)))) for i in range(80)]
    got = lm_score.query(spark, folder(documents(rows, extra=True))).collect()
    assert order([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]) == order(brute_base(rows))
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_model_beats_the_base(spark, sf):
    got = lm_score.query(spark, sf).where("held_out and n_tokens > 20").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).collect()[0]
    assert got.s > got.b


def test_lm_empty(spark, folder, documents):
    assert lm_score.query(spark, folder(documents([]))).count() == 0


def test_windows_carry_the_state():
    rng = np.random.RandomState(0)
    net = lm_score.Network(seed=1)
    texts = [rng.randint(0, lm_score.TOP, n) for n in (1, 5, 300, 64, 65)]
    once = net.score(texts, window=1000, slots=1)
    for window, slots in ((64, 256), (7, 2), (1, 3)):
        assert np.allclose(net.score(texts, window=window, slots=slots), once, atol=1e-3)


def test_probabilities_sum_to_one():
    net = lm_score.Network(seed=2)
    h = np.random.RandomState(1).randn(1, net.hidden).astype(np.float32)
    ids = np.arange(lm_score.TOP + lm_score.GROUPS)
    assert abs((10 ** net.log10_probs(np.repeat(h, len(ids), axis=0), ids)).sum() - 1) < 1e-3


def test_gradients():
    net = lm_score.Network(hidden=6, seed=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.RandomState(3)
    grid = rng.randint(0, lm_score.TOP, (6, 3))
    loss = lambda: -sum(net.log10_probs(np.concatenate(hs), grid[1:].ravel()).sum() for hs in [states()]) * math.log(10) / grid[1:].size

    def states():
        h, out = np.zeros((3, 6)), []
        for ids in grid[:-1]:
            h = net.step(ids, h)[0]
            out.append(h)
        return out

    grads, _ = net._gradients(grid[:-1], grid[1:], np.zeros((3, 6)))
    for name, at in (("u", (2, 7)), ("u", (1, 15)), ("c", (3, 2)), ("x", (int(grid[0, 0]), 4))):
        before, eps = net.p[name][at], 1e-5
        net.p[name][at] = before + eps
        up = loss()
        net.p[name][at] = before - eps
        down = loss()
        net.p[name][at] = before
        assert abs((up - down) / (2 * eps) - grads[name][at]) < 1e-4


def test_all_training_texts_teach(spark, documents, monkeypatch):
    """A pattern that only the highest ids have reaches the network, and every token is learned from."""
    rng = random.Random(4)
    turn = ["zero", "one", "two", "three", "four", "five", "six", "seven"]
    mixed = lambda: " ".join(rng.choice(turn) for _ in range(80))
    cycle = lambda k: " ".join(turn[(k + j) % 8] for j in range(80))
    rows = [(i, mixed()) for i in range(300)] + [(1000 + i, cycle(i)) for i in range(900)]
    train = documents(rows).selectExpr("doc_id AS _id", "text AS _text")
    monkeypatch.setattr(lm_score, "TRAIN_TOKENS", 400)
    monkeypatch.setattr(lm_score, "PART_TOKENS", 50_000, raising=False)
    monkeypatch.setattr(lm_score, "FAN", 1 << 20, raising=False)
    _, vocabulary, network = lm_score.learn(train, lm_score.shared.SharedTables(spark, "t"))
    ids = lambda t: lm_score.model_ids(lm_score.Words([t.encode()], lower=True), vocabulary)[0]
    ordered, shuffled = network.score([ids(cycle(3)), ids(" ".join(sorted(turn * 10)))])
    assert ordered > 0.75 * shuffled
    assert lm_score.teach(train, vocabulary, lm_score.Network()) == vocabulary.total == 1200 * 81


def test_no_sample_teaches(spark, documents, monkeypatch):
    """The network doesn't hang on a number of chosen texts, and each text of every round counts."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(200)]
    train = documents(rows).selectExpr("doc_id AS _id", "text AS _text")
    monkeypatch.setattr(lm_score, "PART_TOKENS", 5_000)

    def weights(tokens):
        monkeypatch.setattr(lm_score, "TRAIN_TOKENS", tokens)
        _, vocabulary, network = lm_score.learn(train, lm_score.shared.SharedTables(spark, "t"))
        return vocabulary, network.flat()

    (vocabulary, few), (_, more) = weights(100), weights(2_000)
    assert np.array_equal(few, more)
    for i in (3, 77, 160):
        network = lm_score.Network()
        network.start_from(vocabulary)
        assert lm_score.teach(train.where(f"_id != {i}"), vocabulary, network) == vocabulary.total - 61
        assert not np.array_equal(network.flat(), few)


def ids_of(text):
    return [int(x) for x in lm_score.word_ids(lm_score.Words([text.encode()], lower=True))]


def plain_score(net, vocabulary, counts, text):
    """log10 probability of a text: one token and one step at a time, every share from the counts by word."""
    f = lambda x: x.astype(np.float64)
    p = {k: f(v) for k, v in net.p.items()}
    n = net.hidden
    ranked = sorted((-c, int(np.uint64(h).view(np.int64)), h) for h, c in counts.items() if c > 1 or h == int(lm_score.END))
    top = {h: k for k, (_, _, h) in enumerate(ranked[: lm_score.TOP])}
    group = lambda h: int(vocabulary.group[h & 0xFF])
    total, kinds = {}, {}
    for h, c in counts.items():
        if h not in top:
            total[group(h)] = total.get(group(h), 0) + c
            kinds[group(h)] = kinds.get(group(h), 0) + 1
    hs = [*ids_of(text), int(lm_score.END)]
    state, before, out = np.zeros(n), lm_score.START, 0.0
    for h in hs:
        a, u = p["x"][before], state @ p["u"]
        sig = lambda x: 1 / (1 + np.exp(-x))
        z, r = sig(a[:n] + u[:n]), sig(a[n : 2 * n] + u[n : 2 * n])
        new = np.tanh(a[2 * n :] + r * u[2 * n :])
        state = new + z * (state - new)
        soft = lambda y: np.exp(y - y.max()) / np.exp(y - y.max()).sum()
        classes = soft(state @ p["c"] + p["cb"])
        if h in top:
            c, k = divmod(top[h], lm_score.TOP // lm_score.TOP_CLASSES)
            out += math.log10(classes[c] * soft(state @ p["w"][c] + p["wb"][c])[k])
            before = top[h]
        else:
            g = group(h)
            share = (counts[h] - vocabulary.discount) / total[g] if h in counts else vocabulary.discount * kinds[g] / total[g] if g in total else 1.0
            out += math.log10(classes[lm_score.TOP_CLASSES + g] * share)
            before = lm_score.TOP + g
    return out


def test_scores_step_by_step(spark, documents, monkeypatch):
    """Whole texts, rare and unknown words too, against a plain network; how many words travel with the function changes nothing."""
    rng = random.Random(12)
    word = lambda: rng.choice(["the", "a", "of"]) if rng.random() < 0.4 else f"w{int(rng.expovariate(0.004))}"
    rows = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 40, 150])))) for i in range(150)]
    docs = documents([*rows, (900, "never seen words zq zx"), (901, None)]).selectExpr("doc_id AS _id", "text AS _text")
    train = docs.where("_id < 120")
    monkeypatch.setattr(lm_score, "TOP", 64)
    monkeypatch.setattr(lm_score, "START", 64 + lm_score.GROUPS)
    monkeypatch.setattr(lm_score, "_PER", 64 // lm_score.TOP_CLASSES)
    # Workers import the module anew, so the network is taught and asked here.
    counts = {}
    for _, t in rows[:120]:
        for h in [*ids_of(t), int(lm_score.END)]:
            counts[h] = counts.get(h, 0) + 1
    signed = lambda h: int(np.uint64(h).view(np.int64))
    table = spark.createDataFrame([(signed(h), c) for h, c in counts.items()], "h long, c long")
    batch = docs.toPandas().assign(_row=lambda d: d["_id"])
    for heavy in (1 << 18, 70):
        monkeypatch.setattr(lm_score, "HEAVY", heavy)
        v = lm_score.vocabulary_of(table)
        net = lm_score.Network()
        net.start_from(v)
        net.train(lm_score.model_ids(lm_score.Words([t.encode() for _, t in rows[:120]], lower=True), v))
        made = list(lm_score._score(v, net)(iter([batch])))
        assert len(made) == 1
        for (_, t), r in zip([*rows, (900, "never seen words zq zx"), (901, "")], made[0].itertuples(), strict=True):
            rare = 0.0
            for h in r.rare:
                h = int(np.int64(h).view(np.uint64))
                g = v.group[h & 0xFF]
                rare += math.log10((counts[h] - v.discount) / v.rest[g] if h in counts else v.unseen[g])
            assert abs(r.score + rare - plain_score(net, v, counts, t)) < 1e-4 * (1 + r.n)


def test_models_are_averaged_by_tokens(spark):
    """Sums over several levels are the sum over all parts."""
    rows = [(i, i + 1, np.full(3, float(i * (i + 1))).tobytes()) for i in range(70)]
    df = spark.createDataFrame(rows, lm_score._MODEL)
    got = df.groupBy(F.floor(F.col("part") / lm_score.FAN)).applyInPandas(lm_score._added, lm_score._MODEL).collect()
    assert sorted(r.part for r in got) == [0, 1, 2] and sum(r.tokens for r in got) == sum(range(71))
    assert sum(np.frombuffer(r.model)[0] for r in got) == sum(i * (i + 1) for i in range(70))


# ---------------------------------------------------------------- quality


def test_quality_accuracy(spark, sf):
    got = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).collect()[0]
    assert n > 15 and right >= 0.8


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_odd(spark, folder, documents):
    rows = ODD + [(100 + i, "A calm sentence. Another one follows, and it ends." if i % 2 else "BUY!!! $$$ CLICK *** NOW !!! 999") for i in range(60)]
    labels = [(100 + i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (7, None, 1), (99999, 1, 0), (101, 1, 0)]
    got = quality.query(spark, folder(documents(rows, extra=True), labels=labelled(spark, labels))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id is not None and r.doc_id >= 100:
            assert r.predicted == r.doc_id % 2


def test_quality_without_labels(spark, folder, documents, tmp_path):
    got = quality.query(spark, folder(documents(ODD), labels=labelled(spark, []))).collect()
    assert len(got) == len(ODD) and {r.score for r in got} == {0.5}
    documents([]).write.parquet(f"{tmp_path}/e/documents.parquet")
    labelled(spark, []).write.parquet(f"{tmp_path}/e/labels.parquet")
    assert quality.query(spark, f"{tmp_path}/e").count() == 0


def one_hash(grams_of, *words):
    """The hash of one n-gram, taken by itself."""
    return grams_of(np.concatenate([lm_score.Words([w]).hashes() for w in words]))


def plain_vector(text):
    """A text's vector by its definition, one n-gram at a time."""
    from loomgraph.llm.textwords import grams

    t = text.encode()
    small = [w.encode() for w in WORDS.findall(lower(text))]
    found = {}
    for k in (1, 2):
        for i in range(len(small) - k + 1):
            b = int(quality._bucket(one_hash(lambda h: grams(h, k, k), *small[i : i + k]))[0])  # noqa: B023
            found[b] = found.get(b, 0) + 1
    for i in range(len(t) - quality.RUN + 1):
        b = int(quality._bucket(quality._runs(np.frombuffer(t[i : i + quality.RUN], dtype=np.uint8), quality.RUN))[0])
        found[b] = found.get(b, 0) + 1
    total = max(1, sum(found.values()))
    x = np.zeros(quality.WIDTH)
    for b, n in found.items():
        x[b] = n / total
    lines, n = text.split("\n"), max(1, len(small))
    again = len(lines) - len(set(lines))
    x[-quality.MEASURES :] = (math.log1p(len(t)) / 10, math.log1p(len(small)) / 10, len(set(small)) / n, sum(map(len, small)) / n / 10, again / len(lines), math.log1p(again) / 5)
    return x


def test_quality_against_a_plain_ranking(spark, folder, documents):
    """Scores of the query equal those of dense vectors, differences of pairs and plain loops."""
    rng = random.Random(6)
    good = ["calm", "sentence", "Another", "follows", "and", "ends.", "über"]
    rows = [(i, "\n".join(" ".join(rng.choice(good) for _ in range(rng.randrange(0, 9))) for _ in range(3)) if i % 3 else " ".join(rng.choice(["BUY!!", "now$$", "calm", "100%"]) for _ in range(12))) for i in range(90)] + [(90, ""), (91, "ab"), (92, None)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 93, 2)]
    got = {r.doc_id: r.score for r in quality.query(spark, folder(documents(rows), labels=labelled(spark, labels))).collect()}
    x = {i: plain_vector(t or "") for i, t in rows}
    taught = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    m = np.stack([x[i] for i, _ in taught])
    q = np.array([q for _, q in taught])
    assert np.allclose(quality.strengths([(t or "").encode() for _, t in rows], np.arange(quality.WIDTH) / 1e3), [x[i] @ np.arange(quality.WIDTH) / 1e3 for i, _ in rows])
    draw = np.random.RandomState(7)
    one, zero = np.flatnonzero(q == 1), np.flatnonzero(q == 0)
    n = quality.PAIRS * max(len(one), len(zero))
    d = m[draw.permutation(np.resize(one, n))] - m[draw.permutation(np.resize(zero, n))]
    top = 1.1 * np.linalg.norm(d, 2) ** 2 / n
    w = last = np.zeros(quality.WIDTH)
    for t in range(quality.STEPS):
        at = w + (t - 1) / (t + 2) * (w - last) if t else w
        slope = -(d / (1 + np.exp(d @ at))[:, None]).mean(axis=0) + quality.RIDGE * at
        last, w = w, at - slope / (top / 4 + quality.RIDGE)
    s = np.sort(m @ w)
    cut = (s[len(zero) - 1] + s[len(zero)]) / 2
    for i, _ in rows:
        assert abs(got[i] - 1 / (1 + math.exp(cut - x[i] @ w))) < 0.03
    assert np.corrcoef([got[i] for i, _ in rows], [1 / (1 + math.exp(cut - x[i] @ w)) for i, _ in rows])[0, 1] > 0.999


def test_language_against_plain_profiles(spark, folder, documents):
    """Predictions equal those of profiles that are bound and bundled one trigram at a time."""
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("abcde fgh  é" if i % 2 else "mnopq rst  ß") for _ in range(rng.randrange(3, 60)))) for i in range(50)] + [(60, "12 34"), (61, "ABC abc"), (62, "x" * 3000)]
    kind, vectors = language._tables()
    base = vectors[2][:, :]

    def profile(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        if not words:
            return None
        code = [0, *[int(kind[ord(c)]) for c in " ".join(words)], 0]
        # Blanks at the ends of a text stand for themselves.
        if not text.lower()[0].isalpha():
            code = [0, *code]
        if not text.lower()[-1].isalpha():
            code = [*code, 0]
        count = {}
        for i in range(len(code) - 2):
            g = tuple(code[i : i + 3])
            count[g] = count.get(g, 0) + 1
        total = np.zeros(language.DIM)
        for (a, b, c), n in count.items():
            total += math.sqrt(n) * np.roll(base[a], 2).astype(float) * np.roll(base[b], 1) * base[c]
        return total / np.linalg.norm(total)

    for _, t in rows:
        a, b = language.bundle(t), profile(t)
        assert (a is None) == (b is None) and (a is None or np.allclose(a, b, atol=1e-4))
    docs = documents(rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "aa").otherwise("mm"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.query(spark, folder(docs)).collect()}
    learned = {"aa": [], "mm": []}
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1 and profile(t) is not None:
            learned["aa" if i % 2 else "mm"].append(profile(t))
    proto = {k: sum(v) / np.linalg.norm(sum(v)) for k, v in learned.items()}
    mean = sum(proto.values()) / 2
    for i, t in rows:
        v = profile(t)
        if v is None:
            assert got[i] == ("und", 0.0)
            continue
        cos = {k: (p - mean) @ (v - mean) / np.linalg.norm(p - mean) / np.linalg.norm(v - mean) for k, p in proto.items()}
        best = max(cos, key=cos.get)
        assert got[i][0] == best or abs(cos["aa"] - cos["mm"]) < 1e-3
        assert abs(got[i][1] - (1 + max(cos.values())) / 2) < 1e-3
