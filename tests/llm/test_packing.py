import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loomgraph.llm import packing as P

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(text):
    t = Tokenizer.from_file(PATH)
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, pieces):
    want = sorted((i if i is not None else -1, len(ids)) for i, ids in rows)
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(-1 if p.doc_id is None else p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert sum(p.length for p in pieces) == sum(n for _, n in want)
    for i, n in want:
        assert all(p.doc_tokens in {m for j, m in want if j == i} for p in by_doc[i])
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 2048
    lengths = [sum(p.length for p in ps) for ps in by_seq.values()]
    return sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths)


def test_pieces(spark, folder, documents):
    rng = random.Random(3)
    rows = ODD + [(100 + i, " ".join(rng.choice(["alpha", "Beta,", "gamma-ray", "Ça", "it's", "x1y2"]) for _ in range(rng.randrange(0, 900)))) for i in range(80)]
    pieces = P.query(spark, folder(documents(rows, extra=True))).collect()
    ids = [(i, whole(t)) for i, t in rows]
    padding = check(ids, pieces)
    total = sum(len(x) for _, x in ids)
    assert padding <= 0.02 * total
    for i, x in ids:
        if i is None or [j for j, _ in rows].count(i) > 1:
            continue
        mine = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert [p.start for p in mine] == list(np.cumsum([0] + [p.length for p in mine])[:-1]) and sum(p.length for p in mine) == len(x)
        for p in mine:
            assert p.ids_crc32 == zlib.crc32(np.asarray(x[p.start : p.start + p.length], dtype="<u4").tobytes())


def test_empty_table(spark, folder, documents):
    assert P.query(spark, folder(documents([]))).count() == 0


def test_tokens_match_the_tokenizer():
    w = P.tokens(PATH)
    texts = ["", " ", "\n\n", "Hello, World! it's e-mail", "ÀÉÎ õ ß İstanbul", "a b　c", "(x) [y] {z}", "<|endoftext|>", "１２ 34 5.6", "naïve café's", "....", "漢字 テスト", "\x0b\x0c\r tab\tend"] * 2
    assert [list(np.frombuffer(x, dtype="<u4")) + [1] for x in w.many(texts)] == [whole(t) for t in texts]
    small = P.WordTokens(PATH, most=3)
    assert small.many(texts) == w.many(texts)


def test_differencing():
    rng = random.Random(1)
    sizes = sorted((rng.randrange(1, 2000) for _ in range(300)), reverse=True)
    window, sums = P.differencing(sizes, 170)
    again = np.zeros(170, dtype=int)
    np.add.at(again, window, sizes)
    assert (np.sort(again) == np.sort(sums)).all() and sums.sum() == sum(sizes)
    assert sums.max() - sums.min() < max(sizes)


def test_plan_covers():
    rng = random.Random(2)
    for n in (0, 1, 2, 7, 200):
        lengths = [rng.choice([1, 5, 2047, 2048, 2049, rng.randrange(1, 9000)]) for _ in range(n)]
        got = sorted((i, s, k) for i, s, k, _, _ in P.plan(lengths))
        for i, m in enumerate(lengths):
            at = 0
            for _, s, k in [g for g in got if g[0] == i]:
                assert s == at
                at += k
            assert at == m


def test_equal_rows_are_spread(spark, documents):
    """Rows equal in id and text are dealt to many groups, and each is packed once."""
    rows = [(None, "")] * 300 + [(7, "the same words again")] * 200 + [(i, f"text number {i}") for i in range(100)]
    got = P.pack(documents(rows), PATH, docs_per_group=16).collect()
    check([(i, whole(t)) for i, t in rows], got)
    groups = {r.sequence_id >> 24 for r in got if r.doc_id is None}
    assert len(groups) > 10
