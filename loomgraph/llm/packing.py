"""Packing: fill windows of a fixed number of tokens.

Documents are tokenised and dealt by a hash into groups of about
``docs_per_group``; a group is packed by itself, so no task holds more than a
group.  Rows of an id that more rows have than that are counted by their texts and
numbered first, and the number is hashed too, so no key can gather rows.  A document's whole windows are cut off first.
What remains is spread by Karmarkar-Karp multiway differencing: partial
partitions, largest imbalance first, are merged with opposing order until one
partition into near-equal windows is left.  If a window exceeds the capacity,
the window count rises and the differencing runs again.  A few remainders are
held back to be cut into the gaps that are left, and what is over after that
becomes windows whose lengths are powers of two, which need no padding.

Defined results: null and empty texts have the end id alone; rows that repeat an
id are packed each by itself (in the order of their texts); an empty table gives
no pieces; other columns do not matter.  Every id lies in exactly one piece.
"""

from __future__ import annotations

import heapq
import math
import os
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .textwords import Words, blocks, range_hashes, utf8

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CAPACITY = 2048
#: Windows to begin with, as a multiple of the fewest; the remainders held back fill what they leave.
HEADROOM = 1.04


#: Bytes of texts whose ids are found together.
_BLOCK = 1 << 20
_LETTER, _MARK, _OTHER = 0, 1, 2
#: Marks that make one pre-token when they stand together.
_MARKS = np.frombuffer(b".,!?;:*$&#%|()-", dtype=np.uint8)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[_MARKS] = _MARK
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def _kinds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte, and the bytes lower-cased; letters are A-Z and the Latin-1 supplement's, which every rule treats alike."""
    kind, small = _KIND[buf], _SMALL[buf]
    at = np.flatnonzero(buf[:-1] == 0xC3) if len(buf) else np.zeros(0, dtype=np.int64)
    low = buf[at + 1]
    at, low = at[(low >= 0x80) & (low != 0x97) & (low != 0xB7)], low[(low >= 0x80) & (low != 0x97) & (low != 0xB7)]
    kind[at] = kind[at + 1] = _LETTER
    small[at + 1] = np.where(low <= 0x9E, low + 32, low)
    return kind, small


def _running(x: np.ndarray) -> np.ndarray:
    """How many hold before each place (and in all)."""
    out = np.zeros(len(x) + 1, dtype=np.int32)
    np.cumsum(x, dtype=np.int32, out=out[1:])
    return out


class WordTokens:
    """Token ids of whole texts, kept by pre-token.

    The tokenizer drops white space and never joins text across it, so the ids of
    a text are those of its words in order.  A plain word is letters and then
    marks, one pre-token each; any other word is a unit that the tokenizer takes
    as it is.  A block of texts is cut into units, lower-cased and hashed with
    numpy; Python sees each distinct unit of the block once, and the ids of all
    units are gathered with numpy again.  The last token of a pre-token is marked
    in the vocabulary, so many new ones are encoded in one call by a tokenizer
    that splits at spaces only.  The memory of units starts anew when it is full.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.lean = Tokenizer.from_file(path)
        # Pre-tokens come lower-cased and apart, so only the bytes' letters are left to do.
        self.lean.normalizer = None
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.most = most
        self.units: dict[bytes, bytes] = {}

    def _whole(self, unit: bytes) -> bytes:
        return np.asarray(self.tokenizer.encode(unit.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _add(self, plain: list[bytes], others: list[bytes]) -> None:
        """Encode units that are not known yet."""
        self.units.update((x, self._whole(x)) for x in others)
        for at in range(0, len(plain), 128):
            part = plain[at : at + 128]
            # Without offsets, which nobody reads.
            ids = np.asarray(self.lean.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) != len(part):
                self.units.update((x, self._whole(x)) for x in part)
                continue
            data, start = ids.tobytes(), 0
            for x, end in zip(part, ends.tolist()):
                self.units[x] = data[start:end]
                start = end

    def _block(self, texts: list[bytes]) -> list[bytes]:
        words = Words(texts)
        if not len(words):
            return [b""] * len(texts)
        kind, small = _kinds(words.buf)
        letters, others = (_running(kind == k) for k in (_LETTER, _OTHER))
        turns = _running((kind[1:] == _LETTER) & (kind[:-1] == _MARK))
        s, e = words.starts, words.ends
        plain = (others[e] == others[s]) & (turns[e - 1] == turns[s])
        n_letters = np.where(plain, letters[e] - letters[s], 0)
        two = plain & (n_letters > 0) & (n_letters < e - s)
        first = np.concatenate([[0], np.cumsum(1 + two)])  # the first unit of each word
        word = np.repeat(np.arange(len(s)), 1 + two)
        second = np.arange(len(word)) > first[word]
        starts = s[word] + np.where(second, n_letters[word], 0)
        ends = np.where(two[word] & ~second, s[word] + n_letters[word], e[word])
        # Only plain words are lower-cased here.
        change = np.zeros(len(words.buf) + 1, dtype=np.int8)
        change[s[plain]] = 1
        change[e[plain]] = -1
        buf = np.where(np.cumsum(change[:-1], dtype=np.int8) > 0, small, words.buf)
        which, known = pd.factorize(range_hashes(buf, starts, ends))
        at = np.empty(len(known), dtype=np.int64)
        at[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        data = buf.tobytes()
        distinct = [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        found = list(map(self.units.get, distinct))
        if None in found:
            if len(self.units) > self.most:
                self.units.clear()
                found = [None] * len(distinct)
            gone = [(x, p) for x, f, p in zip(distinct, found, plain[word[at]].tolist()) if f is None]
            self._add([x for x, p in gone if p], [x for x, p in gone if not p])
            found = list(map(self.units.get, distinct))
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        joined = np.frombuffer(b"".join(found), dtype="<u4")
        place = np.cumsum(sizes) - sizes
        each = sizes[which]
        reach = np.concatenate([[0], np.cumsum(each)])
        ids = joined[np.repeat(place[which] - reach[:-1], each) + np.arange(reach[-1])].tobytes()
        cut = (reach[first[words.bounds]] * 4).tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def many(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [ids for _, block in blocks((utf8(t) for t in texts), _BLOCK) for ids in self._block(block)]


_TOKENS: dict[str, WordTokens] = {}
_PACKED = [0]


def tokens(path: str) -> WordTokens:
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def differencing(sizes: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: the window of each size, and the windows' sums."""
    if not sizes:
        return np.zeros(0, dtype=np.int64), np.zeros(k, dtype=np.int64)
    sums: list[np.ndarray | None] = []
    heap = []
    for i, x in enumerate(sizes):
        leaf = np.zeros(k, dtype=np.int64)
        leaf[0] = x
        sums.append(leaf)
        heap.append((-x if k > 1 else 0, i))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        joint = sums[a] + sums[b][::-1]
        order = np.argsort(-joint, kind="stable")
        place = np.empty(k, dtype=np.int64)
        place[order] = np.arange(k)
        merges.append((a, b, place))
        joint = joint[order]
        sums[a] = sums[b] = None
        sums.append(joint)
        heapq.heappush(heap, (-int(joint[0] - joint[-1]), len(sums) - 1))
    at: list[np.ndarray | None] = [None] * len(sums)
    at[-1] = np.arange(k)
    for i in range(len(merges) - 1, -1, -1):
        a, b, place = merges[i]
        mine = at[len(sizes) + i]
        at[len(sizes) + i] = None
        at[a] = mine[place]
        at[b] = mine[place[::-1]]
    return np.array([at[i][0] for i in range(len(sizes))], dtype=np.int64), sums[-1]


def _spread(sizes: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Differencing into as few windows as hold them."""
    k = max(1, math.ceil(sum(sizes) * HEADROOM / capacity))
    while True:
        window, sums = differencing(sizes, k)
        if sums.max(initial=0) <= capacity:
            return window, sums
        k += 1 + k // 32


def plan(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, window, offset) of items with these lengths."""
    pieces = []
    windows = 0
    rest: list[tuple[int, int]] = []
    for i, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((i, start, capacity, windows, 0))
            windows += 1
        if n % capacity:
            rest.append((i, n % capacity))
    rest.sort(key=lambda x: (-x[1], x[0]))
    held = 0
    while True:
        spread = rest[held:]
        sizes = [n for _, n in spread]
        if not sizes:
            window, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            break
        window, sums = _spread(sizes, capacity)
        spare = sum(n for _, n in rest[:held])
        gaps = int(len(sums) * capacity - sums.sum())
        if gaps <= spare:
            break
        held = min(len(rest), held + max(1, (gaps - spare) // capacity))
    filled = np.zeros(len(sums), dtype=np.int64)
    for (i, n), w in zip(spread, window):
        pieces.append((i, lengths[i] - n, n, windows + int(w), int(filled[w])))
        filled[w] += n
    room = [(windows + w, int(filled[w]), capacity - int(filled[w])) for w in range(len(sums)) if filled[w] < capacity]
    windows += len(sums)
    over = sum(n for _, n in rest[:held]) - sum(r for _, _, r in room)
    while over > 0:
        size = min(capacity, 1 << (over.bit_length() - 1))
        room.append((windows, 0, size))
        windows += 1
        over -= size
    slots = iter(room)
    w, offset, left = next(slots, (0, 0, 0))
    for i, n in rest[:held]:
        start = lengths[i] - n
        while n:
            if not left:
                w, offset, left = next(slots)
            size = min(n, left)
            pieces.append((i, start, size, w, offset))
            start, n, offset, left = start + size, n - size, offset + size, left - size
    return pieces


def _packer(path: str, end_id: int, capacity: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def pack(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        encode, end = tokens(path), np.asarray([end_id], dtype="<u4").tobytes()
        docs = docs.sort_values(["_id", "_text"], kind="stable", na_position="first")
        ids = [x + end for x in encode.many(list(docs["_text"]))]
        doc_id = docs["_id"].to_numpy()
        rows = [
            (doc_id[i], start, n, zlib.crc32(memoryview(ids[i])[4 * start : 4 * (start + n)]), len(ids[i]) // 4, (key[0] << 24) + w, offset)
            for i, start, n, w, offset in plan([len(x) // 4 for x in ids], capacity)
        ]
        del ids, docs
        _PACKED[0] += 1
        if _PACKED[0] % 8 == 0:
            shared.release()
        return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return pack


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, docs_per_group: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of the documents' ids, dealt to windows of ``capacity``."""
    rows = shared.exact(docs, key, text).select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    groups = max(1, math.ceil(rows.count() / docs_per_group))
    # Only ids are read to see whether some are that frequent.
    often = rows.groupBy("_id").count().where(F.col("count") > docs_per_group).select(F.col("_id").alias("_o"))
    rows = rows.withColumn("_n", F.lit(0).cast("long"))
    if not often.isEmpty():
        same = F.col("_id").eqNullSafe(F.col("_o"))
        equal = rows.join(often, same, "left_semi").groupBy("_id", "_text").count()
        equal = equal.select("_id", "_text", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("_n"))
        rows = rows.join(often, same, "left_anti").unionByName(equal)
    dealt = rows.select("_id", "_text", F.pmod(F.xxhash64("_id", "_text", "_n"), F.lit(groups)).alias("_g"))
    return dealt.groupBy("_g").applyInPandas(_packer(tokenizer, end_id, capacity), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(shared.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
