r"""Language-model scoring: a gated recurrent network in numpy.

Tokens are lower-cased words and one end per text.  Exact counts of all training
tokens are gathered over the whole corpus.  The network (one GRU layer, class-
factored softmax, truncated back-propagation, Adam) learns from all training
texts, each as often as any other: they are dealt by hash to parts of about
``PART_TOKENS`` tokens, and the parts to ``ROUNDS`` rounds.  In a round every
part takes a pass over its whole texts from the weights of the round before, and
the parts' weights are averaged by their tokens.  The first round starts from the
words' shares.  A corpus under ``4 * TRAIN_TOKENS`` tokens is passed over up to
four times.  The driver gets weights and never texts.

The output is factored as P(class | state) P(word | class, state).  The ``TOP``
most frequent words share ``TOP_CLASSES`` classes and have a softmax inside
them.  All other words fall into ``GROUPS`` classes by their last two letters.
Inside these a word has its share of the class's training tokens, less a
discount that goes to the words never seen.

Scoring runs over whole texts.  Many texts run side by side in slots; the state
is carried from window to window until a text ends, so the result is the
complete text's log-likelihood.  Counts of the ``HEAVY`` most frequent words (a
fixed number) travel with the function; rarer words are looked up by an equi-join,
with the same result.

Defined results: null and empty texts are one end token; without training texts
every word is unknown; rows that repeat an id are scored each by itself; rows
with a null id are scored and never learned from; words of equal counts rank by
their hashes; a text of any length is read and scored whole, its state carried
from window to window; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .textwords import Words, blocks, mix, utf8

TOP = 1024
TOP_CLASSES = 16
GROUPS = 24
HEAVY = 1 << 18
#: A fourth of the tokens that a network learns from at least; smaller corpora are read up to four times.
TRAIN_TOKENS = 250_000
PART_TOKENS = 1_000_000
#: Rounds that all texts are dealt to.
ROUNDS = 2
#: Models that are added up together, and how many sums may reach the driver.
FAN = 32
HIDDEN = 16
END = np.uint64(0xFFFFFFFFFFFFFF00)
_PER = TOP // TOP_CLASSES
CLASSES = TOP_CLASSES + GROUPS
START = TOP + GROUPS
_SALT = np.uint64(0x9E3779B97F4A7C15)


def word_ids(words: Words) -> np.ndarray:
    """56 bits of a word's hash, then 8 bits that depend on its last two bytes."""
    h = words.hashes()
    if not len(h):
        return h
    last = words.buf[words.ends - 1].astype(np.uint64)
    before = words.buf[np.maximum(words.ends - 2, words.starts)].astype(np.uint64)
    suffix = mix((last << np.uint64(8) | before) * _SALT) & np.uint64(0xFF)
    return h & ~np.uint64(0xFF) | suffix


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ends = 0
    held: list[np.ndarray] = []
    size = 0
    for b in batches:
        ends += len(b)
        for _, texts in blocks((utf8(t) for t in b["_text"]), 1 << 22):
            held.append(word_ids(Words(texts, lower=True)))
            size += len(held[-1])
            if size > 4_000_000:
                h, c = np.unique(np.concatenate(held), return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "c": c})
                held, size = [], 0
    if held:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        yield pd.DataFrame({"h": h.view(np.int64), "c": c})
    if ends:
        yield pd.DataFrame({"h": [int(END.view(np.int64))], "c": [ends]})


class Vocabulary:
    """The heavy words' counts and the classes of all words."""

    def __init__(self, heavy: np.ndarray, counts: np.ndarray, mass: dict[int, tuple[int, int]], total: int, distinct: int, discount: float = 0.75):
        order = np.argsort(heavy, kind="stable")
        self.heavy, self.counts = heavy[order], counts[order].astype(np.float64)
        self.total, self.distinct = total, distinct
        rank = np.empty(len(heavy), dtype=np.int64)
        rank[np.lexsort((self.heavy.view(np.int64), -self.counts))] = np.arange(len(heavy))
        by_mass = sorted(mass, key=lambda s: (-mass[s][0], s))
        self.group = np.full(256, GROUPS - 1, dtype=np.int64)
        for g, s in enumerate(by_mass[: GROUPS - 1]):
            self.group[s] = g
        suffix = self.group[(self.heavy & np.uint64(0xFF)).astype(np.int64)]
        # Ids: 0..TOP-1 top words, then the groups of all others.
        self.ids = np.where(rank < TOP, rank, TOP + suffix)
        self.rest, kinds = np.zeros(GROUPS), np.zeros(GROUPS)
        for s, (n, types) in mass.items():
            self.rest[self.group[s]] += n
            kinds[self.group[s]] += types
        top = rank < TOP
        np.add.at(self.rest, suffix[top], -self.counts[top])
        np.add.at(kinds, suffix[top], -1.0)
        self.rest, kinds = np.maximum(self.rest, 0), np.maximum(kinds, 0)
        self.discount = discount
        self.within = np.where(top, 0.0, np.log10((self.counts - discount) / np.maximum(1.0, self.rest[suffix])))
        # A class without words is all unseen ones.
        self.unseen = np.where(self.rest > 0, discount * kinds / np.maximum(self.rest, 1), 1.0)

        # Open addressing: each word stands at the first free place from its own.
        self.mask = (1 << max(3, (4 * len(self.heavy) - 1).bit_length())) - 1
        self.table = np.full(self.mask + 1, -1, dtype=np.int32)
        left, at = np.arange(len(self.heavy)), self._place(self.heavy)
        while len(left):
            free = self.table[at] < 0
            spots, first = np.unique(at[free], return_index=True)
            self.table[spots] = left[free][first]
            rest = self.table[at] != left
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _place(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(24)) & np.uint64(self.mask)).astype(np.int64)

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``heavy`` (-1: not there) and model ids."""
        place = self._place(h)
        found = self.table[place]
        known = np.append(self.heavy, np.uint64(0))
        open_ = np.flatnonzero((found >= 0) & (known[found] != h))
        while len(open_):
            place[open_] = (place[open_] + 1) & self.mask
            here = self.table[place[open_]]
            found[open_] = here
            open_ = open_[(here >= 0) & (known[here] != h[open_])]
        return found, np.where(found >= 0, np.append(self.ids, 0)[found], TOP + self.group[(h & np.uint64(0xFF)).astype(np.int64)])


def _class_of(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < TOP, ids // _PER, TOP_CLASSES + ids - TOP)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """A GRU over model ids with a class-factored softmax."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.RandomState(seed)
        f = np.float32
        self.p = {
            "x": (rng.randn(START + 1, 3 * hidden) * 0.1).astype(f),
            "u": (rng.randn(hidden, 3 * hidden) / math.sqrt(hidden)).astype(f),
            "c": (rng.randn(hidden, CLASSES) * 0.1).astype(f),
            "cb": np.zeros(CLASSES, dtype=f),
            "w": (rng.randn(TOP_CLASSES, hidden, _PER) * 0.1).astype(f),
            "wb": np.zeros((TOP_CLASSES, _PER), dtype=f),
        }
        self.hidden = hidden

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()]).astype(np.float64)

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = values[at : at + v.size].reshape(v.shape).astype(v.dtype)
            at += v.size

    def step(self, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        n = self.hidden
        a, uh = self.p["x"][ids], h @ self.p["u"]
        zr = _sigmoid(a[:, : 2 * n] + uh[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        new = np.tanh(a[:, 2 * n :] + r * uh[:, 2 * n :])
        return new + z * (h - new), z, r, new, uh[:, 2 * n :]

    def start_from(self, vocabulary: Vocabulary) -> None:
        """Biases that give unigram shares to begin with."""
        top = vocabulary.ids < TOP
        mass = np.ones(CLASSES)
        np.add.at(mass, _class_of(vocabulary.ids[top]), vocabulary.counts[top])
        mass[TOP_CLASSES:] += np.maximum(vocabulary.rest, 0.001 * vocabulary.total)
        self.p["cb"][:] = np.log(mass / mass.sum())
        inside = np.full(TOP, 0.5)
        inside[vocabulary.ids[top]] += vocabulary.counts[top]
        self.p["wb"][:] = np.log(inside).reshape(TOP_CLASSES, _PER)

    def log10_probs(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10 P(id) for states; for groups that is their class alone."""
        logits = h @ self.p["c"] + self.p["cb"]
        logits -= logits.max(axis=1, keepdims=True)
        kind = _class_of(ids)
        out = logits[np.arange(len(ids)), kind] - np.log(np.exp(logits).sum(axis=1))
        order = np.argsort(kind, kind="stable")
        ends = np.searchsorted(kind[order], np.arange(TOP_CLASSES + 1))
        for c in range(TOP_CLASSES):
            rows = order[ends[c] : ends[c + 1]]
            if len(rows):
                y = h[rows] @ self.p["w"][c] + self.p["wb"][c]
                y -= y.max(axis=1, keepdims=True)
                out[rows] += y[np.arange(len(rows)), ids[rows] - c * _PER] - np.log(np.exp(y).sum(axis=1))
        return out / math.log(10)

    def train(self, texts: list[np.ndarray], slots: int = 64, steps: int = 16, epochs: int = 3, rate: float = 0.01) -> None:
        """Truncated back-propagation over texts' ids (each ends with the end token)."""
        if not texts:
            return
        stream = np.concatenate([np.concatenate([[START], t]) for t in texts])
        if len(stream) < 2 * slots:
            slots = 1
        # A slot ends with the next one's first token, so each token is a target once; what is filled up is none.
        length = -(-len(stream) // slots) + 1
        stream = np.concatenate([stream, np.full(slots * (length - 1) + 1 - len(stream), START)])
        grid = stream[np.arange(length)[:, None] + np.arange(slots) * (length - 1)]
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        t = 0
        total = epochs * max(1, (length - 1) // steps)
        for _ in range(epochs):
            h = np.zeros((slots, self.hidden), dtype=np.float32)
            for at in range(0, length - 1, steps):
                part = grid[at : at + steps + 1]
                grads, h = self._gradients(part[:-1], part[1:], h)
                t += 1
                lr = rate * (1 - 0.9 * t / (total + 1))
                norm = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g *= min(1.0, 5.0 / (norm + 1e-9))
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] -= (lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def _gradients(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        p, n = self.p, self.hidden
        states = []
        for ids in inputs:
            h = h * (ids != START)[:, None]
            after, z, r, new, un = self.step(ids, h)
            states.append((h, z, r, new, un, after))
            h = after
        hs = np.concatenate([s[5] for s in states])
        ids = targets.ravel()
        use = ids != START
        scale = np.float32(1 / max(1, use.sum()))
        g = {k: np.zeros_like(v) for k, v in p.items()}
        logits = hs @ p["c"] + p["cb"]
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        safe = np.where(use, ids, 0)
        kind = _class_of(safe)
        prob[np.arange(len(ids)), kind] -= 1
        prob *= use[:, None] * scale
        g["c"], g["cb"] = hs.T @ prob, prob.sum(axis=0)
        dh = prob @ p["c"].T
        for c in range(TOP_CLASSES):
            rows = np.flatnonzero(use & (kind == c))
            if len(rows):
                y = hs[rows] @ p["w"][c] + p["wb"][c]
                q = np.exp(y - y.max(axis=1, keepdims=True))
                q /= q.sum(axis=1, keepdims=True)
                q[np.arange(len(rows)), ids[rows] - c * _PER] -= 1
                q *= scale
                g["w"][c], g["wb"][c] = hs[rows].T @ q, q.sum(axis=0)
                dh[rows] += q @ p["w"][c].T
        dh = dh.reshape(len(states), -1, n)
        back = np.zeros_like(dh[0])
        into = np.empty((len(states), len(h), 3 * n), dtype=dh.dtype)
        for t in range(len(states) - 1, -1, -1):
            before, z, r, new, un, _ = states[t]
            d = dh[t] + back
            dn = d * (1 - z) * (1 - new * new)
            dz = d * (before - new) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r], axis=1)
            g["u"] += before.T @ du
            into[t, :, : 2 * n], into[t, :, 2 * n :] = du[:, : 2 * n], dn
            back = (d * z + du @ p["u"].T) * (inputs[t] != START)[:, None]
        order = np.argsort(inputs.ravel(), kind="stable")
        ids, first = np.unique(inputs.ravel()[order], return_index=True)
        g["x"][ids] = np.add.reduceat(into.reshape(-1, 3 * n)[order], first)
        return g, h

    def score(self, texts: list[np.ndarray], window: int = 64, slots: int = 256) -> np.ndarray:
        """log10 probability of each text's ids; the state is carried across windows."""
        if not texts:
            return np.zeros(0)
        size = np.array([len(t) for t in texts])
        slots = int(np.clip(size.sum() // max(1, size.max()), 1, slots))
        load = np.zeros(slots, dtype=np.int64)
        dealt: list[list[int]] = [[] for _ in range(slots)]
        for i in np.argsort(-size, kind="stable"):
            s = int(load.argmin())
            dealt[s].append(int(i))
            load[s] += size[i]
        steps = int(load.max())
        inputs = np.full((steps, slots), START, dtype=np.int64)
        targets = np.full((steps, slots), -1, dtype=np.int64)
        owner = np.zeros((steps, slots), dtype=np.int64)
        for s, mine in enumerate(dealt):
            at = 0
            for i in mine:
                t = texts[i]
                inputs[at + 1 : at + len(t), s] = t[:-1]
                targets[at : at + len(t), s] = t
                owner[at : at + len(t), s] = i
                at += len(t)
        out = np.zeros(len(texts))
        h = np.zeros((slots, self.hidden), dtype=np.float32)
        for at in range(0, steps, window):
            ids = inputs[at : at + window]
            states = np.empty((len(ids), slots, self.hidden), dtype=np.float32)
            for t in range(len(ids)):
                h = self.step(ids[t], h * (ids[t] != START)[:, None].astype(np.float32))[0]
                states[t] = h
            goal = targets[at : at + window].ravel()
            use = goal >= 0
            found = self.log10_probs(states.reshape(-1, self.hidden)[use], goal[use])
            out += np.bincount(owner[at : at + window].ravel()[use], weights=found, minlength=len(texts))
        return out


def _with_ends(words: Words, ids: np.ndarray, end: int) -> list[np.ndarray]:
    """The model ids of each text, with the end."""
    every = np.insert(ids.astype(np.int32), words.bounds[1:], end)
    at = words.bounds + np.arange(len(words.bounds))
    return [every[s:e] for s, e in zip(at[:-1], at[1:])]


def model_ids(words: Words, vocabulary: Vocabulary) -> list[np.ndarray]:
    """The model ids of each text, with the end."""
    return _with_ends(words, vocabulary.lookup(word_ids(words))[1], int(vocabulary.lookup(np.array([END]))[1][0]))


def _score(vocabulary: Vocabulary, network: Network):
    size = math.log10(vocabulary.total + vocabulary.distinct + 1)
    base = np.append(np.log10(vocabulary.counts + 1), 0.0)
    within = np.append(vocabulary.within, 0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end_at, end_id = (int(x[0]) for x in vocabulary.lookup(np.array([END])))
        # The end is one of the words that travel; without training texts it is known to nobody.
        ends = [np.array([END], dtype=np.uint64).view(np.int64)] if end_at < 0 else []
        for b in batches:
            rows, keys = b["_row"].to_numpy(), b["_id"].astype("Int64")
            for first, texts in blocks((utf8(t) for t in b["_text"]), 1 << 24):
                words = Words(texts, lower=True)
                h = word_ids(words)
                at, model = vocabulary.lookup(h)
                sums = lambda x, w=words: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.float64)])[w.bounds])
                n = np.diff(words.bounds) + 1
                known = sums(at >= 0).astype(np.int64) + (end_at >= 0)
                low = sums(base[at]) + base[end_at] - n * size
                inside = sums(within[at]) + within[end_at]
                scores = network.score(_with_ends(words, model, end_id)) + inside
                out = np.flatnonzero(at < 0)
                cut = np.searchsorted(out, words.bounds)
                rare = h[out].view(np.int64)
                lists = [np.concatenate([rare[i:j], *ends]) if ends else rare[i:j] for i, j in zip(cut[:-1], cut[1:])]
                part = slice(first, first + len(texts))
                yield pd.DataFrame({"_row": rows[part], "_id": keys.iloc[part].array, "n": n, "known": known, "base": low, "score": scores, "rare": lists})

    return shared.lean(run)


_MODEL = "part long, tokens long, model binary"


def _read(rows: pd.DataFrame, vocabulary: Vocabulary) -> list[np.ndarray]:
    """The model ids of a part's texts, in order of their hashes."""
    texts = []
    for _, block in blocks((utf8(t) for t in rows.sort_values(["_h", "_text"], kind="stable")["_text"]), 1 << 22):
        texts += model_ids(Words(block, lower=True), vocabulary)
    return texts


def _teach(vocabulary: Vocabulary, network: Network, passes: int, rate: float):
    """Passes over a part's texts: the weights times the tokens."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = Network()
        own.p = {k: v.copy() for k, v in network.p.items()}
        texts = _read(rows, vocabulary)
        n = sum(len(t) for t in texts)
        # About 300 updates a pass, whatever the part's size.
        own.train(texts, slots=int(np.clip(n // (24 * 300), 4, 128)), steps=24, epochs=passes, rate=rate)
        shared.release()
        return pd.DataFrame({"part": [int(rows["_part"].iloc[0])], "tokens": [n], "model": [(own.flat() * n).tobytes()]})

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part", kind="stable")
    model = np.frombuffer(rows["model"].iloc[0]).copy()
    for m in rows["model"].iloc[1:]:
        model += np.frombuffer(m)
    return pd.DataFrame({"part": [int(rows["part"].iloc[0]) // FAN], "tokens": [int(rows["tokens"].sum())], "model": [model.tobytes()]})


def _dealt(train: DataFrame, seed: int) -> DataFrame:
    return train.select(F.xxhash64(F.lit(seed), "_id", "_text").alias("_h"), F.coalesce("_text", F.lit("")).alias("_text"))


def teach(train: DataFrame, vocabulary: Vocabulary, network: Network) -> int:
    """Teach the network all texts of ``train`` (_id, _text), each in one round; the number of tokens learned from."""
    parts = max(1, -(-vocabulary.total // PART_TOKENS))
    passes = int(min(4, max(1, -(-4 * TRAIN_TOKENS // max(1, vocabulary.total)))))
    rounds = min(ROUNDS, parts)
    rows = _dealt(train, 11).withColumn("_part", F.pmod("_h", F.lit(parts)))
    tokens = 0
    for turn in range(rounds):
        # Large steps first; the last round's are small, so that the average settles.
        rate = 0.01 if rounds == 1 else 0.02 * 0.25 ** (turn / (rounds - 1))
        mine = rows.where(F.col("_part") % rounds == turn).withColumn("_part", F.floor(F.col("_part") / rounds))
        models, left = mine.groupBy("_part").applyInPandas(_teach(vocabulary, network, passes, rate), _MODEL), -(-(parts - turn) // rounds)
        while left > FAN:
            models = models.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(_added, _MODEL)
            left = -(-left // FAN)
        got = sorted(models.collect())
        learned = sum(r.tokens for r in got)
        if learned:
            network.set_flat(sum(np.frombuffer(r.model) for r in got) / learned)
        tokens += learned
    return tokens


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """The vocabulary of a table of (h, c); the driver gets the ``HEAVY`` most frequent words and 256 sums."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).collect()[0]
    end = int(END.view(np.int64))
    suffix = F.col("h").bitwiseAND(0xFF).cast("int")
    mass = {r["s"]: (int(r["n"]), int(r["types"])) for r in counts.where(F.col("h") != end).groupBy(suffix.alias("s")).agg(F.sum("c").alias("n"), F.count("*").alias("types")).collect()}
    once, twice = counts.agg(F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).collect()[0]
    # Words by the logarithm of their counts: a few hundred sums tell which counts the most frequent words have.
    words = counts.where((F.col("c") >= 2) & (F.col("h") != end)).withColumn("_l", F.floor(8 * F.log2("c")))
    sizes = sorted(((r["_l"], r["count"]) for r in words.groupBy("_l").count().collect()), reverse=True)
    below = np.cumsum([n for _, n in sizes])
    most = max([int(np.searchsorted(below, HEAVY, side="right")) - 1, int(np.searchsorted(below, TOP))])
    heavy = words.where(F.col("_l") >= sizes[min(most, len(sizes) - 1)][0]) if sizes else words
    if sizes and below[min(most, len(sizes) - 1)] > HEAVY:  # many words of about one count
        heavy = heavy.orderBy(F.desc("c"), "h").limit(max(HEAVY, TOP))
    heavy = heavy.select("h", "c").toPandas()
    ends = counts.where(F.col("h") == end).toPandas()  # one row, or none without training texts
    heavy = pd.concat([heavy, ends])
    h = heavy["h"].to_numpy(dtype=np.int64).view(np.uint64)
    s_end = int(END & np.uint64(0xFF))
    if len(ends):
        n, types = mass.get(s_end, (0, 0))
        mass[s_end] = (n + int(ends["c"].iloc[0]), types + 1)
    discount = min(0.95, max(0.5, once / max(1, once + 2 * twice)))
    return Vocabulary(h, heavy["c"].to_numpy(dtype=np.int64), mass, int(total), int(distinct), discount)


def learn(train: DataFrame, tables: shared.SharedTables) -> tuple[DataFrame, Vocabulary, Network]:
    """Counts (h, c) of all tokens of ``train`` (_id, _text), and the model."""
    counts = tables.keep(train.select("_text").mapInPandas(shared.lean(_count), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    vocabulary = vocabulary_of(counts)
    network = Network()
    network.start_from(vocabulary)
    teach(train, vocabulary, network)
    return counts, vocabulary, network


def score(docs: DataFrame, train: DataFrame) -> DataFrame:
    """Scores of ``docs`` (_id, _text) by a model of ``train`` (_id, _text): one row each, keyed by _row."""
    tables = shared.SharedTables(docs.sparkSession, "lm")
    counts, vocabulary, network = learn(train, tables)
    size = math.log10(vocabulary.total + vocabulary.distinct + 1)
    made = docs.withColumn("_row", F.monotonically_increasing_id()).mapInPandas(
        _score(vocabulary, network), "_row long, _id long, n long, known long, base double, score double, rare array<long>"
    )
    made = tables.keep(made)
    rest = [float(x) for x in vocabulary.rest]
    unseen = [float(x) for x in vocabulary.unseen]
    group = F.element_at(F.array(*[F.lit(int(g)) for g in vocabulary.group]), F.col("h").bitwiseAND(0xFF).cast("int") + 1)
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), group + 1)
    seen = F.col("c").isNotNull()
    inside = F.when(seen, F.log10((F.col("c") - F.lit(vocabulary.discount)) / F.greatest(F.lit(1.0), of(rest)))).otherwise(F.log10(F.greatest(F.lit(1e-12), of(unseen))))
    # What a rare word adds is worked out once a word; what travels back is one sum a task, text and kind.
    words = made.select("_row", F.explode("rare").alias("h"))
    found = words.join(counts, "h", "left")
    sums = found.groupBy("_row").agg(F.count_if(seen).alias("r_known"), F.sum(F.when(seen, F.log10(F.col("c") + 1.0)).otherwise(0.0)).alias("r_base"), F.sum(inside).alias("r_score"))
    return made.drop("rare").join(sums, "_row", "left").select(
        F.col("_id"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("r_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("r_base", F.lit(0.0))).alias("base_score"),
        F.round(F.col("score") + F.coalesce("r_score", F.lit(0.0)), 4).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.exact(shared.documents(spark, sf_dir), "doc_id", "text").select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    left_out = F.crc32(F.col("_id").cast("string")) % 7 == 2
    return score(docs, docs.where(~left_out)).withColumn("held_out", F.coalesce(left_out, F.lit(False))).withColumnRenamed("_id", "doc_id").select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
