"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Each word enters as a learnt word vector (words of the training sample) and the scaled sum
of learnt vectors of its character 3- to 5-grams, so that unseen inflections are read by
their characters. A GRU runs over each window of words in both directions, attention pools
its states, and a document's score is that of its highest window; windows overlap and
cover the whole text. Training is plain numpy with hand-written backpropagation: in each
epoch every window of the sample is scored, and each document trains on its highest windows
and a random one (only documents labelled 0 train on the random one).

Bounds (documented parameters): at most ``PER_CLASS`` labelled documents of label 1
and three times as many of label 0, the first by a hash of the id, of at most ``MAX_CHARS`` characters each. Scoring has no bound.

Defined cases: null or empty text and text without letters get the training share of
label 1 as score (0 without labels); labels that are null or name no document are ignored;
a document row is one row out. Without both classes in the sample every score is that share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import rolling, slices, texts_of

WINDOW, STRIDE = 32, 20
PER_CLASS = 1500  # three times as many of label 0
MAX_CHARS = 16_000
FOLDS = 5

HIDDEN, WORD_DIM, CHAR_DIM, CHAR_ROWS = 8, 8, 16, 1 << 15
MIN_COUNT, MAX_WORDS = 3, 20_000
BATCH, EPOCHS, MIN_STEPS, TOP = 128, 3, 160, 2
#: Words whose gate inputs a worker keeps, and windows it runs at a time.
CACHE_ROWS, RUN_WINDOWS = 120_000, 1024

#: Letters lowered, bytes beyond ASCII kept, all else a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def char_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character n-grams of all words, one after the other, and the first of each word."""
    data = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64) + np.uint64(1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    parts, counts = [], np.zeros(len(words), np.int64)
    word_of = np.repeat(np.arange(len(words)), lengths)
    for n in (3, 4, 5):
        grams = rolling(data, n, 0x9FB21C651E98DF25 + 2 * n) if len(data) >= n else np.empty(0, np.uint64)
        ok = word_of[: len(grams)] == word_of[n - 1 : n - 1 + len(grams)]
        parts.append(((grams >> np.uint64(20)) % np.uint64(CHAR_ROWS))[ok].astype(np.int64))
        owner = word_of[: len(grams)][ok]
        parts.append(owner)
        counts += np.bincount(owner, minlength=len(words))
    rows, owners = np.concatenate(parts[::2]), np.concatenate(parts[1::2])
    del starts
    return rows[np.argsort(owners, kind="stable")], np.cumsum(counts) - counts


def window_starts(n: int) -> list[int]:
    """Starts of the overlapping windows that cover ``n`` words; the last one ends with the text."""
    return [*range(0, max(1, n - WINDOW), STRIDE), n - WINDOW] if n > WINDOW else [0] if n else []


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters; ``vocabulary`` gives a word's row in ``word`` (row 0: unknown)."""

    vocabulary: dict[bytes, int]
    prior: float
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)

    def __post_init__(self) -> None:
        if not self.p:
            rng = np.random.default_rng(7)
            inputs = WORD_DIM + CHAR_DIM
            shapes = {"word": (len(self.vocabulary) + 1, WORD_DIM), "char": (CHAR_ROWS, CHAR_DIM), "wx": (inputs, 6 * HIDDEN), "u": (2, HIDDEN, 3 * HIDDEN)}
            sizes = {"word": 0.1, "char": 0.1, "wx": 0.4, "u": 0.35}
            self.p = {k: (rng.standard_normal(s) * sizes[k]).astype(np.float32) for k, s in shapes.items()}
            self.p["bx"] = np.zeros(6 * HIDDEN, np.float32)
            self.p["vw"] = (rng.standard_normal((2, HIDDEN, 2)) * 0.3).astype(np.float32)
            self.p["b"] = np.zeros(1, np.float32)

    def inputs(self, words: list[bytes], drop: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """Word and character vectors of distinct words, and what backpropagation needs of them."""
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        if drop is not None:
            ids[drop] = 0
        rows, firsts = char_rows(words)
        counts = np.diff(np.append(firsts, len(rows)))
        weight = (1 / np.sqrt(counts)).astype(np.float32)[:, None]
        chars = np.add.reduceat(self.p["char"][rows], firsts, axis=0) * weight
        return np.concatenate((self.p["word"][ids], chars), axis=1), (ids, rows, counts, weight)

    def gates(self, words: list[bytes]) -> np.ndarray:
        """Gate inputs of distinct words: (words, direction, 3 * HIDDEN)."""
        return (self.inputs(words)[0] @ self.p["wx"] + self.p["bx"]).reshape(-1, 2, 3 * HIDDEN)

    def logits(self, table: np.ndarray, tokens: np.ndarray, trace: list | None = None) -> np.ndarray:
        """tokens (windows, WINDOW): rows of ``table``, -1 beyond the text."""
        count, steps = tokens.shape
        h, u = np.zeros((2, count, HIDDEN), np.float32), self.p["u"]
        mask = tokens >= 0
        padded = not mask.all()
        states = np.empty((steps, 2, count, HIDDEN), np.float32)
        for t in range(steps):
            x = np.stack((table[tokens[:, t], 0], table[tokens[:, steps - 1 - t], 1]))
            hu = np.matmul(h, u)
            rz = _sigmoid(x[..., : 2 * HIDDEN] + hu[..., : 2 * HIDDEN])
            r, z, un = rz[..., :HIDDEN], rz[..., HIDDEN:], hu[..., 2 * HIDDEN :]
            n = np.tanh(x[..., 2 * HIDDEN :] + r * un)
            new = n + z * (h - n)
            if trace is not None:
                trace.append((h, r, z, un, n))
            if padded:
                new = np.where(np.stack((mask[:, t], mask[:, steps - 1 - t]))[..., None], new, h)
            h = new
            states[t, 0], states[steps - 1 - t, 1] = h[0], h[1]
        pooled = np.matmul(states, self.p["vw"]).sum(axis=1)  # (steps, windows, attention and value)
        s, q = np.where(mask.T, pooled[..., 0], -1e9), pooled[..., 1]
        a = np.exp(s - s.max(axis=0))
        a /= a.sum(axis=0)
        if trace is not None:
            trace.append((states, a, q, mask))
        return (a * q).sum(axis=0) + self.p["b"]

    def step(self, windows: list[list[bytes]], labels: np.ndarray, weights: np.ndarray, rng: np.random.Generator, memory: dict, rate: float) -> None:
        """One step of Adagrad on a batch of windows."""
        known: dict[bytes, int] = {}
        tokens = np.full((len(windows), WINDOW), -1)
        for i, w in enumerate(windows):
            tokens[i, : len(w)] = [known.setdefault(x, len(known)) for x in w]
        p, words = self.p, list(known)
        x, (ids, rows, counts, weight) = self.inputs(words, rng.random(len(words)) < 0.25)
        table, trace = (x @ p["wx"] + p["bx"]).reshape(-1, 2, 3 * HIDDEN), []
        z = self.logits(table, tokens, trace)
        dl = ((_sigmoid(z) - labels) * weights / len(windows)).astype(np.float32)
        states, a, q, mask = trace.pop()
        dq, da = a * dl, q * dl
        ds = a * (da - (a * da).sum(axis=0))
        dpool = np.stack((ds, dq), axis=-1)
        grads = {"b": dl.sum(keepdims=True), "vw": np.einsum("tdbh,tbk->dhk", states, dpool, optimize=True)}
        dstates = np.einsum("tbk,dhk->tdbh", dpool, p["vw"], optimize=True)
        du, dh = np.zeros_like(p["u"]), np.zeros((2, len(windows), HIDDEN), np.float32)
        dxs = np.empty((tokens.shape[1], 2, len(windows), 3 * HIDDEN), np.float32)
        steps = tokens.shape[1]
        for t in reversed(range(steps)):
            h, r, zt, un, n = trace[t]
            back = steps - 1 - t
            dh = dh + np.stack((dstates[t, 0], dstates[back, 1]))
            m = np.stack((mask[:, t], mask[:, back]))[..., None]
            dnew = np.where(m, dh, 0)
            dn = dnew * (1 - zt) * (1 - n * n)
            dr, dz = dn * un * r * (1 - r), dnew * (h - n) * zt * (1 - zt)
            inner = np.concatenate((dr, dz, dn * r), axis=-1)
            du += np.matmul(h.transpose(0, 2, 1), inner)
            dh = np.where(m, dnew * zt, dh) + np.matmul(inner, p["u"].transpose(0, 2, 1))
            np.concatenate((dr, dz, dn), axis=-1, out=dxs[t])
        dtable = np.zeros_like(table)
        for direction, of_step in ((0, tokens.T), (1, tokens.T[::-1])):
            at, sums = _summed(of_step.ravel(), dxs[:, direction].reshape(-1, 3 * HIDDEN))
            dtable[at, direction] += sums  # -1 adds zeros to the last row
        dtable = dtable.reshape(len(words), -1)
        grads |= {"u": du, "wx": x.T @ dtable, "bx": dtable.sum(axis=0)}
        dx = dtable @ p["wx"].T
        for k, g in grads.items():
            memory[k] += g * g
            p[k] -= rate * g / np.sqrt(memory[k] + 1e-8)
        for k, index, g in (("char", rows, np.repeat(dx[:, WORD_DIM:] * weight, counts, axis=0)), ("word", ids, dx[:, :WORD_DIM])):
            at, g = _summed(index, g)  # only rows that the batch has
            memory[k][at] += g * g
            p[k][at] -= rate * g / np.sqrt(memory[k][at] + 1e-8)


def _summed(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indices and the sums of their rows."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    firsts = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
    return index[firsts], np.add.reduceat(values[order], firsts, axis=0)


class Scorer:
    """Scores texts with a network; keeps the gate inputs of words seen."""

    def __init__(self, network: Network) -> None:
        self.network = network
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.table = np.empty((0, 2, 3 * HIDDEN), np.float32)
        self.used = 0

    def tokens(self, words: list[list[bytes]]) -> list[np.ndarray]:
        if self.used > CACHE_ROWS:
            self.clear()
        rows = self.rows
        out = [np.fromiter((rows.setdefault(w, len(rows)) for w in ws), np.int64, len(ws)) for ws in words]
        if len(rows) > self.used:
            new = list(rows)[self.used :] if self.used else list(rows)
            if len(rows) > len(self.table):
                grown = np.empty((len(rows) * 5 // 4 + 1000, 2, 3 * HIDDEN), np.float32)
                grown[: self.used] = self.table[: self.used]
                self.table = grown
            for at in range(0, len(new), 20_000):
                part = new[at : at + 20_000]
                self.table[self.used : self.used + len(part)] = self.network.gates(part)
                self.used += len(part)
        return out

    def windows(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Logits of all windows of each text."""
        tokens = self.tokens(texts)
        starts = [window_starts(len(t)) for t in tokens]
        flat = np.concatenate([*tokens, np.full(WINDOW, -1)])
        firsts = np.cumsum([0, *map(len, tokens)])
        at = np.array([f + s for f, ss in zip(firsts, starts, strict=False) for s in ss], np.int64)
        if not len(at):
            return [np.empty(0, np.float32) for _ in texts]
        grid = at[:, None] + np.arange(WINDOW)
        room = np.repeat([min(len(t), WINDOW) for t in tokens], [len(s) for s in starts])
        z = np.empty(len(at), np.float32)
        for a in range(0, len(at), RUN_WINDOWS):
            part = flat[grid[a : a + RUN_WINDOWS]]
            part[np.arange(WINDOW) >= room[a : a + RUN_WINDOWS, None]] = -1
            z[a : a + RUN_WINDOWS] = self.network.logits(self.table, part)
        return np.split(z, np.cumsum([len(s) for s in starts])[:-1])

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        slope, shift = self.network.scale
        top = [z.max() if len(z) else None for z in self.windows(texts)]
        return np.array([self.network.prior if z is None else _sigmoid(np.float64(slope * z + shift)) for z in top], np.float64)


def train(texts: list[bytes], labels: list[int], share: float) -> Network:
    """Fits a network on labelled texts; ``share``: of label 1 among all labelled rows."""
    documents = [words_of(t) for t in texts]
    y = np.array(labels, np.float32)
    counts: dict[bytes, int] = {}
    for d in documents:
        for w in set(d):
            counts[w] = counts.get(w, 0) + 1
    kept = sorted((w for w, c in counts.items() if c >= MIN_COUNT), key=lambda w: (-counts[w], w))[:MAX_WORDS]
    network = Network({w: i + 1 for i, w in enumerate(kept)}, share)
    if len(set(labels)) < 2:
        return network
    _seed(network, documents, y)
    rng = np.random.default_rng(11)
    memory = {k: np.full_like(v, 1e-4) for k, v in network.p.items()}
    full = [i for i, d in enumerate(documents) if d]
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    done, epoch = 0, 0
    while epoch < EPOCHS or done < MIN_STEPS:
        zs = Scorer(network).windows([documents[i] for i in full]) if epoch else [_evidence(network, documents[i]) for i in full]
        picked: list[tuple[int, int]] = []
        for i, z in zip(full, zs, strict=True):
            starts = window_starts(len(documents[i]))
            top = np.argsort(-z, kind="stable")[:TOP]
            if not y[i]:
                top = np.append(top, rng.integers(len(starts)))
            picked += [(i, starts[k]) for k in dict.fromkeys(top.tolist())]
        order = rng.permutation(len(picked))
        for a in range(0, len(order), BATCH):
            part = [picked[k] for k in order[a : a + BATCH]]
            at = [i for i, _ in part]
            rate = 0.08 if epoch < EPOCHS - 2 else 0.03
            network.step([documents[i][s : s + WINDOW] for i, s in part], y[at], balance[at], rng, memory, rate)
            done += 1
        epoch += 1
    top = np.array([z.max() for z in Scorer(network).windows([documents[i] for i in full])], np.float64)
    network.scale = _calibrated(top, y[full], share)
    return network


def _seed(network: Network, documents: list[list[bytes]], y: np.ndarray) -> None:
    """Starts one coordinate of each word and n-gram vector at the evidence of its document counts."""
    word, char = np.zeros((2, len(network.vocabulary) + 1)), np.zeros((2, CHAR_ROWS))
    for d, label in zip(documents, y.astype(int).tolist(), strict=True):
        if own := list(set(d)):
            word[label][np.unique([network.vocabulary.get(w, 0) for w in own])] += 1
            char[label][np.unique(char_rows(own)[0])] += 1
    n1, n = y.sum(), len(y)
    for name, count in (("word", word), ("char", char)):
        q = (count.sum(axis=0) + 0.5) / (n + 1)
        z = (count[1] - n1 * q) / np.sqrt(n1 * (1 - n1 / n) * q * (1 - q) + 0.5)
        network.p[name][:, 0] = np.clip(z / 4, -1.5, 1.5)
    network.p["word"][0, 0] = 0


def _evidence(network: Network, words: list[bytes]) -> np.ndarray:
    """For each window the largest starting evidence of a word in it."""
    distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = network.inputs(list(distinct))[0]
    each = (x[:, 0] + x[:, WORD_DIM])[[distinct[w] for w in words]]
    return np.array([each[s : s + WINDOW].max() for s in window_starts(len(words))])


def _calibrated(z: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic slope and shift at the true share of label 1 (a few damped Newton steps)."""
    weight = np.where(y == 1, share / max(y.mean(), 1e-6), (1 - share) / max(1 - y.mean(), 1e-6))
    x, w = np.stack((z, np.ones_like(z)), axis=1), np.array([1.0, 0.0])
    for _ in range(30):
        p = _sigmoid(x @ w)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1.0, 0.01])
        w = w - np.linalg.solve(hess, x.T @ (weight * (p - y)) + np.array([1.0, 0.01]) * (w - np.array([1.0, 0.0])))
    return float(max(w[0], 0.05)), float(w[1])


def held_out(doc_id: Column) -> Column:
    """Rows whose CRC-32 of the id as text is divisible by ``FOLDS``; null ids count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit(documents: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Network:
    """Trains on a bounded sample of the labelled rows that are not held out."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    tally = dict(marked.groupBy("toxic").count().collect())
    share = tally.get(1, 0) / max(1, sum(tally.values()))
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = None
    for label in (0, 1):
        part = marked.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class * (1 if label else 3))
        chosen = part if chosen is None else chosen.unionByName(part)
    # the chosen ids are at most 4 * per_class rows
    sample = narrow.join(F.broadcast(chosen), "doc_id").where(F.length("text") <= max_chars)
    rows = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * per_class).collect()
    return train([r["text"].encode() for r in rows], [r["toxic"] for r in rows], share)


def _score(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in slices(batches, limit=1 << 20):
            values = scorer.scores([words_of(t) for t in texts_of(batch)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], names=["doc_id", "score"])

    return score


def score_toxicity(documents: DataFrame, network: Network) -> DataFrame:
    """documents(doc_id, text) -> doc_id, score of the whole text."""
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_score(documents.sparkSession.sparkContext.broadcast(network)), "doc_id long, score double")


def toxic_mask(network):
    """A mapInArrow function that keeps the rows (all columns) whose score is below 0.5."""
    model = network

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in slices(batches, limit=1 << 20):
            values = scorer.scores([words_of(t) for t in texts_of(batch)])
            yield batch.filter(pa.array(values < 0.5))

    return keep


def drop_toxic(documents: DataFrame, network: Network) -> DataFrame:
    """The rows of ``documents``, all columns, that score below 0.5."""
    return documents.mapInArrow(toxic_mask(documents.sparkSession.sparkContext.broadcast(network)), documents.schema)
