"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as the embedding of its hash and the mean embedding of its
character 3- and 4-grams. Two gated recurrent layers read a window in both
directions, attention pools their states, and a logistic unit scores the window.
A document's score is that of its highest window; the windows overlap and
cover the whole text. The network is trained in numpy, by one task, on a
bounded sample of labelled documents; scoring is a map over all documents.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pandekt.llm.common import MARKS, bytes_of, mix64, released, row_slices, small_batches, word_hashes

WINDOW, STRIDE = 48, 32
HIDDEN, WORD_DIM, CHAR_DIM, ATTEND = 8, 8, 8, 8
WORD_BUCKETS, CHAR_BUCKETS = 1 << 15, 1 << 13
#: Bound of the training sample: at most this many documents of each class.
SAMPLE_PER_CLASS = 1500
SLICE_BYTES = 2 << 20
WORD_BLOCK = 1 << 14
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1


# Inputs.

class Words:
    """The distinct words of some texts with their buckets and character n-grams."""

    def __init__(self, texts: list[bytes]) -> None:
        hashes, self.counts, buf, starts, ends = word_hashes(texts, MARKS)
        _, first, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        self.bucket = (hashes[first] % np.uint64(WORD_BUCKETS)).astype(np.int64)
        starts, ends = starts[first], ends[first]
        # Words with a mark on either side: bytes from one before to one after, the outer ones as spaces.
        length = ends - starts + 2
        padded = np.where(MARKS[buf], 32, buf).astype(np.uint8)
        parts = [self._grams(padded, starts[a:a + WORD_BLOCK], length[a:a + WORD_BLOCK], a) for a in range(0, len(first), WORD_BLOCK)]
        self.gram, self.owner = (np.concatenate([p[k] for p in parts] or [np.zeros(0, dtype=np.int32)]) for k in (0, 1))
        self.n_grams = np.bincount(self.owner, minlength=len(first))

    @staticmethod
    def _grams(padded: np.ndarray, starts: np.ndarray, length: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
        """(n-gram bucket, word) of a block of words, by word."""
        grams, owners = [], []
        for n in (3, 4):
            many = np.maximum(length - n + 1, 0)
            owner = np.repeat(np.arange(len(starts)), many)
            at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + starts[owner] - 1
            value = np.full(len(at), n, dtype=np.uint64)
            for k in range(n):
                byte = np.where(at + k < 0, np.uint8(32), padded[np.maximum(at + k, 0)])
                value = value * np.uint64(257) + byte
            grams.append((mix64(value) % np.uint64(CHAR_BUCKETS)).astype(np.int32))
            owners.append(owner.astype(np.int32))
        gram, owner = np.concatenate(grams), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return gram[order], owner[order] + np.int32(offset)

    def chars(self, table: np.ndarray) -> np.ndarray:
        """Mean n-gram embedding of every distinct word (each has an n-gram)."""
        if not len(self.gram):
            return np.zeros((0, table.shape[1]), dtype=np.float32)
        return np.add.reduceat(table[self.gram], np.r_[0, np.cumsum(self.n_grams)[:-1]], axis=0) / self.n_grams[:, None].astype(np.float32)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word position, mask, text) of all overlapping windows; a text has at least one."""
    many = np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(counts)), many)
    nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    offset = nth[:, None] * STRIDE + np.arange(WINDOW)
    mask = offset < counts[text][:, None]
    base = (np.cumsum(counts) - counts)[text]
    return np.where(mask, base[:, None] + offset, -1), mask, text


# The network.

def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def new_model(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d = WORD_DIM + CHAR_DIM
    weight = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
    m = {"word": weight(WORD_BUCKETS, WORD_DIM) * 0, "char": weight(CHAR_BUCKETS, CHAR_DIM) * 0}
    for side in "fb":
        m |= {f"W{side}": weight(d, 3 * HIDDEN), f"U{side}": weight(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, dtype=np.float32)}
    m |= {"A": weight(2 * HIDDEN, ATTEND), "a": np.zeros(ATTEND, dtype=np.float32), "q": weight(ATTEND, 1)[:, 0], "o": weight(2 * HIDDEN, 1)[:, 0], "b": np.zeros(1, dtype=np.float32)}
    return m


def project(m: dict, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, forward and backward input terms) of every distinct word."""
    x = np.concatenate([m["word"][words.bucket], words.chars(m["char"])], axis=1)
    return x, x @ m["Wf"] + m["cf"], x @ m["Wb"] + m["cb"]


def recur(terms: np.ndarray, mask: np.ndarray, U: np.ndarray, reverse: bool, keep: bool):
    """States (steps, windows, hidden) of one direction; masked steps carry the state on."""
    steps, n, _ = terms.shape
    H = HIDDEN
    h = np.zeros((n, H), dtype=np.float32)
    states = np.empty((steps, n, H), dtype=np.float32)
    memory = []
    Ug, Uc = np.ascontiguousarray(U[:, :2 * H]), np.ascontiguousarray(U[:, 2 * H:])
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        g = sigmoid(terms[t, :, :2 * H] + h @ Ug)
        z, r = g[:, :H], g[:, H:]
        c = np.tanh(terms[t, :, 2 * H:] + (r * h) @ Uc)
        step = (1 - z) * mask[t]
        new = h + step * (c - h)
        if keep:
            memory.append((t, h, z, r, c))
        h = new
        states[t] = h
    return states, memory


def pool(m: dict, states: np.ndarray, mask: np.ndarray):
    """Attention over the steps: (logits, scores, attention, hidden of the attention, context)."""
    hidden = np.tanh(states @ m["A"] + m["a"])
    energy = np.where(mask[:, :, 0] > 0, hidden @ m["q"], np.float32(-1e9))
    energy -= energy.max(axis=0)
    weight = np.exp(energy) * mask[:, :, 0]
    weight /= np.maximum(weight.sum(axis=0), np.float32(1e-9))
    context = (weight[:, :, None] * states).sum(axis=0)
    return context @ m["o"] + m["b"][0], weight, hidden, context


def forward(m: dict, words: Words, position: np.ndarray, mask: np.ndarray, inputs=None, keep: bool = False):
    x, tf, tb = inputs or project(m, words)
    word = np.where(position >= 0, words.word[np.maximum(position, 0)] if len(words.word) else 0, 0).T
    mk = mask.T[:, :, None].astype(np.float32)
    zero = np.zeros((*word.shape, 3 * HIDDEN), dtype=np.float32)
    sf, memf = recur(tf[word] if len(tf) else zero, mk, m["Uf"], False, keep)
    sb, memb = recur(tb[word] if len(tb) else zero, mk, m["Ub"], True, keep)
    states = np.concatenate([sf, sb], axis=2)
    logit, weight, hidden, context = pool(m, states, mk)
    return logit, (x, word, mk, memf, memb, states, weight, hidden, context)


def backward(m: dict, words: Words, cache, d_logit: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of all parameters; d_logit is the loss's derivative by each logit."""
    x, word, mk, memf, memb, states, weight, hidden, context = cache
    g = {"o": context.T @ d_logit, "b": np.array([d_logit.sum()], dtype=np.float32)}
    d_context = d_logit[:, None] * m["o"]
    d_states = weight[:, :, None] * d_context
    d_weight = (states * d_context).sum(axis=2)
    d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["q"] = (hidden * d_energy[:, :, None]).sum(axis=(0, 1))
    d_hidden = d_energy[:, :, None] * m["q"] * (1 - hidden * hidden)
    g["A"] = states.reshape(-1, 2 * HIDDEN).T @ d_hidden.reshape(-1, ATTEND)
    g["a"] = d_hidden.sum(axis=(0, 1))
    d_states = d_states + d_hidden @ m["A"].T
    H = HIDDEN
    d_x = np.zeros_like(x)
    for side, memory, part in (("f", memf, d_states[:, :, :H]), ("b", memb, d_states[:, :, H:])):
        U = m[f"U{side}"]
        d_u, d_terms = np.zeros_like(U), np.zeros((*word.shape, 3 * H), dtype=np.float32)
        d_h = np.zeros_like(part[0])
        for t, h, z, r, c in reversed(memory):
            d_new = part[t] + d_h
            step = (1 - z) * mk[t]
            d_pre = d_new * step * (1 - c * c)
            d_z = -d_new * (c - h) * mk[t] * z * (1 - z)
            d_rh = d_pre @ U[:, 2 * H:].T
            d_r = d_rh * h * r * (1 - r)
            d_gate = np.concatenate([d_z, d_r], axis=1)
            d_u[:, 2 * H:] += (r * h).T @ d_pre
            d_u[:, :2 * H] += h.T @ d_gate
            d_h = d_new * (1 - step) + d_rh * r + d_gate @ U[:, :2 * H].T
            d_terms[t] = np.concatenate([d_gate, d_pre], axis=1)
        flat = d_terms.reshape(-1, 3 * H)
        g[f"U{side}"], g[f"c{side}"] = d_u, flat.sum(axis=0)
        per_word = np.zeros((len(x), 3 * H), dtype=np.float32)
        np.add.at(per_word, word.ravel(), flat * mk.reshape(-1, 1))
        g[f"W{side}"] = x.T @ per_word
        d_x += per_word @ m[f"W{side}"].T
    g["word"] = (words.bucket, d_x[:, :WORD_DIM])
    d_char = d_x[:, WORD_DIM:] / np.maximum(words.n_grams, 1)[:, None].astype(np.float32)
    g["char"] = (words.gram, d_char[words.owner])
    return g


class Adam:
    def __init__(self, m: dict, rate: float) -> None:
        self.m, self.rate, self.t = m, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in m.items()}
        self.second = {k: np.zeros_like(v) for k, v in m.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            rows = slice(None)
            if isinstance(g, tuple):  # only the rows in use
                rows, at = np.unique(g[0], return_inverse=True)
                full = np.zeros((len(rows), g[1].shape[1]), dtype=np.float32)
                np.add.at(full, at, g[1])
                g = full
            g = np.clip(g, -1, 1)
            self.first[k][rows] = 0.9 * self.first[k][rows] + 0.1 * g
            self.second[k][rows] = 0.99 * self.second[k][rows] + 0.01 * g * g
            up = self.first[k][rows] / (1 - 0.9 ** self.t)
            self.m[k][rows] -= (self.rate * up / (np.sqrt(self.second[k][rows] / (1 - 0.99 ** self.t)) + 1e-6)).astype(np.float32)


# Training.

def _log_odds(parts: Iterator[tuple[np.ndarray, np.ndarray]], label: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log odds of a document being toxic, given that it holds the item, from (text, item) parts of whole texts."""
    bad, good = np.zeros(size), np.zeros(size)
    for owner, item in parts:
        pair = np.unique(owner * np.int64(size) + item)
        text, thing = pair // size, pair % size
        bad += np.bincount(thing, weights=label[text], minlength=size)
        good += np.bincount(thing, weights=1 - label[text], minlength=size)
    n_bad, n_good = max(label.sum(), 1), max((1 - label).sum(), 1)
    return (np.log((bad + 0.3) / (n_bad + 0.6)) - np.log((good + 0.3) / (n_good + 0.6))).astype(np.float32)


def score_windows(m: dict, words: Words, position: np.ndarray, mask: np.ndarray, size: int = 1024) -> np.ndarray:
    inputs = project(m, words)
    parts = [forward(m, words, position[a:a + size], mask[a:a + size], inputs)[0] for a in range(0, len(position), size)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.float32)


def highest(text: np.ndarray, logit: np.ndarray) -> np.ndarray:
    """Index of the highest window of every text (windows are ordered by text)."""
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    order = np.lexsort((-logit, text))
    return order[first]


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 6, rounds: int = 2, rate: float = 0.02, batch: int = 256, seed: int = 3) -> dict[str, np.ndarray]:
    """Fit the network on whole documents of which only the label is known.

    Word and n-gram embeddings start from the log odds of their occurrence.
    A toxic document teaches by its most suspicious window, a clean one by its most
    suspicious and one random window; after each round the network itself
    chooses the windows anew.
    """
    m = new_model()
    if not len(labels) or labels.min() == labels.max():
        m["o"][:] = 0
        m["b"][0] = 6.0 if len(labels) and labels.min() == 1 else -6.0
        return m
    words = Words(texts)
    label = labels.astype(np.float64)
    first_word = np.r_[0, np.cumsum(words.counts)]
    first_gram = np.cumsum(words.n_grams) - words.n_grams

    def holds(kind: str):
        """(text, item) of some texts at a time: an n-gram occurs in far more words than there are texts."""
        for a in range(0, len(texts), 64):
            b = min(a + 64, len(texts))
            own = np.repeat(np.arange(a, b), words.counts[a:b])
            word = words.word[first_word[a]:first_word[b]]
            if kind == "word":
                yield own, words.bucket[word]
                continue
            pair = np.unique(own * np.int64(max(1, len(words.bucket))) + word)
            own, word = pair // max(1, len(words.bucket)), pair % max(1, len(words.bucket))
            many = words.n_grams[word]
            at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first_gram[word], many)
            yield np.repeat(own, many), words.gram[at]

    m["word"][:, 0] = _log_odds(holds("word"), label, WORD_BUCKETS) / 3
    m["char"][:, 0] = _log_odds(holds("char"), label, CHAR_BUCKETS)
    rng = np.random.default_rng(seed)
    m["word"][:, 1:] = rng.standard_normal((WORD_BUCKETS, WORD_DIM - 1)) * 0.05
    m["char"][:, 1:] = rng.standard_normal((CHAR_BUCKETS, CHAR_DIM - 1)) * 0.05
    position, mask, text = windows(words.counts)
    hint = (m["word"][words.bucket, 0] + words.chars(m["char"])[:, 0]) if len(words.bucket) else np.zeros(1)
    suspicion = np.where(mask, np.exp(2 * hint[words.word[np.maximum(position, 0)]]), 0).sum(axis=1) if len(words.word) else np.zeros(len(text))
    optimiser = Adam(m, rate)
    per_text = np.bincount(text, minlength=len(texts))
    start = np.cumsum(per_text) - per_text
    for again in range(rounds):
        top = highest(text, suspicion if not again else score_windows(m, words, position, mask))
        clean = np.flatnonzero(label == 0)
        other = start[clean] + (rng.random(len(clean)) * per_text[clean]).astype(np.int64)
        chosen = np.concatenate([top, other])
        target = np.concatenate([label, np.zeros(len(other))]).astype(np.float32)
        share = target.mean()
        cost = np.where(target > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        for epoch in range(epochs):
            optimiser.rate = rate * (0.5 ** (epoch // 2)) * (0.5 ** again)
            order = rng.permutation(len(chosen))
            for a in range(0, len(order), batch):
                pick = order[a:a + batch]
                pos, mk = position[chosen[pick]], mask[chosen[pick]]
                # Only the words of this batch.
                used, local = np.unique(words.word[np.maximum(pos, 0)] if len(words.word) else np.zeros_like(pos), return_inverse=True)
                part = _subset(words, used, local.reshape(pos.shape), mk)
                logit, cache = forward(m, part, np.where(mk, np.arange(pos.size).reshape(pos.shape), -1), mk, keep=True)
                d = (sigmoid(logit) - target[pick]) * cost[pick] / len(pick)
                optimiser.step(backward(m, part, cache, d))
    return m


def _subset(words: Words, used: np.ndarray, local: np.ndarray, mask: np.ndarray) -> Words:
    part = object.__new__(Words)
    part.word = local.ravel()
    part.bucket = words.bucket[used] if len(words.bucket) else np.zeros(0, dtype=np.int64)
    n = words.n_grams[used] if len(words.bucket) else np.zeros(0, dtype=np.int64)
    begin = (np.cumsum(words.n_grams) - words.n_grams)[used] if len(words.bucket) else n
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    part.gram, part.owner, part.n_grams = words.gram[at], np.repeat(np.arange(len(n)), n), n
    part.counts = mask.sum(axis=1)
    return part


def dump(m: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **m)
    return out.getvalue()


def load(raw: bytes) -> dict[str, np.ndarray]:
    data = np.load(io.BytesIO(raw))
    return {k: data[k] for k in data.files}


def in_held_out(doc_id) -> F.Column:
    """True for the fold that labels aren't learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> bytes:
    """Train on at most ``per_class`` labelled documents of each class outside the held-out fold.

    Documents are chosen by a hash of their id. Null labels and ids are left
    out; an id with several labels counts as toxic if any says so.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.filter(~in_held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.filter(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    # At most 2 * per_class narrow rows: small enough to send to every task.
    ids = F.broadcast(chosen[0].union(chosen[1]))
    sample = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(ids, "doc_id")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column("doc_id").to_pylist(), bytes_of(b.column("text")), b.column("toxic").to_pylist(), strict=True)]
        rows.sort()
        model = train([r[1] for r in rows], np.array([r[2] for r in rows], dtype=np.int64))
        yield pa.RecordBatch.from_pydict({"model": pa.array([dump(model)], pa.binary())})

    got = sample.repartition(1).mapInArrow(released(learn), "model binary").collect()
    return bytes(got[0]["model"]) if got else dump(train([], np.zeros(0, dtype=np.int64)))


def score(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the ``carry`` columns, text and score in [0, 1]: the highest score of any window.

    Null and empty texts are one window without words. Repeated rows are scored
    alike, and nothing but the text enters a score. Columns not named are left
    out. An empty table gives no rows.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c).alias(f"_c_{c}") for c in carry], F.col(text).alias("text"))
    names = ["doc_id", *[f"_c_{c}" for c in carry], "text"]
    schema = ", ".join(f"`{n}` {src.schema[n].dataType.simpleString()}" for n in names) + ", score double"
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(sent.value)
        for part in row_slices(batches, "text", SLICE_BYTES):
            words = Words(bytes_of(part.column("text")))
            position, mask, text_of = windows(words.counts)
            logit = score_windows(m, words, position, mask).astype(np.float64)
            best = logit[highest(text_of, logit)]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(1 / (1 + np.exp(-best)))], names=[*names, "score"])

    return src.mapInArrow(released(run), schema).select("doc_id", *[F.col(f"_c_{c}").alias(c) for c in carry], "text", "score")
