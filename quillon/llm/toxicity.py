"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

Inputs of a word: an embedding of its hashed form, the mean embedding of its hashed character
trigrams, and how much oftener it stands in toxic training documents (leave-one-out in training).
Windows of `WIDTH` words overlap; every window of the whole text is scored and a document has the
score of its highest window. Training is numpy in one task over a bounded sample of labelled rows, so
neither their texts nor the training take memory of the driver.

Defined cases: texts that are null or hold no word score 0; one-word texts are one window; very long texts are
scored whole, window by window; rows repeat as they are; an empty table gives no rows; with labels of one kind only, or none, every score
is that kind's share (0 without labels). Only text and the given label are ever read.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import id_text, through

WORD = re.compile(r"[^\W\d_]+")
WIDTH, STRIDE = 32, 24
WORDS, GRAMS, DIM, HID = 1 << 14, 1 << 12, 6, 8
OUT = "doc_id long, held_out boolean, score double, predicted int"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of ^word$ over all words, and where each word's begin."""
    raw = [("^" + w + "$").encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    end = np.cumsum(size)
    h = (data[:-2] * 961 + data[1:-1] * 31 + data[2:]) * np.uint32(2654435761) >> np.uint32(20)
    ok = np.ones(len(data), bool)
    ok[end - 1] = ok[end - 2] = False
    return h[ok[:-2]].astype(np.int32), np.concatenate([[0], np.cumsum(size - 2)[:-1]])


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.fromiter((zlib.crc32(w.encode()) & (WORDS - 1) for w in words), np.int64, len(words))
    return ids, *grams_of(words)


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def windows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(window ids padded with 0, document of each window); the words' ids start at 1."""
    own, of = [], []
    for d, ids in enumerate(docs):
        if len(ids):
            n = 1 + max(0, -(-(len(ids) - WIDTH) // STRIDE))
            flat = np.zeros((n - 1) * STRIDE + WIDTH, np.int32)
            flat[: len(ids)] = ids
            own.append(np.lib.stride_tricks.sliding_window_view(flat, WIDTH)[::STRIDE])
            of.append(np.full(n, d))
    return (np.concatenate(own), np.concatenate(of)) if own else (np.zeros((0, WIDTH), np.int32), np.zeros(0, np.int64))


@dataclass
class Model:
    prior: float
    p: dict | None = None
    odds: dict | None = None  # word -> log odds, for words seen in training

    def table(self, words: list[str]) -> np.ndarray:
        """Gate inputs of both directions for each word; row 0 is padding, which holds the state."""
        ids, grams, starts = features(words)
        odds = np.fromiter((self.odds.get(w, 0.0) for w in words), np.float32, len(words))
        return project(self.p, ids, grams, starts, odds)[0]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.p is None:
            return np.array([self.prior if t and WORD.search(t) else 0.0 for t in texts])
        slot: defaultdict = defaultdict()
        slot.default_factory = slot.__len__
        docs = [np.fromiter(map(slot.__getitem__, words_of(t)), np.int64) + 1 for t in texts]
        out = np.zeros(len(texts))
        if slot:
            table = self.table(list(slot))
            wins, of = windows(docs)
            for i in range(0, len(wins), 2048):
                logit = forward(self.p, table, wins[i : i + 2048])[0]
                np.maximum.at(out, of[i : i + 2048], sigmoid(logit.astype(np.float64)))
        return out


def project(p, ids, grams, starts, odds):
    sums = np.empty((len(starts), DIM), np.float32)
    for i in range(0, len(starts), 20_000):
        end = starts[i + 20_000] if i + 20_000 < len(starts) else len(grams)
        sums[i : i + 20_000] = np.add.reduceat(p["grams"][grams[starts[i] : end]], starts[i : i + 20_000] - starts[i], axis=0)
    count = np.diff(np.append(starts, len(grams)))[:, None]
    x = np.concatenate([p["words"][ids], sums / count, odds[:, None]], axis=1).astype(np.float32)
    table = np.empty((len(ids) + 1, 6 * HID), np.float32)
    table[1:] = x @ p["wx"] + p["bx"]
    table[0] = 0
    table[0, :HID] = table[0, 3 * HID : 4 * HID] = 30  # the update gate stays shut
    return table, x


def gru(g, u, back: bool = True):
    """g: steps x rows x 3*HID gate inputs -> states, and what the way back needs."""
    steps, rows, _ = g.shape
    h = np.zeros((rows, HID), np.float32)
    states, keep = np.empty((steps, rows, HID), np.float32), []
    for t in range(steps):
        hu = h @ u
        zr = sigmoid(g[t, :, : 2 * HID] + hu[:, : 2 * HID])
        z, r, m = zr[:, :HID], zr[:, HID:], hu[:, 2 * HID :]
        n = np.tanh(g[t, :, 2 * HID :] + r * m)
        if back:
            keep.append((h, z, r, m, n))
        h = n + z * (h - n)
        states[t] = h
    return states, keep


def gru_back(d, keep, u):
    """d: gradient of the states -> that of the gate inputs and of u."""
    dg, du, dh = np.empty((*d.shape[:2], 3 * HID), np.float32), np.zeros_like(u), np.zeros(d.shape[1:], np.float32)
    for t in range(len(keep) - 1, -1, -1):
        h, z, r, m, n = keep[t]
        dh = dh + d[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * m * r * (1 - r)
        dg[t] = np.concatenate([dz, dr, dn], axis=1)
        dhu = np.concatenate([dz, dr, dn * r], axis=1)
        du += h.T @ dhu
        dh = dh * z + dhu @ u.T
    return dg, du


def forward(p, table, wins, back: bool = False):
    g = table[wins.T]
    a, ka = gru(g[:, :, : 3 * HID], p["uf"], back)
    b, kb = gru(g[::-1, :, 3 * HID :], p["ub"], back)
    s = np.concatenate([a, b[::-1]], axis=2)
    e = np.where(wins.T == 0, -1e9, s @ p["att"])
    w = np.exp(e - e.max(axis=0))
    w /= w.sum(axis=0)
    pooled = (w[:, :, None] * s).sum(axis=0)
    return pooled @ p["out"] + p["b"][0], (s, w, pooled, ka, kb)


def train(texts: list[str], toxic: list[int], steps: int = 250, rate: float = 0.01, seed: int = 7) -> Model:
    """Logistic loss on the highest window of each document, and on a random one of clean ones.

    There are enough passes for `steps` batches, but 10 at least and 16 at most.
    """
    rng, y = np.random.default_rng(seed), np.array(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(float(y.mean()) if len(y) else 0.0)
    slot: defaultdict = defaultdict()
    slot.default_factory = slot.__len__
    docs = [np.fromiter(map(slot.__getitem__, words_of(t)), np.int64) + 1 for t in texts]
    vocab = list(slot)
    pos, neg = np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1)
    for d, t in zip(docs, toxic):
        (pos if t else neg)[np.unique(d)] += 1
    n_pos, n_neg = y.sum(), len(y) - y.sum()

    def odds_for(p, n):
        # a pseudo-count of the shared rate keeps rare words near 0
        return (np.log((p + 1) / (n_pos + 1)) - np.log((n + n_neg / n_pos) / (n_neg + n_neg / n_pos)))[1:].astype(np.float32)

    odds = odds_for(pos, neg)
    loo = (odds_for(pos, np.maximum(neg - 1, 0)), odds_for(np.maximum(pos - 1, 0), neg))
    wins, of = windows(docs)
    first = np.zeros(len(docs), np.int64)
    first[1:] = np.searchsorted(of, np.arange(1, len(docs)))
    has = np.flatnonzero(np.bincount(of, minlength=len(docs)))
    ids, grams, starts = features(vocab)
    scale = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    dim = 2 * DIM + 1
    p = {"words": np.zeros((WORDS, DIM), np.float32), "grams": rng.normal(0, 0.05, (GRAMS, DIM)).astype(np.float32), "wx": scale(dim, 6 * HID), "bx": np.zeros(6 * HID, np.float32), "uf": scale(HID, 3 * HID), "ub": scale(HID, 3 * HID), "att": scale(2 * HID), "out": scale(2 * HID), "b": np.array([-1.0], np.float32)}
    for at in (2 * HID, 5 * HID):  # at first the states rise with the last input, and so does the score
        p["wx"][-1, at : at + HID] = np.abs(p["wx"][-1, at : at + HID]) + 0.5
    p["att"], p["out"] = np.abs(p["att"]) + 0.5, np.abs(p["out"]) + 0.2
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    counts = np.diff(np.append(starts, len(grams)))
    gram_word = np.repeat(np.arange(len(vocab)), counts)
    free = 0.5 * min(1.0, len(docs) / 2000)  # few documents must not be learned by heart
    epochs = int(min(16, max(10, -(-steps * 256 // (len(has) + n_neg)))))
    for epoch in range(epochs):
        tables = [project(p, ids, grams, starts, o)[0] for o in loo]
        if epoch:
            scores = np.empty(len(wins), np.float32)
            for i in range(0, len(wins), 1024):
                part = slice(i, i + 1024)
                for k in (0, 1):
                    at = np.flatnonzero(y[of[part]] == k) + i
                    if len(at):
                        scores[at] = forward(p, tables[k], wins[at])[0]
        else:
            lift = [np.append(np.float32(-9), o) for o in loo]
            scores = np.where(y[of] == 1, lift[1][wins].max(axis=1), lift[0][wins].max(axis=1))
        order = np.lexsort((scores, of))
        top = order[np.append(np.flatnonzero(np.diff(of)), len(of) - 1)]  # the last window of each document
        clean = has[y[has] == 0]
        size = np.bincount(of, minlength=len(docs))
        extra = first[clean] + rng.integers(0, size[clean])
        pick = rng.permutation(np.concatenate([top, extra]))
        for i in range(0, len(pick), 256):
            take = pick[i : i + 256]
            t = y[of[take]]
            for k in (0, 1):
                at = take[t == k]
                if not len(at):
                    continue
                used, inv = np.unique(wins[at], return_inverse=True)
                inv = inv.reshape(wins[at].shape)
                if used[0] != 0:
                    used, inv = np.append(0, used), inv + 1
                w = used[1:] - 1
                n_grams = counts[w]
                at_gram = np.repeat(starts[w] - (np.cumsum(n_grams) - n_grams), n_grams) + np.arange(n_grams.sum())
                own_grams, own_starts = grams[at_gram], np.cumsum(n_grams) - n_grams
                table, x = project(p, ids[w], own_grams, own_starts, loo[k][w])
                logit, (s, a, pooled, ka, kb) = forward(p, table, inv, True)
                d = (sigmoid(logit) - k).astype(np.float32) / len(take)
                g = {"b": np.array([d.sum()], np.float32), "out": d @ pooled}
                dp = d[:, None] * p["out"]
                da = (s * dp).sum(axis=2)
                de = a * (da - (a * da).sum(axis=0))
                g["att"] = np.einsum("tb,tbh->h", de, s)
                ds = a[:, :, None] * dp + de[:, :, None] * p["att"]
                gf, g["uf"] = gru_back(ds[:, :, :HID], ka, p["uf"])
                gb, g["ub"] = gru_back(np.ascontiguousarray(ds[::-1, :, HID:]), kb, p["ub"])
                both = np.concatenate([gf, gb[::-1]], axis=2)
                dt = np.zeros_like(table)
                np.add.at(dt, inv.T, both)
                dt = dt[1:]
                g["wx"], g["bx"] = x.T @ dt, dt.sum(axis=0)
                dx = dt @ p["wx"].T
                g["words"], g["grams"] = np.zeros_like(p["words"]), np.zeros_like(p["grams"])
                np.add.at(g["words"], ids[w], dx[:, :DIM])
                np.add.at(g["grams"], own_grams, np.repeat(dx[:, DIM : 2 * DIM] / n_grams[:, None], n_grams, axis=0))
                step += 1
                for name, v in g.items():
                    m1[name] += 0.1 * (v - m1[name])
                    m2[name] += 0.01 * (v * v - m2[name])
                    p[name] -= (rate * free if name in ("words", "grams") else rate) * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.99**step)) + 1e-8)
        for name in ("words", "grams"):
            p[name] *= 0.9
    return Model(float(y.mean()), p, {w: float(o) for w, o in zip(vocab, odds) if abs(o) > 0.05})


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_each: int = 1500, most_chars: int = 20_000) -> Model:
    """Train on the (at most) `most_each` toxic and `most_each` clean labelled documents of lowest hash
    among those of up to `most_chars` characters. A document counts as toxic if any of its labels does."""
    marks = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("toxic")).where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    rows = id_text(docs, id_col, text_col).where(F.length("text") <= most_chars)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(rows.select("doc_id"), "doc_id", "left_semi")
    picked = [marks.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_each) for k in (0, 1)]
    chosen = picked[0].unionByName(picked[1])  # at most 2 * most_each rows
    # an id that is repeated gives one of its texts, the same one each time
    own = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(batches):
        import pyarrow as pa

        got = sorted((r["doc_id"], r["text"], r["toxic"]) for b in batches for r in b.to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([t for _, t, _ in got], [k for *_, k in got]))], pa.binary())], ["model"])

    made = through(own.repartition(1), run, "model binary").first()
    return pickle.loads(bytes(made["model"])) if made else Model(0.0)


def score(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    box = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        from quillon.llm.tokens import chunks

        for b in batches:
            texts = b.column(1).to_pylist()
            got = [box.value.score(texts[lo:hi]) for lo, hi in chunks([t or "" for t in texts], 2_000_000)]
            s = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return through(id_text(docs, id_col, text_col).select("doc_id", "text", held_out.alias("held_out")), run, OUT)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score at or above the threshold: judged in place, all columns stay."""
    box, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        from quillon.llm.tokens import chunks

        for b in batches:
            texts = [t or "" for t in b.column(place).to_pylist()]
            for lo, hi in chunks(texts, 2_000_000):
                yield b.slice(lo, hi - lo).filter(pa.array(box.value.score(texts[lo:hi]) < threshold))

    return through(docs, run, docs.schema)
