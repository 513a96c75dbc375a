"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (runs of ``PASSAGE`` words over the whole text). Each
passage is encoded, h = tanh(W x + b) from its character-class, word and repetition
features; gated attention a = softmax(w . (tanh(V h) * sigmoid(U h))) weighs the
passages; the weighted sum is scored by a logistic unit. Only document labels are
needed: the attention learns which passages tell.

The network is fitted on a bounded sample of the labelled rows (``max_train``
documents, the smallest key hashes, of ``max_passages`` passages together), featurised on
the executors. Scoring covers every
row and its whole text.

Defined cases: null or blank text is a bag with one empty passage and gets that bag's
score; without labelled rows every score is 0.5, and with one class only the score
stays near that class. Several labels of one key: their maximum. Columns beside key
and text are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens.llm import words as W

PASSAGE, HIDDEN, GATE = 64, 24, 12
CLASSES, BUCKETS, STATS = 16, 128, 4
WIDTH = CLASSES * CLASSES + BUCKETS + STATS


def _class_table() -> np.ndarray:
    """Byte -> character class (0 lower-case letter ... 15 other symbol)."""
    t = np.full(256, 15, dtype=np.int64)
    t[97:123], t[65:91], t[48:58], t[128:] = 0, 1, 2, 5
    t[32] = t[9] = 3
    t[10] = t[13] = 4
    for k, chars in enumerate((".", ",", "!", "?", "\"'`", "|", "()[]{}", "-_/", ":;"), start=6):
        t[[ord(c) for c in chars]] = k
    return t


_TABLE = _class_table()


def features(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(passage features, document of each passage); every text has a passage at least."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf, starts, ends, doc = W.words(texts)
    cased = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
    n = len(texts)
    count = np.bincount(doc, minlength=n)
    per_doc = np.maximum(1, -(-count // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per_doc)])
    owner = np.repeat(np.arange(n), per_doc)
    x = np.zeros((first[-1], WIDTH), dtype=np.float32)
    if not len(starts):
        return x, owner
    nth = np.arange(len(starts)) - np.concatenate([[0], np.cumsum(count)])[doc]
    passage = first[doc] + nth // PASSAGE
    # class pairs: a byte belongs to the passage of the last word begun before it
    cls = _TABLE[cased]
    mark = np.zeros(len(cased), dtype=np.int64)
    mark[starts] = 1
    word_at = np.cumsum(mark) - 1
    pair_at = passage[np.maximum(word_at[1:], 0)]
    lo = x.shape[0] * CLASSES * CLASSES
    pairs = np.bincount(pair_at * CLASSES * CLASSES + cls[:-1] * CLASSES + cls[1:], minlength=lo).reshape(len(x), -1)
    h = W.hashes(buf, starts, ends)
    bag = np.bincount(passage * BUCKETS + (h >> np.uint64(57)).astype(np.int64),
                      minlength=len(x) * BUCKETS).reshape(len(x), BUCKETS)
    size = np.bincount(passage, minlength=len(x))
    full = np.maximum(size, 1)[:, None]
    x[:, :CLASSES ** 2] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
    x[:, CLASSES ** 2:-STATS] = np.sqrt(bag / full)
    order = np.lexsort((h, passage))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
    x[:, -4] = np.bincount(passage[order][new], minlength=len(x)) / full[:, 0]
    x[:, -3] = np.bincount(passage[same], minlength=len(x)) / full[:, 0]
    x[:, -2] = np.bincount(passage, weights=ends - starts, minlength=len(x)) / full[:, 0] / 16
    x[:, -1] = np.log1p(size) / 4
    return x, owner


def _sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def _forward(p: dict, x: np.ndarray, owner: np.ndarray, n: int):
    h = np.tanh(x @ p["W"] + p["b"])
    tv, su = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (tv * su) @ p["w"]
    top = np.full(n, -np.inf, dtype=e.dtype)
    np.maximum.at(top, owner, e)
    a = np.exp(e - top[owner])
    a = a / np.bincount(owner, weights=a, minlength=n)[owner]
    first = np.searchsorted(owner, np.arange(n))
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return h, tv, su, a, first, z, _sigmoid(z @ p["c"] + p["c0"])


def gradients(p: dict, x: np.ndarray, owner: np.ndarray, label: np.ndarray) -> dict:
    """Gradients of the mean log loss of bags; ``owner`` ascends and names every bag."""
    n = len(label)
    h, tv, su, a, first, z, out = _forward(p, x, owner, n)
    dz_logit = ((out - label) / n).astype(x.dtype)
    dz = dz_logit[:, None] * p["c"]
    da = (dz[owner] * h).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, first)[owner])
    dg = de[:, None] * p["w"]
    dtv, dsu = dg * su * (1 - tv ** 2), dg * tv * su * (1 - su)
    dh = (a[:, None] * dz[owner] + dtv @ p["V"].T + dsu @ p["U"].T) * (1 - h ** 2)
    return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dtv, "U": h.T @ dsu,
            "w": (de[:, None] * tv * su).sum(axis=0), "c": z.T @ dz_logit, "c0": np.array([dz_logit.sum()])}


def fit(x: np.ndarray, owner: np.ndarray, label: np.ndarray, epochs: int = 40, batch: int = 256,
        rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> dict:
    """Adam on the log loss over bags; ``owner`` ascends."""
    rng = np.random.default_rng(seed)

    def start(*shape):
        return rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)

    base = float(np.clip(label.mean(), 0.01, 0.99))
    p = {"W": start(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": start(HIDDEN, GATE),
         "U": start(HIDDEN, GATE), "w": start(GATE), "c": start(HIDDEN),
         "c0": np.array([np.log(base / (1 - base))], np.float32)}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    bounds = np.searchsorted(owner, np.arange(len(label) + 1))
    step = 0
    for _ in range(epochs):
        deal = rng.permutation(len(label))
        for lo in range(0, len(label), batch):
            pick = np.sort(deal[lo:lo + batch])
            rows = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in pick])
            own = np.repeat(np.arange(len(pick)), bounds[pick + 1] - bounds[pick])
            xb, y = x[rows], label[pick]
            g = gradients(p, xb, own, y)
            step += 1
            for k in p:
                gk = g[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                s[k] = 0.999 * s[k] + 0.001 * gk ** 2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9 ** step))
                        / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return p


def score_texts(p: dict | None, texts: list) -> np.ndarray:
    out = np.full(len(texts), 0.5)
    if p is None:
        return out
    for lo, hi in W.batches(texts, 500_000):
        x, owner = features(texts[lo:hi])
        out[lo:hi] = _forward(p, x, owner, hi - lo)[-1]
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
                label: str = "quality", max_train: int = 3000, max_passages: int = 300_000) -> dict | None:
    """Fit on at most ``max_train`` documents that have a label (None: there is none).

    Of these, taken by a hash of the key, the first that together have at most
    ``max_passages`` passages are used, so long texts do not fill the driver; a document that
    has over a twentieth of them by itself is not drawn."""
    marked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(
        F.max(label).cast("double").alias("y"))
    picked = (docs.select(F.col(key).alias("k")).distinct().join(marked, "k")
              .orderBy(F.xxhash64(F.col("k").cast("string")), "k").limit(max_train))

    def bags(batches):
        for pdf in batches:
            for lo, hi in W.batches(pdf["t"].tolist(), 500_000):
                x, owner = features(pdf["t"].tolist()[lo:hi])
                cut = np.searchsorted(owner, np.arange(hi - lo + 1))
                yield pd.DataFrame({"k": pdf["k"].iloc[lo:hi], "y": pdf["y"].iloc[lo:hi],
                                    "x": [x[a:b].astype("<f2").tobytes() for a, b in zip(cut[:-1], cut[1:])]})

    # at most max_train ids are broadcast, and as many documents' features collected
    sample = (docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
              .join(F.broadcast(picked), "k"))
    # a passage has PASSAGE words, so at least 2 * PASSAGE characters with their spaces
    bound = F.floor(F.length("t") / F.lit(2 * PASSAGE)) + 1
    upto = Window.orderBy(F.xxhash64(F.col("k").cast("string")), "k")        # at most max_train keys
    fits = (sample.groupBy("k").agg(F.sum(bound).alias("p")).filter(F.col("p") <= max_passages // 20)
            .withColumn("upto", F.sum("p").over(upto)).filter(F.col("upto") <= max_passages).select("k"))
    sample = sample.join(F.broadcast(fits), "k")
    rows = sorted({(r["k"], r["y"], bytes(r["x"])) for r in
                   sample.mapInPandas(bags, "k long, y double, x binary").toLocalIterator()})
    if not rows:
        return None
    bag = [np.frombuffer(r[2], "<f2").reshape(-1, WIDTH) for r in rows]
    owner = np.repeat(np.arange(len(bag)), [len(b) for b in bag])
    return fit(np.concatenate(bag).astype(np.float32), owner, np.array([r[1] for r in rows], dtype=np.float32))


def score(docs: DataFrame, model: dict | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text."""
    @F.pandas_udf("double")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield pd.Series(score_texts(model, s.tolist()))

    return docs.withColumn(name, run(F.coalesce(F.col(text), F.lit(""))))
