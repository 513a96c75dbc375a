"""Language identification with hyperdimensional profiles.

Every letter (and the word gap) owns a random vector of +-1. A trigram abc is bound
as roll(A, 2) * roll(B, 1) * C, a text is the bundle (sum) of its trigrams, and a
language prototype is the bundle of its training texts' unit vectors. A text gets the
language of the largest cosine with the prototypes.

Defined cases: null text, or no letter in it: ``und`` with score 0. No training row:
every text is ``und``. Ties between prototypes: the smaller language name. Columns of
the input beside text, language and key play no part and are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.llm.common import worker_cache

DIMS = 1024
UNIT = 1 << 20          # unit vectors are bundled as integers, so sums do not depend on order


def _letters() -> np.ndarray:
    """Code point -> is it a letter."""
    state = worker_cache()
    if "letters" not in state:
        t = np.zeros(0x110000, dtype=bool)
        t[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        state["letters"] = t
    return state["letters"]


def _symbol(cp: int, dims: int) -> np.ndarray:
    return np.random.default_rng([7, int(cp)]).integers(0, 2, dims, dtype=np.int8) * 2 - 1


def _trigram_vectors(a, b, c, dims: int) -> np.ndarray:
    """Bound vectors of trigrams given as code point arrays, float32 rows."""
    known = worker_cache().setdefault(("symbols", dims), {})
    if len(known) > 4096:
        known.clear()
    cps, inv = np.unique(np.concatenate([a, b, c]), return_inverse=True)
    for cp in cps:
        if cp not in known:
            known[cp] = _symbol(cp, dims)
    base = np.stack([known[cp] for cp in cps])
    n = len(a)
    two, one = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    out = two[inv[:n]]
    out *= one[inv[n:2 * n]]
    out *= base[inv[2 * n:]]
    return out.astype(np.float32)


def bundle(texts: list[str | None], dims: int = DIMS, block: int = 8192) -> np.ndarray:
    """Unit bundle vectors of texts, one float32 row each (zero row: no letter).

    All texts of the call are cut into trigrams together; the count matrix
    (texts x distinct trigrams) meets the trigram vectors in column blocks, so
    memory holds len(texts) * block counts at most whatever the alphabet."""
    joined = " ".join(f" {t.lower()} " if t else " " for t in texts)
    out = np.zeros((len(texts), dims), dtype=np.float32)
    cps = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    lens = [len(t.lower()) + 2 if t else 1 for t in texts]
    owner = np.repeat(np.arange(len(texts)), np.array(lens) + 1)[:len(cps)]
    is_letter = _letters()[cps]
    cps = np.where(is_letter, cps, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]          # one gap after each run of letters
    keep[0] = True
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    keep |= first
    cps, owner = cps[keep], owner[keep]
    if len(cps) < 3:
        return out
    alphabet = np.flatnonzero(np.bincount(cps, minlength=1))
    k = len(alphabet)
    place = np.zeros(int(alphabet[-1]) + 1, dtype=np.int64)
    place[alphabet] = np.arange(k)
    small = place[cps]
    # a trigram lies in one text and is not (letter, gap, letter)
    good = (owner[:-2] == owner[2:]) & (cps[1:-1] != 32)
    code = ((small[:-2] * k + small[1:-1]) * k + small[2:])[good]
    owner = owner[:-2][good]
    if not len(code):
        return out
    if k ** 3 <= 4_000_000:
        present = np.flatnonzero(np.bincount(code, minlength=k ** 3))
        back = np.zeros(k ** 3, dtype=np.int64)
        back[present] = np.arange(len(present))
        col = back[code]
    else:
        present, col = np.unique(code, return_inverse=True)
    for lo in range(0, len(present), block):
        part = present[lo:lo + block]
        if len(present) <= block:
            cell = owner * len(part) + col
        else:
            inside = (col >= lo) & (col < lo + block)
            cell = owner[inside] * len(part) + col[inside] - lo
        counts = np.bincount(cell, minlength=len(texts) * len(part)).reshape(len(texts), len(part))
        vec = _trigram_vectors(alphabet[part // (k * k)], alphabet[part // k % k], alphabet[part % k], dims)
        out += counts.astype(np.float32) @ vec
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def _groups(texts: list, chars: int = 400_000):
    """Consecutive index ranges of at most ``chars`` characters and 256 texts."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > lo and (size + n > chars or i - lo >= 256):
            yield lo, i
            lo, size = i, 0
        size += n
    if texts:
        yield lo, len(texts)


def fit_prototypes(train: DataFrame, text: str, lang: str, dims: int = DIMS) -> dict[str, np.ndarray]:
    """One unit prototype per language over all training rows.

    Each task bundles its own rows to one integer vector per language; the vectors
    are summed by (language, dimension), pre-aggregated in the tasks. The driver gets
    languages x dims numbers."""

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            texts, langs = pdf["t"].tolist(), pdf["l"].to_numpy(dtype=object)
            for lo, hi in _groups(texts):
                vec = np.rint(bundle(texts[lo:hi], dims) * UNIT).astype(np.int64)
                for name in set(langs[lo:hi]):
                    total[name] = total.get(name, 0) + vec[langs[lo:hi] == name].sum(axis=0)
        if total:
            yield pd.DataFrame({"l": list(total), "v": [v.tolist() for v in total.values()]})

    schema = T.StructType([T.StructField("l", T.StringType()), T.StructField("v", T.ArrayType(T.LongType()))])
    rows = (train.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
            .select(F.col(text).alias("t"), F.col(lang).alias("l")).mapInPandas(sums, schema))
    summed = (rows.select("l", F.posexplode("v").alias("i", "x")).groupBy("l", "i").agg(F.sum("x").alias("x"))
              .groupBy("l").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")))
    protos = {}
    for r in summed.collect():                      # one row per language
        v = np.array([float(x["x"]) for x in r["v"]])
        n = np.linalg.norm(v)
        if n > 0:
            protos[r["l"]] = v / n
    return dict(sorted(protos.items()))


def identify(docs: DataFrame, protos: dict[str, np.ndarray], text: str,
             pred: str = "lang_pred", score: str = "score", dims: int = DIMS) -> DataFrame:
    """``docs`` with the predicted language and its cosine clipped to 0..1."""
    names = list(protos)
    matrix = np.stack([protos[n] for n in names], axis=1).astype(np.float32) if names else None

    def predict(series):
        for s in series:
            texts = [None if t is None or t != t else t for t in s.tolist()]
            langs, scores = [], []
            for lo, hi in _groups(texts):
                vec = bundle(texts[lo:hi], dims)
                some = np.any(vec != 0, axis=1)
                sims = vec @ matrix if names else np.zeros((hi - lo, 1))
                best = sims.argmax(axis=1)
                for ok, b, row in zip(some, best, sims):
                    ok = ok and bool(names)
                    langs.append(names[b] if ok else "und")
                    scores.append(float(min(1.0, max(0.0, row[b]))) if ok else 0.0)
            yield pd.DataFrame({"p": langs, "s": scores})

    @F.pandas_udf("struct<p:string,s:double>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from predict(series)

    tmp = "__hd"
    return (docs.withColumn(tmp, run(F.col(text)))
            .withColumns({pred: F.col(f"{tmp}.p"), score: F.col(f"{tmp}.s")}).drop(tmp))


def language_id(docs: DataFrame, train_on: Column, text: str = "text", lang: str = "lang",
                dims: int = DIMS) -> DataFrame:
    """Fit on the rows where ``train_on`` holds, predict every row."""
    protos = fit_prototypes(docs.filter(F.coalesce(train_on, F.lit(False))), text, lang, dims)
    return identify(docs, protos, text, dims=dims)


__all__ = ["bundle", "fit_prototypes", "identify", "language_id"]
