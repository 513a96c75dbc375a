"""Periodic runs of word sequences by recompression.

A batch of sequences is parsed into a run-length grammar, level by level: a block level
replaces each maximal run of one symbol by a symbol for (symbol, count), a pair level
splits the symbols into two halves by a hash and replaces every adjacent (left, right) pair
by a symbol. Equal factors get equal symbols except near their ends, so the longest common
extension of two positions is found by climbing while the symbols agree and descending
where they differ: O(1) symbols a level. Levels are built only as high as some query climbs.

A run of period p and length at least L(p) = max(shortest, 2 p) holds a grid point i, a
multiple of L(p) - p, with i and i + p inside (harmonic sums: n log n points). Points where
the two words differ are no candidates; for the others the extensions to both sides give
the whole run. Of the candidates with one stretch the smallest period is the run's.

All steps are numpy over many texts at once; a text is never cut. Candidates are handled in
slices, so the work memory beside the words themselves is bounded.

Defined cases: a null or empty text, or one of white space, has no words and no run; rows
repeat as they are; a null key leaves the text as it is (``periodic_tail``); an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import worker_cache
from claimlens.llm.words import batches, mix

SHORTEST = 12
SLICE = 1 << 21             # grid points handled at once
CACHED = 1 << 15            # sequences up to this length share one cached grid
CHARS = 1 << 20             # characters of the texts of one grammar


class Level:
    """One level of the parse. ``sym`` has a sentinel at both ends, so the symbol after
    boundary k is sym[k + 1] and the one before it sym[k]. ``start`` gives the boundary
    here of each boundary of the next level, ``up`` the reverse (-1: none), ``block`` the
    next level's symbol of each symbol, where the next level is one of blocks."""

    def __init__(self, symbols: np.ndarray, names: int):
        self.sym = np.concatenate([[-1], symbols, [-2]])
        self.names = names              # symbols so far: all are smaller
        self.start = self.up = self.block = None


class Grammar:
    """The levels over one sequence, and the rules of their symbols:
    (first symbol, left, right) of pair levels, (first symbol, symbol, count) of block levels."""

    def __init__(self, symbols: np.ndarray, names: int):
        self.levels = [Level(symbols, names)]
        self.rules: list[tuple[str, int, np.ndarray, np.ndarray]] = []

    def above(self, i: int) -> Level:
        """Level ``i`` with its links to level ``i + 1``, which is built if need be."""
        level = self.levels[i]
        if level.start is None:
            sym = level.sym[1:-1]
            first = np.concatenate([[True], sym[1:] != sym[:-1]])
            nxt, names = self._blocks(level, sym, first) if not first.all() else self._pairs(level, sym)
            self.levels.append(Level(nxt, names))
        return level

    def _link(self, level: Level, begins: np.ndarray) -> None:
        level.start = np.append(np.flatnonzero(begins), len(begins))
        level.up = np.full(len(begins) + 1, -1, dtype=np.int64)
        level.up[level.start] = np.arange(len(level.start))

    def _blocks(self, level: Level, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, int]:
        self._link(level, first)
        level.block = np.cumsum(first) - 1
        heads, count = sym[level.start[:-1]].copy(), np.diff(level.start)
        many = np.flatnonzero(count > 1)
        width = int(count.max()) + 1
        key, inverse = np.unique(heads[many] * width + count[many], return_inverse=True)
        self.rules.append(("block", level.names, key // width, key % width))
        heads[many] = level.names + inverse
        return heads, level.names + len(key)

    def _pairs(self, level: Level, sym: np.ndarray) -> tuple[np.ndarray, int]:
        """Adjacent symbols all differ; some half of the symbols gives a pair."""
        seed = len(self.levels)
        while True:
            side = (mix(sym.astype(np.uint64) + np.uint64(seed << 40)) & np.uint64(1)).astype(bool)
            joins = [np.flatnonzero(~side[:-1] & side[1:]), np.flatnonzero(side[:-1] & ~side[1:])]
            at = max(joins, key=len)
            if len(at):
                break
            seed += 1 << 10
        begins = np.ones(len(sym), dtype=bool)
        begins[at + 1] = False
        self._link(level, begins)
        key, inverse = np.unique(sym[at] * level.names + sym[at + 1], return_inverse=True)
        self.rules.append(("pair", level.names, key // level.names, key % level.names))
        out = sym[level.start[:-1]].copy()
        out[level.up[at]] = level.names + inverse
        return out, level.names + len(key)

    def extend(self, x: np.ndarray, y: np.ndarray, back: bool = False) -> np.ndarray:
        """Longest common extension of the boundaries ``x`` and ``y`` (x <> y), forward or
        backward, for all queries at once."""
        kx, ky = x.astype(np.int64), y.astype(np.int64)
        off, sign = (0, -1) if back else (1, 1)
        stopped: list[np.ndarray] = []

        def advance(level: Level, q: np.ndarray) -> None:
            if level.block is None:
                step = 1
            else:                       # the rest of both runs of this symbol
                a, b = kx[q], ky[q]
                if back:
                    step = np.minimum(a - level.start[level.block[a - 1]], b - level.start[level.block[b - 1]])
                else:
                    step = np.minimum(level.start[level.block[a] + 1] - a, level.start[level.block[b] + 1] - b)
            kx[q] += sign * step
            ky[q] += sign * step

        active, i = np.arange(len(kx)), 0
        while len(active):
            ends, climbs = [], []
            while len(active):
                sym = self.levels[i].sym
                same = sym[kx[active] + off] == sym[ky[active] + off]
                ends.append(active[~same])
                active = active[same]
                if len(active):
                    level = self.above(i)
                    u, v = level.up[kx[active]], level.up[ky[active]]
                    ok = (u >= 0) & (v >= 0)
                    kx[active[ok]], ky[active[ok]] = u[ok], v[ok]
                    climbs.append(active[ok])
                    active = active[~ok]
                    advance(level, active)
            stopped.append(np.concatenate(ends))
            active = np.concatenate(climbs) if climbs else active
            i += 1
        down = np.zeros(0, dtype=np.int64)
        for i in range(len(stopped) - 2, -1, -1):
            level = self.levels[i]
            down = np.concatenate([down, stopped[i + 1]])
            kx[down], ky[down] = level.start[kx[down]], level.start[ky[down]]
            todo = down
            while len(todo):
                todo = todo[level.sym[kx[todo] + off] == level.sym[ky[todo] + off]]
                advance(level, todo)
        return np.abs(kx - x)


def _points(n: int, p0: int, p1: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points (i, i + p) of the periods p0 <= p < p1 in a sequence of length n."""
    p = np.arange(p0, p1, dtype=np.int64)
    step = np.maximum(shortest, 2 * p) - p
    count = np.maximum(0, -(-(n - p) // step))
    ends = np.cumsum(count)
    k = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)
    a = k * np.repeat(step, count)
    return a, a + np.repeat(p, count)


def _grid(n: int, shortest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All grid points of a sequence of length n, in slices. Shorter sequences share one
    grid, ordered by the second point: theirs are a prefix of it."""
    if n > CACHED:
        p = 1
        while p <= n // 2:
            per = max(1, n // max(p, shortest - p))
            to = min(n // 2 + 1, p + max(1, SLICE // per))
            yield _points(n, p, to, shortest)
            p = to
        return
    size = max(256, 1 << (n - 1).bit_length())
    cache = worker_cache()
    key = ("grid", size, shortest)
    if key not in cache:
        a, b = _points(size, 1, size // 2 + 1, shortest)
        order = np.argsort(b, kind="stable")
        b = b[order]
        cache[key] = a[order], b, np.searchsorted(b, np.arange(size + 1))
    a, b, upto = cache[key]
    m = upto[n]
    yield a[:m], b[:m]


def find_runs(sequences: list[np.ndarray], names: int, shortest: int = SHORTEST) -> list[np.ndarray]:
    """The runs of each sequence of symbols (smaller than ``names``): rows (start, length,
    period) ordered by start, then period.

    A run is a stretch of smallest period q and length max(shortest, 2 q) or more that no
    neighbour extends with that period."""
    # one sequence, with a symbol of its own after each part, which no extension passes
    whole = np.concatenate([np.append(s, names + i) for i, s in enumerate(sequences)] or [np.zeros(0, np.int64)])
    at = np.concatenate([[0], np.cumsum([len(s) + 1 for s in sequences])]).astype(np.int64)
    grammar = Grammar(whole, names + len(sequences))
    found, held, size = [], [], 0

    def handle():
        x, y = (np.concatenate(c) for c in zip(*held))
        fwd, bwd = grammar.extend(x, y), grammar.extend(x, y, back=True)
        p = y - x
        length = p + fwd + bwd
        ok = length >= np.maximum(shortest, 2 * p)
        found.append(np.stack([(x - bwd)[ok], length[ok], p[ok]], axis=1))
        held.clear()

    for s, lo in zip(sequences, at.tolist()):
        if len(s) < shortest:
            continue
        for a, b in _grid(len(s), shortest):
            hit = np.flatnonzero(s[a] == s[b])
            if len(hit):
                held.append((a[hit] + lo, b[hit] + lo))
                size += len(hit)
                if size >= SLICE:
                    handle()
                    size = 0
    if held:
        handle()
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]      # by stretch, smallest period first
    if len(runs):
        runs = runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)])]
        runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    parts = np.split(runs, np.searchsorted(runs[:, 0], at[1:-1])) if sequences else []
    return [r - [lo, 0, 0] for r, lo in zip(parts, at.tolist())]


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


class _Ids(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _texts(texts: list, tails: list, shortest: int) -> Iterator[tuple[int, np.ndarray, str]]:
    """(words, runs, kept words) of each text; ``tails``: (a, p) or None, see ``periodic_tail``."""
    for lo, hi in batches(texts, CHARS):
        ids, words, rows = _Ids(), [], []
        for t, tail in zip(texts[lo:hi], tails[lo:hi]):
            own = (t or "").encode("utf-8", "surrogatepass").split()   # bytes: ASCII white space only
            n = len(own)
            row = np.fromiter(map(ids.__getitem__, own), dtype=np.int64, count=n)
            if tail is not None and n:
                a, p = tail(n)
                order = np.concatenate([np.arange(a), a + np.arange(n - a) % p])
                row, own = row[order], [own[j] for j in order.tolist()]
            words.append(own)
            rows.append(row)
        for own, runs in zip(words, find_runs(rows, len(ids), shortest)):
            n = len(own)
            if len(runs):
                own = [own[j] for j in np.flatnonzero(~dropped(runs, n)).tolist()]
            yield n, runs, b" ".join(own).decode("utf-8", "surrogatepass")


def _tail_of(h: int):
    g = h // 10

    def tail(n: int) -> tuple[int, int]:
        a = g % n
        return a, 1 + (n - a) // (3 + g % 8)

    return tail if h >= 0 and h % 10 == 0 else None


_RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def run_detection(docs: DataFrame, text: str, keep: list[str], periodic_tail: Column | None = None,
                  shortest: int = SHORTEST) -> DataFrame:
    """``keep`` columns of ``docs`` with n_words, runs (start, length, period by start, then
    period) and collapsed: the words that no run holds after its first period, joined by a
    space.

    ``periodic_tail``: a non-negative hash h. Where h % 10 = 0 the words from a on are first
    replaced by repetitions of the p words there, a = g % n, p = 1 + (n - a) div (3 + g % 8),
    g = h div 10."""
    @F.pandas_udf(_RESULT)
    def run(texts: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        out = list(_texts(texts.tolist(), [_tail_of(h) for h in hashes.tolist()], shortest))
        names = ("start", "length", "period")
        return pd.DataFrame({"n_words": [o[0] for o in out], "runs": [[dict(zip(names, r)) for r in o[1].tolist()] for o in out],
                             "collapsed": [o[2] for o in out]})

    h = F.lit(-1).cast("long") if periodic_tail is None else F.coalesce(periodic_tail.cast("long"), F.lit(-1).cast("long"))
    return docs.select(*keep, run(F.coalesce(F.col(text), F.lit("")), h).alias("__r")).select(*keep, "__r.*")
