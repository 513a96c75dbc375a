"""Hard-negative mining with an inverted multi-index.

The dimensions are halved; each half has a codebook (k-means of a bounded sample). Every
row lies in the cell of its two codes, and a code has the radius of its farthest row. For an
anchor q, <q1, c1> + |q1| r1 + <q2, c2> + |q2| r2 bounds the score of every row of the cell
(c1, c2). The half bounds are sorted, and a heap visits the cells by their sum, highest
first (multi-sequence order), until the bound falls below what any window of the anchor can
still take: the kth score found in it, or its lower end. Every later cell is certified out.

Two passes, first the positives (same label, one open window), then the negatives (other
labels, one window per positive). Each has two visits: a seed, the first cells holding
``SEED`` rows, gives kth scores; the full visit then ships only cells at or above them, and
stops within a task as soon as the best scores there certify the rest. Anchors near each
other form groups; a cell is packed into blocks of at most ``BLOCK`` rows, so no task
holds more than one group and a few blocks, however many rows share a cell.

Rows of equal vector and label are one class: they tie, and ties go by id, so only the
first k + 1 ids of a class (one may be the anchor) can be in an answer, and the index lists
those. The codebooks are fitted on at most ``SAMPLE`` rows; the index, radii and counts
cover all. The driver holds the codebooks and one line per cell (at most ``CODES``^2).

Defined cases: rows with a null id, label or vector or a null or non-finite component take
no part; of several rows of one id the one of smallest (vector, label) counts; a shorter
vector is padded with zeros. An anchor without another row of its label has no positives and
gives no rows; a negative positive score has an empty window. Scores beyond a long are held
at its ends. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens.llm.common import cut_lineage, partitions
from claimlens.llm.covertree import _scores

SAMPLE, CODES = 16384, 256
BLOCK, GROUP, SEED = 512, 256, 400
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1

_ANCHOR = "id long, label long, v array<double>, lo array<long>, hi array<long>, tau array<long>"


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids of the distinct rows of ``x`` (at most ``k``; the origin, if there are none)."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        own = nearest(x, c)[0]
        n = np.bincount(own, minlength=len(c))
        for i in np.flatnonzero(n):
            c[i] = x[own == i].mean(axis=0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, distance) of each row."""
    own = ((c ** 2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
    return own, np.sqrt(((x - c[own]) ** 2).sum(axis=1))


class Cells:
    """Codebooks, radii and the filled cells: everything a visit is planned from."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], cells: list[tuple]):
        self.books, self.half = books, books[0].shape[1]
        self.n = np.zeros((len(books[0]), len(books[1])), dtype=np.int64)
        self.r = np.zeros((2, *self.n.shape))
        for c1, c2, n, r1, r2 in cells:
            self.n[c1, c2], self.r[0, c1, c2], self.r[1, c1, c2] = n, r1, r2
        self.radius = (self.r[0].max(axis=1), self.r[1].max(axis=0))

    def visit(self, q: np.ndarray) -> Iterator[tuple[float, float, float, int, int]]:
        """(bound by code radii, own bound, own lower bound, c1, c2) of each filled cell,
        highest bound by code radii first."""
        parts = (q[:self.half], q[self.half:])
        norm = [float(np.linalg.norm(p)) for p in parts]
        mid = [b @ p for b, p in zip(self.books, parts)]
        up = [m + g * r for m, g, r in zip(mid, norm, self.radius)]
        o1, o2 = (np.argsort(-u, kind="stable") for u in up)
        u1, u2 = up[0][o1].tolist(), up[1][o2].tolist()
        o1, o2 = o1.tolist(), o2.tolist()
        slack = 1e-6 * (1 + sum(abs(m).max() + g * r.max() for m, g, r in zip(mid, norm, self.radius)))
        heap = [(-(u1[0] + u2[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < len(u2):
                heapq.heappush(heap, (-(u1[i] + u2[j + 1]), i, j + 1))
            if not j and i + 1 < len(u1):
                heapq.heappush(heap, (-(u1[i + 1] + u2[0]), i + 1, 0))
            c1, c2 = o1[i], o2[j]
            if self.n[c1, c2]:
                centre = float(mid[0][c1] + mid[1][c2])
                reach = norm[0] * self.r[0, c1, c2] + norm[1] * self.r[1, c1, c2] + slack
                yield slack - bound, centre + reach, centre - reach, c1, c2

    def plan(self, anchors: list, seed: bool) -> dict[tuple[int, int], float]:
        """The cells a group has to visit, with the highest bound any of its anchors has."""
        out: dict[tuple[int, int], float] = {}
        width = sum(b.shape[1] for b in self.books)
        for a in anchors:
            q = np.zeros(width)
            q[:len(a["v"])] = a["v"]
            need = min((max(lo, tau) for lo, hi, tau in zip(a["lo"], a["hi"], a["tau"]) if lo <= hi), default=None)
            if need is None:
                continue
            top, rows = max(a["hi"]), 0
            for bound, own, low, c1, c2 in self.visit(q):
                if bound < need or seed and rows >= SEED:
                    break
                if own >= need and low <= top:
                    rows += int(self.n[c1, c2])
                    out[c1, c2] = max(own, out.get((c1, c2), -math.inf))
        return out


class Finder:
    """The first k rows (highest score, then smallest id) of each window of each anchor."""

    def __init__(self, anchors: list, k: int, same: bool, width: int):
        self.k, self.same = k, same
        self.ids = np.array([a["id"] for a in anchors], dtype=np.int64)
        self.labels = np.array([a["label"] for a in anchors], dtype=np.int64)
        self.v = _matrix([a["v"] for a in anchors], width)
        n = max(len(a["lo"]) for a in anchors)
        grid = [[a[f][j] if j < len(a[f]) else {"lo": 1, "hi": 0, "tau": LOWEST}[f] for j in range(n)]
                for f in ("lo", "hi", "tau") for a in anchors]
        self.lo, self.hi, tau = np.array(grid, dtype=np.int64).reshape(3, len(anchors), n)
        self.worst = np.maximum(self.lo, tau)
        self.best: dict[tuple[int, int], list] = {}
        self._certify()

    def _certify(self) -> None:
        open_ = self.lo <= self.hi
        self.need = int(np.where(open_, self.worst, HIGHEST).min()) if open_.any() else HIGHEST

    def offer(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        s = _scores(self.v, v).astype(np.int64)
        ok = ((self.labels[:, None] == labels) == self.same) & (self.ids[:, None] != ids)
        for j in range(self.lo.shape[1]):
            hits = ok & (s >= self.worst[:, j:j + 1]) & (s <= self.hi[:, j:j + 1])
            for a in np.flatnonzero(hits.any(axis=1)).tolist():
                at = np.flatnonzero(hits[a])
                at = at[np.lexsort((ids[at], -s[a, at]))[:self.k]]
                mine = self.best.get((a, j), []) + list(zip((-s[a, at]).tolist(), ids[at].tolist()))
                mine.sort()
                self.best[a, j] = mine = mine[:self.k]
                if len(mine) == self.k:
                    self.worst[a, j] = max(self.worst[a, j], -mine[-1][0])
        self._certify()

    def rows(self) -> list[tuple]:
        return [(int(self.ids[a]), j, i, -s) for (a, j), mine in self.best.items() for s, i in mine]


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _books(rows: DataFrame, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two codebooks, their size growing with the fourth root of the rows."""
    take = max(CODES, min(SAMPLE, (1 << 22) // max(1, width)))
    sample = _matrix([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(take).select("v").collect()], width)
    k, half = max(2, min(CODES, round(2 * n ** 0.25))), (width + 1) // 2
    return kmeans(sample[:, :half], k), kmeans(sample[:, half:], k)


def _coded(rows: DataFrame, books: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows with the code of each half and the distance to it."""
    width, half = sum(b.shape[1] for b in books), books[0].shape[1]

    @F.pandas_udf("c1 int, c2 int, d1 double, d2 double")
    def code(vectors: pd.Series) -> pd.DataFrame:
        x = _matrix(vectors.tolist(), width)
        (c1, d1), (c2, d2) = nearest(x[:, :half], books[0]), nearest(x[:, half:], books[1])
        return pd.DataFrame({"c1": c1, "c2": c2, "d1": d1, "d2": d2})

    return rows.withColumn("__c", code("v")).select(*rows.columns, "__c.*")


def _blocks(coded: DataFrame, width: int) -> DataFrame:
    """Cells as blocks of at most ``BLOCK`` rows: (block, c1, c2, n, r1, r2, ids, labels, vecs)."""
    def pack(batches):
        held: list = []

        def out(rows):
            d = list(zip(*rows))
            return (d[0][0], d[1][0], len(rows), max(d[2]), max(d[3]), np.array(d[4], "<i8").tobytes(),
                    np.array(d[5], "<i8").tobytes(), _matrix(d[6], width).astype("<f8").tobytes())

        names = ["c1", "c2", "n", "r1", "r2", "ids", "labels", "vecs"]
        for pdf in batches:
            done = []
            for row in pdf[["c1", "c2", "d1", "d2", "id", "label", "v"]].itertuples(index=False, name=None):
                if held and (held[0][:2] != row[:2] or len(held) == BLOCK):
                    done.append(out(held))
                    held = []
                held.append(row)
            if done:
                yield pd.DataFrame(done, columns=names)
        if held:
            yield pd.DataFrame([out(held)], columns=names)

    spark = coded.sparkSession
    packed = (coded.repartitionByRange(partitions(spark), "c1", "c2", F.xxhash64("id")).sortWithinPartitions("c1", "c2")
              .mapInPandas(pack, "c1 int, c2 int, n long, r1 double, r2 double, ids binary, labels binary, vecs binary"))
    return cut_lineage(packed.withColumn("block", F.monotonically_increasing_id()))


class MultiIndex:
    """The index over (id, label, v) rows, and visits of anchors to it."""

    def __init__(self, rows: DataFrame, ties: int):
        """``ties``: how many ids of one class an answer can hold at most."""
        self.spark = rows.sparkSession
        size = rows.agg(F.max(F.size("v")).alias("w"), F.count("*").alias("n")).first()
        self.width, self.rows = max(2, size["w"] or 0), size["n"]
        self.books = _books(rows, self.width, size["n"])
        same = Window.partitionBy("v", "label").orderBy("id")
        listed = rows.withColumn("__n", F.row_number().over(same)).filter(F.col("__n") <= ties).drop("__n")
        self.blocks = _blocks(_coded(listed.select("id", "label", "v"), self.books), self.width)
        self.lines = self.blocks.select("block", "c1", "c2", "n", "r1", "r2")
        cells = self.lines.groupBy("c1", "c2").agg(F.sum("n"), F.max("r1"), F.max("r2")).collect()   # at most CODES^2
        self.cells = Cells(self.books, [tuple(c) for c in cells])

    def group(self, anchors: DataFrame) -> DataFrame:
        """Anchors with ``grp``: at most ``GROUP`` of them, near each other."""
        coded = _coded(anchors, self.books)
        ranged = (coded.repartitionByRange(partitions(self.spark), "c1", "c2", F.xxhash64("id"))
                  .sortWithinPartitions("c1", "c2", "id").withColumn("__at", F.monotonically_increasing_id()))
        at, part = F.col("__at").bitwiseAND((1 << 33) - 1), F.shiftrightunsigned("__at", 33)
        return cut_lineage(ranged.select(*anchors.columns, (F.shiftleft(part, 33) + F.floor(at / GROUP)).alias("grp")))

    def pairs(self, anchors: DataFrame, seed: bool) -> DataFrame:
        """(grp, block, bound) of the blocks each group has to see."""
        cells, names = self.cells, ["grp", "c1", "c2", "bound"]

        def plan(batches):
            for pdf in batches:
                for grp, members in zip(pdf["grp"].tolist(), pdf["members"]):
                    found = cells.plan(list(members), seed)
                    yield pd.DataFrame([(grp, *c, b) for c, b in found.items()], columns=names)

        planned = self._headers(anchors).mapInPandas(plan, "grp long, c1 int, c2 int, bound double")
        return planned.join(self.lines.select("block", "c1", "c2"), ["c1", "c2"]).select("grp", "block", "bound")

    def _headers(self, anchors: DataFrame) -> DataFrame:
        return anchors.groupBy("grp").agg(F.collect_list(F.struct("id", "label", "v", "lo", "hi", "tau")).alias("members"))

    def visit(self, anchors: DataFrame, k: int, same: bool, seed: bool) -> DataFrame:
        """(anchor, window, id, score, rank): the first ``k`` rows of each window among the
        cells visited, which for a full visit are the first of all rows."""
        groups = max(1, anchors.select("grp").distinct().count())
        lanes = max(1, math.ceil(partitions(self.spark) / groups))
        width = self.width
        none = F.lit(None)
        shipped = (self.pairs(anchors, seed).join(self.blocks, "block").select(
            "grp", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int").alias("lane"), F.col("bound").alias("bound"),
            none.cast(f"array<struct<{_ANCHOR.replace(' ', ':').replace(',:', ',')}>>").alias("members"), "ids", "labels", "vecs"))
        heads = self._headers(anchors).select(
            "grp", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(math.inf).alias("bound"), "members",
            *[none.cast("binary").alias(c) for c in ("ids", "labels", "vecs")])

        def run(batches):
            finder, names = None, ["anchor", "window", "id", "score"]
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    if r.ids is None:                     # the group's header comes before its blocks
                        if finder is not None:
                            yield pd.DataFrame(finder.rows(), columns=names)
                        finder = Finder(list(r.members), k, same, width)
                    elif r.bound >= finder.need:
                        finder.offer(np.frombuffer(r.ids, "<i8"), np.frombuffer(r.labels, "<i8"),
                                     np.frombuffer(r.vecs, "<f8").reshape(-1, width))
            if finder is not None:
                yield pd.DataFrame(finder.rows(), columns=names)

        found = (heads.unionByName(shipped).repartition(groups * lanes, "grp", "lane")
                 .sortWithinPartitions("grp", "lane", F.desc("bound"), F.col("ids").isNotNull())
                 .mapInPandas(run, "anchor long, window int, id long, score long"))
        order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
        return cut_lineage(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """The full visit, after a seed visit that gives each window's kth score so far."""
        start = anchors.withColumn("tau", F.transform("lo", lambda _: F.lit(LOWEST)))
        seen = self.visit(start, k, same, seed=True).filter(F.col("rank") == k)
        taus = seen.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("t"))
        known = cut_lineage(anchors.join(taus.withColumnRenamed("anchor", "id"), "id", "left").withColumn(
            "tau", F.transform("lo", lambda _, i: F.coalesce(F.try_element_at("t", i), F.lit(LOWEST)))).drop("t"))
        return self.visit(known, k, same, seed=False)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, vec_id: str = "vec_id", vector: str = "embedding",
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """For every anchor and each of its first ``positives`` rows of the same label, the first
    ``negatives`` rows of other labels whose score is ``low`` to ``high`` per cent of the
    positive's. Scores are inner products of floor(scale * x)."""
    v = F.col(vector).cast("array<double>")
    whole = (F.col(vector).isNotNull() & F.col(vec_id).isNotNull() & label.isNotNull()
             & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = vectors.filter(F.coalesce(whole, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"),
        F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("q"))
    rows = cut_lineage(rows.groupBy("id").agg(F.min(F.struct("v", "label")).alias("r"), F.max("q").alias("q"))
                       .select("id", "r.v", "r.label", "q"))
    index = MultiIndex(rows, max(positives, negatives) + 1)
    anchors = index.group(rows.filter("q").drop("q"))
    any_ = anchors.select("*", F.array(F.lit(LOWEST)).alias("lo"), F.array(F.lit(HIGHEST)).alias("hi"))
    best = index.search(any_, positives, same=True)

    # each window: low * p <= 100 * s <= high * p, empty where p < 0
    p = "cast(score as decimal(20, 0))"
    lo = F.expr(f"if(score < 0, 1L, ({p} * {low} + 99) div 100)")
    hi = F.expr(f"if(score < 0, 0L, ({p} * {high}) div 100)")
    windows = (best.select("anchor", F.struct("rank", lo.alias("lo"), hi.alias("hi")).alias("w"))
               .groupBy("anchor").agg(F.array_sort(F.collect_list("w")).alias("w")))
    spans = anchors.join(windows.withColumnRenamed("anchor", "id"), "id").select(
        *anchors.columns, F.transform("w", lambda w: w["lo"]).alias("lo"), F.transform("w", lambda w: w["hi"]).alias("hi"))
    found = index.search(cut_lineage(spans), negatives, same=False)
    own = best.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"),
                      F.col("score").alias("positive_score"))
    return found.join(own, ["anchor", "window"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
