"""Exact top-k inner-product search with dual cover trees.

Vectors are packed into blocks of nearby rows and queries into groups; each block and
each group carries a cover tree. A pair of tree nodes (Q, D) is skipped when
<q0, d0> + |q0| rD + |d0| rQ + rQ rD, an upper bound for every pair below it (r:
covering radius, 0: centre), is under the worst kth score that any query of Q has so
far; otherwise the larger node is opened, and two leaves are scored as one matrix
product. A task holds one query group and meets blocks, highest bound first.

Before blocks are shipped, groups and blocks are compared by their centres and radii alone:
a seed visit to the ``SEEDS`` blocks of highest centre score gives each group's worst kth
score, and only pairs whose bound reaches it are shuffled. A block's tree is built once and
travels with it. Only the k best per query and task are shuffled.

Every query meets every block that its bound does not exclude: the answer is exact.
Blocks and groups have bounded sizes, also under repeated vectors (a frequent vector
fills several blocks).

Defined cases: vectors null, or with a null or non-finite component, take no part. A
shorter vector counts as padded with zeros. A query is never its own candidate (rows of
the same id are one vector and count once, as query and as candidate). Scores tie towards the smaller id. Scores beyond the
range of a long are held at its ends. Empty input gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens.llm.common import cut_lineage, partitions

BLOCK, GROUP, LEAF = 2048, 1024, 64
SEEDS, CENTRES = 2, 1024              # blocks of a seed visit; centres that travel together


class CoverTree:
    """Nested nets over the rows of a matrix, coarsest first.

    A node covers its rows within a radius; children are a net of the parent's rows
    whose spacing halves the parent's scale. Rows that would make children of one row
    stay in the parent's own leaf, so a node is either a leaf (``rows``) or has
    ``children``. Node rows are consecutive in ``order``."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, nodes: list | None = None):
        self.x, self.leaf = x, leaf
        self.nodes: list = nodes or []        # (centre, radius, row indices, children)
        self.root = len(nodes) - 1 if nodes else self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray) -> int:
        pts = self.x[rows]
        dist = np.sqrt(((pts - pts[0]) ** 2).sum(axis=1))
        radius = float(dist.max())
        children: list[int] = []
        if len(rows) > self.leaf and radius > 0:
            scale = 2.0 ** (math.ceil(math.log2(radius)) - 1)
            nearest, owner, centre = dist, np.zeros(len(rows), dtype=np.int64), 0
            limit = max(2, len(rows) // self.leaf * 2)
            while nearest.max() > scale and centre + 1 < limit:
                centre += 1
                far = int(nearest.argmax())
                d = np.sqrt(((pts - pts[far]) ** 2).sum(axis=1))
                closer = d < nearest
                owner[closer], nearest = centre, np.where(closer, d, nearest)
            parts = [rows[owner == c] for c in range(centre + 1)]
            if len(parts) > 1 and max(map(len, parts)) < len(rows):
                single = [p for p in parts if len(p) < self.leaf // 8]
                children = [self._build(p) for p in parts if len(p) >= self.leaf // 8]
                if single:
                    children.append(self._leaf(np.concatenate(single)))
            elif not children:
                half = len(rows) // 2          # net too fine for its limit: split evenly
                near = np.argsort(nearest, kind="stable")
                children = [self._build(rows[near[:half]]), self._build(rows[near[half:]])]
        self.nodes.append((pts[0], radius, rows, children))
        return len(self.nodes) - 1

    def _leaf(self, rows: np.ndarray) -> int:
        pts = self.x[rows]
        centre = pts.mean(axis=0)
        radius = float(np.sqrt(((pts - centre) ** 2).sum(axis=1)).max())
        if len(rows) > 4 * self.leaf:
            half = len(rows) // 2
            children = [self._leaf(rows[:half]), self._leaf(rows[half:])]
        else:
            children = []
        self.nodes.append((centre, radius, rows, children))
        return len(self.nodes) - 1


def _scores(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Integer inner products of integer-valued rows, exact."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * q.shape[1]
    if top < 2 ** 52:
        return q @ d.T
    big = np.vectorize(int, otypes=[object])
    out = big(q) @ big(d).T
    return np.clip(out.astype(object), -(1 << 63), (1 << 63) - 1)


class Best:
    """The k best (score, smaller id first) of each query of a group."""

    def __init__(self, ids: np.ndarray, k: int):
        self.q, self.k = ids, k
        self.score = [[] for _ in ids]       # ascending list of (score, -id)
        self.worst = np.full(len(ids), -np.inf)

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        import heapq
        for r, line in zip(rows.tolist(), scores):
            hit = np.flatnonzero(line >= self.worst[r]) if len(self.score[r]) == self.k else np.arange(len(line))
            if len(hit) > 4 * self.k:        # only the k best of this leaf, ties by id
                best = np.lexsort((ids[hit], -line[hit].astype(np.float64)))[:self.k + 1] \
                    if line.dtype != object else range(len(hit))
                hit = hit[best]
            own = int(self.q[r])
            for c in hit.tolist():
                if int(ids[c]) == own:
                    continue
                item = (int(line[c]), -int(ids[c]))
                heap = self.score[r]
                if len(heap) < self.k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
            if len(self.score[r]) == self.k:
                self.worst[r] = self.score[r][0][0]


def search(qt: CoverTree, dt: CoverTree, ids: np.ndarray, best: Best) -> int:
    """Dual traversal of a query tree and a data tree; returns the leaf pairs scored."""
    opened = 0

    def bound(q, d):
        return float(q[0] @ d[0]) + np.linalg.norm(q[0]) * d[1] + np.linalg.norm(d[0]) * q[1] + q[1] * d[1]

    stack = [(qt.root, dt.root)]
    while stack:
        qi, di = stack.pop()
        q, d = qt.nodes[qi], dt.nodes[di]
        top = bound(q, d)
        if top + 1e-6 * (1 + abs(top)) < best.worst[q[2]].min():
            continue
        if d[3] and (not q[3] or d[1] >= q[1]):
            near = sorted(d[3], key=lambda c: float(q[0] @ dt.nodes[c][0]))
            stack.extend((qi, c) for c in near)           # best centre is popped first
        elif q[3]:
            stack.extend((c, di) for c in q[3])
        else:
            opened += 1
            best.offer(q[2], ids[d[2]], _scores(qt.x[q[2]], dt.x[d[2]]))
    return opened


def bound_of(q: np.ndarray, q_radius, d: np.ndarray, d_radius) -> np.ndarray:
    """Upper bounds of the inner products between balls: centres in rows, radii beside."""
    qn, dn = np.linalg.norm(q, axis=1)[:, None], np.linalg.norm(d, axis=1)[None]
    rq, rd = np.asarray(q_radius)[:, None], np.asarray(d_radius)[None]
    top = q @ d.T + qn * rd + dn * rq + rq * rd
    return top + 1e-6 * (1 + np.abs(top))


def _matrix(vecs: list, width: int) -> np.ndarray:
    out = np.zeros((len(vecs), width))
    for i, b in enumerate(vecs):
        own = np.frombuffer(b, "<f8")
        out[i, :len(own)] = own
    return out


def _pack(rows: DataFrame, size: int, name: str, width: int) -> DataFrame:
    """Rows (id, v) as blocks of at most ``size`` rows: (name, ids, vecs, centre, radius, tree).

    Rows are range-partitioned on a signature of coordinate signs, so a block holds
    vectors that point alike; equal vectors spread over as many blocks as they fill."""

    def pack(batches):
        import pandas as pd
        held: list = []

        def block(part):
            x = _matrix([np.asarray(v, "<f8").tobytes() for v in part["v"]], width)
            tree = CoverTree(x)
            centre = x.mean(axis=0)
            radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
            return {"ids": part["id"].to_numpy("<i8").tobytes(), "vecs": x.astype("<f8").tobytes(), "centre": centre.astype("<f8").tobytes(),
                    "radius": radius, "tree": pickle.dumps(tree.nodes)}

        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= size:
                whole = pd.concat(held, ignore_index=True)
                cut = len(whole) // size * size
                for lo in range(0, cut, size):
                    yield pd.DataFrame([block(whole.iloc[lo:lo + size])])
                held = [whole.iloc[cut:]]
        rest = pd.concat(held, ignore_index=True) if held else []
        if len(rest):
            yield pd.DataFrame([block(rest)])

    signs = F.concat(*[F.when(F.coalesce(F.get("v", F.lit(i)), F.lit(0.0)) < 0, "0").otherwise("1") for i in range(16)])
    n = rows.count()
    packed = (rows.withColumn("s", signs)
              .repartitionByRange(max(1, min(partitions(rows.sparkSession), math.ceil(n / size))), "s", F.xxhash64("id"))
              .sortWithinPartitions("s").select("id", "v").mapInPandas(pack, "ids binary, vecs binary, centre binary, radius double, tree binary"))
    return cut_lineage(packed.withColumn(name, F.monotonically_increasing_id()))


def _bounds(groups: DataFrame, data: DataFrame, width: int, seed: bool) -> DataFrame:
    """(grp, block, bound) of the pairs to visit, from centres and radii: the ``SEEDS`` blocks
    of highest centre score, or all whose bound reaches the group's ``worst`` kth score.

    Centres travel in packs of ``CENTRES``; every group meets every pack, some thousandth of
    what the blocks themselves weigh."""
    packs = (data.select("block", "centre", "radius").withColumn("pack", F.floor(F.row_number().over(
        Window.partitionBy(F.spark_partition_id()).orderBy("block")) / CENTRES)).groupBy(F.spark_partition_id().alias("p"), "pack")
        .agg(F.collect_list(F.struct("block", "centre", "radius")).alias("centres")).select("centres"))

    def meet(batches):
        import pandas as pd
        for pdf in batches:
            for r in pdf.itertuples():
                q, d = np.frombuffer(r.q, "<f8")[None], _matrix([c["centre"] for c in r.centres], width)
                top = bound_of(q, [r.q_radius], d, [c["radius"] for c in r.centres])[0]
                score = (q @ d.T)[0]
                keep = np.argsort(-score, kind="stable")[:SEEDS] if seed else np.flatnonzero(top >= r.worst)
                yield pd.DataFrame({"grp": r.grp, "block": [r.centres[i]["block"] for i in keep], "bound": top[keep], "score": score[keep]})

    met = (groups.select("grp", F.col("centre").alias("q"), F.col("radius").alias("q_radius"), "worst").crossJoin(packs)
           .mapInPandas(meet, "grp long, block long, bound double, score double"))
    if seed:
        order = Window.partitionBy("grp").orderBy(F.desc("score"), "block")
        met = met.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SEEDS)
    return met.select("grp", "block", "bound")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id",
          vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The ``k`` rows of largest integer inner product for every query row.

    Components are floor(scale * x). Returns query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    v = F.col(vector).cast("array<double>")
    whole = (F.col(vector).isNotNull() & F.col(vec_id).isNotNull()
             & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = vectors.filter(F.coalesce(whole, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("id"),
        F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("q"))
    # one row per id on both sides: copies would fill the places of other neighbours
    vecs = cut_lineage(rows.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")))
    width = max(1, vecs.agg(F.max(F.size("v"))).first()[0] or 0)
    data = _pack(vecs.select("id", "v"), BLOCK, "block", width)
    groups = _pack(vecs.filter("q").select("id", "v"), GROUP, "grp", width).drop("tree")
    n_groups, n_blocks = groups.count(), data.count()
    if not n_groups or not n_blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    first = groups.withColumn("worst", F.lit(-math.inf))
    seen = _visit(first, data, _bounds(first, data, width, True), n_groups, k, width)
    full = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = seen.withColumn("n", F.row_number().over(full)).filter(F.col("n") == k).groupBy("grp").agg(
        F.min("score").cast("double").alias("low"), F.count("*").alias("filled"))
    # the worst kth score holds for a group whose queries all have k candidates
    known = cut_lineage(groups.join(kth, "grp", "left").withColumn("worst", F.when(
        F.col("filled") * 8 == F.length("ids"), F.col("low")).otherwise(-math.inf)).drop("low", "filled"))
    found = _visit(known, data, shipped_pairs(known, data, width), n_groups, k, width).drop("grp")
    return (found.distinct().withColumn("rank", F.row_number().over(full)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def shipped_pairs(groups: DataFrame, data: DataFrame, width: int) -> DataFrame:
    """The (grp, block, bound) pairs that the full visit shuffles."""
    return _bounds(groups, data, width, False)


def _visit(groups: DataFrame, data: DataFrame, pairs: DataFrame, n_groups: int, k: int, width: int) -> DataFrame:
    """(grp, query_id, vec_id, score): the k best of each query and task among the pairs' blocks.

    Groups x lanes tasks, where lanes share a group's blocks out, highest bound first."""
    lanes = max(1, math.ceil(partitions(groups.sparkSession) / n_groups))
    none = F.lit(None).cast("binary")
    blocks = (pairs.join(data, "block").select(
        "grp", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int").alias("lane"), "bound", "ids", "vecs", "tree", F.lit(None).cast("double").alias("worst")))
    heads = groups.select("grp", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(math.inf).alias("bound"),
                          "ids", "vecs", none.alias("tree"), "worst")

    def run(batches):
        import pandas as pd
        grp = best = qt = None

        def result():
            rows = [(grp, int(q), -neg, s) for q, heap in zip(best.q, best.score) for s, neg in heap]
            return pd.DataFrame(rows, columns=["grp", "query_id", "vec_id", "score"]).astype("int64")

        for pdf in batches:
            for r in pdf.itertuples():
                ids, x = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.vecs, "<f8").reshape(-1, width)
                if r.tree is None:                  # the group comes before its blocks
                    if best is not None:
                        yield result()
                    grp, best, qt = r.grp, Best(ids, k), CoverTree(x)
                    best.worst = np.maximum(best.worst, r.worst)
                elif r.bound >= best.worst.min():
                    search(qt, CoverTree(x, nodes=pickle.loads(r.tree)), ids, best)
        if best is not None:
            yield result()

    return (heads.unionByName(blocks).repartition(n_groups * lanes, "grp", "lane")
            .sortWithinPartitions("grp", "lane", F.desc("bound"), F.col("tree").isNotNull())
            .mapInPandas(run, "grp long, query_id long, vec_id long, score long"))
