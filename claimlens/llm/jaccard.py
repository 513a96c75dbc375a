"""Exact n-gram Jaccard join with a token-group matrix.

Each document is the set of its distinct word shingles. Equal sets form a class, and
one row per class goes on. A class's *tokens* are its p smallest shingle hashes, where
p = n - ceil(t n) + l(n) for a set of n shingles, similarity t and l(n) = max(1, n // 8):
two sets that reach the similarity share at least l of these tokens, l taken at the
smaller of their sizes (the prefix filter, with room for l common tokens instead of
one). Since l must be shared, every class may leave out its l - 1 most frequent tokens:
the rarest shared one always stays. So passages that many documents share, and frequent
words, do not bring documents together; nearly copied texts meet in their own tokens.

* Overlap: a class's token overlap with all others is the number of its tokens that some
  other class has; below l no link is possible, and the class is done.
* Groups: the other classes, connected by shared tokens, form clusters, which no link
  leaves. A cluster is one group, or is split into several of at most ``GROUP_SHINGLES``.
* Matrix: (token, group) rows are the groups' token unions. The column of an undivided
  cluster meets only its own members; between the groups of a split cluster the tokens that
  two unions share are counted, and the members of one visit the other, from one side, if
  some class there could reach l. A visitor's overlap with the group's union decides whether
  the group is opened for it.
* Opening: a task holds the members of one group, compares them with each other and then
  some ``VISITORS`` visitors with them, shingle by shingle; a group with more visitors is opened
  by several tasks.
  Every link between different sets is found and counted; as a group's links can be as many
  as its pairs, tasks return each class's number of linked documents and a spanning set of
  links, whose components are those of all links.

Defined cases: null text or text without words is the empty set, linked with nothing
(its component is its own key). With fewer words than n the whole sequence is the one
shingle. Rows of one key and text are the same node; a null key belongs to the
component of its text and is never its smallest key. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens.llm import words as W
from claimlens.llm.common import bounded_batches, components, cut_lineage

GROUP_SHINGLES = 2_000_000      # shingles in a group, the unit of memory in a task
VISITORS = 20_000               # classes that one task compares with a group from outside
BROADCAST_ROWS = 2_000_000      # ids; at 16 bytes each, more are joined by shuffle
_K = [np.uint64(k) for k in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(texts: list, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list = [np.zeros(0, np.uint64)] * len(texts)
    for lo, hi in W.batches(texts):
        buf, starts, ends, doc = W.words(texts[lo:hi])
        if not len(starts):
            continue
        h = W.hashes(buf, starts, ends)
        count = np.bincount(doc, minlength=hi - lo)
        first = np.concatenate([[0], np.cumsum(count)])
        with np.errstate(over="ignore"):
            whole = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
            for j in range(n):
                whole = W.mix(whole * _K[0] + h[j:len(h) - n + 1 + j] * _K[1])
            whole += _K[2]
        fits = doc[:len(whole)] == doc[n - 1:]
        owner, whole = doc[:len(whole)][fits], whole[fits]
        order = np.lexsort((whole, owner))
        owner, whole = owner[order], whole[order]
        if len(whole):
            new = np.ones(len(whole), dtype=bool)
            new[1:] = (whole[1:] != whole[:-1]) | (owner[1:] != owner[:-1])
            owner, whole = owner[new], whole[new]
        cut = np.searchsorted(owner, np.arange(hi - lo + 1))
        for d in range(hi - lo):
            if count[d] >= n:
                out[lo + d] = whole[cut[d]:cut[d + 1]]
            elif count[d]:
                value = np.array([count[d]], dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for x in h[first[d]:first[d + 1]]:
                        value = W.mix(value * _K[2] + x)
                out[lo + d] = value
    return out


def shared_at_least(size, num: int, den: int):
    """How many tokens a set of ``size`` shingles shares with any set it links to."""
    smallest = -(-size * num // den)
    return np.maximum(1, smallest // 8)


def signatures(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """The tokens of a sorted set."""
    n = len(shingles)
    return shingles[:min(n, n - -(-n * num // den) + max(1, n // 8))]


class Group:
    """The members of a group, opened: an inverted list of their shingles."""

    def __init__(self, cls: np.ndarray, docs: np.ndarray, sets: list[np.ndarray], num: int, den: int):
        self.cls, self.docs, self.num, self.den = cls, docs, num, den
        self.size = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        flat, self.owner = flat[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        self.shingles, self.at = flat[first], np.append(first, len(flat))
        self.label = np.arange(len(sets))           # connected so far
        self.links = np.zeros(len(sets), dtype=np.int64)
        self.tokens = np.unique(np.concatenate([signatures(s, num, den) for s in sets]))
        self.edges: list[tuple[int, int]] = []

    def linked(self, shingles: np.ndarray) -> np.ndarray:
        """Places of the members that link with a set."""
        n = len(shingles)
        k = np.searchsorted(self.shingles, shingles)
        k = k[self.shingles[np.minimum(k, len(self.shingles) - 1)] == shingles]
        lo, size = self.at[k], self.at[k + 1] - self.at[k]
        if not len(k):
            return k
        flat = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
        both = np.bincount(self.owner[flat], minlength=len(self.size))
        return np.flatnonzero(self.den * both >= self.num * (self.size + n - both))

    def reached(self, shingles: np.ndarray) -> bool:
        """Whether a visitor's overlap with the group's token union allows a link."""
        own = signatures(shingles, self.num, self.den)
        at = np.searchsorted(self.tokens, own)
        overlap = (self.tokens[np.minimum(at, len(self.tokens) - 1)] == own).sum()
        return bool(overlap >= shared_at_least(len(shingles), self.num, self.den))

    def meet(self, cls: int, docs: int, shingles: np.ndarray, member: int | None = None) -> int:
        """Link one set with the members; returns the documents it links with. A member is
        met by all others, so its links are its own to count; a visitor adds to theirs."""
        hit = self.linked(shingles)
        if member is not None:
            hit = hit[hit != member]
        elif len(hit):
            self.links[hit] += docs
        if not len(hit):
            return 0
        labels, place = np.unique(self.label[hit], return_index=True)
        own = None if member is None else self.label[member]
        for lab, i in zip(labels.tolist(), place.tolist()):
            if lab != own:
                self.edges.append((cls, int(self.cls[hit[i]])))
        if len(labels) > 1 or own is not None and labels[0] != own:
            low = int(labels[0] if own is None else min(labels[0], own))
            self.label[np.isin(self.label, labels if own is None else np.append(labels, own))] = low
        return int(self.docs[hit].sum())


def _open_groups(num: int, den: int):
    """Rows sorted by (task, visitor): a spanning set of links (a, b), and (a, null, n) with the
    linked documents of each class."""
    def run(batches):
        import pandas as pd
        key, held, group, names = None, [], None, ["a", "b", "n"]

        def opened():
            got = Group(np.array([h[0] for h in held]), np.array([h[1] for h in held]), [h[2] for h in held], num, den)
            if held and held[0][3]:                 # the first task of a group compares its members
                for i, (cls, docs, shingles, _) in enumerate(held):
                    got.links[i] += got.meet(cls, docs, shingles, i)
            return got

        def closed():
            n = group.links > 0
            rows = [(a, b, 0) for a, b in group.edges] + [(c, None, k) for c, k in zip(group.cls[n].tolist(), group.links[n].tolist())]
            return pd.DataFrame({"a": [r[0] for r in rows], "b": pd.array([r[1] for r in rows], dtype="Int64"), "n": [r[2] for r in rows]},
                                columns=names)

        for pdf in batches:
            met = []
            for r in pdf.itertuples(index=False):
                if (r.grp, r.block) != key:
                    if key is not None:
                        group = group or opened()
                        yield closed()
                    key, held, group = (r.grp, r.block), [], None
                shingles = np.frombuffer(r.shingles, "<u8")
                if not r.visitor:
                    held.append((r.cls, r.docs, shingles, r.block == 0))
                    continue
                group = group or opened()
                n = group.meet(r.cls, r.docs, shingles) if group.reached(shingles) else 0
                if n:
                    met.append((r.cls, None, n))
            if met:
                yield pd.DataFrame({"a": [m[0] for m in met], "b": pd.array([None] * len(met), dtype="Int64"), "n": [m[2] for m in met]})
        if key is not None:
            group = group or opened()
            yield closed()
    return run


def classes_of(docs: DataFrame, key: str, text: str, n: int, num: int, den: int) -> DataFrame:
    """One row per document: key, text hash, set size, class and tokens."""

    def run(batches):
        import pandas as pd
        for pdf in batches:
            sets = shingle_sets(pdf["t"].tolist(), n)
            with np.errstate(over="ignore"):
                cls = [W.mix(W.mix(s + _K[0]).sum(keepdims=True) + np.uint64(len(s))).view("<i8")[0] if len(s) else None
                       for s in sets]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "th": pdf["th"], "n_shingles": [len(s) for s in sets],
                                "cls": pd.array(cls, dtype="Int64"),
                                "tokens": [signatures(s, num, den).view("<i8") for s in sets]})

    t = F.coalesce(F.col(text), F.lit(""))
    return cut_lineage(docs.select(F.col(key).cast("long").alias("doc_id"), t.alias("t"), F.xxhash64(t).alias("th"))
                       .mapInPandas(run, "doc_id long, th long, n_shingles long, cls long, tokens array<long>"))


def _few(df: DataFrame) -> DataFrame:
    """Broadcast a table of ids where its counted rows are few; else join by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def links(docs: DataFrame, rows: DataFrame, key: str, text: str, n: int, num: int, den: int) -> DataFrame:
    """Links between classes of ``rows``, as written rows: (a, b, 0) is a spanning set, (a, null,
    k) says that class a links with k documents of other classes (to be summed)."""
    spark = docs.sparkSession
    classes = cut_lineage(rows.filter("cls is not null").groupBy("cls").agg(
        F.min(F.struct("doc_id", "th")).alias("first"), F.first("n_shingles").alias("n"), F.count("*").alias("docs"),
        F.first("tokens").alias("tokens")))
    spare = F.greatest(F.lit(1), F.floor(F.floor((F.col("n") * num + (den - 1)) / den) / 8)).cast("int") - 1
    entries = classes.select("cls", spare.alias("spare"), F.explode("tokens").alias("token"))
    # tokens of one class alone need no partner; a class's other tokens are its overlap with
    # all classes. It keeps all but the most frequent that it may leave out
    counts = entries.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = Window.partitionBy("cls")
    rank = F.row_number().over(own.orderBy(F.desc("df"), F.desc("token")))
    entries = cut_lineage(entries.join(counts, "token").withColumn("from_top", rank).withColumn("overlap", F.count(F.lit(1)).over(own))
                          .filter("from_top > spare AND overlap > spare").select("cls", "token"))
    # clusters: every class with the smallest class of each of its tokens
    lows = entries.groupBy("token").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low < high")
    edges = cut_lineage(entries.join(lows, "token").select(F.col("cls").alias("a"), F.col("low").alias("b"))
                        .filter("a <> b").distinct())
    cluster = components(edges, spark)
    cluster = cut_lineage(cluster.unionByName(cluster.select(F.col("root").alias("node"), "root")).distinct())
    members = classes.drop("tokens").join(cluster, F.col("cls") == F.col("node")).drop("node")
    width = members.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(GROUP_SHINGLES)).alias("parts"))
    members = cut_lineage(
        members.join(width, "root").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")))
        .select("cls", "docs", (spare + 1).alias("need"), "parts", F.xxhash64("root", "part").alias("grp"),
                F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th")))

    def sets(batches):
        import pandas as pd
        for pdf in batches:
            got = shingle_sets(pdf["t"].tolist(), n)
            yield pd.DataFrame({"cls": pdf["cls"], "docs": pdf["docs"], "grp": pdf["grp"], "shingles": [s.tobytes() for s in got]})

    t = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(key).cast("long").alias("d"), t.alias("t"), F.xxhash64(t).alias("h"))
    wanted = _few(members.select("cls", "docs", "grp", "doc_id", "th"))
    picked = (texts.join(wanted, (F.col("h") == F.col("th")) & F.col("d").eqNullSafe(F.col("doc_id")))
              .select("cls", "docs", "grp", "t").mapInPandas(sets, "cls long, docs long, grp long, shingles binary"))
    stream = picked.select("cls", "docs", "shingles", "grp", F.lit(0).alias("block"), F.lit(False).alias("visitor"))
    split = members.filter("parts > 1").select("cls", "grp", "need")
    if not split.isEmpty():
        picked = cut_lineage(picked)               # read by its own group and by those it visits
        visits = cut_lineage(visits_of(split, classes))
        sizes = split.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
        tasks = visits.join(sizes, "grp").groupBy("other").agg(F.ceil(F.sum("size") / F.lit(VISITORS)).cast("int").alias("blocks"))
        blocks = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block")
        inside = picked.join(tasks.withColumnRenamed("other", "grp"), "grp", "left").select(
            "cls", "docs", "shingles", "grp", blocks, F.lit(False).alias("visitor"))
        outside = (picked.join(visits.join(tasks, "other"), "grp")
                   .select("cls", "docs", "shingles", F.col("other").alias("grp"),
                           F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("visitor")))
        stream = inside.unionByName(outside)
    return cut_lineage(stream.repartition("grp", "block").sortWithinPartitions("grp", "block", "visitor", "cls")
                       .mapInPandas(_open_groups(num, den), "a long, b long, n long"))


def visits_of(split: DataFrame, classes: DataFrame) -> DataFrame:
    """(grp, other): the groups of split clusters whose members visit a later group, as the
    token unions of both share as many tokens as some member needs. ``split``: (cls, grp, need)."""
    matrix = cut_lineage(split.join(classes.select("cls", "tokens"), "cls").select("grp", F.explode("tokens").alias("token")).distinct())
    # tokens of one group alone open no other
    wide = matrix.groupBy("token").agg(F.count(F.lit(1)).alias("groups")).filter("groups > 1").select("token")
    shared = matrix.join(wide, "token")
    least = split.groupBy("grp").agg(F.min("need").alias("need"))
    met = shared.join(shared.withColumnRenamed("grp", "other"), "token").filter("other > grp").groupBy("grp", "other").agg(
        F.count(F.lit(1)).alias("overlap"))
    return met.join(least, "grp").filter("overlap >= need").select("grp", "other")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3,
                       num: int = 90, den: int = 100, with_hash: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row: two rows link when
    den * intersection >= num * union; component_id is the smallest key reachable, n_links
    the number of other rows it links with.

    ``with_hash`` gives (doc_id, th, comp) instead: the text's xxhash64 and a component
    number that is null for the empty set, to tell rows of one key apart."""
    if not 0 < num <= den:
        raise ValueError("the similarity must lie in (0, 1]")
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = classes_of(docs, key, text, n, num, den)
    found = links(docs, rows, key, text, n, num, den)
    roots = components(found.filter("b IS NOT NULL").select("a", "b"), spark)
    slim = rows.select("doc_id", "th", "n_shingles", "cls")
    placed = slim.join(roots, F.col("cls") == F.col("node"), "left").select(
        "doc_id", "th", "n_shingles", "cls", F.coalesce("root", "cls").alias("comp"))
    if with_hash:
        return placed.drop("n_shingles", "cls")
    lowest = placed.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("low"))
    others = found.filter("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    copies = slim.filter("cls IS NOT NULL").groupBy("cls").agg((F.count("*") - 1).alias("copies"))
    counted = copies.join(others, "cls", "left").select("cls", (F.col("copies") + F.coalesce("others", F.lit(0))).alias("n_links"))
    return placed.join(lowest, "comp", "left").join(counted, "cls", "left").select(
        "doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


__all__ = ["Group", "jaccard_components", "links", "shared_at_least", "shingle_sets", "signatures", "visits_of"]
