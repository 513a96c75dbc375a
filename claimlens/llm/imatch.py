"""I-Match document fingerprints, by DataFrame operations only.

Terms are the lower-cased runs of letters and digits. The lexicon holds the terms whose
document frequency lies in a band, ``low`` to ``high`` of all documents (an inverse
document frequency band): words in nearly every text say nothing, words in hardly any
are noise. A class of near-equal texts counts for no more documents than the lower end
of the band, in a term's frequency and in the number of documents, so the terms of a
text do not leave the band by its copies. Near-equal texts are found by ``SKETCHES``
sketches, each the ``LEAST`` smallest of the seeded term hashes; sketches of many
documents that occur together in many documents are one class. The size of the lexicon
is bounded by the mean number of distinct terms divided by ``low``, whatever the corpus. Randomised subsets of the lexicon are drawn by md5: ``SUBSETS``
subsets at each of several densities, so that texts of every length have subsets that
hold a few of their terms. The fingerprint hashes, for each subset, the sorted distinct
terms of the text that lie in it (six hex digits of an md5; that of the empty string
stands for no term). Densities at which a subset would hold more than ``MANY`` of the
text's terms on average are left empty, as they would change with every word; the
sparsest never is, whatever the length of the text.

The likeness of two fingerprints is, at the density where it is largest, the share of
subsets with equal hashes among those that are not empty in both; at least ``FEW`` such
subsets count at a density, unless none has so many. Equal fingerprints: 1.

A text with fewer than ``FEW`` lexicon terms, or with none in any subset, is fingerprinted
on the sorted list of all its distinct terms, in one hash that fills every place.

Defined cases: null text is the empty text; texts without terms have the fingerprint of
the empty list. Rows of the same key and text are one document, returned as often as it
occurs; null keys come last. The only document is its own next one. Further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens.llm.common import cut_lineage, partitions

LOW, HIGH = 0.001, 0.05
DENSITIES = (4, 16, 64, 256, 1024, 4096, 16384)     # a subset holds one in so many lexicon terms
SUBSETS, HEX, FEW, MANY = 8, 6, 3, 8
PLACES = len(DENSITIES) * SUBSETS
SKETCHES, LEAST = 4, 3
BROADCAST_TERMS = 1_000_000             # larger lexicons are joined by shuffle
_NONE = "d41d8c"                         # md5 of the empty string


def terms(text: Column) -> Column:
    """Distinct terms of a text, with one empty term."""
    return F.array_distinct(F.split(F.concat(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit("  ")), " +"))


def sketches(found: str) -> list[Column]:
    """Sketches of a column of term hashes; near-equal sets agree in most of them."""
    def one(i: int) -> Column:
        seed = int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
        drawn = F.transform(found, lambda x: x.bitwiseXOR(F.lit(seed).cast("long")))
        return F.xxhash64(F.lit(i), F.slice(F.sort_array(drawn), 1, LEAST))

    return [one(i) for i in range(SKETCHES)]


def _hashed(docs: DataFrame, text: str) -> DataFrame:
    listed = docs.select(F.array_remove(terms(F.col(text)), "").alias("t"))
    return listed.withColumn("hashes", F.transform("t", lambda t: F.xxhash64(t))).withColumn("s", F.array(*sketches("hashes")))


def near_classes(sketched: DataFrame, most: int) -> dict[int, int]:
    """Class of each sketch that more than ``most`` documents have.

    Two such sketches are of one class if more than ``most`` documents have both. Whatever
    the corpus, fewer than SKETCHES / low sketches and 6 / low pairs of them pass."""
    often = [r["x"] for r in sketched.select(F.explode("s").alias("x")).groupBy("x").count()
             .filter(F.col("count") > most).select("x").collect()]
    root = {x: x for x in often}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    if often:
        both = F.array(*[F.struct(F.col("s")[i].alias("x"), F.col("s")[j].alias("y"))
                         for i in range(SKETCHES) for j in range(i + 1, SKETCHES)])
        for r in (sketched.select(F.explode(both).alias("p")).groupBy("p.x", "p.y").count()
                  .filter(F.col("count") > most).collect()):
            a, b = top(r["x"]), top(r["y"])
            root[max(a, b)] = min(a, b)
    return {x: top(x) for x in often}


def lexicon(docs: DataFrame, text: str, low: float, high: float) -> DataFrame:
    """(term, code, mask): in-band terms, their md5 code and the subsets they lie in.

    The empty term, which every text has, comes with an empty code."""
    spark = docs.sparkSession
    n = docs.count()
    most = max(2, math.ceil(low * n))
    hashed = _hashed(docs, text)
    sketched = cut_lineage(hashed.select("s"))
    classes = near_classes(sketched, most)

    def classed(rows: DataFrame) -> DataFrame:
        if not classes:
            return rows.withColumn("cls", F.lit(None).cast("long"))
        known = F.broadcast(spark.createDataFrame([(classes,)], "known map<long,long>"))
        return rows.crossJoin(known).withColumn("cls", F.coalesce(*[F.col("known")[F.col("s")[i]] for i in range(SKETCHES)]))

    # documents outside the classes count one by one, those of a class at most ``most``
    counted = F.sum(F.when(F.col("cls").isNull(), F.col("m")).otherwise(F.least("m", F.lit(most))))
    if classes:
        n = classed(sketched).groupBy("cls").agg(F.count(F.lit(1)).alias("m")).agg(counted).first()[0]
        each = classed(hashed).select("cls", F.explode("t").alias("term"))
    else:
        each = classed(docs.select(F.explode(terms(F.col(text))).alias("term")).filter("term <> ''"))
    counts = (each.groupBy("term", "cls").agg(F.count(F.lit(1)).alias("m")).groupBy("term").agg(counted.alias("df"))
              .filter((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= max(2.0, high * n))))

    def drawn(p: int) -> Column:
        # four hex digits of an md5 per subset, against its density
        draw = F.conv(F.substring(F.md5(F.concat(F.col("term"), F.lit(f"/{p}"))), 1, 4), 16, 10).cast("int")
        return F.when(draw % DENSITIES[p // SUBSETS] == 0, F.lit(1 << p)).otherwise(F.lit(0)).cast("long")

    mask = drawn(0)
    for p in range(1, PLACES):
        mask = mask + drawn(p)
    return cut_lineage(spark.sql("SELECT '' AS term, '' AS code, 0L AS mask").unionByName(
        counts.select("term", F.substring(F.md5("term"), 1, 16).alias("code"), mask.alias("mask"))))


def _bits(densities) -> int:
    return sum(1 << p for d in densities for p in range(d * SUBSETS, (d + 1) * SUBSETS))


def _having(found: Column, bits: int) -> Column:
    return F.filter(found, lambda t: t["mask"].bitwiseAND(F.lit(bits).cast("long")) != 0)


def _print(prints: DataFrame, found: str, all_hash: str, name: str) -> DataFrame:
    """``prints`` with the fingerprint of a column of sorted sets of (code, mask).

    The terms of each density (the sparse ones together) are picked out first, so the
    subsets of a density look at its own terms only."""
    kinds = [(0,), (1,), tuple(range(2, len(DENSITIES)))]
    size = F.size(found)
    picked = {f"__{i}": F.when(size <= MANY * DENSITIES[kind[0]], _having(F.col(found), _bits(kind))).otherwise(F.array())
              if len(kind) == 1 else _having(F.col(found), _bits(kind)) for i, kind in enumerate(kinds)}
    prints = prints.withColumns(picked)

    def place(i: int, d: int, p: int) -> Column:
        own = F.substring(F.md5(F.array_join(_having(F.col(f"__{i}"), 1 << p)["code"], ",")), 1, HEX)
        return own if d < 2 or d == len(DENSITIES) - 1 else F.when(size <= MANY * DENSITIES[d], own).otherwise(_NONE)

    places = [place(i, d, p) for i, kind in enumerate(kinds) for d in kind for p in range(d * SUBSETS, (d + 1) * SUBSETS)]
    prints = prints.withColumn("__subsets", F.when(size >= FEW, F.concat(*places)))
    some = F.col("__subsets") != _NONE * PLACES       # null: too few terms
    return prints.withColumn(name, F.when(some, F.col("__subsets")).otherwise(F.repeat(all_hash, PLACES))).drop(*picked, "__subsets")


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1."""
    def at(print_: Column, p: Column) -> Column:
        return F.substring(print_, p * HEX + 1, F.lit(HEX))

    shares, few = [], []
    for d in range(len(DENSITIES)):
        places = F.lit(list(range(d * SUBSETS, (d + 1) * SUBSETS)))
        some = F.size(F.filter(places, lambda p: (at(a, p) != _NONE) | (at(b, p) != _NONE)))
        same = F.size(F.filter(places, lambda p: (at(a, p) != _NONE) & (at(a, p) == at(b, p))))
        share = same / F.when(some > 0, some)
        shares.append(F.when(some >= FEW, share))
        few.append(share)
    return F.when(a == b, 1.0).otherwise(F.coalesce(F.greatest(*shares), F.greatest(*few), F.lit(0.0)))


def next_documents(rows: DataFrame) -> DataFrame:
    """Each document (k, z, h) with how often it occurs and its next one by descending
    key, then text hash; the last is followed by the first."""
    keys = rows.groupBy("k", "z", "h").agg(F.count(F.lit(1)).alias("copies"), F.max("n_chars").alias("n_chars"))
    order = [F.col("z"), F.desc("k"), F.col("h")]
    n = partitions(rows.sparkSession)
    placed = cut_lineage(keys.repartitionByRange(n, *order).withColumn("pid", F.spark_partition_id()))
    own = Window.partitionBy("pid").orderBy(*order)
    inner = placed.select("*", F.lead(F.struct("k", "z", "h")).over(own).alias("next"),
                          F.row_number().over(own).alias("nth"))
    # one row per partition: the first key of the next partition that has any
    heads = inner.filter("nth = 1").select(F.col("pid").alias("p"), F.struct("k", "z", "h").alias("head"))
    after = F.coalesce(F.lead("head").over(Window.orderBy("p")), F.first("head").over(
        Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    nxt = F.coalesce("next", "after")
    return cut_lineage(inner.join(F.broadcast(heads.select("p", after.alias("after"))), F.col("pid") == F.col("p")).select(
        "k", "z", "h", "copies", "n_chars", nxt["k"].alias("nk"), nxt["z"].alias("nz"), nxt["h"].alias("nh")))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", low: float = LOW,
                 high: float = HIGH) -> DataFrame:
    """Fingerprints of every text and of its edited text (its last third replaced by the
    beginning of the next document), with their likenesses."""
    smallest = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), smallest).alias("k"), F.col(key).isNull().alias("z"),
                       F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    length = F.length("text").cast("long")
    chain = next_documents(rows.select("k", "z", "h", length.alias("n_chars")))
    words = lexicon(rows, "text", low, high)
    if words.count() <= BROADCAST_TERMS:
        words = F.broadcast(words)
    # what each document takes from its next one; both joins read one exchange of the texts
    a, c = rows.alias("a"), chain.alias("c")
    taken = (a.join(c, (F.col("a.k") == F.col("nk")) & (F.col("a.z") == F.col("nz")) & (F.col("a.h") == F.col("nh")))
             .select("c.k", "c.z", "c.h", F.substring("text", F.lit(1), F.floor(F.col("c.n_chars") / 3).cast("int"))
                     .alias("piece"))
             .groupBy("k", "z", "h").agg(F.first("piece").alias("piece")))
    kept = F.substring("text", F.lit(1), (length - F.floor(length / 3)).cast("int"))
    both = rows.join(taken, ["k", "z", "h"]).withColumn("edited", F.concat(kept, F.col("piece")))

    def all_hash(t: str) -> Column:
        return F.substring(F.md5(F.array_join(F.array_sort(F.col(t)), " ")), 1, HEX)

    listed = both.select("k", "z", "h", length.alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                         terms(F.col("text")).alias("t0"), terms(F.col("edited")).alias("t1"))
    whole = ["n_chars", "edited_sha256", "all0", "all1"]
    sides = listed.select("k", "z", "h", "n_chars", "edited_sha256", all_hash("t0").alias("all0"), all_hash("t1").alias("all1"),
                          F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("t0").alias("terms")),
                                            F.struct(F.lit(1).alias("side"), F.col("t1").alias("terms")))).alias("s"))
    # what belongs to the document as a whole rides on the row of its empty term
    row = (F.col("side") == 0) & (F.col("term") == "")
    found = (sides.select("k", "z", "h", *whole, F.col("s.side").alias("side"), F.explode("s.terms").alias("term"))
             .select("k", "z", "h", *[F.when(row, F.col(c)).alias(c) for c in whole], "side", "term").join(words, "term"))

    def own(side: int) -> Column:
        return F.array_sort(F.collect_set(F.when((F.col("side") == side) & (F.col("mask") != 0), F.struct("code", "mask"))))

    prints = found.groupBy("k", "z", "h").agg(*[F.max(c).alias(c) for c in whole], own(0).alias("w0"), own(1).alias("w1"))
    prints = _print(prints, "w0", "all0", "fingerprint")
    prints = cut_lineage(_print(prints, "w1", "all1", "edited_fingerprint").drop("w0", "w1", "all0", "all1"))
    nxt = prints.select(F.col("k").alias("nk"), F.col("z").alias("nz"), F.col("h").alias("nh"),
                        F.col("fingerprint").alias("next_print"))
    out = prints.join(chain.drop("n_chars"), ["k", "z", "h"]).join(nxt, ["nk", "nz", "nh"])
    return out.select(F.when(F.col("z"), None).otherwise(F.col("k")).cast("long").alias("doc_id"), "n_chars",
                      "edited_sha256", "fingerprint", "edited_fingerprint",
                      likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                      likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
                      F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")
