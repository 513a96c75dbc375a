"""From raw documents to token ids: quality, language, near duplicates, mixture, BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns
a DataFrame that is written as Parquet and reread as the next one's ``docs``. All but
the last return the columns of ``documents``. ``run`` applies them to ``documents``.

Defined cases: an empty table gives no rows at any stage; rows of one key and text are
near duplicates of each other, so one of them stays; rows without words link with
nothing, but the quality stage may reject them; further columns are passed through up
to the last stage, except names that begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens.llm import bpe, hdlang, jaccard, mil, mixing
from claimlens.llm import catalog as C
from claimlens.llm.common import bounded_batches, cut_lineage, fold, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the quality classifier scores at 0.3 or more."""
    bounded_batches(spark)
    model = mil.fit_quality(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))
    return mil.score(docs, model, name="__score").filter(F.col("__score") >= C.QUALITY_CUT).drop("__score")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts in a learned language: not ``und``, and not unlike every prototype."""
    bounded_batches(spark)
    protos = hdlang.fit_prototypes(docs.filter(F.coalesce(fold("doc_id", 3) != 1, F.lit(False))), "text", "lang")
    known = hdlang.identify(docs, protos, "text", pred="__lang", score="__cos")
    return known.filter((F.col("__lang") != "und") & (F.col("__cos") >= C.LANG_FLOOR)).drop("__lang", "__cos")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at Jaccard 0.8 on five-word shingles, keep the smallest key."""
    rows = jaccard.jaccard_components(docs, n=5, num=80, den=100, with_hash=True)
    # the first row of each component; rows without words are their own
    unit = F.coalesce(F.col("comp"), F.xxhash64("doc_id", "th"))
    first = cut_lineage(rows.groupBy(unit.alias("u"), F.col("comp").isNull().alias("alone"))
                        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")).alias("f"))
                        .select(F.col("f.doc_id").alias("__id"), F.col("f.th").alias("__th")))
    own = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    kept = own.join(first, (F.col("__h") == F.col("__th")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    once = Window.partitionBy("__h", "__id").orderBy(F.lit(1))
    return (kept.withColumn("__n", F.row_number().over(once)).filter("__n = 1")
            .drop("__h", "__th", "__id", "__n"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents to the target weights of domain, language and source, each at
    most once (rows of one key and text are taken together)."""
    taken = mixing.mix(docs, C.mix_levels(), C.MIX_WEIGHTS, C.MIX_FRACTION, epochs=1).select(
        F.col("doc_id").alias("__id"), F.col("h").alias("__th")).distinct()
    own = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    on = (F.col("__h") == F.col("__th")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return own.join(taken, on, "left_semi").drop("__h")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as counts and digests."""
    bounded_batches(spark)
    out = bpe.encode_decode(docs.select("doc_id", "text"), "text", C.tokenizer_path("word_bpe_49k.json"))
    return out.drop("text")


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates),
          ("mixture", mixture), ("encode", encode)]

#: SQL can express neither the classifiers nor BPE; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
