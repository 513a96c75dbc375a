"""The ``opN_<name>`` queries: each operator over its whole table, and its SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import blobledger, bpe, covertree, hdlang, htmltext, imatch, jaccard, mil, mixing, multiindex, recompress, tokenbin, warc
from claimlens.llm import oracles as O
from claimlens.llm.common import bounded_batches, fold, table, work_dir

QUALITY_CUT = 0.3
LANG_FLOOR = 0.1            # texts less like every prototype than this have no known language
END_ID = 2


def tokenizer_path(name: str) -> str:
    """A public tokenizer file; $TOKENIZER_DIR names another folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op2_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark, 64)             # a row may be a block of a megabyte
    return covertree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_hd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return (hdlang.language_id(docs.select("doc_id", "text", "lang"), ~held)
            .select("doc_id", held.alias("held_out"), "lang_pred", "score"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), folder=work_dir(spark, "warc"))
    captures = warc.assemble(warc.read_records(manifest, with_payload=False))
    kind = F.col("response.type")
    return captures.select(
        F.element_at("metadata.fields", "page-id").cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        kind.alias("record_type"), F.when(kind == "revisit", warc.page_of(F.col("response.refers_to"))).alias("refers_to"))


#: the tree and weights of the mixing query and pipeline stage
MIX_WEIGHTS = ({"long": 3.0, "medium": 5.0, "short": 2.0}, {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}, {})
MIX_FRACTION = 0.6


def mix_levels() -> dict:
    """domain (by length, as no table names one), language, source."""
    n = mixing.n_words(F.col("text"))
    return {"domain": F.when(n >= 1000, "long").when(n >= 200, "medium").otherwise("short"),
            "lang": F.col("lang"), "source": F.col("source")}


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, MIX_FRACTION, epochs=2).drop("h")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return tokenbin.token_store(table(spark, sf_dir, "documents"), "doc_id", "text",
                                tokenizer_path("byte_bpe_50k.json"), END_ID, work_dir(spark, "tokens"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return (htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
            .withColumn("n_chars", F.length("text").cast("long")))


def op9_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = mil.fit_quality(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))
    return mil.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op10_bpe_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, "text", tokenizer_path("word_bpe_49k.json")).drop("text")


def op11_multiindex_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark, 256)
    key, label = F.col("vec_id"), F.col("label")
    return multiindex.mine(table(spark, sf_dir, "embeddings"), key % 100 == 0,
                           F.when(key % 7 == 0, (label + 1) % 10).otherwise(label))


def op12_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return blobledger.scan_documents(table(spark, sf_dir, "documents"))


def op13_recompression_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    found = recompress.run_detection(table(spark, sf_dir, "documents"), "text", ["doc_id"],
                                     periodic_tail=F.crc32(F.col("doc_id").cast("string")))
    runs = F.col("runs")
    best = F.element_at(F.array_sort(F.transform(runs, lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    length, period = -F.col("best.less"), F.col("best.period")
    return found.withColumn("best", F.when(F.size(runs) > 0, best)).select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"),
        period.alias("period"), F.expr("(-best.less * 1000) div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size(runs) > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_imatch, op2_cover_tree_topk, op3_hd_language, op4_warc, op5_mix,
                                    op6_token_store, op7_jaccard_join, op8_html_text, op9_mil_quality, op10_bpe_dp,
                                    op11_multiindex_negatives, op12_blob_ledger, op13_recompression_runs)}


def oracle_sql() -> dict[str, str]:
    return O.ORACLES
