"""Secret scans over content-addressed blobs, with a ledger of what was scanned.

Every version of every path is addressed by the SHA-256 of its text. The ledger, a
Parquet table in a shared folder, has one row per scan of a blob: its address, the rules
(``name@version``) that scan ran, and the spans found. An update takes the distinct blobs
of the given versions, subtracts the (blob, rule-version) pairs the ledger has, scans the
rest once, and appends. Findings are joined back to all versions of all paths that hold
the blob, so a text that a third of the rows share is scanned once and a new rule version
rescans blobs, not paths.

Texts are shuffled once, one copy per blob and map task (Spark keeps the first of each
address before the shuffle). The join back moves addresses only, from blobs with findings.

Defined cases: a null text is the empty text, which has no findings; null paths and
repeated rows are versions like others; an empty table gives no rows and leaves the ledger
as it is. Columns of the input other than path and text are kept by ``find``; their names
may not begin with two underscores. A span is that of the whole match, in code points, end
exclusive. A failed update appends nothing; one run twice appends equal rows, of which
``findings`` reads one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm.common import work_dir


@dataclass(frozen=True)
class Rule:
    """A pattern (Python ``re``, ASCII classes) of one kind; matches whose ``group`` has
    fewer than ``least`` characters are dropped after matching. ``hints``: lower-case
    strings of which any match holds one (case aside), to pass texts without them by."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hints: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"

    def spans(self, text: str, low: str) -> Iterator[tuple[int, int]]:
        if not self.hints or any(h in low for h in self.hints):
            for m in re.finditer(self.pattern, text, re.A):
                if m.end(self.group) - m.start(self.group) >= self.least:
                    yield m.span()


#: the three base kinds; runs of hexadecimal digits and access keys that are too short cannot
#: overlap a longer match, so their length is part of the pattern
BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, least=6, hints=("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", hints=("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}"))
#: kinds the ledger scans beside them
EXTRA = (
    Rule("pem", 1, r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", hints=("private key-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", hints=("eyj",)))
RULES = BASE + EXTRA

_FOUND = "array<struct<kind:string,start:long,end:long>>"
_SCANS = f"blob binary, rules array<string>, found {_FOUND}"


def address(text: Column) -> Column:
    """The SHA-256 of a text (null: of the empty text) as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class Ledger:
    """The scans made so far, under ``folder`` (a path that all executors share)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, f"{folder.rstrip('/')}/scans"

    def scans(self) -> DataFrame:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.read.schema(_SCANS).parquet(self.path)
        return self.spark.createDataFrame([], _SCANS)

    def unseen(self, versions: DataFrame, text: str, rules: Sequence[Rule]) -> DataFrame:
        """(blob, text, rules) of each distinct blob that some rule version has not seen."""
        blobs = (versions.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
                 .dropDuplicates(["blob"]))
        wanted = F.array(*[F.lit(r.key) for r in rules])
        done = (self.scans().select("blob", F.explode("rules").alias("r"))
                .filter(F.col("r").isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set("r").alias("done")))
        return (blobs.join(done, "blob", "left")
                .select("blob", "text", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))).alias("rules"))
                .filter(F.size("rules") > 0))

    def update(self, versions: DataFrame, text: str, rules: Sequence[Rule] = RULES) -> None:
        """Scan what the ledger has not seen of ``versions`` and append it."""
        by_key = {r.key: r for r in rules}

        @F.pandas_udf(_FOUND)
        def scan(texts: pd.Series, todo: pd.Series) -> pd.Series:
            out = []
            for t, keys in zip(texts, todo):
                low = t.lower()
                out.append([{"kind": by_key[k].name, "start": lo, "end": hi} for k in keys for lo, hi in by_key[k].spans(t, low)])
            return pd.Series(out)

        (self.unseen(versions, text, rules).select("blob", "rules", scan("text", "rules").alias("found"))
         .write.mode("append").parquet(self.path))

    def findings(self, rules: Sequence[Rule] = RULES) -> DataFrame:
        """(blob, found) of the blobs with spans of these rule versions, ordered by start, then rule."""
        names = F.array(*[F.lit(r.name) for r in rules])
        scans = self.scans().filter(F.size("found") > 0).select("blob", F.explode("rules").alias("key"), "found")
        own = (scans.filter(F.col("key").isin([r.key for r in rules]))
               .select("blob", "key", F.expr("filter(found, s -> s.kind = substring_index(key, '@', 1))").alias("found"))
               .filter(F.size("found") > 0).dropDuplicates(["blob", "key"]))
        order = F.transform(F.flatten(F.collect_list("found")), lambda s: F.struct(
            s["start"].alias("start"), F.array_position(names, s["kind"]).alias("at"), s["kind"].alias("kind"), s["end"].alias("end")))
        return own.groupBy("blob").agg(F.array_sort(order).alias("found"))

    def find(self, versions: DataFrame, text: str, rules: Sequence[Rule] = RULES) -> DataFrame:
        """``versions`` without its text, with ``found``: the spans of each row's blob."""
        rows = versions.withColumn("__blob", address(F.col(text))).drop(text)
        found = self.findings(rules).select(F.col("blob").alias("__blob"), F.col("found").alias("__found"))
        none = F.array().cast("array<struct<start:long,at:int,kind:string,end:long>>")
        return (rows.join(found, "__blob", "left").withColumn("found", F.coalesce("__found", none))
                .drop("__blob", "__found"))


def joined(found: Column, kinds: Sequence[str] | None = None) -> Column:
    """``kind:start:end`` of the spans, comma-joined in their order."""
    if kinds is not None:
        found = F.filter(found, lambda s: s["kind"].isin(list(kinds)))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None,
                   rules: Sequence[Rule] = RULES) -> DataFrame:
    """Bring the ledger up to date with ``docs`` and return one row per document: key,
    n_<kind> of the base kinds, digest of the base spans, all spans."""
    spark = docs.sparkSession
    ledger = Ledger(spark, folder or work_dir(spark, "ledger"))
    rows = docs.select(key, text)
    ledger.update(rows, text, rules)
    found = F.col("found")
    base = [r.name for r in BASE]

    def number(kind: str) -> Column:
        return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return ledger.find(rows, text, rules).select(
        key, *[number(k) for k in base],
        F.sha2(joined(found, base), 256).alias("base_sha256"), joined(found).alias("spans"))
