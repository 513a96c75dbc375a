"""WARC 1.1 archives: writing captures, reading records, assembling transactions.

Writing gives every row a request, a response (or revisit) and a metadata record, each
its own gzip member; request and metadata name the response in WARC-Concurrent-To.
Rows whose payloads are equal and long enough are written once: the row with the
largest id is the response, the others are ``revisit`` records that refer to it.

Reading parses the files named in a manifest, one per task, as a stream of records.
Assembly joins requests and metadata to responses through the concurrent-to
identifiers and emits one nested row per response or revisit record.

Defined cases: null html is the empty payload; a null url leaves WARC-Target-URI out;
a null id gets a random record id and never refers to another row; rows of the same id
each give a capture, and where they are the largest of equal payloads all of them are
responses. Requests or metadata without a response are not captures. An empty table
gives no files and no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.llm.common import cut_lineage, new_file, store, work_dir

DATE = "2024-01-01T00:00:00Z"
_URN = re.compile(r"<urn:page:(-?\d+)>")

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("concurrent_to", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("uri", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("payload", T.BinaryType())])


def mark_revisits(pages: DataFrame, page_id: str, html: str, min_bytes: int = 1000) -> DataFrame:
    """(page_id, url columns kept) with digest, bytes, record_type, refers_to."""
    rows = (pages.withColumn("_body", F.coalesce(F.col(html), F.lit("")))
            .withColumn("_digest", F.sha1("_body")).withColumn("_bytes", F.octet_length("_body").cast("long")))
    # one row per payload that occurs more than once; pre-aggregated, so a payload that
    # a third of the rows share costs one row per task
    shared = (rows.filter(F.col("_bytes") >= min_bytes).groupBy(F.col("_digest").alias("_d"))
              .agg(F.max(page_id).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    rows = rows.join(shared, F.col("_digest") == F.col("_d"), "left").drop("_d")
    again = F.col("_first").isNotNull() & F.col(page_id).isNotNull() & (F.col(page_id) != F.col("_first"))
    again = again | (F.col("_first").isNotNull() & F.col(page_id).isNull())
    return rows.withColumn("_type", F.when(again, "revisit").otherwise("response")).withColumn(
        "_refers", F.when(again, F.col("_first"))).drop("_first")


def _record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), *headers,
            ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(text.encode() + block + b"\r\n\r\n") + c.flush()


def _header_value(v: str) -> str:
    """A value without line breaks (percent-encoded, as in URIs)."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", v)


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                   folder: str | None = None, min_bytes: int = 1000) -> DataFrame:
    """Write one archive file per partition; returns the manifest (folder, name, records)."""
    folder = folder or work_dir(pages.sparkSession, "warc")
    rows = mark_revisits(pages.select(page_id, url, html), page_id, html, min_bytes).select(
        F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), F.col("_body").alias("body"),
        F.col("_digest").alias("digest"), F.col("_type").alias("type"), F.col("_refers").cast("long").alias("refers"))

    def write(batches):
        import pandas as pd
        first = next(batches, None)
        if first is None:
            return
        n = 0
        with new_file(folder, "capture", ".warc.gz") as (name, out):
            pdf = first
            while pdf is not None:
                for page, uri, body, digest, kind, refers in zip(
                        pdf["id"].astype("Int64"), pdf["url"], pdf["body"], pdf["digest"], pdf["type"],
                        pdf["refers"].astype("Int64")):
                    payload = body.encode("utf-8")
                    rid = f"<urn:uuid:{uuid.uuid4()}>" if page is pd.NA else f"<urn:page:{page}>"
                    target = [("WARC-Target-URI", _header_value(uri))] if isinstance(uri, str) else []
                    beside = [*target, ("WARC-Concurrent-To", rid)]
                    host = _header_value(uri.split("/")[2]) if isinstance(uri, str) and uri.count("/") > 1 else ""
                    out.write(_record("request", f"<urn:uuid:{uuid.uuid4()}>",
                                      [*beside, ("Content-Type", "application/http;msgtype=request")],
                                      f"GET / HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()))
                    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                            f"Content-Length: {len(payload)}\r\n\r\n").encode()
                    own = [*target, ("Content-Type", "application/http;msgtype=response"), (
                        "WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
                    if kind == "revisit":
                        own += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                                ("WARC-Refers-To", f"<urn:page:{refers}>")]
                        payload = b""
                    out.write(_record(kind, rid, own, http + payload))
                    info = "" if page is pd.NA else f"page-id: {page}\r\n"
                    out.write(_record("metadata", f"<urn:uuid:{uuid.uuid4()}>",
                                      [*beside, ("Content-Type", "application/warc-fields")], info.encode()))
                    n += 3
                pdf = next(batches, None)
        yield pd.DataFrame([(folder, name, n)], columns=["folder", "name", "records"])

    return cut_lineage(rows.mapInPandas(write, "folder string, name string, records long"))


def _records(stream):
    """(WARC headers, block) of each record in a stream of decompressed bytes."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8").partition(":")
            headers[k.strip().lower()] = v.strip()
        block = stream.read(int(headers.get("content-length", 0)))
        if len(block) < int(headers.get("content-length", 0)):
            raise ValueError("a WARC record ends early")
        yield headers, block


def _row(headers: dict, block: bytes) -> tuple:
    kind = headers["warc-type"]
    size = digest = payload = None
    fields = {}
    if kind in ("response", "revisit", "request"):
        http, _, body = block.partition(b"\r\n\r\n")
        for line in http.decode("latin-1").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        if kind == "response":
            size, digest, payload = len(body), hashlib.sha1(body).hexdigest(), body
        elif kind == "revisit":
            size = int(fields["content-length"]) if "content-length" in fields else None
    elif kind == "metadata":
        for line in block.decode("utf-8").split("\r\n"):
            k, _, v = line.partition(":")
            if k.strip():
                fields[k.strip().lower()] = v.strip()
    stated = headers.get("warc-payload-digest", "")
    if stated.startswith("sha1:"):
        stated = base64.b32decode(stated[5:]).hex()
        if digest is not None and digest != stated:
            raise ValueError(f"payload digest of {headers['warc-record-id']} does not match")
        digest = stated
    return (headers["warc-record-id"], kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
            headers.get("warc-target-uri"), headers.get("warc-date"), size, digest, fields, payload)


def read_records(manifest: DataFrame, with_payload: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """All records of the archives in a manifest (folder, name), one task per file."""

    def read(batches):
        import pandas as pd
        names = [f.name for f in RECORD]
        for files in batches:
            for folder, name in zip(files["folder"], files["name"]):
                fs, path = store(folder)
                with fs.open_input_stream(f"{path}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as f:
                    rows, size = [], 0
                    for headers, block in _records(f):
                        row = _row(headers, block)
                        rows.append(row if with_payload else (*row[:-1], None))
                        size += len(block) + 500
                        if size > batch_bytes:
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    n = max(1, manifest.count())
    return manifest.select("folder", "name").repartition(n).mapInPandas(read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (record_id, response, request, metadata).

    ``response`` is the response or revisit record; ``request`` and ``metadata`` are the
    records concurrent to it (the first by record id, null where there is none)."""
    names = [f.name for f in RECORD if f.name != "record_id"]
    whole = F.struct("record_id", *names)
    answers = records.filter(F.col("type").isin("response", "revisit")).select(
        "record_id", whole.alias("response"))

    def beside(kind: str) -> DataFrame:
        slim = F.struct("record_id", "type", "uri", "date", "fields")
        return (records.filter((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
                .groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min_by(slim, "record_id").alias(kind)))

    return (answers.join(beside("request"), "record_id", "left")
            .join(beside("metadata"), "record_id", "left"))


def page_of(record_id):
    """The row id in a record id that ``write_archives`` made (null otherwise)."""
    return F.regexp_extract(record_id, _URN.pattern, 1).try_cast("long")
