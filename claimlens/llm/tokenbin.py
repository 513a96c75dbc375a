"""Token ids as flat unsigned integer files with 64-bit document offsets.

A token store is a folder of part files, in ascending order of the document key:

* ``.ids``  the ids of the part's documents, one after the other, little-endian
  uint16 where the vocabulary fits, else uint32;
* ``.off``  uint64 offsets into ``.ids``, one more than the part has documents;
* ``.key``  int64 document keys (the smallest int64 stands for null);

and a manifest table (one row per part: order, names, documents, tokens). A part's
base, the number of ids before it, is the prefix sum of the manifest's token counts,
so parts are written independently and read by memory map.

Defined cases: null text is the empty text; an empty document holds the end id only;
rows with the same key are ordered by text and each kept; null keys come first; an
empty table gives a store without parts; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.llm.common import cut_lineage, new_file, store, work_dir, worker_cache

NULL_KEY = -(1 << 63)
# A space with no white space beside it always opens a new piece of the byte-level
# pre-tokenizer, so a text may be encoded chunk by chunk between such spaces.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_SAFE = re.compile(r"\S(?:.*\S)?", re.S).fullmatch
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'"
_LONG = 64               # longer chunks are not kept


class ChunkEncoder:
    """The tokenizers library over whole texts, with the ids of frequent chunks kept."""

    def __init__(self, path: str, dtype: str, keep: int = 1_500_000):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.dtype, self.keep, self.known, self.marks = dtype, keep, {}, {}
        # the same tokenizer for chunks that are one piece already
        self.plain = Tokenizer.from_file(path)
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.size = np.zeros(self.tok.get_vocab_size(), dtype=np.int64)
        for name, i in self.tok.get_vocab().items():
            self.size[i] = len(name)

    def _pack(self, ids) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _encode(self, tok, chunks: list[str], into: dict, lead: str) -> None:
        """Encode chunks (each after ``lead``), many in one call of the library.

        A token stands for as many bytes as its name has letters, which tells where
        the ids of a chunk end."""
        width = np.dtype(self.dtype).itemsize
        for lo in range(0, len(chunks), 5_000):
            part = chunks[lo:lo + 5_000]
            ids = tok.encode_batch_fast([[lead + c for c in part]], is_pretokenized=True, add_special_tokens=False)[0].ids
            ids = np.array(ids, dtype=np.int64)
            ends = np.cumsum([len(lead) + (len(c) if c.isascii() else len(c.encode())) for c in part])
            at = np.searchsorted(np.cumsum(self.size[ids]), ends) + 1
            flat, begin = self._pack(ids), 0
            for c, end in zip(part, (at * width).tolist()):
                into[c] = flat[begin:end]
                begin = end

    def _learn(self, chunks: set) -> None:
        """Encode unknown chunks that follow a space. Letters and the marks after them
        are pieces of their own, so each is encoded once and then put together."""
        known, plain, other, made = self.known, {}, [], []
        for c in chunks:
            stem = c.rstrip(_MARKS)
            if not stem.isalpha():
                other.append(c)
                continue
            if stem not in known:
                plain[stem] = None
            if stem != c:
                made.append((c, stem, c[len(stem):]))
        marks = {m for _, _, m in made if m not in self.marks}
        self._encode(self.plain, list(plain), known, " ")
        self._encode(self.tok, list(marks), self.marks, "")
        self._encode(self.tok, other, known, " ")
        for c, stem, tail in made:
            known[c] = known[stem] + self.marks[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed."""
        if len(self.known) > self.keep:
            self.known.clear()
            self.marks.clear()
        known, cut, new, heads, odd = self.known, [], set(), {}, {}
        for t in texts:
            if any(s in t for s in self.special):      # the library finds special tokens itself
                cut.append(None)
                continue
            head, *rest = t.split(" ")
            got = list(map(known.get, rest))
            gaps = [i for i, g in enumerate(got) if g is None]
            miss = {rest[i] for i in gaps}
            if not all(map(_SAFE, miss)) or rest and not _SAFE(head):
                head, *rest = _CUT.split(t)            # white space runs: cut only at safe places
                rest = [c[1:] for c in rest]
                got = list(map(known.get, rest))
                gaps = [i for i, g in enumerate(got) if g is None]
                miss = {rest[i] for i in gaps}
                strange = {c for c in miss if len(c) > _LONG or not _SAFE(c)}
                odd.update(dict.fromkeys(strange))
                miss -= strange
            heads[head] = b""
            new |= miss
            cut.append((head, rest, got, gaps))
        self._learn(new)
        self._encode(self.tok, [h for h in heads if h], heads, "")
        self._encode(self.tok, list(odd), odd, " ")
        out = []
        for t, own in zip(texts, cut):
            if own is None:
                out.append(self._pack(self.tok.encode(t, add_special_tokens=False).ids))
                continue
            head, rest, got, gaps = own
            for i in gaps:
                c = rest[i]
                got[i] = odd[c] if c in odd else known[c]
            out.append(heads[head] + b"".join(got))
        return out


def encoder(path: str, dtype: str) -> ChunkEncoder:
    """One encoder per worker process."""
    state = worker_cache()
    if ("chunks", path, dtype) not in state:
        state["chunks", path, dtype] = ChunkEncoder(path, dtype)
    return state["chunks", path, dtype]


def id_dtype(path: str) -> str:
    from tokenizers import Tokenizer
    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def _blocks(texts: list[str], chars: int = 1_000_000):
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > chars:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if texts:
        yield lo, len(texts)


def write_store(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Encode ``docs`` into a token store under ``folder``; returns its manifest."""
    dtype = id_dtype(tokenizer)

    def write(batches):
        import pandas as pd
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer, dtype)
        end = np.array([end_id], dtype=dtype).tobytes()
        width = np.dtype(dtype).itemsize
        first = next(batches, None)
        if first is None:
            return
        docs_n = tokens = 0
        stem = f"part-{part:06d}"
        with new_file(folder, stem, ".ids") as (ids_name, ids), new_file(folder, stem, ".off") as (off_name, off), \
                new_file(folder, stem, ".key") as (key_name, keys):
            off.write(np.array([0], dtype="<u8").tobytes())
            pdf = first
            while pdf is not None:
                texts = pdf["t"].tolist()
                keys.write(pdf["k"].to_numpy(dtype="<i8").tobytes())
                for lo, hi in _blocks(texts):
                    packed = [p + end for p in enc.encode(texts[lo:hi])]
                    ends = tokens + np.cumsum([len(p) // width for p in packed])
                    ids.write(b"".join(packed))
                    off.write(ends.astype("<u8").tobytes())
                    tokens = int(ends[-1])
                docs_n += len(texts)
                pdf = next(batches, None)
        yield pd.DataFrame([(part, folder, ids_name, off_name, key_name, dtype, docs_n, tokens)],
                           columns=[f.name for f in _MANIFEST])

    ordered = (docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("k"),
                           F.coalesce(F.col(text), F.lit("")).alias("t"))
               .repartitionByRange("k").sortWithinPartitions("k", "t"))
    return cut_lineage(ordered.mapInPandas(write, _MANIFEST))


_MANIFEST = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("folder", T.StringType()),
    T.StructField("ids", T.StringType()), T.StructField("off", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("dtype", T.StringType()), T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType())])


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest (one row per part file) with ``base``, the ids before each part."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _mapped(folder: str, name: str, dtype: str):
    """A numpy view of a file: memory-mapped where the store is a mounted folder."""
    from pyarrow import fs as pafs
    fs, path = store(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        import os
        whole = f"{path}/{name}"
        return np.memmap(whole, dtype=dtype, mode="r") if os.path.getsize(whole) else np.zeros(0, dtype)
    with fs.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), dtype=dtype)


def read_store(manifest: DataFrame, with_ids: bool = False, batch: int = 2000) -> DataFrame:
    """One row per document: key, start, n_tokens, ids_crc32 and, if asked, the ids."""
    spark = manifest.sparkSession
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def read(batches):
        import pandas as pd
        for parts in batches:
            for p in parts.itertuples():
                ids, off = _mapped(p.folder, p.ids, p.dtype), _mapped(p.folder, p.off, "<u8").astype(np.int64)
                keys = _mapped(p.folder, p.key, "<i8")
                for lo in range(0, len(keys), batch):
                    hi = min(lo + batch, len(keys))
                    flat = np.asarray(ids[off[lo]:off[hi]]).astype("<u4")
                    at = off[lo:hi + 1] - off[lo]
                    own = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
                    out = {"doc_id": pd.array(keys[lo:hi], dtype="Int64"), "start": off[lo:hi] + p.base,
                           "n_tokens": np.diff(at), "ids_crc32": [zlib.crc32(x.tobytes()) for x in own]}
                    out["doc_id"][np.asarray(keys[lo:hi]) == NULL_KEY] = pd.NA
                    if with_ids:
                        out["ids"] = [x.astype(np.int64) for x in own]
                    yield pd.DataFrame(out)

    n = max(1, manifest.count())          # one task per part file
    return with_bases(manifest).repartition(n).mapInPandas(read, schema)


def token_store(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int,
                folder: str | None = None) -> DataFrame:
    """Write the store and read it back."""
    spark: SparkSession = docs.sparkSession
    return read_store(write_store(docs, key, text, tokenizer, end_id, folder or work_dir(spark, "tokens")))
