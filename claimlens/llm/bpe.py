"""BPE by dynamic programming over prefixes.

For every prefix of a word exactly one token can end its encoding. Candidates are the
tokens that are a suffix of the prefix; a matching automaton over the vocabulary (a
trie with suffix links) names them all in one pass over the word. A candidate t that
starts where another prefix ends is the last token iff it is compatible with that
prefix's own last token: no merge across their boundary comes before both are
complete. Back-pointers from the whole word give the ids.

Compatibility walks the two tokens' edges forward in merge order: the right edge of
the left token and the left edge of the right token grow by their own merges, and the
pair is incompatible if a merge of the two current edge pieces is due before either
edge grows (the leftmost of equal merges goes first).

Around it stands what the tokenizer file declares: NFC, white space runs to one
space, lower case, the word pattern, byte letters, ``</w>`` at word ends. Strings of
special tokens in a text become their ids, as in the library.

Defined cases: null text is the empty text, with no ids and an empty decoding.
Repeated rows are each returned; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import worker_cache

_END = ""            # stands for the end-of-word mark inside the automaton
_SPACES = re.compile("[\t-\r \x85\xa0]+")
_NEVER = 1 << 60


def _byte_letters() -> list[str]:
    """The printable letter that byte-level BPE uses for each byte: printable Latin-1
    stands for itself, the rest follow from U+0100 on."""
    own = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _plain_pattern() -> re.Pattern:
    """The word pattern for texts below U+0250, with the letter and number classes spelt out."""
    def chars(kind):
        return "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == kind)
    letters, numbers = chars("L"), chars("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^ {letters}{numbers}]+")


class WordBPE:
    """Encoder and decoder for a word-level BPE file of the tokenizers library."""

    def __init__(self, path: str, keep: int = 1_000_000):
        import ahocorasick
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.vocab = model["model"]["vocab"]
        self.mark = model["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.name = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.rank, self.halves = {}, {}
        for r, m in enumerate(model["model"]["merges"]):
            a, b = (self.vocab[x] for x in (m if isinstance(m, list) else m.split(" ")))
            self.rank.setdefault((a, b), r)
            self.halves.setdefault(self.vocab[self.name[a] + self.name[b]], (a, b, r))
        self.library = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.fast = _plain_pattern()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.right, self.left, self.pairs, self.sound = {}, {}, {}, {}
        self.auto = ahocorasick.Automaton()
        for t, i in self.vocab.items():
            if i in self.special.values() or not self._is_sound(i):
                continue
            s = t[:-len(self.mark)] + _END if self.mark and t.endswith(self.mark) and t != self.mark else t
            self.auto.add_word(s, (i, len(s)))
        self.auto.make_automaton()
        self.keep, self.words = keep, {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(piece, rank at which it grows) along the right (1) or left (0) edge, from
        the single symbol to the whole token."""
        cache = self.right if side else self.left
        if token not in cache:
            out, grows, t = [], _NEVER, token
            while True:
                out.append((t, grows))
                if t not in self.halves:
                    break
                grows = self.halves[t][2]
                t = self.halves[t][side]
            cache[token] = out[::-1]
        return cache[token]

    def _apart(self, left: int, right: int, until: int) -> bool:
        """Whether the boundary between two tokens survives all merges below ``until``."""
        a, b = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            joint = self.rank.get((a[i][0], b[j][0]), _NEVER)
            grow_a, grow_b = a[i][1], b[j][1]
            if joint < until and joint < grow_a and joint <= grow_b:
                return False
            if grow_a == grow_b == _NEVER:
                return True
            if grow_a <= grow_b:
                i += 1
            else:
                j += 1

    def _is_sound(self, token: int) -> bool:
        """Whether the token encodes to itself."""
        if token not in self.sound:
            h = self.halves.get(token)
            self.sound[token] = h is None or (self._is_sound(h[0]) and self._is_sound(h[1])
                                              and self._apart(h[0], h[1], h[2]))
        return self.sound[token]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            ok = self.pairs[key] = self._apart(left, right, _NEVER)
        return ok

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word given in byte letters."""
        s = word + _END if self.mark else word
        n = len(s)
        last, at = [-1] * (n + 1), [0] * (n + 1)
        pairs = self.pairs
        for end, (token, length) in self.auto.iter(s):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                ok = pairs.get(before << 32 | token)
                if ok is None:
                    ok = self.compatible(before, token)
                if not ok:
                    continue
            last[end], at[end] = token, start
        if last[n] < 0:
            raise ValueError(f"no encoding for {word!r}")
        out = []
        while n:
            out.append(last[n])
            n = at[n]
        return out[::-1]

    def _split(self, text: str) -> list[str]:
        """The words of a text without special tokens, as the file's normalizer and
        pre-tokenizer give them (in plain letters where the text is plain Latin)."""
        if not text or ord(max(text)) < 0x250 and "İ" not in text:
            return self.fast.findall(_SPACES.sub(" ", text).lower())
        norm = self.library.normalizer.normalize_str(text)
        back = {c: b for b, c in enumerate(self.letters)}
        return [bytes(back[c] for c in w).decode("utf-8", "surrogateescape")
                for w, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]

    def encode_decode(self, text: str) -> tuple[bytes, str]:
        """(ids packed as little-endian uint32, decoded text)."""
        packed, names = [], []
        words = self.words
        for i, piece in enumerate(self.split_special.split(text) if "<|" in text else [text]):
            if i % 2:
                packed.append(np.array([self.special[piece]], "<u4").tobytes())
                names.append(piece)
                continue
            own = self._split(piece)
            for w in set(own).difference(words):
                ids = self.word_ids(w if w.isascii() and w.isprintable() else
                                    "".join([self.letters[b] for b in w.encode("utf-8", "surrogateescape")]))
                words[w] = (struct.pack(f"<{len(ids)}I", *ids), " ".join([self.name[t] for t in ids]))
            got = [words[w] for w in own]
            packed.append(b"".join([g[0] for g in got]))
            names.extend([g[1] for g in got])
        if len(words) > self.keep:
            words.clear()
        return b"".join(packed), " ".join(names)


def codec(path: str) -> WordBPE:
    """One codec per worker process."""
    state = worker_cache()
    if ("bpe", path) not in state:
        state["bpe", path] = WordBPE(path)
    return state["bpe", path]


def encode_decode(docs: DataFrame, text: str, path: str, with_outputs: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 (and, if asked, the ids and
    the decoded text) of a text column."""
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_outputs:
        fields += ", ids array<long>, decoded string"

    @F.pandas_udf(f"struct<{fields.replace(' ', ':').replace(',:', ',')}>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = codec(path)
        for s in series:
            rows = []
            for t in s:
                ids, decoded = bpe.encode_decode(t)
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                if with_outputs:
                    row += (np.frombuffer(ids, "<u4").astype(np.int64), decoded)
                rows.append(row)
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in fields.split(", ")])

    tmp = "__bpe"
    out = docs.withColumn(tmp, run(F.coalesce(F.col(text), F.lit(""))))
    return out.withColumns({f.split()[0]: F.col(f"{tmp}.{f.split()[0]}") for f in fields.split(", ")}).drop(tmp)
