"""Byte-level BPE: exact ids by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: how byte-level vocabularies part a text into words before merging.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A blank before something that is none always begins a word.
BLANKS = re.compile(r" (?=\S)")
#: Words of a generation whose ids a worker remembers, and their most characters.
KNOWN, KNOWN_CHARS = 300_000, 48
#: Bytes of text after which a worker hands on what it has.
CHUNK = 1 << 22
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Bpe:
    """A byte-level BPE vocabulary, read from the JSON of the tokenizers library.

    The last token of a prefix's encoding is unique, and dropping it leaves the encoding of a shorter prefix. So one table
    over all prefixes is enough: of the tokens that end a prefix, which an automaton of all tokens reports, the last one is
    that which stands the test beside the last token of what is before it. Its cost is in proportion to the word.
    """

    def __init__(self, data: bytes):
        j = json.loads(data)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab, model = j["model"]["vocab"], j["model"]
        self.specials = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes_of = [b""] * size
        for s, k in vocab.items():
            self.bytes_of[k] = raw(s)
        for s, k in self.specials.items():
            self.bytes_of[k] = s.encode()
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int32)
        self.rank, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.merge: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            made = vocab[a + b]
            if self.rank[made] >= 0:
                raise ValueError(f"two merges make token {made}: its last token isn't unique")
            self.rank[made], self.left[made], self.right[made] = r, vocab[a], vocab[b]
            self.merge[vocab[a] << 32 | vocab[b]] = r
        self._pairs: dict[int, bool] = {}
        self.byte_ids, own = [-1] * 256, {}
        self.endings = ahocorasick.Automaton()
        for k in sorted(vocab.values(), key=self.rank.__getitem__):  # parts come before what they make
            a, b, r = self.left[k], self.right[k], self.rank[k]
            own[k] = len(self.bytes_of[k]) == 1 if r < 0 else own[a] and own[b] and self.meets(a, b, r)
            if r < 0 and own[k]:
                self.byte_ids[self.bytes_of[k][0]] = k
            elif own[k]:  # others are never the encoding of their own bytes, so they end no prefix
                self.endings.add_word(self.bytes_of[k].decode("latin-1"), (k, len(self.bytes_of[k])))
        self.endings.make_automaton()
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None

    def meets(self, a: int, b: int, limit: int = NEVER) -> bool:
        """Whether `a` and `b` stay apart when their bytes are merged together: no merge of rank below `limit` crosses.

        The merges that made both are undone, the latest first. At each step the pieces at the border could have been
        merged instead if that comes before the merge just undone; of equal merges the left one comes first.
        """
        while True:
            if self.merge.get(a << 32 | b, NEVER) < limit:
                return False
            if self.rank[a] > self.rank[b]:
                limit, a = self.rank[a], self.right[a]
            elif self.rank[b] >= 0:
                limit, b = self.rank[b] + 1, self.left[b]
            else:
                return True

    def word(self, data: bytes) -> list[int]:
        """Ids of one word: the unique last token of each prefix, then back from the end.

        The automaton reports the tokens of two and more bytes in the order of their ends. A prefix that none of them ends
        by the time it is asked for ends with the token of its last byte.
        """
        size, pairs, byte_ids = len(data), self._pairs, self.byte_ids
        last = np.full(size + 1, -1, np.int32) if size > 4096 else [-1] * (size + 1)
        for end, (t, n) in self.endings.iter(data.decode("latin-1")):
            i = end + 1
            if last[i] >= 0:
                continue
            if i == n:
                last[i] = t
                continue
            before = last[i - n]
            before = byte_ids[data[i - n - 1]] if before < 0 else int(before)
            key = before << 32 | t
            known = pairs.get(key)
            if known is None:
                if len(pairs) >= 4 * KNOWN:
                    pairs.clear()
                known = pairs[key] = self.meets(before, t)
            if known:
                last[i] = t
        out, i = [], size
        while i:
            t = int(last[i])
            t = byte_ids[data[i - 1]] if t < 0 else t
            out.append(t)
            i -= len(self.bytes_of[t])
        return out[::-1]

    def encode(self, text: str, specials: bool = True) -> list[int]:
        """Ids of a text. `specials`: strings of special tokens in it become these; else they are ordinary text."""
        if not specials or self.special is None:
            first, *rest = BLANKS.split(text)
            known = self.words()
            return [*known.parted(first), *itertools.chain.from_iterable(map(known.__getitem__, rest))]
        out, start = [], 0
        for m in self.special.finditer(text):
            out += self.encode(text[start : m.start()], False)
            out.append(self.specials[m[0]])
            start = m.end()
        return out + self.encode(text[start:], False)

    def words(self) -> Words:
        if not hasattr(self, "_words"):
            self._words = Words(self)
        return self._words

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Known(dict):
    """What `fresh` gave for texts met lately: two generations, of which the older goes when the newer is full."""

    def __init__(self):
        super().__init__()
        self.older: dict[str, tuple[int, ...]] = {}

    def fresh(self, text: str) -> tuple[int, ...]:
        raise NotImplementedError

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.older.get(text)
        if ids is None:
            ids = self.fresh(text)
        if len(text) <= KNOWN_CHARS:
            if len(self) >= KNOWN:
                self.older = dict(self)
                self.clear()
            self[text] = ids
        return ids


class Words(Known):
    """Ids of what follows a blank, which is taken with it; and of words without one, which are known by a line end before them."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def fresh(self, text: str) -> tuple[int, ...]:
        return tuple(self.bpe.word(text[1:].encode())) if text[0] == "\n" else self.parted(" " + text)

    def parted(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch of text, word by word."""
        words = [text] if text[:1] == " " and text.isascii() and text[1:].isalpha() else WORDS.findall(text)
        if len(words) == 1:
            return tuple(self.bpe.word(text.encode()))
        return tuple(itertools.chain.from_iterable(self[w[1:] if w[0] == " " and not w.isspace() else "\n" + w] for w in words))


_LOADED: dict[str, object] = {}


def loaded(kind: type, data: bytes) -> object:
    """One `kind` a worker process for each vocabulary."""
    key = f"{kind.__name__}:{hashlib.sha256(data).hexdigest()}"
    if key not in _LOADED:
        _LOADED[key] = kind(data)
    return _LOADED[key]


def vocabulary(df: DataFrame, path: str) -> Broadcast:
    """The bytes of a vocabulary file that the driver reads: a fixed size of one or two megabytes, whatever the corpus."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def byte_bpe() -> str:
    """Path of the byte-level vocabulary that is used unless another is named."""
    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(batch: pa.RecordBatch, text: int, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """A batch cut where its texts pass `most` bytes, so that results are handed on in bounded portions."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def encoded(docs: DataFrame, text: str = "text", path: str | None = None, specials: bool = True) -> DataFrame:
    """`docs` with token_ids (array of int): each whole text in the ids of the vocabulary at `path`.

    The ids are those of the tokenizers library without added special tokens; `specials` as in Bpe.encode. Null text and
    empty text have no ids. A column token_ids of `docs` is replaced; all others stay. No shuffle: each row by itself.
    """
    docs = docs.drop("token_ids")
    shared, at, names = vocabulary(docs, path or byte_bpe()), docs.columns.index(text), [*docs.columns, "token_ids"]
    schema = T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(Bpe, shared.value)
        for whole in batches:
            for batch in pieces(whole, at):
                ids = [np.array(bpe.encode(x, specials), np.int32) if x else _NONE for x in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, lists(ids)], names)

    return docs.mapInArrow(run, schema)


_NONE = np.zeros(0, np.int32)


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    """Arrays as one Arrow list column."""
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else _NONE))


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """`tokens` with decoded (string): the text of token_ids, special tokens as their strings; null ids: empty text."""
    tokens = tokens.drop("decoded")
    shared, at, names = vocabulary(tokens, path or byte_bpe()), tokens.columns.index("token_ids"), [*tokens.columns, "decoded"]
    schema = T.StructType([*tokens.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(Bpe, shared.value)
        for batch in batches:
            texts = [bpe.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else "" for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return tokens.mapInArrow(run, schema)
