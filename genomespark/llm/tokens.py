"""Encoding of a corpus with a public byte-level BPE vocabulary.

Merging uses a segment tree over the byte positions of a word: a leaf holds the rank of the pair that begins there, an
inner node the smaller of its children (the left one if they tie), so the root is the leftmost pair of lowest rank.  A
merge changes at most three leaves, each in a logarithmic number of steps, so a word of ``n`` bytes takes
``n log n`` steps however long it is.

Words are first parted where no token of the vocabulary holds the two neighbouring bytes side by side: no merge can
reach over such a place.  Parts are looked up among those that were met before, and merged only when they are new.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the vocabulary files lie; a parameter of every function that reads one.
VOCABULARIES = "/opt/tokenizers"
#: How the text falls into words before merging; belongs to the public vocabulary (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a task remembers before it starts anew; bounds its memory, not what it encodes.
REMEMBERED = 300_000
_NONE = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: token bytes -> id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one word by merging the leftmost pair of lowest rank until none is left."""
    n = len(word)
    if n == 1 or word in ranks and n <= 2:
        return [ranks[word]] if word in ranks else [ranks[word[i : i + 1]] for i in range(n)]
    size = 1
    while size < n:
        size *= 2
    token = [word[i : i + 1] for i in range(n)]
    after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    # rank * span + position: the smallest is the leftmost of the lowest rank
    span = size
    none = _NONE * span
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = get(word[i : i + 2])
        if r is not None:
            tree[size + i] = r * span + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a <= b else b
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    while tree[1] < none:
        i = tree[1] % span
        j = after[i]
        token[i] += token[j]
        k = after[i] = after[j]
        if k < n:
            prior[k] = i
        if tree[size + j] != none:
            put(j, none)
        r = get(token[i] + token[k]) if k < n else None
        put(i, none if r is None else r * span + i)
        h = prior[i]
        if h >= 0:
            r = get(token[h] + token[i])
            put(h, none if r is None else r * span + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i]])
        i = after[i]
    return out


class _Words(dict):
    """Word -> token ids, worked out when first asked for."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.encoder.word(word)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


class Encoder:
    """Encodes texts by one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = WORDS) -> None:
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        side = np.zeros(65_536, dtype=bool)
        for t in ranks:
            if len(t) > 1:
                b = np.frombuffer(t, dtype=np.uint8).astype(np.int64)
                side[b[:-1] * 256 + b[1:]] = True
        self.side = side.tobytes()
        self.parts: dict[bytes, tuple[int, ...]] = {}
        self.words = _Words(self)

    def word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        side, parts = self.side, self.parts
        out: list[int] = []
        start, last = 0, len(raw)
        if whole is not None and last <= 2:
            return (whole,)
        for i in range(1, last + 1):
            if i == last or not side[raw[i - 1] << 8 | raw[i]]:
                part = raw[start:i]
                ids = parts.get(part)
                if ids is None:
                    ids = tuple(merge(part, self.ranks))
                    if len(parts) >= REMEMBERED:
                        parts.clear()
                    if len(part) <= 256:
                        parts[part] = ids
                out += ids
                start = i
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text without special tokens; null and empty texts give an empty list."""
        return list(chain.from_iterable(map(self.words.__getitem__, self.find(text)))) if text else []

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text begins and ends among them."""
        words, find = self.words.__getitem__, self.find
        parts, ends = [], [0]
        for text in texts:
            if text:
                ids = np.fromiter(chain.from_iterable(map(words, find(text))), dtype=np.int32)
                parts.append(ids)
                ends.append(ends[-1] + len(ids))
            else:
                ends.append(ends[-1])
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.array(ends, dtype=np.int32)


_ENCODERS: dict[int, Encoder] = {}


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k.tiktoken", directory: str = VOCABULARIES) -> DataFrame:
    """(key, ids): the token ids of every row's text.  One row per row; null and empty texts give an empty list.

    The vocabulary is read on the driver and broadcast (its size is that of a fixed public file, under 1 MB); each Python
    worker builds the encoder once.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(os.path.join(directory, vocabulary)))
    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    mark = hash((directory, vocabulary))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from genomespark.llm import tokens

        encoder = tokens._ENCODERS.get(mark) or tokens._ENCODERS.setdefault(mark, tokens.Encoder(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # lists of one piece stay small
                piece = batch.slice(at, 500)
                ids, ends = encoder.encode_many(piece.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                yield pa.RecordBatch.from_arrays([piece.column(0), lists], names=[key, "ids"])

    return df.select(key, text).mapInArrow(work, schema)
