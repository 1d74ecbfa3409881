"""Passages of evaluation items in a corpus, by a distributed positional inverted index.

The index holds postings (term, document, position) of the evaluation items' terms.  A posting can belong to a shared
passage of ``least`` words only if it lies in an unbroken stretch of ``least`` terms of the items in which each
neighbouring pair also stands side by side in some item, so only such stretches are indexed: an exact restriction that
keeps the index as small as what may match.  For every window of ``least`` words of an item its rarest term, by the
counts of the index, is the anchor.  The postings of anchors give offsets between document and item; the other terms'
postings are intersected at these offsets.  Runs of consecutive hits are the shared passages; ``least`` hits within
``span`` words, in order but with other words between, are proximity matches.  A stretch with so many hits lacks at most
``span - least`` of its words, so one of its ``span - least + 1`` rarest terms is among the hits: these are its anchors.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genomespark.runtime import counted_cut, cut

LEAST = 20
#: Words of an item within which ``LEAST`` must match at one offset, for a proximity match.
SPAN = 25
#: Positions of a block in which offsets and postings meet.
BLOCK = 128
#: Terms and neighbouring pairs of the items that a worker holds; items beyond it are worked in several rounds.
TERMS_AT_ONCE = 2_000_000

# Han and Kana, the letters that are words by themselves (fixed values: blocks of the Unicode standard)
_SINGLE = "々-〇〡-〩〸-〻ぁ-ゖゝ-ゟァ-ヺー-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U0001b000-\U0001b16f\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_SINGLE}]|[^\W_{_SINGLE}]+")
_BROKEN = re.compile("[-‐](?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])")


def _ranges(category: str) -> str:
    """The inside of a character class with all letters of a Unicode category, as ranges."""
    out, run = [], []
    for c in range(0x110001):
        if c < 0x110000 and unicodedata.category(chr(c)) == category:
            run = [run[0] if run else c, c]
        elif run:
            out.append(f"\\U{run[0]:08x}-\\U{run[1]:08x}")
            run = []
    return "".join(out)


_FORMAT = re.compile(f"[{_ranges('Cf')}]")


def words(text: str | None) -> list[str]:
    """The words of a text: NFKC, lower case, without format characters and hyphens at line breaks."""
    if not text:
        return []
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFKC", text).lower())
    else:
        text = text.lower()
    return _WORD.findall(_BROKEN.sub("", text))


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, at, term): the words of each item in order; items with null keys or texts give none."""
    schema = T.StructType([T.StructField("item", items.schema[key].dataType), T.StructField("words", T.ArrayType(T.StringType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["item", "words"])

    return items.where(F.col(key).isNotNull()).select(key, text).mapInArrow(work, schema).select("item", F.posexplode("words").alias("at", "word"))


def postings(docs: DataFrame, key: str, text: str, vocabulary: list[str], pairs: np.ndarray, least: int, span: int) -> DataFrame:
    """(doc, pos, term) of all terms in stretches that may hold a match.

    Where all of a stretch must match, each neighbouring pair is one of some item.  Where ``span - least`` words of ``span``
    may differ, each of these breaks two pairs at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, pairs))
    schema = T.StructType([T.StructField("doc", docs.schema[key].dataType), T.StructField("pos", T.IntegerType()), T.StructField("term", T.IntegerType())])

    def stretches(ok: np.ndarray, length: int) -> list[tuple[int, int]]:
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.astype(np.int8), [0]))))
        return [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= length]

    def full(count: np.ndarray, width: int, need: int) -> np.ndarray:
        """Which places lie in some stretch of ``width`` (or all there are) with ``need`` marks."""
        width = min(width, len(count))
        sums = np.concatenate(([0], np.cumsum(count)))
        starts = np.flatnonzero(sums[width:] - sums[:-width] >= need)
        edge = np.zeros(len(count) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + width, -1)
        return np.cumsum(edge[:-1]) > 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = shared.value
        number = {w: i for i, w in enumerate(names)}
        get, size = number.get, len(names)
        for batch in batches:
            rows, at, terms = [], [], []
            for row, body in enumerate(batch.column(1).to_pylist()):
                found = [-1 if (n := get(w)) is None else n for w in words(body)]
                if len(found) < least:
                    continue
                ids = np.array(found, dtype=np.int64)
                if span > least:
                    if not full(ids >= 0, span, least).any():
                        continue
                    key2 = ids[:-1] * size + ids[1:]
                    where = np.minimum(np.searchsorted(known, key2), len(known) - 1)
                    near = full((ids[:-1] >= 0) & (ids[1:] >= 0) & (known[where] == key2), span - 1, max(1, 2 * least - span - 1))
                    keep = np.flatnonzero((ids >= 0) & (np.append(near, False) | np.append(False, near)))
                    rows.append(np.full(len(keep), row))
                    at.append(keep)
                    terms.append(ids[keep])
                    continue
                for a, b in stretches(ids >= 0, least):
                    part = ids[a:b]
                    key2 = part[:-1] * size + part[1:]
                    where = np.minimum(np.searchsorted(known, key2), len(known) - 1)
                    for c, d in stretches(known[where] == key2, least - 1) if least > 1 else [(0, b - a - 1)]:
                        rows.append(np.full(d - c + 1, row))
                        at.append(np.arange(a + c, a + d + 1))
                        terms.append(part[c : d + 1])
            if rows:
                keys = batch.column(0).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(terms).astype(np.int32))], names=["doc", "pos", "term"])

    return docs.select(key, text).mapInArrow(work, schema)


def _rounds(items_words: DataFrame, n_words: int) -> list[DataFrame]:
    """The items in rounds of about TERMS_AT_ONCE words."""
    if n_words <= TERMS_AT_ONCE:
        return [items_words]
    n = -(-2 * n_words // TERMS_AT_ONCE)
    return [items_words.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i) for i in range(n)]


def _matches(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str, least: int, span: int, close) -> DataFrame:
    items_words, n_words = counted_cut(item_terms(items, item_key, text))
    found = None
    for part in _rounds(items_words, n_words):
        hits = _hits(docs, part, doc_key, text, least, span)
        one = close(hits)
        found = one if found is None else found.unionByName(one)
    return found.withColumnsRenamed({"doc": doc_key, "item": item_key})


def shared_passages(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc, item, longest, n_words): documents and items that share at least ``least`` consecutive words.

    ``longest`` is the longest shared run, ``n_words`` the number of the item's words that the runs cover.  Items of
    fewer words, null and empty texts match nothing; copies of documents and items each give their rows.  The items'
    vocabulary goes to the workers; items are worked in rounds of about ``TERMS_AT_ONCE`` words, so its size is bounded.
    """

    def close(hits: DataFrame) -> DataFrame:
        order = Window.partitionBy("doc", "item", "shift").orderBy("at")
        runs = hits.withColumn("_run", F.col("at") - F.row_number().over(order)).groupBy("doc", "item", "shift", "_run").agg(F.count("*").cast("int").alias("n"), F.min("at").alias("from"))
        long = runs.where(F.col("n") >= least)
        return long.groupBy("doc", "item").agg(F.max("n").alias("longest"), F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("from", F.col("from") + F.col("n") - 1))))).alias("n_words"))

    return _matches(docs, items, doc_key, item_key, text, least, least, close)


def proximity_matches(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", least: int = LEAST, span: int = SPAN) -> DataFrame:
    """(doc, item, n_near): documents in which, at one offset, at least ``least`` of some ``span`` consecutive words of an
    item stand; up to ``span - least`` of them may be other words.

    ``n_near`` is the largest number of the words of a stretch of ``span`` that match.  All exact passages of ``least``
    words are among the matches.  Null, empty and short texts, and copies, as in :func:`shared_passages`.
    """

    def close(hits: DataFrame) -> DataFrame:
        near = Window.partitionBy("doc", "item", "shift").orderBy("at").rangeBetween(0, span - 1)
        return hits.select("doc", "item", F.count("*").over(near).cast("int").alias("n")).groupBy("doc", "item").agg(F.max("n").alias("n_near")).where(F.col("n_near") >= least)

    return _matches(docs, items, doc_key, item_key, text, least, span, close)


def _hits(docs: DataFrame, item_words: DataFrame, doc_key: str, text: str, least: int, span: int) -> DataFrame:
    """(doc, item, shift, at): the words of items that stand in documents at the offsets that an anchor gives."""
    spark = docs.sparkSession
    listed = item_words.toPandas().sort_values(["item", "at"])  # about TERMS_AT_ONCE words
    vocabulary = sorted(set(listed["word"]))
    number = {w: i for i, w in enumerate(vocabulary)}
    listed["term"] = np.array([number[w] for w in listed["word"]], dtype=np.int32) if len(listed) else np.zeros(0, np.int32)
    same = (listed["item"].to_numpy()[1:] == listed["item"].to_numpy()[:-1]) if len(listed) else np.zeros(0, bool)
    terms = listed["term"].to_numpy().astype(np.int64)
    pairs = np.unique((terms[:-1] * len(vocabulary) + terms[1:])[same]) if len(listed) else np.zeros(0, np.int64)
    schema = T.StructType([item_words.schema["item"], T.StructField("at", T.IntegerType()), T.StructField("term", T.IntegerType())])
    wanted = spark.createDataFrame(listed[["item", "at", "term"]], schema)
    if not len(pairs):
        return docs.where("false").select(F.col(doc_key).alias("doc"), F.lit(None).cast(schema["item"].dataType).alias("item"), F.lit(0).alias("shift"), F.lit(0).alias("at"))

    index = cut(postings(docs, doc_key, text, vocabulary, pairs, least, span))
    seen = index.groupBy("term").agg(F.count("*").alias("seen"))
    window = Window.partitionBy("item").orderBy("at").rowsBetween(0, span - 1)
    counted = wanted.join(F.broadcast(seen), "term", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    stretch = counted.withColumn("_terms", F.array_sort(F.collect_list(F.struct("seen", "at", "term")).over(window)))
    size = F.size("_terms")
    whole = stretch.where((size == span) | ((F.col("at") == 0) & (size >= least)))
    rare = whole.select("item", F.explode(F.slice("_terms", F.lit(1), size - least + 1)).alias("r"))
    anchors = rare.where("r.seen > 0").select("item", "r.at", "r.term").distinct()
    # a table of items is about TERMS_AT_ONCE rows of three numbers
    offsets = index.join(F.broadcast(anchors), "term").select("doc", "item", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    # offsets meet the index in blocks of positions: a long document is no hot key, and each block holds few postings
    length = wanted.groupBy("item").agg(F.max("at").alias("last"))
    spread = offsets.join(F.broadcast(length), "item").withColumn("block", F.explode(F.sequence(F.floor(F.greatest("shift", F.lit(0)) / BLOCK), F.floor((F.col("shift") + F.col("last")) / BLOCK))))
    placed = index.withColumn("block", F.floor(F.col("pos") / BLOCK))
    hits = placed.join(spread.drop("last"), ["doc", "block"]).select("doc", "item", "shift", "pos", "term", (F.col("pos") - F.col("shift")).alias("at"))
    return hits.join(F.broadcast(wanted), ["item", "at", "term"]).select("doc", "item", "shift", "at")
