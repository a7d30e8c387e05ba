"""Evaluation texts leaking into training text.

The n-grams of the evaluation items (a fixed, size-checked set) are broadcast; every training text is cut
into words and its windows are looked up by hash, then verified word by word. If the items have more
n-grams than may be broadcast, windows and n-grams meet in a join by hash instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import word_spans, words

#: Consecutive words in common that make a leak.
N = 12
#: N-grams up to which the items are broadcast (about 200 bytes each).
BROADCAST_GRAMS = 1_000_000

_P = np.uint64(0x100000001B3)


class GramSet:
    """N-grams of items over a private vocabulary, searched by rolling hash and verified by words."""

    def __init__(self, items: list[tuple[int, str]], n: int = N) -> None:
        self.n, self.vocabulary, self.grams = n, {}, {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text or "")]
            for i in range(len(ids) - n + 1):
                self.grams.setdefault(tuple(ids[i : i + n]), set()).add(item)
        keys = np.array(list(self.grams), dtype=np.int64).reshape(-1, n)
        self.hashes = np.sort(self._hash(keys)) if len(keys) else np.zeros(0, np.uint64)

    def _hash(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), dtype=np.uint64)
        for k in range(self.n):
            out = (out ^ (ids[:, k].astype(np.uint64) + np.uint64(1))) * _P
            out ^= out >> np.uint64(29)
        return out

    def find(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """(item, first word, last word) of the windows of a text that an item has, runs joined."""
        n, get = self.n, self.vocabulary.get
        if len(tokens) < n or not len(self.hashes):
            return []
        ids = np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        starts = np.flatnonzero(known[n:] - known[:-n] == n)  # windows of words that items have
        if not len(starts):
            return []
        hashed = self._hash(np.lib.stride_tricks.sliding_window_view(ids, n)[starts])
        at = np.searchsorted(self.hashes, hashed)
        near = self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashed
        found: dict[int, list[list[int]]] = {}
        for s in starts[near].tolist():
            for item in self.grams.get(tuple(ids[s : s + n].tolist()), ()):
                runs = found.setdefault(item, [])
                if runs and runs[-1][1] + 1 >= s:
                    runs[-1][1] = s + n - 1
                else:
                    runs.append([s, s + n - 1])
        return [(i, a, b) for i, runs in found.items() for a, b in runs]


def _held(items: DataFrame, n: int):
    """The items' n-grams as a broadcast set, or None if there are too many; and the items with an id and a text."""
    source = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text")
    size = source.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first()["c"]
    if size // 2 > BROADCAST_GRAMS:  # a word and a separator need two characters at least
        return None, source
    return items.sparkSession.sparkContext.broadcast(GramSet([(r["item_id"], r["text"]) for r in source.collect()], n)), source


def leaks(documents: DataFrame, items: DataFrame, n: int = N, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, first_word, last_word): runs of at least ``n`` consecutive words that stand in the item too.

    Null or short texts on either side leak nothing. A document with several runs of an item has a row for each. How many n-grams
    the items have only decides how they meet the windows, not what comes out.
    """
    held, source = _held(items, n)
    if held is None:
        return _joined_leaks(documents, source, n, id_column)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = held.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.extend((doc, *hit) for hit in grams.find(words(text)))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], batch.column(0).type), pa.array(cols[1]), *(pa.array(c, pa.int64()) for c in cols[2:])],
                    names=["doc_id", "item_id", "first_word", "last_word"],
                )

    texts = documents.where(F.col("text").isNotNull()).select(id_column, "text")
    kind, item_kind = texts.schema[id_column].dataType.simpleString(), source.schema["item_id"].dataType.simpleString()
    return texts.mapInArrow(scan, f"doc_id {kind}, item_id {item_kind}, first_word bigint, last_word bigint")


def _windows(n: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                if len(w) >= n:
                    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc] * len(grams), batch.column(0).type),
                            pa.array(range(len(grams)), pa.int64()),
                            pa.array(grams),
                        ],
                        names=["id", "at", "gram"],
                    )

    return cut


def _joined_leaks(documents: DataFrame, source: DataFrame, n: int, id_column: str) -> DataFrame:
    """The same by a join on the n-grams (adaptive execution splits those that many texts have); neighbouring windows of a document are then joined to runs."""
    texts = documents.where(F.col("text").isNotNull()).select(id_column, "text")
    kind, item_kind = texts.schema[id_column].dataType.simpleString(), source.schema["item_id"].dataType.simpleString()
    left = texts.mapInArrow(_windows(n), f"id {kind}, at bigint, gram string")
    right = source.mapInArrow(_windows(n), f"id {item_kind}, at bigint, gram string")
    right = right.select(F.col("id").alias("item_id"), "gram").distinct()
    hit = left.join(right, "gram").select("id", "item_id", "at")
    line = Window.partitionBy("id", "item_id").orderBy("at")
    opens = F.coalesce((F.col("at") - F.lag("at").over(line) > n).cast("int"), F.lit(1))
    runs = hit.withColumn("opens", opens).withColumn("run", F.sum("opens").over(line)).groupBy("id", "item_id", "run").agg(
        F.min("at").alias("first_word"), (F.max("at") + (n - 1)).alias("last_word")
    )
    return runs.select(F.col("id").alias("doc_id"), "item_id", "first_word", "last_word")


def leaked_items(documents: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, item_id), each pair once."""
    return leaks(documents, items, n).select("doc_id", "item_id").distinct()


def cut_words(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the words of the runs: from the first character of a run's first word to the last of its last word."""
    at, kept, pos = word_spans(text), [], 0
    for first, last in sorted(runs):
        kept.append(text[pos : max(pos, at[first][0])])
        pos = max(pos, at[last][1])
    return "".join(kept) + text[pos:]


def without_leaks(documents: DataFrame, items: DataFrame, n: int = N, whole_documents: bool = False) -> DataFrame:
    """The documents with the leaked words cut out (or without the documents that have any); all other characters stay as they are.

    The items' n-grams at hand, leaks are cut where they are found: documents are read once, and no text is shuffled.
    """
    held, source = _held(items, n)
    if held is None:
        runs = _joined_leaks(documents, source, n, "doc_id")
        if whole_documents:
            return documents.join(runs.select("doc_id").distinct(), "doc_id", "left_anti")
        cuts = runs.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set(F.struct("first_word", "last_word")).alias("__cuts"))

        @F.pandas_udf("string")
        def rest(text, cuts):
            import pandas as pd

            return pd.Series([cut_words(t, [(r["first_word"], r["last_word"]) for r in c]) for t, c in zip(text, cuts)])

        joined = documents.join(cuts, F.col("doc_id") == F.col("__doc"), "left")
        hit = joined.where("__doc IS NOT NULL").withColumn("text", rest("text", "__cuts")).drop("__doc", "__cuts")
        return joined.where("__doc IS NULL").drop("__doc", "__cuts").unionByName(hit)
    place = documents.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = held.value
        for batch in batches:
            texts = batch.column(place).to_pylist()
            found = [[(a, b) for _, a, b in grams.find(words(t))] if t else [] for t in texts]
            if whole_documents:
                yield batch.filter(pa.array([not f for f in found]))
                continue
            if any(found):
                texts = [cut_words(t, f) if f else t for t, f in zip(texts, found)]
                batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.column(place).type))
            yield batch

    return documents.mapInArrow(clean, documents.schema)
