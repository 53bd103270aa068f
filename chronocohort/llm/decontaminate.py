"""Benchmark decontamination: n-gram seeds find test items in documents, Smith-Waterman alignment scores them.

Test items are taken in blocks of a stated number of rows; each block passes over all documents once. Every n-gram of
an item is a seed, however often it occurs, so copies and other leaks never hide an edited one. Hits of one item in one
document are gathered by diagonal. A passage reaches as far around its hits as gaps can lead within the threshold, so
it holds every sufficient alignment through them; where it shares too few words with the item to reach the threshold it
is left, and the others are aligned word by word: the score is the best local alignment over that of the whole item
with itself. An alignment without n words in a row in common is not found. No documents or hits are shuffled, only
results.

Words are letters, digits and non-ASCII characters, A-Z lower-cased. Null and empty texts match nothing, nor do items
with fewer words than a seed. Rows with a null key are aligned too. Repeated rows and items give one row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronocohort.llm.words import PUNCTUATION, ngrams, sliced, words

MATCH, MISMATCH, GAP = 2, -1, -1
FOUND = "key bigint, item bigint, score double, word_start bigint, word_end bigint"


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score, and the passage position behind its end (the first, of several)."""
    places = np.arange(len(passage) + 1) * -GAP
    row, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        step = np.maximum(row + GAP, 0)
        step[1:] = np.maximum(step[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(step + places) - places
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


class Items:
    """A block of test items: words, n-grams, and where each n-gram stands."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.ids, self.n = [r[0] for r in rows], n
        w = words(pa.array([r[1] for r in rows], pa.string()), PUNCTUATION)
        self.words = [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(rows))]
        inside = np.flatnonzero(w.left() >= n)
        gram, owner = ngrams(w.hash, n)[inside], w.text_of_word()[inside]
        order = np.argsort(gram, kind="stable")
        self.gram, self.owner, self.place = gram[order], owner[order], (inside - w.first[owner])[order]

    def hits(self, hashes: np.ndarray, usable: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Word positions and rows of this block's n-grams that meet there, about ``limit`` at a time; one position may meet several rows."""
        if not len(self.gram):
            return
        grams = ngrams(hashes, self.n)
        low = np.searchsorted(self.gram, grams)
        met = np.flatnonzero(usable & (self.gram[np.minimum(low, len(self.gram) - 1)] == grams))
        each = np.searchsorted(self.gram, grams[met], side="right") - low[met]
        part = np.cumsum(each) // limit
        for some in np.split(np.arange(len(met)), np.flatnonzero(part[1:] != part[:-1]) + 1) if len(met) else []:
            n, at = each[some], met[some]
            yield np.repeat(at, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at], n)


def _aligned(text_column, items: Items, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """Of a batch: text number, item number, score, first and last word of each passage that reaches the threshold."""
    w = words(text_column, PUNCTUATION)
    need = np.array([threshold * len(own) for own in items.words])
    # Each gap costs a point, and what is left of the points of all matches must reach the threshold.
    reach = np.array([int(max(0.0, MATCH * len(own) * (1 - threshold)) / -GAP) for own in items.words], np.int64)
    for position, row in items.hits(w.hash, w.left() >= items.n):
        text = np.searchsorted(w.first, position, side="right") - 1
        item, diagonal = items.owner[row], position - items.place[row]
        order = np.lexsort((diagonal, item, text))
        text, item, diagonal = text[order], item[order], diagonal[order]
        head = np.ones(len(text), bool)
        head[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > reach[item[1:]])
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(head)) - 1
        for a, b in zip(first, last):
            own, slack = items.words[item[a]], int(reach[item[a]])
            low = max(int(w.first[text[a]]), int(diagonal[a]) - slack)
            high = min(int(w.first[text[a] + 1]), int(diagonal[b]) + len(own) + slack)
            passage = w.hash[low:high]
            # No alignment has more matches than the item has words that the passage holds.
            if np.isin(own, passage).sum() < need[item[a]] - 1e-9:
                continue
            best, end = align(own, passage)
            score = best / (MATCH * len(own))
            if score >= threshold:
                back, length = align(own[::-1], passage[:end][::-1])
                start = low + end - length
                yield int(text[a]), int(item[a]), score, start - int(w.first[text[a]]), low + end - int(w.first[text[a]])


def matches(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = 3,
    threshold: float = 0.5, items_per_block: int = 5000,
) -> DataFrame:
    """One row per document and item that match: key, item, score, word_start, word_end (of the best passage)."""
    source = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    listed = items.select(F.col(f"`{item_key}`").cast("bigint").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text")).where("item is not null and text is not null")
    blocks = max(1, -(-listed.count() // items_per_block))
    found = None
    for k in range(blocks):
        block = Items(sorted(map(tuple, listed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).distinct().collect())), n)

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 1):
                rows = list(_aligned(batch.column(1), block, threshold))
                pick = lambda i, kind: pa.array([r[i] for r in rows], kind)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick(0, pa.int64())), pa.array([block.ids[r[1]] for r in rows], pa.int64()), pick(2, pa.float64()), pick(3, pa.int64()), pick(4, pa.int64())],
                    names=["key", "item", "score", "word_start", "word_end"],
                )

        part = source.mapInArrow(search, FOUND)
        found = part if found is None else found.union(part)
    best = found.groupBy("key", "item").agg(F.max(F.struct("score", -F.col("word_start"), -F.col("word_end"))).alias("best"))
    return best.select("key", "item", "best.score", (-F.col("best.col2")).alias("word_start"), (-F.col("best.col3")).alias("word_end"))
