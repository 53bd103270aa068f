"""Repeats of a stated number of words, found by recompression and removed outside the first document that has them.

Rounds of recompression name the runs and the pairs of adjacent symbols of a text, starting from its words. A name is a
hash of what it stands for, so equal substrings get equal symbols in every document without a table of names, but for a
margin whose parsing depends on what lies outside. Each symbol therefore carries the span of words that fixes it. A
window of the stated length has for its seed the highest symbol whose span lies within it (of several, the one with the
smallest hash), or itself where there is none. Equal windows have equal seeds, so only windows whose seed occurs in two
documents can repeat; for these the hash of all their words decides, and the smallest key that has it.

Both questions (which seeds are shared; which is a window's smallest key) go from chunks of texts to ranges of hashes
and back, see ``ranges``. Null and empty texts have no words. Rows with a null key are left as they are and take part in
nothing. Rows with equal keys count as one document. Extra columns ride along and may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from chronocohort.llm import ranges
from chronocohort.llm.words import Words, mix, ngrams, powers, words

ROUNDS = 2
_PRIME = np.uint64(0xD6E8FEB86659FD93)


class Symbols:
    """One level of a parsed batch: names, word spans, and the spans that fix the names."""

    def __init__(self, name, start, end, low, high, text, edges):
        self.name, self.start, self.end, self.low, self.high, self.text = name, start, end, low, high, text
        self.edges = edges  # first word of each text, and one behind

    def neighbours(self):
        """The span of the symbol before and after each; beyond a text's edge one word outside of it."""
        same = self.text[1:] == self.text[:-1]
        before, after = self.edges[self.text] - 1, self.edges[self.text + 1] + 1
        before[1:][same] = self.low[:-1][same]
        after[:-1][same] = self.high[1:][same]
        return before, after, same


def runs(s: Symbols) -> Symbols:
    """Name each run of one symbol; that its neighbours differ is part of what fixes a symbol."""
    before, after, same = s.neighbours()
    head = np.ones(len(s.name), bool)
    head[1:] = ~(same & (s.name[1:] == s.name[:-1]))
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(head)) - 1
    size = (last - first + 1).astype(np.uint64)
    name = np.where(size > 1, mix(s.name[first] * _PRIME + size), s.name[first])
    low, high = np.minimum(s.low[first], before[first]), np.maximum(s.high[last], after[last])
    return Symbols(name, s.start[first], s.end[last], low, high, s.text[first], s.edges)


def pairs(s: Symbols, level: int) -> Symbols:
    """Name each adjacent pair of a left and a right symbol; which side a symbol is on, its hash says."""
    before, after, same = s.neighbours()
    right = (mix(s.name + np.uint64(level)) & np.uint64(1)).astype(bool)
    opens = np.zeros(len(right), bool)
    opens[:-1] = same & ~right[:-1] & right[1:]
    closes = np.zeros(len(right), bool)
    closes[1:] = opens[:-1]
    first = np.flatnonzero(~closes)
    paired = opens[first]
    last = first + paired
    name = np.where(paired, mix(s.name[first] * _PRIME + mix(s.name[last] + np.uint64(level))), s.name[first])
    # A lone left symbol was fixed by the one after it, a lone right symbol by the one before.
    low = np.where(~paired & right[first], np.minimum(s.low[first], before[first]), s.low[first])
    high = np.where(~paired & ~right[first], np.maximum(s.high[last], after[last]), s.high[last])
    return Symbols(name, s.start[first], s.end[last], low, high, s.text[first], s.edges)


def levels(w: Words, rounds: int = ROUNDS) -> list[Symbols]:
    """The symbols after each round, from the words of a batch of texts."""
    at = np.arange(len(w))
    s = Symbols(w.hash, at, at + 1, at, at + 1, w.text_of_word(), w.first)
    out = []
    for level in range(1, rounds + 1):
        s = pairs(runs(s), level)
        out.append(s)
    return out


def seeds(w: Words, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Word positions where a window starts, and the seed of each window."""
    starts = np.flatnonzero(w.left() >= window)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    inverse = powers(len(w) + 1, True)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * powers(len(w)))])
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(len(w), none)
    for level, s in reversed(list(enumerate(levels(w, rounds), 1))):
        inside = (s.high - s.low <= window) & (s.low >= w.first[s.text]) & (s.high <= w.first[s.text + 1])
        if level < rounds:  # only windows without a higher symbol look further down
            open_ = np.zeros(len(w) + 1, np.int64)
            open_[starts + 1] = best[starts] == none
            if not open_.any():
                break
            open_ = np.cumsum(open_)
            inside &= open_[np.minimum(s.low + 1, len(w))] > open_[np.maximum(s.high - window, 0)]
        low, high, name = s.low[inside], s.high[inside], s.name[inside]
        fixed = mix((total[high] - total[low]) * inverse[low] ^ name)
        rank = (np.uint64(rounds - level) << np.uint64(60)) | (fixed >> np.uint64(4))
        first, places = high - window, low - high + window
        for k in range(int(places.max(initial=-1)) + 1):
            fits = (places >= k) & (first >= -k)
            np.minimum.at(best, first[fits] + k, rank[fits])
    found = best[starts]
    own = ngrams(w.hash, window)[starts] | (np.uint64(15) << np.uint64(60))
    # Ranks fill few of the top bits; mixed, seeds spread evenly over ranges of hashes.
    return starts, mix(np.where(found == none, own, found))


def _ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows by key with null keys last, the keys, and which are there."""
    table = table.sort_by([("key", "ascending")])
    there = ~np.asarray(pc.is_null(table.column("key")).combine_chunks())
    return table, np.asarray(pc.fill_null(table.column("key"), 0).combine_chunks()), there


def _least(tokens: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens, with their smallest and largest key. ``keys`` are in order."""
    order = np.argsort(tokens, kind="stable")
    tokens, keys = tokens[order], keys[order]
    head = np.ones(len(tokens), bool)
    head[1:] = tokens[1:] != tokens[:-1]
    first = np.flatnonzero(head)
    return tokens[first], keys[first], keys[np.append(first[1:], len(tokens)) - 1] if len(first) else keys[:0]


def dedup(
    df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13, rows_per_chunk: int = 1000, keep: list[str] | None = None
) -> DataFrame:
    """Columns key, n_words, n_removed, kept (the kept words joined by spaces; the text itself where nothing went), row.

    A word goes if some window over it also starts in a document with a smaller key. ``keep`` names input columns to
    carry in the struct ``row``.
    """
    chunks = ranges.chunk_count(df, rows_per_chunk)
    carried = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None).cast("struct<none:int>")
    texts = ranges.chunked(df.withColumn("__row", carried), key, text, chunks, "__row")
    row_type = texts.schema["row"].dataType.simpleString()

    def places(table: pa.Table):
        table, keys, there = _ordered(table)
        return table, keys, there, words(table.column("text"), lower=False)

    def ask_seeds(chunk: int, table: pa.Table) -> pa.Table:
        table, keys, there, w = places(table)
        starts, seed = seeds(w, window)
        text_of = w.text_of_word()[starts]
        new = there[text_of]
        new[1:] &= (seed[1:] != seed[:-1]) | (text_of[1:] != text_of[:-1])
        # The lowest bit says that two documents of this chunk have the seed.
        token, least, most = _least(seed[new] & ~np.uint64(1), keys[text_of[new]])
        return ranges.sent(chunk, token | (least != most).astype(np.uint64), [], chunks)

    def shared(tokens, owner, _):
        group = tokens >> np.uint64(1)
        order = np.argsort(group, kind="stable")
        ordered = group[order]
        head = np.ones(len(ordered), bool)
        head[1:] = ordered[1:] != ordered[:-1]
        number = np.cumsum(head) - 1
        many = np.bincount(number) > 1
        many |= np.bincount(number, weights=(tokens[order] & np.uint64(1)).astype(float)) > 0
        mask = np.zeros(len(tokens), bool)
        mask[order] = many[number]
        return mask, []

    def ask_windows(chunk: int, table: pa.Table, told) -> pa.Table:
        table, keys, there, w = places(table)
        starts, seed = seeds(w, window)
        text_of = w.text_of_word()[starts]
        known, _ = ranges.member(seed >> np.uint64(1), told[0] >> np.uint64(1))
        known &= there[text_of]
        token, least, _ = _least(ngrams(w.hash, window)[starts[known]], keys[text_of[known]])
        return ranges.sent(chunk, token, [least], chunks)

    def smallest(tokens, owner, columns):
        order = np.lexsort((columns[0], tokens))
        ordered, key_of = tokens[order], columns[0][order]
        head = np.ones(len(ordered), bool)
        head[1:] = ordered[1:] != ordered[:-1]
        least = key_of[np.flatnonzero(head)][np.cumsum(head) - 1] if len(ordered) else key_of
        back = np.empty(len(tokens), np.int64)
        back[order] = least
        return back < columns[0], [back]

    def cut(chunk: int, table: pa.Table, told) -> pa.Table:
        table, keys, there, w = places(table)
        starts = np.flatnonzero(w.left() >= window)
        text_of = w.text_of_word()
        starts = starts[there[text_of[starts]]]
        token, own = ngrams(w.hash, window)[starts], keys[text_of[starts]]
        distinct, least, _ = _least(token, own)
        known, at = ranges.member(distinct, told[0])
        least = np.where(known, np.minimum(least, told[1][at] if len(told[1]) else 0), least)
        repeated = starts[own > least[np.searchsorted(distinct, token)]] if len(token) else starts
        change = np.zeros(len(w) + 1, np.int64)
        np.add.at(change, repeated, 1)
        np.add.at(change, repeated + window, -1)
        stays = np.cumsum(change)[:-1] == 0
        total = np.concatenate([[0], np.cumsum(~stays)])
        removed = total[w.first[1:]] - total[w.first[:-1]]
        raw, kept = w.data.tobytes(), []
        whole = table.column("text")
        for i, gone in enumerate(removed):
            if not gone:
                kept.append(whole[i].as_py())
                continue
            left = np.flatnonzero(stays[w.first[i] : w.first[i + 1]]) + w.first[i]
            kept.append(b" ".join(raw[s:e] for s, e in zip(w.start[left], w.end[left])).decode())
        return pa.table(
            {
                "key": table.column("key"), "n_words": pa.array(np.diff(w.first), pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                "kept": pa.array(kept, pa.string()), "row": table.column("row"),
            }
        )

    told_seeds = ranges.answer_by_range(ranges.ask(texts, ask_seeds), ["<u8"], shared)
    sent = ranges.tell(texts, told_seeds, ask_windows, ["<u8"], ranges.SENT)
    told = ranges.answer_by_range(sent, ["<u8", "<i8"], smallest)
    return ranges.tell(texts, told, cut, ["<u8", "<i8"], f"key bigint, n_words bigint, n_removed bigint, kept string, row {row_type}")
