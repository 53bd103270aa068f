"""Spelling variants of a corpus vocabulary by Bloom-guided neighbourhoods.

1. The vocabulary is counted from whole texts (combined before the shuffle, so a frequent word is one row per task).
2. Words are filed by length into blocked Bloom filters, a shard per length, long shards cut into slices of at most
   ``SLICE`` words. A filter is built where its slice's hashes meet. Filters are broadcast in passes of at most
   ``max_bytes`` each, so what a worker holds does not grow with the vocabulary; more words only mean more passes.
3. Each word probes its generated edits, as arithmetic on a rolling hash: one code point deleted (against the shard one
   shorter) and one replaced by a later letter of the vocabulary's alphabet (against its own shard). Each near pair is
   generated once, from its longer word or from the one with the earlier letter; insertions need no probe.
4. Only positives become strings; these meet the vocabulary in an exact join, which removes false positives. Words that
   are alone with their length probe nothing.
5. Forms are followed to their last by doubling: a form has at least ``ratio`` times the rows, so there is no circle.

Null texts have no words, a null key counts as an empty one, repeated rows count again. Very long runs are words like
any other; they are probed in pieces and meet few words of their length. An empty table has no words. Ties between near
words of equal count go to the smallest in code-point order. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronocohort.llm.components import stored
from chronocohort.llm.words import mix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "([A-Za-zÀ-ÿ]+)"

SLICE = 1 << 14
_WORDS_OF_BLOCK = 8
_BASE = np.uint64(0x9FB21C651E98DF25)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPREAD = np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFFFFF)


def vocabulary(df: DataFrame, key: str, text: str, damage: int | None = None, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """Columns word, n: the letter runs of all texts, lower-cased, and how often they occur.

    With ``damage`` a run whose checksum (of key and run) it divides loses one code point first.
    """
    runs = df.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(RUN), F.lit(1))).alias("run"))
    word = F.translate("run", UPPER, LOWER)
    rows = runs.select("key", word.alias("word")).where(F.length("word") >= least_length)
    if damage:
        h = F.crc32(F.encode(F.concat("key", F.lit(":"), "word"), "UTF-8"))
        at = (h % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        rows = rows.select(F.when(h % damage == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_length)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and where each starts (one more entry)."""
    texts = column.to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def powers(n: int) -> np.ndarray:
    table = np.full(n + 1, _BASE)
    table[0] = 1
    return np.multiply.accumulate(table)


def values(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(1))


def groups(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and code points (rows x length) of words of one length, at most about ``limit`` letters at a time."""
    points, first = letters(column)
    length = np.diff(first)
    for size in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == size)
        step = max(1, limit // int(size))
        for part in (rows[a : a + step] for a in range(0, len(rows), step)):
            yield part, points[first[part][:, None] + np.arange(size)]


class Shards:
    """Where a hash lies: slices per length, and in this pass the blocks of each slice (none if it is in another pass)."""

    def __init__(self, slices: dict[int, int]):
        self.slices = slices
        self.first: dict[int, np.ndarray] = {}
        self.blocks: dict[int, np.ndarray] = {}
        self.bits = np.zeros(0, np.uint64)

    def slice_of(self, length: int, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(40)) * np.uint64(self.slices[length]) >> np.uint64(24)).astype(np.int64)

    def load(self, rows: list[tuple[int, int, bytes]]) -> Shards:
        parts, at = [], 0
        for length, piece, raw in rows:
            own = np.frombuffer(raw, np.uint64)
            self.first.setdefault(length, np.zeros(self.slices[length], np.int64))[piece] = at
            self.blocks.setdefault(length, np.zeros(self.slices[length], np.uint64))[piece] = len(own) // _WORDS_OF_BLOCK
            parts.append(own)
            at += len(own)
        self.bits = np.concatenate(parts) if parts else self.bits
        return self

    def hit(self, length: int, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be words: a bit in each of the eight 64-bit words of one block, one after the other."""
        if length not in self.blocks:
            return np.zeros(0, np.int64)
        piece = self.slice_of(length, h) if self.slices[length] > 1 else 0
        blocks = self.blocks[length][piece]
        start = self.first[length][piece] + block_of(h, blocks) * _WORDS_OF_BLOCK
        places = h * _SPREAD
        live = np.flatnonzero(blocks > 0) if self.slices[length] > 1 else np.arange(len(h))
        for k in range(_WORDS_OF_BLOCK):
            bit = places[live] >> np.uint64(16 + 6 * k) & np.uint64(63)
            live = live[(self.bits[start[live] + k] >> bit & np.uint64(1)).astype(bool)]
        return live


def block_of(h: np.ndarray, blocks) -> np.ndarray:
    return ((h & _LOW) * blocks >> np.uint64(32)).astype(np.int64)


def bits_per_word(length: int) -> float:
    """More for longer words, as they generate more edits, and longer ones."""
    return 16 + 2 * max(0.0, np.log2(length / 16))


def filter_of(length: int, h: np.ndarray) -> bytes:
    """The blocked filter of one slice."""
    blocks = max(8, int(np.ceil(len(h) * bits_per_word(length) / 512)))
    bits = np.zeros(blocks * _WORDS_OF_BLOCK, np.uint64)
    start, places = block_of(h, np.uint64(blocks)) * _WORDS_OF_BLOCK, h * _SPREAD
    for k in range(_WORDS_OF_BLOCK):
        np.bitwise_or.at(bits, start + k, np.uint64(1) << (places >> np.uint64(16 + 6 * k) & np.uint64(63)))
    return bits.tobytes()


def filters(words: DataFrame, slices: dict[int, int]) -> DataFrame:
    """One row (length, piece, bits) per slice of a length."""
    shards = Shards(slices)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, points in groups(batch.column(0)):
                size = points.shape[1]
                h = mix((values(points) * powers(size)[:size]).sum(axis=1))
                columns = [np.full(len(h), size), shards.slice_of(size, h), h.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["length", "piece", "h"])

    def build(table: pa.Table) -> pa.Table:
        size = table.column("length")[0].as_py()
        bits = filter_of(size, table.column("h").to_numpy().view(np.uint64))
        return pa.table({"length": pa.array([size], pa.int64()), "piece": table.column("piece").slice(0, 1), "bits": pa.array([bits], pa.binary())})

    hashed = words.select("word").mapInArrow(hashes, "length bigint, piece bigint, h bigint")
    return hashed.groupBy("length", "piece").applyInArrow(build, "length bigint, piece bigint, bits binary")


def probes(points: np.ndarray, counts: dict[int, int], alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Edits of words of one length in turns: target length, hash, row, place, and the new letter (0: the place's letter goes)."""
    size = points.shape[1]
    value, power = values(points), powers(size)[:size]
    terms = value * power
    whole = terms.sum(axis=1)
    if counts.get(size - 1, 0) > 0:
        new = np.ones(points.shape, bool)
        new[:, 1:] = points[:, 1:] != points[:, :-1]  # letters of one run go one for all
        row, place = np.nonzero(new)
        before = np.cumsum(terms, axis=1)
        h = before[row, place] - terms[row, place] + (whole[row] - before[row, place]) * _BACK
        yield size - 1, mix(h), row, place, 0
    if counts.get(size, 0) > 1:
        for letter in alphabet:
            row, place = np.nonzero(points < letter)
            if len(row):
                h = whole[row] + (values(np.array([letter]))[0] - value[row, place]) * power[place]
                yield size, mix(h), row, place, int(letter)


def candidates(words: DataFrame, shards: Shards, counts: dict[int, int], alphabet: np.ndarray) -> DataFrame:
    """Columns word, n, other: edits of each word that the broadcast filters do not rule out."""
    held = words.sparkSession.sparkContext.broadcast(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed = held.value
        for batch in batches:
            texts, n = batch.column(0).to_pylist(), batch.column(1)
            for rows, points in groups(batch.column(0)):
                found, other = [], []
                for size, h, row, place, letter in probes(points, counts, alphabet):
                    for hit in filed.hit(size, h):
                        word, at = texts[rows[row[hit]]], place[hit]
                        found.append(rows[row[hit]])
                        other.append(word[:at] + (chr(letter) if letter else "") + word[at + 1 :])
                if found:
                    index = pa.array(found, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(index), n.take(index), pa.array(other, pa.string())], names=["word", "n", "other"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, other string")


def passes(sizes: DataFrame, max_bytes: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """First and last slice (length, piece) of each pass: at most ``max_bytes`` of filters, one slice at least."""
    out, held = [], 0
    for row in sizes.orderBy("length", "piece").collect():  # one short row per slice
        at = (row["length"], row["piece"])
        if not out or held + row["size"] > max_bytes:
            out.append((at, at))
            held = 0
        out[-1] = (out[-1][0], at)
        held += row["size"]
    return out


def near(words: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Columns a, na, b, nb: each pair of words that differ by one inserted, deleted or replaced code point, once."""
    counts = {r["length"]: r["count"] for r in words.groupBy(F.length("word").alias("length")).count().collect()}
    alphabet = np.sort([ord(r[0]) for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()]).astype(np.uint32)
    slices = {k: -(-n // SLICE) for k, n in counts.items()}
    filed = stored(filters(words, slices), "filters")
    at = lambda x: F.struct(F.lit(x[0]).cast("bigint").alias("length"), F.lit(x[1]).cast("bigint").alias("piece"))
    kept = words.select("word", "n", F.lit("").alias("other")).where("false")
    for lo, hi in passes(filed.select("length", "piece", F.octet_length("bits").alias("size")), max_bytes):
        own = filed.where(F.struct("length", "piece").between(at(lo), at(hi))).collect()
        shards = Shards(slices).load([(r["length"], r["piece"], bytes(r["bits"])) for r in own])
        kept = kept.union(candidates(words, shards, counts, alphabet))
    exact = words.select(F.col("word").alias("b"), F.col("n").alias("nb"))
    return kept.select(F.col("word").alias("a"), F.col("n").alias("na"), F.col("other").alias("b")).join(exact, "b").select("a", "na", "b", "nb")


def roots(forms: DataFrame) -> DataFrame:
    """From (word, form) to (word, root): forms followed until a word has none, by doubling the steps in each round."""
    steps = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stored(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return steps


def variants(words: DataFrame, ratio: int = 2, max_bytes: int = 64 << 20) -> DataFrame:
    """Columns word, form, root, n, n_near, form_n for a vocabulary (word, n)."""
    words = stored(words.select("word", "n"), "vocabulary")
    pair = lambda a, b: F.struct(F.col(a).alias("word"), F.col(f"n{a}").alias("n"), F.col(b).alias("other"), F.col(f"n{b}").alias("m"))
    both = near(words, max_bytes).select(F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("p")).select("p.*")
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    enough = -F.col("best.m") >= ratio * F.col("n")
    best = stored(best.select("word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")), "near")
    last = roots(best.where("form is not null"))
    return (
        words.join(best, "word", "left").join(last, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")
    )
