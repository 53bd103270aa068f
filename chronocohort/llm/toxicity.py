"""Toxicity by nearest labelled examples: exact cosine over a block-max inverted index, distance-weighted votes.

Terms are all words of the examples. A term weighs its TF-IDF times 1 plus the root of G, the likelihood ratio of the
examples of both classes that hold it, so that words tied to a class count most and none is dropped; in G a word counts
no more often than it has distinct contexts (the word after it), so that copies of one text count once. Examples are a
bounded sample of labelled rows, a stated number per class in order of a hash. Document frequencies of the terms are
counted over all documents. The index holds examples in blocks with the largest weight of each frequent term in each; a
search adds up the blocks of highest bound, then all whose bound reaches the k-th neighbour so far, for many texts at
once, so the neighbours are exact. Votes are weighted by cosine and by class, and calibrated on the examples themselves, each without itself.
Broadcast: the postings of at most ``max_per_class * 2`` examples and the hashes of their words.

Null and empty texts, and texts without a term, get the calibrated rate of examples without a term. With no label of
one class everything gets the base rate. Repeated rows are scored alike; ties between neighbours go to the smaller id.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chronocohort.llm.components import stored
from chronocohort.llm.words import PUNCTUATION, sliced, words

BLOCK = 64
FIRST_BLOCKS = 4
# Memory of the frequent terms' rows, and texts searched at once.
WHOLE_BYTES = 24 << 20
TEXTS = 32
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def held_out(key: Column) -> Column:
    """The fifth of documents whose labels are never learned from."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``size`` of them, one span after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first, size)


@dataclass
class Neighbours:
    """Block-max index of examples. Rare terms have posting lists; the most frequent terms, whose lists hold nearly all
    examples, have whole rows, with the largest weight of each block of examples beside them."""

    n_rows: int
    slot: np.ndarray
    often: np.ndarray
    top: np.ndarray
    first: np.ndarray
    row: np.ndarray
    weight: np.ndarray

    @staticmethod
    def build(row: np.ndarray, term: np.ndarray, weight: np.ndarray, n_rows: int, n_terms: int) -> Neighbours:
        """Of weights in order of their rows. What it needs beside them is a few bytes a weight, for the driver makes it."""
        width = -(-n_rows // BLOCK) * BLOCK
        size = np.bincount(term, minlength=n_terms)
        most = np.sort(np.argsort(-size, kind="stable")[: WHOLE_BYTES // (8 * width)])
        slot = np.full(n_terms, -1, np.int32)
        slot[most] = np.arange(len(most))
        often = np.zeros((len(most), width))
        whole = np.flatnonzero(slot[term] >= 0)
        often[slot[term[whole]], row[whole]] = weight[whole]
        rare = np.argsort(term, kind="stable").astype(np.int32, copy=False)
        rare = rare[slot[term[rare]] < 0]
        first = np.append(0, np.cumsum(np.where(slot < 0, size, 0)))
        return Neighbours(n_rows, slot, often, often.reshape(len(most), -1, BLOCK).max(axis=2), first.astype(np.int32), row[rare].astype(np.int32, copy=False), weight[rare])

    @staticmethod
    def of(weights: np.ndarray) -> Neighbours:
        row, term = np.nonzero(weights)
        return Neighbours.build(row, term, weights[row, term], *weights.shape)

    def many(self, owner: np.ndarray, terms: np.ndarray, query: np.ndarray, n: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of n unit queries the row numbers and cosines of its k closest examples, closest first, positive cosines only.

        Rare terms are added up first. A block's bound is its largest sum so far plus the frequent terms' block maxima;
        the frequent terms are added in the blocks of highest bound, then in all whose bound reaches the k-th so far.
        """
        width = self.often.shape[1]
        slot = self.slot[terms]
        whole = slot >= 0
        part = np.zeros((n, len(self.often)))
        part[owner[whole], slot[whole]] = query[whole]
        # One text's lists at a time, so that what a worker holds does not grow with the batch.
        own, rare, asked = owner[~whole], terms[~whole], query[~whole]
        cut, score = np.searchsorted(own, np.arange(n + 1)), np.zeros((n, width))
        for i in range(n):
            some = slice(cut[i], cut[i + 1])
            size = self.first[rare[some] + 1] - self.first[rare[some]]
            posting = _spans(self.first[rare[some]], size)
            score[i] += np.bincount(self.row[posting], self.weight[posting] * np.repeat(asked[some], size), minlength=width)
        bound = part @ self.top + score.reshape(n, -1, BLOCK).max(axis=2)
        todo, done = np.zeros(bound.shape, bool), np.zeros(bound.shape, bool)
        best = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS]
        todo[np.arange(n)[:, None], best] = True
        for _ in range(2):
            todo &= bound > 0
            for block in np.flatnonzero(todo.any(axis=0)):
                some, columns = np.flatnonzero(todo[:, block]), slice(block * BLOCK, (block + 1) * BLOCK)
                score[some, columns] += part[some] @ self.often[:, columns]
            done |= todo
            known = np.where(np.repeat(done, BLOCK, axis=1), score, 0.0)
            least = np.partition(known, width - k, axis=1)[:, width - k] if k <= width else np.zeros(n)
            todo = ~done & (bound >= least[:, None] - 1e-11)
        out = []
        for i in range(n):
            rows = np.flatnonzero((known[i] > 0) & (known[i] >= least[i] - 1e-11))
            rows = rows[np.lexsort((rows, -np.round(known[i, rows], 12)))[:k]]
            out.append((rows, known[i, rows]))
        return out

    def nearest(self, terms: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.many(np.zeros(len(terms), np.int64), terms, query, 1, k)[0]


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    index: Neighbours | None = None
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0), np.zeros(0)))
    without: float = 0.0
    k: int = 15

    def votes(self, owner: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int, skip: int = -1) -> list[tuple[float, np.ndarray]]:
        """Uncalibrated share of toxic weight among the neighbours of each of n texts, and the neighbours.

        With ``skip`` the texts are the examples from that number on, and none is its own neighbour.
        """
        query = (1 + np.log(counts)) * self.scale[terms]
        query /= np.sqrt(np.bincount(owner, query**2, minlength=n))[owner]
        out = []
        for i, (rows, cosine) in enumerate(self.index.many(owner, terms, query, n, self.k + (skip >= 0))):
            if skip >= 0:
                other = rows != skip + i
                rows, cosine = rows[other][: self.k], cosine[other][: self.k]
            weight = cosine * self.weight[rows]
            out.append((float((weight * self.toxic[rows]).sum() / weight.sum()) if len(rows) else 0.0, rows))
        return out

    def calibrated(self, share: float) -> float:
        return float(np.interp(share, *self.steps)) if len(self.steps[0]) else self.without


def _counted(batch_text, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Text number, term number and count of every term (by its place in sorted hashes) in every text of a batch."""
    w = words(batch_text, PUNCTUATION)
    if not len(hashes) or not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), len(w.first) - 1
    at = np.minimum(np.searchsorted(hashes, w.hash), len(hashes) - 1)
    hit = np.flatnonzero(hashes[at] == w.hash)
    code, count = np.unique(w.text_of_word()[hit] * len(hashes) + at[hit], return_counts=True)
    return code // len(hashes), code % len(hashes), count, len(w.first) - 1


def _examples(got: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, label and number of terms of the examples, and their terms and counts one after the other, in order of key,
    label and content. The driver holds the terms of all examples here, so they are never Python objects nor 64 bits wide."""
    ids, label_of = got["key"].to_numpy(), got["y"].to_numpy()
    size = np.concatenate([np.diff(c.offsets) for c in got["term"].chunks]).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    term, count = (np.concatenate([np.zeros(0, np.int32), *(c.flatten() for c in got[x].chunks)]) for x in ("term", "count"))
    first, repeats = np.cumsum(size) - size, Counter(zip(ids.tolist(), label_of.tolist()))

    def place(i: int) -> tuple:
        at = slice(first[i], first[i] + size[i])
        return (ids[i], label_of[i], *((x[at].tobytes() for x in (term, count)) if repeats[ids[i], label_of[i]] > 1 else ()))

    order = np.array(sorted(range(len(ids)), key=place), np.int64)
    at = [slice(a, b) for a, b in zip(first[order].tolist(), (first + size)[order].tolist())]
    term, count = (np.concatenate([x[:0], *(x[s] for s in at)]) for x in (term, count))
    return ids[order], label_of[order], size[order], term, count


def _unit(row: np.ndarray, term: np.ndarray, count: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Weights of the terms of every row, as vectors of length 1."""
    weight = np.log(count)
    weight += 1
    weight *= scale[term]
    weight /= np.sqrt(np.bincount(row, weight**2))[row]
    return weight


def _rising(share: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit: pooled means in order of the share."""
    order = np.argsort(share, kind="stable")
    pools: list[list[float]] = []
    for x, y, w in zip(share[order], toxic[order], weight[order]):
        pools.append([w * x, w * y, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _likelihood_ratio(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """G of words in a of n1 toxic and b of n0 other examples."""
    share, both = n1 / (n1 + n0), np.maximum(a + b, 1)
    half = lambda x, p: x * np.log(np.maximum(x, 1) / (both * p))
    return np.maximum(0.0, 2 * (half(a, share) + half(b, 1 - share)))


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_per_class: int = 4000, k: int = 15,
) -> Model:
    """Learn from the rows of ``labels`` that are not held out."""
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("y")).where("key is not null and y in (0, 1)").where(~held_out(F.col("key")))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return Model(without=1.0 if totals.get(1) else 0.0, k=k)
    part = [known.where(f"y = {y}").orderBy(F.xxhash64("key"), "key").limit(max_per_class) for y in (0, 1)]
    source = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    chosen = F.broadcast(part[0].union(part[1]))  # at most 2 * max_per_class short rows
    sample = stored(source.join(chosen, "key"), "examples")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = sample.select("key", "y", F.filter(F.split(lower, GAP), lambda x: x != "").alias("w")).where("size(w) > 0")
    pairs = tokens.select("key", "y", F.explode(F.arrays_zip(F.col("w").alias("w"), F.slice("w", F.lit(2), F.size("w")).alias("next"))).alias("p")).select("key", "y", "p.*").distinct()
    toxic = F.col("y") == 1
    documents = pairs.select("key", "y", "w").distinct().groupBy("w").agg(F.count_if(toxic).alias("a"), F.count_if(~toxic).alias("b"))
    contexts = pairs.where(toxic).select("w", "next").distinct().groupBy("w").agg(F.count("*").alias("c"))
    found = documents.join(contexts, "w", "left").select("w", F.least("a", "c").alias("a"), "b").toArrow()  # the words of the examples
    hashes = words(found["w"], PUNCTUATION).hash
    order = np.argsort(hashes)
    terms, hashes = found["w"].take(order).to_pylist(), hashes[order]
    a, b = (found[c].to_numpy()[order] for c in "ab")
    del found, order
    strength = 1 + np.sqrt(_likelihood_ratio(a, b, min(totals[1], max_per_class), min(totals[0], max_per_class)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(len(hashes), np.int64), 0
        for batch in sliced(batches, 0, 1 << 20):
            _, term, _, n = _counted(batch.column(0), hashes)
            total, texts = total + np.bincount(term, minlength=len(total)), texts + n
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, held)), pa.array(np.append(texts, total[held]))], names=["term", "df"])

    counts = source.select("text").mapInArrow(frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(terms) + 1)
    df[counts["term"].to_numpy() + 1] = counts["df"].to_numpy()
    scale = (np.log((1 + df[0]) / (1 + df[1:])) + 1) * strength
    del counts, df, a, b, strength

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2, 1 << 20):
            owner, term, count, n = _counted(batch.column(2), hashes)
            cut = np.searchsorted(owner, np.arange(n + 1))
            lists = [[term[cut[i] : cut[i + 1]], count[cut[i] : cut[i + 1]]] for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in lists], pa.list_(pa.int32())), pa.array([x[1] for x in lists], pa.list_(pa.int32()))],
                names=["key", "y", "term", "count"],
            )

    got = sample.select("key", F.col("y").cast("bigint").alias("y"), "text").mapInArrow(vectors, "key bigint, y bigint, term array<int>, count array<int>").toArrow()
    ids, label_of, size, term, count = _examples(got)
    del got
    n = np.array([(label_of == y).sum() for y in (0, 1)])
    class_weight = np.array([totals[0], totals[1]]) / np.maximum(n, 1)
    some = np.flatnonzero(size)
    none = np.array([((label_of == y) & (size == 0)).sum() for y in (0, 1)]) * class_weight
    without = float((none[1] + 0.5) / (none.sum() + 1)) if none.sum() else totals[1] / (totals[0] + totals[1])
    toxic = label_of[some].astype(float)
    model = Model(terms, hashes, scale, None, ids[some], toxic, class_weight[toxic.astype(int)], without=without, k=k)
    if len(some):
        row = np.repeat(np.arange(len(some), dtype=np.int32), size[some])
        model.index = Neighbours.build(row, term, _unit(row, term, count, scale), len(some), len(terms))
        cut = np.append(0, np.cumsum(size[some]))
        share = []
        for at in range(0, len(some), TEXTS):
            own = slice(cut[at], cut[min(at + TEXTS, len(some))])
            share += [x for x, _ in model.votes(row[own] - at, term[own], count[own], min(TEXTS, len(some) - at), skip=at)]
        share = np.array(share)
        model.steps = _rising(share, toxic, model.weight)
    return model


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns key, score, evidence (ids of the nearest examples) and the input columns named by ``keep``, in struct row."""
    remembered: dict[bytes, tuple[float, list[int]]] = {}
    # The workers need the hashes only. A broadcast of its own is read straight into arrays; as part of the function its
    # pickled bytes would stay in every worker beside them.
    held = df.sparkSession.sparkContext.broadcast(replace(model, terms=[]))
    kept = keep or []
    once = text in kept and df.schema[text].dataType.simpleString() == "string"  # texts then go to the workers once
    others = [c for c in kept if not (once and c == text)]
    carried = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None).cast("struct<none:int>")
    source = df.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), carried.alias("row"))
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")) if kept else source

    def row_of(batch: pa.RecordBatch):
        if not once:
            return batch.column(2)
        fields = {c: batch.column(2).field(i) for i, c in enumerate(others)} | {text: batch.column(1)}
        return pa.StructArray.from_arrays([fields[c] for c in kept], names=kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in sliced(batches, 1, 1 << 20):
            owner, term, count, n = _counted(batch.column(1), model.hashes)
            cut = np.searchsorted(owner, np.arange(n + 1))
            scores, evidence = np.full(n, model.without), [[] for _ in range(n)]
            pattern = {i: hashlib.blake2b(term[cut[i] : cut[i + 1]].tobytes() + count[cut[i] : cut[i + 1]].tobytes(), digest_size=16).digest() for i in np.flatnonzero(np.diff(cut))}
            if len(remembered) > 20_000:
                remembered.clear()
            new = list({p: i for i, p in pattern.items() if p not in remembered}.values()) if model.index is not None else []
            for at in range(0, len(new), TEXTS):
                some = np.array(new[at : at + TEXTS])
                size = cut[some + 1] - cut[some]
                own = _spans(cut[some], size)
                for i, (share, rows) in zip(some, model.votes(np.repeat(np.arange(len(some)), size), term[own], count[own], len(some))):
                    remembered[pattern[i]] = model.calibrated(share) if len(rows) else model.without, model.ids[rows].tolist()
            for i, p in pattern.items() if model.index is not None else ():
                scores[i], evidence[i] = remembered[p]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(evidence, pa.list_(pa.int64())), row_of(batch)], names=["key", "score", "evidence", "row"])

    return source.mapInArrow(run, f"key bigint, score double, evidence array<bigint>, row {whole.schema['row'].dataType.simpleString()}")
