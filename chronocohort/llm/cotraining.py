"""Quality by co-training: a text-content view and a page-metadata view teach each other, then both score everything.

Each view is a logistic model of its own features. Both start from labelled rows. In each round every view judges all
unlabelled rows; the rows it is surest of, in the proportion of the classes and a growing share of all, teach the other
view. A round reads the stored features of all unlabelled rows: once for histograms of the margins, which give the
cut of each class, and once for each Newton step, whose sums (gradient and curvature) are of fixed size and added up by
Spark. Rows of equal margin count alike: those at the cut share what is left of the class's share as their weight. All
pseudo-labelled rows together weigh as much as the labelled ones at most. Each view is then calibrated on labelled rows
that took no part (a fifth, by crc32 of the key), and the calibrated views are combined by weights fitted on the same
rows. At most ``max_labelled`` labelled rows are used, in order of a hash; of rows with one key, the one of smallest features.

Null and empty texts have zero text features; null metadata is a value of its own. With labels of one class everything
gets that class's rate; with one class among the held-out rows the views are combined as they are, at equal weights.
Rows with a null key are unlabelled rows. Repeated rows are scored alike; no column of the input but the named ones is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from chronocohort.llm.components import stored
from chronocohort.llm.words import SPACE, sliced, words

SOURCES, LANGS = 64, 16
_KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"|#$%&*+<=>@[]^_{}~\\/", b".,;:'\"()-", b"\n"]


def text_features(column) -> np.ndarray:
    """Shares of kinds of bytes, length and variety of words, and repetition; one row per text."""
    w = words(column, SPACE)
    n = np.diff(w.first)
    at = np.concatenate([w.start, [len(w.data)]])[w.first[:-1]]
    end = np.where(n > 0, np.concatenate([[0], w.end])[w.first[1:]], at)
    size = np.maximum(end - at, 0)
    share = []
    for kind in _KINDS:
        table = np.zeros(256, bool)
        table[list(kind)] = True
        total = np.concatenate([[0], np.cumsum(table[w.data])])
        share.append((total[end] - total[at]) / np.maximum(size, 1))
    text_of = w.text_of_word()
    order = np.lexsort((w.hash, text_of))
    new = np.ones(len(w), bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (text_of[order][1:] != text_of[order][:-1])
    distinct = np.bincount(text_of[order][new], minlength=len(n))
    again = np.zeros(len(w), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (text_of[1:] == text_of[:-1])
    length = np.bincount(text_of, weights=(w.end - w.start), minlength=len(n))
    safe = np.maximum(n, 1)
    return np.column_stack([*share, np.log1p(n), length / safe / 10, distinct / safe, np.bincount(text_of, weights=again, minlength=len(n)) / safe])


def meta_codes(source, lang, length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of source and language, and the logarithm of the stated length."""
    bucket = lambda values, n: np.array([zlib.crc32(str(v).encode()) % n for v in values], np.int32)
    size = np.array([max(float(c or 0), 0.0) for c in length])
    return bucket(source, SOURCES), bucket(lang, LANGS), np.log1p(size) / 10


def meta_features(source: np.ndarray, lang: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One column for each bucket, and the size with its square; one row per document."""
    out = np.zeros((len(size), SOURCES + LANGS + 2))
    at = np.arange(len(size))
    out[at, source] = 1
    out[at, SOURCES + lang] = 1
    out[:, -2], out[:, -1] = size, size**2
    return out


@dataclass
class Logistic:
    """Standardised features and weights; ``fit`` takes Newton steps with a small ridge."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> Logistic:
        model = Logistic(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6), np.zeros(x.shape[1] + 1))
        for _ in range(steps):
            model = model.step(model.sums(x, y, np.ones(len(y))), ridge)
        return model

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[1:]

    def sums(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Gradient and curvature of the weighted loss, as one flat array; those of several sets of rows add up."""
        z = np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)])
        p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
        return np.concatenate([z.T @ (weight * (p - y)), (z.T @ (z * (weight * (p * (1 - p) + 1e-9))[:, None])).ravel()])

    def step(self, sums: np.ndarray, ridge: float = 1.0) -> Logistic:
        """One Newton step from the sums over all rows."""
        n = len(self.weights)
        penalty = np.full(n, ridge)
        penalty[0] = 1e-6
        curve = sums[n:].reshape(n, n) + np.diag(penalty)
        return replace(self, weights=self.weights - np.linalg.solve(curve, sums[:n] + penalty * self.weights))


@dataclass
class Model:
    rate: float
    views: list[Logistic] | None = None
    calibrations: list[Logistic] | None = None
    combined: Logistic | None = None

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: combined probability, then that of each view."""
        if self.views is None:
            return np.full((len(text), 3), self.rate)
        margins = [c.margin(v.margin(x)[:, None]) for v, c, x in zip(self.views, self.calibrations, (text, meta))]
        whole = self.combined.margin(np.column_stack(margins))
        return 1 / (1 + np.exp(-np.clip(np.column_stack([whole, *margins]), -30, 30)))


Sums = Callable[[Callable[[list[np.ndarray]], np.ndarray], int], np.ndarray]
BINS, WIDEST = 4800, 30.0


def _bin(margin: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((margin + WIDEST) * (BINS / (2 * WIDEST))), 0, BINS - 1).astype(np.int64)


def _surest(counts: np.ndarray, take: float) -> np.ndarray:
    """Weight of each bin, the surest first: whole bins up to ``take`` rows, and a share of the bin that exceeds it."""
    before = np.cumsum(counts) - counts
    return np.clip((take - before) / np.maximum(counts, 1), 0.0, 1.0)


def co_train(x: list[np.ndarray], y: np.ndarray, pool: Sums, rounds: int, share: float, steps: int = 2) -> list[Logistic]:
    """Two models. ``pool(work, size)`` adds up an array of that size over all unlabelled rows, given the features of both views."""
    views = [Logistic.fit(x[v], y) for v in (0, 1)]
    sizes = [m.shape[1] for m in x]
    moments = lambda x: np.concatenate([[len(x[0])], *(f(m) for m in x for f in (lambda m: m.sum(axis=0), lambda m: (m**2).sum(axis=0)))])
    whole = pool(moments, 1 + 2 * sum(sizes))
    total = whole[0]
    if not total:
        return views
    whole = whole + moments(x)
    at = 1
    for v, size in enumerate(sizes):
        mean = whole[at : at + size] / whole[0]
        scale = np.sqrt(np.maximum(whole[at + size : at + 2 * size] / whole[0] - mean**2, 0.0))
        at += 2 * size
        # Features that labelled rows lack (a source without labels) start at weight 0, on the scale of all rows.
        views[v] = Logistic(mean, np.maximum(scale, 1e-6), np.zeros(size + 1))
        for _ in range(12):
            views[v] = views[v].step(views[v].sums(x[v], y, np.ones(len(y))))
    ends = np.cumsum([0, *((size + 1) * (size + 2) for size in sizes)])
    for turn in range(1, rounds + 1):
        teachers = list(views)
        counts = pool(lambda x, views=teachers: np.concatenate([np.bincount(_bin(views[v].margin(x[v])), minlength=BINS) for v in (0, 1)]).astype(float), 2 * BINS)
        take = total * share * turn / rounds
        good, bad = [], []
        for own in (counts[:BINS], counts[BINS:]):
            high, low = own.copy(), own.copy()
            high[: BINS // 2] = low[BINS // 2 :] = 0
            good.append(np.where(high > 0, _surest(high[::-1], take * y.mean())[::-1], 0.0))
            bad.append(np.where(low > 0, _surest(low, take * (1 - y.mean())), 0.0))
        weight = min(1.0, len(y) / take)

        def taught(x: list[np.ndarray], learners: list[Logistic]) -> np.ndarray:
            out = []
            for v in (0, 1):
                bins = _bin(teachers[1 - v].margin(x[1 - v]))
                up, down = good[1 - v][bins], bad[1 - v][bins]
                sure = np.flatnonzero(up + down)
                out.append(learners[v].sums(x[v][sure], (up[sure] > 0).astype(float), weight * (up + down)[sure]))
            return np.concatenate(out)

        for _ in range(steps):
            sums = pool(lambda x, learners=list(views): taught(x, learners), int(ends[-1]))
            views = [m.step(sums[ends[v] : ends[v + 1]] + m.sums(x[v], y, np.ones(len(y)))) for v, m in enumerate(views)]
    return views


def _features(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray]:
    text, source, lang, length = (batch.column(first + i) for i in range(4))
    return text_features(text), meta_features(*meta_codes(source.to_pylist(), lang.to_pylist(), length.to_pylist()))


STORED = "key bigint, a array<double>, source int, lang int, size double"


def _stored_features(rows: DataFrame) -> DataFrame:
    """Text features, buckets and size of all rows, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            codes = meta_codes(*(batch.column(i).to_pylist() for i in (2, 3, 4)))
            text = pa.array(list(text_features(batch.column(1))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), text, *map(pa.array, codes)], names=["key", "a", "source", "lang", "size"])

    return stored(rows.mapInArrow(run, STORED), "features")


def _views(a, source, lang, size) -> list[np.ndarray]:
    text = np.asarray(a.flatten()).reshape(len(a), -1)
    return [text, meta_features(*(np.asarray(c) for c in (source, lang, size)))]


def summed(pool: DataFrame, groups: int = 32) -> Sums:
    """Sums over the rows of ``pool``: per partition, then per group of partitions, then the groups' on the driver."""

    def total(work: Callable[[list[np.ndarray]], np.ndarray], size: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, sums = TaskContext.get().partitionId(), np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    sums += work(_views(*(batch.column(i) for i in range(4))))
            yield pa.RecordBatch.from_arrays([pa.array([part % groups], pa.int32()), pa.array([part], pa.int32()), pa.array([sums], pa.list_(pa.float64()))], names=["dealt", "part", "sums"])

        def add(parts: pa.Table) -> pa.Table:
            # In one order, so that a repeated run gives the same sums.
            parts = parts.sort_by("part")
            sums = np.asarray(parts.column("sums").combine_chunks().flatten()).reshape(parts.num_rows, size).sum(axis=0)
            return pa.table({"dealt": parts.column("dealt").slice(0, 1), "sums": pa.array([sums], pa.list_(pa.float64()))})

        parts = pool.select("a", "source", "lang", "size").mapInArrow(run, "dealt int, part int, sums array<double>")
        rows = parts.groupBy("dealt").applyInArrow(add, "dealt int, sums array<double>").collect()
        return sum((np.array(r["sums"]) for r in sorted(rows)), np.zeros(size))

    return total


def _inputs(docs: DataFrame, key: str, text: str, source: str, lang: str, length: str) -> DataFrame:
    named = {"key": (key, "bigint"), "text": (text, "string"), "source": (source, "string"), "lang": (lang, "string"), "length": (length, "double")}
    return docs.select(*(F.col(f"`{c}`").cast(kind).alias(name) for name, (c, kind) in named.items()))


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", length: str = "n_chars",
    label: str = "quality", max_labelled: int = 10_000, rounds: int = 5, share: float = 0.5,
) -> Model:
    """Co-train on a bounded sample of labelled rows and all unlabelled ones; each view labels ``share`` of these in the last round, at most."""
    features = _stored_features(_inputs(docs, key, text, source, lang, length))
    known = labels.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{label}`").cast("int").alias("y")).where("key is not null and y in (0, 1)")
    some = F.broadcast(known.orderBy(F.xxhash64("key"), "key", "y").limit(max_labelled))
    # One row per labelled key, so the sample is bounded whatever the copies of a key.
    sample = features.join(some, "key").groupBy("key", "y").agg(F.min(F.struct("a", "source", "lang", "size")).alias("f")).select("key", "y", "f.*").toArrow()
    sample = sample.sort_by([("key", "ascending"), ("y", "ascending")])
    y = np.asarray(sample.column("y")).astype(float)
    held = np.array([zlib.crc32(str(k).encode()) % 5 == 0 for k in sample.column("key").to_pylist()], bool)
    if not len(y) or len(set(y[~held])) < 2:
        return Model(float(y.mean()) if len(y) else 0.5)
    x = _views(*(sample.column(c).combine_chunks() for c in ("a", "source", "lang", "size")))
    pool = stored(features.join(known.select("key"), "key", "left_anti").select("a", "source", "lang", "size"), "unlabelled")
    views = co_train([m[~held] for m in x], y[~held], summed(pool), rounds, share)
    margins = [v.margin(m[held])[:, None] for v, m in zip(views, x)]
    if len(set(y[held])) == 2:
        calibrations = [Logistic.fit(m, y[held]) for m in margins]
        combined = Logistic.fit(np.column_stack([c.margin(m) for c, m in zip(calibrations, margins)]), y[held])
    else:
        calibrations = [Logistic(np.zeros(1), np.ones(1), np.array([0.0, 1.0]))] * 2
        combined = Logistic(np.zeros(2), np.ones(2), np.array([0.0, 0.5, 0.5]))
    return Model(float(y.mean()), views, calibrations, combined)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", length: str = "n_chars") -> DataFrame:
    """Columns key, score, text_score, meta_score: probabilities of good quality, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            s = model.scores(*_features(batch, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s[:, i]) for i in range(3))], names=["key", "score", "text_score", "meta_score"])

    return _inputs(docs, key, text, source, lang, length).mapInArrow(run, "key bigint, score double, text_score double, meta_score double")
