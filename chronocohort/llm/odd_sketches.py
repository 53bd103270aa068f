"""MinHash near-duplicates with odd sketches: banded candidates, screened by parity bitmaps, confirmed on full sets.

1. Each text's distinct word shingles give ``bands * rows`` MinHash samples. A band is ``rows`` samples as one hash; two
   sets of similarity J share a band with probability 1 - (1 - J^rows)^bands (all but 2e-7 at 0.8 with 40 bands of 5).
   The samples are also folded into an odd sketch: each sample flips one bit of a parity bitmap, so the bits in which
   two bitmaps differ estimate in how many samples the sets differ, most precisely where they differ in few.
2. Equal sets collapse to one. Sets that share a band meet in its bucket. A bucket of any size first compares its
   members with one pivot only, the set with most company in all its buckets (edited copies are closest to their base),
   and a set keeps the pivot that most of its buckets name: one pair per set. Pairs that the sketches keep are confirmed
   on the full sets, and give components.
3. Buckets that still hold several components are open. Their sets get finer odd sketches, of more samples, from their
   texts; sets outside the pivot's component are compared by these with all sets of other components, where they meet.
   A large open bucket is a grid of cells, each set dealt to a row or a column of it, so its pairs spread over many
   tasks. A pair comes out of its first common bucket only, and only if the sketches keep it; it is confirmed as well.
4. Components of all confirmed links are the groups; the smallest id of a group stays.

A pair is screened out if its sketches differ in more bits than a pair at the threshold does but for one in a million.

Texts with fewer words than a shingle are one shingle; texts without words (null, empty, blank) are empty sets and link
with nothing. Rows with a null key link nothing, have no component and are kept. Repeated rows are repeated. Ties (equal sets) are
one set. Very long texts are one set like any other. An empty table has no rows. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chronocohort.llm.components import components, stored
from chronocohort.llm.jaccard import shingle_sets, signatures
from chronocohort.llm.words import mix, sliced, words

# Members of an open bucket that one cell compares with as many others.
CELL = 2048
GROUP = 8192
_SETS = "key bigint, n bigint, sig binary, bands array<bigint>, sketch array<bigint>"


@dataclass(frozen=True)
class Sketch:
    """An odd sketch of so many samples in so many 64-bit words."""

    samples: int
    longs: int

    @property
    def bits(self) -> int:
        return 64 * self.longs

    def most_bits(self, similarity: float, loss: float) -> int:
        """Differing bits that two sets of this similarity exceed with probability ``loss`` at most.

        The samples that differ are binomial; each flips two bits, and flips may meet and cancel.
        """
        odd, place, total = np.zeros(self.bits + 1), np.arange(self.bits + 1), np.zeros(self.bits + 1)
        odd[0], chance = 1.0, similarity**self.samples
        for differ in range(self.samples + 1):
            total += chance * odd
            chance *= (self.samples - differ) / (differ + 1) * (1 - similarity) / similarity
            for _ in range(2):
                up, down = odd * (1 - place / self.bits), odd * place / self.bits
                odd = np.concatenate([[0.0], up[:-1]]) + np.concatenate([down[1:], [0.0]])
        return int(np.flatnonzero(np.cumsum(total[::-1])[::-1] > loss)[-1])

    def of(self, samples: np.ndarray) -> np.ndarray:
        """Parity bitmaps (sets x longs): every sample, told apart by its number, flips one bit."""
        number, out = np.arange(samples.shape[1], dtype=np.uint64) << np.uint64(32), np.zeros((len(samples), self.longs), np.uint64)
        for at in range(0, len(samples), 512):
            some = samples[at : at + 512].astype(np.uint64)
            bit = (mix(some + number) % np.uint64(self.bits)).astype(np.int64) + np.arange(len(some))[:, None] * self.bits
            flips = np.bincount(bit.ravel(), minlength=len(some) * self.bits) & 1
            out[at : at + 512] = np.packbits(flips.astype(np.uint8).reshape(len(some), -1), axis=1, bitorder="little").view(np.uint64)
        return out


@dataclass(frozen=True)
class Scheme:
    size: int = 2
    percent: int = 80
    bands: int = 40
    rows: int = 5
    longs: int = 16
    fine: Sketch = Sketch(2048, 128)
    loss: float = 1e-6

    @property
    def coarse(self) -> Sketch:
        return Sketch(self.bands * self.rows, self.longs)


def minhash(token: np.ndarray, first: np.ndarray, samples: int) -> np.ndarray:
    """Samples (sets x samples) of hashed tokens; sets without tokens get the largest value."""
    full = np.flatnonzero(np.diff(first))
    out = np.full((len(first) - 1, samples), 0xFFFFFFFF, np.uint32)
    if len(full):
        low = token.astype(np.uint32)
        factors = mix(np.arange(1, samples + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
        for k in range(samples):
            out[full, k] = np.minimum.reduceat(low * factors[k], first[full])
    return out


def band_hashes(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per set and band; equal samples in the band give equal hashes."""
    out = np.zeros((len(samples), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(samples), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h ^ samples[:, b * rows + r].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        out[:, b] = h
    return out


def sketched(df: DataFrame, key: str, text: str, scheme: Scheme) -> DataFrame:
    """One row per document: key, n, and if it has words and a key: sig, bands and sketch of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            token, _, first = shingle_sets(words(batch.column(1)), scheme.size)
            n = np.diff(first)
            samples = minhash(token, first, scheme.coarse.samples)
            empty = (n == 0) | ~batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            lists = [band_hashes(samples, scheme.bands, scheme.rows).view(np.int64), scheme.coarse.of(samples).view(np.int64)]
            column = [pa.array([None if e else x for x, e in zip(rows, empty)], pa.list_(pa.int64())) for rows in lists]
            sig = pa.array([None if e else s for s, e in zip(signatures(token, first), empty)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), sig, *column], names=["key", "n", "sig", "bands", "sketch"])

    return df.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, _SETS)


def again(df: DataFrame, key: str, text: str, size: int, wanted: DataFrame, name: str, of) -> DataFrame:
    """Columns sig and ``name``, once for each of the wanted sets (sig, key): ``of(token, first)`` lists from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            token, _, first = shingle_sets(words(batch.column(0)), size)
            yield pa.RecordBatch.from_arrays([pa.array(signatures(token, first), pa.binary()), of(token, first)], names=["sig", name])

    named = df.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    read = named.join(wanted.select("key").distinct(), "key", "left_semi").select("text").mapInArrow(run, f"sig binary, {name} array<bigint>")
    # A key may have other texts too; equal sets have equal lists.
    return read.join(wanted.select("sig"), "sig", "left_semi").groupBy("sig").agg(F.any_value(name).alias(name))


def _tokens(token: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), pa.array(token.view(np.int64))).cast(pa.list_(pa.int64()))


def _screen(scheme: Scheme, sketch: Sketch) -> Column:
    """Sizes and sketches (columns na, sa and nb, sb) that a linked pair can have."""
    differ = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(sketch.longs)), F.lit(0))
    fits = (100 * F.col("na") >= scheme.percent * F.col("nb")) & (100 * F.col("nb") >= scheme.percent * F.col("na"))
    return fits & (differ <= sketch.most_bits(scheme.percent / 100, scheme.loss))


def _side(sets: DataFrame, name: str, *more: Column) -> DataFrame:
    return sets.select(F.col("sig").alias(name), F.col("n").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"), *more)


def confirmed(pairs: DataFrame, sets: DataFrame, df: DataFrame, key: str, text: str, scheme: Scheme) -> DataFrame:
    """The pairs (a, b) of sets that link, counted on the full sets."""
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()
    wanted = stored(sets.select("sig", "key").join(ends, "sig", "left_semi"), "wanted")
    full = stored(again(df, key, text, scheme.size, wanted, "tokens", _tokens), "full")
    one = full.select(F.col("sig").alias("a"), F.col("tokens").alias("ta"))
    two = full.select(F.col("sig").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    linked = 100 * both >= scheme.percent * (F.size("ta") + F.size("tb") - both)
    return pairs.join(one, "a").join(two, "b").where(linked).select("a", "b")


def links(sets: DataFrame, df: DataFrame, key: str, text: str, scheme: Scheme) -> DataFrame:
    """Links (a, b) between sets that connect the same sets as all links do."""
    bands = sets.select("sig", F.explode("bands").alias("bucket"))
    sizes = bands.groupBy("bucket").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    members = stored(bands.join(sizes.select("bucket", "size"), "bucket"), "members")
    company = members.groupBy("sig").agg(F.sum("size").alias("company"))
    members = stored(members.join(company, "sig"), "company")
    pivots = stored(members.groupBy("bucket").agg(F.max_by("sig", F.struct("company", "sig")).alias("pivot")), "pivots")
    named = members.join(pivots, "bucket").where("sig <> pivot").groupBy("sig", "pivot").agg(F.count("*").alias("shared"))
    star = named.groupBy("sig").agg(F.max_by("pivot", F.struct("shared", "pivot")).alias("b")).select(F.col("sig").alias("a"), "b")
    star = star.join(_side(sets, "a"), "a").join(_side(sets, "b"), "b").where(_screen(scheme, scheme.coarse))
    first = stored(confirmed(star.select("a", "b"), sets, df, key, text, scheme), "star")

    linked = components(first).select(F.col("node").alias("sig"), "component")
    own = lambda x: x.join(linked, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    mains = own(pivots.withColumnRenamed("pivot", "sig")).select("bucket", F.col("component").alias("main"))
    placed = stored(own(members).join(mains, "bucket").withColumn("outside", F.col("component") != F.col("main")), "placed")
    open_ = placed.where("outside").select("bucket").distinct()
    rows = stored(placed.join(open_, "bucket").select("sig", "component", "bucket", "size", "outside"), "open")
    wanted = rows.groupBy("sig").agg(F.collect_set("bucket").alias("buckets")).join(sets.select("sig", "key", "n"), "sig")
    wanted = stored(wanted, "wanted")
    fine = again(df, key, text, scheme.size, wanted, "sketch", lambda token, first: _sketches(token, first, scheme.fine))
    # Pairs (a, b): a, outside, takes a row of the bucket's grid and b a column, so each pair meets in one cell. Cells are
    # dealt over groups of about GROUP sets, as most buckets are small.
    side = F.ceil(F.col("size") / CELL).cast("int")
    at, every = F.pmod(F.xxhash64("sig"), side).cast("int"), F.sequence(F.lit(0), side - 1)
    group = F.pmod(F.xxhash64("bucket", "x", "y"), F.lit(-(-rows.count() // GROUP) or 1))
    told = rows.join(stored(wanted.join(fine, "sig").select("sig", "n", "buckets", "sketch"), "fine"), "sig")
    left = told.where("outside").withColumn("x", at).withColumn("y", F.explode(every)).withColumn("group", group).drop("outside", "size")
    right = told.withColumn("y", at).withColumn("x", F.explode(every)).withColumn("group", group).drop("size")
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of its own, as both sides come from one table
    rest = left.groupBy("group").cogroup(right.groupBy("group")).applyInArrow(_compared(scheme), "a binary, b binary")
    return first.union(confirmed(rest.select("a", "b"), sets, df, key, text, scheme))


def _sketches(token: np.ndarray, first: np.ndarray, sketch: Sketch) -> pa.Array:
    return pa.array(list(sketch.of(minhash(token, first, sketch.samples)).view(np.int64)), pa.list_(pa.int64()))


class _Side:
    """One side of some cells, in order of the cells."""

    def __init__(self, table: pa.Table):
        read = {name: table.column(name).combine_chunks() for name in table.column_names}
        number = lambda name: read[name].to_numpy(zero_copy_only=False)
        wide = lambda name: np.frombuffer(b"".join(read[name].to_pylist()), ">u8").reshape(-1, 2)
        cell = mix(number("bucket").view(np.uint64) + mix(number("x").astype(np.uint64) << np.uint64(32) | number("y").astype(np.uint64)))
        order = np.argsort(cell, kind="stable")
        self.cell, self.bucket, self.n = cell[order], number("bucket")[order], number("n")[order]
        self.sig, self.component = wide("sig")[order], wide("component")[order]
        self.outside = number("outside")[order] if "outside" in read else np.ones(len(order), bool)
        self.sketch = read["sketch"].values.to_numpy().view(np.uint64).reshape(len(order), -1)[order]
        self.buckets = [set(x) for x in read["buckets"].take(pa.array(order)).to_pylist()]


def _compared(scheme: Scheme):
    most = scheme.fine.most_bits(scheme.percent / 100, scheme.loss)

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        found: list[tuple[bytes, bytes]] = []
        if len(one) and len(two):
            a, b = _Side(one), _Side(two)
            lo, hi = np.searchsorted(b.cell, a.cell), np.searchsorted(b.cell, a.cell, side="right")
            for i in range(len(a.cell)):
                own = slice(lo[i], hi[i])
                later = (a.sig[i, 0] < b.sig[own, 0]) | (a.sig[i, 0] == b.sig[own, 0]) & (a.sig[i, 1] < b.sig[own, 1])
                fits = (100 * b.n[own] >= scheme.percent * a.n[i]) & (100 * a.n[i] >= scheme.percent * b.n[own])
                other = (b.component[own] != a.component[i]).any(axis=1)
                place = np.flatnonzero(fits & other & (later | ~b.outside[own])) + lo[i]
                differ = np.bitwise_count(b.sketch[place] ^ a.sketch[i]).sum(axis=1, dtype=np.int64)
                for j in place[differ <= most]:
                    if min(a.buckets[i] & b.buckets[j], default=None) == a.bucket[i]:
                        found.append((a.sig[i].tobytes(), b.sig[j].tobytes()))
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    return run


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", scheme: Scheme = Scheme()) -> DataFrame:
    """Columns key, n_shingles, component, kept: one row per document; of each group the smallest key is kept."""
    docs = stored(sketched(df, key, text, scheme), "sketches")
    may = docs.where("sig is not null")
    sets = stored(may.groupBy("sig").agg(F.min("key").alias("key"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")), "sets")
    named = components(stored(links(sets, df, key, text, scheme), "links")).select(F.col("node").alias("sig"), "component")
    placed = stored(sets.select("sig", "key").join(named, "sig", "left").select("sig", "key", F.coalesce("component", "sig").alias("component")), "placed")
    least = placed.groupBy("component").agg(F.min("key").alias("least"))
    some = may.select("key", "n", "sig").join(placed.select("sig", "component"), "sig").join(least, "component").select("key", "n", "least")
    none = docs.where("sig is null").select("key", "n", F.col("key").alias("least"))
    kept = F.coalesce(F.col("key") == F.col("least"), F.lit(True))
    return some.union(none).select("key", F.col("n").alias("n_shingles"), F.col("least").alias("component"), kept.alias("kept"))
