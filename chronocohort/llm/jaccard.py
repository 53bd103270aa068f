"""Exact Jaccard self-join of word n-gram sets, answered with set relations, as components.

1. Each text's distinct shingles are hashed. Chunks of texts ask ranges of hashes (see ``ranges``) in how many chunks
   each shingle occurs. A shingle of one text alone is in no intersection, so a text with too few shared shingles links
   with nothing and is done; equal sets collapse to one representative, whose answer its copies take.
2. Representatives are indexed by prefix: shingles in global order, rarest first (those of one text come first of all
   and need no list). Two linked sets share a prefix shingle.
3. Each index list has two pivots. A set is first compared with the pivot of either kind that most of its lists name;
   sets in one component share its answer, so what is left are pairs of sets of one list whose components differ. Lists are cut into blocks by set size,
   and only neighbouring blocks meet; position is a filter on the pairs that met. Links within a component are not
   all found, so the answer is components, not a list of links.
4. Every pair is counted exactly on the shingles; components of all links follow.

Sets with fewer words than a shingle are the whole sequence as one; texts without words are empty and link with nothing.
A null key counts as no document id: such rows can link others and get the component of those. Repeated rows are
repeated. Lists that stay long and in many components cost pairs of blocks, never a dropped link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from chronocohort.llm import ranges
from chronocohort.llm.components import components, stored
from chronocohort.llm.words import Words, mix, ngrams, words

SETS = "key bigint, n bigint, sig binary, prefix int, tokens array<bigint>"


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, in order within it: hashes, text numbers, and the first of each text (n + 1)."""
    text_of, length = w.text_of_word(), np.diff(w.first)
    grams = ngrams(w.hash, size)
    starts = w.left() >= size
    token, owner = [grams[starts]], [text_of[starts]]
    for short in range(1, size):
        texts = np.flatnonzero(length == short)
        if len(texts):
            token.append(mix(ngrams(w.hash, short)[w.first[texts]] + np.uint64(short)))
            owner.append(texts)
    token, owner = np.concatenate(token), np.concatenate(owner)
    order = np.argsort(token)
    if len(length) < 1 << 16:
        order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
    else:
        order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[new], owner[new]
    return token, owner, np.searchsorted(owner, np.arange(len(length) + 1))


def signatures(token: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128 bits that stand for each set."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(token + np.uint64(k)))]) for k in (1, 2)]
    pairs = np.stack([s[first[1:]] - s[first[:-1]] for s in sums], axis=1)
    return [row.tobytes() for row in np.ascontiguousarray(pairs)]


def survivors(df: DataFrame, key: str, text: str, size: int, percent: int, rows_per_chunk: int) -> DataFrame:
    """One row per document: key, n, and where it may link sig; once per chunk and set also prefix and ordered tokens."""
    chunks = ranges.chunk_count(df, rows_per_chunk)
    texts = ranges.chunked(df, key, text, chunks)
    cut = np.uint64(1 << 17)

    def first_of(sig: list[bytes]) -> np.ndarray:
        seen: set[bytes] = set()
        return np.array([not (s in seen or seen.add(s)) for s in sig], bool)

    def ask(chunk: int, table: pa.Table) -> pa.Table:
        token, owner, first = shingle_sets(words(table.column("text")), size)
        short = np.sort(token) // cut
        once = np.ones(len(short), bool)
        once[1:] = short[1:] != short[:-1]
        at = np.flatnonzero(once)
        many = np.diff(np.append(at, len(short))) > 1
        # 47 bits of the hash and one that says that two sets of this chunk have it, in six bytes.
        code = short[at] * np.uint64(2) + many
        return ranges.sent6(chunk, short[at] * cut, code, chunks)

    def frequency(code, owner, _):
        group = code >> np.uint64(1)
        order = np.argsort(group, kind="stable")
        ordered = group[order]
        head = np.ones(len(ordered), bool)
        head[1:] = ordered[1:] != ordered[:-1]
        number = np.cumsum(head) - 1
        count = np.bincount(number) + np.bincount(number, weights=(code[order] & np.uint64(1)).astype(float)).astype(np.int64)
        back = np.empty(len(code), np.int64)
        back[order] = count[number] if len(number) else back
        return back > 1, [np.minimum(back, 65535).astype("<u2")]

    def answer(chunk: int, table: pa.Table, told) -> pa.Table:
        token, owner, first = shingle_sets(words(table.column("text")), size)
        n = np.diff(first)
        known, at = ranges.member(token // cut, told[0] >> np.uint64(1))
        shared = np.bincount(owner[known], minlength=len(n))
        may = (100 * shared >= percent * n) & (n > 0)
        sig = signatures(token, first)
        new = first_of([s if m else i.to_bytes(4, "little") for i, (s, m) in enumerate(zip(sig, may))]) & may
        prefix = n - -(-percent * n // 100) + 1 - (n - shared)
        tokens: list = [None] * len(n)
        count = told[1][at] if len(told[1]) else np.zeros(len(at), "<u2")
        for i in np.flatnonzero(new):
            own = slice(first[i], first[i + 1])
            ids, weight = token[own][known[own]], count[own][known[own]]
            tokens[i] = ids[np.lexsort((ids, weight))].view(np.int64)
        return pa.table(
            {
                "key": table.column("key"), "n": pa.array(n, pa.int64()),
                "sig": pa.array([s if m else None for s, m in zip(sig, may)], pa.binary()),
                "prefix": pa.array(np.where(new, prefix, 0), pa.int32()), "tokens": pa.array(tokens, pa.list_(pa.int64())),
            }
        )

    told = ranges.answer_by_range(ranges.ask(texts, ask), ["<u8"], frequency, six=True)
    return ranges.tell(texts, told, answer, ["<u8", "<u2"], SETS)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of representatives that link, counted on their shared shingles."""
    one = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(one, "a").join(two, "b").where((100 + percent) * both >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between representatives that connect the same sets as all links do."""
    alone = F.col("n") - F.size("tokens")
    lists = stored(
        sets.select("rep", "n", alone.alias("alone"), F.posexplode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("i", "token"))
        .select("token", "rep", "n", "alone", (F.col("alone") + F.col("i")).cast("bigint").alias("pos")),
        "lists",
    )
    # Pivots: the set of a list with the fewest shingles of its own, which edited copies are closest to, and the first.
    pivots = lists.groupBy("token").agg(F.count("*").alias("size"), F.min(F.struct("alone", "rep")).alias("p"), F.min("rep").alias("q")).where("size > 1")
    met = lists.select("token", "rep").join(pivots, "token").select(F.col("rep").alias("a"), F.posexplode(F.array("p.rep", "q")).alias("kind", "b"))
    met = met.where("a <> b").groupBy("a", "kind", "b").count()
    star = met.groupBy("a", "kind").agg(F.max_by("b", F.struct("count", -F.col("b"))).alias("b"))
    star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = stored(_verified(star, sets, percent), "star")
    # What one component holds is answered; only lists over several components are still open.
    named = components(first)
    placed = lists.join(named.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    rows = stored(placed.join(open_.select("token"), "token"), "open")
    block = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int")
    left = rows.select("token", block.alias("block"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("component").alias("ca"))
    right = rows.select("token", F.explode(F.array(block, block - 1, block + 1)).alias("block"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("component").alias("cb"))
    # Two sets that link have their first common shingle where the overlap they need can still follow, in both.
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    reach = (F.col("pa") <= F.col("na") - need) & (F.col("pb") <= F.col("nb") - need)
    fits = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
    rest = left.join(right, ["token", "block"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits & reach)
    return first.union(_verified(rest.select("a", "b").distinct(), sets, percent))


def join(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75, rows_per_chunk: int = 1000) -> DataFrame:
    """Columns key, n_shingles, component: one row per document. Two link at ``percent`` of their union or more."""
    docs = stored(survivors(df, key, text, size, percent, rows_per_chunk), "sets")
    may = docs.where(F.col("sig").isNotNull())
    reps = may.groupBy("sig", "n").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    once = may.where("tokens is not null").select("sig", "prefix", "tokens").withColumn("i", F.row_number().over(W.partitionBy("sig").orderBy("prefix"))).where("i = 1")
    sets = stored(once.join(reps, "sig").where("rep is not null").select("rep", "n", "prefix", "tokens", "sig"), "reps")
    named = components(stored(links(sets.drop("sig"), percent), "edges"))
    placed = sets.select("sig", "rep").join(named.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.select("sig", F.coalesce("component", "rep").alias("component"))
    some = may.select("key", "n", "sig").join(placed, "sig", "left").select("key", "n", F.coalesce("component", "key").alias("component"))
    none = docs.where(F.col("sig").isNull()).select("key", "n", F.col("key").alias("component"))
    return some.union(none).select("key", F.col("n").alias("n_shingles"), "component")
