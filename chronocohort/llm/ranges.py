"""Questions about hashed tokens of all texts, asked by chunks of texts and answered by ranges of hashes.

Texts are dealt over chunks of a stated mean number of rows by a hash of their key. A chunk sends each hash range one
row with its distinct tokens there, packed; a range combines what all chunks sent and answers each chunk with one row.
However many texts hold a token, a range meets it once per chunk, and a chunk once per range, so no group grows with a
hot token. The exchange of texts by chunk is the same subtree in every step, which lets Spark reuse it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SENT = "part bigint, chunk bigint, payload binary"
ANSWERED = "chunk bigint, answer binary"


def chunk_count(df: DataFrame, rows_per_chunk: int) -> int:
    """Chunks for a mean of ``rows_per_chunk`` rows; counting reads no text column."""
    return max(1, -(-df.count() // rows_per_chunk))


def chunked(df: DataFrame, key: str, text: str, chunks: int, row: str | None = None) -> DataFrame:
    """Columns chunk, key, text (and row); equal keys with equal texts share a chunk. Rows without a key stay, by text."""
    chosen = df.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), *([F.col(f"`{row}`").alias("row")] if row else []))
    return chosen.select(F.pmod(F.xxhash64("key", "text"), F.lit(chunks)).alias("chunk"), *chosen.columns)


def parts(tokens: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``count`` equal ranges sorted 64-bit tokens are in, and where each of these starts (one more entry)."""
    of = ((tokens >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    head = np.ones(len(of), bool)
    head[1:] = of[1:] != of[:-1]
    first = np.flatnonzero(head)
    return of[first].astype(np.int64), np.append(first, len(of))


def sent(chunk: int, tokens: np.ndarray, columns: list[np.ndarray], count: int) -> pa.Table:
    """One row per range that has some of the chunk's tokens (sorted, distinct): tokens, then the other columns, packed."""
    used, cut = parts(tokens, count)
    payload = [b"".join(c[a:b].tobytes() for c in (tokens, *columns)) for a, b in zip(cut, cut[1:])]
    return pa.table({"part": pa.array(used, pa.int64()), "chunk": pa.array(np.full(len(used), chunk), pa.int64()), "payload": pa.array(payload, pa.binary())})


def sent6(chunk: int, tokens: np.ndarray, codes: np.ndarray, count: int) -> pa.Table:
    """As ``sent``, with 48-bit codes in six bytes in place of the tokens."""
    used, cut = parts(tokens, count)
    raw = codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    payload = [raw[a:b].tobytes() for a, b in zip(cut, cut[1:])]
    return pa.table({"part": pa.array(used, pa.int64()), "chunk": pa.array(np.full(len(used), chunk), pa.int64()), "payload": pa.array(payload, pa.binary())})


def unpack6(payload: bytes) -> list[np.ndarray]:
    raw = np.zeros((len(payload) // 6, 8), np.uint8)
    raw[:, :6] = np.frombuffer(payload, np.uint8).reshape(-1, 6)
    return [raw.view("<u8").ravel()]


def unpack(payload: bytes, kinds: list) -> list[np.ndarray]:
    width = sum(np.dtype(k).itemsize for k in kinds)
    n, at, out = len(payload) // width, 0, []
    for kind in kinds:
        out.append(np.frombuffer(payload, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def answer_by_range(sent_rows: DataFrame, kinds: list, combine: Callable, six: bool = False) -> DataFrame:
    """``combine(tokens, chunk index, columns)`` sees all that a range got and returns a mask and columns to send back.

    The answer to a chunk holds the tokens that the mask keeps, then the columns, packed as they were sent.
    """

    def run(table: pa.Table) -> pa.Table:
        chunks = np.asarray(table.column("chunk"))
        received = [unpack6(p.as_py()) if six else unpack(p.as_py(), kinds) for p in table.column("payload")]
        sizes = np.array([len(r[0]) for r in received])
        whole = [np.concatenate([r[k] for r in received]) for k in range(len(kinds))]
        del received
        owner = np.repeat(np.arange(len(chunks)), sizes)
        mask, columns = combine(whole[0], owner, whole[1:])
        first = np.concatenate([[0], np.cumsum(sizes)])
        out_chunk, out = [], []
        for i, chunk in enumerate(chunks):
            kept = np.flatnonzero(mask[first[i] : first[i + 1]]) + first[i]
            if len(kept):
                out_chunk.append(int(chunk))
                out.append(b"".join(c[kept].tobytes() for c in (whole[0], *columns)))
        return pa.table({"chunk": pa.array(out_chunk, pa.int64()), "answer": pa.array(out, pa.binary())})

    return sent_rows.groupBy("part").applyInArrow(run, ANSWERED)


def ask(texts: DataFrame, work: Callable[[int, pa.Table], pa.Table], schema: str = SENT) -> DataFrame:
    """``work(chunk, table)`` once for each chunk."""

    def run(table: pa.Table) -> pa.Table:
        return work(table.column("chunk")[0].as_py(), table)

    return texts.groupBy("chunk").applyInArrow(run, schema)


def tell(texts: DataFrame, answers: DataFrame, work: Callable, kinds: list, schema: str) -> DataFrame:
    """``work(chunk, table, answer columns)`` once for each chunk; answers come sorted by token."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        pieces = [unpack(a.as_py(), kinds) for a in told.column("answer")]
        columns = [np.concatenate([p[k] for p in pieces]) if pieces else np.zeros(0, kinds[k]) for k in range(len(kinds))]
        order = np.argsort(columns[0], kind="stable")
        return work(table.column("chunk")[0].as_py(), table, [c[order] for c in columns])

    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def member(tokens: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are in the sorted array ``of``, and where."""
    if not len(of):
        return np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(of, tokens), len(of) - 1)
    return of[at] == tokens, at
