"""Byte-level BPE with the tiktoken library: texts to packed ids and back to bytes.

Long texts are cut at safe boundaries, so that one pattern match never spans a whole document. Rows keep their place:
there is no shuffle. Null and empty texts give no ids, empty ids decode to no bytes, repeated rows stay repeated, and
an input column with the name of an output is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from chronocohort.llm.carried import ROW, packed, unpacked
from chronocohort.llm.presplit import WHITE, safe_pieces

# The library's pattern engine backtracks over white space and runs out of stack on very long runs.
_LONG_WHITE = re.compile(f"[{WHITE}]{{4096,}}")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a local rank file, read once in each Python worker."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(rank_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _ids(piece: str, codec: tiktoken.Encoding) -> Iterator[list[int]]:
    """Ids by part. Of a long run of white space, all but the last character (all, at the end) are one match."""
    start = 0
    for run in _LONG_WHITE.finditer(piece):
        end = run.end() if run.end() == len(piece) else run.end() - 1
        yield codec.encode_ordinary(piece[start : run.start()])
        yield codec._encode_single_piece(piece[run.start() : end])
        start = end
    yield codec.encode_ordinary(piece[start:])


def encode_text(text: str | None, codec: tiktoken.Encoding) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    if not text:
        return b""
    return b"".join(np.asarray(ids, dtype="<u4").tobytes() for piece in safe_pieces(text) for ids in _ids(piece, codec))


def decode_ids(packed: bytes | None, codec: tiktoken.Encoding) -> bytes:
    return codec.decode_bytes(np.frombuffer(packed, dtype="<u4").tolist()) if packed else b""


def _mapped(df: DataFrame, column: str, out: str, keep: list[str] | None, rank_file: str, pattern: str, work: Callable) -> DataFrame:
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != out.lower()]
    source = df.select(packed(kept), F.col(f"`{column}`").alias("source"))
    schema = StructType([source.schema[ROW], StructField("done", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(rank_file, pattern)
        for batch in batches:
            done = pa.array([work(x.as_py(), codec) for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), done], names=[ROW, "done"])

    return source.mapInArrow(run, schema).select(*unpacked(kept), F.col("done").alias(out))


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """Add ``ids`` (packed, binary). ``keep`` names the columns to carry on; the default is all of them."""
    return _mapped(df, text, ids, keep, rank_file, pattern, encode_text)


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "token_ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Add ``out``: the bytes that the packed ids stand for."""
    return _mapped(df, ids, out, keep, rank_file, pattern, decode_ids)


def n_tokens(ids: str = "token_ids"):
    """Number of packed ids."""
    return (F.octet_length(ids) / 4).cast("bigint")
