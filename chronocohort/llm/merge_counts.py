"""Token counts by byte-pair merging with a heap over a linked list of symbols.

The count of a piece is its number of bytes minus the merges that were possible, so no identifiers are made. Counts of
pieces are remembered in each worker up to a stated number of entries; forgetting them changes the time only.
Null and empty texts count 0; repeated rows stay repeated; there is no shuffle.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from chronocohort.llm.carried import ROW, packed, unpacked
from chronocohort.llm.presplit import WHITE, safe_pieces

REMEMBERED = 500_000
LONGEST_REMEMBERED = 64
_UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
# Fixed value: the pre-tokenizer's pattern, with its white space spelled out.
_PIECE = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeCounter(dict):
    """Text unit to token count; a unit is white space and the other characters after it."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        merges = (m.split(" ") if isinstance(m, str) else m for m in whole["model"]["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.symbols = byte_symbols()
        self.pieces: dict[str, int] = {}
        special = sorted((t["content"] for t in whole.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def merged(self, piece: str) -> int:
        """Symbols left of one piece when no adjacent pair has a rank any more."""
        symbol = [self.symbols[b] for b in piece.encode("utf-8", "surrogatepass")]
        n, rank = len(symbol), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := rank.get((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue
            symbol[i], symbol[j] = a + b, ""
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((symbol[i], symbol[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbol[i], symbol[k]))
            if (h := before[i]) >= 0 and (r := rank.get((symbol[h], symbol[i]))) is not None:
                heapq.heappush(heap, (r, h, symbol[h], symbol[i]))
        return left

    def piece(self, piece: str) -> int:
        count = self.pieces.get(piece)
        if count is None:
            count = self.merged(piece)
            if len(piece) <= LONGEST_REMEMBERED:
                if len(self.pieces) >= REMEMBERED:
                    self.pieces.clear()
                self.pieces[piece] = count
        return count

    def __missing__(self, unit: str) -> int:
        count = sum(map(self.piece, _PIECE.findall(unit)))
        if len(unit) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[unit] = count
        return count

    def count(self, text: str | None) -> int:
        """Tokens of a text; a special string inside it is one token."""
        if not text:
            return 0
        parts, extra = [text], 0
        if self.special is not None:
            parts = self.special.split(text)
            extra = len(parts) - 1
        return extra + sum(sum(map(self.__getitem__, _UNIT.findall(piece))) for part in parts for piece in safe_pieces(part, 1 << 20))


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(df: DataFrame, vocabulary: str, text: str = "text", out: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """Add ``out``: tokens of ``text`` by the merges of a byte-level vocabulary file. An input column of that name goes."""
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != out.lower()]
    source = df.select(packed(kept), F.col(f"`{text}`").alias("source"))
    schema = StructType([source.schema[ROW], StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            done = pa.array([count(x.as_py()) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), done], names=[ROW, "n"])

    return source.mapInArrow(run, schema).select(*unpacked(kept), F.col("n").alias(out))
