"""Merkle manifest of a table as a persistent tree: one tree of all rows, and a version of it for each changed row.

1. A leaf is the digest of a row's columns (``-`` for null, else byte count, colon, value). Texts are hashed where they are
   read; from then on a row is its key, its group and one or two digests.
2. Leaves get their place within their group from one range sort: the place in a sorted range plus the rows of the group
   in earlier ranges. No group is held as a whole, so one group may be the whole table.
3. Every 2^``levels`` consecutive nodes of a group are an aligned block, one row. A block's own subtree is grown in one task;
   the roots of all blocks are the nodes of the next round, until each group has its subroot. Subroots, in order of their
   group, are the leaves of the tree on top, grown the same way. There are log2(rows) / levels rounds.
4. Paths come back down: a block gets the siblings above it, which are few, by a join on (group, block).
5. A changed row makes a version: the nodes from its leaf to the root are copied and hashed anew, all others are shared
   with the tree. A version starts in its aligned block and goes on along the block's upper path in the same task, so it
   never meets the other versions, however many there are above one block.

Nodes of two children hash both hexadecimal digests joined; the last node of an odd row hashes its only child.

Nulls: a null column is ``-``; a null group is a group of its own and comes first; null keys come first in their group.
Rows with equal keys follow each other in order of their leaves, repeated rows are leaves each. Very long texts are one
digest. An empty table has no rows and no root. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronocohort.llm.components import stored

LEVELS = 8

_ROOTS = "group string, block bigint, n bigint, digest binary"
_PATHS = "group string, at bigint, path binary, subroot binary, root binary"
_NONE, _LEFT, _RIGHT = b"0", b"1", b"2"
_STEP = 65


def digest(columns: Sequence[Column]) -> Column:
    """Digest of one row: each value with its length in bytes before it, so that no two rows read alike."""
    text = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]
    return F.sha2(F.concat(*parts), 256)


def leaves(df: DataFrame, key: str, group: str, columns: Sequence[str], change: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """Columns key, group, leaf, changed: the digest of each row, and of the row with ``change`` made in it ``where`` asked."""
    plain = {c: F.col(f"`{c}`") for c in columns}
    changed = F.when(where, digest([*({**plain, **change}).values()])) if change else F.lit(None).cast("string")
    return df.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").cast("string").alias("group"),
        F.encode(digest([*plain.values()]), "UTF-8").alias("leaf"), F.encode(changed, "UTF-8").alias("changed"),
    )


def placed(nodes: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Columns ``at`` (from 0 within the group) and ``n`` (rows of the group) added, by one range sort of stored rows."""
    nodes = stored(nodes.withColumn("spread", F.monotonically_increasing_id()), f"{name}-rows")
    by = ["group", *order, "spread"]  # equal rows may lie in any order, and need not lie in one range
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranges = nodes.repartitionByRange(*by).sortWithinPartitions(*by).drop("spread")
    ranges = stored(ranges.select("*", F.spark_partition_id().alias("range"), place.alias("place")), f"{name}-ranges")
    sizes = ranges.groupBy("group", "range").agg(F.min("place").alias("first"), F.count("*").alias("size"))
    earlier = W.partitionBy("group").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("group").alias("g"), F.col("range").alias("r"), (F.coalesce(F.sum("size").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("size").over(W.partitionBy("group")).alias("n"),
    )
    met = ranges.join(sizes, (F.col("range") == F.col("r")) & F.col("group").eqNullSafe(F.col("g")))
    return met.withColumn("at", F.col("place") + F.col("shift")).drop("range", "place", "first", "g", "r", "shift")


def grown(row: list[bytes], levels: int) -> list[list[bytes]]:
    """A row of nodes and the rows above it."""
    rows = [row]
    for _ in range(levels):
        row = [hashlib.sha256(b"".join(row[i : i + 2])).hexdigest().encode() for i in range(0, len(row), 2)]
        rows.append(row)
    return rows


def depth(n: int, levels: int) -> int:
    """Levels that a block of a group of n nodes grows."""
    return min(levels, (n - 1).bit_length())


def siblings(rows: list[list[bytes]], at: int) -> bytes:
    """Packed path from node ``at`` of the lowest row: at each level the sibling's side and digest, if there is one."""
    path = []
    for row in rows[:-1]:
        other = at ^ 1
        path.append(_NONE + b" " * (_STEP - 1) if other >= len(row) else (_LEFT if other < at else _RIGHT) + row[other])
        at >>= 1
    return b"".join(path)


def fold(leaf: bytes, path: bytes) -> list[bytes]:
    """The nodes above a leaf, copied along its path: the last one is the root of this leaf's version."""
    nodes = []
    for at in range(0, len(path), _STEP):
        side, other = path[at : at + 1], path[at + 1 : at + _STEP]
        leaf = hashlib.sha256(other + leaf if side == _LEFT else leaf + other if side == _RIGHT else leaf).hexdigest().encode()
        nodes.append(leaf)
    return nodes


def digests_of(path: bytes) -> list[bytes]:
    return [path[at + 1 : at + _STEP] for at in range(0, len(path), _STEP) if path[at : at + 1] != _NONE]


def _blocks(nodes: DataFrame, levels: int, *more: str) -> DataFrame:
    """One row per aligned block with its nodes in order."""
    own = F.sort_array(F.collect_list(F.struct("at", "digest", *more)))
    return nodes.groupBy("group", F.shiftright("at", levels).alias("block")).agg(F.max("n").alias("n"), own.alias("nodes"))


def _each(batch: pa.RecordBatch, part: str) -> Iterator[list]:
    column = batch.column(batch.schema.get_field_index("nodes"))
    values = column.flatten().field(part).to_pylist()
    ends = column.offsets.to_pylist()
    return (values[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:]))


def _roots(blocks: DataFrame, levels: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_pylist()
            top = [grown(row, depth(n, levels))[-1][0] for row, n in zip(_each(batch, "digest"), sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(top, pa.binary())], names=["group", "block", "n", "digest"])

    return blocks.select("group", "block", "n", "nodes").mapInArrow(run, _ROOTS)


@dataclass
class Grown:
    """Stored rounds of blocks, lowest first, and the root of every group."""

    rounds: list[DataFrame]
    roots: DataFrame


def climb(nodes: DataFrame, name: str, levels: int, *more: str) -> Grown:
    """Blocks of blocks, until every group is one node."""
    rounds, done = [], []
    while True:
        rounds.append(stored(_blocks(nodes, levels, *(more if not rounds else ())), f"{name}-blocks"))
        roots = stored(_roots(rounds[-1], levels), f"{name}-roots")
        done.append(roots.where(F.col("n") <= 1 << levels).select("group", "digest"))
        open_ = roots.where(F.col("n") > 1 << levels)
        if open_.isEmpty():
            break
        nodes = open_.select("group", F.col("block").alias("at"), F.ceil(F.col("n") / (1 << levels)).alias("n"), "digest")
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return Grown(rounds, whole)


def _down(blocks: DataFrame, ends: DataFrame, paths: DataFrame | None, levels: int) -> DataFrame:
    """Blocks with the path above them: from ``ends`` where the group ends with this block, from ``paths`` else."""
    above = ends.withColumn("end", F.lit(True))
    if paths is not None:
        above = above.unionByName(paths.withColumn("end", F.lit(False)))
    known = above.select(F.col("group").alias("g"), F.col("at").alias("b"), "path", "subroot", "root", "end")
    on = (F.col("block") == F.col("b")) & F.col("group").eqNullSafe(F.col("g")) & ((F.col("n") <= 1 << levels) == F.col("end"))
    return blocks.join(known, on).drop("g", "b", "end")


def _lowest(tree: Grown, ends: DataFrame, name: str, levels: int) -> DataFrame:
    """The lowest blocks with the path above them, carried down round by round."""
    paths = None
    for blocks in reversed(tree.rounds[1:]):
        paths = stored(_paths(_down(blocks, ends, paths, levels), levels), f"{name}-paths")
    return _down(tree.rounds[0], ends, paths, levels)


def _paths(blocks: DataFrame, levels: int, label: bool = False) -> DataFrame:
    """One row per node with its path to the root. With ``label`` the nodes are subroots and name the groups they top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = {name: batch.column(name).to_pylist() for name in ("group", "n", "path", "subroot", "root")}
            for i, (row, places, names) in enumerate(zip(_each(batch, "digest"), _each(batch, "at"), _each(batch, "label" if label else "at"))):
                rows = grown(row, depth(read["n"][i], levels))
                path = [siblings(rows, k) + read["path"][i] for k in range(len(row))]
                columns = [names, [0] * len(row), path, row, [read["root"][i]] * len(row)] if label else [
                    [read["group"][i]] * len(row), places, path, [read["subroot"][i]] * len(row), [read["root"][i]] * len(row)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=["group", "at", "path", "subroot", "root"])

    return blocks.mapInArrow(run, _PATHS)


_TYPES = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def manifest(rows: DataFrame, detail: bool = False, levels: int = LEVELS) -> DataFrame:
    """From ``leaves`` to one row per leaf: key, group, at, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``proof_sha256`` is the digest of the path's siblings, ``folded_root`` the root of the version that the changed leaf (the
    leaf itself, if unchanged) makes. With ``detail`` also ``siblings`` and ``copied``, the version's own nodes, leaf first.
    """
    named = rows.withColumnRenamed("leaf", "digest")
    tree = climb(placed(named, ["key", "digest"], "leaves"), "tree", levels, "key", "changed")
    subroots = tree.roots.select(F.col("group").alias("label"), "digest")
    # The groups are leaves of one group, in order of their names; a null name is ordered as null.
    top = climb(placed(subroots.select(F.lit("").alias("group"), "label", "digest"), ["label"], "groups"), "top", levels, "label")
    root = top.roots.select("group", F.lit(0).cast("bigint").alias("at"), F.lit(b"").alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    subroot_paths = stored(_paths(_lowest(top, root, "top", levels), levels, label=True), "subroots")
    whole = _lowest(tree, subroot_paths, "tree", levels)
    extra = ", siblings array<string>, copied array<string>" if detail else ""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = {name: batch.column(name).to_pylist() for name in ("group", "n", "path", "subroot", "root")}
            flat = batch.column("nodes").flatten()
            out: list[list] = [[] for _ in range(8)]
            for i, (row, changed) in enumerate(zip(_each(batch, "digest"), _each(batch, "changed"))):
                tree_rows = grown(row, depth(read["n"][i], levels))
                for k, (leaf, other) in enumerate(zip(row, changed)):
                    path = siblings(tree_rows, k) + read["path"][i]
                    others, version = digests_of(path), [other or leaf, *fold(other or leaf, path)]
                    made = [read["group"][i], leaf, read["subroot"][i], read["root"][i], hashlib.sha256(b"".join(others)).hexdigest(), version[-1]]
                    for column, value in zip(out, [*made, others, version if other else []]):
                        column.append(value)
            text = [pa.array(c, pa.binary()).cast(pa.string()) if k not in (0, 4) else pa.array(c, pa.string()) for k, c in enumerate(out[:6])]
            same = pa.array([a == b for a, b in zip(out[3], out[5])], pa.bool_())
            lists = [pa.array([[x.decode() for x in c] for c in column], pa.list_(pa.string())) for column in out[6:]] if detail else []
            columns = [flat.field("key"), text[0], flat.field("at"), *text[1:], same, *lists]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["key", "group", "at", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + (["siblings", "copied"] if detail else [])
    schema = f"key {kind}, group string, at bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean{extra}"
    return whole.select("group", "n", "path", "subroot", "root", "nodes").mapInArrow(run, schema)


def versions(detailed: DataFrame) -> DataFrame:
    """The nodes that each version owns, of a manifest with ``detail``: key, group, level (0 is the leaf), digest.

    Everything else of a version is the tree's own: its root is the node of the highest level.
    """
    return detailed.where(F.size("copied") > 0).select("key", "group", F.posexplode("copied").alias("level", "digest"))
