"""Merkle manifest of a dataset, checkpointed every few levels (operator 13).

Rows are leaves of one tree per language, and the tops of these trees are the leaves of one more tree. Only
the leaves and every ``STEP``-th level are stored. A proof needs the levels between as well: they are
made again, one aligned subtree of ``2^STEP`` stored nodes at a time, from the nodes stored below it. The
siblings of every node of the subtree are put out, and the subtree is dropped.

* Leaves are numbered within their group by a range partition: each slice numbers its own rows, and the
  counts of the slices before are added. A group that holds most rows spreads over many slices.
* A subtree is a key of its own (group, block), so one task holds at most ``2^STEP`` digests at a time.
* The proof of a stored node comes down to the subtree below it as one more row of that subtree, first in
  order, so texts and leaves are never joined with anything.

A node is ``H`` of its children's hex digests, concatenated; a node without a neighbour becomes ``H`` of
itself alone. A proof is one binary: for every level ``L`` or ``R`` (the side of the sibling) and the sibling's 32
bytes, or ``-`` where there is none.

Defined results: null fields are ``-`` in the leaf; a null doc_id comes first in its group, a null lang is the first
group; rows with one doc_id are ordered by leaf, and repeated rows are leaves of their own; empty and very
long texts are hashed whole; an empty table has no rows and no root; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tokenlake.llm.common import written

#: levels between two stored ones: subtrees of 1024 nodes
STEP = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
OUT_ROWS = 4096

_NODE = "gkey string, idx long, n long, digest binary"
_PROOF = "gkey string, idx long, digest binary, proof binary, subroot binary, root binary"


# ---------------------------------------------------------------- hashes


def hash_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def row_hash(values: list[Column]) -> Column:
    """Hex digest of a row: each value ``-`` if null, else its UTF-8 length, a colon and itself."""
    field = lambda v: F.coalesce(F.concat(F.octet_length(v.cast("string")), F.lit(":"), v.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(field, values)), 256)


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    return max(n - 1, 0).bit_length()


def subtree(nodes: list[str], folds: int) -> list[list[str]]:
    """The levels over ``nodes``, lowest first, ``folds`` of them above the nodes themselves."""
    levels = [nodes]
    for _ in range(folds):
        below = levels[-1]
        levels.append([hash_text("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def siblings(levels: list[list[str]], i: int) -> bytes:
    """The proof of node ``i`` of the lowest level, up to the top of its subtree."""
    steps = []
    for level in levels[:-1]:
        side, i = i & 1, i >> 1
        at = 2 * i + 1 - side
        steps.append((b"L" if side else b"R") + bytes.fromhex(level[at]) if at < len(level) else b"-")
    return b"".join(steps)


def read_proof(proof: bytes) -> Iterator[tuple[str, str]]:
    """(side, hex digest of the sibling) by level; side ``-`` has no sibling."""
    at = 0
    while at < len(proof):
        side = chr(proof[at])
        end = at + (1 if side == "-" else 33)
        yield side, proof[at + 1 : end].hex()
        at = end


def fold(leaf: str, proof: bytes) -> str:
    """The root that a leaf and its proof lead to."""
    for side, sibling in read_proof(proof):
        leaf = hash_text(sibling + leaf if side == "L" else leaf + sibling)
    return leaf


# ---------------------------------------------------------------- leaves


def leaves(docs: DataFrame, claimed: dict[str, Column] | None = None) -> DataFrame:
    """(gkey, doc_id, digest, claimed) of every row, written once: texts are read and hashed here only.

    ``claimed`` replaces columns of the copy that is to be verified; its digest is null where nothing differs.
    """
    claimed, same, other = claimed or {}, F.lit(True), F.lit(None).cast("string")
    for name, value in claimed.items():
        same = same & value.eqNullSafe(F.col(name))
    if claimed:
        other = F.when(~same, row_hash([claimed.get(c, F.col(c)) for c in FIELDS]))
    hashed = docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("gkey"), "doc_id",
        F.unhex(row_hash([F.col(c) for c in FIELDS])).alias("digest"), F.unhex(other).alias("claimed"),
    )
    return written(hashed, "merkle-leaves")


def _count_in_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, k = None, 0
    for batch in batches:
        place = []
        for key in batch["gkey"].to_pylist():
            k = k + 1 if key == last else 0
            last = key
            place.append(k)
        yield batch.append_column("k", pa.array(place, pa.int64()))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``idx``, the row's place in its ``gkey`` by ``order``, and ``n``, the rows of that group.

    The last sort key tells repeated rows apart, so that many equal ones need not share a slice.
    """
    keys = ["gkey", *order, "tie"]
    sliced = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    sliced = sliced.drop("tie").withColumn("slice", F.spark_partition_id())
    schema = ", ".join(f"`{name}` {kind}" for name, kind in sliced.dtypes) + ", k long"
    local = written(sliced.mapInArrow(_count_in_slice, schema), "merkle-numbered")
    counts = local.groupBy("gkey", "slice").agg(F.count("*").alias("rows"))
    of_group = Window.partitionBy("gkey")  # over one row per group and slice
    upto = F.sum("rows").over(of_group.orderBy("slice"))
    counts = counts.select("gkey", "slice", (upto - F.col("rows")).alias("before"), F.sum("rows").over(of_group).alias("n"))
    return local.join(counts, ["gkey", "slice"]).withColumn("idx", F.col("before") + F.col("k")).drop("slice", "before", "k")


# ---------------------------------------------------------------- subtrees


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[tuple]]]:
    """Rows by their first two columns, group and block; rows of a block follow each other."""
    rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns), strict=True))
    return ((key, (row[2:] for row in group)) for key, group in groupby(rows, key=lambda row: row[:2]))


def _out(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, OUT_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _folded(step: int, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tops() -> Iterator[tuple]:
            for (gkey, block), rows in _blocks(batches):
                got = list(rows)
                n = got[0][1]
                folds = min(step, height(n))
                top = subtree([digest.hex() for _, _, digest in got], folds)[-1]
                yield gkey, block, -(-n >> folds), bytes.fromhex(top[0])

        yield from _out(tops(), schema)

    return run


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("gkey", "block").sortWithinPartitions("gkey", "block", "idx")


def grow(nodes: DataFrame, step: int = STEP) -> list[DataFrame]:
    """The stored levels (gkey, idx, n, digest), from ``nodes`` to the top of every group."""
    levels = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        below = levels[-1].select("gkey", F.shiftright("idx", step).alias("block"), "idx", "n", "digest")
        levels.append(written(_by_block(below).mapInArrow(_folded(step, _arrow(_NODE)), _NODE), "merkle-level"))
        most = -(-most >> min(step, height(most)))
    return levels


def _extracted(step: int, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def proofs() -> Iterator[tuple]:
            for (gkey, block), rows in _blocks(batches):
                _, _, _, above, subroot, root, *_ = next(rows)  # idx -1: what lies above the subtree
                got = list(rows)
                levels = subtree([row[2].hex() for row in got], min(step, height(got[0][1])))
                for i, (idx, _, digest, _, _, _, *carried) in enumerate(got):
                    yield gkey, idx, digest, siblings(levels, i) + above, subroot, root, *carried

        yield from _out(proofs(), schema)

    return run


def extract(levels: list[DataFrame], above: DataFrame, carry: dict[str, str], step: int = STEP) -> DataFrame:
    """The proof of every row of ``levels[0]``, its ``carry`` columns kept.

    ``above`` (gkey, idx, proof, subroot, root) has the proof of every group's top. Stored levels are
    gone through from the top, so a level's proofs are ready when the level below needs them.
    """
    for k in range(len(levels) - 1, -1, -1):
        extra = carry if k == 0 else {}
        block = F.shiftright("idx", step).alias("block")
        nothing = [F.lit(None).cast("binary").alias(c) for c in ("proof", "subroot", "root")]
        below = levels[k].select("gkey", block, "idx", "n", "digest", *nothing, *extra)
        head = above.select(
            "gkey", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"), F.lit(None).cast("long").alias("n"),
            F.lit(None).cast("binary").alias("digest"), "proof", "subroot", "root", *[F.lit(None).cast(t).alias(c) for c, t in extra.items()],
        )
        ddl = ", ".join([_PROOF, *(f"`{c}` {t}" for c, t in extra.items())])
        above = _by_block(below.unionByName(head)).mapInArrow(_extracted(step, _arrow(ddl)), ddl)
        if k:
            above = written(above, "merkle-proofs")
    return above


# ---------------------------------------------------------------- the manifest


def manifest(rows: DataFrame, step: int = STEP) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stored levels of the groups' trees over ``leaves`` rows, and those of the tree over the groups."""
    trees = grow(numbered(rows, ["doc_id", "digest"]), step)
    tops = trees[-1].select(F.lit("").alias("gkey"), F.col("gkey").alias("name"), "digest")
    return trees, grow(numbered(tops, ["name"]), step)


def proofs(rows: DataFrame, step: int = STEP) -> DataFrame:
    """(gkey, idx, digest, proof, subroot, root, doc_id, claimed) of every row of ``leaves``."""
    trees, top = manifest(rows, step)
    none = F.lit(None).cast("binary")
    root = top[-1].select("gkey", "idx", F.lit(b"").cast("binary").alias("proof"), none.alias("subroot"), F.col("digest").alias("root"))
    groups = extract(top, root, {"name": "string"}, step)
    above = groups.select(F.col("name").alias("gkey"), F.lit(0).cast("long").alias("idx"), "proof", F.col("digest").alias("subroot"), "root")
    kinds = dict(rows.dtypes)
    return extract(trees, written(above, "merkle-groups"), {"doc_id": kinds["doc_id"], "claimed": "binary"}, step)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told, sums = [], []
        for digest, claimed, proof in zip(*(batch[c].to_pylist() for c in ("digest", "claimed", "proof")), strict=True):
            told.append(fold((claimed or digest).hex(), proof))
            sums.append(hash_text("".join(sibling for _, sibling in read_proof(proof))))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], *(batch[c] for c in ("digest", "subroot", "root")), pa.array(sums, pa.string()), pa.array(told, pa.string())],
            ["doc_id", "digest", "subroot", "root", "proof_sha256", "folded_root"],
        )


def verify(proven: DataFrame) -> DataFrame:
    """Folds every claimed row, else the row itself, with its proof and compares the result with the root.

    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), digests as hex.
    """
    kind = dict(proven.dtypes)["doc_id"]
    schema = f"doc_id {kind}, digest binary, subroot binary, root binary, proof_sha256 string, folded_root string"
    told = proven.select("doc_id", "digest", "subroot", "root", "claimed", "proof").mapInArrow(_verified, schema)
    text = lambda c: F.lower(F.hex(c))
    return told.select(
        "doc_id", text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == text("root")).alias("verified"),
    )
