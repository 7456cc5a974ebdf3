"""Merkle manifest of a table: a digest per row, a root per tree, and for each row the
siblings that lead from its digest to the root.

Leaves of a tree stand in order; each ``fanout`` consecutive nodes become the hash of
their digests, level by level, until one is left. The leaves are cut into aligned
blocks of a power of the fanout, and each block hashes its own levels. Above them the
blocks run a butterfly exchange: in round j, blocks at the same place of neighbouring
groups of ``fanout ** j`` blocks swap the roots of their groups, and each hashes the
next root for itself. Every block so ends with the root of the tree and all siblings on
the way there; nothing is handed down again. A round is a join of one small row per
block, however many leaves there are, and no task sees a whole tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rolecall.session import materialize

#: Nodes that become one, and levels that a block hashes by itself.
FANOUT, BLOCK_LEVELS = 3, 7

#: One level of a proof: which of its run the node is, and the digests of the others.
PROOF = "array<struct<place:int,siblings:array<string>>>"

_PROOF = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))]))


def digest(*columns: str | Column) -> Column:
    """The digest of a row: lower-case hex sha256 of each value, ``-`` if null, else its
    UTF-8 byte count, a colon and the value as text."""
    values = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
                             for v in values]), 256)


def proof_digest(proof: str) -> Column:
    """sha256 of all sibling digests of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda level: level["siblings"])), ""), 256)


def folded(leaf: str | Column, proof: str) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    def up(node: Column, level: Column) -> Column:
        before = F.slice(level["siblings"], F.lit(1), level["place"])
        after = F.slice(level["siblings"], level["place"] + 1, F.size(level["siblings"]))
        return F.sha2(F.concat(F.array_join(before, ""), node, F.array_join(after, "")), 256)

    return F.aggregate(proof, F.col(leaf) if isinstance(leaf, str) else leaf, up)


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _levels(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes of each level, the leaves first."""
    rows = [nodes]
    for _ in range(levels):
        nodes = [_hash(nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
        rows.append(nodes)
    return rows


def _height(leaves: int, most: int, fanout: int) -> int:
    """Levels above the leaves, ``most`` at most."""
    levels, width = 0, 1
    while width < leaves and levels < most:
        levels, width = levels + 1, width * fanout
    return levels


def _blocks_of(columns: list[str]):
    """Rows sorted by block and rank, block by block, as lists of columns. A block is bounded, so
    it is brought together, also across Arrow batches."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = list(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist()))
            first = 0
            for row, key in enumerate(keys):
                last = keys[row - 1] if row else held and (held[-1].column("tree")[-1].as_py(), held[-1].column("block")[-1].as_py())
                if last and key != last:
                    held.append(batch.slice(first, row - first))
                    yield _combined(held, columns)
                    held, first = [], row
            held.append(batch.slice(first))
            held = [h for h in held if h.num_rows]
        if held:
            yield _combined(held, columns)
    return blocks


def _combined(held: list[pa.RecordBatch], columns: list[str]) -> dict[str, pa.Array]:
    table = pa.Table.from_batches([h for h in held if h.num_rows])
    return {c: table.column(c).combine_chunks() for c in columns}


def _block_roots(fanout: int, levels: int):
    blocks = _blocks_of(["tree", "block", "leaves", "leaf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            leaves = block["leaves"][0].as_py()
            top = _levels(block["leaf"].to_pylist(), _height(leaves, levels, fanout), fanout)[-1]
            yield pa.record_batch([block["tree"].slice(0, 1), block["block"].slice(0, 1), pa.array([leaves]),
                                   pa.array(top, pa.string())], names=["tree", "block", "leaves", "node"])
    return run


def _with_proofs(fanout: int, levels: int, keep: list[str]):
    handed = ["tree", "leaf", "subroot", "root"]
    blocks = _blocks_of([*handed, "leaves", "upper", *keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            leaves = block["leaf"].to_pylist()
            height = _height(block["leaves"][0].as_py(), levels, fanout)
            rows = _levels(leaves, height, fanout)
            upper = block["upper"][0].as_py()
            for first in range(0, len(leaves), 512):
                proofs = []
                for at in range(first, min(first + 512, len(leaves))):
                    proof = []
                    for nodes in rows[:height]:
                        low = at - at % fanout
                        run_ = nodes[low:low + fanout]
                        place = at % fanout
                        proof.append({"place": place, "siblings": run_[:place] + run_[place + 1:]})
                        at //= fanout
                    proofs.append(proof + upper)
                count = len(proofs)
                yield pa.record_batch(
                    [block[c].slice(first, count) for c in handed] + [pa.array(proofs, _PROOF)]
                    + [block[c].slice(first, count) for c in keep], names=[*handed, "proof", *keep])
    return run


def _ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank`` within the tree, from 0, and ``leaves``, the size of the tree: sorted in
    ranges, and the sizes of the ranges added up, so that a large tree is many ranges."""
    low = (1 << 33) - 1  # the place within its range is in the lower 33 bits
    by = [F.col("tree").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    placed = materialize(
        leaves.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
        .withColumns({"range": F.shiftright("place", 33), "place": F.col("place").bitwiseAND(F.lit(low))}), "leaves")
    # One row per tree and range it reaches into: as many as trees and ranges together.
    parts = placed.groupBy("tree", "range").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    of_tree = Window.partitionBy("tree")
    before = of_tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(parts.select(
        F.col("tree").alias("of"), F.col("range").alias("within"), F.sum("n").over(of_tree).alias("leaves"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base")), "bases")
    return placed.join(bases, F.col("tree").eqNullSafe(F.col("of")) & (F.col("range") == F.col("within"))).withColumn(
        "rank", F.col("base") + F.col("place")).drop("of", "within", "base", "place", "range")


def _butterfly(blocks: DataFrame, fanout: int, label: str) -> DataFrame:
    """(tree, block, node, upper): the root of each block's tree, and the proof from the block's own
    root to it. ``blocks``: (tree, block, node), blocks numbered from 0."""
    of_tree = Window.partitionBy("tree")
    state = materialize(blocks.select("tree", "block", "node", F.max("block").over(of_tree).alias("last")).withColumn(
        "upper", F.array().cast(PROOF)), label)
    most = state.agg(F.max("last")).first()[0] or 0
    width = 1
    while width <= most:
        span = width * fanout
        aligned = F.col("block") - F.col("block") % span
        # The groups beside one's own, and of each the block at one's own place in it. The last group of
        # a tree may lack that place: its blocks then serve those places in turn.
        start = F.explode(F.sequence(aligned, F.least(aligned + span - 1, F.col("last")), F.lit(width).cast("bigint")))
        present = F.least(F.lit(width).cast("bigint"), F.col("last") - F.col("start") + 1)
        asked = state.select("tree", "block", "last", start.alias("start")).select(
            F.col("tree").alias("of"), F.col("block").alias("asker"), "start",
            (F.col("start") + F.col("block") % F.lit(width) % present).alias("partner"))
        swapped = asked.join(state.select("tree", "block", "node"), F.col("of").eqNullSafe(F.col("tree")) & (
            F.col("partner") == F.col("block"))).groupBy("of", "asker").agg(
            F.array_sort(F.collect_list(F.struct("start", "node"))).alias("run"))  # fanout rows at most
        place = ((F.col("block") % span - F.col("block") % width) / width).cast("int")
        nodes = F.transform("run", lambda n: n["node"])
        others = F.concat(F.slice(nodes, F.lit(1), place), F.slice(nodes, place + 2, F.lit(fanout)))
        level = F.struct(place.alias("place"), others.alias("siblings"))
        done = F.col("last") < width  # this tree has its root already
        state = materialize(state.join(swapped, F.col("tree").eqNullSafe(F.col("of")) & (F.col("block") == F.col("asker"))).select(
            "tree", "block", "last",
            F.when(done, F.col("node")).otherwise(F.sha2(F.array_join(nodes, ""), 256)).alias("node"),
            F.when(done, F.col("upper")).otherwise(F.concat("upper", F.array(level))).alias("upper")), label)
        width = span
    return state.select("tree", "block", "node", "upper")


def _checked(fanout: int, block_levels: int) -> None:
    if fanout < 2 or block_levels < 0:
        raise ValueError("the fanout must be 2 at least, levels of a block not negative")


def _blocks(leaves: DataFrame, order: list[str], fanout: int, block_levels: int) -> tuple[DataFrame, DataFrame]:
    """The leaves with their rank and block, and (tree, block, node, upper) of each block."""
    size = fanout ** block_levels
    # Equal rows are told apart by where they were read, so that they may lie in several ranges.
    placed = _ranked(leaves.withColumn("_nth", F.monotonically_increasing_id()), [*order, "leaf", "_nth"]).drop("_nth")
    dealt = materialize(placed.withColumn("block", F.floor(F.col("rank") / size)), "dealt")
    by = ["tree", "block"]
    tops = materialize(dealt.select("tree", "block", "leaves", "rank", "leaf").repartition(*by).sortWithinPartitions(*by, "rank")
                       .mapInArrow(_block_roots(fanout, block_levels), "tree string, block bigint, leaves bigint, node string"),
                       "blocks")
    return dealt, _butterfly(tops, fanout, "butterfly")


def _proved(dealt: DataFrame, above: DataFrame, keep: list[str], fanout: int, block_levels: int) -> DataFrame:
    """(tree, leaf, subroot, root, proof, and ``keep``); ``above`` holds (of, within, subroot, root,
    upper) of each block."""
    by = ["tree", "block"]
    whole = dealt.join(above, F.col("tree").eqNullSafe(F.col("of")) & (F.col("block") == F.col("within"))).drop("of", "within")
    fields = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    schema = f"tree string, leaf string, subroot string, root string, proof {PROOF}" + "".join(
        f", `{c}` {fields[c]}" for c in keep)
    return whole.repartition(*by).sortWithinPartitions(*by, "rank").mapInArrow(
        _with_proofs(fanout, block_levels, keep), schema)


def trees(leaves: DataFrame, order: list[str], fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """(tree, leaf, root, proof, and the other columns) of every leaf.

    ``leaves`` holds tree (string, null being a tree of its own), leaf (hex digest) and
    other columns; within a tree they stand in ascending ``order``, nulls first. Rows
    that are equal in it come by digest. A lone leaf is the root and has an empty proof.
    An empty table gives no rows. Rows with equal digests are leaves of their own.
    ``block_levels`` doesn't change the result; a block holds ``fanout ** block_levels``
    leaves in memory.
    """
    _checked(fanout, block_levels)
    keep = [c for c in leaves.columns if c not in ("tree", "leaf")]
    dealt, state = _blocks(leaves, order, fanout, block_levels)
    above = state.select(F.col("tree").alias("of"), F.col("block").alias("within"), F.col("node").alias("subroot"),
                         F.col("node").alias("root"), "upper")
    return _proved(dealt, above, keep, fanout, block_levels).drop("subroot")


def manifest(rows: DataFrame, columns: list[str], tree: str, order: str, fanout: int = FANOUT,
             block_levels: int = BLOCK_LEVELS, also: dict[str, Column] | None = None) -> DataFrame:
    """(order, leaf, subroot, root, proof, and ``also``) of every row: one tree per value
    of ``tree``, and the roots of those, ordered by value with null first, as the leaves
    of the tree above. The proof leads from the leaf by the subroot to the root.

    The digest of a row is that of ``columns``; no other column counts, whatever its
    name. ``also`` are columns made of the row that are handed through, such as the
    digest of what is to be verified; they get the names given. Nulls in any column,
    empty texts and repeated rows are values like any other. A null in ``order`` comes
    first. An empty table gives no rows.
    """
    _checked(fanout, block_levels)
    also = also or {}
    inner = {name: f"_also{i}" for i, name in enumerate(also)}
    leaves = rows.select(F.col(tree).cast("string").alias("tree"), digest(*columns).alias("leaf"),
                         F.col(order).alias("_order"), *[c.alias(inner[n]) for n, c in also.items()])
    dealt, state = _blocks(leaves, ["_order"], fanout, block_levels)
    # One row per tree; where trees are many, they are sorted and hashed in blocks, too.
    tops = state.where("block = 0").select(F.lit("").alias("tree"), F.col("node").alias("leaf"), F.col("tree").alias("name"))
    top = trees(tops, ["name"], fanout, block_levels).select("name", "root", F.col("proof").alias("rest"))
    above = materialize(state.join(top, F.col("tree").eqNullSafe(F.col("name"))).select(
        F.col("tree").alias("of"), F.col("block").alias("within"), F.col("node").alias("subroot"), "root",
        F.concat("upper", "rest").alias("upper")), "above")
    return _proved(dealt, above, ["_order", *inner.values()], fanout, block_levels).select(
        F.col("_order").alias(order), "leaf", "subroot", "root", "proof", *[F.col(i).alias(n) for n, i in inner.items()])
