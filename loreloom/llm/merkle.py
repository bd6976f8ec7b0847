"""Merkle manifest of a dataset as a postorder append log, with proofs addressed by closed-form positions.

``H`` is the lowercase hex SHA-256 of its inputs joined, digests as hex text. A leaf is ``H`` of a row's fields, each ``-`` if null, else
its UTF-8 byte count, ``:`` and its value. Leaves of a group ascend; every two consecutive nodes become one, the last one of an odd
level alone, until one is left: the group's root. The groups' roots, in the groups' order, give the dataset's root in the same way.

The log holds a group's nodes in the order in which they are complete when leaves are appended: a leaf, then every node it ends. Leaf
``j`` stands at ``2j - ones(j)``, with the number of one bits in j, since so many nodes are complete before it; a node of level l stands
l places after its last leaf. Nodes at the right edge that never fill up follow at the end, lowest level first (``position``). So

* builders work on aligned blocks of ``2 ** BITS`` leaves, each on its own, and write one contiguous run of the log;
* the blocks' roots are the leaves of the next tier, again in aligned blocks, until each group has one node;
* a proof needs no search: the siblings on a leaf's path have known positions. Those below the block's root lie in the block's own
  run; those above are joined by position, for block roots only, so a proof costs a leaf no join of its own.

Leaves get their place in the group by a range-partitioned sort and counts per partition, so one group may hold nearly all rows.

Rows with equal order values stand in the order of their leaves; a null order value comes first, as does the null group. A repeated
row is a leaf of its own. Null and empty texts are told apart (``-`` and ``0:``); texts are hashed whole, at any length. An empty
table has an empty log and no proofs. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loreloom.llm.tables import stage

#: A builder's block holds ``2 ** BITS`` nodes.
BITS = 10


def leaf_text(*fields: Column) -> Column:
    """The fields as one unambiguous text."""
    texts = [f.cast("string") for f in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def leaf(*fields: Column) -> Column:
    return F.sha2(leaf_text(*fields), 256)


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def position(level: int, index: int, size: int) -> int:
    """Place in the log of the node ``index`` of a level, in a group of ``size`` leaves."""
    last = ((index + 1) << level) - 1
    if last < size:
        return 2 * last - last.bit_count() + level
    lowest = (size & -size).bit_length() - 1
    return 2 * size - size.bit_count() + level - lowest - 1


def height(size: int) -> int:
    return (size - 1).bit_length()


def path(index: int, size: int, low: int, high: int) -> Iterator[tuple[int, int | None, bool]]:
    """(level, sibling's index or None, whether it stands on the left) for the levels from ``low`` on, below ``high``, on a leaf's path."""
    for level in range(low, min(high, height(size))):
        sibling = (index >> level) ^ 1
        yield level, sibling if sibling << level < size else None, bool(index >> level & 1)


def build_block(nodes: list[str], low: int, high: int, first: int, size: int) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of the new nodes up to level ``high`` over an aligned block of nodes of level ``low``; ``first`` is the
    index of its first."""
    for level in range(low, min(high, height(size))):
        nodes = [digest("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
        first >>= 1
        yield from ((level + 1, first + k, node) for k, node in enumerate(nodes))


def ranked(leaves: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``leaves`` with ``rank`` (from 0) and ``size`` in their group, written; no group is gathered anywhere.

    A range-partitioned sort fixes the order; a row's rank is its place in its partition plus the group's rows in the partitions before.
    """
    placed = leaves.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    numbered, _ = stage(placed.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "ordered-leaves")
    counts = numbered.groupBy("part", group).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    own = Window.partitionBy(group)
    before = F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts, _ = stage(
        counts.select("part", group, (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(own).alias("size")), "leaf-starts"
    )
    out = numbered.join(starts, ["part", group]).withColumn("rank", F.col("seq") + F.col("shift"))
    return stage(out.drop("part", "seq", "shift"), "ranked-leaves")[0]


def run_builder(bits: int):
    def build(table: pa.Table) -> pa.Table:
        """One block of leaves to its run of the log."""
        key, block, size = (table.column(c)[0].as_py() for c in ("grp", "block", "size"))
        start = block << bits
        hexes = [h for _, h in sorted(zip(table.column("rank").to_pylist(), table.column("leaf").to_pylist()))]
        nodes = [(position(0, start + k, size), h) for k, h in enumerate(hexes)]
        root = hexes[0]
        for level, index, root in build_block(hexes, 0, bits, start, size):
            nodes.append((position(level, index, size), root))
        run = bytes.fromhex("".join(h for _, h in sorted(nodes)))
        return pa.table({
            "grp": [key], "block": pa.array([block], pa.int64()), "size": pa.array([size], pa.int64()),
            "start": pa.array([nodes[0][0]], pa.int64()), "run": pa.array([run], pa.binary()), "node": [root],
        })

    return build


def tier_builder(bits: int):
    def build(table: pa.Table) -> pa.Table:
        """A block of nodes of one tier to all nodes above them."""
        key, size, level = (table.column(c)[0].as_py() for c in ("grp", "size", "level"))
        nodes = sorted(zip(table.column("index").to_pylist(), table.column("node").to_pylist()))
        made = list(build_block([h for _, h in nodes], level, level + bits, nodes[0][0], size))
        return pa.table({
            "grp": pa.array([key] * len(made), pa.string()), "size": pa.array([size] * len(made), pa.int64()),
            "level": pa.array([m[0] for m in made], pa.int32()), "index": pa.array([m[1] for m in made], pa.int64()),
            "position": pa.array([position(m[0], m[1], size) for m in made], pa.int64()), "node": pa.array([m[2] for m in made], pa.string()),
        })

    return build


#: Steps upwards: the sibling's digest, empty if a node goes up alone, and whether it stands on the left.
PROOF = "array<struct<sibling:string,left:boolean>>"


class Log:
    """The written log: ``runs`` (grp, block, size, start, run, node), the builders' runs of binary digests in completion order with
    the block's root, and ``upper`` (grp, size, level, index, position, node), the nodes from the blocks' roots upwards."""

    def __init__(self, runs: DataFrame, upper: DataFrame, bits: int) -> None:
        self.runs, self.upper, self.bits = runs, upper, bits

    def roots(self) -> DataFrame:
        """(grp, size, root)."""
        top = self.upper.where(F.col("index") == 0).groupBy("grp").agg(F.max_by(F.struct("size", "node"), "level").alias("t"))
        return top.select("grp", "t.size", F.col("t.node").alias("root"))

    def entries(self) -> DataFrame:
        """(grp, position, node): the log as rows."""
        at = F.explode(F.sequence(F.lit(0), (F.octet_length("run") / 32).cast("int") - 1)).alias("k")
        low = self.runs.select("grp", "start", "run", at).select(
            "grp", (F.col("start") + F.col("k")).alias("position"), F.lower(F.hex(F.substring("run", F.col("k") * 32 + 1, F.lit(32)))).alias("node")
        )
        above = self.upper.where(F.col("level") > self.bits).select("grp", "position", "node")
        return low.unionByName(above)


def append_log(leaves: DataFrame, bits: int = BITS) -> Log:
    """The log of ranked leaves (grp, rank, size, leaf)."""
    blocks = leaves.select("grp", F.shiftright("rank", bits).alias("block"), "rank", "size", "leaf")
    runs, _ = stage(
        blocks.groupBy("grp", "block").applyInArrow(run_builder(bits), "grp string, block long, size long, start long, run binary, node string"),
        "merkle-runs",
    )
    # a block's root stands at level ``bits``, or at the tree's height if the block is the whole tree
    level = F.least(F.lit(bits), _height(F.col("size")))
    base = runs.select(
        "grp", "size", level.alias("level"), F.col("block").alias("index"), _position(level, F.col("block"), F.col("size")).alias("position"), "node"
    )
    upper, low = stage(base, "merkle-tier")[0], bits
    largest = leaves.agg(F.max("size")).first()[0] or 0
    while largest > 1 << low:
        tier = upper.where((F.col("level") == low) & (F.col("size") > F.lit(1 << low)))
        made = tier.groupBy("grp", F.shiftright("index", bits).alias("block")).applyInArrow(
            tier_builder(bits), "grp string, size long, level int, index long, position long, node string"
        )
        upper, low = upper.unionByName(stage(made, "merkle-tier")[0]), low + bits
    return Log(runs, upper, bits)


def _height(size: Column) -> Column:
    """``height`` as an expression."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def _position(level: Column, index: Column, size: Column) -> Column:
    """``position`` as an expression."""
    last = F.call_function("shiftleft", index + 1, level) - 1
    lowest = F.bit_count((size.bitwiseAND(-size)) - 1)
    full = 2 * last - F.bit_count(last) + level
    return F.when(last < size, full).otherwise(2 * size - F.bit_count(size) + level - lowest - 1)


def upper_paths(log: Log) -> DataFrame:
    """(grp, block, above): for every block, the siblings on its root's path, lowest first, found by their positions."""
    bits = log.bits
    own = log.runs.select("grp", "block", "size").where(F.col("size") > 1 << bits)
    levels = own.withColumn("level", F.explode(F.sequence(F.lit(bits), _height(F.col("size")) - 1)))
    sibling = F.call_function("shiftright", F.col("block"), F.col("level") - bits).bitwiseXOR(F.lit(1))
    wanted = levels.withColumn("sibling", sibling).where(F.call_function("shiftleft", F.col("sibling"), F.col("level")) < F.col("size"))
    wanted = wanted.select("grp", "block", "level", _position(F.col("level"), F.col("sibling"), F.col("size")).alias("position"))
    found = wanted.join(log.upper.select("grp", "position", "node"), ["grp", "position"]).groupBy("grp", "block").agg(F.sort_array(F.collect_list(F.struct("level", "node"))).alias("p"))
    return found.select("grp", "block", F.col("p.node").alias("above"))


def proofs(leaves: DataFrame, log: Log, by_group: DataFrame | None = None) -> DataFrame:
    """``leaves`` (grp, rank, size, leaf and others) with ``proof``, the steps from the leaf to the group's root.

    ``by_group`` (grp and others) has a row per group, which goes to every leaf of it; it is joined to the blocks, not to the leaves.
    """
    keep = [c for c in leaves.columns if c not in ("grp", "block")]
    bits = log.bits
    more = [c for c in by_group.columns if c != "grp"] if by_group else []
    blocks = leaves.select("grp", F.shiftright("rank", bits).alias("block"), *keep)
    known = log.runs.select("grp", "block", "size", "start", "run").join(upper_paths(log), ["grp", "block"], "left")
    known = known.join(by_group, "grp") if by_group else known

    def extract(own: pa.Table, run: pa.Table) -> pa.Table:
        block, size, start, data = (run.column(c)[0].as_py() for c in ("block", "size", "start", "run"))
        above = iter(run.column("above")[0].as_py() or [])
        # the steps above the block's root are the same for all its leaves
        high = [(next(above) if sibling is not None else "", left) for _, sibling, left in path(block << bits, size, bits, 64)]
        siblings, lefts, ends = [], [], [0]
        for rank in own.column("rank").to_pylist():
            for level, sibling, left in path(rank, size, 0, bits):
                at = 32 * (position(level, sibling, size) - start) if sibling is not None else len(data)
                siblings.append(data[at : at + 32].hex())
                lefts.append(left)
            siblings += [s for s, _ in high]
            lefts += [left for _, left in high]
            ends.append(len(siblings))
        steps = pa.StructArray.from_arrays([pa.array(siblings, pa.string()), pa.array(lefts, pa.bool_())], ["sibling", "left"])
        out = own.select(["grp", *keep]).append_column("proof", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps))
        for c in more:
            out = out.append_column(c, run.column(c).combine_chunks().take(pa.array([0] * own.num_rows)))
        return out

    kinds = {f.name: f.dataType.simpleString() for f in [*leaves.schema.fields, *(by_group.schema.fields if by_group else [])]}
    schema = [*(f"`{c}` {kinds[c]}" for c in ("grp", *keep)), f"proof {PROOF}", *(f"`{c}` {kinds[c]}" for c in more)]
    return blocks.groupBy("grp", "block").cogroup(known.groupBy("grp", "block")).applyInArrow(extract, ", ".join(schema))


def group_key(group: Column) -> Column:
    """The group as a text that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


class Manifest:
    """Ranked leaves of a dataset, the log of its groups, and the tree over the groups' roots."""

    def __init__(self, rows: DataFrame, group: str, order: str, bits: int = BITS) -> None:
        """``rows`` hold ``leaf``, the group and order columns, and whatever else should stay with a leaf."""
        leaves = rows.withColumn("grp", group_key(F.col(group)))
        self.leaves = ranked(leaves, "grp", [order, "leaf"])
        self.log = append_log(self.leaves, bits)
        tops = self.log.roots().select(F.lit("").alias("grp"), F.col("grp").alias("own"), F.col("root").alias("leaf"))
        self.tops = ranked(tops, "grp", ["own"])
        self.top_log = append_log(self.tops, bits)

    def proven(self) -> DataFrame:
        """The leaves with subroot, root and ``proof``, the steps from the leaf over its subroot to the root."""
        tops = proofs(self.tops, self.top_log, self.top_log.roots().select("grp", "root"))
        tops, _ = stage(
            tops.select(F.col("own").alias("grp"), F.col("leaf").alias("subroot"), "root", F.col("proof").alias("_top")), "merkle-tops"
        )
        return proofs(self.leaves, self.log, tops).withColumn("proof", F.concat("proof", "_top")).drop("_top")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the steps of a proof give."""
    joined = lambda node, s: F.when(s["left"], F.concat(s["sibling"], node)).otherwise(F.concat(node, s["sibling"]))
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(joined(node, s), 256))


def proof_digest(proof: Column) -> Column:
    """``H`` of a proof's siblings."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["sibling"]), ""), 256)
