"""Exact and near duplicate removal with first-in-order-wins semantics.

A row is dropped when an *earlier kept* row has the same key checksum (exact)
or is near it: SimHash distance at most 3 and length ratio at least 0.92. The
outcome only depends on the order column, never on partitioning.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from hashlib import sha256
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom.functions import text as tx
from loreloom.session import stage

MAX_HAMMING = 3
MIN_LENGTH_RATIO = 0.92
#: Words whose hashes a batch remembers; it only saves work.
MAX_KNOWN = 20_000
_TOKEN = re.compile(tx.SIMHASH_TOKEN)


@F.pandas_udf(T.LongType())
def _simhash64(folded: pd.Series) -> pd.Series:
    known: dict[str, int] = {}
    result = np.empty(len(folded), dtype=np.uint64)
    for at, text in enumerate(folded):
        votes = Counter(_TOKEN.findall(text))
        if len(known) > MAX_KNOWN:
            known.clear()
        for word in votes:
            if word not in known:
                known[word] = int.from_bytes(sha256(word.encode("utf-8")).digest()[:8], "big")
        hashes = np.fromiter((known[w] for w in votes), np.uint64, len(votes))
        counts = np.fromiter(votes.values(), np.float64, len(votes))
        ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits = 2 * (counts @ ones) >= counts.sum()
        result[at] = np.packbits(set_bits, bitorder="little").view(np.uint64)[0]
    return pd.Series(result.view(np.int64))


def simhash64(text: Column) -> Column:
    """Token vote per bit; a tie sets the bit. Stored as a signed 64-bit value."""
    return _simhash64(tx.fold(text))


def band(simhash: Column, number: int) -> Column:
    """16-bit band of a signature, lowest bits first."""
    return F.shiftrightunsigned(simhash, 16 * number).bitwiseAND(F.lit(65535)).cast("int")


def signatures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``checksum``, ``simhash`` and ``text_length`` to rows of normalised text."""
    return (
        df.withColumn("checksum", F.sha2(tx.dedupe_key(F.col(text)), 256))
        .withColumn("simhash", simhash64(F.col(text)))
        .withColumn("text_length", F.length(text))
    )


def drop_exact(df: DataFrame, order: Sequence[str], row_id: str, checksum: str = "checksum") -> DataFrame:
    """Keep the first row of every checksum. Partial minima keep hot checksums cheap."""
    first = df.groupBy(checksum).agg(
        F.min_by(F.col(row_id), F.struct(*order)).alias(row_id)
    )
    return df.join(first.select(row_id), row_id, "left_semi")


def _blocks(count: int) -> list[tuple[int, int]]:
    """``count`` bit ranges (shift, width) that cover the 64 bits."""
    edges = [64 * i // count for i in range(count + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def block_count(rows: int) -> int:
    """Blocks for ``rows`` signatures, so that a random key stays nearly unique.

    With b blocks and distance 3 at least b - 3 blocks agree, so the key is any
    choice of b - 3 blocks: 16 bits for b = 4, 25 for b = 5 and 32 for b = 6.
    """
    return 4 if rows < 200_000 else 5 if rows < 50_000_000 else 6


def blocking_keys(simhash: Column, length: Column, blocks: int = 4) -> Column:
    """Keys such that any near pair shares at least one.

    Lengths are bucketed on a log scale one ratio step wide; a row stands in its
    own bucket and the next one up, so lengths within the ratio always meet.
    """
    step = F.floor(F.log(F.greatest(length, F.lit(1))) / F.lit(-np.log(MIN_LENGTH_RATIO)))
    keys = []
    for number, chosen in enumerate(combinations(_blocks(blocks), blocks - MAX_HAMMING)):
        packed = F.lit(0).cast("long")
        for shift, width in chosen:
            part = F.shiftrightunsigned(simhash, shift).bitwiseAND(F.lit((1 << width) - 1))
            packed = F.shiftleft(packed, width).bitwiseOR(part)
        for bucket in (step, step + 1):
            keys.append(F.xxhash64(F.lit(number), packed, bucket.cast("long")))
    return F.array(*keys)


def is_near(a: str, b: str, max_hamming: int = MAX_HAMMING, min_ratio: float = MIN_LENGTH_RATIO) -> Column:
    la, lb = F.col(f"{a}.text_length"), F.col(f"{b}.text_length")
    distance = F.bit_count(F.col(f"{a}.simhash").bitwiseXOR(F.col(f"{b}.simhash")))
    return (distance <= max_hamming) & (
        F.least(la, lb).cast("double") / F.greatest(la, lb) >= min_ratio
    )


def near_pairs(
    sigs: DataFrame, row_id: str, max_hamming: int = MAX_HAMMING, min_ratio: float = MIN_LENGTH_RATIO,
    blocks: int = 4,
) -> DataFrame:
    """Near pairs between *distinct* signatures, each with its multiplicity.

    Copies share one signature, so they are folded before the join: a group of n
    copies is one row with ``copies`` = n, not n * n pairs.
    """
    if max_hamming > MAX_HAMMING or min_ratio < MIN_LENGTH_RATIO:
        raise ValueError("blocking keys only guarantee pairs within the standard limits")
    folded = stage(
        sigs.groupBy("simhash", "text_length").agg(F.min(row_id).alias("first_id"), F.count("*").alias("copies")),
        "signature-classes",
    )
    keyed = folded.withColumn(
        "key", F.explode_outer(F.array_distinct(blocking_keys(F.col("simhash"), F.col("text_length"), blocks)))
    )
    left, right = keyed.alias("l"), keyed.alias("r")
    return (
        left.join(
            right,
            (F.col("l.key") == F.col("r.key"))
            & (F.col("l.first_id") < F.col("r.first_id"))
            & is_near("l", "r", max_hamming, min_ratio),
        )
        .select(
            F.col("l.first_id").alias("left_id"),
            F.col("r.first_id").alias("right_id"),
            F.col("l.copies").alias("left_copies"),
            F.col("r.copies").alias("right_copies"),
            F.bit_count(F.col("l.simhash").bitwiseXOR(F.col("r.simhash"))).alias("hamming"),
        )
        .distinct()
    )


def greedy_dedup(
    df: DataFrame,
    row_id: str,
    order: Sequence[str],
    near: bool = True,
    window: int = 512,
    max_rounds: int = 1000,
) -> DataFrame:
    """Status per row: ``kept``, ``exact`` or ``near``.

    ``df`` needs ``checksum``, ``simhash`` and ``text_length`` (see
    ``signatures``). Returns ``row_id``, the order columns, ``checksum`` and
    ``status``.

    The kept set is the first-in-order maximal independent set over "same
    checksum or near". Rows equal in all three signature columns are one class
    and only its first row can be kept. Classes are decided in rounds: in every
    blocking bucket the first ``window`` undecided classes are compared; a class
    that stands inside that window in all of its buckets and has no earlier
    neighbour is final, and final classes drop their later neighbours. Work per
    round is linear in the bucket sizes, no pair list is written, and the number
    of rounds grows with (kept rows in the largest bucket) / ``window``.
    """
    ord_ = F.struct(*[F.col(c) for c in order]).alias("ord")
    narrow = df.select(row_id, ord_, "checksum", "simhash", "text_length")
    if not near:
        return _label_exact(narrow, row_id, order)
    narrow = stage(narrow, "signatures")
    classes = narrow.groupBy("checksum", "simhash", "text_length").agg(
        F.min("ord").alias("ord"), F.min_by(row_id, "ord").alias("node")
    )
    undecided = stage(classes, "undecided")
    blocks = block_count(undecided.count())
    kept_parts: list[DataFrame] = []
    for _ in range(max_rounds):
        keys = blocking_keys(F.col("simhash"), F.col("text_length"), blocks)
        keyed = undecided.withColumn(
            "bucket", F.array_distinct(F.concat(keys, F.array(F.xxhash64(F.lit(-1), "checksum"))))
        ).withColumn("buckets", F.size("bucket")).withColumn("bucket", F.explode_outer("bucket"))
        spot = Window.partitionBy("bucket").orderBy("ord")
        front = stage(
            keyed.withColumn("place", F.row_number().over(spot)).where(F.col("place") <= window),
            "front",
        )
        neighbour = (F.col("a.checksum") == F.col("b.checksum")) | is_near("a", "b")
        earlier = (
            (F.col("a.bucket") == F.col("b.bucket"))
            & (F.col("a.ord") < F.col("b.ord"))
            & neighbour
        )
        blocked = front.alias("b").join(front.alias("a"), earlier, "left_semi").select("node").distinct()
        inside = front.groupBy("node").agg(
            F.count("*").alias("seen"), F.first("buckets").alias("buckets")
        ).where(F.col("seen") == F.col("buckets")).select("node")
        winners = stage(
            front.join(inside, "node", "left_semi").join(blocked, "node", "left_anti"), "winners"
        )
        kept_parts.append(winners.select("node", "checksum").distinct())
        losers = keyed.alias("b").join(winners.alias("a"), earlier, "left_semi").select("node").distinct()
        decided = winners.select("node").unionByName(losers).distinct()
        undecided = stage(undecided.join(decided, "node", "left_anti"), "undecided")
        if undecided.isEmpty():
            break
    else:
        raise RuntimeError(f"near-duplicate rounds did not finish in {max_rounds}")
    kept = kept_parts[0]
    for part in kept_parts[1:]:
        kept = kept.unionByName(part)
    # At most one row per checksum is kept, so this lookup side is unique.
    by_checksum = kept.select("checksum", F.col("node").alias("kept_node")).join(
        narrow.select(F.col(row_id).alias("kept_node"), F.col("ord").alias("kept_ord")), "kept_node"
    )
    return narrow.join(by_checksum, "checksum", "left").select(
        row_id,
        *[F.col(f"ord.{c}").alias(c) for c in order if c != row_id],
        "checksum",
        F.when(F.col(row_id) == F.col("kept_node"), F.lit("kept"))
        .when(F.col("kept_ord") < F.col("ord"), F.lit("exact"))
        .otherwise(F.lit("near"))
        .alias("status"),
    )


def _label_exact(narrow: DataFrame, row_id: str, order: Sequence[str]) -> DataFrame:
    first = narrow.groupBy("checksum").agg(F.min_by(row_id, "ord").alias(row_id)).select(
        row_id, F.lit(True).alias("is_first")
    )
    return narrow.join(first, row_id, "left").select(
        row_id,
        *[F.col(f"ord.{c}").alias(c) for c in order if c != row_id],
        "checksum",
        F.when(F.col("is_first"), F.lit("kept")).otherwise(F.lit("exact")).alias("status"),
    )


def flag_conflicts(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keep every row and mark those whose key stands on more than one row."""
    counts = df.groupBy(*key).agg((F.count("*") > 1).alias("source_conflict"))
    return df.join(counts, list(key))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")
