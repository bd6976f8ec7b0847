"""Exact duplicates by two-pass Bloom filtering.

Texts are equal when identical after every run of ASCII white space became one space; a null text counts as
empty. Of equal texts the row with the smallest id stays (null ids last; of rows that repeat both id and text
exactly one stays).

Pass one hashes every text to ``HASHES`` slots of a bit array and counts how often each slot is hit; only slots
hit twice or more are set in the filter, kept as 4 KB bitmaps. Pass two looks each row up: a row with an unset
slot has no copy anywhere and passes straight through without a shuffle; the others, true copies and a few
false positives, are grouped by their SHA-256. The filter has 16 bits a row up to ``MAX_BITS``, so what is
broadcast has a proven bound of ``MAX_BITS / 8`` bytes. Beyond that more rows are false positives, which costs
shuffled rows and never a wrong answer. Copies are only summed per digest, so a group of any size is spread.

An empty table gives an empty result; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm.tables import stage

HASHES = 2
MIN_BITS, MAX_BITS = 1 << 18, 1 << 28


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _slots(digest: Column, bits: int) -> list[Column]:
    return [F.xxhash64(digest, F.lit(i)).bitwiseAND(F.lit(bits - 1)) for i in range(HASHES)]


def repeat_filter(digests: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap) of the slots that two rows or more hit; at most ``bits / 32768`` rows of 4 KB."""
    slots = digests.select(F.explode(F.array(*_slots(F.col("digest"), bits))).alias("slot"))
    twice = slots.groupBy("slot").count().where("count > 1")
    return twice.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")
    )


def member_filter(digests: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap) of the slots that any row hits; for ``maybe_repeated`` on other rows."""
    slots = digests.select(F.explode(F.array(*_slots(F.col("digest"), bits))).alias("slot"))
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")
    )


def filter_bits(rows: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (16 * max(rows, 1) - 1).bit_length()))


def maybe_repeated(rows: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """``rows`` (with a ``digest``) plus ``maybe``: whether all slots are set in the filter."""
    found = []
    out = rows
    for i, slot in enumerate(_slots(F.col("digest"), bits)):
        side = bitmaps.select(F.col("bucket").alias(f"__bucket{i}"), F.col("bitmap").alias(f"__bitmap{i}"))
        out = out.join(F.broadcast(side), F.bitmap_bucket_number(slot) == F.col(f"__bucket{i}"), "left")
        at = F.bitmap_bit_position(slot)
        byte = F.conv(F.hex(F.col(f"__bitmap{i}").substr((F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        found.append(F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
    both = found[0]
    for one in found[1:]:
        both = both & one
    return out.withColumn("maybe", both).drop(*[f"__{k}{i}" for k in ("bucket", "bitmap") for i in range(HASHES)])




def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256."""
    hashed = docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(normal_text(F.col(text_col)), 256)).alias("digest"),
    )
    rows, _ = stage(hashed, "digests")
    bits = filter_bits(rows.count())
    bitmaps, _ = stage(repeat_filter(rows, bits), "bloom")
    looked = maybe_repeated(rows, bitmaps, bits)
    alone = looked.where("not maybe").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    again = looked.where("maybe").select("id", "row", "digest")
    groups = again.groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"),
        F.count(F.lit(1)).alias("group_size"),
    )
    # written, so that the rows of a large group meet a plain table and can be split at run time
    groups, _ = stage(groups, "copy-groups")
    copies = again.join(groups, "digest").select(
        "id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "digest"
    )
    return alone.unionByName(copies).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns. Rows without a possible copy are not shuffled."""
    columns = docs.columns
    digest = F.unhex(F.sha2(normal_text(F.col(text_col)), 256))
    rows, _ = stage(docs.select(digest.alias("digest")), "digests")
    bits = filter_bits(rows.count())
    bitmaps, _ = stage(repeat_filter(rows, bits), "bloom")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), digest.alias("digest"))
    looked = maybe_repeated(packed, bitmaps, bits)
    id_of = F.col("doc").getField(id_col)
    first = looked.where("maybe").groupBy("digest").agg(F.min_by("doc", F.struct(id_of.isNull(), id_of)).alias("doc"))
    return looked.where("not maybe").select("doc").unionByName(first.select("doc")).select(
        *[F.col("doc").getField(c).alias(c) for c in columns]
    )
