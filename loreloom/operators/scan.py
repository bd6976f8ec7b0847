"""Running aggregates over ordered groups that survive a group of any size.

A plain window over ``keys`` sends a whole group to one task. Here the order is
cut into chunks first: each chunk is reduced on its own (with partial
aggregation before the shuffle), the much smaller chunk rows are scanned per
group, and every row combines its chunk's carry with a window that only spans
the chunk. The result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"


def by_span(order: str, span: int) -> Column:
    """Chunk of a whole-number order column; at most ``span`` distinct values each."""
    return F.floor(F.col(order) / F.lit(span)).cast("long")


def by_hours(order: str, hours: int) -> Column:
    """Chunk of a timestamp order column."""
    return F.floor(F.unix_seconds(F.col(order)) / F.lit(3600 * hours)).cast("long")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    values: Mapping[str, tuple[str, Column]],
    inclusive: bool = False,
    keep_chunk: bool = False,
) -> DataFrame:
    """Add one running column per entry of ``values``.

    Each entry maps an output name to ``(kind, column)``. Kinds: ``max``,
    ``sum``, ``count``, ``last`` (latest non-null) and ``prev`` (value of the row
    just before, even if null). ``inclusive`` lets a row see itself; ``prev``
    never does. The last entries of ``order`` must make it total. With
    ``keep_chunk`` the chunk column stays, and a following call reuses it and
    its partitioning.
    """
    keys = list(keys)
    rows = df if CHUNK in df.columns else df.withColumn(CHUNK, chunk)
    for name, (_, column) in values.items():
        rows = rows.withColumn(f"_in_{name}", column)
    position = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]

    def total(name: str, kind: str) -> Column:
        source = F.col(f"_in_{name}")
        if kind == "max":
            return F.max(source)
        if kind == "sum":
            return F.sum(source)
        if kind == "count":
            return F.count(source)
        stamped = F.struct(*position, source.alias("v"))
        return F.max(stamped if kind == "prev" else F.when(source.isNotNull(), stamped))

    parts = rows.groupBy(*keys, CHUNK).agg(
        *[total(name, kind).alias(f"_part_{name}") for name, (kind, _) in values.items()]
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(
        Window.unboundedPreceding, -1
    )

    def carry(name: str, kind: str) -> Column:
        part = F.col(f"_part_{name}")
        if kind in ("sum", "count"):
            return F.sum(part).over(before)
        return F.max(part).over(before)

    carries = parts.select(
        *keys,
        CHUNK,
        *[carry(name, kind).alias(f"_carry_{name}") for name, (kind, _) in values.items()],
    )
    joined = rows.join(carries, [*keys, CHUNK])
    ordered = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    local = ordered.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    for name, (kind, _) in values.items():
        source, carried = F.col(f"_in_{name}"), F.col(f"_carry_{name}")
        if kind == "max":
            value = F.greatest(carried, F.max(source).over(local))
        elif kind == "sum":
            here = F.sum(source).over(local)
            value = F.when(carried.isNull(), here).when(here.isNull(), carried)
            value = value.otherwise(carried + here)
        elif kind == "count":
            value = F.coalesce(carried, F.lit(0)) + F.count(source).over(local)
        elif kind == "last":
            value = F.coalesce(F.last(source, ignorenulls=True).over(local), carried["v"])
        else:
            value = F.when(
                F.row_number().over(ordered) > 1, F.lag(source).over(ordered)
            ).otherwise(carried["v"])
        joined = joined.withColumn(name, value)
    dropped = [] if keep_chunk else [CHUNK]
    for name in values:
        dropped += [f"_in_{name}", f"_carry_{name}"]
    return joined.drop(*dropped)


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. The limit is pushed below the shuffle by Spark."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
