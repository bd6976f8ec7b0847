"""Line removal by the number of distinct sites a line is spread over; built-in functions only.

A line is the text between line feeds, trimmed of ASCII white space; empty lines are never removed. Lines are known by a
128-bit hash. A line that occurs on ``sites`` distinct sites or more is boilerplate and is removed from every document.

Most lines occur once. Rows are first counted per (line, site) (the shuffle carries one row per task, line and site), lines
on a single site go, and the sites of the rest are merged into one HyperLogLog sketch per line. Only lines whose estimate lies within
``MARGIN`` standard errors of the threshold get an exact distinct count. The boilerplate lines of each
document then meet its text once; a line that stands in a third of all documents is never gathered.

A null site counts as one site of its own; a null text has no lines and stays null; rows that repeat an id and text are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm.tables import stage

#: log2 of the sketch's registers.
LG_K = 10
#: Standard errors of the estimate around the threshold that are counted exactly.
MARGIN = 6


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """128 bits of SHA-256, as two numbers."""
    digest = F.sha2(trimmed(line), 256)
    return F.struct(
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("k1"), F.conv(F.substring(digest, 16, 15), 16, 10).cast("long").alias("k2")
    )


def boilerplate(rows: DataFrame, sites: int) -> DataFrame:
    """(k1, k2, site hash) rows to the (k1, k2, n_sites) of lines on ``sites`` sites or more."""
    per = rows.groupBy("k1", "k2", "site").agg(F.count(F.lit(1)).alias("n"))
    wide = per.groupBy("k1", "k2").agg(F.min("site").alias("low"), F.max("site").alias("high"), F.count(F.lit(1)).alias("n_partial"))
    wide = wide.where(F.col("low") < F.col("high")).select("k1", "k2") if sites > 1 else wide.select("k1", "k2")
    shared, _ = stage(per.join(wide, ["k1", "k2"]).select("k1", "k2", "site"), "line-sites")
    sketch = shared.groupBy("k1", "k2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    estimate = sketch.select("k1", "k2", F.hll_sketch_estimate("sketch").alias("estimate"))
    slack = max(1, round(MARGIN * 1.04 / 2 ** (LG_K / 2) * sites))
    estimate, _ = stage(estimate.where(F.col("estimate") >= sites - slack), "line-estimates")
    near = estimate.where(F.col("estimate") <= sites + slack).select("k1", "k2")
    exact = shared.join(near, ["k1", "k2"], "left_semi").distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_sites"))
    far = estimate.where(F.col("estimate") > sites + slack).select("k1", "k2", F.col("estimate").alias("n_sites"))
    return exact.where(F.col("n_sites") >= sites).unionByName(far)


def remove_boilerplate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = 8
) -> DataFrame:
    """Per row: id, n_lines, n_removed, kept (the text without boilerplate lines)."""
    text = F.col(text_col).cast("string")
    base = docs.select(
        F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"), F.xxhash64(F.col(site_col).cast("string")).alias("site")
    )
    keys = F.array_distinct(F.transform(F.filter(lines_of(F.col("text")), lambda x: trimmed(x) != ""), line_key))
    found, _ = stage(base.where("text is not null").select("id", "mark", "site", F.explode(keys).alias("k")).select("id", "mark", "site", "k.*"), "lines")
    bad, _ = stage(boilerplate(found, sites), "boilerplate")
    per_text = found.join(bad, ["k1", "k2"]).groupBy("id", "mark").agg(F.collect_set(F.struct("k1", "k2")).alias("bad"))
    joined = base.join(per_text.withColumnsRenamed({"id": "id_", "mark": "mark_"}), F.col("id").eqNullSafe(F.col("id_")) & (F.col("mark") == F.col("mark_")), "left")
    lines = lines_of(F.col("text"))
    kept = F.when(F.col("bad").isNull(), lines).otherwise(
        F.filter(lines, lambda x: (trimmed(x) == "") | ~F.array_contains("bad", line_key(x)))
    )
    out = joined.select("id", "text", lines.alias("lines"), kept.alias("kept"))
    n = lambda c: F.when(F.col("text").isNull(), 0).otherwise(F.size(c)).cast("long")
    return out.select(
        F.col("id").alias(id_col), n("lines").alias("n_lines"),
        (n("lines") - n("kept")).alias("n_removed"), F.array_join("kept", "\n").alias("kept"),
    )
