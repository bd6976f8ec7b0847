"""Redirect chains of a page catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.functions import text as tx
from loreloom.session import stage


def redirect_map(pages: DataFrame) -> DataFrame:
    """(source_key, target_key) of redirect pages. ``pages``: title_key, redirect, redirect_target."""
    return pages.where("redirect AND redirect_target IS NOT NULL").select(
        F.col("title_key").alias("source_key"), tx.title_key(F.col("redirect_target")).alias("target_key")
    )


def _follow(edges: DataFrame, label: str) -> DataFrame:
    """(node, next, steps, done): every edge (node, next) of a functional graph followed by pointer doubling.

    ``done`` says that ``next`` has no edge of its own, and then ``steps`` is its distance. After r rounds an open node has gone
    ``2 ** r`` steps. As long as an open node comes to an end some day, one does in the next round; so after a round in which none did, all
    that are left run into cycles, and once they have gone as many steps as they are, their ``next`` lies on one.
    """
    ends = edges.select(F.col("node").alias("_node"), F.lit(False).alias("_end"))
    first = edges.join(ends, F.col("next") == F.col("_node"), "left")
    state = stage(first.select("node", "next", F.lit(1).cast("long").alias("steps"), F.col("_end").isNull().alias("done")), label)
    reach, before = 1, -1
    while (left := state.where("NOT done").count()) and (left != before or reach < left):
        before = left
        ahead = state.select(F.col("node").alias("_at"), F.col("next").alias("_next"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        walked = state.where("NOT done").join(ahead, F.col("next") == F.col("_at")).select(
            "node", F.col("_next").alias("next"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_done").alias("done")
        )
        state = stage(state.where("done").unionByName(walked), label)
        reach *= 2
    return state


def _cycle_sizes(edges: DataFrame) -> DataFrame:
    """(node, cycle, size) for edges that are cycles only; a cycle is named by its least key."""
    total = edges.count()
    state = stage(edges.select("node", "next", F.least("node", "next").alias("least")), "redirect-cycles")
    reach = 1
    while reach < total:
        ahead = state.select(F.col("node").alias("_at"), F.col("next").alias("_next"), F.col("least").alias("_least"))
        state = stage(
            state.join(ahead, F.col("next") == F.col("_at")).select("node", F.col("_next").alias("next"), F.least("least", "_least").alias("least")),
            "redirect-cycles",
        )
        reach *= 2
    sizes = state.groupBy("least").agg(F.count(F.lit(1)).alias("size"))
    return state.join(sizes, "least").select("node", F.col("least").alias("cycle"), "size")


def close_redirects(mapping: DataFrame, existing: DataFrame) -> DataFrame:
    """Follow every redirect to its end: (source_key, final_key, status, steps).

    ``status`` is resolved, broken or cycle; ``steps`` is the number of redirects walked, in a cycle up to the first repeated key.
    No row grows with the chain; ``redirect_chains`` lists the keys walked.
    """
    edges = mapping.select(F.col("source_key").alias("node"), F.col("target_key").alias("next"))
    state = _follow(edges, "redirects")
    known = existing.select(F.col("title_key").alias("next"), F.lit(True).alias("exists"))
    resolved = F.col("exists").isNotNull()
    closed = state.where("done").join(known, "next", "left").select(
        F.col("node").alias("source_key"), F.when(resolved, F.col("next")).alias("final_key"),
        F.when(resolved, "resolved").otherwise("broken").alias("status"), "steps",
    )
    endless = state.where("NOT done")
    if endless.isEmpty():
        return closed
    on_cycle = stage(endless.select(F.col("next").alias("node")).distinct(), "redirects")
    around = edges.join(on_cycle, "node", "left_semi")
    sizes = stage(_cycle_sizes(around), "redirects")
    tails = edges.join(endless.select("node"), "node", "left_semi").join(on_cycle, "node", "left_anti")
    entered = _follow(tails, "redirects").join(sizes.select(F.col("node").alias("next"), "size"), "next")
    rings = sizes.select("node", F.col("size").alias("steps")).unionByName(entered.select("node", (F.col("steps") + F.col("size")).alias("steps")))
    return closed.unionByName(rings.select(
        F.col("node").alias("source_key"), F.lit(None).cast("string").alias("final_key"), F.lit("cycle").alias("status"), "steps"
    ))


def redirect_chains(mapping: DataFrame, closed: DataFrame) -> DataFrame:
    """(source_key, step, key): the keys that the sources in ``closed`` walk, the source itself as step 0.

    A walk is halved again and again with jumps of 2 ** k redirects, so a chain takes as many rounds as its length has bits; ``closed``
    may be any choice of sources, since all chains together can be far larger than the redirects.
    """
    jumps = [stage(mapping.select(F.col("source_key").alias("at"), F.col("target_key").alias("to")), "redirect-jumps")]
    longest = closed.agg(F.max("steps")).first()[0] or 0
    while 2 << len(jumps) <= 2 * longest:
        one = jumps[-1]
        jumps.append(stage(one.join(one.select(F.col("at").alias("to"), F.col("to").alias("_to")), "to").select("at", F.col("_to").alias("to")), "redirect-jumps"))
    spans = closed.select("source_key", F.lit(0).cast("long").alias("step"), F.col("source_key").alias("key"), F.col("steps").alias("span"))
    walked = spans.select("source_key", "step", "key")
    for k in range(len(jumps) - 1, -1, -1):
        far = spans.where(F.col("span") > 1 << k).join(jumps[k], F.col("key") == F.col("at"))
        second = far.select("source_key", (F.col("step") + (1 << k)).alias("step"), F.col("to").alias("key"), (F.col("span") - (1 << k)).alias("span"))
        spans = stage(spans.withColumn("span", F.least("span", F.lit(1 << k).cast("long"))).unionByName(second), "redirect-spans")
    last = spans.where("span > 0").join(jumps[0], F.col("key") == F.col("at"))
    return walked.unionByName(last.select("source_key", (F.col("step") + 1).alias("step"), F.col("to").alias("key")))


def redirect_stats(closed: DataFrame) -> DataFrame:
    return closed.groupBy("status").agg(F.count("*").alias("redirects"))


def redirect_report(closed: DataFrame, pages: DataFrame) -> DataFrame:
    """Closed redirects with the source page and, when resolved, the final page."""
    columns = ("title", "page_id", "revision_id", "document_id")
    source = pages.select(
        F.col("title_key").alias("source_key"), "redirect_target", *[F.col(c).alias(f"source_{c}") for c in columns]
    )
    final = pages.select(F.col("title_key").alias("final_key"), *[F.col(c).alias(f"final_{c}") for c in columns])
    return closed.join(source, "source_key").join(final, "final_key", "left")


def redirect_source_rows(closed: DataFrame, pages: DataFrame) -> DataFrame:
    """(title_key, source_key, title, page_id, revision_id, document_id): the redirecting pages of each final page, as rows."""
    columns = ("title", "page_id", "revision_id", "document_id")
    source = pages.select(F.col("title_key").alias("source_key"), *columns)
    found = closed.where("status = 'resolved'").join(source, "source_key")
    return found.select(F.col("final_key").alias("title_key"), "source_key", *columns)


def redirect_sources(closed: DataFrame, pages: DataFrame) -> DataFrame:
    """Redirecting pages of each final page, in title order, as an array of structs, as the record format has it."""
    entry = F.struct("source_key", "title", "page_id", "revision_id", "document_id")
    ordered = F.transform(F.sort_array(F.collect_list(entry)), lambda s: s.dropFields("source_key"))
    return redirect_source_rows(closed, pages).groupBy("title_key").agg(ordered.alias("redirect_sources"))
