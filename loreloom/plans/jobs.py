"""Jobs a user starts: import, index, evaluate, replay, advise."""

from __future__ import annotations

import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from loreloom.operators import answers as an, evaluate as ev, events as el, index as ix, retrieve as rt, state as st
from loreloom.operators import publish as pb
from loreloom.operators.scan import by_span
from loreloom.plans import corpus as co
from loreloom.session import stage
from loreloom.sources import files as fl
from loreloom.streaming import events as se


def import_corpus(
    spark: SparkSession, snapshots: list[str], out: str, overrides: str | None = None, force: bool = False, **options
) -> dict:
    """Snapshots to a published corpus; returns the manifest.

    The checksum of the sources and options is stored; an import of the same sources is skipped unless forced.
    """
    sources = pb.source_checksum(spark, [*snapshots, *([overrides] if overrides else [])])
    if options:
        sources += ":" + ",".join(f"{k}={v}" for k, v in sorted(options.items()))
    if not force and not pb.needs_build(spark, out, sources):
        return pb.read_manifest(spark, out)
    entries = fl.read_overrides(spark, overrides) if overrides else None
    return co.publish(co.build_corpus(fl.read_pages(spark, snapshots), entries, **options), out, source_checksum=sources)


INDEX = "INDEX"
INDEX_TABLES = ("index_chunks", "aliases", "fields", "postings", "term_stats")


def build_index(spark: SparkSession, out: str, encoder: ix.Encoder | None = None) -> tuple[ix.KeywordIndex, DataFrame | None]:
    """Keyword tables, and vectors when there is an encoder, of the published corpus.

    The index belongs to the corpus version and is written into a new folder under it. The version's index
    pointer is switched last, after the ids of vectors and chunks were compared.
    """
    version = pb.current_folder(spark, out)
    folder = os.path.join(version, f"index-{uuid.uuid4().hex[:16]}")
    chunks = spark.read.parquet(os.path.join(version, "chunks"))
    built = ix.build_keyword_index(chunks)
    for name, df in zip(INDEX_TABLES, (built.chunks, built.aliases, built.fields, built.postings)):
        df.write.parquet(os.path.join(folder, name))
    ix.term_stats(spark.read.parquet(os.path.join(folder, "postings"))).write.parquet(os.path.join(folder, "term_stats"))
    if encoder is not None:
        ix.build_vectors(chunks, encoder).write.parquet(os.path.join(folder, "vectors"))
        if not ix.id_mismatch(chunks, spark.read.parquet(os.path.join(folder, "vectors"))).isEmpty():
            raise RuntimeError("vectors and chunks do not cover the same ids")
    pb.write_pointer(spark, os.path.join(version, INDEX), os.path.basename(folder))
    return open_index(spark, out)


def open_index(spark: SparkSession, out: str) -> tuple[ix.KeywordIndex, DataFrame | None]:
    """The published version's current index."""
    version = pb.current_folder(spark, out)
    name = pb.read_pointer(spark, os.path.join(version, INDEX))
    if name is None:
        raise FileNotFoundError(f"{version} has no index")
    folder = os.path.join(version, name)
    index = ix.KeywordIndex(*[spark.read.parquet(os.path.join(folder, table)) for table in INDEX_TABLES])
    vectors = os.path.join(folder, "vectors")
    return index, spark.read.parquet(vectors) if pb.exists(spark, vectors) else None


def convert_index_vectors(spark: SparkSession, source: str, target: str, dimension: int, expected: int | None = None) -> DataFrame:
    """Vector tables of another store, checked and normalised, written into a new folder."""
    ix.convert_vectors(spark.read.parquet(source), dimension, expected).write.parquet(target)
    return spark.read.parquet(target)


def evaluate_suite(
    spark: SparkSession, suite: str, index: ix.KeywordIndex, vectors: DataFrame | None = None, encoder: ix.Encoder | None = None,
    latency: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Report row and per-case scores of an evaluation file, with the latency gate.

    ``latency``: (query_id, latency_ms) of single queries, where a service measured them. Without it the batch itself is timed, from the
    question texts to the written hits, and each case is charged an equal share.
    """
    cases, header = fl.read_eval(spark, suite)
    began = time.perf_counter()
    embedded = ix.embed(cases, encoder, "query_id", F.col("query")) if vectors is not None and encoder else None
    hits = stage(rt.hybrid_search(cases, index, header["top_k"], vectors, embedded), "suite-hits")
    spent = (time.perf_counter() - began) * 1000
    scored = ev.score_cases(
        cases, hits.select("query_id", "rank", "entity_id", F.col("source.id").alias("source_id"))
    )
    if latency is None:
        scored = scored.withColumn("latency_ms", F.lit(spent / max(cases.count(), 1)))
    else:
        scored = scored.join(latency.select("query_id", F.col("latency_ms").cast("double").alias("latency_ms")), "query_id", "left")
    mode = "keyword" if embedded is None else "hybrid"
    return ev.evaluate(scored, header["thresholds"], mode, "latency_ms"), scored


@dataclass(frozen=True)
class Listened:
    """Tables of a listening job."""

    recorded: DataFrame
    invalid: DataFrame
    diagnostics: DataFrame


@dataclass(frozen=True)
class Replay:
    """Tables of a replayed recording."""

    line_counts: DataFrame
    diagnostics: DataFrame
    states: DataFrame
    items: DataFrame
    accepted: DataFrame


def replay(lines: DataFrame, arrival: str, prefix: str = el.DEFAULT_PREFIX, span: int = 100_000) -> Replay:
    """Recorded lines (``value`` and a whole-number ``arrival``) to diagnostics and states."""
    parsed = el.parse_events(lines, prefix=prefix)
    checked = el.seq_check(el.valid_events(parsed), "run_id", "seq", [arrival], by_span(arrival, span))
    accepted = checked.where("accepted").drop("accepted", "gap")
    return Replay(
        el.line_counts(parsed), el.diagnostics(checked, "run_id"), st.rebuild_state(accepted, span),
        st.current_items(accepted, span), accepted,
    )


class ListenMetrics(StreamingQueryListener):
    """Counts of the micro-batches as the query reports them: {batch number: {metric: value}}."""

    def __init__(self) -> None:
        self.batches: dict[int, dict] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get("lines")
        if seen is not None:
            self.batches[event.progress.batchId] = seen.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def total(self) -> dict:
        out: dict = {}
        for counts in self.batches.values():
            for name, value in counts.items():
                out[name] = out.get(name, 0) + (value or 0)
        return out


LISTEN_TABLES = ("recorded", "invalid", "checked")


def write_batch(out: str):
    """Sinks of one micro-batch; each is a folder named by the batch number, so a batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        kept = stage(batch, "listen")
        place = lambda table: os.path.join(out, table, f"batch={number}")
        valid = kept.where("status = 'valid'")
        valid.where("accepted").select("run_id", "seq", "json").write.mode("overwrite").parquet(place("recorded"))
        kept.where("status = 'invalid'").select("value", "broken_rules").write.mode("overwrite").parquet(place("invalid"))
        valid.groupBy("run_id").agg(
            F.count_if("accepted").alias("parsed_events"), F.count_if(~F.col("accepted")).alias("out_of_order_events"), F.sum("gap").alias("sequence_gaps")
        ).write.mode("overwrite").parquet(place("checked"))

    return write


def listen(lines: DataFrame, out: str, order: list[str], prefix: str = el.DEFAULT_PREFIX, **trigger):
    """Start listening to a stream of log lines (``value``): accepted events are recorded, broken lines kept, diagnostics counted.

    One query feeds all sinks under ``out``. Lines that are no events count in the observed metrics only. Returns the query; pass
    ``availableNow=True`` to stop when everything there is has been read.
    """
    parsed = el.parse_events(lines, prefix=prefix)
    counted = parsed.observe(
        "lines", F.count(F.lit(1)).alias("lines"), *[F.count_if(F.col("status") == s).alias(s) for s in ("valid", "invalid", "ignored")]
    )
    slim = counted.where("status <> 'ignored'").select(
        *dict.fromkeys(["value", *order]), "status", "broken_rules", "run_id", "seq", F.substring(F.col("value"), F.instr("value", "{"), F.length("value")).alias("json")
    )
    # lines without a proper run and number are spread over keys of their own; their verdict on order is not used
    valid = F.col("status") == "valid"
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("value"), F.lit(256)).cast("string"))
    keyed = slim.withColumns({"guard_run": F.when(valid, F.col("run_id")).otherwise(spread), "guard_seq": F.when(valid, F.col("seq")).otherwise(0)})
    checked = se.order_guard(keyed, "guard_run", "guard_seq", order)
    writer = checked.writeStream.foreachBatch(write_batch(out)).option("checkpointLocation", os.path.join(out, "progress"))
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def listened(spark: SparkSession, out: str) -> Listened:
    """What a listening job wrote so far."""
    read = lambda table: spark.read.parquet(os.path.join(out, table))
    sums = [F.sum(c).alias(c) for c in ("parsed_events", "out_of_order_events", "sequence_gaps")]
    return Listened(read("recorded"), read("invalid"), read("checked").groupBy("run_id").agg(*sums))


def advise(accepted: DataFrame, index: ix.KeywordIndex, items: DataFrame | None = None) -> DataFrame:
    """Evidence for every item that appeared in an item room and is known."""
    described = index.chunks.where((F.col("entity_type") == "item") & ~F.col("stale"))
    known = described.select(
        F.regexp_extract("entity_id", "^collectible:([0-9]+)$", 1).cast("string").alias("number")
    ).where("number <> ''").select(F.col("number").cast("long").alias("collectible_id")).distinct()
    triggers = el.advice_triggers(accepted, known).select("run_id", "seq", "collectible_id")
    asked = triggers.select(
        F.col("collectible_id").alias("query_id"), F.col("collectible_id").cast("string").alias("query"),
        F.array(F.lit("item")).alias("entity_types"),
    ).distinct()
    return an.item_evidence(triggers, rt.hybrid_search(asked, index), items)
