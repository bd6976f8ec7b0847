"""Long repeated passages through a compacted de Bruijn graph of word windows.

The graph's edges are the windows of ``size`` consecutive words. Consecutive windows that share their minimiser (the
smallest hash of ``SEED`` words inside) form a run already inside a document, a super-k-mer with one content hash: its
boundaries depend on the words only, so equal passages cut alike. Runs are the vertices that Spark works on:

1. one pass over the texts writes (id, mark, start, windows, content, anchor, previous, next) per run;
2. runs whose anchor occurs in one document only cannot repeat and go;
3. per content: the smallest document that holds it, and whether it has one predecessor and one successor. Joined to
   its occurrences, consecutive runs that do not branch compact to one path record per occurrence of the path;
4. a path first held by a smaller document is repeated throughout. Where an anchor has several contents, the first
   holder's windows are compared one by one, by 128-bit hashes at their source coordinates;
5. the repeated intervals of each document meet its text, and the covered words go.

Words are runs without ASCII white space, unchanged; a null text has none. ``mark`` (a hash of the text) keeps rows that repeat an
id apart. A row with a null id has no smaller documents and is nobody's smaller document: nothing is removed from it. Only
the smallest id of a content is ever needed, so groups of any size are aggregated, not gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loreloom.llm.tables import drop, stage
from loreloom.llm.words import BASES, Windows, WordHashes, in_bounds, mix, rows, signed

SEED = 16


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def runs(h: np.ndarray, size: int, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, window after, and anchor hash of each run of windows with one minimiser."""
    order = mix(windows.of(h, min(SEED, size)), 2)
    width = size - min(SEED, size) + 1
    n = len(h) - size + 1
    least = np.lib.stride_tricks.sliding_window_view(order, width).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return first, np.append(first[1:], n), order[least[first]]


def super_kmers(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    names = ["id", "mark", "start", "windows", "c1", "c2", "anchor", "before", "after"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, one, two = WordHashes(), Windows(BASES[0]), Windows(BASES[1])
        for batch, texts in rows(in_bounds(batches)):
            out: list[list[np.ndarray]] = [[] for _ in names]
            for key, mark, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts):
                words = (text or b"").split()
                if len(words) < size or key is None:
                    continue
                h = cache.of(words)
                first, stop, anchor = runs(h, size, one)
                c1 = signed(one.spans(one.prefix(h), first, stop + size - 1))
                c2 = signed(two.spans(two.prefix(h), first, stop + size - 1))
                edge = np.zeros(1, dtype=np.int64)
                for column, value in zip(out, (
                    np.full(len(first), key), np.full(len(first), mark), first, stop - first, c1, c2, signed(anchor),
                    np.concatenate([edge, c1[:-1]]), np.concatenate([c1[1:], edge]),
                )):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(v) if v else [], k) for v, k in zip(out, kinds)], names=names
            )

    return marked(docs, id_col, text_col).mapInArrow(
        cut, "id long, mark long, start int, windows int, c1 long, c2 long, anchor long, before long, after long"
    )


def window_hashes(spans: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, mark, at, w1, w2) of the windows in ``spans`` (id, mark, start, windows), read from their sources."""
    per_text = spans.groupBy("id", "mark").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    texts = marked(docs, id_col, text_col)
    joined = texts.join(per_text, ["id", "mark"]).select("id", "text", "mark", "spans")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, one, two = WordHashes(), Windows(BASES[0]), Windows(BASES[1])
        for batch, texts in rows(batches):
            for key, mark, own, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), texts):
                h = cache.of(text.split())
                at = np.concatenate([np.arange(s["start"], s["start"] + s["windows"]) for s in own])
                w1 = one.spans(one.prefix(h), at, at + size)
                w2 = two.spans(two.prefix(h), at, at + size)
                for k in range(0, len(at), 65536):
                    part = slice(k, k + 65536)
                    n = len(at[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, key)), pa.array(np.full(n, mark)), pa.array(at[part].astype(np.int32)), pa.array(signed(w1[part])), pa.array(signed(w2[part]))],
                        names=["id", "mark", "at", "w1", "w2"],
                    )

    return joined.mapInArrow(expand, "id long, mark long, at int, w1 long, w2 long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50) -> DataFrame:
    """(id, mark, start, end): word intervals covered by windows that also start in a document with a smaller id."""
    spark = docs.sparkSession
    cut, whole = stage(super_kmers(docs, id_col, text_col, size), "super-kmers")
    # written, so that a join on a frequent anchor meets plain tables and can be split at run time
    anchors = cut.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    anchors, _ = stage(anchors.where("low < high").select("anchor"), "shared-anchors")
    kept, _ = stage(cut.join(anchors, "anchor"), "shared-kmers")
    drop(spark, whole)

    content = kept.groupBy("anchor", "c1", "c2").agg(
        F.min("id").alias("low"),
        (F.min("before") == F.max("before")).alias("one_before"), (F.min("after") == F.max("after")).alias("one_after"),
    )
    content, _ = stage(content, "contents")
    many = content.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", F.lit(True).alias("branching"))
    many, _ = stage(many, "branching")
    known, _ = stage(content.join(many, "anchor", "left"), "known-contents")
    at = kept.join(known, ["anchor", "c1", "c2"]).select(
        "id", "mark", "start", "windows", "low", F.coalesce("branching", F.lit(False)).alias("branching"), "one_before", "one_after",
    )
    at, _ = stage(at, "occurrences")

    # nonbranching neighbours compact to one record per occurrence of the path
    order = Window.partitionBy("id", "mark").orderBy("start")
    joined = F.col("one_before") & F.lag("one_after").over(order) & (F.lag(F.col("start") + F.col("windows")).over(order) == F.col("start"))
    joined = joined & (F.lag("low").over(order) == F.col("low"))
    parted = at.where("low < id").withColumn("new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    paths = parted.withColumn("path", F.sum("new").over(order)).groupBy("id", "mark", "path").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("windows")).alias("end")
    ).select("id", "mark", "start", "end")

    # windows of branching anchors, at their first holders
    open_ = at.where("branching and low = id").select("id", "mark", "start", "windows")
    single, _ = stage(window_hashes(open_, docs, id_col, text_col, size), "windows")
    least = single.groupBy("w1", "w2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("w1", "w2", "low")
    least, _ = stage(least, "least")
    again = single.join(least, ["w1", "w2"]).where("low < id").select("id", "mark", F.col("at").alias("start"), (F.col("at") + 1).alias("end"))
    found = paths.unionByName(again)
    return found.select("id", "mark", "start", (F.col("end") + size - 1).alias("end"))


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, kept (the remaining words joined by one space)."""
    per_text = spans.groupBy("id", "mark").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    texts = marked(docs, id_col, text_col)
    joined = texts.join(per_text, (texts["id"] == per_text["id"]) & (texts["mark"] == per_text["mark"]), "left").select(
        texts["id"], "text", "spans"
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows(in_bounds(batches)):
            n, removed, kept = [], [], []
            for text, own in zip(texts, batch.column(2).to_pylist()):
                words = (text or b"").split()
                out, last = [], 0
                for span in own or ():
                    out += words[last : max(last, span["start"])]
                    last = max(last, span["end"])
                out += words[last:]
                n.append(len(words))
                removed.append(len(words) - len(out))
                kept.append(b" ".join(out).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["id", "n_words", "n_removed", "kept"],
            )

    return joined.mapInArrow(remove, "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50) -> DataFrame:
    spans, _ = stage(repeated_spans(docs, id_col, text_col, size), "repeats")
    return remove_spans(docs, spans, id_col, text_col)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
