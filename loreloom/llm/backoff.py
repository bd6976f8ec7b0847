"""Stupid-backoff scores of every document under the counts of all other documents.

A word is scored by the longest run of up to ``order`` words that ends at it, inside its document. If the run w1..wn occurs in another
document, its score is ``c(w1..wn) / c(w1..wn-1)``; else the run without its first word is tried, times ``alpha``; a single word scores
``c(w) / N``. A document's own occurrences are subtracted from every count (runs and N), so its text does not vouch for itself; a
word that occurs nowhere else counts 1. Words are runs without ASCII white space, unchanged. Every run is counted, however rare.

Documents are taken in blocks of about ``BLOCK_BYTES`` of text, or a single longer one. For one length of run after the other, the
distinct runs of a block, with their number in it, are dealt as sorted lists of hashes by part of the hash range; a part sums them over
all blocks, and each block gets the sums in the order of its hashes. At last the words of a block meet its sums. A run is at most one
entry per block, however frequent, so no part is skewed by it. A row for each run and document would not fit the disk: at 8 bytes of
hash alone, the runs of 1 to 3 words take five times the input. One length is dealt at a time, and its shuffle files go before the next.

Runs are told apart by 64-bit hashes: two of 10**9 meet with a chance of 3 %, and would share a count.

Null and empty texts have no words and a null score. Every row is a document of its own, also one that repeats an id or has none.
Texts are read whole, at any length; equal texts have equal scores; an empty table gives an empty result; columns other than the named
ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm.memory import frugal
from loreloom.llm.tables import stage
from loreloom.llm.words import Windows, in_bounds, mix, signed

#: Bytes of text in a block of documents, about.
BLOCK_BYTES = 4 << 20
#: Words of the corpus for each part of the hash range, about.
PART_WORDS = 1_000_000


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, n_words, ids, texts): documents in blocks of bounded size, a row each."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in in_bounds(batches, 1, BLOCK_BYTES):
            n_words = len(split(batch.column(1))[1])
            lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.concat_arrays([c])) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([n_words]), *lists], names=["block", "n_words", "ids", "texts"])
            block += 1

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(gather, "block long, n_words long, ids array<long>, texts array<string>")


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """All words of the texts, one text after the other, and the text of each."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, owner = lists.flatten(), pc.list_parent_indices(lists)
    whole = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty word
    return owner.filter(whole).to_numpy(), words.filter(whole)


class Words:
    """The words of a block's documents, one document after the other; each different word is hashed once."""

    def __init__(self, texts: pa.Array, windows: Windows) -> None:
        #: The document of a word, and the word's place in it.
        self.document, words = split(texts)
        coded = words.dictionary_encode()
        different = [xxhash.xxh3_64_intdigest(word) for word in coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)]
        self.windows = windows
        self.hash = np.array(different, dtype=np.uint64)[coded.indices.to_numpy()]
        self.sizes = np.bincount(self.document, minlength=len(texts))
        self.place = np.arange(len(self.hash)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of ``n`` words inside a document, and the runs' hashes."""
        start = np.flatnonzero(self.place + n <= self.sizes[self.document])
        if not len(start):
            return start, np.zeros(0, dtype=np.uint64)
        return start, mix(self.windows.of(self.hash, n), n)[start]


def own_counts(placed: DataFrame, n: int, parts: int) -> DataFrame:
    """(part, block, hashes, own): every block's distinct runs of ``n`` words by part of the hash range, with their number in it."""
    edges = np.array([(part << 64) // parts for part in range(1, parts)], dtype=np.uint64)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        windows = Windows()
        for batch in batches:
            for block, texts in zip(batch.column("block"), batch.column("texts")):
                hashes, own = np.unique(Words(texts.values, windows).runs(n)[1], return_counts=True)
                cuts = pa.array([0, *np.searchsorted(hashes, edges), len(hashes)], pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(c)) for c in (signed(hashes), own)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(parts)), pa.array(np.full(parts, block.as_py())), *lists], names=["part", "block", "hashes", "own"]
                )

    drawn = placed.select("block", "texts").mapInArrow(draw, "part long, block long, hashes array<long>, own array<long>")
    return drawn.where(F.size("hashes") > 0)


def summed(own: DataFrame) -> DataFrame:
    """(block, part, counts): the runs of ``own`` in the same order, with their number in all blocks."""

    def add(group: pa.Table) -> pa.Table:
        frugal()
        table = group.combine_chunks()
        lists = table.column("hashes").chunk(0)
        _, run = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        total = np.bincount(run, weights=table.column("own").chunk(0).flatten().to_numpy()).astype(np.int64)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        counts = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(total[run]))
        return pa.table({"block": table.column("block"), "part": table.column("part"), "counts": counts})

    return own.groupBy("part").applyInArrow(add, "block long, part long, counts array<long>")


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.4, order: int = 3) -> DataFrame:
    """Per row: id, n_words, n_seen (words after the first whose longest run occurs elsewhere), log_score (sum of natural logarithms),
    mean_log_score."""
    placed, _ = stage(blocks(docs, id_col, text_col), "blocks")
    total = placed.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    parts = 1 + total // PART_WORDS
    tables = [stage(summed(own_counts(placed, n, parts)), f"counts-{n}")[0].withColumn("n", F.lit(n)) for n in range(1, order + 1)]
    counts = reduce(DataFrame.unionByName, tables)

    def score(texts: pa.Table, counts: pa.Table) -> pa.Table:
        frugal()
        row, counts = texts.combine_chunks(), counts.sort_by([("n", "ascending"), ("part", "ascending")])
        words = Words(row.column("texts").chunk(0).flatten(), Windows())
        by_length = [counts.filter(pc.field("n") == n).column("counts").combine_chunks() for n in range(1, order + 1)]
        n_seen, log_score = _scored(words, [c.flatten().to_numpy() for c in by_length], total, alpha)
        return pa.table({
            "id": row.column("ids").chunk(0).flatten(), "n_words": pa.array(words.sizes), "n_seen": pa.array(n_seen), "log_score": pa.array(log_score),
        })

    out = placed.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(score, "id long, n_words long, n_seen long, log_score double")
    value = F.when(F.col("n_words") > 0, F.col("log_score"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_seen", value.alias("log_score"), (value / F.col("n_words")).alias("mean_log_score"))


def _elsewhere(words: Words, n: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of a block's runs of ``n`` words, and how often each occurs in other documents. ``counts``: of its distinct runs, in
    order of their hashes."""
    start, hashes = words.runs(n)
    distinct, run = np.unique(hashes, return_inverse=True)
    left = counts[run] - 1
    again = np.flatnonzero(np.bincount(run)[run] > 1)  # only what the block repeats may repeat in a document
    pair = words.document[start[again]] * len(distinct) + run[again]
    _, at, own = np.unique(pair, return_inverse=True, return_counts=True)
    left[again] -= own[at] - 1
    return start, left


def _scored(words: Words, counts: list[np.ndarray], total: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Per document of a block: words whose longest run is seen, and the score."""
    start, left = _elsewhere(words, 1, counts[0])
    value = np.log(np.maximum(left, 1) / np.maximum(total - words.sizes, 1)[words.document])
    before = left  # by first word, of the runs one word shorter
    n_seen = np.zeros(len(words.sizes), dtype=np.int64)
    for n, own in enumerate(counts[1:], 2):
        start, left = _elsewhere(words, n, own)
        known, end = left > 0, start + n - 1
        value[end] = np.where(known, np.log(np.maximum(left, 1) / np.maximum(before[start], 1)), np.log(alpha) + value[end])
        longest = known if n == len(counts) else known & (words.place[start] == 0)
        n_seen += np.bincount(words.document[start[longest]], minlength=len(n_seen))
        before = np.zeros(len(words.hash), dtype=np.int64)
        before[start] = left
    return n_seen, np.bincount(words.document, weights=value, minlength=len(n_seen)).astype(np.float64)  # int64 without any word
