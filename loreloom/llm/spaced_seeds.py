"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters and digits, lower-cased. A mask selects some of ``SPAN`` consecutive words; the hash of the
selected words is a seed, so a substitution at an ignored position leaves it unchanged. Seeds of the benchmark and of the
documents are joined; around each hit the whole item is laid against the document along the hit's diagonal, and every window
of ``min(overlap, words of the item)`` or more aligned words is tested: ``PERCENT`` of them must match, wherever the others are.
The window with the most matches is reported, without mismatched words at its ends as far as it stays long enough.

Items of fewer than ``SPAN`` words are sought as one exact seed of all their words, all of which must match; items under ``SHORTEST`` words, null or
empty, say too little and match nothing. A Bloom filter of the benchmark's seeds, at most ``MAX_BITS`` bits, keeps other
seeds of the documents from being emitted; its false positives end at the join. Whole texts are read; repeated rows are judged
alike; a null text holds nothing; rows with a null id are judged like others and reported with a null id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm.memory import frugal, trim
from loreloom.llm.tables import stage
from loreloom.llm.words import Windows, WordHashes, in_bounds, mix, rows, signed

#: Fixed masks: 1 selects a word, 0 ignores it.
MASKS = ("11111111", "110110110101", "111001011011", "101110011101")
SPAN, SHORTEST = 12, 5
MIN_BITS, MAX_BITS = 1 << 18, 1 << 28
#: Least share of matching words in a window.
PERCENT = 80
WORD = re.compile(r"[^\W_]+")


def words_of(text: bytes | None, cache: WordHashes) -> np.ndarray:
    return cache.of([w.encode() for w in WORD.findall((text or b"").decode().lower())])


def seeds(h: np.ndarray, number: int) -> np.ndarray:
    """Seed hashes of mask ``number`` at every position."""
    chosen = [i for i, c in enumerate(MASKS[number]) if c == "1"]
    n = len(h) - len(MASKS[number]) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k, i in enumerate(chosen):
        total += h[i : i + n] * np.uint64(pow(0x9E3779B97F4A7C1B, k + 1, 1 << 64))
    return mix(total, 10 + number)


def item_seeds(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, at, hash, n): every seed of every item; ``n`` is the item's number of words if it is one exact seed, else 0."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, windows = WordHashes(), Windows()
        for batch, texts in rows(batches):
            out: list[list] = [[], [], [], []]
            for item, text in zip(batch.column(0).to_pylist(), texts):
                h = words_of(text, cache)
                if SHORTEST <= len(h) < SPAN:
                    found = [(windows.of(h, len(h)), len(h))]
                elif len(h) >= SPAN:
                    found = [(seeds(h, m), 0) for m in range(len(MASKS))]
                else:
                    found = []
                for values, n in found:
                    for at, value in enumerate(signed(values).tolist()):
                        for column, v in zip(out, (item, at, value, n)):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=["item", "at", "hash", "n"])

    source = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(draw, "item long, at long, hash long, n long")


def _slots(bits: int) -> list[Column]:
    return [F.col("hash").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(bits - 1))]


def seed_filter(found: DataFrame) -> np.ndarray:
    """Bit array of the benchmark's seeds, at most ``MAX_BITS`` bits whatever the benchmark's size."""
    count = found.count()
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (1024 * max(count, 1) - 1).bit_length()))
    slots = found.select(F.explode(F.array(*[s + 1 for s in _slots(bits)])).alias("slot"))  # buckets count from 1
    packed = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")
    ).toArrow()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for bucket, bitmap in zip(packed.column("bucket").to_pylist(), packed.column("bitmap").to_pylist()):
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bitmap, dtype=np.uint8)
    return out


def hits(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, text, at, hash): documents with seeds that the filter lets through; ``mark`` hashes the text.

    The text goes along, so that no other text of the corpus is moved afterwards.
    """
    shared = docs.sparkSession.sparkContext.broadcast(seed_filter(found))
    short = sorted(r["n"] for r in found.where("n > 0").select("n").distinct().collect())  # below SPAN, so a few

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        table = shared.value
        last = np.uint64(len(table) * 8 - 1)
        cache, windows = WordHashes(), Windows()
        cache.limit = 100_000

        def inside(values: np.ndarray) -> np.ndarray:
            out = np.arange(len(values))
            for slot in (values & last, (values >> np.uint64(32)) & last):
                slot = slot[out]
                out = out[(table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            return out

        for batch, texts in rows(in_bounds(batches), 1):
            row, at, hashes = [], [], []
            for i, text in enumerate(texts):
                h = words_of(text, cache)
                drawn = [seeds(h, m) for m in range(len(MASKS))] + [windows.of(h, n) for n in short]
                found_at = [inside(values) for values in drawn]
                if any(map(len, found_at)):
                    row.append(i)
                    at.append(np.concatenate(found_at))
                    hashes.append(signed(np.concatenate([v[p] for v, p in zip(drawn, found_at)])))
            own, lists = batch.take(pa.array(row, pa.int64())), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [own.column(0), own.column(2), own.column(1), pa.array(at, lists), pa.array(hashes, lists)], names=["id", "mark", "text", "at", "hash"]
            )
        cache.clear()
        trim()

    return _marked(docs, id_col, text_col).mapInArrow(seek, "id long, mark long, text string, at array<long>, hash array<long>")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.col(text_col).cast("string")).alias("mark"),
    )


def best_window(same: np.ndarray, least: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """Matches, start and end of the window of ``least`` or more aligned words, ``percent`` of them matching, with the most matches.

    Of equal ones the first, cut at its end and then at its start while the outer word does not match. Zeros if there is none.
    """
    matches = np.concatenate([[0], np.cumsum(same, dtype=np.int64)])
    level = 100 * matches - percent * np.arange(len(matches))
    low = np.minimum.accumulate(level)
    # the longest window that ends at a word starts at the first place that lies no higher
    start = np.searchsorted(-low, -level)
    long_enough = np.arange(len(matches)) - start >= least
    if not len(same) or not long_enough.any():
        return 0, 0, 0
    end = int(np.argmax(np.where(long_enough, matches - matches[start], -1)))
    first = int(start[end])
    while end - first > least and not same[end - 1]:
        end -= 1
    while end - first > least and not same[first]:
        first += 1
    return int(matches[end] - matches[first]), first, end


def overlaps(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", overlap: int = 13,
) -> DataFrame:
    """(id, mark, item, start, n_words, n_matching): verified overlaps of documents with items."""
    drawn, _ = stage(item_seeds(items, item_id, item_text), "item-seeds")
    met, _ = stage(hits(docs, drawn, id_col, text_col), "hits")
    seed = drawn.select("hash", F.col("at").alias("q"), "item")
    flat = met.select("id", "mark", F.explode(F.arrays_zip("at", "hash")).alias("h")).select("id", "mark", "h.*")
    diagonals = flat.join(seed, "hash").select("id", "mark", "item", (F.col("at") - F.col("q")).alias("shift")).distinct()
    texts = met.select("id", "mark", "text").dropDuplicates(["id", "mark"])
    want = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("want")).distinct()
    per_text = diagonals.groupBy("id", "mark", "item").agg(F.collect_set("shift").alias("shifts"))  # bounded by one text
    joined = per_text.join(texts, per_text["id"].eqNullSafe(texts["id"]) & (per_text["mark"] == texts["mark"])).select(
        per_text["id"], per_text["mark"], "item", "shifts", "text"
    ).join(want, "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        cache = WordHashes()
        cache.limit = 100_000
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for key, mark, item, shifts, text, other in zip(*(c.to_pylist() for c in batch.columns)):
                h, b = words_of((text or "").encode(), cache), words_of((other or "").encode(), cache)
                least, percent = max(1, min(overlap, len(b))), 100 if len(b) < SPAN else PERCENT
                best = (0, 0, 0)
                for shift in shifts:
                    low, high = max(0, -shift), min(len(b), len(h) - shift)
                    if high - low >= least:
                        n, start, end = best_window(h[low + shift : high + shift] == b[low:high], least, percent)
                        best = max(best, (n, -(low + shift + start), end - start))
                if best[0]:
                    for column, v in zip(out, (key, mark, item, -best[1], best[2], best[0])):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int64()) for v in out], names=["id", "mark", "item", "start", "n_words", "n_matching"]
            )
        cache.clear()
        trim()

    return joined.select("id", "mark", "item", "shifts", "text", "want").mapInArrow(
        verify, "id long, mark long, item long, start long, n_words long, n_matching long"
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a verified overlap, all columns."""
    found, _ = stage(overlaps(docs, items, id_col, text_col, **options).select("id", "mark").distinct(), "contaminated")
    mark = F.xxhash64(docs[text_col].cast("string"))
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(found["id"]) & (mark == found["mark"]), "left_anti")
