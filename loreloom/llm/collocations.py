"""Collocations by prefix-free parsing: phrases are counted in a dictionary of text chunks instead of in the text.

Texts (``A-Z`` lower-cased) are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, and those at spaces and tabs into words. Inside a piece a
window of ``OVERLAP`` words whose hash says so is a trigger. A chunk runs from a trigger, or the start of the piece, through the next
trigger, or to the piece's end; so neighbours share a trigger, and equal passages are cut alike wherever they stand. The distinct
chunks of a language form its dictionary, with the number of times each occurs in the parse. Every run of up to ``OVERLAP + 1``
words lies whole in the chunk in which it starts, and the words of a chunk's closing trigger start runs of the next chunk only: so
runs are counted once in each distinct chunk and weighted with its frequency.

A phrase can only be frequent if its parts are. So words are counted first, then pairs of frequent words, then runs of three and four
words whose pairs are all frequent; a Bloom filter of bounded size says which those are, and its false positives only cost time,
since every count is exact and cut at the least frequency afterwards. All parts of a frequent phrase are counted on the way.

Score of a phrase of a occurrences, cut into a first part of l and a rest of r: ``floor(2000000 * a / (l + r))`` in exact decimal
arithmetic; the lowest-scoring cut counts, the shortest first part among equal ones. A phrase inside a longer frequent one that has
``contained`` percent of its occurrences or more is dropped.

Words are told apart by 64-bit hashes of language and word while they are counted; frequent ones keep their text.

Null and empty texts hold no words; a null language is ``und``. Texts are read whole, at any length: a piece without a trigger is one
chunk. Repeated rows count each time. Equal scores stand by frequency, then by phrase in byte order. An empty table gives an empty
result. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loreloom.llm.tables import stage
from loreloom.llm.words import WordHashes, in_bounds, mix, rows, signed

#: Words that neighbouring chunks share, and the longest phrase's words less one.
OVERLAP = 3
#: One window in so many is a trigger.
TRIGGER = 16
#: Distinct chunks that a task holds before it passes their counts on.
HELD = 200_000
#: Bytes of chunks whose runs are counted at once.
CHUNK_BYTES = 8 << 20
#: Parts of a language whose best phrases are taken first.
PARTS = 64
#: Bits of the filters per member, and at most.
MEMBER_BITS, MAX_BITS = 16, 1 << 27

#: Piece separators as one word of their own.
STOP = b"."
_FIXED = bytes(ord(STOP) if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, with ``STOP`` between pieces."""
    return text.lower().translate(_FIXED).replace(STOP, b" . ").split()


class Hashes(WordHashes):
    """Word hashes; ``STOP`` is zero."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        value = super().__missing__(word)
        if word == STOP:
            value = self[word] = 0
        return value


def chunk_bounds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and whether it closes its piece, for the chunks of a token array, in which zero is ``STOP``."""
    word = h != 0
    before = np.concatenate([[False], word[:-1]])
    opens = word & ~before
    whole = np.zeros(len(h), dtype=bool)
    n = len(h) - OVERLAP + 1
    if n > 0:
        window, whole[:n] = np.zeros(n, dtype=np.uint64), True
        for k in range(OVERLAP):
            window += h[k : k + n] * np.uint64(2 * k + 0x9E3779B97F4A7C15)
            whole[:n] &= word[k : k + n]
        whole[:n] &= mix(window, 5) % np.uint64(TRIGGER) == 0
    start = np.flatnonzero(opens | whole)
    ends = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1  # of the pieces
    end = ends[np.searchsorted(ends, start, side="right")] if len(start) else start
    following = np.append(start[1:], len(h) + 1)
    last = following >= end
    return start, np.where(last, end, following + OVERLAP), last


def parse(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, chunk, last, n): the dictionary with parse frequencies; ``last`` chunks close their piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, counts = Hashes(), Counter()

        def flush() -> pa.RecordBatch:
            keys = [k.split(b"\n", 2) for k in counts]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([k[2] for k in keys], pa.binary()).cast(pa.string()), pa.array([k[0] for k in keys], pa.binary()),
                    pa.array([k[1] == b"1" for k in keys], pa.bool_()), pa.array(list(counts.values()), pa.int64()),
                ],
                names=["lang", "chunk", "last", "n"],
            )
            counts.clear()
            return out

        for batch, texts in rows(in_bounds(batches, 0), 0):
            langs = batch.column(1).to_pylist()
            words: list[bytes] = []
            ends = []
            for text in texts:
                words += tokens(text or b"")
                words.append(STOP)
                ends.append(len(words))
            start, end, last = chunk_bounds(cache.of(words))
            owner = np.searchsorted(np.array(ends), start, side="right")
            tails = [(b"\n0\n" + l.encode(), b"\n1\n" + l.encode()) for l in langs]
            counts.update(
                b" ".join(words[a:b]) + tails[d][z] for a, b, d, z in zip(start.tolist(), end.tolist(), owner.tolist(), last.tolist())
            )
            if len(counts) >= HELD:
                yield flush()
        yield flush()

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    source = docs.select(F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    found = source.mapInArrow(cut, "lang string, chunk binary, last boolean, n long")
    return found.groupBy("lang", "chunk", "last").agg(F.sum("n").alias("n"))


class Chunks:
    """The words of some dictionary rows as one array, with each word's row, and the runs of words that count."""

    def __init__(self, batch: pa.RecordBatch, cache: Hashes) -> None:
        self.langs = batch.column(0).to_pylist()
        chunks = batch.column(1).to_pylist()
        self.words = b" ".join(chunks).split(b" ") if chunks else []
        length = np.fromiter((c.count(b" ") + 1 for c in chunks), dtype=np.int64, count=len(chunks))
        closes = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        weight = batch.column(3).to_numpy()
        # the line break keeps a language apart from the word that is spelled like it
        seed = {x: np.uint64(xxhash.xxh3_64_intdigest(b"\n" + x.encode())) for x in set(self.langs)}
        self.row = np.repeat(np.arange(len(chunks)), length)
        self.h = mix(cache.of(self.words) ^ np.array([seed[x] for x in self.langs], dtype=np.uint64)[self.row], 7) if chunks else np.zeros(0, np.uint64)
        self.weight = weight[self.row]
        # places from a word to the chunk's end, and whether runs that start at it are this chunk's
        self.left = np.repeat(np.cumsum(length), length) - np.arange(len(self.row))
        self.own = closes[self.row] | (self.left > OVERLAP)

    def runs(self, size: int, good: np.ndarray) -> np.ndarray:
        """Starts of the runs of ``size`` words that count, all of whose words but the last have ``good``."""
        start = np.flatnonzero(self.own & (self.left >= size))
        for k in range(size - 1):
            start = start[good[start + k]]
        return start


def summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, and the sum of its weights."""
    order = np.argsort(key)
    if not len(order):
        return order, weight[order]
    k = key[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return order[first], np.add.reduceat(weight[order], first)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``CHUNK_BYTES`` of chunks."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in in_bounds(batches, 1, CHUNK_BYTES):
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and (rest := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield rest[0]


def word_counts(parsed: DataFrame) -> DataFrame:
    """(word_hash, lang, word, n) of every word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Hashes()
        for batch in _gathered(batches):
            c = Chunks(batch, cache)
            own = np.flatnonzero(c.own)
            at, n = summed(c.h[own], c.weight[own])
            at = own[at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(c.h[at])), pa.array([c.langs[r] for r in c.row[at].tolist()], pa.string()),
                    pa.array([c.words[i] for i in at.tolist()], pa.binary()).cast(pa.string()), pa.array(n, pa.int64()),
                ],
                names=["word_hash", "lang", "word", "n"],
            )

    found = parsed.mapInArrow(count, "word_hash long, lang string, word string, n long")
    return found.groupBy("word_hash", "lang", "word").agg(F.sum("n").alias("n"))


def _slots(key: Column, bits: int) -> list[Column]:
    return [key.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(bits - 1))]


class Filter:
    """A Bloom filter of 64-bit keys: two bits a key, of at most ``MAX_BITS``."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def of(cls, keys: DataFrame) -> Filter:
        """Of a table with the column ``key``."""
        bits = min(MAX_BITS, max(1 << 18, 1 << (MEMBER_BITS * max(keys.count(), 1) - 1).bit_length()))
        slots = keys.select(F.explode(F.array(*[s + 1 for s in _slots(F.col("key"), bits)])).alias("slot"))  # buckets count from 1
        packed = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")
        ).toArrow()
        out = np.zeros(bits // 8, dtype=np.uint8)
        for bucket, bitmap in zip(packed.column("bucket").to_pylist(), packed.column("bitmap").to_pylist()):
            out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bitmap, dtype=np.uint8)
        return cls(out)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        last = np.uint64(len(self.table) * 8 - 1)
        out = np.ones(len(keys), dtype=bool)
        for slot in (keys & last, (keys >> np.uint64(32)) & last):
            out &= (self.table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def pair_key(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return mix(one * np.uint64(0x9E3779B97F4A7C15) + two, 11)


def pair_counts(parsed: DataFrame, frequent: DataFrame) -> DataFrame:
    """(key, hashes, n) of the pairs of two words in ``frequent`` (word_hash), and of few others."""
    shared = parsed.sparkSession.sparkContext.broadcast(Filter.of(frequent.select(F.col("word_hash").alias("key"))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Hashes()
        for batch in _gathered(batches):
            c = Chunks(batch, cache)
            good = shared.value.holds(c.h)
            start = c.runs(2, good)
            start = start[good[start + 1]]
            key = pair_key(c.h[start], c.h[start + 1])
            at, n = summed(key, c.weight[start])
            at = start[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(pair_key(c.h[at], c.h[at + 1]))), pa.array(signed(c.h[at])), pa.array(signed(c.h[at + 1])), pa.array(n, pa.int64())],
                names=["key", "a", "b", "n"],
            )

    found = parsed.mapInArrow(count, "key long, a long, b long, n long").groupBy("a", "b").agg(F.first("key").alias("key"), F.sum("n").alias("n"))
    return found.select("key", F.array("a", "b").alias("hashes"), "n")


def long_counts(parsed: DataFrame, frequent: DataFrame, sizes: range) -> DataFrame:
    """(hashes, n) of the runs of ``sizes`` words all of whose pairs are in ``frequent`` (key), and of few others."""
    shared = parsed.sparkSession.sparkContext.broadcast(Filter.of(frequent.select("key")))
    names = [f"w{i}" for i in range(sizes[-1])]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Hashes()
        for batch in _gathered(batches):
            c = Chunks(batch, cache)
            good = np.zeros(len(c.h), dtype=bool)
            if len(c.h) > 1:
                good[:-1] = shared.value.holds(pair_key(c.h[:-1], c.h[1:]))
            for size in sizes:
                start = c.runs(size, good)
                key = c.h[start].copy()
                for k in range(1, size):
                    key = pair_key(key, c.h[start + k])
                at, n = summed(key, c.weight[start])
                at = start[at]
                words = [pa.array(signed(c.h[at + k])) if k < size else pa.nulls(len(at), pa.int64()) for k in range(sizes[-1])]
                yield pa.RecordBatch.from_arrays([*words, pa.array(n, pa.int64())], names=[*names, "n"])

    found = parsed.mapInArrow(count, ", ".join(f"{w} long" for w in names) + ", n long").groupBy(*names).agg(F.sum("n").alias("n"))
    return found.select(F.filter(F.array(*names), lambda w: w.isNotNull()).alias("hashes"), "n")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(lang, words, n) of every phrase of 1 to ``OVERLAP + 1`` words that occurs ``least`` times, and (lang, total) words."""
    parsed, _ = stage(parse(docs, text_col, lang_col), "dictionary")
    counted, _ = stage(word_counts(parsed), "word-counts")
    totals, _ = stage(counted.groupBy("lang").agg(F.sum("n").alias("total")), "word-totals")
    words, _ = stage(counted.where(F.col("n") >= least), "frequent-words")
    pairs, _ = stage(pair_counts(parsed, words).where(F.col("n") >= least), "frequent-pairs")
    longer, _ = stage(long_counts(parsed, pairs, range(3, OVERLAP + 2)).where(F.col("n") >= least), "frequent-runs")
    runs = pairs.select("hashes", "n").unionByName(longer)
    parts = runs.select("hashes", "n", F.posexplode("hashes").alias("at", "word_hash")).join(words.select("word_hash", "lang", "word"), "word_hash")
    named = parts.groupBy("hashes", "n").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    named = named.where(F.size("w") == F.size("hashes")).select("lang", F.col("w.word").alias("words"), "n")
    out, _ = stage(words.select("lang", F.array("word").alias("words"), "n").unionByName(named), "frequent-phrases")
    return out, totals


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, contained: int = 80, top: int | None = 2000
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best collocations; ``top`` None ranks them all."""
    phrases, totals = frequent_phrases(docs, text_col, lang_col, least)
    text = lambda words: F.array_join(words, " ")
    counts = phrases.select("lang", text(F.col("words")).alias("part"), "n")
    candidates = phrases.where(F.size("words") > 1).select("lang", text(F.col("words")).alias("phrase"), "words", F.col("n").alias("a"))

    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", text(F.slice("words", F.lit(1), F.col("k"))).alias("first"),
        text(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))).alias("rest"),
    )
    cuts = cuts.join(counts.select("lang", F.col("part").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(
        counts.select("lang", F.col("part").alias("rest"), F.col("n").alias("r")), ["lang", "rest"]
    )
    score = F.expr("cast(cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r) as long)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("c")
    )

    spans = candidates.where(F.size("words") > 2).select(
        "lang", "words", F.col("a").alias("longer"), F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size")
    )
    spans = spans.select("lang", "words", "longer", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    inside = spans.groupBy("lang", text(F.slice("words", F.col("at"), F.col("size"))).alias("phrase")).agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20, 0)") * 100 < F.col("a").cast("decimal(20, 0)") * contained)
    )
    order = F.desc("c.score"), F.desc("a"), "phrase"
    if top is not None:  # of each part of a language first, so that what meets in one task does not grow with the corpus
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
        kept = kept.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("rank")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked.where(F.col("rank") <= top) if top is not None else ranked
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "c.l", "c.r", F.col("total").alias("n"), "c.score")
