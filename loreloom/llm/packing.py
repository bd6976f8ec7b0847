"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

A document is its token ids and one end token; only a longer one is cut, into pieces of ``capacity`` tokens.
A null text is empty and is the end token alone. Every row of the input is packed, repeated rows too.

Which piece goes where depends on lengths only, so the plan is made from the counts of the at most ``capacity``
distinct lengths: a table of bounded size, whatever the corpus. First Martello-Toth dominance reduction fixes
sets that provably dominate every other way to fill a bin with its largest item; then best fit, longest first,
places the rest, on groups of equally filled bins instead of single bins. The plan says for each length which
ranks go into which bins at which offset; a piece finds its rank from a counter inside its task plus the counts
of the tasks before, so no length, however frequent, is gathered anywhere.
"""

from __future__ import annotations

import bisect
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loreloom.llm.memory import frugal, trim
from loreloom.llm.tables import stage
from loreloom.llm.words import in_bounds, rows

END = 1
#: Marks that are one pre-token after letters.
MARKS = frozenset((b".", b",", b";", b":", b"!", b"?"))


class Encoder(dict):
    """``Tokenizer.encode(text, add_special_tokens=False).ids`` as little-endian 32-bit numbers.

    White space separates tokens and yields none, so ids are concatenated over white-space-separated parts, and the
    dict remembers parts: once it holds ``limit``, it starts anew and takes over what is asked for again, so at most twice
    ``limit`` are kept. A part of letters only is one pre-token; where ``probe`` finds that the vocabulary works that way,
    such parts go straight to the merge model. So do letters before a punctuation mark, if they are letters in normal form, too:
    a combining mark at their end would be one token run with the punctuation.
    """

    limit = 100_000
    probe = ("word", "Straße", "Éñçà", "été", "don't", "x1y2", "ΑΣ", "naïve,", "日本語")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(printable)]
        self.table = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.older: dict[bytes, bytes] = {}
        self.direct = True
        self.direct = all(self[p.encode()] == self._whole(p) for p in self.probe)
        self.clear()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, part: bytes) -> bytes:
        value = self.older.get(part)
        if value is None:
            value = self._encoded(part)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[part] = value
        return value

    def _merged(self, mapped: str) -> bytes:
        ids = [token.id for token in self.tokenizer.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encoded(self, part: bytes) -> bytes:
        if not self.direct:
            return self._whole(part.decode())
        # of ASCII letters nothing needs to be normalised, and the byte table leaves them as they are
        if part.isalpha():
            low = part.lower()
            return self._merged(part.decode()) if low == part else self[low]
        if part[-1:] in MARKS and part[:-1].isalpha():
            return self[part[:-1]] + self[part[-1:]]
        text = part.decode()
        if text.isalpha():
            if "Σ" in text or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
                return self._whole(text)
            low = text.lower()
            if low != text:
                return self[low.encode()]
            return self._merged(part.decode("latin-1").translate(self.table))
        if part[-1:] in MARKS and _letters(text[:-1]):
            return self[part[:-1]] + self[part[-1:]]
        return self._whole(text)

    def encode(self, text: bytes) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), dtype="<u4")


def _letters(stem: str) -> bool:
    """Letters, and still letters in normal form and lower case."""
    return stem.isalpha() and (stem.isascii() or unicodedata.normalize("NFC", stem).lower().isalpha())


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str, remembered: int = Encoder.limit) -> Encoder:
    """The Python worker's encoder, kept from task to task; it remembers up to twice as many parts as ``remembered``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].limit = remembered
    return _ENCODERS[path]


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, list[tuple[int, int]]]], dict[int, int]]:
    """Bins fixed by dominance as (how many, [(length, items per bin)]), and the counts that remain.

    With j the longest item and k the longest that fits beside it, {j, k} dominates every other bin with j when no
    set of other items that fits beside j is longer than k: then exchanging such a set for k loses nothing.
    """
    left = {n: c for n, c in counts.items() if c}
    fixed: list[tuple[int, list[tuple[int, int]]]] = []
    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                room = capacity - j
                sizes = np.array(sorted(n for n, c in left.items() if c - (n == j)), dtype=np.int64)
                fitting = sizes[sizes <= room]
                if not len(fitting):
                    times, items = left[j], [(j, 1)]
                else:
                    k = int(fitting[-1])
                    if k != room and not _alone(fitting, left, j, k, room):
                        break
                    times = left[j] // 2 if k == j else min(left[j], left[k])
                    items = [(j, 2)] if k == j else [(j, 1), (k, 1)]
                fixed.append((times, items))
                for n, per in items:
                    left[n] -= times * per
                    if not left[n]:
                        del left[n]
                changed = True
    return fixed, left


def _alone(fitting: np.ndarray, left: dict[int, int], j: int, k: int, room: int) -> bool:
    """No set of two or more items beside j lies above k: true if pairs cannot and triples do not fit."""
    have = [left[int(n)] - (int(n) == j) for n in fitting[:3]]
    low = [int(n) for n, c in zip(fitting[:3], have) for _ in range(min(c, 3))][:3]
    if len(low) < 2 or low[0] + low[1] > room:
        return True
    if len(low) >= 3 and sum(low) <= room:
        return False
    mate = fitting[np.maximum(np.searchsorted(fitting, room - fitting, side="right") - 1, 0)]
    pair = (fitting + mate)[fitting + mate <= room]
    return not len(pair) or int(pair.max()) <= k


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, on groups of equally filled bins."""
    groups: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, times: int, items: list[tuple[int, int]]) -> None:
        if times:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append([times, items])

    for n in sorted(counts, reverse=True):
        c = counts[n]
        while c:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                room, times, items, new = capacity, -(-c // (capacity // n)), [], True
            else:
                room = rooms[at]
                times, items = groups[room].pop()
                new = False
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            per = room // n
            full, rest = min(times, c // per), 0
            put(room - per * n, full, [*items, (n, per)])
            c -= full * per
            if full < times:
                rest = c
                if rest:
                    put(room - rest * n, 1, [*items, (n, rest)])
                    c = 0
                if not new:
                    put(room, times - full - bool(rest), items)
    return [(times, items) for found in groups.values() for times, items in found]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, items per bin, offset) rows that place every rank of every length."""
    fixed, left = reduce_by_dominance(counts, capacity)
    used: dict[int, int] = {}
    out, first = [], 0
    for times, items in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for n, per in items:
            rank = used.get(n, 0)
            used[n] = rank + times * per
            out.append((n, rank, used[n], first, per, offset))
            offset += n * per
        first += times
    return out


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, keep_ids: bool, remembered: int) -> DataFrame:
    """Pieces with their task and their rank among the task's pieces of that length."""
    fields = "id long, piece int, start long, length long, ids_crc32 long, part int, rank long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        encoder = encoder_of(tokenizer, remembered)
        part, seen = TaskContext.get().partitionId(), {}
        for batch, texts in rows(in_bounds(batches)):
            out: list[list] = [[] for _ in range(8)]
            for key, text in zip(batch.column(0).to_pylist(), texts):
                ids = np.append(encoder.encode(text or b""), np.uint32(END)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    rank = seen.get(len(own), 0)
                    seen[len(own)] = rank + 1
                    for column, value in zip(out, (key, piece, start, len(own), zlib.crc32(own.tobytes()), part, rank, own if keep_ids else None)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            arrays = [pa.array(v, k) for v, k in zip(out, kinds)]
            names = ["id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            if keep_ids:
                arrays.append(pa.array([v.astype(np.int32) for v in out[7]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        trim()

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(cut, fields + (", ids array<int>" if keep_ids else ""))


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, keep_ids: bool = False,
    remembered: int = Encoder.limit,
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids). ``remembered`` trades memory of the workers, about
    400 bytes for each, for time; it changes no result."""
    cut, _ = stage(pieces(docs, tokenizer, id_col, text_col, capacity, keep_ids, remembered), "pieces")
    by_part, _ = stage(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    slots = docs.sparkSession.createDataFrame(
        plan(counts, capacity), "n long, low long, high long, bin long, per long, at long"
    )
    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    # at most a few rows per distinct length: bounded by the capacity, not by the corpus
    placed = ranked.join(
        F.broadcast(slots), (F.col("length") == F.col("n")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    )
    index = F.col("rank") - F.col("low")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("bin") + F.floor(index / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + index % F.col("per") * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if keep_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed tokens themselves, from ``pack(..., keep_ids=True)``; a sequence is bounded by the capacity."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
