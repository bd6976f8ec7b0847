"""Near duplicates by HyperMinHash registers, banding, and confirmation on whole shingle sets.

A document's set holds the distinct ``words``-word shingles of its text, ASCII letters lower-cased;
a shorter text is one shingle, a text without words (or a null text) has the empty set and no links.
Two documents are linked when ``100 * |A and B| >= percent * |A or B|``.

How it runs:

1. one pass over the texts yields, per document, the set's size, a 128-bit digest of the set, and one
   byte per register: the leading zeros of the smallest hash in the register (4 bits) and the next 4
   bits of it (the mantissa). Documents with equal sets become one vertex, so copies cost one row each;
2. ``BANDS`` keys of ``ROWS`` registers; vertices that share a key are compared with the smallest vertex of
   that bucket, first by the estimate (corrected for registers that agree by chance), then by whole sets;
3. a bucket that is one component needs no further pair: links inside it cannot change the answer. For the vertices of the
   other buckets the shingles that nobody else there has are counted. They bound every intersection exactly, so most members of a family
   of edited copies turn out to have no partner at all; the rest are compared with the vertex that has the fewest such shingles;
4. pairs across components that the bounds and the triangle inequality still allow are compared in blocks, by 16-bit marks of
   all shingles (which bound the intersection from above), by estimate, and then by whole sets. Nothing is capped or sampled.

With 48 bands of 6 registers a pair of similarity 0.8 misses every band with probability 5e-7.

Rows with a null id keep their set size, have no component and are kept. Rows that repeat an id belong
together. An empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm import bloom_dedup
from loreloom.llm.components import components
from loreloom.llm.memory import frugal, trim
from loreloom.llm.tables import drop, stage
from loreloom.llm.words import Windows, WordHashes, in_bounds, mix, rows, signed

BANDS, ROWS = 48, 6
REGISTERS = BANDS * ROWS
#: A register without any element.
EMPTY = 255
#: Estimates this many standard deviations below the threshold are dropped unconfirmed.
SIGMAS = 6
#: Vertices of a bucket that one task compares with as many others.
BLOCK = 1024
#: Slices of the hash range for each partition of a shuffle, in which shingles are counted.
SLICES = 4
#: Shingles of a set whose 16-bit marks are compared before its estimate.
SMALL = 2000


class Hashes(WordHashes):
    """Fewer words at a time, as up to four Python workers of an executor each hold some."""

    limit = 100_000


def shingles(words: list[bytes], size: int, cache: WordHashes, windows: Windows) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(windows.of(cache.of(words), min(size, len(words))))


def registers(elements: np.ndarray) -> np.ndarray:
    """Leading-zero count and mantissa of the smallest hash per register, one byte each."""
    smallest = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    which = (elements % np.uint64(REGISTERS)).astype(np.int64)
    np.minimum.at(smallest, which, mix(elements, 1))
    out = np.full(REGISTERS, EMPTY, dtype=np.uint8)
    used = np.zeros(REGISTERS, dtype=bool)
    used[which] = True
    value = smallest[used]
    zeros = np.minimum(64 - np.frexp((value >> np.uint64(11)).astype(np.float64))[1] - 11, 14).astype(np.uint64)
    mantissa = (value << (zeros + np.uint64(1))) >> np.uint64(60)
    out[used] = (zeros * np.uint64(16) + mantissa).astype(np.uint8)
    return out


def _cells() -> tuple[np.ndarray, np.ndarray]:
    """The interval of hashes, as fractions of the range, behind each register value."""
    low = np.zeros(240)
    high = np.zeros(240)
    for z in range(15):
        for m in range(16):
            low[16 * z + m] = 2.0 ** -(z + 1) * (1 + m / 16)
            high[16 * z + m] = 2.0 ** -(z + 1) * (1 + (m + 1) / 16)
    low[224] = 0.0
    return low, high


LOW, HIGH = _cells()


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Share of used registers in which unrelated sets of sizes n and m agree."""
    def cells(size):
        load = np.asarray(size, dtype=np.float64)[:, None] / REGISTERS
        return np.exp(-load * LOW) - np.exp(-load * HIGH)

    used = 1 - np.exp(-(np.asarray(n, dtype=np.float64) + m) / REGISTERS)
    return (cells(n) * cells(m)).sum(axis=1) / np.maximum(used, 1e-9)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of register rows, corrected for chance agreement, and the used registers."""
    used = ((x != EMPTY) | (y != EMPTY)).sum(axis=1)
    same = ((x == y) & (x != EMPTY)).sum(axis=1)
    by_chance = np.minimum(chance(n, m), 0.9)
    return (same / np.maximum(used, 1) - by_chance) / (1 - by_chance), used


def plausible(est: np.ndarray, used: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that the estimate cannot rule out; sizes rule out exactly."""
    least = percent / 100
    slack = SIGMAS * np.sqrt(least * (1 - least) / np.maximum(used, 1)) + 1 / np.maximum(used, 1)
    return (est >= least - slack) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, n, digest, regs) of every row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        cache, windows = Hashes(), Windows()
        for batch, texts in rows(in_bounds(batches)):
            n, digest, regs = [], [], []
            for text in texts:
                own = shingles((text or b"").lower().split(), words, cache, windows)
                n.append(len(own))
                digest.append(xxhash.xxh3_128_digest(own.tobytes()))
                regs.append(registers(own).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())],
                names=["id", "n", "digest", "regs"],
            )
        del cache, windows
        trim()

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(sketch, "id long, n long, digest binary, regs binary")


def _estimated(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, n, m, x, y) to the plausible (a, b, est)."""

    def compare(batches):
        frugal()
        for batch in (b.slice(k, 2048) for b in batches for k in range(0, b.num_rows, 2048)):
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, REGISTERS) for i in (4, 5))
            est, used = estimate(x, y, n, m)
            keep = pa.array(plausible(est, used, n, m, percent))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(est)], names=["a", "b", "est"])
            yield out.filter(keep)
        trim()

    return pairs.mapInArrow(compare, "a long, b long, est double")


def _texts_of(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the documents in ``nodes``, and a few others: a Bloom filter of bounded size keeps most out of the joins after it."""
    keys, _ = stage(nodes.select(F.xxhash64("node").alias("digest")), "text-keys")
    bits = bloom_dedup.filter_bits(keys.count())
    bitmaps, _ = stage(bloom_dedup.member_filter(keys, bits), "text-filter")
    node = F.col(id_col).cast("long")
    texts = docs.select(node.alias("node"), F.col(text_col).cast("string").alias("text"), F.xxhash64(node).alias("digest"))
    return bloom_dedup.maybe_repeated(texts, bitmaps, bits).where("maybe").select("node", "text")


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(a, b) to (a, b, common, total) from the whole texts; ``common`` over ``total`` is the similarity."""

    def confirm(batches):
        frugal()
        cache, windows = Hashes(), Windows()
        last: tuple = (None, None)
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            a, b, common, total = [], [], [], []
            left, right = (batch.column(i).cast(pa.binary()).to_pylist() for i in (2, 3))
            for i, (s, t) in enumerate(zip(left, right)):
                if last[0] != t:
                    last = (t, shingles((t or b"").lower().split(), words, cache, windows))
                own = shingles((s or b"").lower().split(), words, cache, windows)
                both = len(np.intersect1d(own, last[1], assume_unique=True))
                a.append(batch.column(0)[i].as_py())
                b.append(batch.column(1)[i].as_py())
                common.append(both)
                total.append(len(own) + len(last[1]) - both)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int64()) for v in (a, b, common, total)], names=["a", "b", "common", "total"]
            )
        del cache, windows, last
        trim()

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = _texts_of(ends, docs, id_col, text_col).select(F.col("node").alias("id"), "text")
    left = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("s")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("t")), "b")
    found = both.select("a", "b", "s", "t").mapInArrow(confirm, "a long, b long, common long, total long")
    return found


def _links(frame: DataFrame, percent: int) -> DataFrame:
    return frame.where((F.col("total") > 0) & (100 * F.col("common") >= percent * F.col("total"))).select("a", "b")


def _band_keys() -> Column:
    one = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.struct(i.alias("band"), F.col("regs").substr(i * ROWS + 1, F.lit(ROWS)).alias("part")),
    )
    return F.transform(F.filter(one, lambda s: s["part"] != F.unhex(F.lit("FF" * ROWS))), lambda s: F.xxhash64(s["band"], s["part"]))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links), kept (is that id)."""
    # 1: sketches, and equal sets folded to their smallest id
    spark = docs.sparkSession
    drawn, drawn_path = stage(sketches(docs, id_col, text_col, words), "sketches")
    known = drawn.where("n > 0 and id is not null")
    vertices, _ = stage(
        known.groupBy("digest").agg(
            F.min("id").alias("node"), F.first("n").alias("n"), F.first("regs").alias("regs")
        ),
        "vertices",
    )
    member = known.select("id", "digest").join(vertices.select("digest", "node"), "digest").select("id", "node")
    member, _ = stage(member, "members")
    # the registers are kept with the vertices only
    drawn, _ = stage(drawn.select("id", "n", "digest"), "sizes")
    drop(spark, drawn_path)
    several = member.groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    repeated = member.join(several.select("id"), "id", "left_semi").select(F.col("id").alias("a"), F.col("node").alias("b"))

    # 2: buckets of two vertices or more, each compared with the bucket's smallest
    shared, shared_path = stage(_shared(vertices.select(F.explode(_band_keys()).alias("key"), "node")), "buckets")
    node = vertices.select("node", "n", "regs")
    stars = shared.where("node <> hub").select("node", "hub").distinct()
    stars = stars.join(node.select("node", "n", F.col("regs").alias("x")), "node").join(
        node.select(F.col("node").alias("hub"), F.col("n").alias("m"), F.col("regs").alias("y")), "hub"
    )
    likely = _estimated(stars.select(F.col("node").alias("a"), F.col("hub").alias("b"), "n", "m", "x", "y"), percent)
    best = likely.groupBy("a").agg(F.max_by("b", F.struct("est", -F.col("b"))).alias("b"))
    best, _ = stage(best, "stars")
    tried, _ = stage(confirmed(best, docs, id_col, text_col, words, percent), "tried")
    tried = tried.groupBy("a", "b").agg(F.max_by(F.struct("common", "total"), F.col("common") / F.col("total")).alias("s"))
    tried = tried.select("a", "b", "s.common", "s.total")
    first = _links(tried, percent)

    # 3: buckets that are not one component yet, compared with their most ordinary vertex
    texts = (docs, id_col, text_col, words)
    label = components(first.unionByName(repeated))
    open_, open_path = stage(_open(shared.select("key", "node"), label), "open-buckets")
    drop(spark, shared_path)
    alone = _alone_counts(open_.select("node").distinct(), *texts)
    # an id of several texts is no single set: nothing counts as its own
    alone = alone.join(several.select(F.col("id").alias("node"), F.lit(0).alias("none")), "node", "left").select(
        "node", F.coalesce("none", "alone").alias("alone")
    )
    known_size = vertices.select("node", "n").join(alone, "node").select("node", "n", (F.col("n") - F.col("alone")).alias("shared"))
    known_size, _ = stage(known_size, "shared-sizes")
    open_, _ = stage(_linkable(open_.join(known_size, "node"), percent), "linkable")
    drop(spark, open_path)
    lightest = open_.groupBy("key").agg(
        F.min_by(F.struct("node", "n", "shared", "component"), F.struct(-F.col("shared") / F.col("n"), "node")).alias("h")
    )
    second = open_.join(lightest, "key").where(F.col("component") != F.col("h.component")).where(
        _bound(F.col("n"), F.col("shared"), F.col("h.n"), F.col("h.shared"), percent)
    ).select(F.greatest("node", "h.node").alias("a"), F.least("node", "h.node").alias("b"), "node").distinct()
    second = second.join(node.select(F.col("node").alias("a"), "n", F.col("regs").alias("x")), "a").join(
        node.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("regs").alias("y")), "b"
    )
    likely = _estimated(second.select("a", "b", "n", "m", "x", "y"), percent).distinct()
    likely, _ = stage(likely.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "second-stars")
    again, _ = stage(confirmed(likely, *texts, percent), "second-tried")
    again = again.groupBy("a", "b").agg(F.max_by(F.struct("common", "total"), F.col("common") / F.col("total")).alias("s"))
    again = again.select("a", "b", "s.common", "s.total")
    linked = first.unionByName(_links(again, percent)).unionByName(repeated)

    # 4: what is left in buckets of several components, pair by pair in blocks
    rest = _linkable(_open(open_.select("key", "node"), components(linked)).join(known_size, "node"), percent)
    both = tried.unionByName(again)
    distance = both.select(F.col("a").alias("node"), F.col("b").alias("hub"), (1 - F.col("common") / F.col("total")).alias("far"))
    distance = distance.groupBy("node").agg(F.min_by("hub", F.struct("far", "hub")).alias("hub"), F.min("far").alias("far"))
    rest, _ = stage(rest, "rest")
    marks = _marks(rest.select("node").distinct().join(several.select(F.col("id").alias("node")), "node", "left_anti"), *texts)
    rest = rest.join(node.select("node", "regs"), "node").join(distance, "node", "left").join(marks, "node", "left")
    across, _ = stage(_across(rest, percent).distinct().join(both.select("a", "b"), ["a", "b"], "left_anti"), "across")
    third = _links(confirmed(across, *texts, percent), percent)
    links, _ = stage(linked.unionByName(third), "all-links")
    final = components(links).withColumnsRenamed({"node": "node_", "component": "component_"})

    own = drawn.select("id", "n", "digest").join(vertices.select("digest", "node"), "digest", "left")
    own = own.join(final, F.col("node") == F.col("node_"), "left")
    lone = (F.col("n") == 0) | F.col("id").isNull()
    component = F.when(lone, F.col("id")).otherwise(F.coalesce("component_", "node"))
    return own.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _shared(entries: DataFrame) -> DataFrame:
    """(key, node, hub) of the buckets of two vertices or more; entries are dealt by key once, for the sums and for the join."""
    entries = entries.repartition("key")
    hubs = entries.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("high"))
    return entries.join(hubs.where("hub < high").drop("high"), "key")


def _open(entries: DataFrame, label: DataFrame) -> DataFrame:
    """(key, node, component) of the buckets whose vertices lie in several components."""
    placed = entries.join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return placed.join(several.select("key"), "key")


def _sliced(nodes: np.ndarray, elements: np.ndarray, slices: int) -> pa.RecordBatch:
    """(slice, nodes, shingles): a row for each slice of the hash range that has any."""
    slice_ = (elements % np.uint64(slices)).astype(np.int32)
    by = np.argsort(slice_, kind="stable")
    slice_ = slice_[by]
    start = np.flatnonzero(np.diff(slice_, prepend=-1))
    ends = pa.array(np.append(start, len(by)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(v[by])) for v in (nodes, signed(elements))]
    return pa.RecordBatch.from_arrays([pa.array(slice_[start]), *lists], names=["slice", "nodes", "shingles"])


def _alone_counts(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(node, alone): how many shingles of each vertex no other of ``nodes`` has."""

    slices = SLICES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        cache, windows = Hashes(), Windows()
        for batch, texts in rows(in_bounds(batches)):
            each = [shingles((t or b"").lower().split(), words, cache, windows) for t in texts]
            yield _sliced(np.repeat(batch.column(0).to_numpy(), [len(e) for e in each]), np.concatenate(each), slices)
        del cache, windows
        trim()

    texts = _texts_of(nodes, docs, id_col, text_col)
    drawn = texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(
        draw, "slice int, nodes array<long>, shingles array<long>"
    )
    # dealt once, by slice: the sums need no further exchange, and a shingle costs its hash instead of a row
    drawn = drawn.repartition("slice").select("slice", F.explode(F.arrays_zip("nodes", "shingles")).alias("one"))
    drawn = drawn.select("slice", F.col("one.nodes").alias("node"), F.col("one.shingles").alias("shingle"))
    single = drawn.groupBy("slice", "shingle").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
    counts = single.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    return nodes.join(counts, "node", "left").select("node", F.coalesce("alone", F.lit(0)).alias("alone"))


def _marks(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(node, marks): the distinct low 16 bits of a vertex's shingles, for sets of up to ``SMALL`` shingles."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, windows = Hashes(), Windows()
        for batch, texts in rows(in_bounds(batches)):
            each = [shingles((t or b"").lower().split(), words, cache, windows) for t in texts]
            marks = [np.unique(e.astype(np.uint16)).tobytes() if len(e) <= SMALL else None for e in each]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary())], names=["node", "marks"])
        del cache, windows
        trim()

    texts = _texts_of(nodes, docs, id_col, text_col)
    drawn = texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(draw, "node long, marks binary")
    return drawn.groupBy("node").agg(F.first("marks").alias("marks"))


def _bound(n: Column, shared: Column, m: Column, other: Column, percent: int) -> Column:
    """Whether two sets can be linked: their intersection lies within what each shares with anyone."""
    return (100 + percent) * F.least(shared, other) >= percent * (n + m)


def _linkable(entries: DataFrame, percent: int) -> DataFrame:
    """Entries that can have a partner in their bucket; exact.

    A partner of A has at least ``percent`` of A's size, and at least the smallest size in the bucket, and the intersection is at
    most what A shares with anyone. A vertex with many shingles of its own has no partner, however large its family is.
    """
    smallest = entries.groupBy("key").agg(F.min("n").alias("smallest"))
    joined = entries.join(smallest, "key")
    least = F.greatest(percent / 100 * F.col("n"), F.col("smallest"))
    return joined.where((100 + percent) * F.col("shared") >= percent * (F.col("n") + least) - 1e-6).drop("smallest")


def _across(rest: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs of vertices of one bucket in different components.

    A bucket is cut into blocks of about ``BLOCK`` vertices and each task compares two blocks. Pairs whose
    exact distances to the same hub differ by more than the largest distance of a link are left out: the
    Jaccard distance is a metric, so they cannot be linked. Marks leave out pairs exactly, too.
    """
    sizes = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = rest.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    limit = 1 - percent / 100 + 1e-9

    def compare(table: pa.Table) -> pa.Table:
        frugal()
        one, two = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        frame = {c: table.column(c).to_numpy() for c in ("node", "component", "n", "shared", "block")}
        hub = table.column("hub").fill_null(-1).to_numpy()
        far = table.column("far").fill_null(9.0).to_numpy()
        x = np.frombuffer(b"".join(table.column("regs").to_pylist()), dtype=np.uint8).reshape(-1, REGISTERS)
        marks = [None if v is None else np.frombuffer(v, dtype=np.uint16) for v in table.column("marks").to_pylist()]
        known = np.array([m is not None for m in marks])
        lost = np.array([0 if m is None else k - len(m) for m, k in zip(marks, frame["n"])])
        member = np.zeros(1 << 16, dtype=bool)
        left = np.flatnonzero(frame["block"] == one)
        right = np.flatnonzero(frame["block"] == two)
        a, b = [], []
        for i in left:
            j = right[frame["component"][right] != frame["component"][i]]
            if one == two:
                j = j[frame["node"][j] < frame["node"][i]]
            m, most = frame["n"][j], np.minimum(frame["shared"][j], frame["shared"][i])
            j = j[(100 + percent) * most >= percent * (m + frame["n"][i])]
            j = j[~((hub[j] == hub[i]) & (hub[i] >= 0) & (np.abs(far[j] - far[i]) > limit))]
            if known[i] and len(j) and known[j].any():
                # equal shingles have equal marks, so common marks and what either lost to collisions bound the intersection
                member[marks[i]] = True
                some = j[known[j]]
                sizes = [len(marks[k]) for k in some]
                met = np.add.reduceat(member[np.concatenate([marks[k] for k in some])], np.cumsum([0, *sizes[:-1]]), dtype=np.int64)
                member[marks[i]] = False
                met += np.minimum(lost[some], lost[i])
                possible = (100 + percent) * met >= percent * (frame["n"][some] + frame["n"][i])
                j = np.concatenate([some[possible], j[~known[j]]])
            if not len(j):
                continue
            n, m = np.full(len(j), frame["n"][i]), frame["n"][j]
            est, used = estimate(np.broadcast_to(x[i], (len(j), REGISTERS)), x[j], n, m)
            j = j[plausible(est, used, n, m, percent)]
            a.append(np.maximum(frame["node"][i], frame["node"][j]))
            b.append(np.minimum(frame["node"][i], frame["node"][j]))
        whole = [np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (a, b)]
        return pa.table({"a": whole[0], "b": whole[1]})

    columns = ["key", "i", "j", "block", "node", "component", "n", "shared", "regs", "hub", "far", "marks"]
    return cells.select(*columns).groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")
