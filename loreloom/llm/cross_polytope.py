"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

A table's hash rotates a vector by three rounds of random signs and a fast Hadamard transform, and takes the nearest signed axis; a
key joins one or more such hashes. Every vector goes to one bucket per table. A query visits, per table, its own bucket and those of
the next nearest axes; the candidates met there are ranked by their inner product with the query in double precision.

Largest inner product is what counts, also for vectors of different norms: such vectors get one more coordinate that brings all to
the largest norm, and a query gets zero there, so that nearness in angle is the order of inner products.

* **Fit.** Hashes per key, probes and number of tables come from the data by one rule at every size: for ``SAMPLE`` queries the true
  neighbours are found in a scan of all vectors, and of all settings by which at least ``recall`` of them would be met, the one with
  the least cost (rows moved and products taken, estimated from ``SAMPLE_ROWS`` vectors) is used. Nothing else is sampled: every vector is
  in every table.
* **Hot groups.** Equal vectors are one class with one row in the tables, and only its smallest ids can be results. A bucket larger
  than ``BLOCK`` rows is cut into blocks, and so are its queries; each pair of blocks is one group, so no task holds a bucket.
* **Rerank.** Blocks return the best of each query by exact scores; their union, without repeats, is cut again.
* A query that meets fewer rows than it should return is compared with all vectors, in blocks.

Vectors that are null, empty, zero or hold a null or non-finite component take no part, and neither do rows with a null id or vectors
whose length is not the most frequent one (the smallest of several). Equal scores stand in the order of ids. A repeated row
counts once; an id with several vectors asks with each of them and is never its own neighbour. Columns other than the named ones are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loreloom.llm.tables import stage

#: Queries whose true neighbours the settings are fitted on, and vectors that stand for the sizes of buckets.
SAMPLE, SAMPLE_ROWS = 200, 2000
#: Vectors, and queries, of a bucket in one group.
BLOCK = 4096
#: Queries whose products with a block are held at once.
CHUNK = 256
#: Settings that are compared.
HASHES, PROBES, TABLES = (1, 2), (1, 2, 4, 8, 16), 40
#: Cost of a row moved through the shuffle, in multiplications.
MOVE = 2000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform along the first axis, whose length is a power of two."""
    size, n = x.shape
    h = 1
    while h < size:
        pairs = x.reshape(size // (2 * h), 2, h, n)
        x = np.stack((pairs[:, 0] + pairs[:, 1], pairs[:, 0] - pairs[:, 1]), axis=1).reshape(size, n)
        h *= 2
    return x


def padded(vectors: np.ndarray) -> np.ndarray:
    """Vectors as columns, filled up to a power of two."""
    size = 1 << max(vectors.shape[1] - 1, 1).bit_length()
    out = np.zeros((size, len(vectors)), dtype=np.float32)
    out[: vectors.shape[1]] = vectors.T
    return out


def rotated(columns: np.ndarray, table: int, hash_: int, seed: int) -> np.ndarray:
    """Pseudo-rotation number (table, hash_) of the columns."""
    rng = np.random.default_rng([seed, table, hash_])
    for _ in range(3):
        signs = rng.integers(0, 2, len(columns)).astype(np.float32) * 2 - 1
        columns = hadamard(columns * signs[:, None]) / np.float32(np.sqrt(len(columns)))
    return columns


def nearest_axes(y: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``many`` nearest signed axes of each column, nearest first, and how far their coordinates fall short of the largest."""
    size = np.abs(y)
    many = min(many, len(y))
    top = np.argsort(-size, axis=0, kind="stable")[:many] if many > 1 else np.argmax(size, axis=0)[None]
    value = np.take_along_axis(size, top, axis=0)
    code = 2 * top + (np.take_along_axis(y, top, axis=0) < 0)
    return code.astype(np.int64), value[:1] - value


@dataclass(frozen=True)
class Setting:
    """Hashes per key, buckets visited per table, and number of tables."""

    hashes: int
    probes: int
    tables: int
    seed: int = 1

    def keys(self, vectors: np.ndarray, table: int, probes: int) -> np.ndarray:
        """Bucket keys (probe, vector) of a table, the vector's own bucket first."""
        columns = padded(vectors)
        radix, n = 2 * len(columns), len(vectors)
        keys, loss = np.zeros((1, n), dtype=np.int64), np.zeros((1, n), dtype=np.float32)
        for h in range(self.hashes):
            code, short = nearest_axes(rotated(columns, table, h, self.seed), probes)
            keys = (keys[:, None] * radix + code[None]).reshape(-1, n)
            loss = (loss[:, None] + short[None] ** 2).reshape(-1, n)
            if len(keys) > probes:
                best = np.argsort(loss, axis=0, kind="stable")[:probes]
                keys, loss = np.take_along_axis(keys, best, axis=0), np.take_along_axis(loss, best, axis=0)
        return keys + (np.int64(table) << 48)


def _floats(raw: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), dtype="<f8").reshape(-1, dim)


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, digest, norm, raw) of the vectors that take part, raw as little-endian doubles, and their length."""
    value = F.col(vector_col).cast("array<double>")
    source = vectors.select(F.col(id_col).cast("long").alias("id"), value.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0))
    lengths = source.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = lengths["dim"] if lengths else 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim) + 0.0
            good = np.isfinite(flat).all(axis=1) & flat.any(axis=1)
            raws = [row.tobytes() for row in np.ascontiguousarray(flat[good], dtype="<f8")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).filter(pa.array(good)), pa.array([xxhash.xxh3_128_digest(r) for r in raws], pa.binary()),
                    pa.array(norms(flat[good])), pa.array(raws, pa.binary()),
                ],
                names=["id", "digest", "norm", "raw"],
            )

    return source.where(F.size("v") == dim).mapInArrow(pack, "id long, digest binary, norm double, raw binary"), dim


def norms(v: np.ndarray) -> np.ndarray:
    """Euclidean norms, also of very large and very small components."""
    most = np.abs(v).max(axis=1, initial=0.0)
    return most * np.sqrt(((v / np.maximum(most, 5e-324)[:, None]) ** 2).sum(axis=1))


def scaled(v: np.ndarray, top: float, even: bool, query: bool) -> np.ndarray:
    """What is hashed: the vectors at the largest norm, by one more coordinate if norms differ; a query has zero there."""
    norm = norms(v)[:, None]
    if even:
        return v / norm
    if query:
        return np.hstack([v / norm, np.zeros_like(norm)])
    return np.hstack([v / top, np.sqrt(np.maximum(1 - (norm / top) ** 2, 0))])


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest inner products of each query with the vectors: query ids, ids, scores. Equal scores: smaller ids."""
    out: list[tuple] = []
    for start in range(0, len(q), CHUNK):
        part = q[start : start + CHUNK]
        product = part @ v.T
        if len(v) > k:  # a little more than the best, as the order of summation differs
            slack = 1e-12 * np.sqrt((part * part).sum(axis=1) * (v * v).sum(axis=1).max())
            limit = np.partition(product, len(v) - k, axis=1)[:, len(v) - k]
            row, col = np.nonzero(product >= (limit - slack)[:, None])
        else:
            row, col = (a.ravel() for a in np.indices(product.shape))
        score = (part[row] * v[col]).sum(axis=1)  # in one order of summation, wherever the pair is met
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        out.append((q_ids[start : start + CHUNK][row[place < k]], ids[col[place < k]], score[place < k]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def true_neighbours(reps: DataFrame, sample: list, dim: int, k: int) -> DataFrame:
    """(q, id, score, raw): the ``k`` nearest of each sample query in a scan of all vectors; each task returns its best."""
    q_ids = np.array([r["id"] for r in sample], dtype=np.int64)
    q = np.frombuffer(b"".join(r["raw"] for r in sample), dtype="<f8").reshape(-1, dim)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), _floats(batch.column(1), dim)
            if held is not None:
                ids, v = np.concatenate([ids, held[0]]), np.concatenate([v, held[1]])
            found = best(q_ids, q, ids, v, k)
            used = np.isin(ids, found[1])
            held = (ids[used], v[used])
        if held is not None:
            found = best(q_ids, q, held[0], held[1], k)
            at = {i: n for n, i in enumerate(held[0].tolist())}
            raw = [held[1][at[i]].tobytes() for i in found[1].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[0]), pa.array(found[1]), pa.array(found[2]), pa.array(raw, pa.binary())], names=["q", "id", "score", "raw"]
            )

    found = reps.select("id", "raw").mapInArrow(scan, "q long, id long, score double, raw binary")
    return _top(found, k)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def fit(reps: DataFrame, queries: DataFrame, dim: int, k: int, recall: float, top: float, even: bool, seed: int) -> Setting:
    """The cheapest setting by which at least ``recall`` of the sample's true neighbours share a visited bucket with their query."""
    n, n_queries = reps.count(), queries.count()
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "raw").collect()
    near = true_neighbours(reps, sample, dim, k).select("q", "raw").collect()
    rows = reps.select("id", "raw").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLE_ROWS).collect()
    floats = lambda found: np.frombuffer(b"".join(r["raw"] for r in found), dtype="<f8").reshape(-1, dim)
    number = {r["id"]: i for i, r in enumerate(sample)}
    owner = np.array([number[r["q"]] for r in near])
    asked = scaled(floats(sample), top, even, True)
    # the order of inner products, for vectors as they lie in the tables
    there, others = scaled(floats(near), top, even, False), scaled(floats(rows), top, even, False)
    options = []
    for hashes in HASHES:
        own = Setting(hashes, PROBES[-1], TABLES, seed)
        drawn = [(own.keys(asked, t, PROBES[-1]), own.keys(there, t, 1)[0], own.keys(others, t, 1)[0]) for t in range(TABLES)]
        for probes in PROBES:
            met, visited = np.zeros(len(owner), dtype=bool), 0.0
            for tables, (probe, key, other) in enumerate(drawn, 1):
                met |= (probe[:probes, owner] == key[None]).any(axis=0)
                visited += _share(probe[:probes], other)
                if met.mean() >= recall:
                    break
            cost = tables * MOVE * (n + probes * n_queries) + visited * n * n_queries * dim
            options.append((max(0.0, recall - met.mean()), cost, Setting(hashes, probes, tables, seed)))
    return min(options, key=lambda o: o[:2])[2]


def _share(probe: np.ndarray, other: np.ndarray) -> float:
    """Mean share of the vectors in the buckets that a query visits."""
    keys, counts = np.unique(other, return_counts=True)
    at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
    return float(np.where(keys[at] == probe, counts[at], 0).sum(axis=0).mean() / len(other))


def hashed(rows: DataFrame, dim: int, setting: Setting, probes: int, top: float, even: bool) -> DataFrame:
    """(id, raw, keys): the buckets of each row in all tables; for queries, with the visited ones."""
    query = probes > 0

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 2048) for b in batches for i in range(0, b.num_rows, 2048)):
            v = scaled(_floats(batch.column(1), dim), top, even, query)
            keys = np.concatenate([setting.keys(v, t, max(probes, 1)) for t in range(setting.tables)])
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, len(keys), dtype=np.int32), pa.array(np.ascontiguousarray(keys.T).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["id", "raw", "keys"])

    return rows.select("id", "raw").mapInArrow(draw, "id long, raw binary, keys array<long>")


def searched(index: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """(q, id, score): the best of every query (key, id, raw) in the bucket of its key, block by block."""
    blocks = lambda rows, name: rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name)).where(F.col(name) > 1)
    one, two = blocks(index.select("key"), "vs"), blocks(queries.select("key"), "qs")
    # the few large buckets; their number is not bounded, so sizes decide how they are joined
    wide, _ = stage(one.join(two, "key", "full"), "large-buckets")

    def placed(rows: DataFrame, own: str, other: str, query: bool) -> DataFrame:
        part = lambda name: F.coalesce(F.col(name), F.lit(1))
        mine = F.pmod(F.xxhash64("id"), part(own)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), part(other) - 1))
        cut = rows.join(wide, "key", "left").select("key", mine.alias(own), copies.alias(other), "id", "raw")
        return cut.select("key", "vs", "qs", F.lit(query).alias("query"), "id", "raw")

    def search(table: pa.Table) -> pa.Table:
        ask = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
        ids, found = table.column("id").to_numpy(), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if ask.any() and not ask.all():
            v = _floats(table.column("raw").combine_chunks(), dim)
            found = best(ids[ask], v[ask], ids[~ask], v[~ask], k)
        return pa.table(dict(zip(("q", "id", "score"), found)))

    both = placed(index, "vs", "qs", False).unionByName(placed(queries, "qs", "vs", True))
    return both.groupBy("key", "vs", "qs").applyInArrow(search, "q long, id long, score double")


def neighbours(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
    recall: float = 0.95, setting: Setting | None = None, seed: int = 1,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``is_query`` (of column ``id``) holds, its ``k`` nearest others."""
    cleaned, dim = clean(vectors, id_col, vector_col)
    cleaned, _ = stage(cleaned, "vectors")
    classes = cleaned.groupBy("digest").agg(F.min("id").alias("rep"), F.first("raw").alias("raw"), F.first("norm").alias("norm"))
    classes, _ = stage(classes, "vector-classes")
    member, _ = stage(cleaned.select("id", "digest").join(classes.select("digest", "rep"), "digest").select("id", "rep").distinct(), "vector-members")
    norms = classes.agg(F.min("norm").alias("low"), F.max("norm").alias("high"), F.count(F.lit(1)).alias("n")).first()
    total = member.count()
    reps = classes.select(F.col("rep").alias("id"), "raw")
    asking = member.where(is_query)
    queries, _ = stage(reps.join(asking.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "query-vectors")
    top, even = norms["high"] or 1.0, not norms["n"] or norms["high"] - norms["low"] <= 1e-5 * norms["high"]
    if setting is None:
        setting = fit(reps, queries, dim, k, recall, top, even, seed) if not queries.isEmpty() else Setting(1, 1, 1, seed)

    flat = lambda rows: rows.select(F.explode("keys").alias("key"), "id", "raw")
    index, _ = stage(hashed(reps, dim, setting, 0, top, even), "hashed")
    probing, _ = stage(hashed(queries, dim, setting, setting.probes, top, even), "probing")
    near = _top(searched(flat(index), flat(probing), dim, k + 1).dropDuplicates(["q", "id"]), k + 1)
    lists, _ = stage(_members_of(near, member, k), "neighbour-lists")

    short = queries.join(lists.where(F.size("near") >= min(k + 1, total)).select(F.col("q").alias("id")), "id", "left_anti")
    short, _ = stage(short, "short-queries")
    if not short.isEmpty():  # met too few: compared with every vector, in blocks
        shards = -(-norms["n"] // BLOCK)
        every = reps.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("key"), "id", "raw")
        asked = short.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("key"), "id", "raw")
        exact = _members_of(_top(searched(every, asked, dim, k + 1), k + 1), member, k)
        lists = lists.join(exact.select("q"), "q", "left_anti").unionByName(exact)

    others = F.slice(F.filter("near", lambda s: s["id"] != F.col("own")), 1, k)
    answered = asking.select(F.col("id").alias("own"), F.col("rep").alias("q")).join(lists, "q").select("own", F.posexplode(others).alias("rank", "s"))
    return answered.select(
        F.col("own").alias("query_id"), (F.col("rank") + 1).cast("int").alias("rank"), F.col("s.id").alias("vec_id"), F.col("s.score").alias("score")
    )


def _members_of(near: DataFrame, member: DataFrame, k: int) -> DataFrame:
    """(q, near): nearest classes to the ids in them, the best ``k + 1`` of each query in order. A class's smallest ids are enough."""
    own = Window.partitionBy("rep").orderBy("id")
    smallest = member.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k + 1).select("rep", F.col("id").alias("vec"))
    rows = near.join(smallest, F.col("id") == F.col("rep")).select("q", F.col("vec").alias("id"), "score")
    one = F.struct((-F.col("score")).alias("down"), "id", "score")
    return _top(rows, k + 1).groupBy("q").agg(F.array_sort(F.collect_list(one)).alias("l")).select(
        "q", F.transform("l", lambda s: F.struct(s["id"].alias("id"), s["score"].alias("score"))).alias("near")
    )
