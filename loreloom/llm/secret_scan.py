"""Secrets in texts, with corpus-wide ownership of every candidate value.

Base kinds, leftmost and non-overlapping each: ``assign`` (a password-like name, ``:`` or ``=``, a value of 8 characters
or more), ``access`` (``AKIA`` and capitals or digits, 16 or more), ``hex`` (32 or more). The method looks at the values of
all candidates across the corpus, by hash: in how many repositories and by how many owners each occurs. A value of many
owners is a copied example; one of a single owner looks live. This adds two kinds of span, never inside a base one:

* ``known``: a bare value, of any characters a value can have, that is a base value elsewhere in the corpus;
* ``owned``: a bare mixed value (letters and digits, 20 characters or more, 3.5 bits a character or more) that
  occurs with one owner only.

A value is compared, and counted, without ``.``, ``=`` and ``-`` at its end, wherever it stands; base spans keep them. The base values
are collected first; a Bloom filter of them, of bounded size, keeps other bare runs from being emitted, and a join decides.

Spans count code points, end exclusive, of the whole text; a null text is empty. Rows are kept as they are: repeated
ids and null ids give a row each; a null owner or repository counts as one of its own.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm.spaced_seeds import seed_filter
from loreloom.llm.tables import stage
from loreloom.llm.words import in_bounds

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Bare values: maximal runs.
BARE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{8,}")
LETTER, DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "known", "owned")
#: Owners from which on a value is called a copied example.
EXAMPLE_OWNERS = 3


def canonical(value: str) -> str:
    """What a value is compared by: a sentence's end and padding are no part of it."""
    return value.rstrip(".=-") or value


def digest_of(value: str) -> bytes:
    return xxhash.xxh3_128_digest(canonical(value).encode())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base kinds, in order of start and kind."""
    out = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            out.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # a longer run is the same match with or without the length in the pattern: runs are maximal
    out += [(m.start(), 2, m.end(), m[0]) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def bits_per_character(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


class Known:
    """Whether a value may be a base value; remembers the answers for up to ``limit`` short values."""

    limit, longest = 300_000, 64

    def __init__(self, table: np.ndarray) -> None:
        self.bits, self.last, self.seen = memoryview(table), len(table) * 8 - 1, {}

    def __call__(self, value: str) -> bool:
        if (found := self.seen.get(value)) is None:
            h = int.from_bytes(digest_of(value)[:8], "big")
            found = all(self.bits[slot >> 3] >> (slot & 7) & 1 for slot in (h & self.last, (h >> 32) & self.last))
            if len(value) <= self.longest:
                if len(self.seen) >= self.limit:
                    self.seen.clear()
                self.seen[value] = found
        return found


def bare_spans(text: str, base: list[tuple[int, int, int, str]], known: Known) -> list[tuple[int, int, str, bool]]:
    """(start, end, value, strong) of bare values outside base spans that are strong or may be base values."""
    out = []
    for m in BARE.finditer(text):
        start, value = m.start(), m[0].rstrip(".=-")
        end = start + len(value)
        if len(value) < 8:
            continue
        strong = len(value) >= 20 and bool(DIGIT.search(value) and LETTER.search(value)) and bits_per_character(value) >= 3.5
        if (strong or known(value)) and not any(s < end and start < e for s, _, e, _ in base):
            out.append((start, end, value, strong))
    return out


def base_values(docs: DataFrame, text_col: str) -> DataFrame:
    """(hash): 64 bits of the hash of every base value, once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_bounds(batches, 0):
            found = {digest_of(v) for text in batch.column(0).to_pylist() for *_, v in base_spans(text or "")}
            yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(d[:8], "big", signed=True) for d in found], pa.int64())], names=["hash"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(scan, "hash long").distinct()


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """Per row: row, id, repo, owner and found: (start, end, kind or -1 for bare, strong, value hash)."""
    values, _ = stage(base_values(docs, text_col), "base-values")
    shared = docs.sparkSession.sparkContext.broadcast(seed_filter(values))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("strong", pa.bool_()), ("hash", pa.binary())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known = TaskContext.get().partitionId() << 40, Known(shared.value)
        for batch in in_bounds(batches):
            found, row = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                own = [(s, e, k, False, v) for s, k, e, v in base] + [(s, e, -1, strong, v) for s, e, v, strong in bare_spans(text, base, known)]
                found.append([
                    {"start": s, "end": e, "kind": k, "strong": strong, "hash": digest_of(v)} for s, e, k, strong, v in own
                ])
                row.append(number)
                number += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int64()), batch.column(0), batch.column(2), batch.column(3), pa.array(found, kind)],
                names=["row", "id", "repo", "owner", "found"],
            )

    source = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
        F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"),
    )
    return source.mapInArrow(
        scan, "row long, id long, repo string, owner string, found array<struct<start:long,end:long,kind:int,strong:boolean,hash:binary>>"
    )


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_rows, n_repos, n_owners, based): distinct counts over two narrow aggregations each; hot values are only counted."""
    per = found.groupBy("hash", "repo", "owner").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("kind") >= 0).alias("based"))
    repos = per.groupBy("hash", "repo").agg(F.sum("n").alias("n"), F.max("based").alias("based"))
    repos = repos.groupBy("hash").agg(F.count(F.lit(1)).alias("n_repos"), F.sum("n").alias("n_rows"), F.max("based").alias("based"))
    owners = per.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    return repos.join(owners, "hash")


def secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source"
) -> DataFrame:
    """Per row: id, found: array of (start, end, kind, n_repos, n_owners), in order of start and kind."""
    rows, _ = stage(candidates(docs, id_col, text_col, repo_col, owner_col), "candidates")
    flat = rows.where("size(found) > 0").select("row", "repo", "owner", F.explode("found").alias("f")).select("row", "repo", "owner", "f.*")
    owned, _ = stage(ownership(flat), "ownership")
    joined = flat.select("row", "start", "end", "kind", "strong", "hash").join(owned, "hash")
    kind = F.when(F.col("kind") >= 0, F.col("kind")).when(F.col("based"), 3).when(F.col("strong") & (F.col("n_owners") == 1), 4)
    spans = joined.withColumn("kind", kind).where("kind is not null")
    by_row = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "n_repos", "n_owners"))).alias("spans"))
    return rows.select("row", "id").join(by_row, "row", "left").select(F.col("id").alias(id_col), "spans")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts and span lists of ``secrets``' rows."""
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<start:long,kind:int,end:long,n_repos:long,n_owners:long>>)"))
    out = found.withColumn("spans", spans)
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] <= 2)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    live = F.size(F.filter("spans", lambda s: s["n_owners"] == 1)).cast("long")
    copied = F.size(F.filter("spans", lambda s: s["n_owners"] >= EXAMPLE_OWNERS)).cast("long")
    return out.select(
        id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"), live.alias("n_live"), copied.alias("n_example"),
    )


def sha256_of(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()
