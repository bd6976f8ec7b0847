"""Collocations, the Merkle log and cross-polytope search against plain versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreloom.llm import collocations, cross_polytope, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank long, grp string, words string, n int, chunk string, id long"


def frame(spark, rows):
    """(doc_id, text, lang, source, n_chars) with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 3, "g", "w", 9, "c", 5) for r in rows], DOCS).repartition(4)


def plain_collocations(rows, least, contained=80):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            totals[lang or "und"] += len(w)
            for size in range(1, 5):
                counts[lang or "und"].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if a >= least}
        kept = []
        for p, a in found.items():
            if len(p) == 1:
                continue
            longer = max((b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))), default=0)
            if 100 * longer >= contained * a:
                continue
            cut = min((2000000 * a // (found[p[:k]] + found[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-cut[0], -a, " ".join(p).encode(), found[p[: cut[1]]], found[p[cut[1] :]]))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept), 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3))) for _ in range(60)] + ["en", "de", "fr", "und", "New", "YORK"]
    rows = []
    for i in range(240):
        words = [rng.choice(vocab) + rng.choice(["", "", "", ".", ",", "\t", "\n", ":", "\x1c"]) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            words[len(words) // 2 : len(words) // 2] = ["in", "New", "York", "city", rng.choice(vocab)]
        rows.append((i, " ".join(words), rng.choice(["en", "en", "de", None, "f\nr"]), "s", 1))
    rows += [(900, None, "en", "s", 1), (901, "", None, None, None), (902, "ha " * 6000, "en", "s", 1), (903, " \t.,\n", "xx", "s", 1)]
    return rows + rows[:40] + [rows[7]] * 60


@pytest.mark.parametrize("least", [5, 30])
def test_collocations(spark, prose, least):
    got = collocations.collocations(frame(spark, prose), least=least, top=None)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(prose, least)


def test_collocations_of_the_first_ranks(spark, prose):
    got = sorted(map(tuple, collocations.collocations(frame(spark, prose), least=5, top=7).collect()))
    assert got == [r for r in plain_collocations(prose, 5) if r[1] <= 7]


def test_collocations_with_a_full_filter(spark, prose, monkeypatch):
    """A filter that lets nearly everything through changes no count."""
    monkeypatch.setattr(collocations.Filter, "of", classmethod(lambda cls, keys: cls(np.full(1 << 15, 255, dtype=np.uint8))))
    got = collocations.collocations(frame(spark, prose), least=30, top=None)
    assert sorted(map(tuple, got.collect())) == plain_collocations(prose, 30)


def test_scores_are_exact(spark, monkeypatch):
    """Products beyond 64 bits: 2000000 * a with a of 10 ** 18."""
    rows = [("en", ["a"], 3 * 10**18), ("en", ["b"], 10**18 + 1), ("en", ["a", "b"], 10**18)]
    phrases = spark.createDataFrame(rows, "lang string, words array<string>, n long")
    totals = spark.createDataFrame([("en", 9 * 10**18)], "lang string, total long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *a: (phrases, totals))
    got = collocations.collocations(phrases).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", 10**18, 3 * 10**18, 10**18 + 1, 9 * 10**18, 2000000 * 10**18 // (4 * 10**18 + 1))]


def test_chunks_cover_every_run_once():
    rng = random.Random(5)
    for _ in range(60):
        h = np.array([0 if rng.random() < 0.05 else rng.choice([3, 7, 11, 13]) for _ in range(rng.randint(0, 200))] + [0], dtype=np.uint64)
        start, end, last = collocations.chunk_bounds(h)
        for size in range(1, 5):
            want = {i for i in range(len(h) - size + 1) if h[i : i + size].all()}
            got = [i for a, b, z in zip(start, end, last) for i in range(a, b - size + 1) if z or i < b - collocations.OVERLAP]
            assert sorted(got) == sorted(want)


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [digest(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, siblings' digest, folded root, verified), and each language's levels."""
    changed = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
    leaf = lambda r, n: digest(*map(field, (r[0], r[3], r[2], n, r[1])))
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, r[4] + 1) if changed(r) and r[4] is not None else leaf(r, r[4]), r[0]))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    tree = {x: levels([k[2] for k in sorted(by[x], key=lambda k: k[:3])]) for x in langs}
    top = levels([tree[x][-1][0] for x in langs])
    out = []
    for place, lang in enumerate(langs):
        for j, row in enumerate(sorted(by[lang], key=lambda k: k[:3])):
            node, siblings = row[3], []
            for nodes, i in ((tree[lang], j), (top, place)):
                for level in nodes[:-1]:
                    other = [x for k, x in enumerate(level[i // 2 * 2 : i // 2 * 2 + 2]) if k != i % 2]
                    node = digest(*other, node) if i % 2 else digest(node, *other)
                    siblings += other
                    i //= 2
            out.append((row[4], row[2], tree[lang][-1][0], top[-1][0], digest(*siblings), node, node == top[-1][0]))
    return sorted(out, key=repr), tree


def manifest_rows(n, seed):
    rng = random.Random(seed)
    langs = ["en"] * 6 + [None, "de", "fr", "é", "\U0001F600", ""]
    rows = [(i, rng.choice([None, "", "héé", f"text {i}"]), rng.choice(langs), rng.choice(["a", None]), rng.choice([None, 5, 70])) for i in range(n)]
    return rows + [(None, "x", "en", "a", 1), (None, "y", "en", "a", 1), (5, "q" * 300_000, "solo", None, None)] + rows[2:3] * 3


def checked(spark, rows, bits):
    docs = frame(spark, rows)
    fields = lambda n: [F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select(
        "doc_id", "lang", "words", merkle.leaf(*fields(F.col("n_chars"))).alias("leaf"), F.when(chosen, merkle.leaf(*fields(F.col("n_chars") + 1))).alias("t")
    )
    manifest = merkle.Manifest(leaves.withColumn("claimed", F.coalesce("t", "leaf")), "lang", "doc_id", bits)
    proven = manifest.proven().withColumn("folded_root", merkle.fold(F.col("claimed"), F.col("proof")))
    proven = proven.withColumn("proof_sha256", merkle.proof_digest(F.col("proof")))
    return manifest, proven.withColumn("verified", F.col("folded_root") == F.col("root"))


@pytest.mark.parametrize("n,bits", [(300, 2), (70, 1), (40, 10), (1, 3)])
def test_merkle_proofs_and_log(spark, n, bits):
    rows = manifest_rows(n, n)
    want, tree = plain_manifest(rows)
    manifest, out = checked(spark, rows, bits)
    got = [
        (r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out.collect()
    ]
    assert sorted(got, key=repr) == want
    log = defaultdict(dict)
    for e in manifest.log.entries().collect():
        assert e.position not in log[e.grp]
        log[e.grp][e.position] = e.node
    for lang, nodes in tree.items():
        own = log["-" if lang is None else "=" + lang]
        size = len(nodes[0])
        assert own == {merkle.position(level, i, size): h for level, row in enumerate(nodes) for i, h in enumerate(row)}
        assert sorted(own) == list(range(sum(map(len, nodes))))


def test_positions_are_the_order_of_completion():
    for size in range(1, 70):
        done, order = set(), []
        for j in range(size):
            order.append((0, j))
            level, i = 0, j
            while i & 1:
                level, i = level + 1, i >> 1
                order.append((level, i))
        done = set(order)
        for level in range(merkle.height(size) + 1):
            order += [(level, i) for i in range(-(-size >> level)) if (level, i) not in done]
        assert [merkle.position(level, i, size) for level, i in order] == list(range(len(order)))


def test_merkle_of_one_row_and_none(spark):
    rows = [(3, "only", "en", "s", 4)]
    _, out = checked(spark, rows, 10)
    assert [(r.leaf, r.root, r.folded_root, r.proof) for r in out.collect()] == [(plain_manifest(rows)[0][0][1],) * 3 + ([],)]
    assert checked(spark, [], 10)[1].count() == 0


def plain_neighbours(rows, k, every):
    rows = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    dims = Counter(len(v) for _, v in rows)
    dim = min(dims, key=lambda d: (-dims[d], d))
    rows = {(i, tuple(v.tolist())) for i, v in rows if len(v) == dim}
    out = {}
    for q, v in rows:
        if q % every == 0:
            found = sorted((-float((np.array(v) * np.array(w)).sum()), i) for i, w in rows if i != q)[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "r", 2, 5) for i, v in rows], "vec_id long, embedding array<float>, label int, raw string, key int, rep int").repartition(4)


def test_neighbours_are_found(spark):
    """Recall on clustered vectors of different norms, with many copies and odd rows; scores are exact."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    base = np.concatenate([c + rng.normal(size=(60, 24)) * 0.6 for c in centres]) * rng.uniform(0.5, 2, size=(720, 1))
    rows = [(i, base[i].astype(np.float32).tolist()) for i in range(720)]
    rows += [(1000 + i, rows[5][1]) for i in range(300)]  # copies
    odd = [(2000, None), (2020, []), (2040, [0.0] * 24), (2060, [float("nan")] + [1.0] * 23), (2080, [None] + [1.0] * 23), (2100, [1.0] * 7), (None, rows[0][1])]
    want = plain_neighbours(rows + odd, 20, 20)
    got = defaultdict(list)
    for r in cross_polytope.neighbours(vectors(spark, rows + odd + rows[:3]), F.col("id") % 20 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in {f[1] for f in found}
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert hit >= 0.9 * 20 * len(want)
    # a query among the copies meets them all; ties stand by id
    assert [i for _, i, _ in got[1000]] == [i for i, _ in want[1000]]


def test_blocks_and_short_buckets_give_exact_results(spark, monkeypatch):
    """Buckets cut into blocks, and queries that meet too few rows, lose nothing."""
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(150, 6)).astype(np.float32))]
    monkeypatch.setattr(cross_polytope, "BLOCK", 16)
    lonely = cross_polytope.Setting(2, 1, 1)  # hardly any two vectors share a bucket: nearly every query is compared with all
    got = defaultdict(list)
    for r in cross_polytope.neighbours(vectors(spark, rows), F.col("id") % 10 == 0, k=120, setting=lonely).orderBy("rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == plain_neighbours(rows, 120, 10)


@pytest.mark.parametrize("n", [0, 1, 2, 15])
def test_few_vectors(spark, n):
    rows = [(i, [1.0, float(i), -2.0]) for i in range(n)]
    got = defaultdict(list)
    for r in cross_polytope.neighbours(vectors(spark, rows), F.col("id") % 20 == 0).orderBy("rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == (plain_neighbours(rows, 20, 20) if n > 1 else {})


def test_rotations_keep_lengths():
    x = np.random.default_rng(1).normal(size=(5, 24)).astype(np.float32)
    y = cross_polytope.rotated(cross_polytope.padded(x), 3, 1, 9)
    assert np.allclose(np.linalg.norm(y, axis=0), np.linalg.norm(x, axis=1), rtol=1e-5)


def test_memory_of_the_last_task_is_given_back():
    """A worker's next task finds what the last one freed; until then glibc may keep it."""
    import subprocess
    import sys

    code = """
import ctypes, os
from loreloom.llm import memory
libc = ctypes.CDLL(None)
libc.malloc.restype, libc.malloc.argtypes, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p]
memory.frugal()
held = [libc.malloc(4000) for _ in range(30000)]
for at in held:
    ctypes.memset(at, 1, 4000)
pin = libc.malloc(4000)
for at in held:
    libc.free(at)
rss = lambda: int(open('/proc/self/statm').read().split()[1]) * os.sysconf('SC_PAGE_SIZE') >> 20
before = rss()
memory.frugal()
print(before - rss())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) > 80
