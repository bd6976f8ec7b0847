"""Toxic passages by maximum-scoring segment search over token log-odds.

* Weights: for every feature of a word (the word and its character 5-grams, with word marks) the labelled training
  documents that hold it are counted by class, and the log-odds ratio with a Dirichlet prior proportional to the
  overall counts gives a weight and its standard error. Features are hashed to ``BUCKETS`` buckets, which bounds
  what reaches the driver and the tasks. A word takes its most significant feature if that is at least ``Z`` standard
  errors above ``LEAST``, twice the odds (with enough rows even a slight imbalance of ordinary words is significant),
  divided by how often the text has said it; every other word costs a constant, so an ordinary text drifts down.
* Search: one linear scan finds all maximal scoring segments (disjoint, none extendable).
* Calibration: under the drift of ordinary text the score of a best segment follows an extreme-value law with parameters
  lambda (solving ``E[exp(lambda * s)] = 1`` for the word scores of training documents that are not toxic) and K. A
  segment's evidence is ``lambda * score - ln(K * words)``; evidence above zero makes a passage significant.
* Score: the summed evidence of a document's significant passages through a logistic curve with two parameters, fitted
  on at most ``fit_rows`` training documents, those with the smallest hashes. Everything else uses all rows.

A null or empty text has no words and evidence zero. Without training rows no word has a weight and every score is 0.
Rows that repeat an id are scored each for themselves; a null id is never a training row. Labels with a null class are ignored;
an id labelled with both classes counts as a training row of each. Texts are read whole, at any length; documents with the same
evidence have the same score; columns other than the named ones are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm import bloom_dedup
from loreloom.llm.memory import frugal, trim
from loreloom.llm.tables import stage
from loreloom.llm.words import in_bounds, rows

BUCKETS = 1 << 20
Z = 4.0
#: Cost of a word without a significant feature.
DRIFT = 0.5
#: Log-odds ratio that a scoring word exceeds significantly.
LEAST = math.log(2)
#: Largest score of one word, so that no single word decides by itself.
TOP = 6.0
PRIOR = 50.0
#: Bytes of text whose new words are looked up together, about.
SCORED_BYTES = 2 << 20
WORD = re.compile(r"[^\W_]+")


def bucket_of(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature.encode()) % BUCKETS


def features(words: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``words``, bucket) of every feature: the words themselves, then their 5-grams.

    Each different gram is hashed once; ``known`` remembers the buckets of at most 150,000 and those of one call.
    """
    if len(known) > 150_000:
        known.clear()
    marked = pa.array([f"^{word}$" for word in words], pa.string())
    sizes = pc.utf8_length(marked).to_numpy()
    places, grams, at = [np.arange(len(words))], [], np.arange(len(words))
    for start in range(int(sizes.max(initial=0)) - 4):
        at = at[sizes[at] >= start + 5]
        places.append(at)
        grams.append(pc.utf8_slice_codeunits(marked.take(pa.array(at)), start, start + 5))
    coded = pa.chunked_array(grams, pa.string()).combine_chunks().dictionary_encode()
    different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    known.update((gram, bucket_of(gram)) for gram in set(different).difference(known))
    whole = np.fromiter(map(bucket_of, marked.to_numpy(zero_copy_only=False)), dtype=np.int64, count=len(words))
    of_grams = np.fromiter(map(known.__getitem__, different), dtype=np.int64, count=len(different))
    return np.concatenate(places), np.concatenate([whole, of_grams[coded.indices.to_numpy()]])


class Buckets(dict):
    """The buckets of a word's features, for many words at once; emptied when more than ``limit`` words are known."""

    limit = 75_000

    def __init__(self) -> None:
        super().__init__()
        self.grams: dict[str, int] = {}

    def learn(self, texts: list[list[str]]) -> None:
        """From now on, until the next call at least, every word of the texts is known."""
        if len(self) > self.limit:
            self.clear()
        new = list(set().union(*texts).difference(self))
        place, bucket = features(new, self.grams)
        by_word = bucket[np.argsort(place)].tolist()
        ends = np.cumsum(np.bincount(place, minlength=len(new))).tolist()
        self.update((word, by_word[start:end]) for word, start, end in zip(new, [0, *ends], ends))


def words_of(text: bytes | None) -> list[str]:
    return WORD.findall((text or b"").decode().lower())


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to (bucket, toxic documents, other documents), summed over the task."""
    frugal()
    known = Buckets()
    totals = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch, texts in rows(in_bounds(batches, limit=SCORED_BYTES)):
        said = [list(set(words_of(text))) for text in texts]
        known.learn(said)
        for label, words in zip(batch.column(0).to_pylist(), said):
            hit = set().union(*map(known.__getitem__, words))
            if hit:
                totals[1 if label else 0, np.fromiter(hit, dtype=np.int64)] += 1
    used = np.flatnonzero(totals.any(axis=0))
    for start in range(0, len(used), 65536):
        own = used[start : start + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(totals[1, own]), pa.array(totals[0, own])], names=["bucket", "bad", "good"])


def log_odds(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> np.ndarray:
    """Word scores per bucket: the log-odds ratio less one standard error where it is significant, else zero."""
    share = (bad + good) / max(n_bad + n_good, 1)
    prior = PRIOR * share
    x, y = bad + prior, good + prior
    ratio = np.log((x + 0.01) / (n_bad + PRIOR - x + 0.01)) - np.log((y + 0.01) / (n_good + PRIOR - y + 0.01))
    error = np.sqrt(1 / (x + 0.01) + 1 / (y + 0.01))
    return np.where(ratio - LEAST >= Z * error, np.clip(ratio - error, 0, TOP), 0).astype(np.float32)


def maximal_segments(at: list[int], gain: list[float], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments, as (score, first word, word after), in one pass over the scoring words.

    ``at`` are the positions of words with a gain; each other word costs ``drift``. A candidate keeps the running sum
    before (l) and after (r) it; a new one is appended, or merged leftwards while an earlier candidate has a smaller l
    and a smaller r.
    """
    open_: list[list] = []
    total, position = 0.0, 0
    for i, g in zip(at, gain):
        total -= drift * (i - position)
        new = [total, total + g, i, i + 1]
        total += g
        position = i + 1
        while open_:
            j = len(open_) - 1
            while j >= 0 and open_[j][0] >= new[0]:
                j = open_[j][4]
            if j < 0 or open_[j][1] >= new[1]:
                new.append(j)
                break
            new = [open_[j][0], new[1], open_[j][2], new[3]]
            del open_[j:]
        else:
            new.append(-1)
        open_.append(new)
    return [(r - left, first, end) for left, r, first, end, _ in open_]


class Scorer:
    """The scoring words among those met so far, which are forgotten together when they are more than ``limit``."""

    def __init__(self, weights: np.ndarray, limit: int = 200_000) -> None:
        self.weights, self.limit = weights, limit
        self.met: set[str] = set()
        self.score: dict[str, float] = {}
        self.grams: dict[str, int] = {}

    def learn(self, texts: list[list[str]]) -> dict[str, float]:
        """The scores of all scoring words of the texts, and of some others."""
        if len(self.met) > self.limit:
            self.met.clear()
            self.score.clear()
        new = list(set().union(*texts).difference(self.met))
        self.met.update(new)
        place, bucket = features(new, self.grams)
        weight = self.weights[bucket]
        for at in np.flatnonzero(weight > 0).tolist():  # none is below zero, and few are above
            word = new[place[at]]
            self.score[word] = max(self.score.get(word, 0.0), float(weight[at]))
        return self.score


_SCORERS: dict[str, Scorer] = {}


class Model:
    """Weights and calibration; its size is fixed by ``BUCKETS``."""

    def __init__(self, weights: np.ndarray, lam: float = 1.0, k: float = 1.0, slope: float = 0.0, shift: float = 0.0) -> None:
        self.weights, self.lam, self.k, self.slope, self.shift = weights, lam, k, slope, shift
        self.trained = bool(weights.any())
        self.name = uuid.uuid4().hex

    def scorer(self) -> Scorer:
        """The word scores of this model, kept by the Python worker from task to task."""
        if self.name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[self.name] = Scorer(self.weights)
        return _SCORERS[self.name]

    def scoring_words(self, texts: list[list[str]]) -> list[tuple[list[int], list[float]]]:
        """Places and scores of each text's scoring words; all others score zero."""
        score = self.scorer().learn(texts)
        found = []
        for words in texts:  # most texts have none, and a look into the few scoring words is quick
            at = [] if score.keys().isdisjoint(words) else [i for i, word in enumerate(words) if word in score]
            found.append((at, [score[words[i]] for i in at]))
        return found

    def passages(self, text: bytes | None) -> tuple[int, list[tuple[float, float, int, int]]]:
        """Number of words, and (evidence, score, first word, word after) of every significant passage."""
        return len(words_of(text)), self.all_passages([text])[0]

    def all_passages(self, texts: list[bytes | None]) -> list[list[tuple[float, float, int, int]]]:
        """The significant passages of each text."""
        said = [words_of(text) for text in texts]
        return [self._significant(words, *x) for words, x in zip(said, self.scoring_words(said))] if self.trained else [[] for _ in said]

    def _significant(self, words: list[str], at: list[int], gain: list[float]) -> list[tuple[float, float, int, int]]:
        if not at:
            return []
        base = math.log(self.k * len(words))
        seen: dict[str, int] = {}
        gains = []
        for i, own in zip(at, gain):  # the n-th time a text says the same word counts an n-th
            seen[words[i]] = seen.get(words[i], 0) + 1
            gains.append(own / seen[words[i]])
        found = maximal_segments(at, gains, DRIFT)
        return [(self.lam * s - base, s, a, b) for s, a, b in found if self.lam * s > base]

    def probability(self, evidence: float) -> float:
        if not self.trained:
            return 0.0
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * math.log1p(evidence) + self.shift))))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, held: int) -> DataFrame:
    """(id, label, text) of the labelled documents outside the held-out fifth, written once.

    A Bloom filter of the labelled ids, of bounded size, keeps the other texts out of the join's shuffle.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label is not null").distinct()
    own, _ = stage(own.where(F.crc32(F.col("id").cast("string").cast("binary")) % held != 0), "labels")
    bits = bloom_dedup.filter_bits(own.count())
    bitmaps, _ = stage(bloom_dedup.member_filter(own.select(F.xxhash64("id").alias("digest")), bits), "label-filter")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col).alias("digest"))
    met = bloom_dedup.maybe_repeated(texts, bitmaps, bits).where("maybe").select("id", "text")
    train, _ = stage(own.join(met, "id").select("id", "label", "text"), "training")
    return train


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    held: int = 5, fit_rows: int = 20_000,
) -> Model:
    """Counts, lambda and K over all training documents; only the logistic curve uses a sample of ``fit_rows``."""
    train = training_rows(docs, labels, id_col, text_col, label_col, held)
    sizes = {r["label"]: r["n"] for r in train.groupBy(F.col("label").cast("boolean").cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    by_task = train.select("label", "text").mapInArrow(counted, "bucket long, bad long, good long")
    total = by_task.groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    table = total.toArrow()  # at most BUCKETS rows
    bad, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    where = table.column("bucket").to_numpy()
    bad[where], good[where] = table.column("bad").to_numpy(), table.column("good").to_numpy()
    model = Model(log_odds(bad, good, n_bad, n_good))
    if not model.trained:
        return model
    # the last hash of the sample first, from hashes alone; then the texts up to it
    hashed = train.select("label", "text", F.xxhash64("id").alias("h"))
    last = hashed.select("h").orderBy("h").limit(fit_rows).agg(F.max("h")).first()[0]
    sample, _ = stage(hashed.where(F.col("h") <= F.lit(last)).drop("h").repartition(64), "calibration")
    share = _background(train, model)
    model.lam, model.k = _extreme_value(share)
    drawn = score(sample.select(F.col("label").alias("doc_id"), "text"), model).select("doc_id", "evidence").toArrow()
    x = np.log1p(drawn.column("evidence").to_numpy())
    y = (drawn.column("doc_id").to_numpy() != 0).astype(float)
    model.slope, model.shift = _logistic(x, y)
    return model


def _background(train: DataFrame, model: Model) -> np.ndarray:
    """Histogram, in steps of 0.1, of word scores in training documents that are not toxic; the first cell counts the others."""
    steps = int(TOP * 10) + 1
    shared = train.sparkSession.sparkContext.broadcast(model)

    def count(batches):
        total = np.zeros(steps, dtype=np.int64)
        for _, texts in rows(in_bounds(batches, limit=SCORED_BYTES)):
            said = [words_of(text) for text in texts]
            for words, (_, gain) in zip(said, shared.value.scoring_words(said)):
                step = np.ceil(np.array(gain, dtype=np.float32) * 10).astype(np.int64)
                total += np.bincount(step, minlength=steps)[:steps]
                total[0] += len(words) - len(gain)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(steps)), pa.array(total)], names=["step", "n"])

    found = train.select("label", "text").where("label = 0").mapInArrow(count, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    out = np.zeros(steps)
    out[found.column("step").to_numpy()] = found.column("n").to_numpy()
    return out


def _extreme_value(histogram: np.ndarray) -> tuple[float, float]:
    """lambda with E[exp(lambda * s)] = 1, and K from the rate at which scoring words start a segment."""
    gains = np.arange(len(histogram)) / 10
    scores = np.where(gains > 0, gains, -DRIFT)
    p = histogram + np.where(gains == TOP, 1.0, 0.0)  # one unseen word, so that lambda is finite
    p = p / p.sum()
    if (p * scores).sum() >= 0:
        return 0.05, 1.0
    low, high = 1e-6, 1.0
    while (p * np.exp(high * scores)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if (p * np.exp(middle * scores)).sum() < 1 else (low, middle)
    return low, float(max(p[1:].sum(), 1e-9))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Two-parameter logistic regression by Newton steps with a slight ridge."""
    if not len(x) or y.min() == y.max():
        return 0.0, (-60.0 if not len(y) or y[0] == 0 else 60.0)
    design = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -60, 60)))
        gradient = design.T @ (y - p) - 1e-2 * w
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score, evidence, n_passages, and passages as (first word, word after, evidence)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for batch, texts in rows(in_bounds(batches, limit=SCORED_BYTES)):
            value, evidence, number, spans = [], [], [], []
            for found in shared.value.all_passages(texts):
                total = math.fsum(f[0] for f in found)
                evidence.append(total)
                value.append(shared.value.probability(total))
                number.append(len(found))
                spans.append([{"first": a, "end": b, "evidence": e} for e, _, a, b in found])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(value, pa.float64()), pa.array(evidence, pa.float64()), pa.array(number, pa.int64()), pa.array(spans, kind)],
                names=[id_col, "score", "evidence", "n_passages", "passages"],
            )

    source = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(
        scored, f"`{id_col}` long, score double, evidence double, n_passages long, passages array<struct<first:long,end:long,evidence:double>>"
    )


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` scored below ``at``, all columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for batch, texts in rows(in_bounds(batches, place, SCORED_BYTES), place):
            clean = [shared.value.probability(math.fsum(f[0] for f in found)) < at for found in shared.value.all_passages(texts)]
            yield batch.filter(pa.array(clean))
        trim()

    return docs.mapInArrow(kept, docs.schema)
