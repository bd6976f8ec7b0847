"""Batch hybrid retrieval: exact alias, contained alias, BM25 and cosine.

Queries travel as rows, so one job answers any number of them. Candidate
tables share the columns (query_id, chunk_id, method, value).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom.functions import text as tx
from loreloom.operators.index import FILTER_COLUMNS, KeywordIndex
from loreloom.operators.index import postings as index_postings
from loreloom.operators.scan import top_per
from loreloom.session import stage

# Ranking constants that define the scores.
BM25_K1 = 1.2
BM25_B = 0.75
BM25_MIN_IDF = 1e-6
LEXICAL_WEIGHT = 0.65
VECTOR_WEIGHT = 0.60
METHOD_BONUS = 0.05
MIN_SCORE = 0.12
MIN_SIMILARITY = 0.52
PER_ENTITY = 2
ALIAS_CAP = 100
MAX_TERMS = 8
METHODS = ("exact", "bm25", "vector")
# End of fixed values.


def candidate_limit(top_k: int) -> int:
    return max(top_k * 4, 12)


def prepare_queries(df: DataFrame) -> DataFrame:
    """Fill the optional filter columns, trim, and drop empty or out-of-scope text."""
    empty = F.array().cast("array<string>")
    defaults = {
        "entity_types": empty,
        "source_types": empty,
        "game_version": F.lit(None).cast("string"),
        "include_stale": F.lit(False),
    }
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    df = df.withColumn("query", tx.strip(F.col("query")))
    return df.where((F.col("query") != "") & ~tx.is_out_of_scope(F.col("query"))).select(
        "query_id", "query", *defaults
    )


def passes() -> Column:
    """Metadata filter of a query against a row that carries the filter columns."""
    any_type = F.size("entity_types") == 0
    any_source = F.size("source_types") == 0
    return (
        (F.col("f.include_stale") | ~F.col("c.stale"))
        & (any_type | F.array_contains("f.entity_types", F.col("c.entity_type")))
        & (F.col("f.game_version").isNull() | (F.col("f.game_version") == F.col("c.game_version")))
        & (any_source | F.array_contains("f.source_types", F.col("c.source_type")))
    )


def _unfiltered() -> Column:
    return (
        (F.size("f.entity_types") == 0)
        & (F.size("f.source_types") == 0)
        & F.col("f.game_version").isNull()
        & ~F.col("f.include_stale")
    )


def exact_candidates(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    keyed = queries.withColumn("key", tx.alias_key(F.col("query"))).where("key <> ''")
    return (
        keyed.alias("f")
        .join(aliases.alias("c"), (F.col("f.key") == F.col("c.normalized")) & passes())
        .select("f.query_id", "c.chunk_id", F.lit("exact").alias("method"), F.lit(1.0).alias("value"))
    )


def contained_candidates(
    queries: DataFrame, aliases: DataFrame, cap: int | None = ALIAS_CAP,
    generic: Sequence[str] = tx.GENERIC_ALIASES,
) -> DataFrame:
    """Aliases that occur inside the query. Call it with queries that had no exact hit.

    ``cap`` is the number of aliases per query that are considered, longest first; None considers all.
    """
    # The single-element generator keeps the normal form a step of its own; only its length goes on with the keys.
    keyed = queries.withColumn("whole", F.explode_outer(F.array(tx.alias_key(F.col("query"))))).where(
        (F.length("whole") >= 3) & ~F.col("whole").rlike("^[0-9]+$") & ~tx.is_exact_id(F.col("query"))
    )
    keyed = keyed.withColumn("whole", F.length("whole")).withColumn("key", F.explode_outer(tx.contained_keys(F.col("query"))))
    keyed = keyed.where(~F.col("key").rlike("^[0-9]"))  # no name begins with a digit
    names = aliases.where((F.length("normalized") >= 2) & ~F.col("normalized").rlike("^[0-9]"))
    found = (
        keyed.alias("f")
        .join(names.alias("c"), (F.col("f.key") == F.col("c.normalized")) & passes())
        .select("f.query_id", "c.chunk_id", "c.normalized", "f.whole")
    )
    size = F.length("normalized")
    order = [size.desc(), F.col("chunk_id"), F.col("normalized")]
    first = found if cap is None else top_per(found, ["query_id"], order, cap)
    quality = F.least(F.lit(0.99), F.lit(0.80) + F.lit(0.19) * size / F.col("whole"))
    return (
        first.where(~F.col("normalized").isin(list(generic)))
        .groupBy("query_id", "chunk_id")
        .agg(F.max(quality).alias("value"))
        .select("query_id", "chunk_id", F.lit("exact").alias("method"), "value")
    )


def phrase_counts(postings: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, chunk_id, dl, tf) for a table of distinct ``phrase`` values, from postings alone.

    The rarest term of a phrase gives the chunks and the places where the phrase may start; the other
    terms are looked up by (term, chunk) and a place counts when every term confirms it. A frequent
    term is therefore never a join key by itself unless the phrase has no other.
    """
    listed = F.filter(F.split(F.trim("phrase"), " +"), lambda w: w != "")
    words = phrases.select("phrase", listed.alias("words")).where(F.size("words") > 0)
    words = words.select("phrase", F.size("words").alias("size"), F.posexplode("words").alias("k", "term"))
    used = postings.join(words.select("term").distinct(), "term", "left_semi")
    known = words.join(used.groupBy("term").agg(F.count("*").alias("df")), "term")
    anchors = stage(
        known.groupBy("phrase", "size").agg(
            F.min(F.struct("df", "k", "term")).alias("a"), F.count("*").alias("present")
        ).where("present = size").select("phrase", "size", F.col("a.k").alias("anchor"), F.col("a.term").alias("term")),
        "phrase-anchors",
    )
    starts = F.transform("positions", lambda p: p - F.col("anchor"))
    found = anchors.join(used, "term").select("phrase", "size", "anchor", "chunk_id", "dl", starts.alias("starts"))
    found = stage(found, "phrase-starts")
    single = found.where("size = 1").select("phrase", "chunk_id", "dl", F.size("starts").cast("long").alias("tf"))
    others = found.where("size > 1").join(words.select("phrase", "k", "term"), "phrase").where("k <> anchor")
    confirmed = others.join(used.select("term", "chunk_id", "positions"), ["term", "chunk_id"]).select(
        "phrase", "size", "chunk_id", "dl",
        F.explode(F.array_intersect("starts", F.transform("positions", lambda p: p - F.col("k")))).alias("start"),
    )
    whole = confirmed.groupBy("phrase", "size", "chunk_id", "dl", "start").agg(F.count("*").alias("n")).where("n = size - 1")
    longer = whole.groupBy("phrase", "chunk_id", "dl").agg(F.count("*").alias("tf"))
    return single.unionByName(longer.select("phrase", "chunk_id", "dl", "tf"))


def bm25_scores(
    queries: DataFrame, fields: DataFrame, postings: DataFrame | None = None, max_terms: int | None = MAX_TERMS
) -> DataFrame:
    """(query_id, chunk_id, score) for every chunk that matches any query phrase.

    ``fields`` gives the number and mean length of the chunks. ``max_terms`` is the number of phrases a
    query may have, None for all of them.
    """
    if postings is None:
        postings = stage(index_postings(fields), "postings")
    terms = queries.select(
        "query_id", F.posexplode(tx.query_terms(F.col("query"), max_terms)).alias("term_no", "term")
    ).withColumn("phrase", tx.search_text(F.col("term"))).where("phrase <> ''")
    terms = stage(terms.select("query_id", "phrase"), "query-phrases")
    counts = stage(phrase_counts(postings, terms.select("phrase").distinct()), "phrase-counts")
    stats = fields.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    n, df = F.col("n"), F.col("df")
    idf = F.log((n - df + 0.5) / (df + 0.5))
    weights = (
        counts.groupBy("phrase")
        .agg(F.count("*").alias("df"))
        .withColumn("n", stats.select("n").scalar())
        .withColumn("avgdl", stats.select("avgdl").scalar())
        .select("phrase", "avgdl", F.when(idf > 0, idf).otherwise(F.lit(BM25_MIN_IDF)).alias("idf"))
    )
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl"))
    part = F.col("idf") * F.col("tf") * (BM25_K1 + 1.0) / (F.col("tf") + norm)
    weighted = counts.join(weights, "phrase").select("phrase", "chunk_id", part.alias("part"))
    return weighted.join(terms, "phrase").groupBy("query_id", "chunk_id").agg(
        F.round(F.sum("part"), 9).alias("score")
    )


def bm25_candidates(
    queries: DataFrame, fields: DataFrame, limit: int, postings: DataFrame | None = None, max_terms: int | None = MAX_TERMS
) -> DataFrame:
    """Best ``limit`` chunks per query as reciprocal ranks.

    A query without any filter also lets stale chunks take places here; they
    are removed later, when the hits are fused.
    """
    scores = bm25_scores(queries, fields, postings, max_terms)
    kept = (
        scores.join(queries, "query_id").alias("f")
        .join(fields.select("chunk_id", *FILTER_COLUMNS).alias("c"), "chunk_id")
        .where(_unfiltered() | passes())
        .select("query_id", "chunk_id", "score")
    )
    ranked = top_per(kept, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], limit)
    return ranked.select(
        "query_id", "chunk_id", F.lit("bm25").alias("method"), (1.0 / F.col("rank")).alias("value")
    )


def vector_candidates(
    queries: DataFrame, vectors: DataFrame, limit: int, shards: int | None = None, pack_rows: int = 1024
) -> DataFrame:
    """Exact cosine top ``limit`` per query, similarity clamped to [0, 1].

    Both sides are packed into rows of at most ``pack_rows`` vectors. Vector packs are dealt to ``shards``, query
    packs are sent to every shard, and a task scores one pair of packs at a time, so neither the driver nor a
    task holds more than two packs and its best rows. The best of each pair are merged per query.
    """
    shards = shards or int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = _packed(queries, "query_id", pack_rows).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    searched = _packed(vectors, "chunk_id", pack_rows).withColumn(
        "shard", F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int")
    )
    pairs = searched.select("shard", "chunk_id", F.col("matrix").alias("right")).join(
        asked.select("shard", "query_id", F.col("matrix").alias("left")), "shard"
    )
    query_type, chunk_type = (df.schema[c].dataType for df, c in ((queries, "query_id"), (vectors, "chunk_id")))
    schema = T.StructType([
        T.StructField("query_id", query_type), T.StructField("chunk_id", chunk_type), T.StructField("value", T.DoubleType()),
    ])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for names, right, ids, left in frame.itertuples(index=False):
                names, ids = np.asarray(names), np.asarray(ids)
                if not len(names) or not len(ids):
                    continue
                other = np.frombuffer(right).reshape(len(names), -1)
                similarity = np.round(other @ np.frombuffer(left).reshape(len(ids), -1).T, 9)
                if len(names) > limit:
                    floor = np.partition(similarity, len(names) - limit, axis=0)[len(names) - limit]
                else:
                    floor = np.full(len(ids), -np.inf)
                rows, columns = np.nonzero(similarity >= floor)
                found = pd.DataFrame({"query_id": ids[columns], "chunk_id": names[rows], "value": similarity[rows, columns]})
                found = found.sort_values(["value", "chunk_id"], ascending=[False, True]).groupby("query_id", sort=False).head(limit)
                yield found.assign(value=found["value"].clip(0.0, 1.0))

    scored = pairs.select("chunk_id", "right", "query_id", "left").mapInPandas(run, schema)
    return top_per(scored, ["query_id"], [F.col("value").desc(), F.col("chunk_id")], limit).select(
        "query_id", "chunk_id", F.lit("vector").alias("method"), "value"
    )


def _unit_rows(series: pd.Series) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in series])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1, norms)


def _packed(vectors: DataFrame, key: str, rows: int) -> DataFrame:
    """(key: array of ids, matrix: their unit vectors) in packs of at most ``rows``."""
    schema = T.StructType([T.StructField(key, T.ArrayType(vectors.schema[key].dataType)), T.StructField("matrix", T.BinaryType())])

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), rows):
                part = frame.iloc[start : start + rows]
                yield pd.DataFrame({key: [part[key].tolist()], "matrix": [_unit_rows(part["embedding"]).tobytes()]})

    return vectors.select(key, "embedding").mapInPandas(pack, schema)


def fuse(candidates: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """One scored row per (query, chunk): best value per method, bonus, floors."""
    grouped = candidates.groupBy("query_id", "chunk_id").agg(
        *[F.max(F.when(F.col("method") == m, F.col("value"))).alias(m) for m in METHODS]
    )
    zero = F.lit(0.0)
    base = F.greatest(
        F.coalesce("exact", zero),
        LEXICAL_WEIGHT * F.coalesce("bm25", zero),
        VECTOR_WEIGHT * F.coalesce("vector", zero),
    )
    methods = F.array_compact(F.array(*[F.when(F.col(m).isNotNull(), F.lit(m)) for m in METHODS]))
    many = F.size("methods") - 1
    score = F.when(many > 0, F.least(F.lit(1.0), F.col("base") + METHOD_BONUS * many)).otherwise(
        F.col("base")
    )
    only_weak_vector = (
        F.col("exact").isNull() & F.col("bm25").isNull() & (F.col("vector") < min_similarity)
    )
    return (
        grouped.withColumn("base", base)
        .withColumn("methods", methods)
        .withColumn("raw", score)
        .where(~only_weak_vector & (F.col("raw") >= MIN_SCORE))
        .withColumn("score", F.bround("raw", 6))
        .drop("base", "raw")
    )


def rank_order() -> list[Column]:
    return [F.col("score").desc(), F.col("entity_type"), F.col("entity_id"), F.col("chunk_id")]


def diversify(hits: DataFrame, top_k: int, per_entity: int = PER_ENTITY) -> DataFrame:
    """At most ``per_entity`` hits of one entity in rank order, then the first ``top_k``."""
    spread = top_per(hits, ["query_id", "entity_id"], rank_order(), per_entity, "entity_rank")
    return top_per(spread.drop("entity_rank"), ["query_id"], rank_order(), top_k)


def hybrid_search(
    queries: DataFrame,
    index: KeywordIndex,
    top_k: int = 5,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    min_similarity: float = MIN_SIMILARITY,
    prefilter: bool = False,
    alias_cap: int | None = ALIAS_CAP,
    max_terms: int | None = MAX_TERMS,
    candidates_per_method: int | None = None,
) -> DataFrame:
    """Ranked, diversified hits. Queries without a row in the result have no answer.

    An exact hit skips the other methods, and so does an explicit id. Vector
    candidates are filtered after their top list is cut; ``prefilter`` restricts
    the vectors to non-stale chunks first. The queries and their alias hits are
    written once and read by every branch.
    """
    asked = stage(prepare_queries(queries), "asked")
    limit = candidates_per_method or candidate_limit(top_k)
    exact = stage(exact_candidates(asked, index.aliases), "exact-hits")
    no_exact = asked.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    contained = stage(contained_candidates(no_exact, index.aliases, alias_cap), "contained-hits")
    open_ = no_exact.join(contained.select("query_id").distinct(), "query_id", "left_anti").where(
        ~tx.is_exact_id(F.col("query"))
    )
    open_ = stage(open_, "open-queries")
    candidates = exact.unionByName(contained).unionByName(
        bm25_candidates(open_, index.fields, limit, index.postings, max_terms)
    )
    if vectors is not None and query_vectors is not None:
        searched = vectors
        if prefilter:
            live = index.chunks.where(~F.col("stale")).select("chunk_id")
            searched = vectors.join(live, "chunk_id", "left_semi")
        asked_vectors = query_vectors.join(open_.select("query_id"), "query_id", "left_semi")
        candidates = candidates.unionByName(vector_candidates(asked_vectors, searched, limit))
    payload = index.chunks.select("chunk_id", *FILTER_COLUMNS, *_payload(index.chunks))
    fused = (
        fuse(_allowed(candidates, asked, payload), min_similarity)
        .join(payload, "chunk_id")
    )
    return diversify(fused, top_k)


def _payload(chunks: DataFrame) -> list[str]:
    wanted = ("document_id", "name_zh", "name_en", "title", "text", "source", "content_version")
    return [c for c in wanted if c in chunks.columns]


def _allowed(candidates: DataFrame, asked: DataFrame, payload: DataFrame) -> DataFrame:
    """Candidates whose chunk exists and passes the query's filters."""
    return (
        candidates.join(asked.drop("query"), "query_id").alias("f")
        .join(payload.select("chunk_id", *FILTER_COLUMNS).alias("c"), "chunk_id")
        .where(passes())
        .select("query_id", "chunk_id", "method", "value")
    )


def answer_flags(queries: DataFrame, hits: DataFrame, vectors_available: bool) -> DataFrame:
    """Per query: whether it has no answer, and whether the search was degraded and why."""
    found = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    out = tx.is_out_of_scope(tx.strip(F.col("query")))
    empty = tx.strip(F.col("query")) == ""
    reason = F.when(empty, "empty query").when(out, "out of scope")
    if not vectors_available:
        reason = F.coalesce(reason, F.lit("no vectors, keyword search only"))
    return queries.join(found, "query_id", "left").select(
        "query_id",
        (F.coalesce("n", F.lit(0)) == 0).alias("no_answer"),
        F.lit(not vectors_available).alias("degraded"),
        reason.alias("reason"),
    )


def describe_entities(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """First non-stale chunk (by id) of each (entity_type, entity_id)."""
    keys = ["entity_type", "entity_id"]
    names = [c for c in ("name_zh", "name_en", "title", "text") if c in chunks.columns]
    first = chunks.where(~F.col("stale")).groupBy(*keys).agg(
        F.min(F.struct("chunk_id", *names)).alias("first")
    )
    return entities.join(first, keys, "left").select(entities["*"], "first.*")
