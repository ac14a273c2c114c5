"""Lexical, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom import config as C
from memloom.functions.extract import fact_of_chunk, turn_chunks
from memloom.functions.text import tokens
from memloom.functions.vector import dot


def lengths(docs: DataFrame) -> DataFrame:
    """(id, words): each text's tokens, once."""
    return docs.select("id", tokens(F.col("text")).alias("words"))


def _times(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def _term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(id, len, tf0, ...): a text's length and how often it has each term; a lambda names the tokens, so they are made once."""

    def counted(words: Column) -> Column:
        times = [_times(words, t).alias(f"tf{i}") for i, t in enumerate(terms)]
        return F.struct(F.size(words).alias("len"), *times)

    return docs.select("id", F.element_at(F.transform(F.array(tokens(F.col("text"))), counted), 1).alias("n")).select("id", "n.*")


def bm25_topk(docs: DataFrame, query: list[str], k: int = C.LEXICAL_TOP) -> DataFrame:
    """(id, score) of the best k. Nothing is shuffled but partial sums and each task's best k.

    Document frequencies are sums of conditional counts in one aggregate. Scores are made of the texts
    that contain a term as a string, a cheap test that leaves out nothing; the others aren't split again.
    """
    terms = sorted(set(query))
    all_, lower = _term_counts(docs, terms), F.lower("text")
    stats = all_.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    score, met = F.lit(0.0), F.lit(False)
    for i, t in enumerate(terms):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score = score + F.when(tf > 0, idf * tf * (C.BM25_K1 + 1) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * F.col("len") / F.col("avg_len")))).otherwise(0.0)
        met = met | lower.contains(t)
    # Scores are positive where a term occurs. They need the statistics, so this filter stays above the counts.
    found = _term_counts(docs.where(met), terms).crossJoin(F.broadcast(stats)).select("id", score.alias("score")).where("score > 0")  # stats is one row
    return found.orderBy(F.desc("score"), "id").limit(k)


def knn(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, score): exact inner product of ``embedding`` with one query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("id", dot(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def rrf(legs: list[DataFrame], k: int = C.RRF_K, top: int = C.FUSED_TOP) -> DataFrame:
    """Reciprocal rank fusion of bounded top-k legs ``id, score``, with ranks from 0."""
    ranked = [leg.select("id", (1 / (k + F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)).alias("part")) for leg in legs]
    both = ranked[0]
    for leg in ranked[1:]:
        both = both.unionByName(leg)
    return both.groupBy("id").agg(F.sum("part").alias("rrf")).orderBy(F.desc("rrf"), "id").limit(top)


def chunk_rows(docs: DataFrame, window: int, overlap: int) -> DataFrame:
    """(chunk, id, text) of ``id, text``: turn-aware chunks; of several, the k-th is named ``id#k``."""
    spans = docs.select("id", "text", turn_chunks(F.col("text"), window, overlap).alias("spans"))
    each = spans.select("id", "text", F.size("spans").alias("n"), F.posexplode("spans").alias("k", "span"))
    name = F.when(F.col("n") > 1, F.concat_ws("#", "id", "k")).otherwise(F.col("id").cast("string"))
    return each.select(name.alias("chunk"), "id", F.substring(F.col("text"), F.col("span.start") + 1, F.col("span.end") - F.col("span.start")).alias("text"))


def best_chunks(scored: DataFrame) -> DataFrame:
    """(fact, chunk, score) of ``chunk, score``: each fact by its best chunk, the lower name of equals; a null score is the worst."""
    best = F.min(F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("worst"), "chunk", "score")).alias("b")
    return scored.groupBy(fact_of_chunk(F.col("chunk")).alias("fact")).agg(best).select("fact", "b.chunk", "b.score")
