"""An inverted index as tables: postings in folders by term bucket, and a row of statistics a batch.

``postings/bucket=b`` has (term, id, tf, len); ``batches`` has (batch, n, total_len). A search reads the buckets of its terms
and the statistics, never a text. New documents are appended as a batch: frequencies and lengths are counted
from what is stored, so scores are those of one index over all batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from memloom import config as C
from memloom.functions.text import tokens
from memloom.session import ship_package, written

POSTINGS = "term string, id long, tf int, len int, batch long, bucket int"
BATCHES = "batch long, n long, total_len long"


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, id, tf, len): a row for each distinct term of a text, counted inside the row by runs of its sorted tokens."""
    return _counted(docs.select("id", F.sort_array(tokens(F.coalesce("text", F.lit("")))).alias("words")))


def _counted(words: DataFrame) -> DataFrame:
    w = F.col("words")
    # The places where a term begins; the next such place tells how often it occurs.
    starts = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == 1) | (F.get(w, i - 1) != F.get(w, i - 2)))
    begun = words.where(F.size(w) > 0).select("id", "words", starts.alias("starts"))
    s = F.col("starts")
    runs = F.transform(s, lambda i, k: F.struct(F.get(w, i - 1).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(w) + 1) - i).alias("tf")))
    return begun.select("id", F.size(w).alias("len"), F.explode(runs).alias("run")).select("run.term", "id", "run.tf", "len")


def append(docs: DataFrame, path: str, batch: int, buckets: int = C.POSTING_BUCKETS) -> None:
    """Add ``id, text`` as one batch; a batch that is stored already is left as it is.

    The statistics are written last and readers take the batches that have them, so a run that broke off leaves nothing
    that counts, and running it again gives the batch once: each batch has folders of its own, which are written over.
    Texts are tokenised once; of the shuffle by bucket each term of a text is one row.
    """
    spark = docs.sparkSession
    if batch in {r["batch"] for r in _batches(spark, path).select("batch").collect()}:
        return
    rows = term_counts(docs).withColumn("bucket", bucket_of(F.col("term"), buckets))
    # Buckets are dealt with the id's hash beside them: a bucket with a very common term is written by several tasks.
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(C.POSTING_SPLITS))).sortWithinPartitions("bucket", "term", "id")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    written = spark.read.schema("term string, id long, tf int, len int, bucket int").parquet(f"{path}/postings/batch={batch}")
    # Each text's length stands in all its postings; those of texts without a term are nought.
    totals = written.agg(F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("total_len"))
    n = docs.select("id").count()
    totals.select(F.lit(batch).cast("long").alias("batch"), F.lit(n).cast("long").alias("n"), "total_len").write.mode("append").parquet(f"{path}/batches")


def _batches(spark: SparkSession, path: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batches")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], BATCHES)
    return spark.read.schema(BATCHES).parquet(f"{path}/batches")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All postings of the batches that are complete."""
    rows = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    return rows.where(F.col("batch").isin([r["batch"] for r in _batches(spark, path).select("batch").distinct().collect()]))


def statistics(spark: SparkSession, path: str) -> tuple[int, float]:
    """Documents, and their mean length; a row a batch is read."""
    n, total = _batches(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total_len"), F.lit(0))).first()
    return n, total / max(1, n)


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(term, tf, df) of every term: one partial aggregate, as a text has a term in one row."""
    return stored(spark, path).groupBy("term").agg(F.sum("tf").cast("long").alias("tf"), F.count("*").alias("df"))


def search(spark: SparkSession, path: str, query: list[str], k: int = C.LEXICAL_TOP, buckets: int = C.POSTING_BUCKETS) -> DataFrame:
    """(id, score): BM25 of the best k; an empty query finds nothing. Only the folders of the terms' buckets are read."""
    terms = sorted(set(query))
    if not terms:
        return spark.createDataFrame([], "id long, score double")
    of = {r["term"]: r["bucket"] for r in spark.createDataFrame([(t,) for t in terms], "term string").withColumn("bucket", bucket_of(F.col("term"), buckets)).collect()}
    hits = stored(spark, path).where(F.col("bucket").isin(sorted(set(of.values()))) & F.col("term").isin(terms))
    n, mean = statistics(spark, path)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    tf, share = F.col("tf"), F.col("len") / mean if mean else F.lit(0.0)
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * tf * (C.BM25_K1 + 1) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * share))
    scored = hits.join(F.broadcast(df), "term")  # a row a term of the query
    return scored.groupBy("id").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def search_many(spark: SparkSession, path: str, queries: DataFrame, k: int = C.LEXICAL_TOP, buckets: int = C.POSTING_BUCKETS) -> DataFrame:
    """(query, id, score): BM25 of the best k for each of ``query, terms``; a query without terms finds nothing.

    The postings of the asked terms are read once for all queries.
    """
    asked = _asked(queries)
    terms = _terms(asked).withColumn("bucket", bucket_of(F.col("term"), buckets))
    hits = written(stored(spark, path).join(terms, ["bucket", "term"]).select("number", "id", "tf", "len"), "hits")
    return _best(hits, asked, terms, *statistics(spark, path), k)


def search_texts(docs: DataFrame, queries: DataFrame, k: int = C.LEXICAL_TOP) -> DataFrame:
    """As :func:`search_many`, from the texts of ``id, text`` in one scan: for many questions at once no index has to be stored."""
    asked = _asked(queries)
    terms = _terms(asked)
    told = Observation()
    # A text's tokens are made once, for its terms and for the lengths of all texts.
    words = docs.select("id", F.sort_array(tokens(F.coalesce("text", F.lit("")))).alias("words"))
    words = words.observe(told, F.count("*").alias("n"), F.coalesce(F.sum(F.size("words").cast("long")), F.lit(0)).alias("total_len"))
    hits = written(_counted(words).join(terms, "term").select("number", "id", "tf", "len"), "hits")
    n, total = told.get["n"], told.get["total_len"]
    return _best(hits, asked, terms, n, total / max(1, n), k)


def _asked(queries: DataFrame) -> DataFrame:
    return written(queries.select("query", F.explode(F.array_distinct("terms")).alias("term")).where("term is not null"), "asked")


def _terms(asked: DataFrame) -> DataFrame:
    """(term, number) of the asked terms."""
    return written(asked.select("term").distinct().withColumn("number", F.monotonically_increasing_id()), "terms")


def _best(hits: DataFrame, asked: DataFrame, terms: DataFrame, n: int, mean: float, k: int) -> DataFrame:
    """(query, id, score): the best k texts of each query of ``query, term``, from the postings ``number, id, tf, len`` of all asked terms.

    Texts are dealt by id, so that a group has all postings of some texts, HITS_TASK in all, about, and scores them for
    its queries: only the best k of a query and group go on, never a row for each query and text that has one of its terms.
    """
    df = hits.groupBy("number").agg(F.count("*").alias("df"))
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighed = asked.join(terms.select("term", "number"), "term").join(df, "number").select("query", "number", idf.alias("idf"))
    blocks, parts = max(8, -(-hits.count() // C.HITS_TASK)), max(1, -(-asked.count() // C.ASKED_TASK))
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    place = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    left = hits.where("id is not null").select(place("id", blocks).alias("block"), every(parts).alias("part"), "number", "id", "tf", "len")
    right = weighed.select(place("query", parts).alias("part"), every(blocks).alias("block"), "query", "number", "idf")
    ship_package(hits.sparkSession)
    by = ["block", "part"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_scored(mean, k), "query long, id long, score double")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).drop("rank")


def _scored(mean: float, k: int):
    def run(hits, asked):
        """The best k of the group's texts for each of its queries, the lower id of equals."""
        import pyarrow as pa

        out: list[tuple] = []
        if hits.num_rows and asked.num_rows:
            number = hits["number"].to_numpy()
            order = np.argsort(number, kind="stable")
            number, ids = number[order], hits["id"].to_numpy()[order]
            tf, length = (hits[c].to_numpy()[order].astype(float) for c in ("tf", "len"))
            lower = tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * (length / mean if mean else 0.0))
            known, text = np.unique(ids, return_inverse=True)
            query, wanted, idf = (asked[c].to_numpy() for c in ("query", "number", "idf"))
            order = np.lexsort((wanted, query))
            query, wanted, idf = query[order], wanted[order], idf[order]
            begin, end = np.searchsorted(number, wanted), np.searchsorted(number, wanted, side="right")
            first = np.flatnonzero(np.diff(query, prepend=query[0] - 1))
            for a, b in zip(first, [*first[1:], len(query)], strict=True):
                at = [slice(begin[i], end[i]) for i in range(a, b)]
                part = np.concatenate([idf[a + i] * tf[x] * (C.BM25_K1 + 1) / lower[x] for i, x in enumerate(at)])
                score = np.bincount(np.concatenate([text[x] for x in at]), part, len(known))
                some = np.flatnonzero(score)
                rank = -np.round(score[some], 12)
                if len(some) > k:
                    near = rank <= np.partition(rank, k - 1)[k - 1]
                    some, rank = some[near], rank[near]
                # Ids ascend, so a stable sort puts the lower of equals first.
                some = some[np.argsort(rank, kind="stable")[:k]]
                out.append((np.full(len(some), query[a]), known[some], score[some]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c) for c in columns], ["query", "id", "score"])

    return run


def coverage(spark: SparkSession, path: str, eligible: DataFrame, floor: float = C.LEXICAL_COVERAGE) -> dict:
    """Distinct indexed ids of ``eligible`` ids, and whether the projection may serve: at least ``floor`` of them."""
    have = stored(spark, path).select("id").distinct().join(eligible.select("id").distinct(), "id", "left_semi").count()
    all_ = eligible.select("id").distinct().count()
    return {"indexed": have, "eligible": all_, "active": all_ > 0 and have >= floor * all_}
