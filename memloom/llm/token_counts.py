"""Token counts through a digest cache.

The cache is a Parquet table ``(version, content, n_tokens)``: the digest of the
tokenizer (file and library), the digest of the text as the tokenizer sees it,
and the stored count. Known digests are joined; each distinct unknown text is
encoded once and appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import path_exists, text_rows, written
from .tokenizing import TokenCounter, tokenizer_version

CACHE_SCHEMA = "content binary, n_tokens long, version string"


def _cache(docs: DataFrame, path: str, version: str) -> DataFrame:
    spark = docs.sparkSession
    if not path_exists(spark, path):
        return spark.createDataFrame([], CACHE_SCHEMA).select("content", "n_tokens")
    return spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("version") == version).select("content", "n_tokens")


def _packed_texts(batches):
    """Each distinct text of the task once, compressed for the shuffle."""
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    seen: set[bytes] = set()
    for batch in batches:
        digests, texts = [], []
        for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest not in seen:
                seen.add(digest)
                digests.append(digest)
                texts.append(pack(text.encode()))
        yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(texts, pa.binary())], ["content", "packed"])


def _counter(tokenizer: str):
    def run(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        counter = TokenCounter(tokenizer)
        seen: set[bytes] = set()
        for batch in batches:
            digests, texts = [], []
            for digest, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    texts.append(unpack(packed).decode())
            counts = counter.count_all(pa.array(texts, pa.string()))
            yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return run


def count_tokens(
    docs: DataFrame,
    cache_path: str,
    tokenizer: str = "byte_bpe_50k.json",
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (``n_tokens > limit``).

    Null text counts as empty (0 tokens). A repeated row gives a repeated result, a
    null id stays null, other columns are ignored, an empty table gives no rows. The
    cache only ever gains rows; two runs that add the same text at once leave two
    equal rows, of which the join sees one.
    """
    version = tokenizer_version(tokenizer)
    keyed = text_rows(docs, id_col, text_col).withColumn("content", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    digests = keyed.select("content").distinct()
    missing = written(digests.join(_cache(docs, cache_path, version), "content", "left_anti"), "missing")
    if not missing.isEmpty():
        texts = keyed.select("content", "text").mapInArrow(_packed_texts, "content binary, packed binary")
        counted = (
            texts.join(missing, "content", "left_semi")
            .mapInArrow(_counter(tokenizer), "content binary, n_tokens long")
            .groupBy("content")
            .agg(F.max("n_tokens").alias("n_tokens"))
        )
        counted.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache_path)
    # Written, so that the join has two plain shuffles and Spark can split a digest with very many rows.
    stored = written(_cache(docs, cache_path, version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "stored")
    rows = keyed.select("id", F.octet_length("text").cast(T.LongType()).alias("n_bytes"), "content")
    return rows.join(stored, "content").select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
