"""Nearest neighbours over an index of cells.

The index has a row for each vector in the folder of its cell (``vectors/cell=c``) and a table of cells with their
centroid, number of rows and radius. A search probes the cells whose centroid has the largest inner product with the query. An
exact search then visits each further cell whose bound, the centroid's product plus the query's norm times
the radius, reaches the k-th score found so far, so that it returns what a scan would.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom import config as C
from memloom.session import ship_package, written

#: Digits of a score that order rows, so that equal vectors tie however their products were summed.
DIGITS = 12
VECTORS = "id long, embedding array<double>, cell int"
CELLS = "cell int, n long, radius double, centroid array<double>"


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(float)
    return x.reshape(len(column), -1) if len(column) else x.reshape(0, 0)


def train(sample: np.ndarray, cells: int, rounds: int = C.CELL_ROUNDS) -> np.ndarray:
    """Centroids by Lloyd's rounds; they begin at rows evenly spaced in the sample, and an empty cell keeps its centroid."""
    at = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest_cell(sample, at)
        n = np.bincount(own, minlength=len(at))
        total = np.zeros_like(at)
        np.add.at(total, own, sample)
        at[n > 0] = total[n > 0] / n[n > 0, None]
    return at


def nearest_cell(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(1) / 2
    return np.concatenate([(x[i : i + 2048] @ centroids.T - half).argmax(1) for i in range(0, len(x), 2048)] or [np.zeros(0, int)])


def build(vectors: DataFrame, path: str, cell_rows: int = C.CELL_ROWS, sample: int = C.CELL_SAMPLE) -> None:
    """Index ``id, embedding``: every row whose vector has the common length and finite components; others have no score.

    Centroids are trained on at most ``sample`` rows, drawn by hash of the id; all rows are assigned. A cell with very many rows
    is written by several tasks.
    """
    spark = ship_package(vectors.sparkSession)
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where("id is not null and size(embedding) > 0")
    rows = rows.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    dims = rows.agg(F.mode(F.size("embedding"), deterministic=True)).first()[0]
    if dims is None:
        spark.createDataFrame([], CELLS).write.mode("overwrite").parquet(f"{path}/cells")
        spark.createDataFrame([], VECTORS).write.mode("overwrite").parquet(f"{path}/vectors")
        return
    rows = rows.where(F.size("embedding") == dims)
    n = rows.select("id").count()
    chance = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < F.lit(min(1.0, 1.2 * sample / max(1, n)) * 1_000_003)
    some = rows.where(chance).orderBy(F.xxhash64("id"), "id", "embedding").limit(sample).select("embedding").collect()
    some = some or rows.orderBy("id", "embedding").limit(1).select("embedding").collect()
    centroids = train(np.array([r[0] for r in some]), min(C.CELLS_MOST, math.ceil(n / cell_rows)))
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column("embedding"))
            own = nearest_cell(x, shared.value) if batch.num_rows else np.zeros(0, int)
            away = np.sqrt(((x - shared.value[own]) ** 2).sum(1)) if batch.num_rows else np.zeros(0)
            yield pa.record_batch([*batch.columns, pa.array(own, pa.int32()), pa.array(away)], ["id", "embedding", "cell", "away"])

    placed = rows.mapInArrow(assign, f"{VECTORS}, away double")
    dealt = placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(C.POSTING_SPLITS)))
    dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    stored = spark.read.schema(f"{VECTORS}, away double").parquet(f"{path}/vectors")
    told = {r["cell"]: r for r in stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}  # a row a cell
    cells = [(c, told[c]["n"], told[c]["radius"], centroids[c].tolist()) for c in sorted(told)]
    spark.createDataFrame(cells, CELLS).write.mode("overwrite").parquet(f"{path}/cells")


def _cells(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, sizes, radii and centroids: CELLS_MOST rows at most."""
    rows = spark.read.schema(CELLS).parquet(f"{path}/cells").orderBy("cell").collect()
    return (*(np.array([r[c] for r in rows]) for c in ("cell", "n", "radius")), np.array([r["centroid"] for r in rows]))


def _probes(queries: DataFrame, shared, probes: int, after: bool) -> DataFrame:
    """(query, cell): a query's first cells, or ``after`` them each cell whose bound reaches its ``least``."""

    def run(batches):
        import pyarrow as pa

        cell, _, radius, centroids = shared.value
        for batch in batches:
            q = _matrix(batch.column("embedding"))
            if not batch.num_rows:
                continue
            product = q @ centroids.T
            first = np.argsort(-product, axis=1, kind="stable")[:, :probes]
            wanted = np.zeros(product.shape, bool)
            np.put_along_axis(wanted, first, True, 1)
            if after:
                bound = product + np.sqrt((q**2).sum(1))[:, None] * radius
                least = batch.column("least").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                wanted = ~wanted & (bound >= least[:, None] - 1e-9 * (1 + abs(least[:, None])))
            row, at = np.nonzero(wanted)
            yield pa.record_batch([batch.column("query").take(pa.array(row)), pa.array(cell[at], pa.int32())], ["query", "cell"])

    return queries.mapInArrow(run, "query long, cell int")


def _best(k: int):
    def run(left, right):
        """The best k of the group's vectors for each of its queries."""
        import pyarrow as pa

        query, ids = left["query"].to_numpy(), right["id"].to_numpy()
        out: list[tuple] = []
        if len(query) and len(ids):
            order = np.argsort(ids, kind="stable")
            x, ids = _matrix(right["embedding"])[order], ids[order]
            q = _matrix(left["embedding"])
            for i in range(0, len(q), 256):
                score = np.round(q[i : i + 256] @ x.T, DIGITS)
                # Ids ascend, so a stable sort puts the lower of equals first.
                at = np.argsort(-score, axis=1, kind="stable")[:, :k]
                out.append((np.repeat(query[i : i + 256], at.shape[1]), ids[at].ravel(), np.take_along_axis(score, at, 1).ravel()))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c) for c in columns], ["query", "id", "score"])

    return run


def _meet(pairs: DataFrame, queries: DataFrame, path: str, sizes: dict[int, int], k: int) -> DataFrame:
    """(query, id, score): the best k of each query's cells. Groups hold BLOCK_ROWS vectors and BLOCK_QUERIES queries, about."""
    spark = pairs.sparkSession
    pairs = written(pairs, "probes")
    asked = pairs.groupBy("cell").agg(F.count("*").alias("asked")).collect()  # a row a cell
    if not asked:
        return spark.createDataFrame([], "query long, id long, score double")
    parts = [(r["cell"], math.ceil(sizes[r["cell"]] / C.BLOCK_ROWS), math.ceil(r["asked"] / C.BLOCK_QUERIES)) for r in asked]
    splits = F.broadcast(spark.createDataFrame(parts, "cell int, of_rows int, of_queries int"))  # CELLS_MOST rows at most
    chosen = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = pairs.join(splits, "cell").join(queries.select("query", "embedding"), "query").select("cell", chosen("query", "of_queries").alias("qs"), every("of_rows").alias("vs"), "query", "embedding")
    stored = spark.read.schema(VECTORS).parquet(f"{path}/vectors")
    right = stored.join(splits, "cell").select("cell", every("of_queries").alias("qs"), chosen("id", "of_rows").alias("vs"), "id", "embedding")
    by = ["cell", "qs", "vs"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_best(k), "query long, id long, score double")
    return _top(found, k)


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def search(queries: DataFrame, path: str, k: int, probes: int = C.PROBES, exact: bool = True) -> DataFrame:
    """(query, id, score): for each of ``query, embedding`` the best k by inner product, the lower id of equals.

    ``exact=False`` stops after the probes. Queries have an id each; those with a null vector, or one of another length than
    the index, find nothing. Fewer rows than k give all of them.
    """
    spark = queries.sparkSession
    cells = _cells(spark, path)
    if not len(cells[0]):
        return spark.createDataFrame([], "query long, id long, score double")
    rows = queries.select(F.col("query").cast("long").alias("query"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.size("embedding") == cells[3].shape[1])
    shared, sizes = spark.sparkContext.broadcast(cells), dict(zip(cells[0].tolist(), cells[1].tolist(), strict=True))
    near = _meet(_probes(rows, shared, probes, False), rows, path, sizes, k)
    if not exact or len(cells[0]) <= probes:
        return near
    near = written(near, "near")
    least = near.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    far = _meet(_probes(rows.join(least, "query", "left").select("query", "embedding", "least"), shared, probes, True), rows, path, sizes, k)
    return _top(near.unionByName(far), k)
