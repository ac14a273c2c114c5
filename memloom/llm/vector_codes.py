"""Product codes of vectors: each part of a vector becomes the index of its nearest codebook entry.

All is done on integers, so that codes and errors don't depend on how rows are dealt. The nearest entry is found by lower bounds from
segment means, coarse to fine: for a segment of L components with sums s and t and residual norms r and q,
the squared distance is at least (s - t)^2 / L + (r - q)^2. Entries whose bound passes the exact
distance of the most likely one go; the others get exact integer distances.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of which a task holds bounds at once.
BLOCK = 1024
#: Components up to this have exact squared distances in 64-bit integers; beyond, Python's integers are used.
LARGEST = 1 << 26
#: Share of entries left from which on all pairs of a block are worked on at once.
DENSE = 1 / 16
#: Share by which a float bound may be too large.
SLACK = 1e-9


def _segments(n: int) -> list[int]:
    """Segments of each level: one, then four times as many while they divide the part and hold two components."""
    levels = [1]
    while n % (levels[-1] * 4) == 0 and n // (levels[-1] * 4) >= 2:
        levels.append(levels[-1] * 4)
    return levels


def _means(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row and each of its k segments: the mean times the square root of the length, and the residual's norm."""
    s = x.reshape(len(x), k, -1).astype(float)
    mean = s.mean(2)
    rest = np.sqrt(((s - mean[:, :, None]) ** 2).sum(2))
    return mean * np.sqrt(s.shape[2]), rest


class Book:
    """The entries of one part position, with the segment means of each level."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.wide = entries.dtype == object
        if not self.wide:
            self.levels = [(k, *_means(entries, k)) for k in _segments(entries.shape[1])]
            self.norms = (entries.astype(float) ** 2).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of the nearest entry (the lower of equals) and squared distance of each row; distances computed in full."""
        if self.wide or x.dtype == object:
            d = ((x.astype(object)[:, None, :] - self.entries.astype(object)[None]) ** 2).sum(2)
            at = np.array([min(range(len(r)), key=r.__getitem__) for r in d], np.int64)
            return at, d[np.arange(len(x)), at], d.size
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        norms = (x.astype(float) ** 2).sum(1)
        left = None
        for k, mean, rest in self.levels:
            m, r = _means(x, k)
            if left is None:  # one segment: two numbers a row
                low = (m - mean[:, 0]) ** 2 + (r - rest[:, 0]) ** 2
                likely = low.argmin(1)
                least = self._exact(x, np.arange(len(x)), likely)
                most = least + SLACK * (norms + self.norms.max()) + 1
                left = low <= most[:, None]
            elif left.mean() > DENSE:
                low = (m**2).sum(1)[:, None] + (mean**2).sum(1) - 2 * (m @ mean.T) + (r**2).sum(1)[:, None] + (rest**2).sum(1) - 2 * (r @ rest.T)
                left &= low <= most[:, None]
            else:
                row, entry = np.nonzero(left)
                low = ((m[row] - mean[entry]) ** 2).sum(1) + ((r[row] - rest[entry]) ** 2).sum(1)
                left[row, entry] = low <= most[row]
        full = int(left.sum())
        largest = max(np.abs(x).max(initial=0), np.abs(self.entries).max(initial=0))
        if full > DENSE * left.size and 4 * x.shape[1] * int(largest) ** 2 < 1 << 53:
            # All terms and sums are whole numbers below 2^53, so these products are the exact integer distances.
            whole = self.entries.astype(float)
            d = norms[:, None] + self.norms - 2 * (x.astype(float) @ whole.T)
            d[~left] = np.inf
            at = d.argmin(1)
            return at, d[np.arange(len(x)), at].astype(np.int64), full
        row, entry = np.nonzero(left)
        d = self._exact(x, row, entry)
        # Pairs stand by row, then entry: the first of the least is the answer.
        starts = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(d, starts)
        hits = np.flatnonzero(d == least[row])
        at = entry[hits[np.searchsorted(row[hits], np.arange(len(x)))]]
        return at, least, full

    def _exact(self, x: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
        out = np.empty(len(row), np.int64)
        for i in range(0, len(row), 1 << 16):
            gap = x[row[i : i + (1 << 16)]] - self.entries[entry[i : i + (1 << 16)]]
            out[i : i + (1 << 16)] = np.einsum("ij,ij->i", gap, gap)
        return out


def integers(column, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(1024 * x) of the rows whose length is ``dims``, and which rows these are."""
    lengths = np.array([-1 if n is None else n for n in _lengths(column)])
    fit = np.flatnonzero(lengths == dims)
    flat = column.take(_indices(fit)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(fit), dims)
    floors = np.floor(flat * SCALE)
    if len(floors) and dims and np.abs(floors).max() > LARGEST:
        return np.array([[int(v) for v in r] for r in floors], object).reshape(len(fit), dims), fit
    return floors.astype(np.int64), fit


def _lengths(column):
    import pyarrow.compute as pc

    return pc.list_value_length(column).to_pylist()


def _indices(at: np.ndarray):
    import pyarrow as pa

    return pa.array(at, pa.int64())


def _blocks(batches, dims: int):
    """(rows, integers, which rows fit) of at most BLOCK rows at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            part = batch.slice(i, BLOCK)
            yield part, *integers(part.column("embedding"), dims)


def _books(codebooks: np.ndarray) -> list[Book]:
    return [Book(c) for c in codebooks]


def _sums(codebooks, dims: int):
    """(part, entry, n, sums) of a task's vectors: a row for each entry that is some part's nearest."""

    def run(batches):
        import pyarrow as pa

        books, width = _books(codebooks.value), dims // PARTS
        count = np.zeros((PARTS, len(books[0].entries)), np.int64)
        total = np.zeros((*count.shape, width), object)
        for _, x, _ in _blocks(batches, dims):
            for p, book in enumerate(books):
                part = x[:, p * width : (p + 1) * width]
                at, _, _ = book.nearest(part)
                count[p] += np.bincount(at, minlength=count.shape[1])
                order = np.argsort(at, kind="stable")
                used, first = np.unique(at[order], return_index=True)
                if len(used):
                    total[p, used] += np.add.reduceat(part[order], first, axis=0)
        p, e = np.nonzero(count)
        sums = [[str(v) for v in total[i, j]] for i, j in zip(p, e, strict=True)]
        yield pa.record_batch([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(sums, pa.list_(pa.string()))], ["part", "entry", "n", "sums"])

    return run


def _codes(codebooks, dims: int):
    def run(batches):
        import pyarrow as pa

        books, width = _books(codebooks.value), dims // PARTS
        for block, x, fit in _blocks(batches, dims):
            code = np.zeros((len(x), PARTS), np.int64)
            error = np.zeros(len(x), object)
            for p, book in enumerate(books):
                code[:, p], d, _ = book.nearest(x[:, p * width : (p + 1) * width])
                error += d.astype(object)
            codes, errors = [None] * block.num_rows, [None] * block.num_rows
            for i, c, e in zip(fit.tolist(), code.tolist(), error.tolist(), strict=True):
                codes[i], errors[i] = "".join(f"{v:02x}" for v in c), int(e) if e < 1 << 63 else None
            yield pa.record_batch([block.column("vec_id"), block.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the vectors whose components are all finite numbers."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    rows = vectors.select(F.col("vec_id").cast("long"), label.alias("label"), F.col("embedding").cast("array<double>"))
    return rows.where(F.col("embedding").isNotNull() & ~bad)


def train(kept: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, component) after the rounds; None without a vector that can be coded.

    They start as the parts of the smallest ids (then by components, null ids last) of those of the first one's length.
    The driver holds the codebooks and, each round, one row an entry.
    """
    spark = kept.sparkSession
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    first = kept.orderBy(*order).first()
    if first is None or not first["embedding"] or len(first["embedding"]) % PARTS:
        return None
    dims = len(first["embedding"])
    same = kept.where(F.size("embedding") == dims)
    begin = [r[0] for r in same.orderBy(*order).limit(entries).select("embedding").collect()]
    rows = [[int(np.floor(v * SCALE)) for v in r] for r in begin]
    books = np.array(rows, object).reshape(len(rows), PARTS, dims // PARTS).transpose(1, 0, 2)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(_narrow(books))
        found = same.select("embedding").mapInArrow(_sums(shared, dims), "part int, entry int, n long, sums array<string>")
        # Sums as decimals: exact for any number of vectors whose components are up to 2^60.
        totals = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims // PARTS)]
        books = books.copy()
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():
            for i in range(dims // PARTS):
                books[r["part"], r["entry"], i] = int(r[f"s{i}"]) // r["n"]
    return books


def _narrow(books: np.ndarray) -> np.ndarray:
    """64-bit integers where squared distances fit them."""
    return books.astype(np.int64) if not books.size or max(map(abs, books.ravel())) <= LARGEST else books


def codebooks_digest(books: np.ndarray | None) -> str:
    return hashlib.sha256(",".join(str(v) for v in (books.ravel() if books is not None else ())).encode()).hexdigest()


def encode(kept: DataFrame, books: np.ndarray | None) -> DataFrame:
    """(vec_id, label, code, error) of each row of ``kept_vectors``."""
    if books is None:
        return kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    shared = kept.sparkSession.sparkContext.broadcast(_narrow(books))
    return kept.mapInArrow(_codes(shared, books.shape[0] * books.shape[2]), "vec_id long, label string, code string, error long")


def compress(vectors: DataFrame) -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error and codebooks_sha256.

    Vectors that are null or hold null or non-finite components are left out. One of another length than that of the
    smallest id, and any if that length is nought or four doesn't divide it, can't be coded: its code and error are null. An error
    beyond a long is null too; equal rows have equal results, null ids come last, null labels are one label, other
    columns are ignored, an empty table gives no rows. Fewer vectors than entries give as many entries.
    """
    kept = written(kept_vectors(vectors), "vectors")
    books = train(kept)
    coded = written(encode(kept, books), "codes")
    # Written, so that the join has two plain shuffles and Spark can split a label with very many rows.
    totals = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    told = totals.select(F.col("label").alias("of"), "label_error")
    return coded.join(told, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
