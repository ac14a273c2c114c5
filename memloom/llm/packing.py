"""Best-fit packing of token pieces by patterns and non-negative least squares.

Documents become token ids (and one end id), cut into pieces of at most
``capacity`` tokens. What is packed is the histogram of piece lengths, whose size
is bounded by ``capacity`` and not by the corpus: patterns of one to three
lengths that fill a sequence are enumerated, their repeat counts fitted by
non-negative least squares and rounded down, and what is left is packed best fit
first, again as patterns with counts. The rank of a piece among those of its
length then decides its sequence and offset by arithmetic.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_rows, written
from .tokenizing import WordEncoder

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def _cut(tokenizer: str, capacity: int, end_id: int):
    """Pieces of each row; ``nth`` counts the pieces of one length within the task."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = WordEncoder(tokenizer)
        end = np.array([end_id], "<u4")
        task = TaskContext.get().partitionId()
        nth = np.zeros(capacity + 1, np.int64)
        names = [c.split()[0] for c in PIECES.split(", ")]
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
        for batch in slices(batches):
            rows = []
            for doc, made in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1)), strict=True):
                ids = np.concatenate((made, end))
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    n = len(part)
                    rows.append((doc, k, at, n, zlib.crc32(part.tobytes()), task, int(nth[n])))
                    nth[n] += 1
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def enumerate_patterns(hist: np.ndarray, capacity: int, partners: int = 12) -> np.ndarray:
    """Patterns of at most three lengths, as a (P, 3) array of lengths (0: none).

    For each length the pairs with the largest lengths that still fit, and the triples with
    ``partners`` second lengths spread over those present and the largest third that fits.
    """
    have = np.flatnonzero(hist)
    have = have[have > 0]
    if not len(have):
        return np.zeros((0, 3), np.int64)

    def largest(room: np.ndarray) -> np.ndarray:
        """The largest length present that fits into each room, or 0."""
        at = np.searchsorted(have, room, "right") - 1
        return np.where(at >= 0, have[np.maximum(at, 0)], 0)

    found = [np.stack([have, np.zeros_like(have), np.zeros_like(have)], 1)]
    second = largest(capacity - have)
    found.append(np.stack([have, second, np.zeros_like(have)], 1))
    spread = have[np.linspace(0, len(have) - 1, min(partners, len(have))).astype(int)]
    for b in [*spread, None]:
        mid = have if b is None else np.full_like(have, b)  # None: the same length twice
        room = capacity - have - mid
        third = np.where(room > 0, largest(np.maximum(room, 0)), 0)
        found.append(np.stack([have, mid, third], 1)[room >= 0])
    rows = np.sort(np.concatenate(found), axis=1)[:, ::-1]
    rows = np.unique(rows, axis=0)
    return rows[(rows.sum(1) <= capacity) & (rows[:, 0] > 0)]


def fit_repeats(patterns: np.ndarray, hist: np.ndarray, steps: int = 600) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient: repeats x >= 0 with A x near the histogram."""
    n = len(hist)
    used = patterns > 0
    target = hist.astype(float).copy()
    target[0] = 0

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(patterns.ravel(), (x[:, None] * used).ravel(), n)

    def back(r: np.ndarray) -> np.ndarray:
        return (r[patterns] * used).sum(1)

    power = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue gives the step
        power = back(times(power))
        power /= np.linalg.norm(power) or 1
    step = 1 / max(1e-9, float(power @ back(times(power))) * 1.05)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(times(y) - target))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit_patterns(hist: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Pack a histogram best fit first: ([(length, times)], repeats) until nothing is left.

    The longest piece opens a sequence, then the longest that fits enters, again and again; the
    sequence so made is repeated as often as the counts allow.
    """
    left = hist.copy()
    made = []
    have = [int(x) for x in np.flatnonzero(left) if x > 0]
    from bisect import bisect_right

    while have:
        room, pattern = capacity, []
        at = len(have)
        while room and at:
            at = min(at, bisect_right(have, room))
            if not at:
                break
            size = have[at - 1]
            times = min(room // size, int(left[size]))
            pattern.append((size, times))
            room -= size * times
            at -= 1
        repeats = min(int(left[size]) // times for size, times in pattern)
        for size, times in pattern:
            left[size] -= repeats * times
        made.append((pattern, repeats))
        have = [x for x in have if left[x]]
    return made


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns with repeat counts that use up the histogram exactly."""
    patterns = enumerate_patterns(hist, capacity)
    # Only sequences filled to a 256th are worth fixing early; the rest is left to best fit.
    patterns = patterns[patterns.sum(1) >= capacity - capacity // 256]
    left, made = hist.copy(), []
    if len(patterns):
        repeats = np.floor(fit_repeats(patterns, hist) + 1e-6).astype(np.int64)
        for p in np.argsort(-patterns.sum(1), kind="stable"):
            sizes, times = np.unique(patterns[p][patterns[p] > 0], return_counts=True)
            n = min(int(repeats[p]), *(int(left[s]) // int(k) for s, k in zip(sizes, times, strict=True)))
            if n > 0:
                left[sizes] -= n * times
                made.append(([(int(s), int(k)) for s, k in zip(sizes[::-1], times[::-1], strict=True)], n))
    return made + best_fit_patterns(left, capacity)


def _placement(made: list[tuple[list[tuple[int, int]], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank of each use of it, and for that use repeats' size, first sequence and offset."""
    uses: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, repeats in made:
        offset = 0
        for size, times in pattern:
            uses.setdefault(size, []).append((taken.get(size, 0), times, sequence, offset))
            taken[size] = taken.get(size, 0) + times * repeats
            offset += size * times
        sequence += repeats
    return {size: tuple(np.array(c) for c in zip(*rows, strict=True)) for size, rows in uses.items()}


def pack(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of the end id alone. Repeated rows are packed each, null
    ids stay, other columns are ignored, an empty table gives no rows. The pieces (without
    their ids) are written once to the shared folder, so ranks are settled before the plan is
    made; a lost executor can't change them.
    """
    pieces = written(text_rows(docs, id_col, text_col).mapInArrow(_cut(tokenizer, capacity, end_id), PIECES), "pieces")
    runs = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = runs.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    hist = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows
        hist[r["length"]] = r["n"]
    placement = docs.sparkSession.sparkContext.broadcast(_placement(plan(hist, capacity)))
    ranked = pieces.join(first, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("first")).alias("rank")
    )

    def run(batches):
        import pyarrow as pa

        where = placement.value
        for batch in batches:
            sizes = batch.column(3).to_numpy(zero_copy_only=False)
            ranks = batch.column(5).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                starts, times, base, shift = where[int(size)]
                use = np.searchsorted(starts, ranks[mine], "right") - 1
                inside = ranks[mine] - starts[use]
                sequence[mine] = base[use] + inside // times[use]
                offset[mine] = shift[use] + inside % times[use] * size
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names)

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
