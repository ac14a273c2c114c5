"""Retrieval metrics, weight grids and confidence intervals over ``event, rank, gain``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom import config as C


def metrics(surfaced: DataFrame, k: int = C.EVAL_K) -> DataFrame:
    """(event, recall, rr, ndcg) of rows ``event, rank, relevant`` with ranks from 1; null without relevant rows."""
    top, hit = F.col("rank") <= k, F.col("relevant")
    w = 1 / F.log2(F.col("rank") + 1)
    rows = surfaced.groupBy("event").agg(
        F.sum((top & hit).cast("long")).alias("found"),
        F.sum(hit.cast("long")).alias("all"),
        F.min(F.when(hit & top, F.col("rank"))).alias("first"),
        F.sum(F.when(hit & top, w).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("all").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    some = F.col("all") > 0
    return rows.select(
        "event",
        F.when(some, F.col("found") / F.col("all")).alias("recall"),
        F.when(some, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("rr"),
        F.when(some, F.col("dcg") / ideal).alias("ndcg"),
    )


def graded(surfaced: DataFrame, labels: DataFrame, k: int = C.EVAL_K) -> DataFrame:
    """(event, ndcg, harm) of ``event, id, rank`` (from 1) against ``event, id, role``, a row for each event of either.

    Roles are expected, neighbour (derived from or into an expected id) and forbidden; of several forbidden
    counts first for the gain, then expected. The ideal order has the expected ids, then the neighbours;
    without any of both, ndcg is null. ``harm`` says that a forbidden id is among the first ``k``.
    """
    role = F.col("role")
    each = labels.groupBy("event", "id").agg(*[F.max((role == r).cast("int")).alias(r) for r in C.GAINS])
    gain = F.when(F.col("forbidden") == 1, C.GAINS["forbidden"]).when(F.col("expected") == 1, C.GAINS["expected"]).when(F.col("neighbour") == 1, C.GAINS["neighbour"]).otherwise(0.0)
    near = (F.col("neighbour") == 1) & (F.col("expected") == 0)
    rows = each.withColumn("gain", gain).join(surfaced.where(F.col("rank") <= k), ["event", "id"], "full")
    sums = rows.groupBy("event").agg(
        F.coalesce(F.sum("expected"), F.lit(0)).alias("e"), F.count_if(near).alias("n"),
        F.coalesce(F.sum(F.col("gain") / F.log2(F.col("rank") + 1)), F.lit(0.0)).alias("dcg"),
        (F.count_if(F.col("rank").isNotNull() & (F.col("forbidden") == 1)) > 0).alias("harm"),
    )
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), (F.col("e") + F.col("n")).cast("int"))))
    weight = lambda i: F.when(i <= F.col("e"), C.GAINS["expected"]).otherwise(C.GAINS["neighbour"])
    ideal = F.aggregate(places, F.lit(0.0), lambda s, i: s + weight(i) / F.log2(i + 1))
    return sums.select("event", F.when(F.col("e") + F.col("n") > 0, F.col("dcg") / ideal).alias("ndcg"), "harm")


def failure_rates(ranks: DataFrame) -> DataFrame:
    """(leg, n, failure_20, recall_5, recall_10, recall_20) of ``leg, rank``: ranks of the wanted ids from 0, null for a miss."""
    share = lambda k: F.avg(F.coalesce(F.col("rank") < k, F.lit(False)).cast("int"))
    return ranks.groupBy("leg").agg(F.count("*").alias("n"), (1 - share(20)).alias("failure_20"), *[share(k).alias(f"recall_{k}") for k in (5, 10, 20)])


def weight_overlay(rows: DataFrame, frozen: dict[str, float]) -> DataFrame:
    """One row (the weights, applied): those of the latest row by (ts, id), or the frozen ones.

    Rows have ``id, ts, reviewed, cold_start, harm_delta, ndcg_delta, headroom`` and a column a weight. Only the latest is
    looked at: it must be reviewed, not from a cold start, do no more harm, gain NDCG and have finite weights.
    """
    last = rows.agg(F.max_by(F.struct(*rows.columns), F.struct(F.coalesce("ts", F.lit("")), F.coalesce("id", F.lit("")))).alias("r"))
    r = lambda name: F.col(f"r.{name}")
    finite = lambda name: F.abs(r(name)) < float("inf")
    fit = r("reviewed") & ~F.coalesce(r("cold_start"), F.lit(False)) & F.coalesce(r("headroom"), F.lit(True))
    for name in ("harm_delta", "ndcg_delta", *frozen):
        fit = fit & finite(name)
    fit = F.coalesce(fit & (r("harm_delta") <= 0) & (r("ndcg_delta") > 0), F.lit(False))
    return last.select(*[F.when(fit, r(name)).otherwise(F.lit(w)).alias(name) for name, w in frozen.items()], F.when(fit, r("id")).alias("applied"))


def abstain_f1(rows: DataFrame) -> DataFrame:
    """(tp, fp, fn, f1) of ``should, did``."""
    both = lambda a, b: F.sum((a & b).cast("long"))
    s, d = F.col("should"), F.col("did")
    n = rows.agg(both(s, d).alias("tp"), both(~s, d).alias("fp"), both(s, ~d).alias("fn"))
    return n.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def grid(candidates: DataFrame, k: int = C.EVAL_K) -> DataFrame:
    """(engagement, damping, ndcg) for each point of the weight grid over ``event, id, base, eng, damp, relevant``.

    Scores are compared in units of 1e-6; of rows with equal score and id those that aren't relevant come first. Rows are dealt once
    by event, not once a point: a task goes through its events in order and keeps a batch and, of the event that may go on
    in the next one, each point's best ``k``. Tasks send on one sum a point.
    """
    points = [(e, d) for e in C.GRID_ENGAGEMENT for d in C.GRID_DAMPING]
    score = lambda e, d: F.round((F.col("base") + F.lit(e) * F.col("eng") + F.lit(d) * F.col("damp")) * 1e6).cast("long")
    dealt = candidates.select("event", "id", "relevant", "base", "eng", "damp").repartition("event").sortWithinPartitions("event", "id", "relevant")
    rows = dealt.select("event", "relevant", *[score(e, d).alias(f"s{i}") for i, (e, d) in enumerate(points)])
    sums = rows.mapInArrow(_grid_sums(points, k), "engagement double, damping double, total double, n long")
    return sums.groupBy("engagement", "damping").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("ndcg"))


def _grid_sums(points: list[tuple[float, float]], k: int):
    def run(batches):
        """A row a point with the NDCG of the task's events; rows come by event, and those of equal score in order."""
        import pyarrow as pa
        import pyarrow.compute as pc

        gain = 1 / np.log2(np.arange(k) + 2)
        ideal, total, n, event = np.concatenate([[1.0], np.cumsum(gain)]), np.zeros(len(points)), 0, None
        best: list[tuple[np.ndarray, np.ndarray]] = []  # of the open event, by point: scores and relevance
        open_relevant, some = 0, False

        def close(dcg: np.ndarray, relevant: np.ndarray) -> None:
            nonlocal n, total
            hit = relevant > 0
            n += int(hit.sum())
            total += (dcg[:, hit] / ideal[np.minimum(relevant[hit], k)]).sum(1)

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = pc.dictionary_encode(batch.column("event"), null_encoding="encode")
            e, names = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), codes.dictionary
            if some and names[0].as_py() != event:
                e = e + 1
            held = len(best[0][0]) if some else 0
            own = batch.column("relevant").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            relevant = np.bincount(e, own, e[-1] + 1).astype(np.int64)
            relevant[0] += open_relevant
            e = np.concatenate([np.zeros(held, np.int64), e])
            rank = np.arange(len(e)) - np.searchsorted(e, e)
            top = np.flatnonzero(rank < k)
            dcg, kept = np.zeros((len(points), e[-1] + 1)), top[e[top] == e[-1]]
            for i in range(len(points)):
                score = batch.column(f"s{i}").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                hit = own
                if held:
                    score, hit = np.concatenate([best[i][0], score]), np.concatenate([best[i][1], own])
                order = np.lexsort((~score, e))  # stable, and the greatest score first
                dcg[i] = np.bincount(e[top], hit[order[top]] * gain[rank[top]], e[-1] + 1)
                best[i : i + 1] = [(score[order[kept]], hit[order[kept]])]
            close(dcg[:, :-1], relevant[:-1])
            last, open_relevant, some, event = dcg[:, -1:], int(relevant[-1]), True, batch.column("event")[-1].as_py()
        if some:
            close(last, np.array([open_relevant]))
            yield pa.record_batch([pa.array([p[0] for p in points]), pa.array([p[1] for p in points]), pa.array(total), pa.array([n] * len(points))], ["engagement", "damping", "total", "n"])

    return run


def bootstrap_ci(rows: DataFrame, resamples: int = C.CI_RESAMPLES, level: float = C.CI_LEVEL) -> DataFrame:
    """(mean, low, high) of ``value`` by a Poisson bootstrap.

    A row's weight in a resample is Poisson(1), so rows of one value together weigh Poisson(their number):
    one draw for each distinct value, from a generator keyed by it. Tasks send on one partial sum a
    resample: no task holds the rows, and results don't depend on partitions.
    """

    def draw(batches):
        import pandas as pd

        weight, total = np.zeros(resamples), np.zeros(resamples)
        for b in batches:
            for x, n in zip(b["value"].to_numpy(), b["n"].to_numpy(), strict=True):
                w = np.random.Generator(np.random.Philox(key=int(np.float64(x).view(np.uint64)))).poisson(float(n), resamples)
                weight += w
                total += w * x
        yield pd.DataFrame({"resample": np.arange(resamples), "weight": weight, "total": total})

    plain = rows.where("value is not null").groupBy(F.col("value").cast("double").alias("value")).agg(F.count("*").alias("n"))
    whole = plain.agg(F.lit(-1).cast("long").alias("resample"), F.sum("n").cast("double").alias("w"), F.sum(F.col("n") * F.col("value")).alias("t"))
    sums = plain.mapInPandas(draw, "resample long, weight double, total double").groupBy("resample").agg(F.sum("weight").alias("w"), F.sum("total").alias("t"))
    drawn, mean = F.col("resample") >= 0, F.try_divide(F.col("t"), F.col("w"))
    edge = (1 - level) / 2
    ends = [F.percentile(F.when(drawn, mean), F.lit(x)).alias(name) for x, name in ((edge, "low"), (1 - edge, "high"))]
    return sums.unionByName(whole).agg(F.max(F.when(~drawn, mean)).alias("mean"), *ends)


def weekly_volume(signals: DataFrame, weeks: int = C.VOLUME_WEEKS) -> DataFrame:
    """(volume): the floored mean of rows in each of the last weeks that have any, 0 without rows; ``ts`` by UTC.

    A week's key is the calendar year and the ISO week.
    """
    key = F.struct(F.year("ts").alias("y"), F.weekofyear("ts").alias("w"))
    counts = signals.where("ts is not null").groupBy(key.alias("week")).agg(F.count("*").alias("n"))
    last = counts.orderBy(F.desc("week")).limit(weeks)
    return last.agg(F.coalesce(F.floor(F.avg("n")), F.lit(0)).cast("long").alias("volume"))


def phase_gate(measured: DataFrame) -> DataFrame:
    """(criterion, measured, threshold, met) of one row: labels, ndcg_delta, harm_delta, volume, weeks; null isn't met."""
    rules = [
        ("labels", C.GATE_LABELS, True), ("ndcg_delta", C.GATE_NDCG, True), ("harm_delta", C.GATE_HARM, False),
        ("volume", C.GATE_WEEKLY, True), ("weeks", C.GATE_WEEKS, True),
    ]
    each = [
        F.struct(
            F.lit(name).alias("criterion"), F.col(name).cast("double").alias("measured"), F.lit(float(bound)).alias("threshold"),
            F.coalesce((F.col(name) >= bound) if at_least else (F.col(name) <= bound), F.lit(False)).alias("met"),
        )
        for name, bound, at_least in rules
    ]
    return measured.select(F.inline(F.array(*each)))


def best_weights(points: DataFrame, baseline_harm: Column | float) -> DataFrame:
    """The row of ``iteration, ndcg, harm, ...`` with most NDCG whose harm isn't above the baseline's.

    Ties go to less harm, then to the earlier iteration. No row if none qualifies. One aggregate, no sort.
    """
    fit = points.where(F.col("ndcg").isNotNull() & ~F.isnan("ndcg") & (F.col("harm") <= baseline_harm))
    top = F.max_by(F.struct(*points.columns), F.struct(F.col("ndcg"), -F.col("harm"), -F.col("iteration")))
    return fit.agg(top.alias("p")).where("p is not null").select("p.*")
