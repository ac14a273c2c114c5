"""Selection among scored candidates: masks, density, diversity, budgets and propensities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom import config as C


def avg_pairwise_cosine(vectors: DataFrame) -> DataFrame:
    """(n, avg) over all pairs of unit vectors without making a pair.

    The squared length of the sum holds each pair twice and each vector with itself once.
    """
    parts = vectors.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x")).alias("own"), F.count("*").alias("n"))
    total = parts.agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("both"), F.sum("own").alias("own"))
    return total.select("n", F.when(F.col("n") > 1, (F.col("both") - F.col("own")) / (F.col("n") * (F.col("n") - 1))).alias("avg"))


def density(scored: DataFrame, group: str, score: str) -> DataFrame:
    """(group, n, near, flag): how many scores lie within 5 % of the group's best."""
    best = scored.groupBy(group).agg(F.max(score).alias("best"), F.count("*").alias("n"))
    near = scored.join(best, group).where(F.col(score) >= (1 - C.DENSE_SHARE) * F.col("best")).groupBy(group).agg(F.first("n").alias("n"), F.count("*").alias("near"))
    flag = F.when(F.col("near") >= C.DENSE_COUNT, "crowded").when(F.col("n") < C.SPARSE_COUNT, "sparse").otherwise("normal")
    return near.select(group, "n", "near", flag.alias("flag"))


def predicate_mask(vectors: DataFrame, excluded: list[list[float]], threshold: float = C.PREDICATE_COSINE) -> DataFrame:
    """(id, masked): cosine with any excluded vector above the threshold.

    Predicates are a bounded list, so each batch takes one matrix product; a list beyond the bound is refused.
    """
    if len(excluded) > C.PREDICATES_MAX:
        raise ValueError(f"{len(excluded)} predicates, {C.PREDICATES_MAX} allowed")
    p = np.asarray(excluded, np.float64)
    p = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-300) if len(p) else p

    def run(batches):
        for b in batches:
            masked = np.zeros(len(b), bool)
            some = np.flatnonzero(b["embedding"].notna().to_numpy())
            if len(some) and len(p):
                v = np.stack(b["embedding"].iloc[some].to_list()).astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                masked[some] = (v @ p.T > threshold).any(axis=1)
            yield b[["id"]].assign(masked=masked)

    return vectors.select("id", "embedding").mapInPandas(run, "id long, masked boolean")


def consent_factor(basis: Column) -> Column:
    return F.when(basis == "blocked", C.CONSENT["blocked"]).when(basis == "third_party_inferred", C.CONSENT["third_party_inferred"]).otherwise(1.0)


def mmr(candidates: DataFrame, most: int = C.MMR_OUTPUT, weight: float = C.MMR_LAMBDA, inputs: int = C.MMR_INPUT) -> DataFrame:
    """(query, id, position): greedy diversity over each query's best candidates ``query, id, score, embedding``.

    Only the best ``inputs`` of a query take part, which is the operator's definition and bounds a group.
    The similarity to what is chosen counts from 0; ties go to the earlier candidate.
    """
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = candidates.withColumn("r", F.row_number().over(w)).where(F.col("r") <= inputs)

    def pick(g):
        g = g.sort_values("r", ignore_index=True)
        v = np.stack(g["embedding"].to_list()).astype(np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        near, free, order = np.zeros(len(g)), np.ones(len(g), bool), []
        while free.any() and len(order) < most:
            gain = np.where(free, weight * g["score"].to_numpy() - (1 - weight) * near, -np.inf)
            order.append(int(gain.argmax()))
            free[order[-1]] = False
            near = np.maximum(near, v @ v[order[-1]])
        return g.loc[order, ["query", "id"]].assign(position=range(len(order)))

    return best.groupBy("query").applyInPandas(pick, "query long, id long, position long")


def char_budget(items: DataFrame, group: str, total: int = C.BRIEF_CHARS, each: int = C.BRIEF_ITEM_CHARS, most: int = C.BRIEF_ITEMS) -> DataFrame:
    """Items ``pos, content`` cut to ``each`` characters, then to a running ``total``: the last one that fits in part stays in part."""
    w = Window.partitionBy(group).orderBy("pos")
    rows = items.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).withColumn("content", F.substring("content", 1, each))
    before = F.coalesce(F.sum(F.length("content")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("left", total - before).where("left > 0").select(group, "pos", F.expr("substring(content, 1, cast(left as int))").alias("content"))


def softmax(scored: DataFrame, group: str, score: str, tau: float = C.PROPENSITY_TAU) -> DataFrame:
    """Adds p, the softmax of the scores in each group; two aggregates, so that a hot group never meets in one task."""
    best = scored.groupBy(group).agg(F.max(score).alias("top"))
    raised = scored.join(best, group).withColumn("e", F.exp((F.col(score) - F.col("top")) / tau))
    total = raised.groupBy(group).agg(F.sum("e").alias("sum"))
    return raised.join(total, group).withColumn("p", F.col("e") / F.col("sum")).drop("top", "e", "sum")


def jitter(seed: Column, place: Column) -> Column:
    """A number in [-1, 1] for the place-th candidate: the place-th four bytes of the seed's digests, a block of eight each.

    A block's digest is SHA-256 of the seed and the block's number as eight little-endian bytes.
    """
    block, at = F.floor(place / 8), place % 8
    number = F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(block, 8 * k).bitwiseAND(255)), 2, "0") for k in range(8)])
    digest = F.sha2(F.concat(seed.cast("binary"), F.unhex(number)), 256)
    byte = lambda k: F.conv(F.substr(digest, (8 * at + 2 * k + 1).cast("int"), F.lit(2)), 16, 10).cast("long")
    whole = sum((byte(k) * (1 << (8 * k)) for k in range(1, 4)), byte(0))
    return 2 * (whole / 0xFFFFFFFF) - 1


def propensities(ranked: DataFrame, group: str, score: str, place: str, seed: str, tau: float = C.PROPENSITY_TAU) -> DataFrame:
    """Adds ``propensity``: the softmax over each group of scores moved by at most PROPENSITY_JITTER of their size.

    ``place`` numbers a group's candidates from 0; a group is a bounded list, such as the candidates of one recall.
    """
    moved = F.col(score) + jitter(F.col(seed), F.col(place)) * C.PROPENSITY_JITTER * F.abs(score)
    w = Window.partitionBy(group)
    rows = ranked.withColumn("_moved", moved).withColumn("_e", F.exp((F.col("_moved") - F.max("_moved").over(w)) / tau))
    return rows.withColumn("propensity", F.col("_e") / F.sum("_e").over(w)).drop("_moved", "_e")


def idf_jaccard(sets: DataFrame, query: list[str]) -> DataFrame:
    """(id, score): idf of the shared keys over idf of all keys of either, between rows ``id, keys`` and one query set.

    Keys are entity match keys; ``peers``, if there, are keys that name the row's own group or channel,
    which weigh as if every row had them. Only rows that share a key are joined to the frequencies.
    """
    asked = sorted(set(query))
    keys, peers = F.array_distinct("keys"), F.coalesce("peers", F.array().cast("array<string>")) if "peers" in sets.columns else F.array().cast("array<string>")
    rows = sets.select("id", keys.alias("keys"), peers.alias("peers"))
    n = rows.count()
    df = rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("df"))
    idf = lambda d: F.log((n - d + 0.5) / (d + 0.5) + 1)
    known = {r["key"]: r["df"] for r in df.where(F.col("key").isin(asked)).collect()}
    met = rows.where(F.arrays_overlap("keys", F.array(*[F.lit(t) for t in asked])))
    # What the query has and the row lacks; a key that no row has counts as one row's.
    missing = F.lit(0.0)
    for t in asked:
        missing = missing + F.when(F.array_contains("keys", t), 0.0).when(F.array_contains("peers", t), idf(F.lit(n))).otherwise(idf(F.lit(known.get(t, 1))))
    each = met.select("id", "peers", missing.alias("missing"), F.explode("keys").alias("key")).join(df, "key")
    weight = idf(F.when(F.array_contains("peers", F.col("key")), F.lit(n)).otherwise(F.col("df")))
    sums = each.groupBy("id").agg(F.sum(F.when(F.col("key").isin(asked), weight).otherwise(0.0)).alias("both"), F.sum(weight).alias("own"), F.first("missing").alias("missing"))
    return sums.select("id", (F.col("both") / (F.col("own") + F.col("missing"))).alias("score"))
