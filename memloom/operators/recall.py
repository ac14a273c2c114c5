"""The recall score of a candidate, and recall as one plan from hybrid search to the brief."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom import config as C
from memloom.functions.affect import valence_match
from memloom.functions.extract import anchor_step, match_key
from memloom.functions.scoring import decay, jaccard
from memloom.functions.text import content_hash
from memloom.functions.vector import dot
from memloom.operators import policies, retrieval, selection
from memloom.session import cut


def final_score(similarity: Column, gate: Column, additions: dict[str, Column], salience: Column) -> Column:
    """(similarity gated + weighted additions) times the root of salience.

    Without a vector a candidate needs additions over a floor, or it scores 0. Missing salience is 1.
    """
    added = sum((w * F.coalesce(additions[k], F.lit(0.0)) for k, w in C.RECALL_WEIGHTS.items() if k in additions), F.lit(0.0))
    whole = (F.coalesce(similarity, F.lit(0.0)) * gate + added) * F.coalesce(F.sqrt(salience), F.lit(1.0))
    return F.when(similarity.isNull() & (added < C.RECALL_FLOOR), 0.0).otherwise(whole)


def recall(facts: DataFrame, vectors: DataFrame, terms: list[str], vector: list[float], excluded: list[list[float]], recent: DataFrame) -> DataFrame:
    """(id, position, score, content): the brief for one question.

    ``facts`` has id, text, kind and age_days; ``recent`` the ids that were surfaced lately. After the
    two top-k legs every frame has at most ``FUSED_TOP`` rows: the joins broadcast those alone, and a
    checkpoint of them keeps the later steps from scanning the tables again.
    """
    fused = retrieval.rrf([retrieval.bm25_topk(facts, terms), retrieval.knn(vectors, vector, C.FUSED_TOP)])
    few = F.broadcast(fused)  # FUSED_TOP rows at most
    chosen = cut(facts.join(few, "id").join(vectors.join(few.select("id"), "id", "left_semi").select("id", "embedding"), "id", "left"))
    masked = selection.predicate_mask(chosen, excluded).where("masked").select("id")
    open_ = chosen.join(masked, "id", "left_anti").join(recent.select("id").distinct().withColumn("again", F.lit(True)), "id", "left")
    q = F.array(*[F.lit(float(x)) for x in vector])
    similarity = F.when(F.col("embedding").isNotNull(), dot(F.col("embedding"), q))
    hits = F.size(F.filter(F.array(*[F.lit(t) for t in sorted(set(terms))]), lambda t: F.contains(F.lower("text"), t)))
    score = final_score(similarity, F.lit(1.0), {"entity": hits / max(1, len(set(terms))), "decay": decay(F.col("age_days"), F.col("kind"))}, F.lit(None).cast("double"))
    damped = open_.withColumn("score", score * F.when(F.col("again"), C.RECENT_FACTOR).otherwise(1.0)).where("score > 0")
    w = Window.partitionBy(content_hash(F.col("text"))).orderBy(F.desc("score"), "id")
    single = damped.withColumn("copy", F.row_number().over(w)).where("copy = 1")
    width = len(vector)
    zeros = F.array_repeat(F.lit(0.0), width)
    ready = single.select(F.lit(0).cast("long").alias("query"), "id", "score", F.coalesce(F.col("embedding").cast("array<double>"), zeros).alias("embedding"))
    order = selection.mmr(ready)
    items = order.join(single.select("id", "score", "text"), "id").select("query", F.col("position").alias("pos"), "id", "score", F.col("text").alias("content"))
    brief = selection.char_budget(items.select("query", "pos", "content"), "query")
    return items.drop("content").join(brief, ["query", "pos"]).select("id", F.col("pos").alias("position"), "score", "content")


CHANNELS = ["entities", "anchor", "valence"]


def fuse(legs: list[DataFrame], k: int = C.RRF_K, top: int = C.FUSED_TOP) -> DataFrame:
    """(query, id, rrf): reciprocal rank fusion of legs ``query, id, score`` of at most ``top`` rows a query each, ranks from 0."""
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "id")
    parts = [leg.select("query", "id", (1 / (k + F.row_number().over(w) - 1)).alias("part")) for leg in legs]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    fused = both.groupBy("query", "id").agg(F.sum("part").alias("rrf"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("rrf", 12)), "id"))
    return fused.withColumn("rank", best).where(F.col("rank") <= top).drop("rank")


def rescored(fused: DataFrame, queries: DataFrame, facts: DataFrame, backfills: DataFrame, weights: DataFrame, gates: DataFrame, excluded: list[str]) -> DataFrame:
    """(query, id, seed, hash, score) of the candidates that pass the gates; no text goes along.

    ``queries``: query, seed, embedding, entities, anchor, valence. ``facts``: id, hash (of the content), kind, age_days, consent, salience, embedding and the
    channels entities, anchor, valence, which the latest row of ``backfills`` replaces one by one. ``weights`` is one row with a weight
    for each of RECALL_WEIGHTS; ``gates`` has (id, gate). A candidate that names an excluded entity is masked, so are blocked ones.
    """
    asked = queries.select("query", "seed", F.col("embedding").alias("q_embedding"), *[F.col(c).alias(f"q_{c}") for c in CHANNELS])
    known = facts.join(fused.select("id").distinct(), "id", "left_semi")
    known = policies.overlay(known, backfills, CHANNELS).join(gates.select("id", "gate"), "id", "left")
    rows = fused.join(known, "id").join(asked, "query").crossJoin(F.broadcast(weights.select(*[F.col(c).alias(f"w_{c}") for c in C.RECALL_WEIGHTS])))  # one row
    keys = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), match_key)
    names = F.array(*[F.lit(e) for e in excluded]).cast("array<string>")
    mask = F.when(F.arrays_overlap(keys("entities"), F.transform(names, match_key)), 0.0).otherwise(1.0)
    gate = mask * selection.consent_factor(F.col("consent")) * F.coalesce("gate", F.lit(1.0))
    parts = {
        "entity": jaccard(F.array_distinct(keys("entities")), F.array_distinct(keys("q_entities"))),
        "time": anchor_step(F.datediff("anchor", "q_anchor")), "decay": decay(F.col("age_days"), F.col("kind")), "valence": valence_match(F.col("valence"), F.col("q_valence")),
    }
    added = sum((F.col(f"w_{c}") * F.coalesce(parts[c], F.lit(0.0)) for c in C.RECALL_WEIGHTS), F.lit(0.0))
    similarity = F.when(F.col("embedding").isNotNull() & F.col("q_embedding").isNotNull(), dot(F.col("embedding"), F.col("q_embedding")))
    whole = (F.coalesce(similarity, F.lit(0.0)) * gate + added) * F.coalesce(F.sqrt("salience"), F.lit(1.0))
    # What is masked goes, and so does what has neither a vector nor enough besides.
    kept = rows.where((gate > 0) & ~(similarity.isNull() & (added < C.RECALL_FLOOR)))
    return kept.select("query", "id", "seed", "hash", whole.alias("score"))


def ranked(scored: DataFrame, recent: DataFrame, inputs: int = C.MMR_INPUT, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query, id, place, score, propensity, flag): each query's best ``inputs``, copies and surfaced ids seen to.

    ``scored`` has query, id, seed, score and the content's ``hash``, or its ``text``. Of equal contents the best stays. Ids of ``recent`` (query, id)
    weigh a quarter. ``rerank`` may replace the scores of the candidates (query, id, score and, if given, text); without it they keep
    their order. ``flag`` tells how crowded a query's scores are at the top. ``text`` and ``embedding``, if given, come back with the best only.
    """
    along = [c for c in ("text", "embedding") if c in scored.columns]
    bare = scored.select("query", "id", "seed", "score", (F.col("hash") if "hash" in scored.columns else content_hash(F.col("text"))).alias("hash"))
    back = (lambda rows: rows.join(scored.select("query", "id", *along), ["query", "id"])) if along else (lambda rows: rows)
    one = Window.partitionBy("query", "hash").orderBy(F.desc(F.round("score", 12)), "id")
    single = bare.withColumn("copy", F.row_number().over(one)).where("copy = 1").drop("copy", "hash")
    again = recent.select("query", "id").distinct().withColumn("again", F.lit(True))
    damped = single.join(again, ["query", "id"], "left").withColumn("score", F.col("score") * F.when(F.col("again"), C.RECENT_FACTOR).otherwise(1.0)).drop("again")
    of = Window.partitionBy("query")
    best = Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "id")
    rows = damped.withColumns({"place": F.row_number().over(best) - 1, "top": F.max("score").over(of), "n": F.count("*").over(of)})
    rows = rows.withColumn("near", F.count_if(F.col("score") >= (1 - C.DENSE_SHARE) * F.col("top")).over(of)).where(F.col("place") < inputs)
    if rerank:
        asked = back(rows)
        new = rerank(asked.select("query", "id", *[c for c in along if c == "text"], "score")).select("query", "id", F.col("score").alias("new"))
        rows = rows.join(new, ["query", "id"], "left").withColumn("score", F.coalesce("new", "score")).drop("new")
        rows = rows.withColumn("place", F.row_number().over(best) - 1)
    flag = F.when(F.col("near") >= C.DENSE_COUNT, "crowded").when(F.col("n") < C.SPARSE_COUNT, "sparse").otherwise("normal")
    told = selection.propensities(rows.withColumn("flag", flag), "query", "score", "place", "seed")
    return back(told.select("query", "id", "place", "score", "propensity", "flag")).select("query", "id", "place", "score", "propensity", "flag", *along)


def briefs(best: DataFrame, width: int) -> DataFrame:
    """(query, position, id, score, content) of ``ranked``: the diverse order, cut to the brief's size; a missing vector counts as zeros of ``width``."""
    zeros = F.array_repeat(F.lit(0.0), width)
    ready = best.select("query", "id", "score", F.coalesce(F.col("embedding").cast("array<double>"), zeros).alias("embedding"))
    items = selection.mmr(ready).join(best.select("query", "id", "score", "text"), ["query", "id"]).select("query", F.col("position").alias("pos"), "id", "score", F.col("text").alias("content"))
    cut_down = selection.char_budget(items.select("query", "pos", "content"), "query")
    return items.drop("content").join(cut_down, ["query", "pos"]).select("query", F.col("pos").alias("position"), "id", "score", "content")
