"""Contradictions between a new reconstruction and what its parents and siblings say, and how to resolve them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom import config as C
from memloom.functions import vector


def overlap(new: Column, other: Column) -> Column:
    """Share of the new row's distinct entities that the other row has; 0 without any."""
    own = F.array_distinct(new)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(own, other)), F.greatest(F.size(own), F.lit(0))), F.lit(0.0))


def opposed(a: str, b: str) -> Column:
    """(test, score) of two rows ``entities, sign, magnitude, embedding`` by name prefix; null if they agree.

    Unlike signs with a strength of 0.4 or more count where entities overlap; a cosine below -0.05 counts by itself.
    """
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    strength = F.greatest(F.abs(x("magnitude")), F.abs(y("magnitude")))
    signs = (x("sign") != y("sign")) & (strength >= C.OPPOSED_VALENCE) & (overlap(x("entities"), y("entities")) >= C.OPPOSED_OVERLAP)
    cosine = vector.cosine(x("embedding"), y("embedding"))
    told = lambda name, score: F.struct(F.lit(name).alias("test"), score.cast("double").alias("score"))
    return F.when(signs, told("valence", strength)).when(cosine < C.OPPOSED_COSINE, told("cosine", cosine))


def candidates(new: DataFrame, edges: DataFrame, most: int = C.SIBLINGS_MAX) -> DataFrame:
    """(id, other, relation): the parents of each new id, and of its parents' other children the first by id.

    At most ``most`` siblings are looked at for a new row, as a walk over its parents in order would. No
    parent can give more than that, so children beyond the bound go before the join, on the map side.
    """
    own = edges.join(new.select(F.col("id").alias("child")).distinct(), "child", "left_semi")
    parents = own.select(F.col("child").alias("id"), F.col("parent").alias("other"), F.lit("parent").alias("relation"))
    # One more than the bound, since the new row itself may be among them.
    place = F.row_number().over(Window.partitionBy("parent").orderBy("other"))
    few = edges.select("parent", F.col("child").alias("other")).distinct().withColumn("k", place).where(F.col("k") <= most + 1)
    met = own.select(F.col("child").alias("id"), "parent").distinct().join(few, "parent").where("id <> other")
    first = met.groupBy("id", "other").agg(F.min(F.struct("parent", "k")).alias("at"))
    turn = F.row_number().over(Window.partitionBy("id").orderBy("at", "other"))
    siblings = first.withColumn("turn", turn).where(F.col("turn") <= most).select("id", "other", F.lit("sibling").alias("relation"))
    return parents.distinct().unionByName(siblings)


def contradictions(new: DataFrame, rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, other, relation, test, score) over ``new`` and ``rows``: id, thread, kind, entities, sign, magnitude, embedding.

    Siblings are reconstructed rows of another thread; one of the same thread refines and doesn't contradict
    (test ``refines``, score null). Null signs, vectors and entities oppose nothing; unknown ids are passed over.
    """
    pairs = candidates(new, edges)
    a = new.select("id", F.struct(*new.columns).alias("a"))
    b = rows.select(F.col("id").alias("other"), F.struct(*rows.columns).alias("b"))
    met = pairs.join(a, "id").join(b, "other").where((F.col("relation") == "parent") | (F.col("b.kind") == "reconstructed"))
    same = (F.col("relation") == "sibling") & (F.col("a.thread") == F.col("b.thread"))
    refines = F.struct(F.lit("refines").alias("test"), F.lit(None).cast("double").alias("score"))
    found = met.withColumn("hit", F.when(same, refines).otherwise(opposed("a", "b"))).where("hit is not null")
    return found.select("id", "other", "relation", "hit.test", "hit.score")


def forbidden(new: DataFrame, policies: DataFrame) -> DataFrame:
    """(id): new rows whose entities an active exclusion covers to 0.3 or more.

    ``policies``: id, kind, confidence, active, entities. Only shared entities meet; a policy's share is summed by key.
    """
    live = policies.where(F.col("kind").isin("exclude", "fact_excluded") & (F.col("confidence") >= C.AUTHORITY_LEAST) & F.coalesce("active", F.lit(True)))
    said = live.select(F.col("id").alias("policy"), F.explode(F.array_distinct("entities")).alias("entity"))
    own = new.select("id", F.size(F.array_distinct("entities")).alias("n"), F.explode(F.array_distinct("entities")).alias("entity"))
    shares = own.join(said, "entity").groupBy("id", "policy").agg((F.count("*") / F.first("n")).alias("share"))
    return shares.where(F.col("share") >= C.OPPOSED_OVERLAP).select("id").distinct()


def resolution(new: DataFrame, rows: DataFrame, found: DataFrame, barred: DataFrame) -> DataFrame:
    """(id, resolution, superseded) for each new id: exclude_rejected, substitute or co_exist.

    A row is substituted if it is the only candidate, reconstructed, of the same thread, scope and kind of agent, and
    the new confidence exceeds its by 0.2. Refinements are candidates where nothing contradicts.
    """
    real = F.col("test") != "refines"
    per = found.groupBy("id").agg(
        F.count_if(real).alias("n"), F.count("*").alias("all"), F.min(F.when(real, F.col("other"))).alias("one"), F.min("other").alias("refined"),
    )
    one = F.when(F.col("n") == 1, F.col("one")).when((F.col("n") == 0) & (F.col("all") == 1), F.col("refined"))
    facts = ["kind", "thread", "scope", "agent", "confidence"]
    old = rows.select(F.col("id").alias("superseded"), *[F.col(c).alias(f"old_{c}") for c in facts])
    got = new.select("id", *facts).join(per.select("id", one.alias("superseded")), "id", "left").join(old, "superseded", "left")
    got = got.join(barred.select("id", F.lit(True).alias("barred")).distinct(), "id", "left")
    agent = lambda c: F.split_part(F.col(c), F.lit(":"), F.lit(1))
    better = (F.col("old_kind") == "reconstructed") & (F.col("confidence") - F.col("old_confidence") >= C.SUBSTITUTE_GAIN)
    alike = (F.col("thread") == F.col("old_thread")) & (F.col("scope") == F.col("old_scope")) & (agent("agent") == agent("old_agent"))
    choice = F.when(F.col("barred"), "exclude_rejected").when(better & alike, "substitute").otherwise("co_exist")
    return got.select("id", choice.alias("resolution"), F.when(choice == "substitute", F.col("superseded")).alias("superseded"))
