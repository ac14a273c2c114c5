"""Memories as their users see them: one event with its provenance, labels joined to the recalls they judge, aliases of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom import config as C


def shown_features(features: T.StructType, name: str = "features") -> list:
    """The fields of a features struct but for arrays of numbers, which are vectors if they are longer than VECTOR_LEAST."""
    out = []
    for f in features:
        c = F.col(name).getField(f.name)
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            c = F.when(F.size(c) <= C.VECTOR_LEAST, c)
        out.append(c.alias(f.name))
    return out


def get(ledger: DataFrame, ids: DataFrame, edges: DataFrame) -> DataFrame:
    """The events of ``ids`` with provenance, references, what they derive from and into; an id that the ledger lacks gives no row.

    ``ledger``: id, kind, content, source, ts, created_at, confidence, source_refs (array of ref, via), derived_from, features. Missing
    sources are the ledger's own, missing ways are ``original``. ``derived_into`` are the reconstructed children by id, from ``edges`` (child, parent).
    """
    asked = ledger.join(ids.select("id").distinct(), "id", "left_semi")
    kinds = ledger.where("kind = 'reconstructed'").select(F.col("id").alias("child"))
    near = edges.join(asked.select(F.col("id").alias("parent")), "parent", "left_semi").join(kinds, "child", "left_semi")
    into = near.groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_set("child")).alias("derived_into"))
    refs = F.transform(F.coalesce("source_refs", F.array().cast(ledger.schema["source_refs"].dataType)), lambda r: F.struct(r["ref"].alias("ref"), F.coalesce(r["via"], F.lit("original")).alias("via")))
    none = F.array().cast(T.ArrayType(ledger.schema["id"].dataType))
    return asked.join(into, "id", "left").select(
        "id", "kind", F.coalesce("content", F.lit("")).alias("content"),
        F.struct(F.coalesce("source", F.lit("memory_ledger")).alias("source"), F.coalesce("ts", "created_at").alias("ts"), "confidence").alias("provenance"), refs.alias("source_refs"),
        F.coalesce("derived_from", none).alias("derived_from"), F.coalesce("derived_into", none).alias("derived_into"), F.struct(*shown_features(ledger.schema["features"].dataType)).alias("features"), F.coalesce("created_at", "ts").alias("created_at"),
    )


def label_recalls(labels: DataFrame, recalls: DataFrame) -> DataFrame:
    """Labels ``id, derived_from, ...`` with the recall ``id, ...`` that the first of ``derived_from`` names, as ``recall``; others have none and go."""
    told = recalls.select(F.col("id").alias("_recall"), F.struct("*").alias("recall"))
    return labels.withColumn("_recall", F.get("derived_from", F.lit(0))).join(told, "_recall").drop("_recall")


def alias_entities(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """``id, entities`` with each entity replaced by the canonical one of ``alias, canonical``, one step, each once in order of the first.

    Of several rows for an alias the least canonical counts. Entities without an alias stay; a null list stays null.
    """
    one = aliases.groupBy("alias").agg(F.min("canonical").alias("canonical"))
    each = rows.select("id", F.posexplode("entities").alias("at", "entity"))
    made = each.join(one, F.col("entity") == F.col("alias"), "left").select("id", "at", F.coalesce("canonical", "entity").alias("entity"))
    first = made.groupBy("id", "entity").agg(F.min("at").alias("at"))
    lists = first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "entity"))).alias("x")).select("id", F.transform("x", lambda v: v["entity"]).alias("entities"))
    return rows.drop("entities").join(lists, "id", "left").join(rows.select("id", F.col("entities").alias("_had")), "id").withColumn("entities", F.coalesce("entities", F.when(F.col("_had").isNotNull(), F.array().cast("array<string>")))).drop("_had")
