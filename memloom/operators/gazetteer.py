"""Known names found in texts: a join of the texts' token runs with a lexicon of any size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom import config as C
from memloom.functions.extract import slug
from memloom.session import ship_package, written

#: A word, a white space run, or one other character: a name begins and ends where such a piece does.
PIECE = r"[a-z0-9_]+|\s+|[^a-z0-9_\s]"


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({PIECE})"), F.lit(1))


def compile_lexicon(seed: DataFrame, source: str) -> DataFrame:
    """(canonical_id, kind, surface, lowered, size) of ``surface, kind, seq``: the first of each canonical id by seq, then surface.

    Left out are surfaces of under ``NAME_LEAST`` code points, those whose slug is empty, and unknown kinds.
    """
    bare = F.trim(F.regexp_replace("surface", r"^\s+|\s+$", ""))
    rows = seed.select(bare.alias("surface"), "kind", "seq").where(F.col("kind").isin(*C.ENTITY_KINDS) & (F.length("surface") >= C.NAME_LEAST))
    named = rows.withColumn("slug", slug(F.col("surface"))).where("slug <> ''")
    named = named.withColumn("canonical_id", F.concat_ws(":", "kind", F.lit(source), "slug"))
    first = F.row_number().over(Window.partitionBy("canonical_id").orderBy("seq", "surface"))
    kept = named.withColumn("n", first).where("n = 1")
    return kept.select("canonical_id", "kind", "surface", F.lower("surface").alias("lowered"), F.size(pieces(F.col("surface"))).alias("size"))


def find(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, canonical_id, kind, surface, start, end) of ``id, text``: each name once a text, with the code points of its first whole-word occurrence.

    Case doesn't count; names that overlap or nest are all found, as each is looked for by itself. Runs of as
    many pieces as some name has are looked up by hash in a bit table of the lexicon, of bounded size, and those that it may have are
    joined with the lexicon; Spark broadcasts the lexicon if it is small and deals both by the name if it isn't. Ids are unique.
    """
    lexicon = written(lexicon, "lexicon")
    sizes = sorted(r[0] for r in lexicon.select("size").distinct().limit(C.NAME_PIECES + 1).collect())
    if len(sizes) > C.NAME_PIECES:
        raise ValueError(f"names of more than {C.NAME_PIECES} different lengths")
    if not sizes:
        return docs.select("id").limit(0).select("id", *(F.lit(None).cast(k).alias(c) for c, k in _FOUND))
    spark = ship_package(docs.sparkSession)
    table, bits = _bit_table(lexicon)
    shared = spark.sparkContext.broadcast(table)
    p = F.col("pieces")
    told = docs.select("id", pieces(F.col("text")).alias("pieces")).select("id", "pieces", _hashes(p).alias("hashes"))
    kind = dict(docs.dtypes)["id"]
    placed = told.mapInArrow(_candidates(shared, bits, sizes), f"id {kind}, pieces array<string>, at array<struct<i: int, n: int, start: int>>")
    each = placed.select("id", "pieces", F.explode("at").alias("at"))
    runs = each.select("id", F.array_join(F.slice(p, F.col("at.i") + 1, F.col("at.n")), "").alias("lowered"), F.col("at.start").alias("start"))
    return runs.join(lexicon.drop("size"), "lowered").select("id", "canonical_id", "kind", "surface", "start", (F.col("start") + F.length("lowered")).alias("end"))


def _hashes(p: Column) -> Column:
    return F.transform(p, lambda x: F.xxhash64(x))


def _bit_table(lexicon: DataFrame) -> tuple[np.ndarray, int]:
    """Whether some name has a hash, by the hash's first bits: NAME_BITS a name, about, in a table of at most 2 ** NAME_TABLE bits."""
    bits = min(C.NAME_TABLE, max(10, (C.NAME_BITS * lexicon.count()).bit_length()))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            _, size, h = _flat(batch.column("hashes"))
            yield pa.record_batch([pa.array((_run_hashes(h, size, np.cumsum(size) - size) >> np.uint64(64 - bits)).astype(np.int64))], ["place"])

    places = lexicon.select(_hashes(pieces(F.col("lowered"))).alias("hashes")).mapInArrow(run, "place long")
    word, bit = F.shiftright("place", 6), F.col("place").bitwiseAND(63).cast("int")
    made = places.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).toArrow()
    table = np.zeros(1 << bits - 6, np.uint64)
    table[made["word"].to_numpy()] = made["bits"].to_numpy().view(np.uint64)
    return table, bits


def _flat(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A list column's rows by their values' rows, its sizes, and its values."""
    import pyarrow.compute as pc

    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(size)), size), size, values.view(np.uint64) if values.dtype == np.int64 else values


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _run_hashes(h: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of each run of ``size`` pieces from ``at``, of which one size is given to all or one to each."""
    made = np.zeros(len(at), np.uint64)
    for k in range(int(np.max(size, initial=0))):
        more = np.flatnonzero(np.broadcast_to(size, at.shape) > k)
        made[more] = made[more] * _STEP + h[at[more] + k]
    made = (made ^ (made >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return made ^ (made >> np.uint64(29))


def _candidates(shared, bits: int, sizes: list[int]):
    def run(batches):
        """A text's runs that the table has, the first of equals each; none begins with white space."""
        import pyarrow as pa
        import pyarrow.compute as pc

        table = shared.value
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            row, size, h = _flat(batch.column("hashes"))
            text = batch.column("pieces").flatten()
            length = pc.utf8_length(text).to_numpy(zero_copy_only=False)
            space = pc.is_in(pc.utf8_slice_codeunits(text, 0, 1), pa.array(list(" \t\n\x0b\f\r"), text.type)).to_numpy(zero_copy_only=False)
            end, start = np.cumsum(size)[row], np.cumsum(length) - length
            first = np.cumsum(size) - size
            start = start - start[first[row]]
            place = np.arange(len(row))
            found = []
            for n in sizes:
                at = place[~space & (place + n <= end)]
                name = _run_hashes(h, np.int64(n), at)
                bit = name >> np.uint64(64 - bits)
                known = (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
                at, name = at[known], name[known]
                order = np.lexsort((at, name, row[at]))
                at, name = at[order], name[order]
                new = np.ones(len(at), bool)
                new[1:] = (name[1:] != name[:-1]) | (row[at][1:] != row[at][:-1])
                found.append((at[new], np.full(new.sum(), n)))
            at, n = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(row[at], kind="stable")
            at, n = at[order], n[order]
            i = at - first[row[at]]
            made = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (i, n, start[at])], ["i", "n", "start"])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=batch.num_rows))])
            yield pa.record_batch([batch.column("id"), batch.column("pieces"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), made)], ["id", "pieces", "at"])

    return run


_FOUND = (("canonical_id", "string"), ("kind", "string"), ("surface", "string"), ("start", "int"), ("end", "int"))
