"""The inverted index and the index of cells against scans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom import config as C
from memloom.operators import ann, postings, retrieval
from memloom.session import shared_path

SF = "/root/testdata/sf0.001"


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text")


def test_term_counts_and_odd_texts(spark):
    rows = spark.createDataFrame([(1, "Bird bird, cat"), (2, None), (3, ""), (4, "the the"), (5, "cat"), (5, "cat")], "id long, text string")
    assert sorted(map(tuple, postings.term_counts(rows).collect())) == [("bird", 1, 2, 3), ("cat", 1, 1, 3), ("cat", 5, 1, 1), ("cat", 5, 1, 1)]


def test_search_equals_a_scan_and_batches_merge(spark):
    path, rows = shared_path(spark, "t"), docs(spark)
    words = [r["term"] for r in postings.term_counts(rows).groupBy("term").count().orderBy(F.desc("count"), "term").limit(400).collect()]
    for batch, part in enumerate((rows.where("id % 3 = 0"), rows.where("id % 3 = 1"), rows.where("id % 3 = 2"))):
        postings.append(part, path, batch)
    postings.append(rows, path, 2)  # stored already
    for query in ([words[0]], [words[3], words[50], words[399]], [words[5], words[5], "absent"]):
        want = retrieval.bm25_topk(rows, query).collect()
        made = postings.search(spark, path, query).collect()
        assert [r["id"] for r in made] == [r["id"] for r in want]
        assert np.allclose([r["score"] for r in made], [r["score"] for r in want])
    assert postings.search(spark, path, []).collect() == [] and postings.search(spark, path, ["absent"]).collect() == []
    n, mean = postings.statistics(spark, path)
    assert n == rows.count() and math.isclose(mean, retrieval.lengths(rows).agg(F.avg(F.size("words"))).first()[0])


def test_a_broken_append_does_not_count(spark):
    """Postings without their row of statistics are those of a run that broke off; the next run replaces them."""
    path = shared_path(spark, "t")
    first = spark.createDataFrame([(1, "bird cat"), (2, "cat")], "id long, text string")
    postings.append(first, path, 0)
    spark.createDataFrame([("bird", 9, 1, 1, 0)], "term string, id long, tf int, len int, bucket int").write.partitionBy("bucket").parquet(f"{path}/postings/batch=1")
    assert [r["id"] for r in postings.search(spark, path, ["bird"]).collect()] == [1]
    postings.append(spark.createDataFrame([(3, "bird bird")], "id long, text string"), path, 1)
    assert [r["id"] for r in postings.search(spark, path, ["bird"]).collect()] == [3, 1]
    postings.append(first.limit(0), path, 2)
    assert postings.statistics(spark, path) == (3, 5 / 3)


def test_search_reads_the_buckets_of_its_terms_alone(spark):
    path = shared_path(spark, "t")
    postings.append(docs(spark), path, 0)
    plan = postings.search(spark, path, ["thtion"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "text" not in plan


def test_coverage(spark):
    path = shared_path(spark, "t")
    postings.append(spark.createDataFrame([(k, "bird") for k in range(98)], "id long, text string"), path, 0)
    made = [postings.coverage(spark, path, spark.range(n)) for n in (98, 99, 100)]
    assert [m["active"] for m in made] == [True, False, False] or C.LEXICAL_COVERAGE != 0.99
    assert made[2] == {"indexed": 98, "eligible": 100, "active": False}


def scan(rows, queries, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    for q, v in queries:
        score = np.round(x @ np.array(v, float), ann.DIGITS)
        for i in np.lexsort((ids, -score))[:k]:
            yield q, int(ids[i]), float(score[i])


def flat(df):
    return sorted((r["query"], r["id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("clustered", [True, False])
def test_exact_search_equals_a_scan(spark, clustered, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 100)
    monkeypatch.setattr(C, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(20, 12)) * 3
    rows = [(k, (middle[k % 20] * clustered + rng.normal(size=12)).tolist()) for k in range(1500)]
    rows += [(k, rows[7][1]) for k in range(1500, 1800)]  # one vector many times
    path = shared_path(spark, "t")
    odd = [(5000, None), (5001, [1.0]), (5002, [float("nan")] * 12), (None, [1.0] * 12)]
    ann.build(spark.createDataFrame(rows + odd, "id long, embedding array<double>"), path, cell_rows=50)
    queries = [r for r in rows if r[0] % 50 == 0]
    asked = spark.createDataFrame(queries + [(9001, None), (9002, [1.0])], "query long, embedding array<double>")
    want = sorted((q, i, round(s, 9)) for q, i, s in scan(rows, queries, 10))
    assert flat(ann.search(asked, path, 10)) == want
    near = {x[:2] for x in flat(ann.search(asked, path, 10, exact=False))}
    assert len(near & {x[:2] for x in want}) >= (0.9 if clustered else 0.3) * len(want)
    assert spark.read.parquet(f"{path}/vectors").count() == len(rows)


def test_recall_of_the_probes_on_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    path = shared_path(spark, "t")
    ann.build(spark.createDataFrame(rows, "id long, embedding array<double>"), path)
    queries = [r for r in rows if r[0] % 50 == 0]
    near = ann.search(spark.createDataFrame(queries, "query long, embedding array<double>"), path, 10, exact=False)
    want = {x[:2] for x in scan(rows, queries, 10)}
    recall = len({(r["query"], r["id"]) for r in near.collect()} & want) / len(want)
    print("recall", recall)
    assert recall >= 0.9


def test_few_and_no_vectors(spark):
    path = shared_path(spark, "t")
    ann.build(spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>"), path)
    asked = spark.createDataFrame([(4, [2.0, 1.0])], "query long, embedding array<double>")
    assert flat(ann.search(asked, path, 10)) == [(4, 1, 2.0)]
    ann.build(spark.createDataFrame([], "id long, embedding array<double>"), path)
    assert ann.search(asked, path, 10).collect() == []
