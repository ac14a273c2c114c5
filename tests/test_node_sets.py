"""Descendants and reached roots over sets of nodes, against plain loops, and what they shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from memloom import config as C
from memloom.operators import graph


def _graph(seed, shape):
    r = random.Random(seed)
    node = {"near": lambda k: k, "far": lambda k: k * 10_000_019 - 7_000_000_000, "text": lambda k: f"n{k}"}[shape]
    made = {(node(r.randrange(60)), node(r.randrange(60))) for _ in range(90)}
    # Twins, a loop and a pair that derive from each other.
    made |= {(node(c), node(p)) for p in (70, 71, 72, 10) for c in (10, 11, 12)} | {(node(5), node(5)), (node(80), node(81)), (node(81), node(80))}
    return sorted(made)


def _descendants(edges):
    children = {}
    for c, p in edges:
        children.setdefault(p, set()).add(c)
    found = {p: (own | {x for c in own for x in children.get(c, ())}) - {p} for p, own in children.items()}
    return sorted((p, len(x)) for p, x in found.items() if x)


def _reached(edges, stops, roots, hops):
    found = []
    for root in set(roots):
        depth, front = {root: 0}, {root}
        for d in range(1, hops + 1):
            fresh = {p for c, p in edges if c in front} - set(depth)
            depth |= {n: d for n in fresh}
            front = fresh - stops
        found += [(n, root, d) for n, d in depth.items() if d]
    return sorted(found)


@pytest.mark.parametrize("shape", ["near", "far", "text"])
@pytest.mark.parametrize("small", [False, True])
def test_walks_over_twins(spark, monkeypatch, shape, small):
    if small:  # narrow blocks, few links a group
        monkeypatch.setattr(C, "SET_BITS", 1 << 12)
        monkeypatch.setattr(C, "SET_LINKS", 7)
    kind = "string" if shape == "text" else "long"
    edges = _graph(3 + small, shape)
    rows = spark.createDataFrame([*edges, *edges[:9], (None, edges[0][1])], f"child {kind}, parent {kind}").repartition(3)
    got = graph.corroboration(rows).collect()
    assert sorted((r.id, r.n) for r in got) == _descendants(edges)
    assert all(r.boost == min(1.3, 1 + 0.05 * r.n) for r in got)
    nodes = sorted({n for e in edges for n in e})
    stops, roots = set(nodes[::3]), [*nodes[::2], nodes[0]]
    kinds = spark.createDataFrame([(n, "fact" if n in stops else "reconstructed") for n in nodes[:-4]], f"id {kind}, kind string")
    up = graph.propagate_up(rows, kinds, spark.createDataFrame([(n,) for n in roots], f"id {kind}"))
    assert sorted((r.id, r.root, r.depth) for r in up.collect()) == _reached(edges, stops & set(nodes[:-4]), roots, C.EXCISE_HOPS)
    assert up.dtypes == [("id", rows.dtypes[1][1]), ("root", rows.dtypes[1][1]), ("depth", "int"), ("weight", "double")]


def _shuffled(spark, run) -> int:
    """Rows that a job's stages wrote to a shuffle."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty(60_000)
        store = sc.statusStore()
        stages = store.stageList(None, *[getattr(store, f"stageList$default${k}")() for k in range(2, 6)])
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = total()
    run()
    return sum(n for k, n in total().items() if k not in before)


def test_pairs_of_a_walk_are_not_shuffled(spark):
    """1000 tops over 20 middles over 1000 ends: a million pairs, 40,000 edges."""
    n, k = 1000, 20
    rows = spark.range(n * k).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("m"))
    edges = rows.select((10_000 + F.col("m")).alias("child"), F.col("x").alias("parent")).union(rows.select(20_000 + F.col("x"), 10_000 + F.col("m")))
    got = []
    assert _shuffled(spark, lambda: got.extend(graph.corroboration(edges).collect())) < n * n / 2
    assert sorted((r.id, r.n) for r in got) == [(i, n + k) for i in range(n)] + [(10_000 + i, n) for i in range(k)]
    kinds, roots = spark.createDataFrame([], "id long, kind string"), spark.range(20_000, 20_000 + n)
    counts = []
    assert _shuffled(spark, lambda: counts.extend(graph.propagate_up(edges, kinds, roots).groupBy("depth").agg(F.count("*")).collect())) < n * n / 2
    assert sorted(tuple(r) for r in counts) == [(1, n * k), (2, n * n)]


def test_answers_of_many_questions_are_not_shuffled_by_text(spark, monkeypatch, tmp_path):
    """Every text has every question's word: 2,000 by 200 scores, of which three a question and group go on."""
    from memloom.operators import postings

    monkeypatch.setattr(C, "HITS_TASK", 400)
    words = [f"w{i}" for i in range(5)]
    texts = [(i, " ".join(w for k, w in enumerate(words) for _ in range(1 + (i * (k + 3)) % 7))) for i in range(2000)] + [(5000, None), (5001, "")]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(3)
    asked = spark.createDataFrame([(q, [words[q % 5], words[(q + 1) % 5], words[q % 5], None]) for q in range(200)] + [(900, ["none"]), (901, [])], "query long, terms array<string>")
    got = []
    assert _shuffled(spark, lambda: got.extend(postings.search_texts(docs, asked, 3).collect())) < 2000 * 200 / 2
    made = sorted((r["query"], r["id"], round(r["score"], 9)) for r in got)
    path = str(tmp_path / "index")
    postings.append(docs, path, 0)
    assert made == sorted((r["query"], r["id"], round(r["score"], 9)) for r in postings.search_many(spark, path, asked, 3).collect())
    assert len(made) == 600 and {q for q, _, _ in made} == set(range(200))
    for q in (0, 3, 7):
        plain = postings.search(spark, path, [words[q % 5], words[(q + 1) % 5]], 2000).collect()
        plain.sort(key=lambda r: (-round(r["score"], 12), r["id"]))
        assert [(q, r["id"], round(r["score"], 9)) for r in plain[:3]] == sorted((x for x in made if x[0] == q), key=lambda x: (-x[2], x[1]))


@pytest.mark.parametrize("batch", [3, 10_000])
def test_grid_deals_rows_once(spark, batch):
    """The grid's means by a plain loop, events cut by batches among them, and rows shuffled once by event, not once a point."""
    from math import log2

    from memloom.operators import evaluation

    r = random.Random(4)
    rows = [(r.choice([None, 1, 2, 3, 4, 50]) if i % 2 else 60 + i % 9, r.randrange(12), r.randrange(5) / 100, r.randrange(7), r.randrange(5), r.choice([True, False, False, None])) for i in range(400)]
    rows += [(99, i, 0.01, 1, 1, False) for i in range(20)]
    got = []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "event long, id long, base double, eng long, damp long, relevant boolean").repartition(2)
        assert _shuffled(spark, lambda: got.extend(evaluation.grid(df, 3).collect())) < 5 * len(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for e in C.GRID_ENGAGEMENT:
        for d in C.GRID_DAMPING:
            each = []
            for event in {x[0] for x in rows}:
                own = sorted((x for x in rows if x[0] == event), key=lambda x: (-round((x[2] + e * x[3] + d * x[4]) * 1e6), x[1], -1 if x[5] is None else x[5]))
                n = sum(bool(x[5]) for x in own)
                if n:
                    each.append(sum(bool(x[5]) / log2(i + 2) for i, x in enumerate(own[:3])) / sum(1 / log2(i + 2) for i in range(min(3, n))))
            want[e, d] = sum(each) / len(each)
    assert {(x["engagement"], x["damping"]): pytest.approx(x["ndcg"]) for x in got} == want


def test_only_runs_that_may_be_names_are_dealt(spark):
    """60 texts of 300 words and a lexicon of six names: a row for each found name goes to the join, not one for each run of a text."""
    from memloom.operators import gazetteer

    r = random.Random(9)
    texts = [(i, " ".join(r.choice(["Ab", "coß", "d-e", "İx", "f_1"]) + str(r.randrange(90)) for _ in range(300))) for i in range(60)] + [(90, None), (91, ""), (92, "  \U0001f600ab7\tNew  York, new york")]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(3)
    names = ["ab7", "ab7 ", "New York", "d-e5", "coß8 ab3", "none such", "\U0001f600"]
    lexicon = gazetteer.compile_lexicon(spark.createDataFrame([(n + "", "topic", k) for k, n in enumerate(names)], "surface string, kind string, seq long"), "t")
    kept = [x["lowered"] for x in lexicon.collect()]
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    got = []
    try:
        assert _shuffled(spark, lambda: got.extend(gazetteer.find(docs, lexicon).collect())) < 2_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    want = []
    low = {x["id"]: x["low"] for x in docs.select("id", F.lower("text").alias("low")).collect()}
    word = set("abcdefghijklmnopqrstuvwxyz0123456789_")
    for i, text in low.items():
        for name in kept:
            for at in range(len(text or "")):
                end = at + len(name)
                if text[at:end] == name and not (name[0] in word and at and text[at - 1] in word) and not (name[-1] in word and end < len(text) and text[end] in word):
                    want.append((i, name, at, end))
                    break
    assert sorted((x["id"], x["surface"].lower(), x["start"], x["end"]) for x in got) == sorted(want) and len(want) > 60
