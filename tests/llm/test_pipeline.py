"""The corpus pipeline, stage by stage, against plain Python."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from memloom.llm import quality, tokenizing
from memloom.llm.common import table
from test_llm import ODD, SCHEMA, SF, brute_contamination, brute_links


def ids(df):
    return sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())


def test_stages_equal_brute_force(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "packing"]

    kept = stages["quality"](spark, docs, SF).cache()
    assert kept.columns == docs.columns
    assert ids(kept) == ids(quality.score_quality(docs, labels).where("keep"))

    rows = [(r["doc_id"], r["text"] or "") for r in kept.collect()]
    first = stages["near_duplicates"](spark, kept, SF).cache()
    assert first.columns == docs.columns
    assert ids(first) == sorted(str(i) for i, _, c in brute_links(rows, 5, 80, 100) if i == c)

    rows = [(r["doc_id"], r["text"]) for r in first.collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    clean = stages["decontamination"](spark, first, SF).cache()
    assert clean.columns == docs.columns
    assert ids(clean) == sorted(str(r[0]) for r in brute_contamination(rows, items) if not r[-1])

    tok, _ = tokenizing._load("word_bpe_49k.json")
    told = []
    for r in clean.collect():
        made = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        told += [(r["doc_id"], k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(np.split(made, range(4096, len(made), 4096)))]
    packed = stages["packing"](spark, clean, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed) == sorted(told)
    run = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in run) == sorted(told)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, name):
    odd, none = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], SCHEMA)
    stage = dict(corpus_pipeline.STAGES)[name]
    made = stage(spark, odd, SF)
    if name != "packing":
        assert made.columns == odd.columns
        texts = {(r[0], r[1]) for r in ODD}
        assert {(r["doc_id"], r["text"]) for r in made.collect()} <= texts
    else:
        assert len({r["doc_id"] for r in made.collect()}) == len({r[0] for r in ODD})
    assert stage(spark, none, SF).count() == 0


