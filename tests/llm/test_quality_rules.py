"""Quality rules against plain Python and the SQL."""

import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from memloom.llm import quality_rules as qr
from memloom.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, n_words string, kept string, row string, codes string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """n_words, the four measures and base_failed."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeat = {k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), n < 20 or 100 * len(repeat) > 30 * n


PROSE = " ".join(f"{w}{k % 7} wörd of it" for k, w in enumerate("alpha beta gamma delta eps zeta eta theta iota kappa".split() * 3))
TEXTS = [
    None, "", " \n\t ", "one two three", PROSE, PROSE + "\n" + PROSE, "a b c d e f g h " * 30, "x " * 500, "# " + PROSE.replace(" ", " # "), PROSE.upper(),
    "\n".join(f"- item {k} is here and there" for k in range(40)), "\n".join(f"so it goes {k} on ..." for k in range(40)), "1 22 333 " * 40, PROSE + " z" * 2000,
    "same line here\n" * 3 + PROSE, "　".join(PROSE.split()) + " é 𝒳𝒴 " * 9, "w" * 3000 + " " + PROSE, " ".join(f"t{k}" for k in range(30_000)), "a b c d e f g h i a b c d e f g h j " + PROSE,
]
ROWS = [(k, t, "x", "y", "z", "c") for k, t in enumerate(TEXTS)] + [(4, PROSE, "", "", "", ""), (None, PROSE, "", "", "", "")]


def test_measures_and_verdicts(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    made = {r["doc_id"]: r for r in qr.judge(docs).collect()}
    assert qr.judge(docs).count() == len(ROWS)
    for k, t in enumerate(TEXTS):
        assert tuple(made[k])[1:7] == plain(t), k
        assert not (made[k]["base_failed"] and made[k]["kept"])
    assert [k for k in range(len(TEXTS)) if made[k]["kept"]] == [4, 14, 18]
    assert made[None]["kept"]
    left = qr.drop_rejected(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["kept"]) for r in left.collect()) == [(False, 4, ""), (False, 4, "y"), (False, 14, "y"), (False, 18, "y"), (True, 0, "")]
    assert qr.judge(docs.limit(0)).collect() == [] and qr.drop_rejected(docs.limit(0)).collect() == []


def test_order_is_by_rejections_per_second_and_changes_no_verdict(spark):
    rule = lambda name: qr.Rule(name, F.lit(True))
    found = [qr.Estimate(rule("dear"), 5.0, 0.9), qr.Estimate(rule("cheap"), 0.1, 0.3), qr.Estimate(rule("never"), 0.01, 0.0), qr.Estimate(rule("never, dear"), 2.0, 0.0)]
    assert [r.name for r in qr.ordered(found)] == ["cheap", "dear", "never", "never, dear"]
    rows = qr.measured(spark.createDataFrame(ROWS, SCHEMA))
    every = qr.base_rules() + qr.rules()
    there, back = (rows.select("doc_id", "text", qr.verdict(c).isNull().alias("kept")).collect() for c in (every, every[::-1]))
    assert sorted(map(str, there)) == sorted(map(str, back))


def test_each_rule_rejects(spark):
    rows = qr.measured(spark.createDataFrame(ROWS, SCHEMA)).where("doc_id is not null")
    told = rows.select("doc_id", *(F.coalesce(r.rejects, F.lit(False)).alias(r.name) for r in qr.base_rules() + qr.rules())).collect()
    hit = {name: {r["doc_id"] for r in told if r[name]} for name in told[0].asDict() if name != "doc_id"}
    for name, doc in dict(few_words=3, repeated_words=6, symbols=8, shouting=9, bullets=10, ellipses=11, few_letters=12, one_word=13, longest_word=16, word_length=16).items():
        assert doc in hit[name], name
    assert all(4 not in docs for docs in hit.values())


def test_a_later_rule_is_not_evaluated(spark):
    """The second rule would raise if it were evaluated."""
    rows = qr.measured(spark.createDataFrame(ROWS, SCHEMA))
    cascade = [qr.Rule("all", F.col("n_words") >= 0), qr.Rule("never reached", F.raise_error(F.lit("evaluated")).cast("boolean"))]
    assert {r[0] for r in rows.select(qr.verdict(cascade)).collect()} == {"all"}


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op12_quality_rules"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    told = con.execute(ORACLE_SQL["op12_quality_rules"]).fetchall()
    made = [tuple(r) for r in QUERIES["op12_quality_rules"](spark, sf).collect()]
    assert sorted(made) == sorted(told)
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert all(r[1:7] == plain(texts[r[0]]) for r in made)
