"""Nested redaction and known names against plain Python."""

import random
import re

from memloom.functions import redaction
from memloom.operators import gazetteer
from pyspark.sql import functions as F

KEY = "AKIA" + "ABCDEFGHIJKLMNOP"


def test_every_depth_and_odd_names(spark):
    schema = "id long, handle string, `a.b` string, deep struct<x:array<struct<url:string,m:map<string,array<string>>>>,n:long,person_uid:string>, nothing string"
    rows = [
        (1, " tel:+49 30 1234567 ", KEY, ([("https://x.de/p?a=1&token=s#f", {"link": ["http://y/?q=1", "no url?q=1"], "k": [KEY, None]}), None], 5, " u1 "), None),
        (2, "+49 30 1234567", "x" + KEY, None, None),
        (3, "someone", "clean", ([], None, None), None),
    ]
    made = {r["id"]: r for r in redaction.redact_rows(spark.createDataFrame(rows, schema)).collect()}
    one = made[1]
    assert one["handle"] == " tel:+49 30 1234567 " and one["a.b"] == "[REDACTED:aws_access_key_id]"  # with tel: it hasn't the shape of a number
    first = one["deep"]["x"][0]
    assert first["url"] == "https://x.de/p?a=1#f" and first["m"] == {"link": ["http://y/", "no url?q=1"], "k": ["[REDACTED:aws_access_key_id]", None]}
    assert one["deep"]["x"][1] is None and one["deep"]["n"] == 5 and re.fullmatch("ab_[0-9a-f]{12}", one["deep"]["person_uid"])
    assert one["triggered_redactions"] == ["aws_access_key_id", "url_query_stripped:token", "url_query_stripped:q", "abperson_uid_hashed"]
    assert re.fullmatch("phone_[0-9a-f]{12}", made[2]["handle"]) and made[2]["a.b"] == "x" + KEY and made[2]["deep"] is None
    assert made[2]["triggered_redactions"] == ["e164_phone_hashed"] and made[3]["triggered_redactions"] == []
    assert tuple(made[3])[:3] == (3, "someone", "clean") and made[3]["deep"]["x"] == []


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame([(1, ["x"])], "id long, x array<string>")
    assert "Python" not in redaction.redact_rows(rows)._jdf.queryExecution().executedPlan().toString()


def test_urls(spark):
    urls = ["http://h/p?q=1", "http://h/p?a=1&q=1&b=2#t=?q=2", "http://h/p#x?q=1", "nourl?q=1", "http://h?%71=1&x", "mailto:a?code=1&code=2", None, "", "http://h/?Q=1"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    made = [r[0] for r in rows.select(redaction.strip_url(F.col("u"))).collect()]
    assert made == ["http://h/p", "http://h/p?a=1&b=2#t=?q=2", "http://h/p#x?q=1", "nourl?q=1", "http://h?x", "mailto:a", None, "", "http://h/?Q=1"]


def plain(text, names):
    low = (text or "").lower()
    for n in names:
        before = "(?<![a-z0-9_])" if re.match("[a-z0-9_]", n) else ""
        after = "(?![a-z0-9_])" if re.match("[a-z0-9_]", n[-1]) else ""
        if m := re.search(before + re.escape(n) + after, low):
            yield n, m.start(), m.end()


def test_names_nest_overlap_and_have_odd_edges(spark):
    names = ["new york", "new york times", "york", "times square", "c++", ".net", "北京大学", "e-mail", "a\\eb", "fw-3"]
    seed = spark.createDataFrame([(n.upper() if n != "fw-3" else " FW-3 ", ("org", "place", "topic")[k % 3], k) for k, n in enumerate(names)], "surface string, kind string, seq long")
    lexicon = gazetteer.compile_lexicon(seed, "doc")
    known = {r["lowered"] for r in lexicon.collect()}
    assert known == set(names) - {"北京大学"}  # its slug is empty
    rng = random.Random(1)
    words = ["New", "York", "Times", "Square", "c++", "C+", ".NET", "x.net", "newyork", "e-mail", "a\\Eb", "fw-3", "FW-31", "ünew", "new\nyork", ","]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(200)] + [None, "", "New  York", "the FW-3 deck"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    made = sorted((r["id"], r["surface"].lower(), r["start"], r["end"]) for r in gazetteer.find(docs, lexicon).collect())
    assert made == sorted((k, *x) for k, t in enumerate(texts) for x in plain(t, sorted(known)))


def test_large_lexicon_and_first_of_an_id(spark):
    seed = spark.range(100_000).select(F.concat(F.lit("Name "), F.col("id").cast("string")).alias("surface"), F.lit("person").alias("kind"), F.col("id").alias("seq"))
    more = spark.createDataFrame([("name-7", "person", -1), ("ab", "person", 0), ("xyz", "weather", 0), ("!!!", "person", 0), (None, "person", 0)], "surface string, kind string, seq long")
    lexicon = gazetteer.compile_lexicon(seed.union(more), "doc")
    assert lexicon.count() == 100_000 and lexicon.where("canonical_id = 'person:doc:name_7'").first()["surface"] == "name-7"
    docs = spark.createDataFrame([(1, "We met Name 99999, name 5 and NAME-7."), (2, "name")], "id long, text string")
    assert sorted(r["surface"] for r in gazetteer.find(docs, lexicon).collect()) == ["Name 5", "Name 99999", "name-7"]
    assert gazetteer.find(docs, lexicon.limit(0)).collect() == []
