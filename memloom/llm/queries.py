"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format, decontaminate, html_extract, lm_score, media, ngram_join, packing, quality, quality_rules, token_counts, turn_repair, url_filter,
    vector_codes,
)
from .common import fresh_path, table, written

URL_RULES = {
    "com/en/": "block",
    "example.com/en/7": "allow",
    "net/de/": "allow",
    "example.net/de/8": "block",
    "org/es/": "block",
}


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hostile = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(more.columns).unionByName(more)
    return chat_format.read_back(chat_format.format_conversations(turns))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), like=ngram_join.Likeness(size=4, num=85, den=100))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts into an empty cache, then answers from it: every digest is joined to its stored count."""
    docs, path = table(spark, sf_dir, "documents"), fresh_path(spark, "token-cache")
    token_counts.count_tokens(docs, path)
    return token_counts.count_tokens(docs, path)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images are written to the shared folder, and what is read back from there is told."""
    return media.read_media(written(media.store_media(table(spark, sf_dir, "documents")), "media"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damage(table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_lm_scoring,
        op3_quality_classifier,
        op4_html_extraction,
        op5_chat_formatting,
        op6_ngram_jaccard_join,
        op7_url_filters,
        op8_packing,
        op9_token_counts,
        op10_media_columns,
        op11_vector_codes,
        op12_quality_rules,
        op13_turn_repair,
        pipeline,
    )
}

#: A-Z to lower case and nothing else; words of the contract.
_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\\x{80}-\\x{10FFFF}]+')"""

OP1_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
starts AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM items WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM starts),
sizes AS (SELECT DISTINCT n FROM win),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
runs AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n),
hits AS (
  SELECT r.doc_id, r.i, r.n, win.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM runs) r
  JOIN win ON win.n = r.n AND win.s = r.s),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP6_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^ \\t\\n\\v\\f\\r]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY 1)
SELECT words.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(words.doc_id, coalesce(c, words.doc_id)) AS component_id
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

_ROUNDS = 4


def _op11_sql() -> str:
    """A CTE a round: squared distances of all parts and entries, the least by distance and index, floored means."""
    ctes = [
        """rows AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "spots AS (SELECT unnest(range(1, 5)) AS p)",
        "parts AS (SELECT vec_id, p, v[(p - 1) * len(v) // 4 + 1 : p * len(v) // 4] AS x FROM rows, spots)",
        "firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM rows QUALIFY e < 256)",
        "book0 AS (SELECT p, e, x AS c FROM parts JOIN firsts USING (vec_id))",
    ]
    for k in range(_ROUNDS + 1):
        ctes.append(f"""near{k} AS (SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT vec_id, p, e, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS d
  FROM parts JOIN book{k} USING (p)) GROUP BY vec_id, p)""")
        if k < _ROUNDS:
            ctes.append(f"""means{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (
  SELECT p, e, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS m
  FROM parts JOIN near{k} USING (vec_id, p), unnest(range(1, len(x) + 1)) AS spot(i) GROUP BY p, e, i) GROUP BY p, e),
book{k + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m USING (p, e))""")
    last = _ROUNDS
    return f"""WITH {", ".join(ctes)},
coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{last} GROUP BY vec_id)
SELECT coded.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) FROM book{last}) AS codebooks_sha256
FROM coded JOIN rows USING (vec_id)
"""


OP12_SQL = """
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\v\\f\\r]')) AS lines FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM starts),
twice AS (SELECT doc_id, s FROM windows GROUP BY ALL HAVING count(*) > 1),
sites AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM windows JOIN twice USING (doc_id, s)) GROUP BY 1),
most AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM words) GROUP BY ALL) GROUP BY 1),
base AS (
  SELECT doc_id, text, lines, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(sites.n, 0) AS n_repeat_words, coalesce(most.n, 0) AS common
  FROM words LEFT JOIN sites USING (doc_id) LEFT JOIN most USING (doc_id)),
told AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  2 * word_chars < 5 * n_words OR word_chars > 12 * n_words OR longest > 1000 OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * len(lines)
  OR 100 * len(list_filter(lines, lambda x: substring(ltrim(x), 1, 1) IN ('-', '*', '•', '‣', '◦', '·'))) > 90 * len(lines)
  OR 100 * len(list_filter(lines, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) > 50 * len(lines)
  OR 100 * (word_chars - length(regexp_replace(text, '[^\\p{L}\\p{M}]+', '', 'g'))) > 40 * word_chars
  OR 100 * length(regexp_replace(text, '[^\\p{Lu}]+', '', 'g')) > 50 * word_chars OR 100 * common > 30 * n_words AS rejected FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT (base_failed OR rejected) AS kept FROM told
"""

ORACLE_SQL = {"op6_ngram_jaccard_join": OP6_SQL, "op1_decontamination": OP1_SQL, "op11_vector_codes": _op11_sql(), "op12_quality_rules": OP12_SQL}
