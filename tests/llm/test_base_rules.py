"""Base columns of the quality rules against SQL, over a whole table and odd texts."""

from __future__ import annotations

import duckdb

from kairo.llm import rules

SF = "/root/testdata/sf0.001"
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM docs), w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
n AS (SELECT doc_id, text, words, list_transform(range(greatest(len(words) - 7, 0)), lambda i: array_to_string(words[i + 1 : i + 8], ' ')) AS wins FROM w),
u AS (SELECT doc_id, unnest(wins) AS win, unnest(range(len(wins))) AS i FROM n), c AS (SELECT doc_id, i FROM u QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM c, range(8) AS o(k) GROUP BY 1), l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t)
SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, len(words) < 20 OR 100 * coalesce(r.n, 0) > 30 * len(words) AS base_failed FROM n LEFT JOIN r USING (doc_id) JOIN l USING (doc_id)
"""


def test_base_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = [(-1, None), (-2, ""), (-3, " \t\n\x0b\x0c\r "), (-4, "a b c d e f g h " * 9), (-5, "é ü 一  x y"), (-6, "l\nl\n \nl \n\nL"), (-7, "#*$%&|<> ##"), (-8, "w " * 8), (-9, " ".join(str(i % 30) for i in range(300)))]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s") for i, t in odd], docs.schema))
    got = rules.apply_rules(docs).select("doc_id", *rules_columns())
    duck = duckdb.connect()
    duck.register("docs", docs.toPandas())
    want = sorted(duck.sql(SQL).fetchall())
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200


def rules_columns():
    return ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
