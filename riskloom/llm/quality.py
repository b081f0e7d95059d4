"""Quality rules, line first.

Every line is judged alone by three rules; lines that fail are removed, and a
document that loses too much of its text is rejected. Only built-in functions
are used, so each text is read once and nothing is shuffled.

A line fails as
  punctuation  symbols make up over a tenth of it, or a quarter of its words
               end in doubled exclamation marks, or it runs on for
               ``run_on_words`` words without any sentence mark;
  navigation   it has two or more menu separators, one for each four words;
  boilerplate  it is short and holds a stock phrase.

Results for odd input: a null text has no words and fails the base rules, as do
empty texts. Lines without words count for nothing and are dropped from the
cleaned text. Rows are judged one by one, so repeated rows repeat their result,
and an empty table gives an empty result. Columns besides ``doc_id`` and
``text`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import SPACES, let, words

SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "all rights reserved|terms of (use|service)|privacy policy|cookie|copyright|licen[sc]ed under|"
    "general public license|creative commons|spdx-license|enable javascript|subscribe to|sign up|"
    "click here|read more|log ?in"
)


def repeat_words(tokens: Column) -> Column:
    """How many words lie in three-word windows that the text holds twice or more."""

    def covered(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(
            pairs,
            lambda s: F.sort_array(
                F.array_compact(
                    F.transform(
                        s,
                        lambda x, j: F.when(
                            (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]),
                            x["i"],
                        ),
                    )
                )
            ),
        )
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(
            F.aggregate(starts, start, step, lambda a: a["n"])
        )

    def grams(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(tokens) >= 3, let(grams(tokens), covered)).otherwise(F.lit(0))


def judge_line(line: Column, run_on_words: int) -> Column:
    """Words of the line and the first rule that it fails, null if none."""
    marks = lambda pattern: F.regexp_count(line, F.lit(pattern))

    def verdict(n: Column) -> Column:
        rule = (
            F.when(n == 0, F.lit("empty"))
            .when((marks("[|»›•·]") >= 2) & (marks("[|»›•·]") * 4 >= n), F.lit("navigation"))
            .when((n <= 30) & F.lower(line).rlike(BOILERPLATE), F.lit("boilerplate"))
            .when(
                (marks("[#*$%&<>{}=~^]") * 10 > F.length(line))
                | ((marks("!!") >= 3) & (marks("!!") * 4 >= n))
                | ((n >= run_on_words) & (marks("[.!?…。！？]") == 0)),
                F.lit("punctuation"),
            )
        )
        return F.struct(n.alias("n"), rule.alias("rule"), line.alias("line"))

    return let(F.size(words(line)), verdict)


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_loss_percent: int = 40,
    run_on_words: int = 30,
) -> DataFrame:
    """doc_id, base counts, lines failed by rule, words lost, cleaned text and the verdict."""
    text = F.coalesce(F.col("_t"), F.lit(""))
    parts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")).select(
        "doc_id",
        words(text).alias("_w"),
        F.split(text, "\n").alias("_l"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    counted = parts.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        let(
            F.filter("_l", lambda x: x.rlike("[^ \\t-\\r]")),
            lambda x: F.size(x) - F.size(F.array_distinct(x)),
        ).cast("long").alias("n_dup_lines"),
        let(F.col("_w"), repeat_words).cast("long").alias("n_repeat_words"),
        F.transform("_l", lambda x: judge_line(x, run_on_words)).alias("_j"),
    )
    failed = lambda rule: F.size(F.filter("_j", lambda x: x["rule"] == rule)).cast("long")
    add = lambda a, x: a + x["n"]
    out = counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        *(failed(r).alias(f"{r}_lines") for r in ("punctuation", "navigation", "boilerplate")),
        F.aggregate(F.filter("_j", lambda x: x["rule"].isNotNull()), F.lit(0), add).cast("long").alias("lost_words"),
        F.array_join(F.transform(F.filter("_j", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = out.withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_words") <= max_loss_percent * F.col("n_words")))


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(t, '{SPACES}'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS l,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols FROM d),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM w, unnest(range(1, len(w) - 1)) AS r(i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, range(3) AS r(k) GROUP BY doc_id),
li AS (SELECT doc_id, x, len(list_filter(string_split_regex(x, '{SPACES}'), lambda y: y <> '')) AS n FROM w, unnest(l) AS u(x)),
m AS (SELECT *, len(regexp_extract_all(x, '[|»›•·]')) AS bars, len(regexp_extract_all(x, '[#*$%&<>{{}}=~^]')) AS marks,
             len(regexp_extract_all(x, '!!')) AS shouts, len(regexp_extract_all(x, '[.!?…。！？]')) AS stops FROM li),
j AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN bars >= 2 AND bars * 4 >= n THEN 'navigation'
             WHEN n <= 30 AND regexp_matches(lower(x), '{BOILERPLATE}') THEN 'boilerplate'
             WHEN marks * 10 > length(x) OR (shouts >= 3 AND shouts * 4 >= n) OR (n >= 30 AND stops = 0) THEN 'punctuation' END AS rule FROM m),
s AS (SELECT doc_id, count(*) FILTER (rule = 'punctuation') AS punctuation_lines, count(*) FILTER (rule = 'navigation') AS navigation_lines,
             count(*) FILTER (rule = 'boilerplate') AS boilerplate_lines, CAST(coalesce(sum(n) FILTER (rule IS NOT NULL), 0) AS BIGINT) AS lost_words,
             count(*) FILTER (n > 0) - count(DISTINCT CASE WHEN n > 0 THEN x END) AS n_dup_lines FROM j GROUP BY doc_id),
o AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
             CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(punctuation_lines AS BIGINT) AS punctuation_lines,
             CAST(navigation_lines AS BIGINT) AS navigation_lines, CAST(boilerplate_lines AS BIGINT) AS boilerplate_lines, lost_words
      FROM w JOIN s USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_words <= 40 * n_words AS kept FROM o
"""
