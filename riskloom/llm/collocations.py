"""Phrase collocations by suffix-sigma: one shuffle of truncated suffixes, one stack a partition.

Texts are lower-cased (A-Z only), cut at stops into pieces and those into words. Every
word starts a suffix of at most ``max_n`` words that ends with its piece. Suffixes of one
language and first word meet in one place, sorted in reverse; there every phrase is a
prefix of a run of suffixes, so a stack of at most ``max_n`` open prefixes counts phrases
of all lengths in one pass. Parts are joined to their phrases afterwards.

A task sums equal suffixes of each slice of text before the shuffle, so copies and
passages that many documents share cost a row a slice. The place of a suffix is a range
of (language, first word, next words): ranges are cut by a sample of suffixes, so a first
word that holds a third of all is spread over many. A prefix that is open at the edge of
a range is handed on whatever its count, and the parts of its count are added, so where
ranges are cut changes no result.

Results for odd input: a null text has no words; a null language is ``und``; a text of any
length is taken in slices that overlap by the words a suffix needs; rows given twice count
twice; an empty table gives an empty result; other columns aren't read. A word may hold any
character but blanks, tabs and stops. Where phrases tie, they come by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.scratch import Scratch

#: Text bytes of a language that a task sorts at a time, and rows it hands on at a time.
SLICE, ROWS = 3 << 20, 50_000
#: One document in so many shows where ranges are cut; so many suffixes of it a range.
SAMPLED, CUTS = 64, 32
_STOP = b"."
_TABLE = bytes.maketrans(b",;:!?\n\v\f\r\t" + bytes(range(65, 91)), _STOP * 9 + b" " + bytes(range(97, 123)))


def tag(lang: str) -> str:
    """Its length first, so that no language's tag starts another's."""
    return f"{len(lang)}:{lang}"


def untag(word: str) -> tuple[str, str]:
    size, rest = word.split(":", 1)
    return rest[: int(size)], rest[int(size) :]


def _text(x: str) -> pa.Scalar:
    return pa.scalar(x, pa.large_string())


def _parts(texts: list[bytes], max_n: int) -> Iterator[tuple[pa.Array, int]]:
    """Words and stops in parts of bounded size, and how many of a part's words start a suffix there."""
    data = b" . ".join(texts).translate(_TABLE).replace(_STOP, b" . ")
    head, start = b"", 0
    while start < len(data):
        end = data.find(b" ", start + SLICE)
        end = len(data) if end < 0 else end
        words = pc.split_pattern(pa.array([(head + b" " + data[start:end]).decode()], pa.large_string()), " ").flatten()
        words = words.filter(pc.not_equal(words, _text("")))
        yield words, len(words) if end == len(data) else max(0, len(words) - max_n + 1)
        head, start = " ".join(words[max(0, len(words) - max_n + 1) :].to_pylist()).encode(), end


def _summed(words: pa.Array, starts: int, max_n: int) -> tuple[list[pa.Array], np.ndarray]:
    """Columns of the words of the distinct suffixes in order, null past their end, and their counts."""
    coded = words.dictionary_encode()
    given = coded.dictionary
    # a word with its blank is no other's start, so this order is the bytes' order of whole suffixes
    order = pc.sort_indices(pc.binary_join_element_wise(given, _text(""), _text(" "))).to_numpy()
    rank = np.empty(len(given), np.int64)
    rank[order] = np.arange(1, len(given) + 1)
    ids = np.concatenate([rank[coded.indices.to_numpy()], np.zeros(max_n, np.int64)])
    stop = pc.index(given, pa.scalar(".", given.type)).as_py()
    if stop >= 0:
        ids[ids == rank[stop]] = 0
    columns = [ids[:starts]]
    for k in range(1, max_n):
        columns.append(np.where(columns[-1] > 0, ids[k : k + starts], 0))
    alive = columns[0] > 0
    columns = [c[alive] for c in columns]
    if not len(columns[0]):
        return [], np.zeros(0, np.int64)
    bits = int(len(given) + 1).bit_length()
    per, keys = max(1, 63 // bits), []
    for at in range(0, max_n, per):
        key = np.zeros(len(columns[0]), np.int64)
        for c in columns[at : at + per]:
            key = (key << bits) | c
        keys.append(key)
    sort = np.lexsort(keys[::-1])
    keys = [k[sort] for k in keys]
    new = np.ones(len(sort), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    named = given.take(pa.array(order))
    picked = [c[sort[first]] for c in columns]
    return [named.take(pa.array(np.maximum(c, 1) - 1, mask=c == 0)) for c in picked], np.diff(np.append(first, len(sort)))


def suffixes(max_n: int, cuts: list[str] | None = None):
    """Partly summed suffixes (range, suffix, n) of (lang, text); a suffix is its language's tag and words, each with a blank."""

    def flush(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        for words, starts in _parts(texts, max_n):
            columns, n = _summed(words, starts, max_n)
            if not columns:
                continue
            key = pc.binary_join_element_wise(_text(tag(lang)), columns[0], _text(""))
            key = pc.binary_join_element_wise(key, *columns[1:], _text(""), _text(" "), null_handling="skip")
            edges = [0, *(_first_from(key, c) for c in cuts or ()), len(key)]
            place = np.repeat(np.arange(len(edges) - 1, dtype=np.int32), np.diff(edges))
            for at in range(0, len(key), ROWS):
                some = key.slice(at, ROWS).cast(pa.string())
                yield pa.record_batch({"range": pa.array(place[at : at + ROWS]), "suffix": some, "n": pa.array(n[at : at + ROWS])})
            del words, columns, key, some
            pa.default_memory_pool().release_unused()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                lang = lang.as_py()
                held.setdefault(lang, []).append(text.as_buffer().to_pybytes())
                size[lang] = size.get(lang, 0) + len(held[lang][-1])
                if size[lang] >= SLICE or sum(size.values()) >= 2 * SLICE:
                    largest = max(size, key=size.get)
                    size.pop(largest)
                    yield from flush(largest, held.pop(largest))
        for lang in list(held):
            yield from flush(lang, held.pop(lang))

    return run


def _first_from(keys: pa.Array, cut: str) -> int:
    """Where the sorted keys reach the cut, by bytes."""
    want, lo, hi = cut.encode(), 0, len(keys)
    while lo < hi:
        mid = (lo + hi) // 2
        if keys[mid].as_buffer().to_pybytes() < want:
            lo = mid + 1
        else:
            hi = mid
    return lo


def prefixes(max_n: int, least: int):
    """lang, phrase, words, n of the prefixes of sorted suffixes; the languages' totals have 0 words.

    Prefixes that are open at the first or last row are given whatever their count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: str | None = None
        stack = np.zeros(max_n + 1, np.int64)  # counts of the open prefixes of each length
        edge = np.ones(max_n + 1, bool)  # whether they were open at the first row
        totals: dict[str, int] = {}

        def out(rows: list[tuple[str, str, int, int]]) -> pa.RecordBatch:
            names, kinds = ("lang", "phrase", "words", "n"), (pa.string(), pa.string(), pa.int32(), pa.int64())
            return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n = batch.column("suffix").to_pylist(), batch.column("n").to_numpy()
            if last is not None:
                keys, n = [last, *keys], np.concatenate([[0], n])
            parts = pc.split_pattern(pa.array(keys, pa.large_string()), " ")
            offsets = parts.offsets.to_numpy()
            sizes = np.diff(offsets) - 1  # a suffix ends with a blank
            coded = parts.flatten().dictionary_encode()
            names, flat = coded.dictionary, coded.indices.to_numpy()
            sums = np.zeros(len(names), np.int64)
            np.add.at(sums, flat[offsets[:-1]], n)
            for w in np.flatnonzero(sums):
                lang = untag(names[int(w)].as_py())[0]
                totals[lang] = totals.get(lang, 0) + int(sums[w])
            ids = np.full((len(keys), max_n), -1, np.int64)
            for k in range(max_n):
                has = sizes > k
                ids[has, k] = flat[offsets[:-1][has] + k]
            same, rows = np.ones(len(keys), bool), []
            same[0] = False
            for k in range(1, max_n + 1):
                same[1:] &= (ids[1:, k - 1] == ids[:-1, k - 1]) & (ids[1:, k - 1] >= 0)
                begin = np.flatnonzero(~same)
                sums = np.add.reduceat(n, begin)
                sums[0] += stack[k]
                wanted = sums >= least
                wanted[0] |= edge[k]
                wanted[-1] = False  # still open
                for i in np.flatnonzero(wanted & (sizes[begin] >= k)):
                    rows.append((*_named(names, ids[begin[i], :k]), k, int(sums[i])))
                stack[k] = sums[-1]
                edge[k] &= len(begin) == 1
            last = keys[-1]
            if rows:
                yield out(rows)
        if last is not None:
            words = last.split(" ")[:-1]
            lang, first = untag(words[0])
            rows = [(lang, " ".join([first, *words[1:k]]), k, int(stack[k])) for k in range(1, len(words) + 1)]
            yield out(rows + [(lang, "", 0, n) for lang, n in totals.items()])

    return run


def _named(names: pa.Array, ids: np.ndarray) -> tuple[str, str]:
    words = [names[int(i)].as_py() for i in ids]
    lang, first = untag(words[0])
    return lang, " ".join([first, *words[1:]])


def phrase_counts(docs: DataFrame, scratch: Scratch, max_n: int = 5, least: int = 100, partitions: int | None = None) -> DataFrame:
    """lang, phrase, words, n: all phrases of up to max_n words that occur ``least`` times, and with 0 words each language's words in all."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).filter("text is not null")
    some = given.filter(F.pmod(F.xxhash64("lang", "text"), F.lit(SAMPLED)) == 0).mapInArrow(suffixes(max_n), "range int, suffix string, n long")
    shown = some.select("suffix").distinct().orderBy(F.xxhash64("suffix")).limit(CUTS * partitions).collect()  # bounded
    shown = sorted((r["suffix"] for r in shown), key=str.encode)
    cuts = [shown[len(shown) * i // partitions] for i in range(1, partitions)] if shown else []
    rows = given.mapInArrow(suffixes(max_n, cuts), "range int, suffix string, n long")
    rows = rows.repartitionById(len(cuts) + 1, F.col("range")).select("suffix", "n").sortWithinPartitions(F.desc("suffix"))
    found = rows.mapInArrow(prefixes(max_n, least), "lang string, phrase string, words int, n long")
    found = found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return scratch.put(found.filter((F.col("n") >= least) | (F.col("words") == 0)), "counts")


def collocations(docs: DataFrame, max_n: int = 5, least: int = 100, covered: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score and cut of each language's best phrases of 2 to max_n words.

    A phrase's score is the least of floor(1000 a n / (l r)) over its cuts, the first cut among equals.
    Left out are those inside a longer candidate that is at least ``covered`` percent as frequent. A longer
    phrase is never more frequent than one inside it, so a look at candidates one word longer will do.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    counts = phrase_counts(docs, scratch, max_n, least)
    split = lambda c: F.split(c, " ")
    phrases = counts.filter(F.col("words").between(2, max_n)).withColumnRenamed("n", "a")
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    part = lambda start, size: F.array_join(F.slice(split("phrase"), start, size), " ")
    cuts = cuts.withColumn("head", part(F.lit(1), F.col("cut"))).withColumn("rest", part(F.col("cut") + 1, F.col("words")))
    known = counts.filter(F.col("words").between(1, max_n - 1))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = cuts.join(counts.filter("words = 0").select("lang", "n"), "lang")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("over", wide("a") * wide("n") * 1000).withColumn("under", wide("l") * wide("r")).withColumn("score", F.expr("over div under"))
    best = F.min(F.struct("score", "cut", "l", "r")).alias("b")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(best).select("lang", "phrase", "a", "n", "b.*")
    inside = phrases.filter("words > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words")))).alias("phrase"), "a")
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    open_ = scored.join(inside, ["lang", "phrase"], "left").filter(~F.coalesce(100 * F.col("longer") >= covered * F.col("a"), F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = open_.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", F.col("score").cast("long"), F.col("cut").cast("long"))


ORACLE = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, p FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)),
listed AS (SELECT lang, piece, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
tokens AS (SELECT lang, piece, unnest(w) AS a, unnest(range(len(w))) AS i FROM listed),
runs AS (
  SELECT lang, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d, lead(a, 4) OVER o AS e
  FROM tokens WINDOW o AS (PARTITION BY piece ORDER BY i)),
grams AS (
  SELECT lang, 1 AS words, a AS phrase FROM runs UNION ALL SELECT lang, 2, concat_ws(' ', a, b) FROM runs WHERE b IS NOT NULL
  UNION ALL SELECT lang, 3, concat_ws(' ', a, b, c) FROM runs WHERE c IS NOT NULL UNION ALL SELECT lang, 4, concat_ws(' ', a, b, c, d) FROM runs WHERE d IS NOT NULL
  UNION ALL SELECT lang, 5, concat_ws(' ', a, b, c, d, e) FROM runs WHERE e IS NOT NULL),
counts AS (SELECT lang, phrase, any_value(words) AS words, count(*) AS f FROM grams GROUP BY lang, phrase),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE words = 1 GROUP BY lang),
often AS (SELECT * FROM counts WHERE f >= 100),
cuts AS (
  SELECT c.lang, c.phrase, c.words, c.f AS a, k, array_to_string(string_split(c.phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ') AS rest
  FROM often c, range(1, 5) AS t(k) WHERE c.words > 1 AND k < c.words),
scores AS (
  SELECT cuts.lang, cuts.phrase, a, k, h.f AS l, t.f AS r, n, (1000 * a::HUGEINT * n) // (h.f::HUGEINT * t.f) AS score
  FROM cuts JOIN counts h ON h.lang = cuts.lang AND h.phrase = head JOIN counts t ON t.lang = cuts.lang AND t.phrase = rest JOIN totals ON totals.lang = cuts.lang),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, f, ' ' || phrase || ' ' AS phrase FROM often WHERE words > 2),
free AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM longer o WHERE o.lang = b.lang AND 100 * o.f >= 100 * b.a AND len(o.phrase) > len(b.phrase) + 2 AND contains(o.phrase, ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score, k AS cut
FROM free QUALIFY rank <= 2000"""
