"""Line dedup by winnowing over line hashes.

A document is its lines, split at line feeds. A gram is the shortest run of lines
from one with words on that holds ``GRAM_WORDS`` words; its hash is one of its
lines' hashes. A window is the grams inside the shortest run of lines that holds
``min_words`` words, and its least gram (the last among equals) is selected. A
repeated run of that many words holds a whole window, and equal windows select
the same gram, so both places of the run have a fingerprint in common. A document
gives each selected gram once, with its place.

Places of one gram are joined to the first of them (by document, then line), and
each match is extended line by line both ways. Where a match ends, another, later
copy may go on. So the lines around each end are fingerprints of the next round:
the gram that reaches one, two, four, eight ... lines over the end, joined to its
own first place. The longest that stands earlier is extended in turn. Every round
halves what is left at least, so rounds grow with the logarithm of the longest
document. Runs with ``min_words`` words or more are deleted where they come later.
What stands first is never deleted, so no content is lost.

Line hashes and places are small; whole texts move once, when lines are deleted.

Results for odd input: a null text stays null, texts shorter than a window have
no matches; documents are ordered by doc_id (null least) and then by a hash of
the text; rows that agree in both are one document given twice and are treated
alike; an empty table gives an empty result; ids that aren't whole numbers end in
a cast error. Columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from riskloom.llm.base import slices
from riskloom.llm.minhash import mix
from riskloom.scratch import Scratch

#: Words of a gram: half of the words of a run that is deleted by default.
GRAM_WORDS = 25
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
RUN = pa.struct([("s", pa.int32()), ("e", pa.int32())])
KEY = pa.struct([("key", pa.binary()), ("side", pa.bool_()), ("end", pa.int32()), ("reach", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])
KEYS = "array<struct<key: binary, side: boolean, end: int, reach: int, s: int, e: int>>"


def gram_words(min_words: int) -> int:
    return min(GRAM_WORDS, min_words)


def line_hashes(lines: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))


def spans(held: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """End of the shortest run of lines from each line in ``at`` that holds the words; past the last line if none does.

    held: words up to the start of each line, and of all.
    """
    return np.searchsorted(held, held[at] + words)


def rolling(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run of lines from those of its lines."""
    n = len(hashes)
    powers, back = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _BACK, np.uint64)
    powers[0] = back[0] = 1
    powers, back = np.cumprod(powers), np.cumprod(back)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:n])])
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def winnow(hashes: np.ndarray, counts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the selected grams. counts: words of each line."""
    held, at = np.concatenate([[0], np.cumsum(counts)]), np.flatnonzero(counts)
    stop = spans(held, at, min_words)
    stop = stop[: np.searchsorted(stop, len(held))]  # of windows that end inside the text
    if not len(stop):
        return at[:0], at[:0]
    ends = spans(held, at, gram_words(min_words))
    ends = ends[: np.searchsorted(ends, len(held))]
    value = rolling(hashes, at[: len(ends)], ends)
    first, upto = np.arange(len(stop)), np.searchsorted(ends, stop, "right")  # grams first..upto lie inside the window
    # the least of 1, 2, 4 ... grams from each on; a window is two such stretches
    level = np.log2(upto - first).astype(np.int64)
    table = np.tile(np.arange(len(ends)), (int(level.max()) + 1, 1))
    for i in range(1, len(table)):
        step = 1 << (i - 1)
        x, y = table[i - 1, :-step], table[i - 1, step:]
        table[i, :-step] = np.where(value[y] <= value[x], y, x)
    x, y = table[level, first], table[level, upto - (1 << level)]
    chosen = np.unique(np.where(value[y] <= value[x], y, x))
    return at[chosen], ends[chosen]


def digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def mark(min_words: int):
    """Hashes of the lines of each document, words of each, and its selected grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = pa.struct([("key", pa.binary()), ("s", pa.int32()), ("e", pa.int32())])
        for b in slices(batches, "text"):
            hashed, sizes, found = [], [], []
            for text in b.column("text").to_pylist():
                lines = text.split("\n")
                counts = np.fromiter((len(x.split()) for x in lines), np.int32, len(lines))
                h = line_hashes(lines) if counts.sum() >= min_words else np.empty(0, np.uint64)
                hashed.append(h.view(np.int64))
                sizes.append(counts if len(h) else counts[:0])
                grams = zip(*(x.tolist() for x in winnow(h, counts, min_words)), strict=True) if len(h) else ()
                found.append([{"key": xxhash.xxh3_128_digest("\n".join(lines[s:e])), "s": s, "e": e} for s, e in grams])
            arrays = [b.column("doc_id"), b.column("hash"), pa.array(hashed, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(found, pa.list_(gram))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "hash", "lines", "sizes", "grams"])

    return run


def extend(own: np.ndarray, other: np.ndarray, start: int, end: int, at: int) -> tuple[int, int] | None:
    """The run of equal lines around own[start:end], which should equal other from at; None if it doesn't."""
    stop = at + end - start
    if stop > len(other) or (own[start:end] != other[at:stop]).any():
        return None
    n = min(start, at)
    differ = np.flatnonzero(own[start - n : start] != other[at - n : at])
    first = start - n + (differ[-1] + 1 if len(differ) else 0)
    n = min(len(own) - end, len(other) - stop)
    differ = np.flatnonzero(own[end : end + n] != other[stop : stop + n])
    return int(first), end + (int(differ[0]) if len(differ) else n)


def over_ends(own: np.ndarray, held: np.ndarray, first: int, last: int, right: bool, words: int) -> list[dict]:
    """Keys of the grams at an end of own[first:last] with 1, 2, 4 ... lines beyond it."""
    if right:
        inner, room = int(np.searchsorted(held, held[last] - words, "right")) - 1, len(own) - last
    else:
        inner, room = int(np.searchsorted(held, held[first] + words)), first
    out, reach = [], 1
    while reach <= room:
        s, e = (inner, last + reach) if right else (first - reach, inner)
        out.append({"key": digest(own[s:e]), "side": right, "end": last if right else first, "reach": reach, "s": s, "e": e})
        reach *= 2
    return out


def extended(min_words: int):
    """The runs to delete that the matches with one earlier document give, and keys over their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs, keys = [], []
            for own, sizes, other, matches in zip(b.column("lines"), b.column("sizes"), b.column("other"), b.column("matches").to_pylist(), strict=True):
                x, y = own.values.to_numpy(), other.values.to_numpy()
                held = np.concatenate([[0], np.cumsum(sizes.values.to_numpy())])
                found, ends = set(), set()
                reached, largest = {}, (0, 0)
                room = lambda m: min(m["s"], m["at"]) + min(len(x) - m["s"], len(y) - m["at"])  # noqa: B023, E731
                for m in sorted(matches, key=lambda m: (-room(m), m["at"] - m["s"], m["s"])):
                    s, e, at = m["s"], m["e"], m["at"]
                    if m["side"] is None and e <= reached.get(at - s, 0):
                        continue  # inside the run that this diagonal has just given
                    over = [i for i in (largest[0] - 1, largest[1]) if 0 <= i < len(x) and 0 <= i + at - s < len(y) and x[i] == y[i + at - s]]
                    if largest[0] <= s and e <= largest[1] and not over:
                        continue  # inside a run that is deleted, and it doesn't lead out
                    if (got := extend(x, y, s, e, at)) is None:
                        continue
                    reached[at - s] = got[1]
                    ends.update((*got, side) for side in ((False, True) if m["side"] is None else (m["side"],)))
                    if held[got[1]] - held[got[0]] >= min_words:
                        found.add(got)
                        largest = max(largest, got, key=lambda r: r[1] - r[0])
                runs.append([{"s": s, "e": e} for s, e in found])
                keys.append([k for end in ends for k in over_ends(x, held, *end, gram_words(min_words))])
            arrays = [b.column("doc_id"), b.column("hash"), pa.array(runs, pa.list_(RUN)), pa.array(keys, pa.list_(KEY))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "hash", "runs", "keys"])

    return run


def delete_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, deleted = [], []
        for text, groups in zip(b.column("text").to_pylist(), b.column("groups").to_pylist(), strict=True):
            if text is None or not groups:
                texts.append(text)
                deleted.append(0)
                continue
            lines = text.split("\n")
            gone = np.zeros(len(lines), bool)
            for run in (r for g in groups for r in g):
                gone[run["s"] : run["e"]] = True
            texts.append("\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g))
            deleted.append(int(gone.sum()))
        yield pa.RecordBatch.from_arrays(
            [b.column("row"), pa.array(texts, pa.string()), pa.array(deleted, pa.int64())], names=["row", "text", "n_deleted"]
        )


def first_places(places: DataFrame, scratch: Scratch) -> DataFrame:
    """places (key, doc, s, ...) that come later than another of their key, with the first one (source, at)."""
    firsts = places.groupBy("key").agg(F.min(F.struct("doc", "s")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = scratch.put(firsts.select("key", "first"), "firsts")  # counts are summed before they are shuffled
    later = places.join(firsts, "key").filter("struct(doc, s) > first")
    return later.select(*places.columns, F.col("first.doc").alias("source"), F.col("first.s").alias("at")).drop("key")


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id") -> DataFrame:
    """id_col as given, text without later repeated runs, n_deleted lines."""
    scratch = Scratch(docs.sparkSession, "lines")
    key = docs[id_col]["doc_id"] if docs.schema[id_col].dataType.typeName() == "struct" else docs[id_col]
    given = docs.select(docs[id_col].alias("row"), key.cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    found = given.filter("text is not null").select("doc_id", "hash", "text").mapInArrow(
        mark(min_words), "doc_id long, hash long, lines array<long>, sizes array<int>, grams array<struct<key: binary, s: int, e: int>>",
    )
    lined = scratch.put(found, "lined")
    own = scratch.put(lined.filter("size(lines) > 0").select("doc_id", "hash", "lines", "sizes").dropDuplicates(["doc_id", "hash"]), "hashes")
    grams = lined.select(F.struct("doc_id", "hash").alias("doc"), F.explode("grams").alias("g")).select("g.key", "doc", "g.s", "g.e")
    later = first_places(grams, scratch).withColumn("side", F.lit(None).cast("boolean"))
    is_ = lambda d: F.col(f"{d}_doc_id").eqNullSafe(F.col("doc_id")) & (F.col(f"{d}_hash") == F.col("hash"))
    rounds = []
    while True:
        # the places that two documents share, one row for the pair of them
        pairs = later.groupBy("doc", "source").agg(F.collect_set(F.struct("s", "e", "at", "side")).alias("matches"))
        pairs = scratch.put(pairs.select("matches", *(F.col(f"{d}.{c}").alias(f"{d}_{c}") for d in ("doc", "source") for c in ("doc_id", "hash"))), "pairs")
        if not pairs.limit(1).count():
            break
        both = pairs.join(own.select("doc_id", "hash", F.col("lines").alias("other")), is_("source")).drop("doc_id", "hash").join(own, is_("doc"))
        out = both.select("doc_id", "hash", "lines", "sizes", "other", "matches").mapInArrow(
            extended(min_words), f"doc_id long, hash long, runs array<struct<s: int, e: int>>, keys {KEYS}"
        )
        rounds.append(scratch.put(out, "runs"))
        ends = rounds[-1].select(F.struct("doc_id", "hash").alias("doc"), F.explode("keys").alias("k")).select("doc", "k.*")
        later = first_places(ends, scratch)
        # of each end the farthest place that stands earlier
        best = later.groupBy("doc", "side", "end").agg(F.max(F.struct("reach", "source", "at", "s", "e")).alias("b"))
        later = best.select("doc", "b.source", "b.s", "b.e", "b.at", "side")
    runs = own.select("doc_id", "hash", F.lit(None).cast("array<struct<s: int, e: int>>").alias("runs")).limit(0)
    for r in rounds:
        runs = runs.union(r.filter("size(runs) > 0").select("doc_id", "hash", "runs"))
    runs = scratch.put(runs.groupBy("doc_id", "hash").agg(F.collect_list("runs").alias("groups")), "deleted")
    scratch.free(lined, own, *rounds)
    gone = runs.select(F.col("doc_id").alias("_doc_id"), F.col("hash").alias("_hash"), "groups")
    on = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("hash") == F.col("_hash"))
    joined = given.join(gone.hint("merge"), on, "left").select("row", "text", "groups")  # by key at every size
    schema = StructType().add("row", docs.schema[id_col].dataType).add("text", StringType()).add("n_deleted", LongType())
    return joined.mapInArrow(delete_lines, schema).withColumnRenamed("row", id_col)
