"""Packing by the length histogram, shortest pack first.

1. Each text becomes token ids plus an end id and is cut into pieces of at most
   ``width`` ids. A piece is numbered among those of its length in its task.
2. The histogram of lengths (``width`` rows at most) goes to the driver. Lengths
   are placed longest first, each on the packs that are filled least; packs of
   one fill are a range of sequence numbers with a count, so a placement says:
   the next ``count`` pieces of this length go to these sequences at this offset.
3. A piece's rank among all of its length, from its number and the counts of
   earlier tasks, finds its placement.

Nothing is sorted by key and no length is gathered in one task, so a length that
a third of all pieces share costs nothing extra.

Results for odd input: a null or empty text is one piece with the end id alone;
repeated rows are packed as often as they stand; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.base import slices
from riskloom.scratch import Scratch

#: Words, and pieces of words, that a Python worker keeps, and the longest of the words.
MEMO, MEMO_LEN = 500_000, 48
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, nth long"
_SPACES = str.maketrans("\n\r\t", "   ")
#: Letters whose lower case and composition are one to one, then a run of punctuation.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,;:!?|&%$#*()]*)")


class WordIds:
    """Token ids as the tokenizers library gives them, packed as little-endian uint32.

    White space always ends a token here and is dropped, so a text's ids are those
    of its words in turn. Words are kept; a new one that is letters and then common
    punctuation is two pieces in lower case for this tokenizer, which are kept too
    and encoded many at a time: each ends with an id that ends a piece.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._of = Tokenizer.from_file(path)
        vocabulary = self._of.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._memo: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {"": b""}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._of.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that the tokenizer doesn't cut further."""
        out: list[bytes] = []
        for at in range(0, len(pieces), 1000):
            part = pieces[at : at + 1000]
            ids = np.array(self._of.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            stops = (np.flatnonzero(self._ends[ids]) + 1).tolist()
            if len(stops) != len(part):  # not a vocabulary that marks the ends of pieces
                out += self._whole(part)
                continue
            data = ids.tobytes()
            out += [data[4 * i : 4 * j] for i, j in zip([0, *stops], stops, strict=False)]
        return out

    def _learn(self, words: set[str]) -> None:
        if len(self._pieces) > MEMO:
            self._pieces = {"": b""}
        simple, other, pieces = [], [], set()
        for w in words:
            if m := _SIMPLE.fullmatch(w):
                simple.append((w, m[1].lower(), m[2]))
                pieces.add(simple[-1][1])
                pieces.add(m[2])
            else:
                other.append(w)
        new = list(pieces.difference(self._pieces))
        self._pieces.update(zip(new, self._encode(new), strict=True))
        self._memo.update((w, self._pieces[a] + self._pieces[b]) for w, a, b in simple)
        self._memo.update(zip(other, self._whole(other), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        parts = [(t.translate(_SPACES) if "\t" in t or "\r" in t else t.replace("\n", " ")).split(" ") for t in texts]
        words = set().union(*parts)
        new = words.difference(self._memo)
        if len(self._memo) + len(new) > MEMO:
            self._memo.clear()
            new = words
        self._learn(new)
        out = [b"".join(map(self._memo.__getitem__, p)) for p in parts]
        for w in [w for w in new if len(w) > MEMO_LEN]:
            del self._memo[w]
        return out


_tokenizers: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each Python worker, so that its tasks share the words that it keeps."""
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def cut(path: str, end_id: int, width: int):
    """Token pieces of each text, numbered by length within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens, end = word_ids(path), np.array([end_id], "<u4").tobytes()
        seen, part, step = [0] * (width + 1), TaskContext.get().partitionId(), 4 * width
        for b in slices(batches, "text"):
            rows: list[tuple] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), tokens.ids(b.column("text").to_pylist()), strict=True):
                ids += end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    n = len(piece) // 4
                    rows.append((doc, at // 4, n, zlib.crc32(piece), len(ids) // 4, part, seen[n]))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def place(histogram: dict[int, int], width: int) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset), by length and rank."""
    open_packs: list[tuple[int, int, int]] = []  # (fill, first sequence, count): the shortest pack comes first
    rows, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        extended = []
        while left:
            if open_packs and open_packs[0][0] + length <= width:
                fill, first, count = heapq.heappop(open_packs)
            else:  # packs that this length has just gone on may take it again
                for pack in extended:
                    heapq.heappush(open_packs, pack)
                extended.clear()
                if open_packs and open_packs[0][0] + length <= width:
                    continue
                fill, first, count = 0, sequences, left
                sequences += left
            used = min(left, count)
            rows.append((length, rank, used, first, fill))
            if used < count:
                heapq.heappush(open_packs, (fill, first + used, count - used))
            if fill + length < width:
                extended.append((fill + length, first, used))
            rank, left = rank + used, left - used
        for pack in extended:
            heapq.heappush(open_packs, pack)
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5)


def locate(placed: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks = placed[:, 0], placed[:, 1]
        first = {int(n): int(i) for n, i in zip(*np.unique(lengths, return_index=True), strict=True)}
        last = {int(n): int(i) for n, i in zip(lengths, range(1, len(lengths) + 1), strict=True)}
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.empty(len(n), np.int64)
            for length in np.unique(n):
                lo, hi, own = first[int(length)], last[int(length)], n == length
                at[own] = lo + np.searchsorted(ranks[lo:hi], rank[own], "right") - 1
            sequence = placed[at, 3] + rank - ranks[at]
            keep = [b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            keep[2] = keep[2].cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(sequence), pa.array(placed[at, 4])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, width: int = 4096) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    scratch = Scratch(docs.sparkSession, "packing")
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = scratch.put(texts.mapInArrow(cut(tokenizer_path, end_id, width), PIECES), "pieces")
    counts = scratch.put(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    placed = place({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, width)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    # there are as many offsets as tasks and lengths, so they meet the pieces by key at every size
    ranked = pieces.join(offsets.hint("shuffle_hash"), ["part", "length"]).withColumn("rank", F.col("nth") + F.col("earlier"))
    out = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return out.mapInArrow(locate(placed), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
