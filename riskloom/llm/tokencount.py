"""Token counts through a digest cache.

Content and tokenizer are each named by a SHA-256 digest. Counts known to the
cache are joined; of the rest each distinct content is encoded once and appended
to the cache (Parquet, one folder per tokenizer digest). Writers that overlap, or
one that is run again after a commit by halves, may store a digest twice; a
digest's count is the same in all of its rows and is read once.

Inside a task the encoder keeps the counts of short words: no piece of these
vocabularies runs across the start of a word, so a text's count is the sum over
its words. That is checked when the model is loaded; a model or text for which
it may not hold is encoded whole.

Results for odd input: a null text counts as empty and has no tokens; repeated
rows each get the count; an empty table gives an empty result. Columns besides
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import slices
from riskloom.scratch import Scratch

#: Words that a Python worker keeps, and the longest of them.
MEMO, MEMO_LEN = 500_000, 48
BLANK = "▁"


class PieceCounter:
    """Token counts as the sentencepiece library gives them, without added tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self._sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._sp.id_to_piece(i) for i in range(self._sp.get_piece_size())]
        self._by_word = (
            not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces)
            and self._sp.encode("a  b \n c", out_type=str) == [f"{BLANK}a", BLANK, f"{BLANK}b", BLANK, "<0x0A>", f"{BLANK}c"]
        )
        self._memo: dict[str, int] = {}

    def _whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self._sp.encode(texts, num_threads=1)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self._by_word:
            return self._whole(texts)
        # A word that starts a line keeps its line feed, so it has no leading blank.
        parts = [t.replace("\n", " \n").split(" ") for t in texts]
        # Runs of blanks and literal blank marks are left to the library.
        odd = [i for i, p in enumerate(parts) if BLANK in texts[i] or "" in p]
        new = set().union(*parts).difference(self._memo)
        long = {w for w in new if len(w) > MEMO_LEN}
        if len(self._memo) + len(new) > MEMO:
            self._memo.clear()
            new = set().union(*parts)
            long = {w for w in new if len(w) > MEMO_LEN}
        listed = list(new)
        self._memo.update((w, n - (w[:1] == "\n")) for w, n in zip(listed, self._whole(listed), strict=True))
        out = [sum(map(self._memo.__getitem__, p)) for p in parts]
        for w in long:
            del self._memo[w]
        for i, n in zip(odd, self._whole([texts[i] for i in odd]), strict=True):
            out[i] = n
        return out


_counters: dict[str, PieceCounter] = {}


def piece_counter(path: str) -> PieceCounter:
    """One for each Python worker, so that its tasks share the words that it keeps."""
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes() + b"\nno added tokens").hexdigest()


def count_misses(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(path)
        for b in slices(batches, "text"):
            n = counter.counts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; the cache gains the misses."""
    spark = docs.sparkSession
    folder = f"{cache_path}/tokenizer={tokenizer_digest(tokenizer_path)}"
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    misses = docs.groupBy("digest").agg(F.first("text").alias("text"))  # copies meet within the map tasks first
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        misses = misses.join(spark.read.schema("digest binary, n_tokens long").parquet(folder), "digest", "left_anti")
    misses.mapInArrow(count_misses(tokenizer_path), "digest binary, n_tokens long").write.mode("append").parquet(folder)
    known = spark.read.schema("digest binary, n_tokens long").parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    sized = docs.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return sized.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def count_tokens_once(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """count_tokens with a cache that starts empty and lives as long as the driver."""
    return count_tokens(docs, tokenizer_path, Scratch(docs.sparkSession, "token-cache").path("counts"))


