"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit a binary classifier tells languages
with a 1 from those with a 0: a log-linear model of hashed character n-grams (one
to three characters, words kept apart), whose weights are the log ratio of the
two groups' mean n-gram distributions. Margins are per n-gram, times the root of
their number. Decoding sums the logistic loss of each codeword over the bits,
weighted by how far apart a bit's two groups are, and chooses the codeword with
the least; the score is its share of exp(-loss), and a text whose two best
codewords are nearly even is flagged ambiguous.

The n-grams of all training rows are counted (a text's language and fold say
whether it is one); a model is languages x ``BUCKETS`` numbers, with
``max_langs`` languages at most, else an error.

Results for odd input: a null text, or one without letters, is ``und`` with score
0; with no training rows every text is ``und``; with one language all others get
it; repeated rows repeat their result; an empty table gives an empty result.
Columns besides ``doc_id``, ``text`` and ``lang`` are not read, and ``lang`` only
in training.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import fold, slices
from riskloom.scratch import ship

BITS, GRAMS = 14, 3
BUCKETS = 1 << BITS
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_LETTERS: list[np.ndarray] = []


def letters(codes: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x10000)]))
    out = _LETTERS[0][np.minimum(codes, 0xFFFF)]
    if len(far := np.flatnonzero(codes > 0xFFFF)):
        out[far] = [chr(c).isalpha() for c in codes[far].tolist()]
    return out


def grams(text: str) -> np.ndarray | None:
    """Buckets of the text's n-grams; None without letters."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters(codes)
    if not is_letter.any():
        return None
    codes = np.where(is_letter, codes, 32)
    codes = codes[np.r_[True, is_letter[1:] | is_letter[:-1]]]  # runs of other characters are one blank
    out, h = [], np.zeros(len(codes), np.uint32)
    for i in range(min(GRAMS, len(codes))):
        h = (h[: len(codes) - i] ^ codes[i:]) * _MUL[i]
        h = h ^ (h >> np.uint32(15))
        out.append((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS))
    return np.concatenate(out)


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for b in slices(batches, "text"):
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            if (g := grams(text)) is not None:
                totals[lang] = totals.get(lang, 0) + np.bincount(g, minlength=BUCKETS)
    for lang, n in totals.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of -1 and 1: all splits of up to five languages, else random ones far apart."""
    if n <= 5:
        rows = [(1, *r) for r in itertools.product((1, -1), repeat=n - 1)]
        return np.array([r for r in rows if len(set(r)) > 1], np.int8).reshape(-1, n).T
    r, bits = np.random.default_rng(seed), 8 * int(np.ceil(np.log2(n)))
    tried = [r.choice(np.array([-1, 1], np.int8), (n, bits)) for _ in range(32)]
    return max(tried, key=lambda c: ((bits - c.astype(int) @ c.T.astype(int)) + 4 * bits * np.eye(n)).min())


class Model:
    """Codewords, bit classifiers and decoding."""

    def __init__(self, counts: dict[str, np.ndarray], smooth: float = 0.5):
        self.langs = sorted(counts)
        self.code = codewords(len(self.langs)).astype(np.float32) if self.langs else np.empty((0, 0), np.float32)
        p = np.array([(counts[x] + smooth) / (counts[x].sum() + smooth * BUCKETS) for x in self.langs])
        weights, apart = [], []
        for bit in self.code.T:
            one, zero = p[bit > 0].mean(axis=0), p[bit < 0].mean(axis=0)
            w = np.log(one / zero)
            weights.append(w)
            apart.append(((one - zero) * w).sum())
        self.weights = np.array(weights, np.float32).T.copy()
        self.apart = np.array(apart) / np.sum(apart) if apart else np.empty(0)

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        g = grams(text) if text else None
        if g is None or not self.langs:
            return "und", 0.0, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        total = np.bincount(g, minlength=BUCKETS).astype(np.float32) @ self.weights
        margin = total / np.sqrt(len(g))
        loss = np.logaddexp(0, -self.code * margin) @ self.apart * len(self.apart)
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        best = int(share.argmax())
        return self.langs[best], float(share[best]), bool(np.sort(share)[-2] > 0.5 * share[best])


def train(docs: DataFrame, max_langs: int = 200) -> Model:
    ship(docs.sparkSession)
    rows = docs.filter("text is not null and lang is not null").select("text", F.col("lang").cast("string"))
    summed = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for r in summed.limit(max_langs * BUCKETS + 1).toLocalIterator():
        if r["lang"] not in counts and len(counts) == max_langs:
            raise ValueError(f"over {max_langs} languages")
        counts.setdefault(r["lang"], np.zeros(BUCKETS))[r["bucket"]] = r["n"]
    return Model(counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # max_langs x BUCKETS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [shared.value.decode(t) for t in b.column("text").to_pylist()]
            cols = [pa.array([x[i] for x in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def learn_and_identify(docs: DataFrame, held_fold: int = 2) -> DataFrame:
    """identify, with a model of the rows outside of the held-out fold."""
    model = train(docs.filter(fold(F.col("doc_id")) != held_fold))
    out = identify(docs, model)
    return out.withColumn("held_out", fold(F.col("doc_id")) == held_fold)
