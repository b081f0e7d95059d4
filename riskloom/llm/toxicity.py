"""Toxicity by class-conditional Kneser-Ney models.

Two models of words as strings of characters, of toxic and of ordinary texts, are
smoothed alike: a character's frequency after the four before it is discounted,
and what that frees goes to shorter contexts, whose counts (in how many longer
contexts a character is met) both classes share. So an expression that one class
lacks is as unlikely there as it is rare altogether, and inflected forms share
what is known of their stem.

A text's evidence is the difference of its log-likelihoods under both models,
divided by its number of words (``llr``). That mean also holds what is due to the
text's language or style, which the median word shows; so two more inputs are
taken above the median word: the mean of what exceeds it by more than ``MARGIN``
(``per_word``) and the mean of the highest fiftieth of the words (``peak``). Logistic
weights, learned on a fold that the counts leave out, turn the three into a score.
Counts are of documents, so long ones weigh no more than short ones.

The models are a classifier, fitted on a bounded sample: ``max_docs`` labelled
ids of each class, those first by a hash of the id, and as many to calibrate, with
one text each (of an id with several, the least by hash). All character strings of
those texts are kept, the rare ones too: they are what types and shared backoff
are counted from. The model is sorted arrays of 64-bit keys and ratios, 16 bytes
for each string and each context, so what is collected and broadcast is bounded by
the sample's text. Words are lower case without punctuation.

Results for odd input: a null or empty text, like one without words, has no
evidence and gets the score for none; without labels of both classes every text
scores 0; an id labelled twice is trained on twice; repeated rows repeat their
result; an empty table gives an empty result; ids that aren't whole numbers end in
a cast error. Columns besides ``doc_id`` and ``text`` (labels: ``doc_id``,
``toxic``) are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import fold, slices
from riskloom.llm.minhash import mix
from riskloom.scratch import Scratch

MEMO, MEMO_LEN = 300_000, 64
ORDER, DISCOUNT, MARGIN = 5, 0.75, 2.0
EVIDENCE = ("llr", "per_word", "peak")
_DROP = re.compile(r"[\W_]+")
START, STOP = "\x02" * (ORDER - 1), "\x03"


def normal(word: str) -> str:
    return _DROP.sub("", word.lower())


def grams(word: str) -> list[str]:
    """Every character of the word and its end, after the four characters before."""
    s = START + word + STOP
    return [s[i : i + ORDER] for i in range(len(s) - ORDER + 1)]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def keys(chars: np.ndarray) -> np.ndarray:
    """64-bit key of each row of code points."""
    key = np.full(len(chars), chars.shape[1], np.uint64)
    for i in range(chars.shape[1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + chars[:, i])
    return key


def alike(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the different rows, the place of one row of each, and each row's number among them."""
    return np.unique(keys(chars), return_index=True, return_inverse=True)


def shared_backoff(chars: np.ndarray) -> np.ndarray:
    """Kneser-Ney probability of the last character of each row, all different, after the rest of it.

    Recursive over orders: counts are of distinct characters in front, at order
    one over the characters that are there; the longest order has none.
    """
    count, levels = np.ones(len(chars)), []
    while chars.shape[1]:
        context = alike(chars[:, :-1])[2]
        total, types = np.bincount(context, count), np.bincount(context)
        _, at, lower = alike(chars[:, 1:])
        levels.append((count, total[context], types[context], lower))
        chars, count = chars[at, 1:], np.bincount(lower).astype(float)
    p = np.array([1.0 / max(len(levels[-1][0]), 1)])
    for count, total, types, lower in reversed(levels):
        p = np.maximum(count - DISCOUNT, 0) / total + DISCOUNT * types / total * p[lower]
    return p


class Model:
    """Log-likelihood ratios, toxic against ordinary, of character strings and of contexts."""

    def __init__(self, strings: pa.Array, n0: np.ndarray, n1: np.ndarray):
        """strings, all different and of ORDER characters, with their counts in both classes."""
        self.scale: np.ndarray | None = None  # not calibrated
        chars = np.concatenate([points("".join(strings[i : i + 100_000].to_pylist())) for i in range(0, len(strings), 100_000)]).reshape(-1, ORDER)
        _, at, lower = alike(chars[:, 1:])
        backoff = shared_backoff(chars[at, 1:])[lower]
        context_keys, _, context = alike(chars[:, :-1])
        p, free = [], []
        for n in (n0, n1):
            total, types = np.bincount(context, n), np.bincount(context, n > 0)
            f = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
            p.append(np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)[context] + f[context] * backoff)
            free.append(f)
        own = keys(chars)
        order = np.argsort(own)
        self.strings = own[order], np.log(p[1] / p[0])[order]
        self.contexts = context_keys, np.log(free[1] / free[0])
        self._memo: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_memo": {}}

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the keys, 0 for those that aren't there, and which are."""
        at = np.minimum(np.searchsorted(table[0], key), len(table[0]) - 1)
        there = table[0][at] == key
        return np.where(there, table[1][at], 0.0), there

    def words(self, raw: list[str]) -> np.ndarray:
        """Each word's ratio; nan for punctuation alone."""
        out, plain = np.full(len(raw), np.nan), [normal(w) for w in raw]
        some = [i for i, w in enumerate(plain) if w]
        if not some:
            return out
        chars = points("".join(START + plain[i] + STOP for i in some))
        length = np.array([len(plain[i]) + 1 for i in some])  # strings of each word
        first = np.cumsum(length) - length
        at = np.arange(length.sum()) + np.repeat(np.arange(len(some)) * (ORDER - 1), length)
        chars = np.lib.stride_tricks.sliding_window_view(chars, ORDER)[at]
        ratio, there = self._find(self.strings, keys(chars))
        ratio[~there] = self._find(self.contexts, keys(chars[~there, :-1]))[0]
        out[some] = np.add.reduceat(ratio, first)
        return out

    def evidence(self, texts: list[str]) -> np.ndarray:
        """A row for each text: its mean word, what exceeds the median word by the margin, per word, and the highest fiftieth's mean excess."""
        split = [t.split() for t in texts]
        memo = self._memo
        if len(memo) > MEMO:
            memo.clear()
        new = list(set().union(*split).difference(memo))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            memo.update(zip(part, self.words(part).tolist(), strict=True))
        out = np.zeros((len(split), len(EVIDENCE)))
        for row, words in zip(out, split, strict=True):
            x = np.fromiter(map(memo.__getitem__, words), np.float64, len(words))
            x = x[~np.isnan(x)]
            if len(x):
                above = x - np.median(x)
                row[:] = x.mean(), np.maximum(above - MARGIN, 0).mean(), np.sort(above)[-max(1, len(x) // 50) :].mean()
        for w in new:
            if len(w) > MEMO_LEN:
                del memo[w]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 50) -> None:
        """Logistic regression by Newton's method on standardized evidence."""
        spread = np.maximum(x.std(axis=0), 1e-9)
        z = np.c_[np.ones(len(x)), x / spread]
        w, ridge = np.zeros(1 + x.shape[1]), np.diag([1e-3, *[1.0] * x.shape[1]])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        self.scale = np.array([w[0], *(w[1:] / spread)])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.scale is None:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(self.scale[0] + x @ self.scale[1:], -30, 30)))


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        words, found = (Counter(), Counter()), (Counter(), Counter())
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words[toxic].update(set(map(normal, text.split())))
        for toxic in (0, 1):
            words[toxic].pop("", None)
            for w, n in words[toxic].items():
                for g in grams(w):
                    found[toxic][g] += n
        keys = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([f[g] for g in keys], pa.int64()) for f in found)], ["gram", "n0", "n1"])


def train(docs: DataFrame, labels: DataFrame, held_fold: int = 2, max_docs: int = 10_000) -> Model | None:
    """A model of labelled rows outside of the held-out fold; None without both classes."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    at = fold(F.col("doc_id"))
    marks = labels.filter("toxic is not null and doc_id is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    marks = marks.filter(at != held_fold).withColumn("calibrates", at == (held_fold + 1) % 4)
    # the first max_docs of each class, to count and to calibrate on: every task's first, then the first of those
    first = [marks.filter((F.col("toxic") == t) & (F.col("calibrates") == c)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs) for t in (0, 1) for c in (False, True)]
    marks = scratch.put(first[0].union(first[1]).union(first[2]).union(first[3]), "labels")
    rows = docs.filter("text is not null").select("doc_id", "text")
    rows = rows.join(F.broadcast(marks.select("doc_id").distinct()), "doc_id", "left_semi")  # 4 * max_docs ids at most
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).join(F.broadcast(marks), "doc_id")
    rows = scratch.put(rows, "rows")
    fit = rows.filter("not calibrates").select("text", "toxic")
    counted = fit.mapInArrow(count_grams, "gram string, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = counted.toArrow()
    n0, n1 = (counts[c].to_numpy() for c in ("n0", "n1"))
    if not (n0.sum() and n1.sum()):
        return None
    model = Model(counts["gram"], n0, n1)
    seen = evidence(rows.filter("calibrates").select(F.col("toxic").cast("long").alias("doc_id"), "text"), model).toPandas()
    if seen["doc_id"].nunique() == 2:
        model.calibrate(seen[list(EVIDENCE)].to_numpy(), seen["doc_id"].to_numpy())
    return model


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the evidence and score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # arrays bounded by the sample of max_docs ids of each class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches, "text"):
            x = model.evidence([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, x.T.copy()), pa.array(model.score(x))], ["doc_id", *EVIDENCE, "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{e} double" for e in (*EVIDENCE, "score")))


def score_toxicity(docs: DataFrame, labels: DataFrame, held_fold: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence for every row."""
    model = train(docs, labels, held_fold)
    if model is None:
        out = docs.select(F.col("doc_id").cast("long"), *(F.lit(0.0).alias(c) for c in (*EVIDENCE, "score")))
    else:
        out = evidence(docs, model)
    held = (fold(F.col("doc_id")) == held_fold).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *EVIDENCE)
