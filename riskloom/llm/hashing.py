"""Nearest neighbours by multi-index hashing: learned rotated binary codes, split into substrings.

A rotation is learned on a bounded sample: principal directions, then turns that bring
the projections close to their signs. A vector's code is the signs. Codes are split into
substrings of 16 bits and every substring is indexed. Two codes at most R = m s + a bits
apart (m substrings) agree to s bits in one of the first a + 1 substrings, or to s - 1 bits
in another one; so probing those buckets retrieves *every* code within R. What is
retrieved is ranked by the cosine of the vectors themselves, in double precision.

R is each query's own. A cosine gives the expected distance of two codes, and the sample
how far real ones stray from it; R is where a neighbour better than the k-th best so far
would stay with the stated probability. The first k-th best comes from the sample, a
better one from what the codes within the smallest radius hold. So a query with close
neighbours ends at once, and one without looks as far as it must. No count of candidates
is capped. The codes only cost recall where a neighbour strays further; the tests measure it.

Every usable row is indexed. Rows with equal vectors are one entry with the k + 1 least ids,
which is all that any query can need, summed within a batch and by salt before they meet.
Entries are dealt by hash to shards of bounded size and distinct query vectors to blocks of
bounded size; each (shard, block) is one task's group, indexed there, and gives k + 1 hits a
query. Nothing is broadcast but the rotation and the sample.

Results for odd input: vectors that are null, empty, zero or hold null or non-finite entries
take no part, nor do those of another length than most, nor rows without an id (no result
could name them); with few rows a query gets as many as there are; repeated rows are rows,
each other's neighbours; ties come by id; an empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.vectors import common_size, matrix, usable
from riskloom.scratch import Scratch

SUBSTRING = 16
#: Entries of a shard and query vectors of a block at most, on average; a shard has no fewer entries than LEAST before there are as many as shuffle partitions.
SHARD, LEAST, BLOCK = 65_536, 1_024, 16_384
SALTS = 64
_BITS = np.array([bin(i).count("1") for i in range(1 << SUBSTRING)], np.uint8)
_MASKS = np.argsort(_BITS, kind="stable").astype(np.uint16)  # by number of bits
_UPTO = np.searchsorted(_BITS[_MASKS], np.arange(SUBSTRING + 1), "right")


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def scaled(x: np.ndarray) -> np.ndarray:
    """Times a power of two each, so that squares neither vanish nor pass a double; cosines keep their bits."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


@dataclass(frozen=True)
class Codes:
    """bits signs of (unit vector - mean) @ turn; stray: how far distances stray from the expected, in deviations."""

    mean: np.ndarray
    turn: np.ndarray
    stray: float
    sample: np.ndarray

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        signs = (unit(x) - self.mean) @ self.turn > 0
        return np.packbits(signs, axis=1, bitorder="little").view("<u2")

    def radius(self, cosine: np.ndarray) -> np.ndarray:
        """Bits within which a neighbour of such a cosine or a better one lies."""
        p = np.arccos(np.clip(cosine, -1, 1)) / np.pi
        return np.minimum(self.bits, np.ceil(self.bits * p + self.stray * np.sqrt(self.bits * p * (1 - p) + 1))).astype(int)


def learn(sample: np.ndarray, bits: int, k: int, probability: float, seed: int, rounds: int = 30) -> Codes:
    """The rotation, and the stray of the sample's own nearest pairs."""
    r = np.random.default_rng(seed)
    u = unit(sample)
    d = u.shape[1]
    mean = u.mean(axis=0)
    x = u - mean
    _, axes = np.linalg.eigh(x.T @ x)
    turns = []
    while sum(t.shape[1] for t in turns) < bits:
        size = min(d, bits - sum(t.shape[1] for t in turns))
        axis = axes[:, ::-1][:, :size]
        turn = np.linalg.qr(r.standard_normal((size, size)))[0]
        flat = x @ axis
        for _ in range(rounds):
            a, _, b = np.linalg.svd(flat.T @ np.sign(flat @ turn))
            turn = a @ b
        turns.append(axis @ turn)
    codes = Codes(mean, np.hstack(turns), 0.0, sample)
    code = codes.of(sample)
    probes = np.arange(min(512, len(u)))
    cosines = u[probes] @ u.T
    cosines[probes, probes] = -2
    near = np.argsort(-cosines, axis=1)[:, : min(4 * k, len(u) - 1)]
    if near.size == 0:
        return Codes(mean, codes.turn, float(bits), sample)
    cosine = np.take_along_axis(cosines, near, axis=1).ravel()
    apart = _BITS[code[np.repeat(probes, near.shape[1])] ^ code[near.ravel()]].sum(axis=1)
    p = np.arccos(np.clip(cosine, -1, 1)) / np.pi
    stray = (apart - bits * p) / np.sqrt(bits * p * (1 - p) + 1)
    # the worst tenth of cosines counts: near and far pairs may stray differently
    parts = np.array_split(stray[np.argsort(cosine)], 10)
    return Codes(mean, codes.turn, max(float(np.quantile(s, probability)) for s in parts if len(s)), sample)


class Index:
    """The substring tables of a shard."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.tables = [np.unique(code[:, j], return_inverse=True) for j in range(code.shape[1])]
        self.lists = [(np.argsort(inverse, kind="stable"), np.append(0, np.cumsum(np.bincount(inverse)))) for _, inverse in self.tables]

    def within(self, q: np.ndarray, radius: int) -> np.ndarray:
        """Which codes are within the radius of q, by probing."""
        met = np.zeros(len(self.code), bool)
        m = len(q)
        s, a = divmod(radius, m)
        for j, ((values, inverse), (order, start)) in enumerate(zip(self.tables, self.lists, strict=True)):
            reach = min(s if j <= a else s - 1, SUBSTRING)
            if reach < 0:
                continue
            if _UPTO[reach] * 4 < len(values):  # fewer keys to look up than buckets there are
                keys = q[j] ^ _MASKS[: _UPTO[reach]]
                at = np.minimum(np.searchsorted(values, keys), len(values) - 1)
                for b in at[values[at] == keys]:
                    met[order[start[b] : start[b + 1]]] = True
            else:
                met |= (_BITS[values ^ q[j]] <= reach)[inverse]
        rows = np.flatnonzero(met)
        return rows[_BITS[self.code[rows] ^ q].sum(axis=1) <= radius]


def search(codes: Codes, x: np.ndarray, ids: list[np.ndarray], code: np.ndarray, q: np.ndarray, qcode: np.ndarray, bound: np.ndarray, k: int) -> Iterator[list[tuple[float, int]]]:
    """The k best (minus cosine, id) of each query among the entries."""
    index, x = Index(code), scaled(x)
    length, q = np.sqrt((x * x).sum(axis=1)), scaled(q)
    norm = np.sqrt((q * q).sum(axis=1))
    m = code.shape[1]
    for i in range(len(q)):
        best: list[tuple[float, int]] = []
        done = np.zeros(len(x), bool)
        least = bound[i]
        for radius in (min(m - 1, int(codes.radius(least))), None):
            radius = int(codes.radius(least)) if radius is None else radius
            rows = index.within(qcode[i], radius)
            rows = rows[~done[rows]]
            done[rows] = True
            if len(rows):
                score = (x[rows] * q[i]).sum(axis=1) / (length[rows] * norm[i])
                if len(rows) > k:
                    keep = score >= np.partition(score, len(rows) - k)[len(rows) - k]
                    rows, score = rows[keep], score[keep]
                best = sorted(best + [(-float(c), int(v)) for r, c in zip(rows, score, strict=True) for v in ids[r]])[:k]
            if len(best) == k:
                least = max(least, -best[-1][0])
        yield best


def _key(vector: str) -> list[Column]:
    return [F.xxhash64(vector).alias("h1"), F.xxhash64(F.lit(1), vector).alias("h2")]


def _least(k: int):
    """Rows with equal vectors of a batch as one, with their k least ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h, v = (batch.column(c).to_numpy() for c in ("h1", "id"))
            h2 = batch.column("h2").to_numpy()
            order = np.lexsort((v, h2, h))
            new = np.ones(len(order), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
            first = np.flatnonzero(new)
            some = [v[order[a : min(a + k, b)]] for a, b in zip(first, np.append(first[1:], len(order)), strict=True)]
            out = batch.take(pa.array(order[first]))
            ids = pa.array([list(map(int, s)) for s in some], pa.list_(pa.int64()))
            yield pa.record_batch([out.column("h1"), out.column("h2"), out.column("v"), ids], ["h1", "h2", "v", "ids"])

    return run


def _coded(codes: Codes, k: int, bound: bool):
    """code, and for queries the k-th best cosine in the sample, a lower bound of what the search finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = unit(codes.sample) if bound else None
        for batch in batches:
            x = scaled(matrix(batch.column("v"), len(codes.mean)))
            code = pa.array([c.tobytes() for c in codes.of(x)], pa.binary())
            columns = [*batch.columns, code]
            if bound:
                least = np.full(len(x), -1.0)
                if len(sample) >= k:
                    for at in range(0, len(x), 256):
                        near = unit(x[at : at + 256]) @ sample.T
                        least[at : at + 256] = np.partition(near, len(sample) - k, axis=1)[:, len(sample) - k] - 1e-9
                columns.append(pa.array(least))
            yield pa.record_batch(columns, [*batch.schema.names, "code", *(["bound"] if bound else [])])

    return run


def nearest(
    df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, bits: int = 64, sample: int = 8192, probability: float = 0.98, seed: int = 13
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows nearest to each row that ``queries`` picks, itself left out.

    bits: a multiple of 16. sample: vectors at most that the rotation is learned on, the least by hash.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "hashing")
    schema, d = "query_id long, rank int, vec_id long, score double", common_size(df, vector)
    if d is None:
        return spark.createDataFrame([], schema)
    positive = F.exists(vector, lambda c: c != 0)
    plain = F.transform(F.col(vector), lambda c: c + F.lit(0).cast("float"))  # no negative zeros
    rows = df.filter(usable(F.col(vector)) & (F.size(vector) == d) & positive & F.col(key).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("id"), plain.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.select("id", "v", "asks", *_key("v"))
    kind = dict(rows.dtypes)["v"]
    wanted = k + 1  # a query finds itself too

    entries = rows.select("id", "v", "h1", "h2").mapInArrow(_least(wanted), f"h1 long, h2 long, v {kind}, ids array<long>")
    less = F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, wanted).alias("ids")
    entries = entries.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).groupBy("h1", "h2", "salt").agg(F.any_value("v").alias("v"), less)
    entries = scratch.put(entries.groupBy("h1", "h2").agg(F.any_value("v").alias("v"), less), "entries")
    found = entries.orderBy("h1", "h2").limit(sample).select("v").toArrow()
    if not found.num_rows:
        return spark.createDataFrame([], schema)
    codes = learn(scaled(matrix(found.column("v"), d)), bits, k, probability, seed)

    n, least = entries.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-n // SHARD), min(least, -(-n // LEAST)))
    ask = scratch.put(rows.filter("asks").select("id", "v", "h1", "h2"), "asking")
    vectors = ask.groupBy("h1", "h2").agg(F.any_value("v").alias("v"))
    blocks = max(1, -(-vectors.count() // BLOCK))
    indexed = entries.mapInArrow(_coded(codes, wanted, False), f"h1 long, h2 long, v {kind}, ids array<long>, code binary")
    indexed = scratch.put(indexed.select(F.pmod("h1", F.lit(shards)).alias("shard"), "v", "ids", "code"), "index")
    asked = vectors.mapInArrow(_coded(codes, wanted, True), f"h1 long, h2 long, v {kind}, code binary, bound double")
    asked = scratch.put(asked.withColumn("block", F.pmod("h2", F.lit(blocks))), "asked")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        hits: list[list[tuple[float, int]]] = []
        if left.num_rows and right.num_rows:
            code, qcode = (np.frombuffer(b"".join(t.column("code").to_pylist()), "<u2").reshape(-1, bits // SUBSTRING) for t in (left, right))
            ids = [np.array(i) for i in left.column("ids").to_pylist()]
            hits = list(search(codes, matrix(left.column("v"), d), ids, code, matrix(right.column("v"), d), qcode, right.column("bound").to_numpy(), wanted))
        else:
            right = right.slice(0, 0)
        listed = pa.array([[{"m": m, "id": i} for m, i in h] for h in hits], pa.list_(pa.struct([("m", pa.float64()), ("id", pa.int64())])))
        return pa.table([right.column("h1"), right.column("h2"), pa.array(np.arange(len(hits)) % SALTS, pa.int32()), listed], ["h1", "h2", "salt", "hits"])

    left = indexed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    right = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("shard", F.col("shard").cast("long"))
    pairs = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
    hits = pairs.applyInArrow(meet, "h1 long, h2 long, salt int, hits array<struct<m: double, id: long>>")
    fewer = F.slice(F.sort_array(F.flatten(F.collect_list("hits"))), 1, wanted).alias("hits")
    hits = hits.groupBy("h1", "h2", "salt").agg(fewer).groupBy("h1", "h2").agg(fewer)
    hits = scratch.put(hits, "hits")
    out = ask.select(F.col("id").alias("query_id"), "h1", "h2").join(hits, ["h1", "h2"])
    own = F.array_position(F.transform("hits", lambda h: h["id"]), F.col("query_id"))
    others = F.slice(F.filter("hits", lambda h, i: i + 1 != F.col("own")), 1, k)
    out = out.withColumn("own", own).select("query_id", F.posexplode(others).alias("at", "h"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("h.id").alias("vec_id"), (-F.col("h.m")).alias("score"))
