"""Near-duplicate classes by BagMinHash.

A text is the multiset of its five-word shingles (a shorter text with words is
one shingle). Weights are counts. The weight axis is cut into levels [0, 1),
[1, 2), [2, 4), [4, 8) ...; each shingle and level owns a Poisson process over
time whose rate is the level's width for each signature place. A level that lies
below the count takes part whole; in the level that the count cuts, a point's
place is found by halving, and points above the count are left out. Signature
place k holds the earliest point dealt to k, so two texts agree there with the
probability of their weighted Jaccard similarity. Only points up to a time that
all places will have been filled by are made; the few texts with a place still
empty get twice the time.

Signatures are cut into bands. Equal multisets form a class first, and only one
text of each goes on. Every text of a bucket is compared with the bucket's
centre, the one with the most company over all of its buckets, so a large family
of copies costs one comparison each and not one for each pair. Links (checked on
the texts: multiset overlap of ``threshold`` or more) are joined to components.
Buckets that still hold several get another centre outside of the last one's
component, and so on while that joins a fifth of what was open.

In small buckets what is left is compared pair by pair. In large ones it would be
most of a family of texts that share much but not enough, so they are compared
through their rarest items: an item is a shingle and its occurrence, items are
ordered by how many of these texts hold them, and two texts that overlap by the
threshold hold a common item among the first |x| - ceil(threshold |x|) + 1 of each.
Texts meet at such an item, pair by pair or in blocks of bounded size, where the
multisets are compared exactly. So no link among texts that share a bucket is lost.

Bands of five places, 28 of them: a pair of similarity 0.8 shares a bucket with
probability 1 - 1.5e-5, one of 0.9 with 1 - 1e-11.

Results for odd input: texts without words are equal to each other; a null text
is a class of its own, with its id; a null id counts as the least; rows that agree
in id and text are one document given twice and share a class; an empty table
gives an empty result; ids that aren't whole numbers end in a cast error. Columns
besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import slices
from riskloom.operators.components import components
from riskloom.scratch import Scratch

SHINGLE, BANDS, ROWS = 5, 28, 5
PLACES = BANDS * ROWS
#: Words whose hashes a task remembers.
MEMO = 100_000
#: Texts and bytes of items of a block in the larger groups; those with SMALL texts pair up directly.
BLOCK, BLOCK_BYTES, SMALL = 512, 32 << 20, 16
_U = np.uint64
#: Counters by which items are ordered, a power of two.
COUNTS = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingles:
    """The multiset of a text's shingles: sorted 64-bit hashes and their counts."""

    def __init__(self) -> None:
        self._memo: dict[str, int] = {}

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        memo = self._memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, words), _U, len(words))
        width = min(SHINGLE, len(h))
        if not width:
            return h, np.empty(0, np.int64)
        n = len(h) - width + 1
        s = np.full(n, _U(width))
        for i in range(width):
            s = s * _U(0x9E3779B97F4A7C15) + h[i : i + n]
            s ^= s >> _U(29)
        return np.unique(mix(s), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets; two empty ones are equal."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], places: int = PLACES) -> np.ndarray:
    """uint32 signature of each multiset, one row each; all ones for an empty one."""
    sizes = np.array([len(h) for h, _ in bags])
    out = np.full(len(bags) * places, ~_U(0))
    if not sizes.sum():
        return out.reshape(-1, places).astype(np.uint32)
    doc = np.repeat(np.arange(len(bags)), sizes)
    h = np.concatenate([h for h, _ in bags])
    count = np.concatenate([c for _, c in bags])
    weight = np.bincount(doc, count, len(bags))
    # processes: level 0 is [0, 1), level j >= 1 is [2^(j-1), 2^j)
    levels = 1 + np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0)
    at = np.repeat(np.arange(len(h)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.where(level > 0, low, 1)
    doc, count = doc[at], count[at]
    key = mix(h[at] + (level.astype(_U) << _U(1)) * _U(0xD1B54A32D192ED03) + _U(1))
    rate = (places * width).astype(np.float64)
    until = (np.log(places) + 4) / np.maximum(weight, 1)
    todo = np.flatnonzero(weight > 0)
    while len(todo):
        wanted = np.zeros(len(bags), bool)
        wanted[todo] = True
        live = np.flatnonzero(wanted[doc])
        time, done, block = np.zeros(len(live)), 0, 1
        while len(live):
            n = np.arange(done, done + block, dtype=_U)
            r = mix(key[live][:, None] + n * _U(0x9E3779B97F4A7C15))
            gap = -np.log(((r >> _U(11)).astype(np.float64) + 1) * 2.0**-53) / rate[live][:, None]
            x = time[:, None] + np.cumsum(gap, axis=1)
            r = mix(r ^ _U(0xA0761D6478BD642F))
            place = (r >> _U(40)) * _U(places) >> _U(24)
            keep = x <= until[doc[live]][:, None]
            cut = (low + width)[live] > count[live]
            if cut.any():  # the point's height in its level, by halving: one bit for each half
                height = low[live][:, None] + (mix(r ^ _U(0xE7037ED1A0B428DB)) & (width[live] - 1).astype(_U)[:, None]).astype(np.int64)
                keep &= ~cut[:, None] | (height < count[live][:, None])
            i, j = np.nonzero(keep)
            point = (x[i, j].astype(np.float32).view(np.uint32).astype(_U) << _U(32)) | (mix(r[i, j] + _U(7)) >> _U(32))
            np.minimum.at(out, doc[live][i] * places + place[i, j].astype(np.int64), point)
            time = x[:, -1]
            more = time <= until[doc[live]]
            live, time = live[more], time[more]
            done, block = done + block, min(2 * block, 64)
        todo = todo[(out.reshape(-1, places)[todo] == ~_U(0)).any(axis=1)]
        until[todo] *= 2
    return out.reshape(-1, places).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """int64 key of each band of each signature; bands differ in their keys."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(_U)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=_U)), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingles()
    for b in slices(batches, "text"):
        step = 128
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            bags = [shingles.of(t) for t in part.column("text").to_pylist()]
            content = [xxhash.xxh3_128_digest(h.tobytes() + c.tobytes()) for h, c in bags]
            keys = band_keys(signatures(bags))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            arrays = [part.column("doc_id"), part.column("hash"), pa.array(content, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "hash", "content", "bands"])


def check(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, bag = Shingles(), None, None
        for b in slices(batches, "text_b"):
            keep = []
            for x, s, t in zip(b.column("a").to_pylist(), b.column("text_a"), b.column("text_b").to_pylist(), strict=True):
                if x != last:
                    last, bag = x, shingles.of(s.as_py())
                keep.append(similarity(bag, shingles.of(t)) >= threshold)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The multiset of each text as a set of 64-bit items: one for each shingle and occurrence."""
    shingles = Shingles()
    for b in slices(batches, "text"):
        items = []
        for h, c in map(shingles.of, b.column("text").to_pylist()):
            nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            items.append(np.sort(mix(np.repeat(h, c) + nth.astype(_U))).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(items, pa.list_(pa.int64()))], ["key", "items"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many items each set on the left shares with each on the right."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)

    def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        items = np.concatenate(sets)
        col = np.minimum(np.searchsorted(shared, items), len(shared) - 1)
        found = shared[col] == items
        row, col = row[found], col[found]
        order = np.argsort(col, kind="stable")
        return row[order], col[order]

    if len(shared):
        (ri, ci), (rj, cj) = cells(left), cells(right)
        for at in range(0, len(shared), 4096):
            parts = []
            for r, c, n in ((ri, ci, len(left)), (rj, cj, len(right))):
                lo, hi = np.searchsorted(c, (at, at + 4096))
                dense = np.zeros((n, 4096), np.float32)
                dense[r[lo:hi], c[lo:hi] - at] = 1
                parts.append(dense)
            out += parts[0] @ parts[1].T
    return out


def across(threshold: float):
    """Links between two blocks of a group: those that join components, as few as do."""

    def sets(block: pa.Table) -> list[np.ndarray]:
        return [x.values.to_numpy() for chunk in block.column("items").chunks for x in chunk]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs: list[tuple[int, int]] = []
        if not right.num_rows:  # a block and itself
            right = left
        if left.num_rows:
            x, y = sets(left), sets(right)
            both = overlaps(x, y).astype(np.float64)
            total = np.array([len(v) for v in x])[:, None] + np.array([len(v) for v in y])
            (key_p, p), (key_q, q) = ([t.column(c).to_numpy() for c in ("key", "root")] for t in (left, right))
            i, j = np.nonzero((both / np.maximum(total - both, 1) >= threshold) & (p[:, None] != q))
            joined: dict[int, int] = {}

            def root(r: int) -> int:
                while r in joined:
                    r = joined[r]
                return r

            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                u, v = root(p[a]), root(q[b])
                if u != v:
                    joined[max(u, v)] = min(u, v)
                    pairs.append(tuple(sorted((key_p[a], key_q[b]))))
        return pa.table({c: pa.array([x[k] for x in pairs], pa.int64()) for k, c in enumerate("ab")})

    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id and class_id, the least doc_id of the class, for every row."""
    scratch = Scratch(docs.sparkSession, "minhash")
    signed, classes = _classes(docs, threshold, scratch)
    least = classes.groupBy("root").agg(F.min(F.struct("doc_id")).alias("l"))  # in a struct, null is the least
    named = scratch.put(classes.join(least, "root").select("content", F.col("l.doc_id").alias("class_id")), "named")
    out = signed.select("doc_id", "content").join(named, "content").select("doc_id", "class_id")
    alone = F.col("doc_id").cast("long")
    return out.union(docs.filter("text is null").select(alone.alias("doc_id"), alone.alias("class_id")))


def first_documents(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of each class, all columns as given: the least by doc_id, then by the text's hash.

    A document is an id and a text, so different texts under one id, or under none, are told apart. Where
    rows with other columns share both, the one with the least hash of all columns stays.
    Rows without a text are no one's duplicates and are all kept.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    _, classes = _classes(docs, threshold, scratch)
    firsts = classes.groupBy("root").agg(F.min(F.struct("doc_id", "hash")).alias("f"))
    firsts = scratch.put(firsts.select(F.col("f.doc_id").alias("_kept"), F.col("f.hash").alias("_kept_hash")), "firsts")
    texts = docs.filter("text is not null")
    on = texts["doc_id"].cast("long").eqNullSafe(firsts["_kept"]) & (F.xxhash64(texts["text"]) == firsts["_kept_hash"])
    kept = texts.join(firsts, on, "left_semi").select(F.struct("*").alias("row"))
    kept = kept.groupBy(F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("hash")).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select("row.*").union(docs.filter("text is null"))


def _classes(docs: DataFrame, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """doc_id, hash and content of every text; content, its first doc_id and hash, and root, the key of its class."""
    given = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"))
    texts = given.filter("text is not null")
    signed = scratch.put(texts.mapInArrow(sign, "doc_id long, hash long, content binary, bands array<long>"), "signed")

    # one text of each content goes on, under a number of its own
    first = signed.groupBy("content").agg(F.min(F.struct("doc_id", "hash")).alias("f"))
    first = scratch.put(first.select("content", "f.*", F.monotonically_increasing_id().alias("key")), "first")
    alike = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["hash"] == y["hash"])
    kept = signed.join(first.drop("content"), alike(signed, first)).select("key", "bands").dropDuplicates(["key"])
    rows = scratch.put(kept.select("key", F.explode("bands").alias("bucket")), "buckets")
    sizes = scratch.put(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    shared = scratch.put(rows.join(sizes, "bucket"), "shared")
    scratch.free(rows)

    company = shared.groupBy("key").agg(F.sum("n").alias("company"))
    shared = scratch.put(shared.join(company, "key"), "ranked")
    centres = shared.groupBy("bucket").agg(F.max(F.struct("company", (-F.col("key")).alias("k"))).alias("c"))
    centres = scratch.put(centres.select("bucket", (-F.col("c.k")).alias("a")), "centres")
    stars = shared.join(centres, "bucket").filter("a <> key").select("a", F.col("key").alias("b")).distinct()

    # the texts that share a bucket are fetched once; they move by key at every size
    ids = first.join(shared.select("key").distinct(), "key", "left_semi").select("key", "doc_id", "hash")
    ids = scratch.put(ids, "ids")
    own = texts.hint("merge").join(ids, alike(texts, ids)).select("key", "text").dropDuplicates(["key"])
    own = scratch.put(own, "texts")

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        x, y = (own.select(F.col("key").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        both = pairs.join(y, "b").join(x, "a").select("a", "b", "text_a", "text_b")
        return scratch.put(both.mapInArrow(check(threshold), "a long, b long"), name)

    links = checked(scratch.put(stars, "stars"), "links")
    done = centres.select("bucket", F.col("a").alias("key"))
    member, before = scratch.put(shared.select("bucket", "key", "company"), "member"), None
    while True:
        roots = scratch.put(components(links, scratch), "roots").withColumnRenamed("node", "key")
        member = scratch.put(_several(member.drop("root").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))), "open")
        n = member.count()
        if not n or (before is not None and n > 0.8 * before):
            break
        # another centre, outside of the last one's component
        before, last = n, member.join(done, ["bucket", "key"]).select("bucket", F.col("root").alias("last"))
        outside = member.join(last, "bucket", "left").groupBy("bucket", "key", "company").agg(F.max(F.coalesce(F.col("root") == F.col("last"), F.lit(False))).alias("met"))
        centres = outside.filter("not met").groupBy("bucket").agg(F.max(F.struct("company", (-F.col("key")).alias("k"))).alias("c"))
        centres = scratch.put(centres.select("bucket", (-F.col("c.k")).alias("a")).join(member.select("bucket", F.col("key").alias("a"), F.col("root").alias("own")), ["bucket", "a"]), "centres")
        done = scratch.put(done.union(centres.select("bucket", "a")), "done")
        stars = member.join(centres, "bucket").filter("root <> own").select(F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b")).distinct()
        links = scratch.put(links.union(checked(scratch.put(stars, "stars"), "more-links")), "all-links")

    if n:
        size = member.groupBy("bucket").agg(F.count("*").alias("n"))
        member = scratch.put(member.join(size, "bucket"), "left-over")
        small, large = _pairs(member.filter(F.col("n") <= SMALL)), member.filter(F.col("n") > SMALL).select("key", "root").distinct()
        items = scratch.put(own.join(large, "key").select("key", "text").mapInArrow(listed, "key long, items array<long>"), "items")
        groups = scratch.put(_rare_groups(items, large, threshold, lambda rows: scratch.put(rows, "rarest")), "rare")
        found = _block_links(groups.filter(F.col("n") > SMALL), items, threshold, scratch)
        pairs = scratch.put(small.union(_pairs(groups.filter(F.col("n") <= SMALL))).distinct(), "pairs")
        links = links.union(checked(pairs, "pair-links")).union(scratch.put(found.distinct(), "block-links"))
        roots = scratch.put(components(links, scratch), "roots").withColumnRenamed("node", "key")
    scratch.free(own, shared, member)

    classes = first.select("key", "content", "doc_id", "hash").join(roots, "key", "left")
    return signed, classes.select("content", "doc_id", "hash", F.coalesce("root", "key").alias("root"))


def _several(member: DataFrame) -> DataFrame:
    """The members of buckets that hold several components."""
    mixed = member.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket")
    return member.join(mixed, "bucket")


def _pairs(member: DataFrame) -> DataFrame:
    """Pairs across components of groups with SMALL texts at most."""
    groups = member.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("key", "root"))).alias("g"))
    pairs = groups.select("g", F.posexplode("g").alias("i", "x")).select("x", F.explode(F.expr("slice(g, 1, i)")).alias("y"))
    return pairs.filter("x.root <> y.root").select(F.col("y.key").alias("a"), F.col("x.key").alias("b"))


def _rare_groups(items: DataFrame, member: DataFrame, threshold: float, put: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """bucket, key, root, n, bytes: texts that hold a common item among their rarest, and the size of their group.

    put cuts lineage before the rarest items are read twice.

    Any order of items will do, as long as it is the same for all texts, so items are ordered by counts of
    hashes of them, whose number is fixed, and no text's other items leave their task.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTS, np.int64)
        for b in batches:
            total += np.bincount(b.column("items").flatten().to_numpy() & (COUNTS - 1), minlength=COUNTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    often = np.zeros(COUNTS, np.int64)
    for r in items.mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # COUNTS rows at most
        often[r["at"]] = r["n"]

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, keys, roots = b.column("items"), b.column("key").to_numpy(), b.column("root").to_numpy()
            out = []
            for x in sets:
                x = x.values.to_numpy()
                places = len(x) - int(np.ceil(threshold * len(x) - 1e-9)) + 1
                out.append(x[np.lexsort((x, often[x & (COUNTS - 1)]))[:places]])
            size = np.array([len(x) for x in out])
            own = np.array([8 * len(x) for x in sets], np.int64)
            bucket = np.concatenate(out) if out else np.zeros(0, np.int64)
            columns = (bucket, np.repeat(keys, size.astype(int)), np.repeat(roots, size.astype(int)), np.repeat(own, size.astype(int)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "key", "root", "own"])

    rare = put(items.join(member, "key").select("key", "root", "items").mapInArrow(rarest, "bucket long, key long, root long, own long"))
    held = (F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"))
    about = rare.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("own").alias("bytes"), F.min("root").alias("lo"), F.max("root").alias("hi"), *held)
    # one of the items that the same texts hold will do
    about = about.filter("lo <> hi").groupBy("n", "bytes", "lo", "hi", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "bytes")
    return rare.drop("own").join(about, "bucket")


def _block_links(member: DataFrame, items: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Links across components in the larger groups, block by block, by the multisets themselves."""
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    big = member.withColumn("blocks", blocks).withColumn("own", F.pmod(F.hash("key"), F.col("blocks")))
    big = scratch.put(big.drop("n", "bytes"), "blocks")
    # items are joined last, and a block meets itself without a second copy
    left = big.select("*", F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("j"))
    right = big.filter("own > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"), F.col("own").alias("j"))
    # columns of their own for each side, as both come from the same tables
    left, right = (side.join(items, "key").select(*(F.col(c).alias(c) for c in ("bucket", "i", "j", "key", "root", "items"))) for side in (left, right))
    return left.groupBy("bucket", "i", "j").cogroup(right.groupBy("bucket", "i", "j")).applyInArrow(across(threshold), "a long, b long")
