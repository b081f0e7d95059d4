"""Each operator on a small fixture with awkward rows, against a plain version."""

import hashlib
import random
import tarfile
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from riskloom.llm import chat, langid, linededup, media, minhash, mixing, packing, quality, tokencount, toxicity
from riskloom.llm.queries import vocabulary
from riskloom.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, hash string, words string, leaf string"


def words(r, n, vocabulary=4000):
    return " ".join(f"w{int(vocabulary * r.random() ** 2)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    r = random.Random(3)
    base = words(r, 120)
    passage = words(r, 60)
    out = [(i, words(r, 20 + 30 * (i % 5)) + ".\n" + words(r, 15) + ".", "en" if i % 3 else "fr", f"s{i % 4}") for i in range(40)]
    out += [(100, base, "en", "s0"), (101, base, "en", "s0"), (102, base + " tail", "en", "s0"), (103, base.replace(" ", "  ", 3), None, None)]
    out += [(i, f"{words(r, 12)}.\n{passage}\n{words(r, 9)}.", "en", "s0") for i in range(110, 114)]
    out += [(120, None, "en", "s1"), (121, "", None, "s1"), (122, "   \n\t ", "en", None), (123, "one", "fr", "s2"), (124, "one two", "fr", "s2")]
    out += [(130, words(r, 30_000), "en", "s3"), (131, "x" * 200_000, "en", "s3"), (132, "same line here.\n" * 900, "en", "s3")]
    out += [(140, "</s> <|endoftext|> [INST] é ü ▁x  y z 漢字 🙂", "fr", "s1"), (None, "no id at all but words", "en", "s1"), (None, None, None, None)]
    out += [(100, base, "en", "s0"), (5, out[5][1], "en", "s0"), (5, "other text of five", "en", "s0")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*x, len(x[1] or ""), "r", "h", "w", "l") for x in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, rows, empty):
    got = Counter(map(tuple, quality.quality_rules(docs).select("doc_id", "n_words", "n_dup_lines", "n_repeat_words", "word_chars").collect()))
    want = Counter()
    for i, t, *_ in rows:
        w = (t or "").split()
        if t and " " in t:
            w = [x for x in t.replace("\n", " ").split(" ") if x]
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip()]
        want[(i, len(w), len(lines) - len(set(lines)), len(hit), sum(map(len, w)))] += 1
    assert got == want
    assert quality.quality_rules(empty).count() == 0


def test_quality_lines(spark):
    good = ". ".join(words(random.Random(i), 8, 10**6) for i in range(12)) + "."
    nav = "Home | News | Sport | Help | Contact |"
    cases = [(1, good), (2, f"{good}\n{nav}\nAll rights reserved."), (3, "\n".join([nav.replace("|", f"x{i} |") for i in range(20)])), (4, good.replace(" ", "&&& "))]
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    assert got[1]["kept"] and got[1]["clean_text"] == good
    assert got[2]["kept"] and got[2]["clean_text"] == good and got[2]["navigation_lines"] == got[2]["boilerplate_lines"] == 1
    assert not got[3]["kept"] and not got[4]["kept"]


def bag(text):
    """The five-word shingles of a text, in plain Python."""
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def overlap(x, y):
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 1.0


def classes_by_force(rows, threshold=0.8):
    bags = [None if t is None else bag(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = {}  # only texts that share a shingle, or have none, can be alike
    for a, x in enumerate(bags):
        for s in () if x is None else x or (None,):
            held.setdefault(s, []).append(a)
    for a, x in enumerate(bags):
        for b in () if x is None else sorted({b for s in x or (None,) for b in held[s] if b < a}):
            if find(a) != find(b) and overlap(x, bags[b]) >= threshold:
                root[find(a)] = find(b)
    least = {}
    for i, (d, *_) in enumerate(rows):
        key = lambda v: (v is not None, v)
        least[find(i)] = min(least.get(find(i), d), d, key=key)
    return Counter((d, least[find(i)] if bags[i] is not None else d) for i, (d, *_) in enumerate(rows))


def test_near_duplicates(docs, rows, empty):
    got = Counter(map(tuple, minhash.near_duplicates(docs).collect()))
    assert got == classes_by_force(rows)
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_common_boilerplate(spark):
    """Texts that share two thirds of their words, so that they fill large buckets, with few true copies among them."""
    r = random.Random(10)
    common = words(r, 120, 10**6)
    own = [words(r, 60, 10**6).split() for _ in range(90)]
    rows = [(i, f"{common} {' '.join(w)}") for i, w in enumerate(own)]
    rows += [(100 + i, f"{common} {' '.join([*own[i][:30 + i % 3], f'z{i}', *own[i][31 + i % 3:]])}") for i in range(0, 90, 3)]
    want = classes_by_force(rows)
    assert len({c for _, c in want}) > 60
    assert Counter(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())) == want


def test_links_of_rare_items(spark, monkeypatch):
    """Rare items alone find every link, in pairs and in blocks."""
    r = random.Random(11)
    common, rows = words(r, 40, 10**6).split(), []
    for i in range(60):
        own = words(r, 60, 10**6).split()
        for k in range(1 + i % 3):
            t = [*common, *own]
            for _ in range(k * 3):
                t[r.randrange(40, 100)] = f"q{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(t)))
    bags = [bag(t) for _, t in rows]
    want = {(a, b) for b in range(len(rows)) for a in range(b) if overlap(bags[a], bags[b]) >= 0.8}
    items = spark.createDataFrame(rows, "key long, text string").mapInArrow(minhash.listed, "key long, items array<long>").cache()
    member = items.select("key", F.col("key").alias("root"))
    groups = minhash._rare_groups(items, member, 0.8)
    assert want and want <= {tuple(x) for x in minhash._pairs(groups).collect()}
    # every text is a component, so what a block leaves out its other links join
    found = {tuple(x) for x in minhash._block_links(groups, items, 0.8, Scratch(spark, "t")).collect()}
    join = lambda links: {frozenset(c) for c in joined(len(rows), links)}
    assert found <= want and join(found) == join(want)
    # and so with groups of several blocks
    monkeypatch.setattr(minhash, "BLOCK", 4)
    found = {tuple(x) for x in minhash._block_links(groups, items, 0.8, Scratch(spark, "t")).collect()}
    assert found <= want and join(found) == join(want)


def joined(n, links):
    root = list(range(n))
    for a, b in links:
        x, y = root[a], root[b]
        root = [x if r == y else r for r in root]
    out = {}
    for i, r in enumerate(root):
        out.setdefault(r, []).append(i)
    return out.values()


def test_near_duplicate_recall(spark):
    """Links of all pairs of whole texts, of which none may be lost."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(x["doc_id"], x["text"]) for x in docs.select("doc_id", "text").collect()]
    want = classes_by_force(rows)
    got = Counter(map(tuple, minhash.near_duplicates(docs).collect()))
    print("documents", len(rows), "classes", len({c for _, c in want}), "found", len({c for _, c in got}))
    assert got == want


def test_near_duplicate_family(spark):
    """A large family of copies around a text: those with up to three edits link to it, others to what shares their edits."""
    r = random.Random(9)
    base = words(r, 150, 10**6).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        t = list(base)
        for _ in range(i % 7):
            t[r.randrange(5, 145)] = f"e{r.randrange(10**9)}"
        rows.append((i, " ".join(t)))
    half = rows[6][1].split()
    rows += [(200 + j, " ".join([*half[:40], f"y{j}", *half[41:]])) for j in range(3)]
    r.shuffle(rows)
    got = Counter(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == classes_by_force(rows)


def test_signatures_are_unbiased():
    r = np.random.default_rng(0)
    error = []
    for t in range(150):
        keys = np.sort(minhash.mix(np.arange(t * 1000, t * 1000 + 50, dtype=np.uint64)))
        x, y = r.integers(1, 20, 50), r.integers(1, 20, 50)
        s = minhash.signatures([(keys, x), (keys, y)])
        error.append((s[0] == s[1]).mean() - minhash.similarity((keys, x), (keys, y)))
    assert abs(np.mean(error)) < 0.012 and np.std(error) < 0.06


def lines_by_force(rows, min_words=50):
    """Without every line of a run of min_words words that stands earlier, by comparing all places."""
    order = sorted({(d is not None, d, t) for d, t in rows if t is not None}, key=lambda x: (x[0], x[1] or 0, xxhash.xxh64_intdigest(x[2], seed=42) ^ (1 << 63)))
    split, gone = [t.split("\n") for *_, t in order], [set() for _ in order]
    size = [[len(x.split()) for x in lines] for lines in split]
    for i, own in enumerate(split):
        for j, other in enumerate(split[: i + 1]):
            for shift in range(1 if i == j else -len(other) + 1, len(own)):  # own[x] beside other[x - shift]
                held = 0
                for x in range(max(0, shift), min(len(own), len(other) + shift) + 1):
                    if x < min(len(own), len(other) + shift) and own[x] == other[x - shift]:
                        held += size[i][x]
                        continue
                    y = x - 1
                    while y >= max(0, shift) and own[y] == other[y - shift]:
                        if held >= min_words:
                            gone[i].add(y)
                        y -= 1
                    held = 0
    return {(d, t): "\n".join(x for k, x in enumerate(split[i]) if k not in gone[i]) for i, (_, d, t) in enumerate(order)}


def deduped(df):
    return Counter((r["doc_id"], r["text"]) for r in linededup.dedup_lines(df).collect())


def test_line_dedup(docs, rows, empty):
    pick = [(d, t) for d, t, *_ in rows]
    want = lines_by_force(pick)
    got = deduped(docs)
    assert got == Counter((d, None if t is None else want[(d, t)]) for d, t in pick)
    assert sum(len(t or "") * n for (_, t), n in got.items()) < sum(len(t or "") for _, t in pick) - 10_000
    assert linededup.dedup_lines(empty).count() == 0


def test_line_dedup_past_the_first_place(spark):
    """Runs that stand earlier only in a later copy of their start or end, logs that grow, and shared parts at random."""
    r = random.Random(12)
    big = [words(r, n, 10**6) for n in (60, 55, 30, 28, 40)]
    short = [words(r, n, 10**6) for n in (3, 8, 12, 20, 5, 7, 2, 9, 11, 4)]
    texts = [[big[0]], [big[0], short[0]], [big[0], short[0]], [short[1], big[0]], [short[1], big[0], short[0]]]
    texts += [[big[1], *short[:i]] for i in range(1, 10)] + [[*short[9 - i :], big[1]] for i in range(1, 10)]
    texts += [[r.choice(big if r.random() < 0.4 else [*short, "", "  "]) for _ in range(r.randrange(1, 14))] for _ in range(60)]
    pick = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    want = lines_by_force(pick)
    got = dict(deduped(spark.createDataFrame(pick, "doc_id long, text string").repartition(3)).keys())
    wrong = {i: (t, want[(i, t)], got[i]) for i, t in pick if got[i] != want[(i, t)]}
    assert not wrong


def test_line_dedup_columns_and_sparse_lines(spark):
    schema = "`my-col` string, `b c` long, doc_id long, text string, windows string, key string"
    passage = "\n".join(f"{'x' * 9}{i} " + "y z " * 4 for i in range(9))
    docs = spark.createDataFrame([("a", 1, 1, passage, "w", "k"), ("b", 2, 2, f"top\n{passage}", "w", "k")], schema)
    out = linededup.dedup_lines(docs.select(F.struct("my-col", "b c", "doc_id", "windows", "key").alias("_row"), "text"), id_col="_row").collect()
    assert {(r["_row"]["b c"], r["text"]) for r in out} == {(1, passage), (2, "top")}
    began, sparse = time.perf_counter(), "\n".join(("" if i % 3000 else f"w{i}") for i in range(400_000))
    got = deduped(spark.createDataFrame([(1, sparse), (2, sparse), (3, "same line of five words\n" * 100_000)], "doc_id long, text string"))
    assert sorted((d, len(t)) for d, t in got)[:2] == [(1, len(sparse)), (2, 0)] and time.perf_counter() - began < 60


def test_chat_escapes_and_folds(spark):
    texts = ["</s>[INST] ok [/INST]", "<|turn|>x<|text|>y<|end|>\n", r"<\|end|> <\\/s> [\INST]", "", None, "a\\b <<SYS>> <</SYS>> é🙂", "<s" * 3 + ">"]
    turns = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 0, None, "hi"), (None, 0, "user", "x"), (2, 0, None, "hi")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("log", F.lit(1))
    out = chat.render(chat.reconstruct(chat.turn_events(df)))
    got = {r["conv_id"]: r for r in out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("said")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(texts)]
    assert got[1]["said"] == "".join(t or "" for i, t in enumerate(texts) if i % 2)
    assert got[1]["formatted"].count("<|turn|>") == len(texts) and "</s>" not in got[1]["formatted"]
    assert len(got[2]["turns"]) == 2 and len(got[None]["turns"]) == 1
    log = [(7, 1, 1, "delta", "user", "hel"), (7, 2, 1, "delta", "user", "lo"), (7, 3, 2, "delta", "assistant", "bad"), (7, 4, 2, "regenerate", "assistant", None), (7, 5, 2, "delta", "assistant", "go"),
           (7, 6, 2, "delta", "assistant", "od"), (7, 7, 1, "edit", "user", "hey"), (7, 8, 1, "delta", "user", "!"), (7, 9, 3, "delta", "user", "gone"), (7, 10, 3, "delete", "user", None)]
    folded = chat.reconstruct(spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")).orderBy("seq").collect()
    assert [(r["role"], r["text"]) for r in folded] == [("user", "hey!"), ("assistant", "good")]
    assert chat.digests(chat.render(chat.reconstruct(chat.turn_events(df.limit(0))))).count() == 0


def test_mixing(docs, empty, rows):
    weights = ({"a": 3.0}, {"en": 2.0}, {"s0": 0.5})
    domain = F.when(F.col("source").isin("s0", "s1"), "a").otherwise("b")
    name = lambda s: "a" if s in ("s0", "s1") else "b"
    size = lambda t: len([w for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w])
    supply = Counter()
    for _, t, lang, s in rows:
        supply[(name(s), lang or "", s or "")] += size(t)
    total = sum(supply.values())
    for share in (0.3, 1.0, 3.0):
        picked = mixing.mix(docs, domain, weights, budget_share=share, max_epochs=2).collect()
        given = mixing.budgets(supply, weights, share * total, 2)
        spent = Counter()
        for r in picked:
            spent[(r["domain"], r["row"]["lang"] or "", r["row"]["source"] or "")] += r["n_tokens"]
        largest = max(size(t) for _, t, *_ in rows)
        assert all(given[k] - largest <= spent[k] <= given[k] + 1e-6 for k in supply)
        assert sum(given.values()) == pytest.approx(min(share, 2.0) * total)
        # the prefix, by force
        for leaf in supply:
            mine = [r for r in rows if (name(r[3]), r[2] or "", r[3] or "") == leaf]
            whole = min(2, int(given[leaf] // supply[leaf])) if supply[leaf] else 1
            n = sum((r["domain"], r["row"]["lang"] or "", r["row"]["source"] or "") == leaf for r in picked)
            assert whole * len(mine) <= n <= (whole + 1) * len(mine)
    assert picked[0]["row"].asDict().keys() == set(docs.columns)
    assert mixing.mix(empty, domain, weights).count() == 0


def test_mixing_shares_shortages():
    assert mixing.share(100, [1, 1, 2], [10, 100, 100]) == pytest.approx([10, 30, 60])
    assert mixing.share(100, [1, 1], [10, 20]) == [10, 20]
    got = mixing.budgets({("a", "x", "1"): 10, ("a", "x", "2"): 100, ("b", "x", "3"): 1000}, [{}, {}, {}], 100, 1)
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 40, ("b", "x", "3"): 50}


def test_token_counts(spark, docs, rows, empty, tmp_path):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((d, len((t or "").encode()), len(model.encode(t or ""))) for d, t, *_ in rows)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = tokencount.count_tokens(docs, path, cache)
        assert Counter(map(tuple, got.select("doc_id", "n_bytes", "n_tokens").collect())) == want
    stored = spark.read.parquet(f"{cache}/*")
    assert stored.count() == len({t or "" for _, t, *_ in rows})
    twice = stored.select("digest", "n_tokens").collect()  # as two writers at once leave it
    spark.createDataFrame(twice, "digest binary, n_tokens long").write.mode("append").parquet(f"{cache}/tokenizer={tokencount.tokenizer_digest(path)}")
    got = tokencount.count_tokens(docs, path, cache)
    assert Counter(map(tuple, got.select("doc_id", "n_bytes", "n_tokens").collect())) == want
    assert tokencount.count_tokens_once(empty, path).count() == 0


def test_word_counts_equal_the_library():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model, counter, r = sentencepiece.SentencePieceProcessor(model_file=path), tokencount.PieceCounter(path), random.Random(4)
    parts = ["a", " ", "  ", "\n", "the", "Ünï", "▁", "漢", "\t", "\r", "🙂", "x1", "</s>", " ", "."]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(3000)]
    assert counter.counts(texts) == [len(x) for x in model.encode(texts)]


def pieces_hold(got, rows):
    from tokenizers import Tokenizer

    of = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = Counter()
    for d, t in rows:
        ids = of.encode(t or "", add_special_tokens=False).ids + [2]
        want.update((d, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 4096))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 4096 and sorted(at) == list(range(len(at)))
    return at


def test_packing(docs, rows, empty):
    pieces_hold(packing.pack(docs, vocabulary("word_bpe_49k.json")).collect(), [(d, t) for d, t, *_ in rows])
    assert packing.pack(empty, vocabulary("word_bpe_49k.json")).count() == 0


def test_placing():
    r = random.Random(2)
    for _ in range(30):
        histogram = {r.randrange(1, 101): r.randrange(1, 50) for _ in range(r.randrange(1, 20))}
        placed = packing.place(histogram, 100)
        cells = Counter()
        for length, rank, count, first, offset in placed.tolist():
            for i in range(count):
                cells.update((first + i, x) for x in range(offset, offset + length))
        assert max(cells.values()) == 1 and len(cells) == sum(k * v for k, v in histogram.items())
        for length, n in histogram.items():
            mine = placed[placed[:, 0] == length]
            assert mine[:, 2].sum() == n and (mine[1:, 1] == mine[:-1, 1] + mine[:-1, 2]).all()
        used = Counter(s for s, _ in cells)
        assert all(max(x for t, x in cells if t == s) == used[s] - 1 for s in used)


def test_media(docs, rows, empty):
    got = media.media_columns(docs).collect()
    want = Counter()
    for d, t, *_ in rows:
        p = media.padded(t or "")
        want[(d, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), media.feature(p), len(p) // 64)] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["feature"], r["height"]) for r in got) == want
    assert len({(r["shard"], r["offset"]) for r in got}) == len({t or "" for _, t, *_ in rows})
    assert media.media_columns(empty).count() == 0


def stored(spark):
    """The folders of the media operator's runs, newest last."""
    return sorted(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("media-*"), key=lambda p: p.stat().st_mtime_ns)


def test_media_on_disk(spark):
    """Besides the shards, only rows and addresses are stored, and addresses are those that tarfile finds."""
    r = random.Random(17)
    texts = [words(r, 10 + i % 40) for i in range(3000)]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = media.media_columns(given).toPandas()
    root = stored(spark)[-1]
    shards = next(root.glob("*-shards"))
    rest = sum(p.stat().st_size for p in root.rglob("*.parquet"))
    assert len(got) == 3000 and rest < 100 * len(got)
    assert got.set_index("doc_id")["payload_sha256"].to_dict() == {i: hashlib.sha256(t.encode() + bytes(-len(t) % 64)).hexdigest() for i, t in enumerate(texts)}
    found = {}
    for p in shards.glob("*.tar"):
        with tarfile.open(p) as tar:
            for m in tar:
                found[p.name, m.offset_data, m.size, m.name.removesuffix(".png")] = hashlib.sha256(tar.extractfile(m).read()).hexdigest()
    assert {(x.shard, x.offset, x.length, x.payload_sha256): x.media_sha256 for x in got.itertuples()}.items() <= found.items()
    assert (got["media_bytes"] == got["length"]).all()


def test_media_of_another_content_fails(spark):
    given = spark.createDataFrame([(1, "one text"), (2, "two text")], "doc_id long, text string").coalesce(1)
    media.media_columns(given)
    root = stored(spark)[-1]
    shards = next(root.glob("*-shards"))
    tar = next(shards.glob("*.tar"))
    at = media.to_png(media.padded("one text"))
    other = media.to_png(media.padded("own text"))
    assert len(at) == len(other) and at in tar.read_bytes()
    tar.write_bytes(tar.read_bytes().replace(at, other))
    digest = hashlib.sha256(media.padded("one text")).digest()
    frame = pd.DataFrame([(digest, tar.name, tar.read_bytes().index(other), len(other))], columns=["digest", "shard", "offset", "length"])
    with pytest.raises(ValueError, match="another content"):
        list(media.read_columns(f"file://{shards}")(iter([frame])))


def test_media_round_trip():
    for t in ("", "a", "x" * 64, "é" * 999):
        p = media.padded(t)
        assert len(p) % 64 == 0 and p and media.from_png(media.to_png(p)) == p
        assert media.png_header(media.to_png(p)[: media.HEADER])[:2] == (64, len(p) // 64)


def test_language(spark, docs, empty):
    r = random.Random(5)
    make = lambda syllables: " ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(40))
    kinds = {"aa": ["ka", "tu", "mi", "no"], "bb": ["sch", "ein", "ung", "ber"], "cc": ["eau", "tion", "que", "elle"], "dd": ["ción", "mente", "dor", "osa"], "ee": ["жи", "ло", "та", "ве"], "ff": ["αβ", "γε", "δο", "σι"]}
    for n in (2, 4, 6):
        langs = list(kinds)[:n]
        data = [(i, make(kinds[langs[i % n]]), langs[i % n]) for i in range(240)]
        out = langid.learn_and_identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()
        held = [x for x in out if x["held_out"]]
        assert held and all(x["lang_pred"] == langs[x["doc_id"] % n] for x in held)
    odd = {x["doc_id"]: x for x in langid.learn_and_identify(docs).collect()}
    assert odd[120]["lang_pred"] == odd[121]["lang_pred"] == odd[122]["lang_pred"] == "und"
    assert langid.learn_and_identify(empty).count() == 0


def test_codewords_are_apart():
    for n in (2, 3, 5, 6, 40, 200):
        c = langid.codewords(n).astype(int)
        away = (c.shape[1] - c @ c.T) // 2
        assert c.shape[0] == n and (away + 99 * np.eye(n)).min() >= 1 + (n > 5) * (c.shape[1] // 6)


def test_toxicity(spark, docs, empty):
    r = random.Random(6)
    data, labels = [], []
    for i in range(1200):
        t, bad = words(r, 60, 300).split(), i % 5 == 0
        for _ in range(4 if bad else 0):
            t.insert(r.randrange(len(t)), r.choice(["vile", "scum!", "Rotten"]))
        data.append((i, " ".join(t)))
        labels.append((i, 1, int(bad)))
    d, l = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = [x for x in toxicity.score_toxicity(d, l).collect() if x["held_out"]]
    assert sum((x["doc_id"] % 5 == 0) == x["predicted"] for x in held) / len(held) > 0.97
    out = toxicity.score_toxicity(docs, l).collect()
    assert len(out) == docs.count() and all(0 <= x["score"] <= 1 for x in out)
    assert toxicity.score_toxicity(empty, l).count() == 0
    assert {x["score"] for x in toxicity.score_toxicity(d, l.limit(0)).collect()} == {0.0}


def ratios_by_force(counts):
    """The model's log ratios of strings, by dictionaries."""
    levels, d = [{g[1:] for g in counts}], toxicity.DISCOUNT
    while len(next(iter(levels[-1]))) > 1:
        levels.append({g[1:] for g in levels[-1]})
    p = {"": 1.0 / len(levels[-1])}
    for i in range(len(levels) - 1, -1, -1):
        count = Counter(g[1:] for g in levels[i - 1]) if i else Counter(levels[0])
        total, types = Counter(), Counter(g[:-1] for g in count)
        for g, n in count.items():
            total[g[:-1]] += n
        p = {g: max(n - d, 0) / total[g[:-1]] + d * types[g[:-1]] / total[g[:-1]] * p[g[1:]] for g, n in count.items()}
    total, types = (Counter(), Counter()), (Counter(), Counter())
    for g, n in counts.items():
        for c in (0, 1):
            total[c][g[:-1]] += n[c]
            types[c][g[:-1]] += n[c] > 0
    free = {h: [d * types[c][h] / total[c][h] if total[c][h] else 1.0 for c in (0, 1)] for h in {g[:-1] for g in counts}}
    out = {}
    for g, n in counts.items():
        q = [max(n[c] - d, 0) / max(total[c][g[:-1]], 1) + free[g[:-1]][c] * p[g[1:]] for c in (0, 1)]
        out[g] = np.log(q[1] / q[0])
    return out, {h: np.log(f[1] / f[0]) for h, f in free.items()}


def test_toxicity_keeps_rare_strings(spark):
    """Over 300,000 common strings beside the toxic class's rare ones: none is cut."""
    r = random.Random(8)
    pool = ["".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(6)) for _ in range(60_000)]
    data = [(2 * i + k, " ".join(pool[i % 1500 :: 1500])) for i in range(1500) for k in (0, 1)]
    data += [(10_000 + i, " ".join([*pool[i % 1500 :: 1500], f"vile{i}", f"scum{i}x"])) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i >= 10_000)) for i, _ in data], "doc_id long, toxic int")
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    model = toxicity.train(docs, labels)
    counts = {}
    for i, t in data:
        if zlib.crc32(str(i).encode()) % 4 in (0, 1):  # fold 2 is held out, 3 calibrates
            for w in set(map(toxicity.normal, t.split())):
                for g in toxicity.grams(w):
                    counts.setdefault(g, [0, 0])[i >= 10_000] += 1
    assert len(counts) > 300_000 and len(model.strings[0]) == len(counts)
    strings, contexts = ratios_by_force(counts)
    some = ["vile7", "scum9x", "viles", pool[3], pool[5][:3] + "q", "zzz", "!?", "x" * 500]
    want = [sum(strings.get(g, contexts.get(g[:-1], 0.0)) for g in toxicity.grams(toxicity.normal(w))) if toxicity.normal(w) else np.nan for w in some]
    assert np.allclose(model.words(some), want, equal_nan=True, rtol=1e-9)
    held = [x for x in toxicity.score_toxicity(docs, labels).collect() if x["held_out"]]
    assert all((x["doc_id"] >= 10_000) == bool(x["predicted"]) for x in held)


def test_toxicity_evidence_and_repeated_ids(spark):
    r = random.Random(13)
    data = [(i, words(r, 30, 200) + (" vile scum" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in data], "doc_id long, toxic int")
    once = spark.createDataFrame(data, "doc_id long, text string")
    thrice = once.union(once).union(once)
    x, y = toxicity.train(once, labels), toxicity.train(thrice, labels)
    assert (x.strings[0] == y.strings[0]).all() and np.allclose(x.strings[1], y.strings[1]) and np.allclose(x.scale, y.scale)
    texts = ["vile w1 w2, w3!", "", "!!", "w5"]
    ratio = lambda w: x.words([w])[0]
    for row, t in zip(x.evidence(texts), texts, strict=True):
        v = np.array([ratio(w) for w in t.split() if toxicity.normal(w)])
        above = v - np.median(v) if len(v) else v
        want = (v.mean(), np.maximum(above - toxicity.MARGIN, 0).mean(), above.max()) if len(v) else (0, 0, 0)
        assert np.allclose(row, want)
    out = toxicity.score_toxicity(thrice, labels, threshold=0.5).collect()
    assert len(out) == 1200 and len({(q["doc_id"], q["score"]) for q in out}) == 400
    several = spark.createDataFrame([(0, f"text number {i} of one id") for i in range(50)], "doc_id long, text string")
    assert toxicity.score_toxicity(once.filter("doc_id > 0").union(several), labels).count() == 449


def test_mixing_picks_the_seeded_prefix(docs, rows):
    """Every leaf's documents and epochs by a plain sort of the seeded order."""
    import struct

    import xxhash

    size = lambda t: len((t or "").split())
    leaf = lambda x: ("", x[2] or "", x[3] or "")

    def place(epoch, doc_id):
        h = 42
        for part in (struct.pack("<i", 17), struct.pack("<i", epoch), b"" if doc_id is None else str(doc_id).encode()):
            h = xxhash.xxh64_intdigest(part, seed=h)
        return h - (1 << 64) * (h >> 63)

    supply = Counter()
    for x in rows:
        supply[leaf(x)] += size(x[1])
    for share in (0.3, 0.7, 1.6):
        given, want = mixing.budgets(supply, ({}, {"en": 2.0}, {"s0": 0.5}), share * sum(supply.values()), 2), Counter()
        for k, amount in given.items():
            mine = [x for x in rows if leaf(x) == k]
            whole = min(2, int(amount // supply[k])) if supply[k] else 1
            want.update((x[0], x[1], e) for x in mine for e in range(whole))
            rest, by = int(amount - whole * supply[k]), {}
            for x in mine:
                by.setdefault(place(whole, x[0]), []).append(x)
            for at in sorted(by) if rest > 0 and whole < 2 else ():
                rest -= sum(size(x[1]) for x in by[at])
                if rest < 0:
                    break
                want.update((x[0], x[1], whole) for x in by[at])
        got = mixing.mix(docs, F.lit(""), ({}, {"en": 2.0}, {"s0": 0.5}), budget_share=share, max_epochs=2)
        assert Counter((r["doc_id"], r["text"], r["epoch"]) for r in got.select("row.doc_id", "row.text", "epoch").collect()) == want


def test_mixing_with_an_empty_prefix(spark):
    """A budget that ends in the first range, before its first document: nothing is picked, whatever the order."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g h i j").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    for share, n in ((2e-5, 0), (5e-5, 1), (1e-4, 2)):
        assert mixing.mix(docs, F.lit("d"), ({}, {}, {}), budget_share=share, max_epochs=1).count() == n


def test_mixing_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", "x", "y", "z")], "doc_id long, text string, lang string, source string, domain string, n_tokens string, epoch string")
    got = mixing.mix(docs, F.lit("d"), ({}, {}, {})).select("row.*").collect()
    assert got == docs.collect()
