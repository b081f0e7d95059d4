"""The pipeline's stages one by one against plain versions, on the smallest tables."""

from collections import Counter

from pyspark.sql.types import LongType, StringType, StructField, StructType

import corpus_pipeline as pipeline
from riskloom.llm import minhash
from riskloom.llm.base import table
from tests.llm.test_operators import SCHEMA, bag, classes_by_force, lines_by_force, overlap, pieces_hold, rows  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    kept = []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append((docs.collect(), after.collect()))
        if name != pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        docs = after
    (before, after), lines, near, mixed, packed = kept
    assert {r["doc_id"] for r in after} < {r["doc_id"] for r in before}
    want = lines_by_force([(r["doc_id"], r["text"]) for r in lines[0]])
    assert Counter((r["doc_id"], r["text"]) for r in lines[1]) == Counter((d, t) for (d, _), t in want.items() if t.strip() or _ == t)
    classes = classes_by_force([(r["doc_id"], r["text"]) for r in near[0]])
    assert {r["doc_id"] for r in near[1]} == {c for _, c in classes} and len(near[1]) == len({c for _, c in classes})
    assert 0.5 < sum(len(r["text"].split()) for r in mixed[1]) / sum(len(r["text"].split()) for r in mixed[0]) <= pipeline.MIX_SHARE
    pieces_hold(packed[1], [(r["doc_id"], r["text"]) for r in packed[0]])


def test_run_equals_its_stages(spark):
    assert pipeline.run(spark, SF).count() > 0
    assert pipeline.run(spark, SF).columns[0] == "doc_id"


def test_near_duplicate_stage_on_odd_ids(spark, rows):
    """Missing and repeated ids: of each class one document stays, and no text without a copy goes."""
    far = ["no id and words of its own", "one id for three", "different texts, the second", "and the third of them"]
    odd = [x for x in rows if len(x[1] or "") < 100_000]
    odd += [(None, far[0], "en", "s1"), (7, far[1], "en", "s1"), (7, far[2], "en", "s1"), (7, far[3], "en", "s1"), (None, odd[0][1], "en", "s1"), (300, far[0], "en", "s1")]
    docs = spark.createDataFrame([(*x, len(x[1] or ""), "r", "h", "w", "l") for x in odd], SCHEMA).repartition(3)
    got = pipeline.near_duplicate_stage(spark, docs, "").collect()
    bags = [bag(t) for _, t, *_ in odd if t is not None]
    texts = [(d, t) for d, t, *_ in odd if t is not None]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if root[a] != root[b] and overlap(bags[a], bags[b]) >= 0.8:
                root = [root[b] if r == root[a] else r for r in root]
    first = {}
    for r, (d, t) in zip(root, texts, strict=True):
        first.setdefault(r, []).append((d is not None, d or 0))
    kept = Counter(root[texts.index((r["doc_id"], r["text"]))] for r in got if r["text"] is not None)
    assert kept == Counter(set(root))
    assert all((r["doc_id"] is not None, r["doc_id"] or 0) == min(first[root[texts.index((r["doc_id"], r["text"]))]]) for r in got if r["text"] is not None)
    assert Counter(r["doc_id"] for r in got if r["text"] is None) == Counter(d for d, t, *_ in odd if t is None)
    assert {*far, "other text of five"} <= {r["text"] for r in got}
    classes = Counter(map(tuple, minhash.near_duplicates(docs).collect()))
    assert classes == classes_by_force(odd)


ODD = ("my-col", "b c", "x.y", "a`b", "_row", "hash", "_kept", "leaf", "Clean_Text")


def oddly(spark, given):
    """Rows with a column under each of the names in ODD, over three partitions."""
    names = [*("doc_id", "text", "lang", "source", "n_chars"), *ODD]
    kinds = StructType([StructField(n, LongType() if n in ("doc_id", "n_chars") else StringType()) for n in names])
    return spark.createDataFrame([(*x, len(x[1] or ""), *(f"{n}{i % 2}" for n in ODD)) for i, x in enumerate(given)], kinds).repartition(3)


def test_stages_on_odd_rows(spark, rows):
    """Nulls, empty texts, repeated rows and ids, and columns of any name, through each stage alone."""
    docs = oddly(spark, rows)
    before = docs.collect()
    extra = lambda got: Counter(tuple(r)[5:] + (r["doc_id"], r["lang"], r["source"]) for r in got)
    out = {}
    for name, stage in pipeline.STAGES:
        df = stage(spark, docs, "")
        out[name] = df.collect()
        if name != "packing":
            assert df.columns == docs.columns
            assert extra(out[name]) <= extra(before)
            assert all(r["n_chars"] == len(r["text"] or "") for r in out[name])
    # quality: row by row, and no text without words
    base = [r["text"] for r in out["quality"]]
    assert all(t and len(t.split()) >= 1 for t in base)
    assert sum(r["doc_id"] == 100 for r in out["quality"]) in (0, 2)
    # line dedup: as by force; null and blank texts as they were
    want = lines_by_force([(d, t) for d, t, *_ in rows])
    assert Counter((r["doc_id"], r["text"]) for r in out["line dedup"]) == Counter(
        (d, want[(d, t)] if t is not None else None) for d, t, *_ in rows if t is None or want[(d, t)].strip() or want[(d, t)] == t
    )
    # near duplicates: all null texts, one text without words, the repeated row once
    near = out["near duplicates"]
    assert sum(r["text"] is None for r in near) == sum(t is None for _, t, *_ in rows)
    assert sum(r["text"] is not None and not r["text"].split() for r in near) == 1
    assert sum(r["doc_id"] in (100, 101, 102, 103) for r in near) == 1 and sum(r["doc_id"] == 5 for r in near) == 2
    # mixing: rows of one id together, no row twice
    for i in (5, 100, None):
        assert sum(r["doc_id"] == i for r in out["mixing"]) in (0, sum(d == i for d, *_ in rows)) or i == 5  # its two texts are of two leaves
    assert Counter(map(tuple, out["mixing"])) <= Counter(map(tuple, before))
    pieces_hold(out["packing"], [(d, t) for d, t, *_ in rows])


def test_stages_on_an_empty_table(spark, rows):
    none = oddly(spark, rows).limit(0)
    for name, stage in pipeline.STAGES:
        df = stage(spark, none, "")
        assert df.collect() == [] and (name == "packing" or df.columns == none.columns)
