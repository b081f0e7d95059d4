"""Collocations, whitening and neighbours on awkward rows, against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import collocations, hashing, whitening

DOCS = "doc_id long, text string, lang string, n long, phrase string, range int, suffix string"


def phrases_by_force(rows, max_n, least, covered, top):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(max_n, len(words) - i) + 1):
                    f[(lang, tuple(words[i : i + k]))] += 1
    cands = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    found = defaultdict(list)
    for (lang, p), a in cands.items():
        score, cut = min((1000 * a * n[lang] // (f[(lang, p[:k])] * f[(lang, p[k:])]), k) for k in range(1, len(p)))
        inside = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (m, q), b in cands.items() if m == lang)
        if not inside:
            found[lang].append((-score, -a, " ".join(p).encode(), " ".join(p), f[(lang, p[:cut])], f[(lang, p[cut:])], cut))
    out = set()
    for lang, rows_ in found.items():
        for rank, (s, a, _, p, left, right, cut) in enumerate(sorted(rows_)[:top], 1):
            out.add((lang, rank, p, -a, left, right, n[lang], -s, cut))
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    word = lambda: r.choice(["a", "b", "c", "New", "york", "the", "é", "漢", "\x01", "b\x01", "\x00x", "A\x7f", "it's"])
    rows = [("".join(word() + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!"]) for _ in range(r.randrange(1, 60))), r.choice(["en", "fr", None, "e", ""])) for _ in range(300)]
    rows += [("the new york times the new york times", "en")] * 40 + [(None, "en"), ("", None), (" \t\n.", "en"), ("x" * 50_000, "en"), ("the " * 9_000, "fr"), ("in one sentence. " * 30, "2:en")]
    return rows


@pytest.mark.parametrize(("least", "covered", "top", "parts", "cut"), [(5, 100, 2000, 1, 3 << 20), (9, 60, 7, 7, 3 << 20), (5, 100, 2000, 5, 700)])
def test_collocations_against_force(spark, texts, monkeypatch, least, covered, top, parts, cut):
    monkeypatch.setattr(collocations, "SLICE", cut)
    monkeypatch.setattr(collocations, "SAMPLED", 3)
    docs = spark.createDataFrame([(i, t, x, 1, "p", 1, "s") for i, (t, x) in enumerate(texts)], DOCS).repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = collocations.collocations(docs, least=least, covered=covered, top=top)
        assert {tuple(x) for x in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut").collect()} == phrases_by_force(texts, 5, least, covered, top)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_parts_overlap_by_the_words_a_suffix_needs(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 40)
    words = [f"w{i}" for i in range(100)]
    seen = []
    for part, starts in collocations._parts([" ".join(words).encode()], 5):
        part = part.to_pylist()
        seen += [tuple(part[i : i + 5]) for i in range(starts)]
    assert seen == [tuple(words[i : i + 5]) for i in range(100)]


def test_collocations_of_nothing(spark, texts):
    docs = spark.createDataFrame([], DOCS)
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, 1, "", 1, "")], DOCS)).count() == 0


def vectors(seed, n, d, flat=True):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d)) * (1 if flat else np.geomspace(9, 0.01, d))
    return x / np.sqrt(d)


ODD = [(900, None), (901, []), (902, [float("nan")] * 8), (903, [None] + [0.1] * 7), (904, [float("inf")] * 8), (905, [0.5] * 3), (None, [0.25] * 8)]
SCHEMA = "vec_id long, embedding array<double>, x long, row string, component string, h1 string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if c is None else float(c) for c in v], 5, "r", "c", "h") for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("flat", [True, False])
def test_whitening_against_numpy(spark, flat):
    x = vectors(3, 500, 8, flat)
    rows = [(i, list(v)) for i, v in enumerate(x)] + [(1000 + i, list(x[0])) for i in range(300)] + ODD
    got = whitening.whitened_rows(frame(spark, rows)).toPandas()
    kept = [(i, v) for i, v in rows if v is not None and len(v) == 8 and all(c is not None and math.isfinite(c) for c in v)]
    steps = np.floor(np.array([v for _, v in kept]) * 256)
    fit = np.unique(steps, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, parts = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, parts = values[::-1], parts[:, ::-1]
    want = (steps - s / n) @ parts[:, :4] / np.sqrt(values[:4])
    assert len(got) == 4 * len(kept) and set(got["n"]) == {n}
    for k in range(4):
        part = got[got["component"] == k + 1]
        assert np.allclose(part["explained"], values[k] / values.sum(), rtol=1e-9)
        named = {i if i == i else None: z for i, z in zip(part["vec_id"], part["whitened"], strict=True)}
        mine = np.array([named[i] for i, _ in kept])
        assert min(np.abs(mine - want[:, k]).max(), np.abs(mine + want[:, k]).max()) < 1e-8
    assert got["identity_error"].max() < 1e-9
    exact = {i: int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True))) for (i, _), v in zip(kept, steps, strict=True)}
    assert {(i if i == i else None): v for i, v in zip(got["vec_id"], got["deviation"], strict=True)} == exact


def test_a_steep_spectrum_ends_in_the_small_basis(spark):
    """What the range finder gives by itself equals the full dimension's answer."""
    x = vectors(4, 400, 40, False)
    rows = frame(spark, [(i, list(v)) for i, v in enumerate(x)])
    sizes = []
    added = whitening._added
    whitening._added = lambda fit, made, d: sizes.append(1) or added(fit, made, d)
    try:
        _, small = whitening.whiten(rows, powers=14)
        few = len(sizes)
        _, full = whitening.whiten(rows, oversample=36)
    finally:
        whitening._added = added
    assert few == 1 + 15 + 2  # the trace, the powers and the image, the check: no second basis
    assert np.allclose(small.eigenvalues, full.eigenvalues, rtol=1e-10)
    assert np.allclose(np.abs((small.components * full.components).sum(axis=0)), 1, atol=1e-9)


def test_whitening_of_little(spark):
    assert whitening.whitened_rows(frame(spark, [])).count() == 0
    assert whitening.whitened_rows(frame(spark, ODD[:5])).count() == 0
    assert whitening.whitened_rows(frame(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).count() == 0
    line = whitening.whitened_rows(frame(spark, [(i, [i / 4, i / 2, 0.0]) for i in range(5)])).toPandas()
    assert set(line["component"]) == {1} and np.allclose(line["explained"], 1)
    huge = whitening.whitened_rows(frame(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])])).toPandas()
    assert huge[huge["vec_id"] < 3]["deviation"].isna().all() and set(huge[huge["vec_id"] == 3]["deviation"]) == {1 + 768**2} and np.isfinite(huge["whitened"]).all()
    out, model = whitening.whiten(frame(spark, [(i, [i / 4, -i * i / 9]) for i in range(9)]))
    assert out.columns == ["row", "deviation", "whitened"] and out.select("row.component").distinct().collect()[0][0] == "c" and len(model.eigenvalues) == 2


def near_by_force(rows, k):
    kept = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(c is not None and math.isfinite(c) for c in v) and any(c != 0 for c in v)]
    out = []
    for a, (i, v) in enumerate(kept):
        if i % 50 == 0:
            u = v / np.abs(v).max()
            near = sorted((-float(round(u @ (w / np.abs(w).max()) / np.linalg.norm(u) / np.linalg.norm(w / np.abs(w).max()), 12)), j) for b, (j, w) in enumerate(kept) if b != a)[:k]
            out += [(i, rank, j, round(-m, 9)) for rank, (m, j) in enumerate(near, 1)]
    return Counter(out)


def test_neighbours_against_force(spark):
    """Ties, copies, scaled copies, one id twice."""
    x = vectors(5, 120, 8)
    rows = [(i, list(v)) for i, v in enumerate(x)] + [(200 + i, list(x[50])) for i in range(60)] + [(400, list(2 * x[3])), (450, [0.0] * 8), (500, [1e200 * c for c in x[7]]), (550, [1e-200 * c for c in x[7]])]
    rows += [(50, list(x[50])), (100, list(x[9]))] + ODD  # one id twice
    got = hashing.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, probability=1.0)
    mine = Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got.collect())
    want = near_by_force(rows, 5)
    hit = sum((mine & want).values())
    assert sum(mine.values()) == sum(want.values()) and hit >= 0.9 * sum(want.values())
    few = hashing.nearest(frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])]), F.col("vec_id") % 50 == 0).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in few] == [(1, 1, 0.0)]
    for rows in ([], ODD[:6], [(0, [1.0, 2.0])], [(1, [1.0, 2.0])]):
        assert hashing.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0).count() == 0


def test_probing_retrieves_every_code_within_the_radius():
    r = np.random.default_rng(8)
    code = r.integers(0, 1 << 16, (3000, 4)).astype(np.uint16)
    code[:500] = code[0] ^ (1 << r.integers(0, 16, (500, 4))).astype(np.uint16)
    index = hashing.Index(code)
    for q in (code[0], code[700], r.integers(0, 1 << 16, 4).astype(np.uint16)):
        apart = np.array([bin(int.from_bytes((c ^ q).tobytes(), "little")).count("1") for c in code])
        for radius in (0, 1, 3, 4, 6, 9, 17, 25, 40, 64):
            assert index.within(q, radius).tolist() == np.flatnonzero(apart <= radius).tolist()


@pytest.mark.parametrize("kind", ["none", "groups"])
def test_recall(spark, kind):
    """Vectors without any structure, the hardest case, and groups of near ones beside them."""
    r = np.random.default_rng(6)
    x = r.standard_normal((4000, 64))
    if kind == "groups":
        x[:2000] = x[r.integers(0, 40, 2000)] + 0.4 * x[:2000]
    rows = spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for row in hashing.nearest(rows, F.col("vec_id") % 50 == 0).collect():
        got[row["query_id"]].add(row["vec_id"])
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 4000, 50):
        s = u @ u[q]
        s[q] = -2
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    print("recall", kind, hits / 400)
    assert len(got) == 80 and all(len(v) == 5 for v in got.values()) and hits >= 0.95 * 400
