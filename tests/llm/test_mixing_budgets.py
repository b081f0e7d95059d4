"""Budgets of random trees against plain water-filling, with weights of 0 and empty leaves; rows of one document."""

import random

import pytest

from riskloom.llm import minhash, mixing


def poured(supply, weights, budget, most):
    """The same by small steps: each drop goes down to the open child furthest below its share at every level."""

    def capacity(node, depth):
        if depth == len(weights):
            return most * supply[node]
        return sum(capacity(c, depth + 1) for c in children(node) if weights[depth].get(c[-1], 1.0) > 0)

    def children(node):
        return sorted({leaf[: len(node) + 1] for leaf in supply if leaf[: len(node)] == node})

    def pour(node, amount):
        if len(node) == len(weights):
            return {node: amount}
        kids = children(node)
        w = {c: weights[len(node)].get(c[-1], 1.0) for c in kids}
        room = {c: capacity(c, len(node) + 1) for c in kids}
        # the water level by bisection: every child takes level * weight, up to its room
        lo, hi = 0.0, 1e12
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(room[c], mid * w[c]) for c in kids if w[c] > 0) < amount else (lo, mid)
        return {k: v for c in kids for k, v in pour(c, min(room[c], lo * w[c]) if w[c] > 0 else 0.0).items()}

    return pour((), amount=min(budget, capacity((), 0)))


@pytest.mark.parametrize("seed", range(30))
def test_budgets_against_water_filling(seed):
    r = random.Random(seed)
    supply = {(f"d{r.randrange(3)}", f"l{r.randrange(3)}", f"s{r.randrange(3)}"): r.choice([0, 3, 50, 400, 1000]) for _ in range(r.randrange(1, 14))}
    weights = [{f"{x}{i}": r.choice([0.0, 0.5, 1.0, 3.0]) for i in range(3)} for x in "dls"]
    budget = r.choice([0, 10, 500, 3000, 10**6])
    got, want = mixing.budgets(supply, weights, budget, 2), poured(supply, weights, budget, 2)
    assert set(got) == set(want) == set(supply)
    for leaf, amount in want.items():
        assert min(got[leaf], 2 * supply[leaf]) == pytest.approx(amount, abs=1e-3)


def test_nothing_is_lost_below_a_weight_of_zero():
    supply = {("d0", "bad", "s"): 5000, ("d0", "en", "s"): 10, ("d1", "en", "s"): 1000}
    got = mixing.budgets(supply, ({}, {"bad": 0.0}, {}), 1005, 1)
    assert got[("d0", "bad", "s")] == 0 and got[("d0", "en", "s")] == 10 and got[("d1", "en", "s")] == pytest.approx(995)


def test_one_row_stays_of_a_document_given_twice(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "s1"), (1, text, "de", "s2"), (1, text, "de", "s2"), (2, text + " more", "en", "s0"), (None, None, "en", "s0"), (None, None, "en", "s0")]
    for n in (1, 3, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(n)
        got = sorted(map(str, minhash.first_documents(docs).collect()))
        assert len(got) == 3
        assert n == 1 or got == first
        first = got
