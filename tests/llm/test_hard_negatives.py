"""Hard negatives against brute force, over rounds and blocks of several sizes, and awkward tables."""

import math
import random

import pytest

from framelight.llm import hard_negatives

ROWS = "vec_id bigint, embedding array<float>, label int, rank int, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "x") for i, v, y in rows], ROWS)


def slow(rows, every=50, low=50, high=95):
    good = {(i, y, tuple(math.floor(256 * x) for x in v)) for i, v, y in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * z for x, z in zip(a, b, strict=False))
    out = []
    for i, y, v in good:
        if i % every:
            continue
        order = sorted(((-dot(v, w), j, z) for j, z, w in good if j != i))
        positive = [(-s, j) for s, j, z in order if z == y][:5]
        for p, j in positive:
            fit = [(-s, n) for s, n, z in order if z != y and low * p <= 100 * -s <= high * p][:3]
            out += [(i, j, r, n, p, s) for r, (s, n) in enumerate(fit, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 50)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0.2, 1) for _ in range(6)], rng.randrange(3)) for i in range(600)]
    rows += [(1000 + i, rows[i % 5][1], rng.randrange(3)) for i in range(200)]  # one vector often
    rows += [(50, rows[50][1], rows[50][2])] * 3  # repeated rows
    want = slow(rows)
    assert len(want) > 100
    df = hard_negatives.mine(table(spark, rows), round_bytes=size * 6 * 8)
    assert got(df) == want


def test_awkward_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.7, 0.1], 2), (3, [0.7, 0.1], 2), (4, None, 2), (5, [None, 1.0], 2), (6, [float("nan"), 1.0], 2),
        (7, [float("inf"), 1.0], 2), (None, [0.7, 0.1], 2), (8, [0.7, 0.1], None), (9, [0.7], 3), (100, [-1.0, 0.0], 5), (150, [-0.9, 0.1], 5), (200, [], 7)]
    assert got(hard_negatives.mine(table(spark, rows))) == slow(rows)
    assert (0, 1, 1, 2, 65536, 45824) in slow(rows)


def test_an_id_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.6, 0.8], 2), (3, [0.9, 0.3], 2)]
    assert got(hard_negatives.mine(table(spark, rows))) == slow(rows)


def test_numbers_beyond_doubles(spark):
    big = float(1 << 22)
    rows = [(0, [big, 1.0], 1), (1, [big, 3.0], 1), (2, [big * 0.75, 1.0], 2), (3, [big * 0.75, 1.25], 2)]
    assert got(hard_negatives.mine(table(spark, rows))) == slow(rows)


def test_nothing(spark):
    assert got(hard_negatives.mine(table(spark, []))) == []
    assert got(hard_negatives.mine(table(spark, [(1, [1.0], 1), (2, [1.0], 2)]))) == []
    assert got(hard_negatives.mine(table(spark, [(0, [1.0], 1), (2, [1.0], 2)]))) == []
