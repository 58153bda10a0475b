"""Vector codes against point-by-point Lloyd rounds."""

import math
import random

import numpy as np
import pytest

from tidemark.llm import vector_codes


def brute(rows):
    """By id the code and the error, and the codebooks."""
    rows = [r for r in rows if r[1] is not None and len(r[1]) == 16 and all(x is not None and math.isfinite(x) for x in r[1])]
    points = [[math.floor(4096 * x) for x in r[1]] for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    books = [[points[i][2 * p : 2 * p + 2] for i in order[:16]] for p in range(8)]

    def near(p, x):
        far = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(6):
        for p in range(8):
            groups = {}
            for x in points:
                part = x[2 * p : 2 * p + 2]
                groups.setdefault(near(p, part)[0], []).append(part)
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    found = [[near(p, x[2 * p : 2 * p + 2]) for p in range(8)] for x in points]
    return [(r[0], r[2], "".join(f"{c:02x}" for c, _ in f), sum(d for _, d in f)) for r, f in zip(rows, found, strict=True)], books


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, vector array<double>, label string, code int, of string")


def vectors(scale, seed=3):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, 1), 1) * scale for _ in range(16)], rng.choice([None, "a", "b"])) for i in range(200)]
    return rows + [(900 + i, [0.1 * scale] * 16, "c") for i in range(60)]  # ties and one common vector


@pytest.mark.parametrize("scale", [1, 30, 3e4])
def test_codes_equal_point_by_point_rounds(spark, scale):
    odd = [(500, None, "a"), (501, [None] * 16, "a"), (502, [float("nan")] * 16, "a"), (503, [float("-inf")] * 16, None), (504, [1.0] * 8, "a"), (505, [], "a"), (None, [0.5] * 16, "z")]
    rows = vectors(scale) + odd + vectors(scale)[:5]
    want, books = brute(rows)
    got = vector_codes.compress_vectors(table(spark, rows).repartition(3)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error) for r in got) == sorted((i is None, i or 0, c, e) for i, _, c, e in want)
    assert {r.codebooks_sha256 for r in got} == {vector_codes.codebooks_digest([np.array(b, object) for b in books])}
    by_label = {}
    for _, label, _, error in want:
        by_label[label] = by_label.get(label, 0) + error
    label_of = {r[0]: r[2] for r in rows}
    assert all(r.label_error == by_label[label_of[r.vec_id]] for r in got)


def test_salted_labels_few_rows_and_huge_values(spark, monkeypatch):
    rows = vectors(1)
    plain = sorted(vector_codes.compress_vectors(table(spark, rows)).collect())
    monkeypatch.setattr(vector_codes, "LABELS_BROADCAST", 0)
    assert sorted(vector_codes.compress_vectors(table(spark, rows)).collect()) == plain
    assert [(r.vec_id, r.error) for r in vector_codes.compress_vectors(table(spark, rows[:1])).collect()] == [(0, 0)]
    assert vector_codes.compress_vectors(table(spark, rows).limit(0)).collect() == []
    far = [(i, [(-1.0) ** i * 1e300] * 16, "a") for i in range(40)]
    assert {r.error for r in vector_codes.compress_vectors(table(spark, far)).collect()} == {0}


def test_walks_agree_with_all_distances():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 8, 9, 100, 1000):
        points = rng.integers(-5, 6, (n, 3))
        book = points[rng.integers(0, n, 9)]
        far = ((points[:, None, :] - book[None]) ** 2).sum(-1)
        tree = vector_codes.Tree(points)
        entry, distance = tree.nearest(book)
        assert (entry == far.argmin(1)).all() and (distance == far.min(1)).all()
        total, count = tree.sums(book)
        assert (count == np.bincount(far.argmin(1), minlength=9)).all()
        assert all((total[k] == points[far.argmin(1) == k].sum(0)).all() for k in range(9))
