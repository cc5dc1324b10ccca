"""Clusters and hard negatives of vectors against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from cropspark.llm import negatives, vafile

from .conftest import SF


@pytest.fixture(scope="module")
def vectors(spark):
    """Groups of vectors with ties, copies, repeated rows and everything that takes no part."""
    rng = random.Random(5)
    centres = [[rng.gauss(0, 0.3) for _ in range(64)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in centres[i % 6]], i % 4) for i in range(300)]
    rows += [(400 + k, list(rows[7][1]), k % 3) for k in range(60)]
    rows += [(500, [0.0] * 64, 1), (501, None, 1), (502, [0.5] * 63 + [None], 1), (503, [float("nan")] * 64, 1), (504, [float("inf")] * 64, 1), (505, [1e9] * 64, 2), (550, [0.25] * 32, 1), (551, [0.5] * 32, 1), (552, [0.3] * 32, 2), (506, [], 0), (None, [0.1] * 64, 1), (507, [0.1] * 64, None)]
    rows += [rows[50], rows[50], rows[200]]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(i, v, lab, 0, "x") for i, v, lab in rows], "vec_id long, embedding array<double>, label int, cluster int, rank string").repartition(5)
    return rows, frame


def integers(v):
    return [math.floor(256 * x) for x in v]


def plain_clusters(rows, k, rounds):
    kept = [(i, integers(v)) for i, v, _ in rows if v is not None and len(v) == 64 and all(x is not None and abs(x) < vafile.LARGEST for x in v)]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [list(v) for _, v in seeds]
    near = lambda v: min((sum((x - c) ** 2 for x, c in zip(v, cen, strict=True)), n) for n, cen in enumerate(centroids))
    for _ in range(rounds):
        found = [near(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            if own := [v for (_, v), f in zip(kept, found, strict=True) if f == n]:
                centroids[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    inertia = {n: sum(d for _, c, d in out if c == n) for _, n, _ in out}
    return sorted(((i is None, i or 0), c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in out)


@pytest.mark.parametrize(("k", "rounds"), [(40, 5), (3, 2), (1000, 1)])
def test_clusters(vectors, k, rounds):
    rows, frame = vectors
    got = sorted(((r.vec_id is None, r.vec_id or 0), *r[1:]) for r in vafile.clustered(frame, k, rounds).collect())
    assert got == plain_clusters(rows, k, rounds)


def test_clusters_of_few_rows(vectors):
    _, frame = vectors
    assert vafile.clustered(frame.limit(0)).count() == 0 and vafile.clustered(frame.filter("vec_id IS NULL")).count() == 0
    alone = vafile.clustered(frame.filter("vec_id = 11")).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in alone] == [(11, 0, 0, 0)]


def test_intervals_hold_and_few_are_fetched(vectors):
    rows = np.array([integers(v) for i, v, _ in vectors[0] if i is not None and i < 300])
    edges = np.quantile(rows, np.arange(1, 64) / 64, axis=0, method="higher").T.astype(np.int64)
    cells = vafile.Cells(edges, rows.min(axis=0), rows.max(axis=0))
    packed = cells.pack(rows)
    assert {len(p) for p in packed} == {48}
    centroids = rows[:6]
    tables, numbers = vafile.Tables(cells, centroids), cells.unpack(packed)
    low, high = tables.intervals(numbers)
    middle = centroids.sum(axis=0) // 6
    exact = ((rows[:, None] - centroids[None]) ** 2).sum(axis=2) - ((rows - middle) ** 2).sum(axis=1, keepdims=True)
    assert (low <= exact).all() and (exact <= high).all()
    best, fetched = tables.nearest(numbers, rows)
    assert (best == exact.argmin(axis=1)).all() and fetched < len(rows) / 2


def plain_negatives(rows):
    kept = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, integers(v)) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and abs(x) < vafile.LARGEST for x in v)]
    out = []
    for a, (i, lab, v) in enumerate(kept):
        if i % 50:
            continue
        score = [sum(x * y for x, y in zip(v, w, strict=True)) if len(w) == len(v) and b != a else None for b, (_, _, w) in enumerate(kept)]
        near = lambda same: sorted((-s, kept[b][0], b) for b, s in enumerate(score) if s is not None and (kept[b][1] == lab) == same)
        for p, positive, _ in near(True)[:5]:
            fit = [(n, other) for n, other, _ in near(False) if 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(i, positive, k + 1, other, -p, -n) for k, (n, other) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize(("block", "anchors"), [(8192, 1024), (40, 3)])
def test_hard_negatives(vectors, monkeypatch, block, anchors):
    monkeypatch.setattr(negatives, "ROWS", block)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    rows, frame = vectors
    got = negatives.hard_negatives(frame)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted(map(tuple, got.collect()))
    assert found == plain_negatives(rows) and len(found) > 30
    assert negatives.hard_negatives(frame.limit(0)).count() == 0


def test_code_intervals_are_certain(vectors):
    rows = np.array([integers(v) for i, v, _ in vectors[0] if i is not None and i < 500])
    coded, aligned, left = negatives.codes(rows)
    block = type("B", (), {"codes": coded, "aligned": aligned, "left": left, "length": np.sqrt((rows**2.0).sum(axis=1))})
    planes, exact = negatives.Planes(rows[:20]), rows[:20] @ rows.T
    widths = []
    for stages in (1, negatives.COARSE, negatives.STAGES):
        a, r = np.arange(20)[:, None], np.arange(len(rows))[None]
        value, off = planes.estimate(block, a, r, range(stages))
        width = off + planes.residual(block, a, r, stages - 1)
        assert (np.abs(value - exact) <= width).all()
        widths.append(width.mean())
    assert widths[2] < widths[1] / 3 < widths[0] / 9


def test_vectors_of_the_tables(spark):
    """Clusters and negatives of single-precision vectors with plain integer products."""
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in frame.collect()]
    assert sorted(map(tuple, negatives.hard_negatives(frame).collect())) == plain_negatives(rows)
