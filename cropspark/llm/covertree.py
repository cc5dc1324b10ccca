"""Exact cosine links of vectors by dual traversal of a cover tree.

On unit vectors a cosine of at least ``c`` is a distance of at most ``t = sqrt(2 - 2c)``. Each node has a centre and a covering radius, the
largest distance to anything below it. A pair of nodes further apart than both radii and ``t`` holds no link; a pair whose distance plus
both radii is at most ``t`` links throughout, and is counted without being expanded. All other pairs descend to their children.

- Equal vectors are one point with a count, so copies cost nothing.
- The order: nested nets with radii 1, 1/2, 1/4 of a bounded sample of points (``SAMPLE``); each point follows its nearest net point. The
  sample only decides which points stand next to each other, never what is compared.
- ``BLOCK`` points in a row form a block, which builds its own cover tree (nets with halving radii, nested). ``FANOUT`` blocks form a node above,
  and so on. Node pairs descend level by level by joins on node numbers; only surviving pairs of blocks bring their vectors together.
- Inside a pair of blocks the two trees are traversed at once; single precision only prunes, with a margin, and every link is decided in
  double precision. A task returns its points' link counts and a spanning forest of its links, never the pairs.

Vectors of different length don't compare. Where distances concentrate, as between random vectors of many dimensions, upper nodes can't be
pruned and the work is that of comparing blocks; the result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.llm.common import _ramp, tidy, with_offsets, written
from cropspark.llm.graph import components

SAMPLE, BLOCK, FANOUT = 1024, 4096, 64
RADII = (1.0, 0.5, 0.25)
#: More than single precision can be off in a product of unit vectors, and double precision in a radius.
LOOSE, TIGHT = 1e-4, 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; scaled by the largest part first, so that nothing overflows."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def nets(points: np.ndarray) -> np.ndarray:
    """For each point its net point at every radius (columns, coarse to fine). Nets are nested, a finer net point follows its nearest
    coarser one, and all points follow their nearest point of the finest net."""
    n = len(points)
    near = (points.astype(np.float32) @ points.astype(np.float32).T)
    chosen = np.zeros(n, bool)
    levels = []
    for radius in RADII:
        reach = 1 - radius * radius / 2
        covered = (near[:, chosen] >= reach).any(axis=1) if chosen.any() else np.zeros(n, bool)
        while not covered.all():
            i = int(np.argmin(covered))
            chosen[i] = True
            covered |= near[i] >= reach
            covered[i] = True
        levels.append(np.flatnonzero(chosen))
    out = np.zeros((n, len(RADII)), np.int64)
    below = np.arange(n)
    for k in range(len(RADII) - 1, -1, -1):
        centres = levels[k]
        own = np.unique(below)
        nearest = centres[near[np.ix_(own, centres)].argmax(axis=1)]
        itself = np.isin(own, centres)
        nearest[itself] = own[itself]
        below = nearest[np.searchsorted(own, below)]
        out[:, k] = below
    return out


class Tree:
    """Cover tree over the points of a block, which it puts in its own order: per level where nodes begin, their centres (places of
    points), exact covering radii and parents."""

    def __init__(self, points: np.ndarray, order: np.ndarray | None = None, levels: list | None = None):
        if levels is None:
            path = nets(points)
            order = np.lexsort((np.arange(len(points)), *path.T[::-1]))
            path = path[order]
            place = np.argsort(order)
            levels = []
            for k in range(len(RADII)):
                starts = np.flatnonzero(np.concatenate([[True], (np.diff(path[:, : k + 1], axis=0) != 0).any(axis=1)]))
                levels.append((starts, place[path[starts, k]]))
            points = points[order]
        self.points, self.order, n = points, order, len(points)
        self.levels, above = [], np.zeros(1, np.int64)
        for starts, centres in [*levels, (np.arange(n), np.arange(n))]:
            sizes = np.diff(np.concatenate([starts, [n]]))
            dots = np.einsum("ij,ij->i", points, np.repeat(points[centres], sizes, axis=0))
            radius = np.sqrt(np.maximum(np.maximum.reduceat(2 - 2 * dots, starts), 0)) + TIGHT
            radius[sizes == 1] = 0.0
            self.levels.append((starts, centres, radius, np.searchsorted(above, starts, side="right") - 1))
            above = starts
        self.single = points.astype(np.float32)


def _children(a: Tree, k: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First child and number of children at level k + 1 of nodes of level k."""
    starts, below = a.levels[k][0], a.levels[k + 1][0]
    ends = np.concatenate([starts[1:], [len(a.points)]])
    first = np.searchsorted(below, starts[nodes])
    return first, np.searchsorted(below, ends[nodes]) - first


def dual(a: Tree, b: Tree, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """Linked pairs of points (places), and ranges ``a from, to, b from, to`` that link throughout. For ``a is b`` each pair once."""
    t, same = float(np.sqrt(2 - 2 * threshold)), a is b
    gate, pairs = None, None
    # Levels with many nodes on both sides are judged densely in single precision, with the parents' verdicts as a gate.
    for k in (0, 1):
        (_, ca, ra, pa_), (_, cb, rb, pb_) = a.levels[k], b.levels[k]
        kept, verdict = [], np.zeros((len(ca), len(cb)), bool)
        for i in range(0, len(ca), 1024):
            dots = a.single[ca[i : i + 1024]] @ b.single[cb].T
            reach = (ra[i : i + 1024, None] + (rb + t)[None, :]).astype(np.float32)
            good = dots >= 1 - reach * reach / 2 - LOOSE
            good |= reach >= 2
            if gate is not None:
                good &= gate[pa_[i : i + 1024]][:, pb_]
            verdict[i : i + 1024] = good
            if k:
                x, y = np.nonzero(good)
                kept.append(np.stack([x + i, y]))
        gate = verdict
        pairs = np.concatenate(kept, axis=1) if kept else None
    linked, whole = [], []
    del gate
    for at in range(0, pairs.shape[1], 50_000):
        x, y = pairs[:, at : at + 50_000]
        if same:
            x, y = x[x <= y], y[x <= y]
        for k in (1, 2, 3):
            (sa, ca, ra, _), (sb, cb, rb, _) = a.levels[k], b.levels[k]
            far = []
            for i in range(0, len(x), 50_000):
                far.append(np.einsum("ij,ij->i", a.points[ca[x[i : i + 50_000]]], b.points[cb[y[i : i + 50_000]]]))
            dots = np.concatenate([np.zeros(0), *far])
            if k == 3:
                keep = (dots >= threshold) & ((x != y) if same else True)
                linked.append(np.stack([x[keep], y[keep]]))
                break
            apart, radii = np.sqrt(np.maximum(2 - 2 * dots, 0)), ra[x] + rb[y]
            full = (apart + radii <= t - 1e-7) & ((ra[x] > 0) | (rb[y] > 0))
            ends_a, ends_b = np.concatenate([sa[1:], [len(a.points)]]), np.concatenate([sb[1:], [len(b.points)]])
            whole += zip(sa[x[full]].tolist(), ends_a[x[full]].tolist(), sb[y[full]].tolist(), ends_b[y[full]].tolist(), strict=True)
            go = ~full & (apart <= radii + t + 1e-7)
            x, y = x[go], y[go]
            (fa, na), (fb, nb) = _children(a, k, x), _children(b, k, y)
            many = na * nb
            step = _ramp(many)
            nbr = np.repeat(nb, many)
            cx, cy = np.repeat(fa, many) + step // nbr, np.repeat(fb, many) + step % nbr
            if same:
                cx, cy = cx[cx <= cy], cy[cx <= cy]
            x, y = cx, cy
    both = np.concatenate(linked, axis=1) if linked else np.zeros((2, 0), np.int64)
    return both[0], both[1], whole


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest place that links lead to, of each of n places."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def block_links(blocks: list[dict], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``id, links, root`` of the points of one block, or of two against each other, that have links."""
    trees = [Tree(b["points"], levels=b["levels"]) for b in blocks]
    a, b = trees[0], trees[-1]
    x, y, whole = dual(a, b, threshold)
    ids, copies = (np.concatenate([blk[c] for blk in blocks]) for c in ("ids", "copies"))
    shift = 0 if a is b else len(a.points)
    n = np.zeros(len(ids) + 1, np.int64)
    np.add.at(n, x, copies[y + shift])
    np.add.at(n, y + shift, copies[x])
    sums = np.concatenate([[0], np.cumsum(copies)])
    more = np.zeros(len(ids) + 1, np.int64)
    edges = [(x, y + shift)]
    for a0, a1, b0, b1 in whole:
        b0, b1 = b0 + shift, b1 + shift
        own, other = sums[a1] - sums[a0], sums[b1] - sums[b0]
        more[a0] += other
        more[a1] -= other
        if (a0, a1) == (b0, b1):
            n[a0:a1] -= copies[a0:a1]
        else:
            more[b0] += own
            more[b1] -= own
        edges.append((np.arange(a0, a1), np.full(a1 - a0, b0)))
        edges.append((np.arange(b0, b1), np.full(b1 - b0, a0)))
    n = (n + np.cumsum(more))[:-1]
    root = _forest(len(ids), *(np.concatenate(e) for e in zip(*edges, strict=True)))
    some = n > 0
    return ids[some], n[some], ids[root[some]]


def _array(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _levels_of(tree: Tree) -> bytes:
    return b"".join(np.concatenate([[len(s)], s, c]).astype("<i4").tobytes() for s, c, _, _ in tree.levels[:-1])


def _levels_from(data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    numbers, out, at = np.frombuffer(data, "<i4").astype(np.int64), [], 0
    for _ in RADII:
        n = int(numbers[at])
        out.append((numbers[at + 1 : at + 1 + n], numbers[at + 1 + n : at + 1 + 2 * n]))
        at += 1 + 2 * n
    return out


def point_links(points: DataFrame, threshold: float) -> DataFrame:
    """``id, n, root`` for points ``id, copies, embedding`` of one length: link counts and spanning links of each task."""
    spark = points.sparkSession
    sample = points.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()
    if not len(sample):
        return spark.createDataFrame([], "id long, n long, root long")
    pivots = unit(_array(sample["embedding"]))
    path = nets(pivots)
    finest = np.unique(path[:, -1])
    rank = np.zeros(len(pivots), np.int64)
    rank[finest[np.lexsort(path[finest].T[::-1])]] = np.arange(len(finest))
    centres, kind = pivots[finest], points.schema["embedding"].dataType.simpleString()
    schema = f"id long, copies long, embedding {kind}, node int, far float"

    def place(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                dots = unit(_array(pa.chunked_array([part.column("embedding")]))) @ centres.T
                best = dots.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rank[finest[best]].astype(np.int32)), pa.array((1 - dots.max(axis=1)).astype(np.float32))], ["id", "copies", "embedding", "node", "far"])

    placed = with_offsets(points.select("id", "copies", "embedding").mapInArrow(tidy(place), schema), ["node", "far", "id"], "copies", "_start", "_row").withColumn("block", F.floor(F.col("_row") / BLOCK))
    single = "float" in kind
    block_schema = "block long, centre array<double>, radius double, ids array<long>, copies array<long>, vectors binary, levels binary"

    def build(rows: pa.Table) -> pa.Table:
        raw = _array(rows["embedding"])
        tree = Tree(unit(raw))
        mean = unit(tree.points.mean(axis=0, keepdims=True) + 1e-300)[0]
        radius = float(np.sqrt(max(0.0, (2 - 2 * (tree.points @ mean)).max()))) + TIGHT
        ids, copies = (rows[c].to_numpy()[tree.order] for c in ("id", "copies"))
        return pa.table({"block": [rows["block"][0].as_py()], "centre": [mean.tolist()], "radius": [radius], "ids": [ids.tolist()], "copies": [copies.tolist()], "vectors": pa.array([raw[tree.order].astype("<f4" if single else "<f8").tobytes()], pa.binary()), "levels": pa.array([_levels_of(tree)], pa.binary())})

    blocks = written(placed.select("block", "id", "copies", "embedding").groupBy("block").applyInArrow(build, block_schema))

    def merge(rows: pa.Table) -> pa.Table:
        inner = _array(rows["centre"])
        mean = unit(inner.mean(axis=0, keepdims=True) + 1e-300)[0]
        far = np.sqrt(np.maximum(0, 2 - 2 * (inner @ mean))) + rows["radius"].to_numpy()
        return pa.table({"node": [rows["up"][0].as_py()], "centre": [mean.tolist()], "radius": [float(far.max()) + TIGHT]})

    levels = [blocks.select(F.col("block").alias("node"), "centre", "radius")]
    while levels[-1].count() > FANOUT:
        levels.append(written(levels[-1].withColumn("up", F.floor(F.col("node") / FANOUT)).groupBy("up").applyInArrow(merge, "node long, centre array<double>, radius double")))
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-7
    dot = F.aggregate(F.zip_with("ca", "cb", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    def judged(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        left, right = (nodes.select(F.col("node").alias(x), F.col("centre").alias(f"c{x}"), F.col("radius").alias(f"r{x}")) for x in "ab")
        near = (F.col("a") == F.col("b")) | (F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)) <= F.col("ra") + F.col("rb") + reach)
        return pairs.join(left, "a").join(right, "b").filter(near).select("a", "b")

    top = levels[-1].select(F.col("node").alias("a")).withColumn("b", F.explode(F.sequence("a", F.lit(FANOUT - 1).cast("long"))))  # FANOUT nodes at most
    pairs = judged(top, levels[-1])
    for nodes in levels[-2::-1]:
        down = [F.sequence(F.col(x) * FANOUT, F.col(x) * FANOUT + FANOUT - 1) for x in "ab"]
        pairs = judged(written(pairs).select(F.explode(down[0]).alias("a"), down[1].alias("bs")).select("a", F.explode("bs").alias("b")).filter("a <= b"), nodes)
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block")).join(blocks, "block")

    def search(rows: pa.Table) -> pa.Table:
        found = []
        for row in rows.sort_by("block").to_pylist():
            raw = np.frombuffer(row["vectors"], "<f4" if single else "<f8").reshape(len(row["ids"]), -1)
            found.append({"points": unit(raw), "ids": np.array(row["ids"]), "copies": np.array(row["copies"]), "levels": _levels_from(row["levels"])})
        ids, n, root = block_links(found, threshold)
        return pa.table({"id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "root": pa.array(root, pa.int64())})

    return written(sides.select("a", "b", "block", "ids", "copies", "vectors", "levels").groupBy("a", "b").applyInArrow(search, "id long, n long, root long"))


def linked_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding``.

    ``n_links`` counts the other rows with a cosine of at least ``threshold``, equal ones included; ``component_id`` is the smallest
    ``vec_id`` that links lead to. Vectors that are missing, empty or zero, or hold missing or non-finite parts, link with nothing. Rows with
    equal ``vec_id`` are one vertex with as many vectors; rows without one are in no component and link with nothing.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(sound & F.col("vec_id").isNotNull(), F.lit(False)))
    points = written(rows.filter("ok").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    dims = [r[0] for r in points.select(F.size("embedding")).distinct().collect()]
    found = [point_links(points.filter(F.size("embedding") == d), threshold) for d in dims] or [points.sparkSession.createDataFrame([], "id long, n long, root long")]
    links = found[0]
    for more in found[1:]:
        links = links.unionAll(more)
    labels = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    known = points.join(counts, "id", "left").join(labels, "id", "left").select("embedding", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    good = rows.filter("ok").join(known, "embedding").select("vec_id", "n_links", "component_id")
    bad = rows.filter("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionAll(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
