"""Hard negatives of anchors by rotated one-bit codes with stored alignments, and exact integer scores where their intervals leave it open.

A vector is rotated (random signs and Walsh-Hadamard transforms, from a fixed seed) and kept as the signs of its rotated components: its code. With
it is stored the alignment, the product of the vector and its code's unit vector. What the code misses is rotated again and coded in the same way,
``STAGES`` times, so a vector is the sum of alignments times code vectors and a residual, whose length is stored, too.

The product of an anchor and a vector is then estimated without the vector: the anchor's rotated components, in steps of ``2^-PLANES`` of their
range, are bit planes, and each code's share is a popcount of the code and every plane. By Cauchy and Schwarz the residual adds at most
its length times the anchor's, and the steps add at most their own sum; both are computed, so the interval is certain, not likely. Vectors are
first judged by ``COARSE`` codes, then by all; only those whose interval still matters are scored in integers.

- Positives: of each block of vectors the rows of the anchor's label whose upper end reaches the smallest of the best lower ends.
- Negatives: rows of other labels whose interval meets the window of a positive, and reaches the best lower ends that are surely inside it.
- Blocks of ``ROWS`` vectors (in the order of a hash) meet blocks of ``ANCHORS`` anchors; every pair of blocks is one group of a shuffle, so neither
  a label with a third of all rows nor a group of equal vectors is ever in one task. Each pair of blocks returns its exact best few, and the
  best of all are ranked in a second step.

``rows`` needs ``vec_id, label, embedding``. Rows without ``vec_id`` or label, and with vectors that are missing, empty, or hold missing, non-finite
or too large components (``vafile.LARGEST``: scores must fit a long), take no part. Vectors of different lengths don't compare. Repeated rows are rows of
their own: each repeated anchor has its own result rows, and its copies are other rows. Anchors with no positive, and positives with
nothing in the window, have no result rows; neither have no rows at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropspark.llm.common import tidy, written
from cropspark.llm.vafile import LARGEST, matrix, whole_components

STAGES, COARSE, PLANES = 8, 4, 7
ROWS, ANCHORS = 8192, 4096
#: Pairs of vectors that are held at a time.
PAIRS = 1 << 19
#: What double precision can be off, as a share of the product of both lengths.
LOOSE = 1e-9


def rotate(rows: np.ndarray, stage: int) -> np.ndarray:
    """A fixed rotation of rows whose length is a power of two."""
    n, d = rows.shape
    rng = np.random.default_rng(stage + 1)
    for _ in range(2):
        rows = rows * rng.choice([-1.0, 1.0], d)
        width = 1
        while width < d:
            pair = rows.reshape(n, d // (2 * width), 2, width)
            rows = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, d)
            width *= 2
        rows = rows / np.sqrt(d)
    return rows


def padded(rows: np.ndarray) -> np.ndarray:
    """Rows as doubles, with zeros up to a power of two of at least 64."""
    d = max(64, 1 << int(np.ceil(np.log2(max(1, rows.shape[1])))))
    return np.concatenate([rows.astype(np.float64), np.zeros((len(rows), d - rows.shape[1]))], axis=1)


def words(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def codes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows x stages x words), alignments (rows x stages) and lengths of what all codes up to each stage miss."""
    rest = padded(rows)
    n, d = rest.shape
    out, aligned, left = np.zeros((n, STAGES, d // 64), np.uint64), np.zeros((n, STAGES)), np.zeros((n, STAGES))
    for s in range(STAGES):
        rest = rotate(rest, s)
        positive = rest >= 0
        out[:, s], aligned[:, s] = words(positive), np.abs(rest).sum(axis=1) / np.sqrt(d)
        rest = rest - np.where(positive, 1.0, -1.0) * (aligned[:, s : s + 1] / np.sqrt(d))
        left[:, s] = np.sqrt((rest * rest).sum(axis=1))
    return out, aligned, left


class Planes:
    """Anchors as bit planes of their rotated components, for each stage."""

    def __init__(self, rows: np.ndarray):
        turned = padded(rows)
        n, d = turned.shape
        self.length = np.sqrt((turned * turned).sum(axis=1))
        self.planes = np.zeros((STAGES, PLANES, n, d // 64), np.uint64)
        self.base, self.step, self.sum, self.off = (np.zeros((STAGES, n)) for _ in range(4))
        for s in range(STAGES):
            turned = rotate(turned, s)
            base = turned.min(axis=1)
            step = (turned.max(axis=1) - base) / ((1 << PLANES) - 1)
            number = np.rint((turned - base[:, None]) / np.where(step > 0, step, 1)[:, None]).astype(np.int64)
            for p in range(PLANES):
                self.planes[s, p] = words((number >> p) & 1 == 1)
            known = base[:, None] + number * step[:, None]
            self.base[s], self.step[s], self.sum[s], self.off[s] = base, step, known.sum(axis=1), np.abs(turned - known).sum(axis=1) / np.sqrt(d)
        self.root = np.sqrt(d)

    def estimate(self, block: Block, a: np.ndarray, r: np.ndarray, stages: range) -> tuple[np.ndarray, np.ndarray]:
        """Estimated products with the codes of ``stages`` and how far they can be off; ``a`` and ``r`` are numbers of anchors and rows that
        broadcast against each other."""
        value = off = 0.0
        for s in stages:
            inside = np.bitwise_count(block.codes[r, s]).sum(axis=-1) * self.base[s][a]
            for p in range(PLANES):
                inside = inside + np.bitwise_count(block.codes[r, s] & self.planes[s, p][a]).sum(axis=-1, dtype=np.int64) * (self.step[s][a] * (1 << p))
            aligned = block.aligned[r, s]
            value = value + aligned * ((2 * inside - self.sum[s][a]) / self.root)
            off = off + aligned * self.off[s][a]
        return value, off

    def residual(self, block: Block, a: np.ndarray, r: np.ndarray, stage: int) -> np.ndarray:
        return self.length[a] * (block.left[r, stage] + LOOSE * block.length[r])


class Block:
    """Vectors in order of label, with their codes."""

    def __init__(self, row: dict):
        self.ids, self.labels, self.numbers = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels", "numbers"))
        n = len(self.ids)
        self.vectors = np.frombuffer(row["vectors"], "<i4").reshape(n, -1)
        self.codes, self.aligned, self.left = np.frombuffer(row["codes"], "<u8").reshape(n, STAGES, -1), np.frombuffer(row["aligned"], "<f8").reshape(n, -1), np.frombuffer(row["missed"], "<f8").reshape(n, -1)
        self.length = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1))

    @staticmethod
    def pack(rows: pa.Table, coded: bool) -> dict:
        rows = rows.sort_by([("label", "ascending"), ("number", "ascending")])
        vectors = matrix(rows["v"])
        out = {"ids": rows["vec_id"].to_numpy().astype("<i8"), "labels": rows["label"].to_numpy().astype("<i8"), "numbers": rows["number"].to_numpy().astype("<i8"), "vectors": vectors.astype("<i4")}  # smaller than 2^26
        if coded:
            out |= dict(zip(("codes", "aligned", "missed"), codes(vectors), strict=True))
        return {k: v.tobytes() for k, v in out.items()}


def scored(anchors: np.ndarray, rows: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact integer products of pairs."""
    out = np.zeros(len(a), np.int64)
    for i in range(0, len(a), 1 << 16):
        part = slice(i, i + (1 << 16))
        out[part] = np.einsum("ij,ij->i", anchors[a[part]].astype(np.int64), rows[r[part]].astype(np.int64))
    return out


def best(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, more: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n`` of each group: higher scores first, then smaller ids, then smaller numbers."""
    order = np.lexsort((more, ids, -scores, groups))
    sorted_ = groups[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(sorted_)) + 1]) if len(sorted_) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.concatenate([first, [len(order)]])))
    return order[rank < n]


def largest(values: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest of each row, -inf if there are fewer."""
    if values.shape[1] < n:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - n, axis=1)[:, values.shape[1] - n]


def lowest(groups: np.ndarray, ends: np.ndarray, ids: np.ndarray, n: int, size: int) -> np.ndarray:
    """The n-th largest of the lower ends in each of ``size`` groups, -inf if there are fewer."""
    few = best(groups, ends, ids, ids, n)
    out = np.full(size, np.inf)
    np.minimum.at(out, groups[few], ends[few])
    return np.where(np.bincount(groups[few], minlength=size) == n, out, -np.inf)


def positives_of(anchors: dict, block: Block, n: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``anchor place, row place, score`` of the best ``n`` other rows of each anchor's label in the block."""
    planes = Planes(anchors["vectors"])
    for label in np.unique(anchors["labels"]):
        own = np.flatnonzero(anchors["labels"] == label)
        first, end = np.searchsorted(block.labels, [label, label + 1])
        step = max(1, PAIRS // max(1, end - first))
        for i in range(0, len(own) if end > first else 0, step):
            a, r = own[i : i + step, None], np.arange(first, end)[None]
            other = anchors["numbers"][a] != block.numbers[r]
            value, off = planes.estimate(block, a, r, range(COARSE))
            width = off + planes.residual(block, a, r, COARSE - 1)
            reach = largest(np.where(other, value - width, -np.inf), n)
            x, y = np.nonzero(other & (value + width >= reach[:, None]))
            a, r = a[x, 0], r[0, y]
            value, off = value[x, y], off[x, y]
            for j in range(0, len(a), PAIRS // 4):  # the remaining codes, of what is left
                part = slice(j, j + PAIRS // 4)
                finer, further = planes.estimate(block, a[part], r[part], range(COARSE, STAGES))
                value[part] += finer
                off[part] += further
            width = off + planes.residual(block, a, r, STAGES - 1)
            keep = value + width >= lowest(a, value - width, r, n, len(anchors["ids"]))[a]
            a, r = a[keep], r[keep]
            s = scored(anchors["vectors"], block.vectors, a, r)
            top = best(a, s, block.ids[r], block.numbers[r], n)
            yield a[top], r[top], s[top]


def negatives_of(anchors: dict, block: Block, n: int, low: tuple[int, int], high: tuple[int, int]) -> Iterator[tuple[np.ndarray, ...]]:
    """``window, row place, score`` of the best ``n`` rows of other labels inside each window of the anchors.

    Windows are ``anchors["windows"]``: place of the anchor and score of its positive. A row is inside if its score is at least ``low`` and at most
    ``high`` of the positive's, both given as numerator and denominator."""
    planes, place, goal = Planes(anchors["vectors"]), *anchors["windows"]
    bottom = -((-goal * low[0]) // low[1])
    top = (goal * high[0]) // high[1]
    some = np.flatnonzero(bottom <= top)
    step = max(1, PAIRS // max(1, len(block.ids)))
    for i in range(0, len(some), step):
        w = some[i : i + step]
        a, inverse = np.unique(place[w], return_inverse=True)
        r = np.arange(len(block.ids))[None]
        value, off = planes.estimate(block, a[:, None], r, range(COARSE))
        width = off + planes.residual(block, a[:, None], r, COARSE - 1)
        other = anchors["labels"][a][:, None] != block.labels[r]
        under, over, other = (value - width)[inverse], (value + width)[inverse], other[inverse]
        inside = other & (under >= bottom[w, None]) & (over <= top[w, None])
        reach = np.maximum(bottom[w], largest(np.where(inside, under, -np.inf), n))
        x, y = np.nonzero(other & (over >= reach[:, None]) & (under <= top[w, None]))
        del under, over, other, inside
        value, off = value[inverse[x], y], off[inverse[x], y]
        for j in range(0, len(x), PAIRS // 4):
            part = slice(j, j + PAIRS // 4)
            finer, further = planes.estimate(block, a[inverse[x[part]]], y[part], range(COARSE, STAGES))
            value[part] += finer
            off[part] += further
        width = off + planes.residual(block, a[inverse[x]], y, STAGES - 1)
        sure = np.flatnonzero((value - width >= bottom[w[x]]) & (value + width <= top[w[x]]))
        reach = np.maximum(lowest(x[sure], (value - width)[sure], y[sure], n, len(w)), bottom[w])
        keep = (value + width >= reach[x]) & (value - width <= top[w[x]])
        x, y = x[keep], y[keep]
        s = scored(anchors["vectors"], block.vectors, place[w[x]], y)
        good = np.flatnonzero((s >= bottom[w[x]]) & (s <= top[w[x]]))
        good = good[best(x[good], s[good], block.ids[y[good]], block.numbers[y[good]], n)]
        yield w[x[good]], y[good], s[good]


NONE = dict.fromkeys(("codes", "aligned", "missed"))


def _blocks(rows: DataFrame, size: int, coded: bool) -> tuple[DataFrame, int]:
    """Blocks ``dims, block`` of about ``size`` rows of one length, by a hash of their numbers, and how many there are."""
    n = max(1, -(-rows.count() // size))
    names = ["ids", "labels", "numbers", "vectors", *(NONE if coded else [])]

    def build(part: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([{c: part[c][0].as_py() for c in ("dims", "block")} | Block.pack(part, coded)], pa.schema([("dims", pa.int64()), ("block", pa.int64()), *[(c, pa.binary()) for c in names]]))

    keyed = rows.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(n)))
    return written(keyed.groupBy("dims", "block").applyInArrow(build, "dims long, block long, " + ", ".join(f"{c} binary" for c in names))), n


def _paired(rows: DataFrame, n_rows: int, anchors: DataFrame, n_anchors: int) -> DataFrame:
    """Each block of rows with each block of anchors of the same length, as groups ``dims, block, other`` of two rows."""
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    return rows.withColumn("other", each(n_anchors)).unionByName(anchors.withColumnRenamed("block", "other").withColumn("block", each(n_rows)), allowMissingColumns=True)


def mined(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (1, 2), high: tuple[int, int] = (19, 20)) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for integer vectors ``vec_id, label, v``.

    ``anchors`` is a condition on ``vec_id`` and ``label``. An anchor's positives are its first ``positives`` other rows of the same label, by score. For each
    of them the first ``negatives`` rows of other labels follow that score at least ``low`` and at most ``high`` of it.
    """
    numbered = written(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v", F.size("v").cast("long").alias("dims")).withColumn("number", F.monotonically_increasing_id()))
    blocks, n_rows = _blocks(numbered, ROWS, True)
    asked, n_anchors = _blocks(numbered.filter(anchors), ANCHORS, False)

    def sides(group: pa.Table) -> tuple[dict | None, Block | None]:
        found = {row["codes"] is not None: row for row in group.to_pylist()}
        if len(found) < 2:
            return None, None
        row = found[False]
        ids, labels, numbers = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels", "numbers"))
        return {"ids": ids, "labels": labels, "numbers": numbers, "vectors": np.frombuffer(row["vectors"], "<i4").reshape(len(ids), -1)}, Block(found[True])

    def first_pass(group: pa.Table) -> pa.Table:
        theirs, block = sides(group)
        found = [(theirs["ids"][a], theirs["numbers"][a], block.ids[r], block.numbers[r], s) for a, r, s in positives_of(theirs, block, positives)] if block else []
        columns = [np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 5
        return pa.table(dict(zip(("anchor_id", "anchor", "positive_id", "positive", "positive_score"), map(pa.array, columns), strict=True)))

    near = _paired(blocks, n_rows, asked, n_anchors).groupBy("dims", "block", "other").applyInArrow(first_pass, "anchor_id long, anchor long, positive_id long, positive long, positive_score long")
    by = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive")
    chosen = written(near.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= positives))

    # Rows with an equal score have the same window: one search serves them.
    windows = chosen.groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("goals"))  # ``positives`` values at most
    aimed = written(asked.join(_goals(asked, windows), ["dims", "block"], "left"))

    def second_pass(group: pa.Table) -> pa.Table:
        theirs, block = sides(group)
        out = [np.zeros(0, np.int64)] * 5
        if block:
            known = {g["anchor"]: g["goals"] for goals in group["goals"].to_pylist() for g in goals or []}
            pairs = [(i, goal) for i, number in enumerate(theirs["numbers"].tolist()) for goal in known.get(number, [])]
            if pairs:
                theirs["windows"] = np.array(pairs, np.int64).T
                found = [(theirs["numbers"][theirs["windows"][0][w]], theirs["windows"][1][w], block.ids[r], block.numbers[r], s) for w, r, s in negatives_of(theirs, block, negatives, low, high)]
                out = [np.concatenate(c) for c in zip(*found, strict=True)] if found else out
        return pa.table(dict(zip(("anchor", "positive_score", "negative_id", "negative", "negative_score"), map(pa.array, out), strict=True)))

    hard = _paired(blocks, n_rows, aimed, n_anchors).groupBy("dims", "block", "other").applyInArrow(second_pass, "anchor long, positive_score long, negative_id long, negative long, negative_score long")
    by = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("negative_score"), "negative_id", "negative")
    ranked = hard.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= negatives)
    return chosen.join(ranked, ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _goals(asked: DataFrame, windows: DataFrame) -> DataFrame:
    """The windows of each block of anchors."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["numbers"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([row["dims"]] * len(own)), pa.array([row["block"]] * len(own)), pa.array(own)], ["dims", "block", "anchor"])

    placed = asked.select("dims", "block", "numbers").mapInArrow(tidy(numbers), "dims long, block long, anchor long")
    return placed.join(windows, "anchor").groupBy("dims", "block").agg(F.collect_list(F.struct("anchor", "goals")).alias("goals"))  # ANCHORS at most, about


def hard_negatives(embeddings: DataFrame, **how) -> DataFrame:
    """``mined`` for ``vec_id, label, embedding``: where ``vec_id`` is divisible by 7 the label is first moved on, components become ``floor(256 * x)``, and
    anchors are the rows whose ``vec_id`` is divisible by 50."""
    sound, whole = whole_components("embedding")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = embeddings.filter(sound & (F.size("embedding") > 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    return mined(rows.select("vec_id", moved.alias("label"), whole.alias("v")), F.col("vec_id") % 50 == 0, **how)


ORACLE_SQL = f"""
    WITH v AS (
        SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
            AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR abs(x) >= {LARGEST}]) = 0),
    s AS MATERIALIZED (
        SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.v) = len(b.v)),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id, other) <= 5),
    n AS (
        SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
            row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.id, s.other) AS rank
        FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
    SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
