"""Text quality by naive Bayes support vectors: indicators of n-grams, scaled by the log-ratio of their class counts, under a linear hinge loss.

N-grams are runs of one to three bytes, case kept, and runs of one to three word shapes. A shape tells which kinds of bytes a word has, how it begins and
ends, how long it is and whether it repeats the word before, so that shouting, tables, symbols and repeated words show in any language. All are
hashed into ``FEATURES`` indicators.

- Class counts come from all training rows: how many rows of each class have an indicator, added up by the executors. The ratio of a
  feature is ``log((p / |p|) / (q / |q|))`` of its smoothed counts.
- The hinge loss is fitted by dual coordinate descent on a sample of at most ``SAMPLE`` training rows, those with the smallest hash of their
  ``doc_id``; each is a bit set of fixed size, so the sample has a fixed bound as well. A quarter of it is left out of the fit and turns margins
  into probabilities (a logistic curve, fitted by Newton's method).
- Scoring is one scan without a shuffle; training moves the texts of the training split once, for the join with their labels.

A row's text is all that a score sees. Texts are read whole, in stretches of ``STRETCH`` bytes that end at white space where they can; n-grams don't
reach over the end of a stretch, and a repeated indicator counts once, so that memory stays bounded. Missing texts are empty ones, and an
empty text has the indicators of its (empty) beginning and end. Repeated rows and labels count as often as they occur; labels other than
0 and 1 are ignored. With labels of one class only, or none, every score is the share of label 1 (0.5 if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropspark.llm.common import steps, tidy, written

FEATURES, SAMPLE = 1 << 16, 8192
STRETCH, TOGETHER = 1 << 20, 64
SMOOTH, COST, ROUNDS = 1.0, 1.0, 20
#: Score from which a text is predicted to be of label 1.
THRESHOLD = 0.3

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
#: Kinds of bytes: 1 small letter or any byte of a non-ASCII character, 2 capital letter, 4 digit, 8 mark.
_KIND = np.full(256, 1, np.uint8)
_KIND[0x21:0x7F] = 8
_KIND[0x30:0x3A] = 4
_KIND[0x41:0x5B] = 2
_KIND[0x61:0x7B] = 1
_KIND[_SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += 32
_PLACES = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64)
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_EDGE = b"\n\n"


def _hashed(values: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Feature numbers of the runs of ``n`` values that begin at each place (too short runs at the end are left out)."""
    mixed = np.full(len(values) - n + 1, np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF))
    for k in range(n):
        mixed = (mixed ^ (values[k : len(values) - n + 1 + k] + np.uint32(1)) * _FACTORS[k]) * np.uint32(0x2C1B3C6D)
        mixed ^= mixed >> np.uint32(15)
    return mixed >> np.uint32(16)


def stretches(text: bytes) -> list[bytes]:
    """A text in pieces of at most ``STRETCH`` bytes, cut behind white space where a piece has any."""
    out, at = [], 0
    while len(text) - at > STRETCH:
        piece = np.frombuffer(text, np.uint8, STRETCH, at)
        gaps = np.flatnonzero(_SPACE[piece])
        end = at + (int(gaps[-1]) + 1 if len(gaps) else STRETCH)
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def mark(marks: np.ndarray, units: list[bytes], rows: list[int]) -> None:
    """Set the indicators of each unit in the row of ``marks`` (rows x FEATURES) it belongs to."""
    data = np.frombuffer(b"".join(_EDGE + u + _EDGE for u in units) + _EDGE, np.uint8)
    lengths = np.fromiter((len(u) + 2 * len(_EDGE) for u in units), np.int64, len(units))
    unit = np.repeat(np.arange(len(units), dtype=np.int32), lengths)
    where = (np.array(rows, np.int64) * FEATURES)
    flat, wide = marks.reshape(-1), data.astype(np.uint32)
    at = where[unit]
    for n in (1, 2, 3):
        flat[at + _hashed(wide, n, n)[: len(at)]] = True
    space = _SPACE[data]
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    if not len(starts):
        return
    ends = np.flatnonzero(space[1:] & ~space[:-1])
    kinds = _KIND[data]
    long = ends - starts + 1
    inside = starts[0] + np.arange(len(data) - starts[0])
    place = inside - np.repeat(starts, np.diff(np.concatenate([starts, [len(data)]])))
    hashes = np.add.reduceat(np.where(space[inside], np.uint64(0), (_LOWER[data[inside]] + np.uint64(1)) * _PLACES[place & 63]), starts - starts[0])
    owner = unit[starts]
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (long[1:] == long[:-1]) & (owner[1:] == owner[:-1])
    shape = np.bitwise_or.reduceat(kinds, starts).astype(np.uint32) | (kinds[starts] == 2).astype(np.uint32) << 4 | (kinds[ends] == 8).astype(np.uint32) << 5 | same.astype(np.uint32) << 6
    shape |= np.searchsorted([2, 4, 8, 16], long, side="right").astype(np.uint32) << 7
    for n in (1, 2, 3):
        if len(starts) >= n:
            whole = owner[: len(starts) - n + 1] == owner[n - 1 :]
            flat[where[owner[: len(starts) - n + 1][whole]] + _hashed(shape, n, 3 + n)[whole]] = True


def indicators(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Indicators of runs of texts: the first text's place, and a matrix of at most ``TOGETHER`` rows that is used again afterwards."""
    marks = np.zeros((TOGETHER, FEATURES), bool)
    binary = pc.cast(pc.fill_null(texts, ""), pa.large_binary())
    for first in range(0, len(binary), TOGETHER):
        part = binary.slice(first, TOGETHER).to_pylist()
        marks[:] = False
        units, rows, held = [], [], 0
        for row, text in enumerate(part):
            for piece in stretches(text):
                if held + len(piece) > STRETCH and units:
                    mark(marks, units, rows)
                    units, rows, held = [], [], 0
                units.append(piece)
                rows.append(row)
                held += len(piece)
        mark(marks, units, rows)
        yield first, marks[: len(part)]


class Model:
    """Feature weights for unit vectors of scaled indicators, and the curve from margins to probabilities."""

    def __init__(self, ratios: np.ndarray, weights: np.ndarray, slope: float, offset: float):
        self.ratios, self.weights, self.slope, self.offset = ratios, weights, slope, offset

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        scaled, squares = self.ratios * self.weights, self.ratios**2
        for first, marks in indicators(texts):
            at = np.flatnonzero(marks)
            row, feature = at >> 16, at & (FEATURES - 1)
            n = len(marks)
            out[first : first + n] = np.bincount(row, scaled[feature], n) / np.sqrt(1 + np.bincount(row, squares[feature], n))
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.offset, -500, 500)))


def descend(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray) -> np.ndarray:
    """Weights that minimise ``|w|^2 / 2 + COST * sum(max(0, 1 - y w x))``: one dual variable after the other is set to its optimum, in a new fixed
    pseudo-random order each round. A row is its features and their values."""
    weights, alpha = np.zeros(FEATURES), np.zeros(len(rows))
    squares = np.array([v @ v for _, v in rows])
    for r in range(ROUNDS):
        largest = 0.0
        for i in np.random.default_rng(r).permutation(len(rows)):
            if not squares[i]:
                continue
            f, v = rows[i]
            now = min(max(alpha[i] - (signs[i] * (weights[f] @ v) - 1) / squares[i], 0.0), COST)
            if step := now - alpha[i]:
                weights[f] += step * signs[i] * v
                alpha[i] = now
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return weights


def curve(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins, with targets drawn in a little so that it stays finite."""
    n1 = good.sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (len(good) - n1 + 2))
    x, w = np.stack([margins, np.ones(len(margins))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * w)
        w = w + step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def in_training(doc_id: Column) -> Column:
    """True for the rows whose labels a model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn ``quality`` from the training rows of ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, quality``)."""
    learned = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & in_training(F.col("doc_id")))
    share = min(1.0, 1.05 * SAMPLE / max(1, learned.count()))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(in_training(F.col("doc_id")))
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # Always a shuffle of both sides: labels grow with the documents, and a plan that changes with their size would hide what it costs.
    rows = texts.join(learned.hint("merge"), "doc_id").select("text", "quality", key.alias("key"))
    limit = int(share * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
        names = ["quality", "feature", "n", "key", "bits"]
        for batch in batches:
            for part in steps(batch, "text"):
                quality, keys = part.column("quality").to_numpy(), part.column("key").to_numpy()
                for first, marks in indicators(part.column("text")):
                    own = quality[first : first + len(marks)]
                    for q in (0, 1):
                        sums[q] += marks[own == q].sum(axis=0, dtype=np.int64)
                        seen[q] += int((own == q).sum())
                    chosen = np.flatnonzero(keys[first : first + len(marks)] < limit)
                    if len(chosen):
                        bits = [r.tobytes() for r in np.packbits(marks[chosen], axis=1)]
                        none = pa.nulls(len(chosen), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(own[chosen].astype(np.int32)), none, none, pa.array(keys[first + chosen]), pa.array(bits, pa.binary())], names)
        for q in (0, 1):
            at = np.flatnonzero(sums[q])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, q, np.int32)), pa.array(np.concatenate([[-1], at])), pa.array(np.concatenate([[seen[q]], sums[q][at]])), pa.nulls(len(at) + 1, pa.int64()), pa.nulls(len(at) + 1, pa.binary())], names)

    found = written(rows.mapInArrow(tidy(count), "quality int, feature long, n long, key long, bits binary"))
    counted = found.filter("feature IS NOT NULL").groupBy("quality", "feature").agg(F.sum("n").alias("n")).toArrow()  # 2 * FEATURES rows at most
    quality, feature, n = (counted[c].to_numpy() for c in ("quality", "feature", "n"))
    rows_of = [int(n[(quality == q) & (feature < 0)].sum()) for q in (0, 1)]
    if min(rows_of) == 0:
        share = 0.5 if not sum(rows_of) else rows_of[1] / sum(rows_of)
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, float(np.clip(np.log(max(share, 1e-300) / max(1 - share, 1e-300)), -500, 500)))
    counts = np.full((2, FEATURES), SMOOTH)
    real = feature >= 0
    counts[quality[real], feature[real]] += n[real]
    counts /= counts.sum(axis=1, keepdims=True)
    ratios = np.log(counts[1] / counts[0])
    sample = found.filter("bits IS NOT NULL").orderBy("key", "quality", "bits").limit(SAMPLE).select("quality", "bits").toArrow()  # SAMPLE rows of FEATURES / 8 bytes at most
    vectors = []
    for bits in sample["bits"].to_pylist():
        f = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))).astype(np.int32)
        vectors.append((f, ratios[f] / np.sqrt(1 + (ratios[f] ** 2).sum())))
    good = sample["quality"].to_numpy() == 1
    kept = np.arange(len(vectors)) % 4 != 3
    if len(set(good[kept])) < 2 or len(set(good[~kept])) < 2:
        kept = np.ones(len(vectors), bool)
    weights = descend([v for v, k in zip(vectors, kept, strict=True) if k], np.where(good[kept], 1.0, -1.0))
    judged = ~kept if not kept.all() else kept
    margins = np.array([weights[f] @ v for (f, v), k in zip(vectors, judged, strict=True) if k])
    return Model(ratios, weights, *curve(margins, good[judged]))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                score = model.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, score double, predicted int").select("doc_id", held.alias("held_out"), "score", "predicted")
