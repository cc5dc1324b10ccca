"""Benchmark decontamination by greedy string tiling.

Words (``folded``) of a document and of a benchmark item share seeds: equal runs of ``MIN_MATCH`` words, found by rolling hashes. For
each document and item with a seed, the longest match between words not yet used is taken, its words are marked on both sides, and so on
until no match of ``MIN_MATCH`` words is left. Tiles may come in any order, so reordered passages count in full. An item's coverage is
the share of its words inside tiles; a document with an item covered to ``COVERAGE`` is contaminated.

Items of fewer than ``MIN_MATCH`` words can't be told from chance and match nothing, nor do missing or empty texts. Rows with equal ids are
judged by themselves. The benchmark goes to the executors in slices of at most ``SLICE_WORDS`` words (or one item), each of which costs
one pass over the documents; documents never move.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.llm.common import shingle_hashes, steps, tidy, word_hashes
from cropspark.llm.folded import spaced

MIN_MATCH = 5
COVERAGE = 0.5
SLICE_WORDS = 2_000_000


def tiles(pairs: np.ndarray, length: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiling from all seeds ``(document place, item place)``: tiles ``(document place, item place, words)``."""
    pairs = np.unique(pairs, axis=0)
    diagonal = pairs[:, 0] - pairs[:, 1]
    order = np.lexsort((pairs[:, 0], diagonal))
    place, diagonal = pairs[order, 0], diagonal[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(diagonal) != 0) | (np.diff(place) != 1)]))
    many = np.diff(np.concatenate([new, [len(place)]])) + length - 1
    heap = [(-int(n), int(p), int(p - d)) for p, d, n in zip(place[new], diagonal[new], many, strict=True)]
    heapq.heapify(heap)
    used_doc, used_item, out = set(), set(), []
    while heap:
        n, p, t = heapq.heappop(heap)
        free = [p + k not in used_doc and t + k not in used_item for k in range(-n)]
        if all(free):
            out.append((p, t, -n))
            used_doc.update(range(p, p - n))
            used_item.update(range(t, t - n))
            continue
        run = 0
        for k, ok in enumerate([*free, False]):
            if ok:
                run += 1
            else:
                if run >= length:
                    heapq.heappush(heap, (-run, p + k - run, t + k - run))
                run = 0
    return out


class _Seeds:
    """Runs of words of a slice of the benchmark, sorted by hash."""

    def __init__(self, ids: list[int], texts: list[str | None], length: int):
        hashes, bounds = word_hashes(spaced(pa.array(texts, pa.string())))
        runs, ends = shingle_hashes(hashes, bounds, length)
        n = np.diff(ends)
        item = np.repeat(np.arange(len(ids)), n)
        place = np.arange(len(runs)) - np.repeat(ends[:-1], n)
        real = (np.diff(bounds) >= length)[item]
        order = np.argsort(runs[real], kind="stable")
        self.ids, self.sizes = ids, np.diff(bounds)
        self.runs, self.item, self.place = runs[real][order], item[real][order], place[real][order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.runs & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def found(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``runs`` that equal a run of the slice, with its item and place; one row for each pair."""
        at = np.flatnonzero(self.filter[(runs & np.uint64((1 << 20) - 1)).astype(np.int64)])
        first, last = (np.searchsorted(self.runs, runs[at], side=s) for s in ("left", "right"))
        many = last - first
        which = np.repeat(first, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(at, many), self.item[which], self.place[which]


def _slices(benchmark: DataFrame) -> Iterator[list]:
    """The benchmark in runs of rows of bounded size, one at a time on the driver."""
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"), (F.length(F.coalesce("text", F.lit(""))) / 2 + 1).cast("long").alias("n"))
    held, n = [], 0
    for row in sized.toLocalIterator():
        if held and n + row["n"] > SLICE_WORDS:
            yield held
            held, n = [], 0
        held.append(row)
        n += row["n"]
    if held:
        yield held


def _scan(part: pa.RecordBatch, seeds: _Seeds, length: int) -> list[tuple[int, int, int, int, int, int]]:
    """``row, item, item words, covered, tiles, longest`` for each row and item of the slice with a common run."""
    hashes, bounds = word_hashes(spaced(part.column("text")))
    runs, ends = shingle_hashes(hashes, bounds, length)
    at, item, place = seeds.found(runs)
    row = np.searchsorted(ends, at, side="right") - 1
    real = np.diff(bounds)[row] >= length
    at, item, place, row = at[real] - ends[row[real]], item[real], place[real], row[real]
    order = np.lexsort((item, row))
    at, item, place, row = at[order], item[order], place[order], row[order]
    cuts = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(item) != 0)])).tolist() if len(row) else []
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(row)], strict=False):
        found = tiles(np.stack([at[a:b], place[a:b]], axis=1), length)
        out.append((int(row[a]), int(item[a]), int(seeds.sizes[item[a]]), sum(t[2] for t in found), len(found), max(t[2] for t in found)))
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, length: int = MIN_MATCH) -> DataFrame:
    """Every document and item with a common run of ``length`` words: ``doc_id, item_id, item_words, covered, coverage, n_tiles, longest``."""
    schema = "doc_id long, item_id long, item_words long, covered long, coverage double, n_tiles long, longest long"
    names = [c.split()[0] for c in schema.split(", ")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def search(held: list) -> DataFrame:
        seeds = _Seeds([r["item_id"] for r in held], [r["text"] for r in held], length)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in steps(batch, "text"):
                    if found := _scan(part, seeds, length):
                        rows = [(part.column("doc_id")[row].as_py(), seeds.ids[item], size, covered, covered / size, n, longest) for row, item, size, covered, n, longest in found]
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_arrow(schema))

        return texts.mapInArrow(tidy(run), schema)

    found = [search(held) for held in _slices(benchmark)]
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents and items of ``overlaps`` whose coverage reaches the threshold."""
    return overlaps(docs, benchmark).filter(F.col("coverage") >= coverage)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` whose text is not contaminated, each judged where it stands; the columns stay as they are."""

    def drop(docs: DataFrame, held: list) -> DataFrame:
        seeds = _Seeds([r["item_id"] for r in held], [r["text"] for r in held], MIN_MATCH)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in steps(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    for row, _, size, covered, *_ in _scan(part, seeds, MIN_MATCH):
                        keep[row] &= covered < coverage * size
                    yield part.filter(pa.array(keep))

        return docs.mapInArrow(tidy(run), docs.schema)

    return reduce(drop, _slices(benchmark), docs)


__all__ = ["contaminated", "overlaps", "tiles", "without_benchmark"]
