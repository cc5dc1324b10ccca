"""Best-fit packing of documents into sequences of fixed capacity, planned on the counts of lengths alone.

A document longer than the capacity is cut into full pieces, its first piece takes the rest. Large pieces, over a third of the capacity,
stand at most two in a sequence: from the longest on, each is matched with the longest other large piece that still fits. The small
pieces follow from long to short, each into the tightest gap that takes it, else into a new sequence. Pieces of one length are
interchangeable, so the plan is made for counts (at most ``capacity`` of them, whatever the corpus) and says which running numbers of a
length go where; the pieces themselves never leave the executors.

A missing or empty text is a document of the end id alone. Repeated rows are packed as often as they occur. No documents give no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cropspark.llm.common import _ramp, steps, tidy, written
from cropspark.llm.tokens import TOKEN_STEP, default_tokenizer, encoder

CAPACITY = 1024


class _Groups:
    """Sequences with equal gaps, as ranges of their numbers."""

    def __init__(self):
        self.by_gap: dict[int, list[tuple[int, int]]] = {}
        self.gaps: list[int] = []

    def add(self, gap: int, base: int, n: int) -> None:
        if n and gap:
            if gap not in self.by_gap:
                self.by_gap[gap] = []
                insort(self.gaps, gap)
            self.by_gap[gap].append((base, n))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """The tightest range whose gap is at least ``least``: gap, first number, how many."""
        k = bisect_left(self.gaps, least)
        if k == len(self.gaps):
            return None
        gap = self.gaps[k]
        base, n = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            del self.by_gap[gap], self.gaps[k]
        return gap, base, n


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``length, from, to, base, each, offset``: number ``i`` of a length, from <= i < to, stands in sequence
    ``base + (i - from) // each`` at ``offset + (i - from) % each * length``."""
    left = {k: v for k, v in counts.items() if v > 0}
    given = dict.fromkeys(left, 0)
    rows, groups, bins = [], _Groups(), 0

    def put(length: int, n: int, base: int, each: int, offset: int) -> None:
        rows.append((length, given[length], given[length] + n, base, each, offset))
        given[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        length = large[-1]
        if length not in left:
            large.pop()
            continue
        n = left[length]
        fit = large[: bisect_left(large, capacity - length + 1)]
        while fit and (fit[-1] not in left or fit[-1] == length and n < 2):
            fit.pop()
        if not fit:
            put(length, n, bins, 1, 0)
            groups.add(capacity - length, bins, n)
        elif fit[-1] == length:
            n //= 2
            put(length, 2 * n, bins, 2, 0)
            groups.add(capacity - 2 * length, bins, n)
        else:
            n = min(n, left[fit[-1]])
            put(length, n, bins, 1, 0)
            put(fit[-1], n, bins, 1, length)
            groups.add(capacity - length - fit[-1], bins, n)
        bins += n
    for length in sorted(left, reverse=True):
        while length in left:
            n = left[length]
            found = groups.take(length)
            if found is None:
                each = capacity // length
                found = capacity, bins, -(-n // each)
                bins += found[2]
            gap, base, free = found
            each = gap // length
            full = min(free, n // each)
            if full:
                put(length, full * each, base, each, capacity - gap)
                groups.add(gap - each * length, base, full)
            if full < free and (rest := left.get(length, 0)):
                put(length, rest, base + full, rest, capacity - gap)
                groups.add(gap - rest * length, base + full, 1)
                full += 1
            groups.add(gap, base + full, free - full)
    return rows


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's tokens and end id."""
    tokenizer = tokenizer or default_tokenizer()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(tokenizer, end_id)
        for batch in batches:
            for part in steps(batch, "text", TOKEN_STEP):
                ids, bounds = encode_texts(part.column("text"))
                n = np.diff(bounds)
                many = -(-n // capacity)
                piece, doc = _ramp(many), np.repeat(np.arange(len(n)), many)
                first = (n - (many - 1) * capacity)[doc]
                start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
                length = np.where(piece == 0, first, capacity)
                view = memoryview(ids.astype("<u4").view(np.uint8))
                at = (bounds[:-1][doc] + start) * 4
                sums = [zlib.crc32(view[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run, keep=True), schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``, their place in it."""
    cut = written(pieces(docs, capacity, tokenizer, end_id).withColumn("_part", F.spark_partition_id()))
    counts = cut.groupBy("_part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    placed = plan(totals, capacity)
    spark = docs.sparkSession
    schema = "length long, first long, end long, base long, each long, at long"
    # At most a few ranges for each length up to the capacity, so the table has a fixed bound and goes to every task.
    ranges = F.broadcast(spark.createDataFrame(placed, schema).groupBy("length").agg(F.collect_list(F.struct("first", "end", "base", "each", "at")).alias("_ranges")))
    inside = Window.partitionBy("_part", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = cut.withColumn("_n", F.row_number().over(inside) - 1).join(bases, ["_part", "length"]).withColumn("_n", F.col("_n") + F.col("_base"))
    chosen = numbered.join(ranges, "length").withColumn("_r", F.filter("_ranges", lambda r: (r["first"] <= F.col("_n")) & (F.col("_n") < r["end"]))[0])
    step = F.col("_n") - F.col("_r.first")
    return chosen.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_r.base") + F.floor(step / F.col("_r.each"))).alias("sequence_id"),
        (F.col("_r.at") + step % F.col("_r.each") * F.col("length")).alias("offset"))
