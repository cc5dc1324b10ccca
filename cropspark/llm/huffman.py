"""Token ids as canonical length-limited Huffman code, in independent blocks that are decoded with a table.

Layout of a corpus folder (Parquet as the container, so that Spark reads and writes it anywhere):

- ``codes``: ``id, length``, one row for each id that occurs. The canonical code follows from it: ids by length, then by number.
- ``blocks``: rows of whole documents in ascending ``doc_id``. ``payload`` has the bits, highest first, each document from a whole byte;
  ``doc_ids, n_tokens, n_bytes`` describe its documents; ``spans`` has the bits of every ``SPAN`` tokens of a document (little-endian
  unsigned 16-bit), so that decoding can begin at each of them; ``part, block, start`` give the place in the corpus: ``start`` tokens of
  the same part come before.

Empty or missing texts have only the end id. Rows with equal ``doc_id`` stand next to each other in any order, rows without one come
first. An empty table gives an empty folder that reads back as no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropspark.llm.common import _ramp, forget, scratch, steps, tidy, written
from cropspark.llm.tokens import TOKEN_STEP, default_tokenizer, encoder

#: Longest code in bits: the decoding table has 2 ** LIMIT entries, and a vocabulary of as many ids still fits.
LIMIT = 16
#: Tokens from one checkpoint to the next, and tokens of a block (more only if one document has more).
SPAN, BLOCK = 256, 1 << 20

BLOCKS = "part int, block long, start long, doc_ids array<long>, n_tokens array<long>, n_bytes array<long>, spans binary, payload binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for a count of 0."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(ids) < 2:
        out[ids] = 1
        return out
    if len(ids) > 2**limit:
        raise ValueError(f"{len(ids)} ids need codes of more than {limit} bits")
    order = ids[np.argsort(counts[ids], kind="stable")]
    leaves = counts[order].astype(np.int64)
    is_leaf, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        weights = np.concatenate([leaves, packages])
        rank = np.argsort(weights, kind="stable")
        is_leaf.append(rank < len(leaves))
        weights = weights[rank]
        packages = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(leaves) - 2
    for flags in reversed(is_leaf):
        n = int(flags[:take].sum())
        out[order[:n]] += 1
        take = 2 * (take - n)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    for size, group in ((n, ids[lengths[ids] == n]) for n in range(1, int(lengths.max(initial=0)) + 1)):
        code <<= size - last
        codes[group] = code + np.arange(len(group))
        code, last = code + len(group), size
    return codes


def decoding_table(lengths: np.ndarray) -> np.ndarray:
    """``id * 256 + length`` for each possible run of LIMIT bits."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    table = np.zeros(1 << LIMIT, np.uint64)
    filled = np.repeat(ids.astype(np.uint64) * np.uint64(256) + lengths[ids], 1 << (LIMIT - lengths[ids].astype(np.int64)))
    table[: len(filled)] = filled
    return table


def encode(ids: np.ndarray, bounds: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bits of all documents (each from a whole byte), the bounds of their bytes, their span lengths and the bounds of those."""
    n = np.diff(bounds)
    size = lengths[ids].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    bits = ends[bounds[1:]] - ends[bounds[:-1]]
    at = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    place = ends[:-1] + np.repeat(at[:-1] * 8 - ends[bounds[:-1]], n)
    window = codes[ids].astype(np.int64) << (24 - size - (place & 7))
    byte, total = place >> 3, int(at[-1]) + 2
    out = np.zeros(total)
    for k, shift in enumerate((16, 8, 0)):
        out += np.bincount(byte + k, (window >> shift) & 255, total)
    spans = (n + SPAN - 1) // SPAN
    span_bounds = np.concatenate([[0], np.cumsum(spans)])
    first = np.repeat(bounds[:-1], spans) + _ramp(spans) * SPAN
    last = np.minimum(first + SPAN, np.repeat(bounds[1:], spans))
    return out[: at[-1]].astype(np.uint8), at, (ends[last] - ends[first]).astype("<u2"), span_bounds


def decode(payload: np.ndarray, n_tokens: np.ndarray, n_bytes: np.ndarray, span_bits: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Ids of all documents of a block; all checkpoints are followed at the same time."""
    spans = (n_tokens + SPAN - 1) // SPAN
    size = np.minimum(SPAN, np.repeat(n_tokens, spans) - _ramp(spans) * SPAN)
    before = np.cumsum(span_bits.astype(np.int64)) - span_bits
    first = np.cumsum(spans) - spans
    has = np.repeat(np.arange(len(spans)), spans)
    at = (np.cumsum(n_bytes) - n_bytes)[has] * 8 + before - before[first[has]]
    to = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    at, to, size = at[order], to[order], size[order]
    padded = np.concatenate([payload, np.zeros(4, np.uint8)]).astype(np.uint32)
    words = (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:]
    out = np.zeros(int(n_tokens.sum()), np.uint32)
    live = np.searchsorted(-size, -np.arange(SPAN), side="left")
    for k in range(SPAN):
        m = live[k]
        if not m:
            break
        entry = table[(words[at[:m] >> 3] >> (8 - (at[:m] & 7)).astype(np.uint32)) & 0xFFFF]
        out[to[:m] + k] = entry >> np.uint64(8)
        at[:m] += (entry & np.uint64(255)).astype(np.int64)
    return out


def _binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def token_table(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit), not yet in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(tokenizer, end_id)
        for batch in batches:
            for part in steps(batch, "text", TOKEN_STEP):
                ids, bounds = encode_texts(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds)), _binaries(ids.astype("<u4").view(np.uint8), bounds * 4)], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run, keep=True), "doc_id long, n_tokens long, ids binary")


def _ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view("<u4"), (offsets - offsets[0]) // 4


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        found = np.bincount(_ids_of(batch.column("ids"))[0], minlength=len(total))
        found[: len(total)] += total
        total = found
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])


def write_corpus(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2) -> None:
    """Encode ``doc_id, text`` and write the folder described above. The texts are read once, the ids move once, already coded."""
    spark = docs.sparkSession
    kept = scratch(spark)
    ids = written(token_table(docs, tokenizer or default_tokenizer(), end_id), kept)
    counted = ids.select("ids").mapInArrow(tidy(_count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # the vocabulary at most
    counts = np.zeros(1 + max([0, *counted["id"].to_pylist()]), np.int64)
    counts[counted["id"].to_numpy()] = counted["n"].to_numpy()
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": used, "length": lengths[used].astype(np.int32)})).coalesce(1).write.parquet(f"{path}/codes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.unique(ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts) or [0]).astype(np.int64)
    coded_schema = "part int, doc_id long, n_tokens long, n_bytes long, spans binary, payload binary"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in steps(batch, "ids"):
                bits, at, spans, span_bounds = encode(*_ids_of(rows.column("ids")), codes, lengths)
                numbers = rows.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
                part = pa.array(np.searchsorted(cuts, numbers, side="right").astype(np.int32))
                yield pa.RecordBatch.from_arrays([part, rows.column("doc_id"), rows.column("n_tokens"), pa.array(np.diff(at)), _binaries(spans.view(np.uint8), span_bounds * 2), _binaries(bits, at)], [f.split()[0] for f in coded_schema.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, start, block, part = [], 0, 0, 0, None
        for batch in batches:
            part = batch.column("part")[0].as_py()
            ends = np.cumsum(batch.column("n_tokens").to_numpy())
            first = 0
            while first < batch.num_rows:
                base = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, base + BLOCK - tokens, side="right")))
                if held and ends[last - 1] - base + tokens > BLOCK:
                    yield _block(part, block, start, held)
                    held, start, tokens, block = [], start + tokens, 0, block + 1
                    continue
                held.append(batch.slice(first, last - first))
                tokens += int(ends[last - 1] - base)
                first = last
        if held:
            yield _block(part, block, start, held)

    coded = ids.mapInArrow(tidy(code), coded_schema)
    coded.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first()).mapInArrow(tidy(pack), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    forget(spark, kept)


def _block(part: int, block: int, start: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held)
    joined = {c: b"".join(rows[c].to_pylist()) for c in ("spans", "payload")}
    lists = [pa.array([rows[c].to_pylist()], pa.list_(pa.int64())) for c in ("doc_id", "n_tokens", "n_bytes")]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block]), pa.array([start]), *lists, pa.array([joined["spans"]], pa.binary()), pa.array([joined["payload"]], pa.binary())], [f.split()[0] for f in BLOCKS.split(", ")])


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents of a folder; ``start`` counts the ids of all documents before."""
    codes = spark.read.parquet(f"{path}/codes").toArrow()  # the vocabulary at most
    lengths = np.zeros(1 + max([0, *codes["id"].to_pylist()]), np.uint8)
    lengths[codes["id"].to_numpy()] = codes["length"].to_numpy()
    table = decoding_table(lengths)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sums = blocks.groupBy("part").agg(F.sum(F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)")).alias("n")).toArrow().sort_by("part")  # a row a part
    bases = dict(zip(sums["part"].to_pylist(), np.cumsum(sums["n"].to_numpy()) - sums["n"].to_numpy(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, sizes = np.array(row["n_tokens"]), np.array(row["n_bytes"])
                ids = decode(np.frombuffer(row["payload"], np.uint8), n, sizes, np.frombuffer(row["spans"], "<u2"), table)
                ends = np.concatenate([[0], np.cumsum(n)])
                starts = ends[:-1] + row["start"] + bases[row["part"]]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(n), _binaries(ids.astype("<u4").view(np.uint8), ends * 4)], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids binary")


def encoded_ids(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write all documents as a corpus folder and give what is read back, with the checksum of each document's ids."""
    path = path or scratch(docs.sparkSession)
    write_corpus(docs, path, tokenizer, end_id)
    return read_corpus(docs.sparkSession, path).withColumn("ids_crc32", F.crc32("ids"))


__all__ = ["code_lengths", "canonical", "decode", "encode", "encoded_ids", "read_corpus", "write_corpus"]
