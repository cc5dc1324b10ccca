"""Contiguous shards of near-equal bytes: exact prefix sums of document sizes, cut at equal shares of the total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.llm.common import utf8, with_offsets, written


def byte_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, start`` of every document.

    ``size`` is the text's UTF-8 bytes plus 1 (a missing text: 1). In order of ``doc_id`` (missing ids first, then checksum and size),
    a document goes to the shard that the middle of its bytes falls into, so a shard misses its equal share by less than one document
    at either end. ``law`` is ``bytes``; ``grown_shard`` has no meaning under it and is missing. ``slot`` counts a shard's documents
    from 0, ``start`` the bytes of all documents before. Copies of a text are separate documents, wherever their ids put them. The
    texts are read once and never move: only id, size and checksum are sorted.
    """
    text = utf8(F.col("text"))
    sizes = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    total = sizes.agg(F.sum("size")).first()[0] or 1
    placed = with_offsets(sizes, ["doc_id", "text_crc32", "size"], "size", "start", "_row")
    # 128-bit product: bytes times shards stay exact for any corpus
    middle = (F.col("start") * 2 + F.col("size")).cast("decimal(20,0)") * F.lit(shards).cast("decimal(10,0)")
    cut = placed.withColumn("shard", F.least(F.floor(middle / F.lit(2 * total).cast("decimal(20,0)")), F.lit(shards - 1)).cast("int"))
    firsts = cut.groupBy("shard").agg(F.min("_row").alias("_first"))
    return cut.join(firsts, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_row") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "start")
