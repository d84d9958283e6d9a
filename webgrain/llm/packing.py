"""Packing by powers of two.

A document's ids and the end id are cut from the front into as many pieces of max_len as fit
and then into one piece for each binary digit of the rest, longest first. A piece is a sequence
of its own, so none crosses documents and none is padded; sequences of equal length share the
bucket of that length. Nothing is shuffled.

Defined results: a null or empty text has one piece, the end id; rows that repeat are packed
each; a null id stays null; a very long text is encoded whole and its pieces leave one after the
other; an empty table gives no pieces; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm.caches import trimmed
from webgrain.llm.wordpiece import encoder


def piece_lengths(n: int, max_len: int) -> list[int]:
    """The lengths that n ids are cut into."""
    return [max_len] * (n // max_len) + [1 << b for b in range(max_len.bit_length() - 2, -1, -1) if n % max_len >> b & 1]


def pack(docs: DataFrame, vocabulary: bytes, end_id: int, max_len: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id_col, start, length, doc_tokens, ids (little-endian unsigned 32-bit), sequence_id, offset, bucket."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for i, text in zip(part.column("id").to_pylist(), part.column("text"), strict=True):
                    ids = np.append(np.frombuffer(enc.encode(text.as_py()), enc.dtype), enc.dtype.type(end_id)).astype("<u4").tobytes()
                    start, n = 0, len(ids) // 4
                    for length in piece_lengths(n, max_len):
                        rows.append((i, start, length, n, ids[4 * start:4 * (start + length)]))
                        start += length
                own = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(own[k], pa.int64()) for k in range(4)] + [pa.array(own[4], pa.binary())],
                                                 names=[id_col, "start", "length", "doc_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = rows.mapInArrow(trimmed(run), f"`{id_col}` bigint, start bigint, length bigint, doc_tokens bigint, ids binary")
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
                         F.col("length").alias("bucket"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The sequences as a table with one folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)
