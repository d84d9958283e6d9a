"""Texts as blocks of words, for work that is done once for each distinct word of the whole table.

Documents of a partition are gathered into blocks of about BLOCK_BYTES. A block has its own
vocabulary, the distinct words with a slot each, and for each document the slots of its words in
order. Only the vocabularies travel to where a word is worked on, one row for each word and
block however often the word occurs, and results return to the block by slot. A block is the
unit that is put together again, so no task holds more than a block, or one document if that is
longer.

Rows for words can also be packed: a block's words are dealt into buckets by a hash, and all its words of a bucket travel as one
compressed row, in order, so that results need no slot of their own.

Blocks are formed twice, once for the vocabularies and once for the sequences, over the same
partitions: the documents must come straight from a table in files. A block is named by its place
and a checksum of its texts, and putting together fails where a name is missing on either side: rows
that came in another order the second time, as after a shuffle that was run again, never give wrong
words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm.caches import trimmed

BLOCK_BYTES = 12 << 20


class Words:
    """Splits texts of one block; words are numbered in the order in which they are met."""

    def __init__(self):
        self.words: dict[bytes, int] = {}

    def slots(self, text: str) -> bytes:
        """The slots of a text's words, as unsigned 32-bit integers."""
        raise NotImplementedError

    def note(self, text: str) -> bytes:
        """Take in a text's words where their order is of no interest."""
        return self.slots(text)


class WordBlocks:
    """docs: id_col, text_col and, if given, the boolean mark_col. splitter makes a Words for each block."""

    def __init__(self, docs: DataFrame, splitter: Callable[[], Words], id_col: str = "doc_id", text_col: str = "text",
                 mark: F.Column | None = None, block_bytes: int = BLOCK_BYTES):
        self.splitter, self.block_bytes = splitter, block_bytes
        self.rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                                F.coalesce(mark, F.lit(False)).alias("mark") if mark is not None else F.lit(False).alias("mark"))

    def _blocks(self, in_order: bool = True):
        splitter, most = self.splitter, self.block_bytes

        def read(batches: Iterator[pa.RecordBatch]):
            place, number, size, ids, marks, slots, words, crc = TaskContext.get().partitionId(), 0, 0, [], [], [], splitter(), 0
            name = lambda: xxhash.xxh64_intdigest(f"{place} {number} {len(ids)} {crc}") - (1 << 63)
            for batch in batches:
                for i, text, mark in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("mark").to_pylist(), strict=True):
                    data, text = text.as_buffer(), text.as_py()
                    if ids and size + len(text) > most:
                        yield name(), ids, marks, slots, words.words
                        number, size, ids, marks, slots, words, crc = number + 1, 0, [], [], [], splitter(), 0
                    crc = zlib.crc32(data, crc)
                    ids.append(i)
                    marks.append(mark)
                    slots.append(words.slots(text) if in_order else words.note(text))
                    size += len(text)
            if ids:
                yield name(), ids, marks, slots, words.words

        return read

    def vocabularies(self) -> DataFrame:
        """(block, slot, word, marked): marked counts the word's occurrences in marked documents of the block."""
        read = self._blocks()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, _, marks, slots, words in read(batches):
                counts = np.bincount(np.frombuffer(b"".join(s for s, m in zip(slots, marks, strict=True) if m), np.uint32), minlength=len(words))
                every = pa.array(list(words), pa.binary())
                for at in range(0, len(words), 20_000):
                    n = min(20_000, len(words) - at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(at, at + n, dtype=np.int32)),
                                                      every.slice(at, n), pa.array(counts[at:at + n])], names=["block", "slot", "word", "marked"])

        return self.rows.mapInArrow(trimmed(run), "block bigint, slot int, word binary, marked bigint")

    def sequences(self, buckets: int = 0) -> DataFrame:
        """One row a block: ids and marks of its documents, their numbers of words, and all slots, compressed. With buckets, slots are in the packed order."""
        read = self._blocks()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, ids, marks, slots, words in read(batches):
                every = np.frombuffer(b"".join(slots), np.uint32)
                if buckets:
                    order, _, _ = packed_order(words, buckets)
                    place = np.empty(len(order), np.uint32)
                    place[order] = np.arange(len(order), dtype=np.uint32)
                    every = place[every] if len(order) else every
                packed = zstandard.compress(every.tobytes(), 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([ids], pa.list_(pa.int64())), pa.array([marks], pa.list_(pa.bool_())),
                     pa.array([[len(s) // 4 for s in slots]], pa.list_(pa.int32())), pa.array([packed], pa.binary())],
                    names=["block", "ids", "marks", "sizes", "slots"])

        return self.rows.mapInArrow(trimmed(run), "block bigint, ids array<bigint>, marks array<boolean>, sizes array<int>, slots binary")

    def packed_vocabularies(self, buckets: int) -> DataFrame:
        """(block, bucket, words): the words of a block and bucket, ascending and packed."""
        read = self._blocks(in_order=False)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, _, _, _, words in read(batches):
                _, listed, own = packed_order(words, buckets)
                first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.empty(0, np.int64)
                ends = [*first[1:].tolist(), len(own)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), block)), pa.array(own[first].astype(np.int32)),
                     pa.array([pack_strings(listed[a:b]) for a, b in zip(first.tolist(), ends, strict=True)] if len(first) else [], pa.binary())],
                    names=["block", "bucket", "words"])

        return self.rows.mapInArrow(trimmed(run), "block bigint, bucket int, words binary")

    def assemble(self, results: DataFrame, finish: Callable[[pa.Table, list, list, np.ndarray, np.ndarray], Iterator[pa.RecordBatch] | list], schema: str,
                 buckets: int = 0) -> DataFrame:
        """Bring results (block, slot, ...; packed: block, bucket, ...) back to their blocks.

        finish gets a block's results ordered by slot, ids and marks of its documents, their
        numbers of words and all slots, and returns record batches.
        """
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            row = right.to_pylist()[0] if right.num_rows == 1 else None
            if row is None or not left.num_rows and any(row["sizes"]):
                raise ValueError("the documents came in another order the second time; write them as a table first")
            left = left.sort_by("bucket" if buckets else "slot") if left.num_rows else left
            slots = np.frombuffer(zstandard.decompress(row["slots"]), np.uint32)
            return pa.Table.from_batches(list(finish(left, row["ids"], row["marks"], np.array(row["sizes"], np.int64), slots)))

        return results.groupBy("block").cogroup(self.sequences(buckets).groupBy("block")).applyInArrow(run, schema)


def packed_order(words: dict[bytes, int], buckets: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The places of the words in order of bucket and word, the words in that order, and their buckets."""
    listed = list(words)
    own = np.fromiter((zlib.crc32(w) % buckets for w in listed), np.int64, len(listed))
    order = np.array(sorted(range(len(listed)), key=listed.__getitem__), np.int64)
    order = order[np.argsort(own[order], kind="stable")] if len(order) else order
    return order, [listed[i] for i in order.tolist()], own[order]


def pack_strings(values: list[bytes]) -> bytes:
    """Byte strings as one compressed string: their number, their lengths, then all bytes."""
    lengths = np.fromiter(map(len, values), np.uint32, len(values))
    return zstandard.compress(np.uint32(len(values)).tobytes() + lengths.tobytes() + b"".join(values), 3)


def unpack_strings(packed: bytes) -> tuple[np.ndarray, bytes]:
    """(lengths, all bytes)."""
    data = zstandard.decompress(packed)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    return np.frombuffer(data, np.uint32, n, 4).astype(np.int64), data[4 * (n + 1):]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of stretches of an array, one stretch after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
