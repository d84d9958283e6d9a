"""Byte-level BPE: encoding by a global shuffle of distinct words, and decoding.

Texts are split into pre-tokens; each distinct pre-token of the table is encoded once, at the
place its bytes are shuffled to, and its ids return to the positions where it stands. Decoding
joins each id with the table of token bytes, which has one row for each id of the vocabulary.

Defined results: a null text is the empty text and has no ids; rows that repeat are encoded
each; a null id stays null; ids that the vocabulary lacks make decoding fail; an empty table
gives an empty result; a very long text is a block of its own, held whole; further columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm.caches import trimmed
from webgrain.llm.scratch import shuffle_partitions
from webgrain.llm.wordblocks import BLOCK_BYTES, WordBlocks, Words, gather, pack_strings, unpack_strings

#: White space other than space and line feed, and runs of white space with a space in them.
_UNEVEN = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]|  | \n|\n ")
#: A pattern by which any text is one pre-token.
WHOLE = r"(?s:.+)"
#: Buckets of words for each shuffle partition.
BUCKETS = 2


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


#: Texts that a pattern must split into the same tokens whole and space by space.
PROBES = ["a b", "it's we'll", "1 22 3,000.5 x1", "a, b. ( c ) -- d", "Éa ßb 日本 語 😀 e", "a_b @c #d e/f 'g' \"h\"", "a's 't 'll x"]


@lru_cache
def splits_at_spaces(pattern: str) -> bool:
    """Whether the pattern's tokens never reach across a space but may begin with one."""
    find = regex.compile(pattern).findall
    return all(find(t) == find(t.split(" ")[0]) + [x for piece in t.split(" ")[1:] for x in find(" " + piece)] for t in PROBES)


class PreTokens(Words):
    """Pre-tokens by a pattern that matches every character and joins a token with one space before it.

    In evenly spaced texts what stands between spaces is split on its own, once for each distinct
    piece of the block; other texts, and all where the pattern fails that on PROBES, are split whole.
    """

    def __init__(self, pattern: str):
        super().__init__()
        self.find = regex.compile(pattern).findall
        self.even = splits_at_spaces(pattern)
        self.pieces: dict[str, bytes] = {}

    def _split(self, text: str) -> bytes:
        words, out = self.words, []
        for token in self.find(text):
            out.append(words.setdefault(token.encode(), len(words)))
        return np.array(out, np.uint32).tobytes()

    def _pieces(self, text: str) -> tuple[bytes, list[str]] | None:
        """The slots of what stands before the first space and the pieces after it, all known; None for a text that is split whole."""
        if not self.even or text.startswith(" ") or text.endswith(" ") or _UNEVEN.search(text):
            return None
        pieces, known = text.split(" "), self.pieces
        first, rest = self._split(pieces[0]), pieces[1:]
        for piece in [p for p in dict.fromkeys(rest) if p not in known]:
            known[piece] = self._split(" " + piece)
        return first, rest

    def slots(self, text: str) -> bytes:
        found = self._pieces(text)
        return self._split(text) if found is None else found[0] + b"".join(map(self.pieces.__getitem__, found[1]))

    def note(self, text: str) -> bytes:
        if self._pieces(text) is None:
            self._split(text)
        return b""


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, ids): ids as little-endian unsigned 32-bit integers. ranks: the bytes of a .tiktoken file."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    blocks, parts = WordBlocks(docs, lambda: PreTokens(pattern), id_col, text_col, None, block_bytes), shuffle_partitions(docs.sparkSession)
    buckets = BUCKETS * parts

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = tiktoken.Encoding("own", pat_str=WHOLE, mergeable_ranks=read_ranks(shared.value), special_tokens={}).encode_ordinary
        known: dict[bytes, bytes] = {}
        last = None
        for batch in batches:
            for block, bucket, packed in zip(batch.column("block").to_pylist(), batch.column("bucket").to_pylist(), batch.column("words"), strict=True):
                if bucket != last:
                    known, last = {}, bucket
                lengths, data = unpack_strings(packed.as_py())
                ends = np.cumsum(lengths).tolist()
                words = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                for word in words:
                    if word not in known:
                        known[word] = np.array(run(word.decode()), "<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket], pa.int32()), pa.array(
                    [pack_strings([known[w] for w in words])], pa.binary())], names=["block", "bucket", "ids"])

    words = blocks.packed_vocabularies(buckets).repartition(parts, "bucket")
    results = words.sortWithinPartitions("bucket").mapInArrow(trimmed(encode_words), "block bigint, bucket int, ids binary")

    def finish(own: pa.Table, ids: list, marks: list, sizes: np.ndarray, slots: np.ndarray) -> list[pa.RecordBatch]:
        unpacked = [unpack_strings(p) for p in own.column("ids").to_pylist()]
        lengths = np.concatenate([n for n, _ in unpacked]) // 4 if unpacked else np.empty(0, np.int64)
        every = np.frombuffer(b"".join(d for _, d in unpacked), "<u4")
        starts, ends, out = np.cumsum(lengths) - lengths, np.cumsum(sizes), []
        for at in range(0, len(ids), 256):
            stop = min(at + 256, len(ids))
            here = slots[ends[at] - sizes[at]:ends[stop - 1]]
            data = every[gather(starts[here], lengths[here])].tobytes()
            total = np.concatenate(([0], np.cumsum(lengths[here])))
            cuts = 4 * total[np.concatenate(([0], ends[at:stop] - ends[at] + sizes[at]))]
            out.append(pa.RecordBatch.from_arrays([pa.array(ids[at:stop], pa.int64()), pa.array(
                [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=[id_col, "ids"]))
        return out

    return blocks.assemble(results, finish, f"`{id_col}` bigint, ids binary", buckets)


def decode(encoded: DataFrame, ranks: bytes, ids_col: str = "ids") -> DataFrame:
    """encoded with `decoded`, the bytes that ids_col stands for."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    keep = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = read_ranks(shared.value)
        tokens = [b""] * (max(table.values(), default=-1) + 1)
        for token, rank in table.items():
            tokens[rank] = token
        every, lengths = np.frombuffer(b"".join(tokens), np.uint8), np.fromiter(map(len, tokens), np.int64, len(tokens))
        starts = np.cumsum(lengths) - lengths
        for batch in batches:
            out = []
            for ids in batch.column(ids_col):
                own = np.frombuffer(ids.as_py() or b"", "<u4")
                out.append(every[gather(starts[own], lengths[own])].tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.binary())], names=[*keep, "decoded"])

    types = dict(encoded.dtypes)
    return encoded.select(*keep).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", decoded binary")
