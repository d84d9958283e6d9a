"""Substring dedup by content-defined chunks.

Bytes are cut where a gear rolling hash of the last WINDOW bytes has its top bits clear, so the
cuts depend on nothing but nearby text and an insertion moves only the chunks that it touches.
Chunks are compared by a 64-bit digest. Where chunks of a document occur in another one, the
passage around them is settled by words: of all stretches of min_words words inside a run of
shared chunks and the text beside it, those that occur in another document too are repeats. Every
word of a run begins a stretch, so a passage is found wherever it lies in the other document's run.
Of the documents that share a stretch the one with the smallest id keeps it; from the others the
union of their repeats is taken out. Only digests travel to be counted. Chunks are shared when two
different texts have them, and of equal texts only the one with the smallest id is settled by
stretches: each stretch of the others is one of its own, so all of them go.

Defined results: a null text stays null, an empty one empty, neither has chunks; rows that
repeat an id are one document, whose passages do not repeat each other; rows with a null id are
one document, the first of all; a text of repeats alone becomes empty but for white space; very
long texts are cut like any other, a chunk has CHUNK_MOST bytes at most; an empty table gives an
empty result; all columns of docs are kept, whatever their names but `removed_col`, which gives way.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm.scratch import cut

WINDOW = 16
#: Top bits that must be clear at a cut: one byte in 2**CUT_BITS.
CUT_BITS = 5
CHUNK_LEAST, CHUNK_MOST = 16, 1024
MIN_WORDS = 50
LEAST = -(1 << 63)
#: Stretches that leave a task at once.
SETTLED = 100_000


def gear_table() -> np.ndarray:
    """One random 32-bit number for each byte value, by a multiplicative generator; zero for the zero byte."""
    out, x = np.zeros(256, np.uint32), 0x2545F4914F6CDD1D
    for b in range(1, 256):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out[b] = x >> 32
    return out


GEAR = gear_table()


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum over the last WINDOW bytes of their gear numbers, each shifted by its age."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        older = np.zeros_like(h)
        older[width:] = h[:-width]
        h = h + (older << np.uint32(width))
        width *= 2
    return h


def raw_cuts(texts: list[bytes]) -> np.ndarray:
    """Where the rolling hash cuts the texts, joined by WINDOW zero bytes that keep their windows apart."""
    h = rolling(np.frombuffer(bytes(WINDOW).join(texts), np.uint8))
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def chunk_ends(texts: list[bytes], cuts: np.ndarray | None = None) -> list[list[int]]:
    """The ends of the chunks of each text."""
    cuts = raw_cuts(texts) if cuts is None else cuts
    out, base = [], 0
    for text in texts:
        n = len(text)
        own = cuts[np.searchsorted(cuts, base, side="right"):np.searchsorted(cuts, base + n, side="left")] - base
        ends, last = [], 0
        for c in [*own.tolist(), n]:
            while c - last > CHUNK_MOST:
                last += CHUNK_MOST
                ends.append(last)
            if c - last >= CHUNK_LEAST or c == n and c > last:
                ends.append(c)
                last = c
        out.append(ends)
        base += n + WINDOW
    return out


def _batched(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Slices of a batch with about `most` bytes of text each: (first row, texts)."""
    at, size, texts = 0, 0, []
    for i, value in enumerate(batch.column(column)):
        text = value.as_py()
        if texts and size + len(text) > most:
            yield at, texts
            at, size, texts = i, 0, []
        texts.append(text)
        size += len(text)
    if texts:
        yield at, texts


def chunks(docs: DataFrame) -> DataFrame:
    """docs: id and the bytes `body`. (id, digest) for the distinct chunks of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            ids = batch.column("id")
            for at, texts in _batched(batch, "body"):
                digests, counts = [], []
                for text, ends in zip(texts, chunk_ends(texts), strict=True):
                    own = {digest(text[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)} if ends else set()
                    digests += own
                    counts.append(len(own))
                rows = pa.array(np.repeat(np.arange(at, at + len(texts)), counts))
                yield pa.RecordBatch.from_arrays([ids.take(rows), pa.array(np.array(digests, np.uint64).view(np.int64))], names=["id", "digest"])

    return docs.mapInArrow(run, "id bigint, digest bigint")


_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def stretches(text: bytes, shared: set[int], min_words: int) -> list[tuple[int, int, int]]:
    """(digest, first byte, last byte + 1) of the stretches of min_words words at runs of chunks in shared.

    A stretch begins at every word from which it lies inside a run and the text beside it: the chunk
    after the run and, before it, all from the last cut that has none within CHUNK_LEAST bytes before
    it. Such a cut ends a chunk wherever the text occurs, so a passage that began WINDOW and
    CHUNK_LEAST bytes before it would have its chunks, and the run, begin there.
    """
    raw = raw_cuts([text])
    ends = chunk_ends([text], raw)[0]
    starts = [0, *ends[:-1]]
    shared = {d % (1 << 64) for d in shared}
    hit = [xxhash.xxh3_64_intdigest(text[a:b]) in shared for a, b in zip(starts, ends, strict=True)]
    if True not in hit:
        return []
    common = raw[np.diff(raw, prepend=-CHUNK_LEAST) >= CHUNK_LEAST].tolist()
    spans = [m.span() for m in _WORD.finditer(text)]
    begins, stops = [a for a, _ in spans], [b for _, b in spans]
    wanted: set[int] = set()
    i = 0
    while i < len(hit):
        j = i
        while j < len(hit) and hit[j]:
            j += 1
        if j > i:
            k = bisect_left(common, starts[i]) - 1
            before = min(starts[max(0, i - 1)], common[k] - WINDOW - CHUNK_LEAST if k >= 0 else 0)
            first, last = bisect_left(begins, before), bisect_right(stops, ends[min(j, len(ends) - 1)])
            wanted.update(range(first, last - min_words + 1))
        i = j + 1
    if not wanted:
        return []
    joined = b" ".join([text[a:b] for a, b in spans])
    at = np.cumsum([0] + [b - a + 1 for a, b in spans]).tolist()
    digest = xxhash.xxh3_64_intdigest
    return [(digest(joined[at[w]:at[w + min_words] - 1]), begins[w], stops[w + min_words - 1]) for w in sorted(wanted)]


def whole(text: bytes, min_words: int) -> list[tuple[int, int]]:
    """The range that all stretches of a text cover together."""
    spans = [m.span() for m in _WORD.finditer(text)]
    return [(spans[0][0], spans[-1][1])] if len(spans) >= max(min_words, 1) else []


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def without(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    out, last = [], 0
    for a, b in ranges:
        out.append(text[last:a])
        last = b
    return b"".join([*out, text[last:]])


def shared_digests(own: DataFrame) -> DataFrame:
    """(digest, owner) for the digests that two ids have; own: (id, digest)."""
    return own.groupBy("digest").agg(F.min("id").alias("owner"), F.max("id").alias("last")).where("owner < last").select("digest", "owner")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                   removed_col: str = "_removed") -> DataFrame:
    """docs, without a column removed_col, with passages taken out of text_col, and removed_col: the byte ranges in the former text (null: untouched)."""
    docs = docs.drop(removed_col)
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(LEAST))
    body = F.col("_row").getField(text_col)
    rows = docs.select(F.struct("*").alias("_row"), key.alias("_id"), F.xxhash64(text_col).alias("_text"))
    own = cut(chunks(rows.where(F.length(body) > 0).select(F.col("_text").alias("id"), F.encode(body, "UTF-8").alias("body"))), "chunks")
    shared = own.join(cut(shared_digests(own), "shared"), "digest").groupBy("id").agg(F.collect_set("digest").alias("_chunks"))
    copied = rows.where(F.length(body) > 0).groupBy("_text").agg(F.min(F.struct("_id", F.unhex(F.sha2(body, 256)).alias("sha"))).alias("_first"), F.max("_id").alias("_last"))
    known = copied.where("_first._id < _last").select(F.col("_text").alias("id"), "_first").join(shared, "id", "full")
    copy = F.coalesce((F.col("_id") > F.col("_first._id")) & (F.unhex(F.sha2(body, 256)) == F.col("_first.sha")), F.lit(False))
    met = cut(rows.join(known, rows["_text"] == known["id"], "left").select(
        "_row", "_id", copy.alias("_copy"), F.when(~copy, F.col("_chunks")).alias("_chunks")), "met")
    touched = met.where(F.col("_chunks").isNotNull())

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lambda ids, digests: pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(np.array(digests, np.uint64).view(np.int64))], names=["id", "digest"])
        for batch in batches:
            ids, digests = [], []
            for i, text, known in zip(batch.column("_id").to_pylist(), batch.column("text"), batch.column("_chunks"), strict=True):
                found = {d for d, _, _ in stretches((text.as_py() or "").encode(), set(known.as_py()), min_words)}
                digests += found
                ids += [i] * len(found)
                if len(ids) >= SETTLED:
                    yield table(ids, digests)
                    ids, digests = [], []
            yield table(ids, digests)

    passages = cut(touched.select("_id", body.alias("text"), "_chunks").mapInArrow(settle, "id bigint, digest bigint"), "stretches")
    foreign = passages.join(cut(shared_digests(passages), "passages"), "digest").where("id <> owner").groupBy("id").agg(
        F.collect_set("digest").alias("_passages"))

    def result(body: bytes, ranges: list[tuple[int, int]]) -> dict:
        return {"text": without(body, ranges).decode(), "removed": [{"start": a, "end": b} for a, b in ranges] or None}

    kind = pa.struct([("text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    @F.arrow_udf("struct<text:string,removed:array<struct<start:int,end:int>>>")
    def clean(texts: pa.Array, known: pa.Array, passages: pa.Array) -> pa.Array:
        out = []
        for text, chunk_set, passage_set in zip(texts, known, passages, strict=True):
            body, drop, ranges = (text.as_py() or "").encode(), passage_set.as_py(), []
            if drop and body:
                drop = {d % (1 << 64) for d in drop}
                ranges = union([(a, b) for d, a, b in stretches(body, set(chunk_set.as_py()), min_words) if d in drop])
            out.append(result(body, ranges))
        return pa.array(out, kind)

    @F.arrow_udf("struct<text:string,removed:array<struct<start:int,end:int>>>")
    def clean_copy(texts: pa.Array) -> pa.Array:
        bodies = [text.as_py().encode() for text in texts]
        return pa.array([result(body, whole(body, min_words)) for body in bodies], kind)

    done = touched.join(foreign, touched["_id"] == foreign["id"], "left").select("_row", clean(body, F.col("_chunks"), F.col("_passages")).alias("_done"))
    untouched = met.where(F.col("_chunks").isNull() & ~F.col("_copy")).select("_row", F.lit(None).cast(done.schema["_done"].dataType).alias("_done"))
    every = done.unionByName(untouched).unionByName(met.where("_copy").select("_row", clean_copy(body).alias("_done")))
    field = lambda c: F.col("_row").getField(c)
    return every.select(*[F.coalesce("_done.text", field(c)).alias(c) if c == text_col else field(c).alias(c) for c in docs.columns],
                        F.col("_done.removed").alias(removed_col))
