"""Near-duplicate removal for a corpus: SimHash and MinHash candidates, decided by Jaccard similarity.

Candidates are documents that links of either kind connect. The first are the classes of
simhash.classes over fingerprints of a text's distinct words of four bytes and more: single words
move few bits when words change, and without the short words that most texts share, texts that
have nothing to do with each other lie 32 bits apart. A block that is added or cut off moves more
bits than the radius, so documents also link where one of BANDS keys is equal, each made of
BAND_ROWS minima of hashed five-word shingles: of pairs with Jaccard 0.8, 1 - (1 - 0.8**5)**20 or
99.96 % have one, whatever the kind of edit and the length. Inside a class of candidates documents
link where the Jaccard similarity of their sets of five-word shingles is 0.8 or more, and the
document with the smallest id of each linked group stays.

A class is compared in one task only up to CLASS_ROWS documents; a larger one is dealt into
blocks and every pair of blocks is a unit of work, which returns a spanning forest of its links.

Defined results: texts without words are alike, others with no shingle in common are not; fewer
than five words make one shingle; of rows that repeat an id, and of rows with a null id (which
sort first), one stays when they are alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm.components import components
from webgrain.llm.scratch import cut, shuffle_partitions
from webgrain.llm.simhash import classes, fingerprints, merge_labels, shingle_hashes
from webgrain.llm.wordblocks import gather

CANDIDATE_WORDS, LEAST_BYTES, MAX_BITS = 1, 4, 8
SHINGLE_WORDS, SIMILARITY = 5, 0.8
CLASS_ROWS = 1024
BANDS, BAND_ROWS = 20, 5
#: Shingles that are hashed in one go.
HASHED = 1024
_FACTORS, _SHIFTS = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * BAND_ROWS, 1), np.uint64)
_FACTORS |= np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """BANDS keys of a text's shingle hashes; a key is equal with the probability of the Jaccard similarity to the power of BAND_ROWS."""
    least = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), HASHED):
        np.minimum(least, (hashes[at:at + HASHED] * _FACTORS + _SHIFTS).min(axis=1), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(rows[i].tobytes(), i) for i in range(BANDS)]


def bands(text: DataFrame) -> DataFrame:
    """text: _key, text. (_key, band): the keys of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [k for t in batch.column("_text") for k in band_keys(shingle_hashes(t.as_py(), SHINGLE_WORDS))]
            rows = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([batch.column("_key").take(rows), pa.array(np.array(keys, np.uint64).view(np.int64))], names=["_key", "band"])

    return text.select("_key", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("_text")).mapInArrow(run, "_key bigint, band bigint")


def unit_forest(keys: list[int], texts: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between the documents of a unit.

    The postings of a document's shingles give its shared shingles with all others in one count.
    """
    n = len(keys)
    sets = [np.unique(shingle_hashes(t, SHINGLE_WORDS)) for t in texts]
    sizes = np.fromiter(map(len, sets), np.int64, n)
    owner, every = np.repeat(np.arange(n), sizes), np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    postings, sorted_hashes = owner[order], every[order]
    first = np.searchsorted(sorted_hashes, every, side="left")
    counts = np.searchsorted(sorted_hashes, every, side="right") - first
    ends, left, right = np.cumsum(sizes), [], []
    for i in range(1, n):
        own = slice(ends[i] - sizes[i], ends[i])
        shared = np.bincount(postings[gather(first[own], counts[own])], minlength=n)[:i] if sizes[i] else np.zeros(i, np.int64)
        found = np.flatnonzero(shared >= similarity * (sizes[:i] + sizes[i] - shared))
        left.append(found)
        right.append(np.full(len(found), i))
    label = merge_labels(np.concatenate(left), np.concatenate(right), n) if left else np.arange(n)
    return [(keys[i], keys[j]) for i, j in enumerate(label.tolist()) if i != j]


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = CANDIDATE_WORDS, max_bits: int = MAX_BITS,
               similarity: float = SIMILARITY, class_rows: int = CLASS_ROWS) -> DataFrame:
    """The rows of docs that stay, one of each group of near copies."""
    spark = docs.sparkSession
    keyed = cut(docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_key")), "keyed")
    text = keyed.select("_key", F.col("_row").getField(id_col).cast("bigint").alias("_id"), F.col("_row").getField(text_col).alias("text"))
    rows = cut(fingerprints(text, words, distinct=True, least_bytes=LEAST_BYTES, keep=("_key", "_id")), "near-fingerprints")
    named = classes(rows, max_bits, "_key")
    own = cut(bands(text), "near-bands")
    hubs = cut(own.groupBy("band").agg(F.min("_key").alias("hub"), F.max("_key").alias("last")).where("hub < last").select("band", "hub"), "band-hubs")
    banded = own.join(hubs, "band").select(F.col("_key").alias("a"), F.col("hub").alias("b"))
    linked = components(rows.join(named, "fp").select(F.col("_key").alias("a"), F.col("component_id").alias("b")).unionByName(banded))
    placed = cut(linked.select(F.col("node").alias("_key"), F.col("root").alias("class")), "near-classes")
    sizes = cut(placed.groupBy("class").count().where("count > 1"), "class-sizes")
    blocks = F.ceil(F.col("count") / F.lit(class_rows // 2)).cast("int")
    many = F.col("count") > class_rows
    own = F.when(many, F.pmod(F.xxhash64("_key"), blocks)).otherwise(0).cast("int")
    members = placed.join(sizes, "class").select("_key", "class", own.alias("own"), F.when(many, blocks).otherwise(1).alias("blocks"))
    loaded = cut(text.select("_key", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).join(members, "_key"), "members")
    units = loaded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("class", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "_key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, keys, texts = None, [], []
        for batch in batches:
            for u, k, t in zip(*(batch.column(c) for c in ("unit", "_key", "text")), strict=True):
                u = u.as_py()
                if u != unit and keys:
                    yield links(keys, texts)
                    keys, texts = [], []
                unit = u
                keys.append(k.as_py())
                texts.append(t.as_py())
        if keys:
            yield links(keys, texts)

    def links(keys: list[int], texts: list[bytes]) -> pa.RecordBatch:
        found = unit_forest(keys, texts, similarity)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    edges = units.repartition(shuffle_partitions(spark), "unit").sortWithinPartitions("unit", "_key").mapInArrow(run, "a bigint, b bigint")
    roots = components(edges).join(rows.select(F.col("_key").alias("node"), "_id"), "node")
    stays = cut(roots.groupBy("root").agg(F.min(F.struct("_id", "node")).alias("first")).select(F.col("first.node").alias("node")), "stays")
    gone = cut(roots.select("node").join(stays, "node", "left_anti"), "gone")
    kept = keyed.join(gone.withColumnRenamed("node", "_key"), "_key", "left_anti")
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
