"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest distinct XXH64 values of the shingles of five words. The sketch of a
union is the k smallest of both sketches, so sketches of parts merge; two sketches estimate the
resemblance and containment of their shingle sets, one the number of distinct shingles. As text
a sketch is the Base64 of its values, ascending, each as eight big-endian bytes.

Defined results: a null text is the empty text, whose sketch is empty; two empty sketches are
alike (1), an empty and another are not (0); fewer than five words make one shingle; the
document after the last one is the first, so a table of one row follows itself; rows that share
an id follow each other in the order of their texts, a null id comes last; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm.scratch import shuffle_partitions
from webgrain.llm.simhash import shingle_hashes

WORDS, SIZE = 5, 256
LEAST = -(1 << 63)
#: Ranges of ids for each shuffle partition.
RANGES = 8


def sketch(text: str, words: int = WORDS, k: int = SIZE) -> np.ndarray:
    return np.unique(shingle_hashes(text.encode(), words))[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = SIZE) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = SIZE) -> float:
    """Shared shingles over all shingles."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    return len(_common(a, b, union)) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = SIZE) -> float:
    """The share of a's shingles that b has."""
    union = merge(a, b, k)
    own = np.intersect1d(union, a, assume_unique=True)
    return len(_common(a, b, union)) / len(own) if len(own) else float(not len(a))


def _common(a: np.ndarray, b: np.ndarray, union: np.ndarray) -> np.ndarray:
    both = np.intersect1d(a, b, assume_unique=True)
    return both[both <= union[-1]]


def distinct_shingles(a: np.ndarray, k: int = SIZE) -> float:
    """Exact below k shingles, estimated from the k-th smallest value beyond."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[-1]) + 1)


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(np.uint64)


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as many first code points of the following text."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text, its edited text and the next text in descending id order: their sketches and likenesses.

    Ids are cut into ranges by quantiles and each range is one sorted run; the first document of
    every range also goes, as a guest, to the end of the range before it. Only the range bounds
    reach the driver, RANGES for each shuffle partition.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LEAST)).alias("id"), F.col(id_col).isNull().alias("no_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    steps = [i / (RANGES * parts) for i in range(1, RANGES * parts)]
    cuts = np.unique(np.array(rows.select(F.percentile_approx("id", steps, 100 * RANGES * parts)).first()[0] or [], np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="left").astype(np.int32))

    firsts = rows.select("id", range_of("id").alias("at")).groupBy("at").agg(F.max("id").alias("first")).collect()
    order = sorted(firsts, key=lambda r: -r["first"])
    guests = {r["first"]: order[i - 1]["at"] for i, r in enumerate(order)}
    first_ids = np.array(sorted(guests), np.int64)
    hosts = np.array([guests[i] for i in first_ids.tolist()], np.int32)

    @F.pandas_udf("int")
    def host_of(ids: pd.Series) -> pd.Series:
        at = np.minimum(np.searchsorted(first_ids, ids.to_numpy()), len(first_ids) - 1)
        return pd.Series(np.where(first_ids[at] == ids.to_numpy(), hosts[at], -1).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for batch in batches:
            for at, guest, i, no_id, text in zip(*(batch.column(c) for c in ("at", "guest", "id", "no_id", "text")), strict=True):
                text, guest, at = text.as_py(), guest.as_py(), at.as_py()
                own = None
                if held is not None and held[0] == at:
                    own = sketch(text)
                    out.append(finished(*held[1:], text, own))
                held = None if guest else (at, None if no_id.as_py() else i.as_py(), text, sketch(text) if own is None else own)
                if len(out) >= 512:
                    yield table(out)
                    out = []
        if out:
            yield table(out)

    def finished(i, text: str, own: np.ndarray, following: str, nxt: np.ndarray) -> tuple:
        changed = edited(text, following)
        other = sketch(changed)
        return (i, len(text), hashlib.sha256(changed.encode()).hexdigest(), to_text(own), to_text(other), resemblance(own, other),
                resemblance(own, nxt), distinct_shingles(own))

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    home = F.struct(range_of("id").alias("at"), F.lit(0).alias("guest"))
    placed = rows.withColumn("host", host_of("id")).withColumn("home", home).select("id", "no_id", "text", F.explode(
        F.when(F.col("host") >= 0, F.array("home", F.struct(F.col("host").alias("at"), F.lit(1).alias("guest")))).otherwise(F.array("home"))
    ).alias("p")).select("p.at", "p.guest", "id", "no_id", "text")
    runs = placed.repartition(parts, "at").sortWithinPartitions("at", "guest", F.desc("id"), "text")
    return runs.mapInArrow(run, f"`{id_col}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                "near_edited double, near_next double, n_shingles double")
