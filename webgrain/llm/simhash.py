"""SimHash fingerprints and near-duplicate classes by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan
distance of two such vectors is a lower bound of the Hamming distance, so a range join on the
vectors misses no link. The 32 dimensions are dealt into groups so that a link within
`max_bits` has a group whose distance is 2 at most; each vector enters, for each group, its own
unit cell and the neighbour cells one step away, and two vectors within 2 then meet in a cell.
Inside a cell fingerprints are compared exactly, and only a spanning forest of the links leaves
it. Cells with more than CELL_ROWS members are split into pairs of blocks, so no task holds an
unbounded cell and no link is lost.

Defined results: a null or empty text has no words and fingerprint zero, which links like any
other; fewer words than a shingle make one shingle of the whole sequence; repeated shingles
count each time (or once with distinct=True); rows that repeat are all returned; a null id is
kept and never names a component unless all ids of it are null; an empty table gives an empty
result; further columns are not read.
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

SEED = 42
SEGMENTS = 32
#: Members of a cell that are compared in one go; larger cells are dealt into pairs of blocks of half as many.
CELL_ROWS = 4096
#: Rows up to which the runs of a batch are compared side by side.
SHORT_RUN = 32

# ---- fingerprints ---------------------------------------------------------------------------


def shingle_hashes(text: bytes, words: int, least_bytes: int = 0) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of `words` words of a text with A-Z lower-cased, without shorter words unless all are."""
    tokens = text.lower().split()
    if least_bytes:
        tokens = [t for t in tokens if len(t) >= least_bytes] or tokens
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = np.concatenate(([0], ends[:-words] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[words - 1:].tolist(), strict=True)),
                       np.uint64, len(starts))


def _lanes() -> np.ndarray:
    """For each byte value, its eight bits as eight byte lanes of one word."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return bits.view(np.uint64).ravel()


LANES = _lanes()


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set when it is set in over half the hashes."""
    n = len(hashes)
    if not n:
        return 0
    lanes = LANES[hashes.view(np.uint8).reshape(n, 8)]
    full = n - n % 255
    sums = np.zeros(64, np.int64)
    if full:
        sums += lanes[:full].reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    if full < n:
        sums += lanes[full:].sum(axis=0, dtype=np.uint64).view(np.uint8).reshape(64).astype(np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, distinct: bool = False, least_bytes: int = 0, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs and `fp`, the fingerprint as a signed 64-bit integer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column("_text")):
                hashes = shingle_hashes(text.as_py(), words, least_bytes)
                out[i] = fingerprint(np.unique(hashes) if distinct else hashes)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out.view(np.int64))], names=[*keep, "fp"])

    rows = docs.select(*keep, F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("_text"))
    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", fp bigint")


# ---- range join on the embedding ------------------------------------------------------------


def dimension_groups(max_bits: int) -> list[range]:
    """So many groups that a distance of max_bits leaves one with 2 at most."""
    n = -(-(max_bits + 1) // 3)
    edges = [SEGMENTS * i // n for i in range(n + 1)]
    return [range(edges[i], edges[i + 1]) for i in range(n)]


def embed(fps: np.ndarray) -> np.ndarray:
    """The bit counts of the two-bit segments: one row of 32 for each fingerprint."""
    seg = (fps[:, None] >> (2 * np.arange(SEGMENTS, dtype=np.uint64))) & np.uint64(3)
    return (seg - (seg >> np.uint64(1))).astype(np.int8)


def cells_of(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell key, position in fps) for the unit cells at most one step from each vector, group by group."""
    vectors, keys, owners = embed(fps), [], []
    rows = np.arange(len(fps))
    for g, dims in enumerate(dimension_groups(max_bits)):
        digits = vectors[:, dims.start:dims.stop].astype(np.int64)
        power = 3 ** np.arange(len(dims), dtype=np.int64)
        home = digits @ power + (g << 54)
        keys.append(home)
        owners.append(rows)
        for d in range(len(dims)):
            for step, there in ((1, digits[:, d] < 2), (-1, digits[:, d] > 0)):
                keys.append(home[there] + step * power[d])
                owners.append(rows[there])
    return np.concatenate(keys), np.concatenate(owners)


def _cells(fps: DataFrame, max_bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                own = batch.column("fp").slice(at, 2048).to_numpy(zero_copy_only=False).view(np.uint64)
                keys, owners = cells_of(own, max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[owners].view(np.int64))], names=["cell", "fp"])
    return fps.mapInArrow(run, "cell bigint, fp bigint")


def merge_labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n rows reaches over the links i-j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _long_run(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """Labels inside one run by a search from row to row; each row is compared with the rows not reached yet."""
    label = np.full(len(fps), -1)
    left = np.arange(len(fps))
    while len(left):
        label[left[0]] = left[0]
        todo, root, left = [left[0]], left[0], left[1:]
        while todo and len(left):
            hit = np.bitwise_count(fps[left] ^ fps[todo.pop()]) <= max_bits
            found, left = left[hit], left[~hit]
            label[found] = root
            todo.extend(found.tolist())
    return label


def run_forest(key: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows of equal key (rows sorted by key): rows and the row each hangs on."""
    n = len(fps)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, n))
    per_row = np.repeat(size, size)
    left, right = [], []
    short = np.flatnonzero(per_row <= SHORT_RUN)
    for d in range(1, min(SHORT_RUN, int(size.max(initial=1)))):
        i = short[short + d < n]
        i = i[key[i] == key[i + d]]
        short = i
        if not len(i):
            break
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= max_bits]
        left.append(i)
        right.append(i + d)
    label = merge_labels(np.concatenate(left), np.concatenate(right), n) if left else np.arange(n)
    for at, count in zip(first[size > SHORT_RUN].tolist(), size[size > SHORT_RUN].tolist(), strict=True):
        label[at:at + count] = at + _long_run(fps[at:at + count], max_bits)
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


def fingerprint_links(fps: DataFrame, max_bits: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b) over distinct fingerprints `fp`: links that connect exactly what links within max_bits bits connect."""
    spark, parts = fps.sparkSession, shuffle_partitions(fps.sparkSession)
    hot = cut(_cells(fps, max_bits).groupBy("cell").count().where(F.col("count") > cell_rows).select(
        "cell", F.ceil(F.col("count") / (cell_rows // 2)).cast("int").alias("blocks")), "hot-cells")
    cells = _cells(fps, max_bits)
    if hot.isEmpty():
        units = cells.select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        placed = cells.join(hot, "cell", "left").withColumn("own", F.coalesce(own, F.lit(0)))
        units = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))).select(
            "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            new = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "fp"))
            key, fp = new if kept is None else tuple(np.concatenate(x) for x in zip(kept, new, strict=True))
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
            kept = key[whole:], fp[whole:]
            if whole:
                yield forest(key[:whole], fp[:whole])
        if kept is not None and len(kept[0]):
            yield forest(*kept)

    def forest(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        rows, roots = run_forest(key, fp.view(np.uint64), max_bits)
        pairs = np.unique(np.stack([fp[rows], fp[roots]], axis=1), axis=0) if len(rows) else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    unit = F.when(F.col("i") + F.col("j") == 0, F.col("cell")).otherwise(F.xxhash64("cell", "i", "j"))
    dealt = units.select(unit.alias("unit"), "fp").repartition(parts, "unit").sortWithinPartitions("unit", "fp")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def classes(rows: DataFrame, max_bits: int, id_col: str = "doc_id", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(fp, component_id) for the distinct fingerprints of rows (id_col, fp): the smallest id reachable."""
    own = cut(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprints")
    roots = components(fingerprint_links(own.select("fp"), max_bits, cell_rows))
    placed = cut(own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    names = cut(placed.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    return cut(placed.join(names, "root").select("fp", "component_id"), "classes")


def near_classes(docs: DataFrame, words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 lowercase hex digits), component_id."""
    rows = cut(fingerprints(docs, words, text_col=text_col, keep=(id_col,)), "doc-fingerprints")
    return rows.join(classes(rows, max_bits, id_col), "fp").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
