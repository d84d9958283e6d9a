"""Runs: stretches of words that repeat with a period, found through longest previous factors.

Class numbers of all stretches of 1, 2, 4, ... words (prefix doubling) order the suffixes, and the
same classes say how far two places agree, forwards and backwards. Suffix array and LCP array give
for each place the longest factor that begins earlier too, and these cut the words into blocks, each
the longest that occurs before or a word that is new. A run that touches a block's border is found
by extending both ways from the border, for each period that the lengths of the two blocks allow; a
run that lies inside a block is a copy of one inside the block's earlier occurrence, and copies are
taken from buckets by start, left to right. Each run is found once.

A word of a run with exponent e occurs at least e times in its text, so only stretches of words that
occur that often are looked at; that loses nothing.

A document is one row and one piece of work: n words take O(n log n) time and 4 n bytes for each
doubling. Nothing is shuffled.

Defined results: a null or empty text has no words and no runs, and its collapsed text is empty;
rows that repeat are treated each; a null id stays null; a very long text is treated whole; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm.caches import trimmed

#: Words that are searched together.
TOGETHER = 100_000
#: Rows taken from a batch at a time.
ROWS = 256


class Factors:
    """Classes of all stretches of 2**k symbols, the suffix array and lengths of agreement."""

    def __init__(self, symbols: np.ndarray):
        self.n = n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        ranks = self._ranks(symbols[order], np.zeros(n, np.int64))
        level = np.full(n + 1, -1, np.int32)
        level[order] = ranks
        self.levels, h = [level], 1
        while True:
            sizes = np.bincount(level[:n], minlength=n)
            open_ = np.flatnonzero(sizes[level[:n]] > 1)
            if not len(open_):
                break
            after = np.minimum(open_ + h, n)
            pair = level[open_].astype(np.int64) * (n + 1) + level[after] + 1
            by = np.argsort(pair)
            level = level.copy()
            sorted_pair = pair[by]
            group = sorted_pair // (n + 1)
            level[open_[by]] = self._ranks(sorted_pair, group)
            self.levels.append(level)
            h *= 2
        self.rank = level[:n]
        self.sa = np.empty(n, np.int64)
        self.sa[self.rank] = np.arange(n)

    @staticmethod
    def _ranks(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Of sorted keys: the group's number (where its members begin in the order of suffixes) and how many keys of it are smaller."""
        at = np.arange(len(keys))
        begins = np.maximum.accumulate(np.where(np.append(True, keys[1:] != keys[:-1]), at, 0))
        group_begins = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), at, 0))
        return group + begins - group_begins

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and j on agree (i differs from j)."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][np.minimum(i, self.n)] == self.levels[k][np.minimum(j, self.n)]).astype(np.int64) << k
            i += step
            j += step
            total += step
        return total

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before i and j agree."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            fits = (a >= 0) & (b >= 0)
            step = (fits & (self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)])).astype(np.int64) << k
            i -= step
            j -= step
            total += step
        return total

    def agree(self, i: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
        """Whether 2**k symbols from i and j on agree; places outside never do."""
        fits = (i >= 0) & (j >= 0) & (i < self.n) & (j < self.n)
        return fits & (self.levels[k][np.where(fits, i, 0)] == self.levels[k][np.where(fits, j, 0)])

    def previous(self) -> tuple[list[int], list[int]]:
        """For each place the length of the longest factor that begins earlier too, and where it does."""
        n = self.n
        lcp = np.zeros(n + 1, np.int64)
        lcp[1:n] = self.ahead(self.sa[:-1], self.sa[1:])
        wanted = np.flatnonzero(np.maximum(lcp[self.rank], lcp[self.rank + 1]) > 0)[::-1].tolist()
        rank, sa, common = self.rank.tolist(), self.sa.tolist(), lcp.tolist()
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        length, source = [0] * n, [0] * n
        for i in wanted:  # the latest place leaves first, so what is left at i begins earlier
            r = rank[i]
            lo, hi = before[r], after[r]
            a, b = common[r], common[hi]
            if a >= b:
                length[i] = a
                if a:
                    source[i] = sa[lo]
                common[hi] = b
            else:
                length[i], source[i] = b, sa[hi]
                common[hi] = a
            if lo >= 0:
                after[lo] = hi
            if hi < n:
                before[hi] = lo
        return length, source


def find_runs(symbols: np.ndarray, least_exponent: int = 2, least_length: int = 2) -> list[tuple[int, int, int]]:
    """All maximal runs of at least that many periods and symbols: (start, length, smallest period), by start, then period."""
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")
    n, e = len(symbols), least_exponent
    if n < max(2, least_length):
        return []
    own = Factors(symbols)
    length, source = own.previous()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += max(1, length[at])
    borders = np.array([*starts[1:], n], np.int64)
    sizes = np.diff(np.array([*starts, n, n], np.int64))
    most = (sizes[:-1] + sizes[1:]) // (e - 1)  # a run that ends in the block after a border has no longer period
    border = np.repeat(borders, most)
    period = np.arange(len(border)) - np.repeat(np.cumsum(most) - most, most) + 1
    border, period = np.concatenate([border, border - period]), np.concatenate([period, period])
    # One of both extensions takes half of what a run needs; the classes of that length tell at once.
    half = (np.maximum(least_length - period, (e - 1) * period) + 1) // 2
    level = np.log2(np.maximum(half, 1)).astype(np.int64)
    likely = np.zeros(len(border), bool)
    for k in range(len(own.levels)):
        some = np.flatnonzero(level == k)
        i, j = border[some], border[some] + period[some]
        likely[some] = own.agree(i, j, k) | own.agree(i - (1 << k), j - (1 << k), k)
    border, period = border[likely], period[likely]
    reach, back = own.ahead(border, border + period), own.behind(border, border + period)
    total = reach + back + period
    good = total >= np.maximum(least_length, e * period)
    found: dict[int, dict[int, int]] = {}  # by start: the end, and the smallest period
    for s, t, p in zip((border - back)[good].tolist(), total[good].tolist(), period[good].tolist(), strict=True):
        ends = found.setdefault(s, {})
        ends[s + t] = min(p, ends.get(s + t, p))
    if found:
        for b, size in zip(starts, np.diff([*starts, n]).tolist(), strict=True):
            far = b - source[b]
            for i in range(b + 1, b + size - least_length):
                if i - far in found:
                    inside = {end + far: p for end, p in found[i - far].items() if end + far < b + size}
                    if inside:
                        found[i] = inside | found.get(i, {})
    return sorted(((s, end - s, p) for s, ends in found.items() for end, p in ends.items()), key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: list[list[bytes]], least_exponent: int, least_length: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words; all are searched as one sequence in which no two share a symbol."""
    symbols, places, owners, offset = [], [], [], 0
    for t, words in enumerate(texts):
        if len(words) < least_length:
            continue
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        often = np.bincount(ids)[ids] >= least_exponent
        edges = np.diff(np.concatenate([[0], often.view(np.int8), [0]]))
        begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
            if e - b >= least_length:
                symbols += [ids[b:e] + offset, np.array([-1])]
                places.append(np.arange(b, e + 1))
                owners.append((t, e - b + 1))
        offset += len(numbers)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if symbols:
        line = np.concatenate(symbols)
        border = line < 0
        line[border] = offset + np.arange(border.sum())
        place, owner = np.concatenate(places), np.repeat([t for t, _ in owners], [n for _, n in owners])
        for s, n, p in find_runs(line, least_exponent, least_length):
            out[owner[s]].append((int(place[s]), n, p))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, without those that any run contains after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        gone[s + p] += 1
        gone[s + n] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, least_exponent: int = 4, least_length: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, runs (start, length, period: by start, then period) and the collapsed text of each document."""
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def table(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of_texts(texts, least_exponent, least_length)
        rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in found]
        kept = pa.array([collapsed(w, r) for w, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in texts], pa.int64()), pa.array(rows, kind), kept],
                                          names=[id_col, "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                ids, texts, words = [], [], 0
                for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                    ids.append(i)
                    texts.append((text.as_py() or b"").split())  # at the bytes 0x20 and 0x09 to 0x0D
                    words += len(texts[-1])
                    if words >= TOGETHER:
                        yield table(ids, texts)
                        ids, texts, words = [], [], 0
                if ids:
                    yield table(ids, texts)

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    return rows.mapInArrow(trimmed(run), f"`{id_col}` bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
