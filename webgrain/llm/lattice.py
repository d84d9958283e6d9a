"""Scores of texts by a subword lattice: the marginal probability over all segmentations.

The pieces and their weights are those of an existing vocabulary. Where its scores are merge ranks
and no logarithms, a piece weighs the less the later it was merged (Zipf's law: one over the rank).
A text is its words (A-Z lower-cased, between ASCII white space), each after a word mark, and an end.
No piece crosses a word mark, so a text's probability is the product over its words of the sum over
all segmentations of the word, by a forward recursion in log space, times the probability of the end.
Characters that the vocabulary lacks are spelled by its byte pieces.

Learning counts every word of every training document. The vocabulary's weights give each piece its
expected uses over all segmentations of every distinct training word, times the word's count, and
what is expected plus PRIOR uses in the vocabulary's proportions are the pieces' probabilities; a
second round starts from these. A training word also enters its lattice as one more piece, the whole
word, with its count c less a discount D; what the discounts set free weights the other segmentations:
    P(word) = max(c - D, 0) / N + D V / N * (sum over segmentations into vocabulary pieces)
Word counts stay distributed; only sums over the pieces of the vocabulary and counts of counts reach
the driver.

Many words are worked on side by side, position by position; a word of over LONG_WORD characters
goes alone, piece by piece.

Defined results: a null text is the empty text and consists of the end alone; without training
documents the pieces have the vocabulary's weights, the end is as likely as a piece on average and
the baseline has N = V = 0; rows that repeat are scored each; rows whose mark is null are not learnt
from; a very long text is a block of its own; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.llm.caches import trimmed
from webgrain.llm.scratch import cut, shuffle_partitions
from webgrain.llm.wordblocks import WordBlocks, Words

MARK = "▁"
#: Uses that the vocabulary's weights count for, all pieces together.
PRIOR = 1000.0
#: Rounds of expectation over the lattices of the distinct words.
ROUNDS = 2
#: Text in a block; a block's words are rows here, so it is smaller than where they are packed.
BLOCK_BYTES = 6 << 20
#: Characters that are worked on side by side, and the length from which a word goes alone.
CELLS, LONG_WORD = 1 << 16, 512
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_FACTOR, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


class SpacedWords(Words):
    def slots(self, text: str) -> bytes:
        words = self.words
        return np.array([words.setdefault(w, len(words)) for w in text.encode().translate(_UPPER).split()], np.uint32).tobytes()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Lattice:
    """The pieces of a vocabulary and their natural logarithms; logs: size + 1 of them, the end's last (None: the vocabulary's weights)."""

    def __init__(self, model: bytes, logs: np.ndarray | None = None):
        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = own.get_piece_size()
        listed = [i for i in range(self.size) if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i)) and own.get_score(i) > -1e6]
        self.bytes = [own.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.pieces = {own.id_to_piece(i): i for i in listed}
        self.longest = max(map(len, self.pieces), default=1)
        self.logs = self.weights(own, listed) if logs is None else np.asarray(logs, float)
        hashes = np.empty(len(self.pieces), np.uint64)
        for k, piece in enumerate(self.pieces):
            h = 0
            for code in _codes(piece).tolist():
                h = (h * int(_FACTOR) + code) % (1 << 64)
            hashes[k] = h * int(_MIX) % (1 << 64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.fromiter(self.pieces.values(), np.int32, len(self.pieces))[order]
        self.likely = np.zeros(1 << _FILTER_BITS, bool)
        self.likely[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def weights(self, own: sentencepiece.SentencePieceProcessor, listed: list[int]) -> np.ndarray:
        """Logarithms of the vocabulary's weights; byte pieces weigh as much as the least piece, the end the mean."""
        scores = np.array([own.get_score(i) for i in listed])
        ranked = len(scores) > 0 and scores.min() < -1000
        weight = 1.0 / (1.0 - scores) if ranked else np.exp(scores)
        out = np.zeros(self.size + 1)
        out[listed] = weight
        out[self.bytes] = weight.min(initial=1.0)
        out[-1] = out.sum() / max(1, (out > 0).sum())
        with np.errstate(divide="ignore"):
            return np.log(out / out.sum())

    # -- many words at once

    def match(self, codes: np.ndarray) -> np.ndarray:
        """[length - 1, word, place]: the piece of that length that begins there, -1: none. codes: a row for each word, filled up with zeros."""
        n, wide = codes.shape
        out, h = np.full((min(self.longest, wide), n, wide), -1, np.int32), np.zeros((n, wide), np.uint64)
        for length in range(1, len(out) + 1):
            h = h[:, :wide - length + 1] * _FACTOR + codes[:, length - 1:]
            mixed = h * _MIX
            row, place = np.nonzero(self.likely[mixed >> np.uint64(64 - _FILTER_BITS)] & (codes[:, length - 1:] != 0))
            sought = mixed[row, place]
            at = np.minimum(np.searchsorted(self.hashes, sought), len(self.hashes) - 1)
            same = self.hashes[at] == sought
            out[length - 1, row[same], place[same]] = self.ids[at[same]]
        return out

    def spelled(self, codes: np.ndarray, found: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Give the characters that are no pieces numbers from size + 1 on, in found; these characters, and the logarithms of all numbers."""
        lacking = (found[0] < 0) & (codes != 0)
        chars = np.unique(codes[lacking])
        found[0][lacking] = self.size + 1 + np.searchsorted(chars, codes[lacking])
        costs = [sum(self.logs[self.bytes[b]] for b in chr(c).encode("utf-8", "surrogatepass")) for c in chars.tolist()]
        return chars.tolist(), np.concatenate([self.logs, costs, [-np.inf]])  # the last for -1

    def _batches(self, words: list[str]):
        """(numbers of the words, codes, lengths) of words of about the same length."""
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        order, at = np.argsort(sizes, kind="stable"), 0
        while at < len(order):
            stop = at + 1
            reach = order[at:at + CELLS // int(sizes[order[at]]) + 1]
            stop = at + max(1, int(np.searchsorted(sizes[reach] * np.arange(1, len(reach) + 1), CELLS, side="right")))
            own = order[at:stop]
            lengths = sizes[own]
            codes = np.zeros((len(own), int(lengths[-1])), np.uint64)
            codes[np.arange(codes.shape[1]) < lengths[:, None]] = _codes("".join(MARK + words[i] for i in own.tolist()))
            yield own, codes, lengths
            at = stop

    @staticmethod
    def _sum(parts: list[np.ndarray]) -> np.ndarray:
        stack = np.stack(parts)
        top = stack.max(axis=0)
        top[top == -np.inf] = 0.0
        with np.errstate(divide="ignore"):
            return top + np.log(np.exp(stack - top).sum(axis=0))

    def _ahead(self, costs: np.ndarray) -> np.ndarray:
        n, wide = costs.shape[1:]
        ahead = np.full((wide + 1, n), -np.inf)
        ahead[0] = 0.0
        for t in range(1, wide + 1):
            ahead[t] = self._sum([ahead[t - k] + costs[k - 1, :, t - k] for k in range(1, min(len(costs), t) + 1)])
        return ahead

    def forward(self, words: list[str]) -> np.ndarray:
        """The natural logarithms of the probabilities of words after their marks."""
        out = np.empty(len(words))
        for own, codes, lengths in self._batches(words):
            if codes.shape[1] > LONG_WORD:
                for i in own.tolist():
                    out[i] = self.alone(MARK + words[i])[-1]
                continue
            found = self.match(codes)
            costs = self.spelled(codes, found)[1][found]
            out[own] = self._ahead(costs)[lengths, np.arange(len(own))]
        return out

    def expect(self, words: list[str], weights: np.ndarray, sums: np.ndarray) -> None:
        """Add to sums (size + 1) the expected uses of each piece in the words, times their weights."""
        for own, codes, lengths in self._batches(words):
            if codes.shape[1] > LONG_WORD:
                for i in own.tolist():
                    self.expect_alone(MARK + words[i], float(weights[i]), sums)
                continue
            found = self.match(codes)
            chars, logs = self.spelled(codes, found)
            costs = logs[found]
            (most, n, wide), every = costs.shape, np.arange(len(own))
            ahead, back = self._ahead(costs), np.full((wide + 1, n), -np.inf)
            back[lengths, every] = 0.0
            for t in range(wide - 1, -1, -1):
                step = self._sum([costs[k - 1, :, t] + back[t + k] for k in range(1, min(most, wide - t) + 1)])
                back[t] = np.where(t < lengths, step, back[t])
            base = np.log(weights[own]) - ahead[lengths, every]
            uses = np.zeros(len(logs))
            for k in range(1, most + 1):
                share = np.exp(ahead[:wide - k + 1] + costs[k - 1, :, :wide - k + 1].T + back[k:] + base)
                uses += np.bincount((found[k - 1, :, :wide - k + 1].T % len(logs)).ravel(), share.ravel(), len(logs))
            sums += uses[:self.size + 1]
            for char, n in zip(chars, uses[self.size + 1:-1].tolist(), strict=True):
                for b in chr(char).encode("utf-8", "surrogatepass"):
                    sums[self.bytes[b]] += n

    # -- one word alone

    def edges(self, text: str, at: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(place reached, pieces) from a place of the marked word."""
        single = False
        for stop in range(at + 1, min(len(text), at + self.longest) + 1):
            piece = self.pieces.get(text[at:stop])
            if piece is not None:
                single |= stop == at + 1
                yield stop, (piece,)
        if not single:
            yield at + 1, tuple(self.bytes[b] for b in text[at].encode("utf-8", "surrogatepass"))

    def alone(self, text: str) -> np.ndarray:
        """The logarithm of all ways to each place of the marked word."""
        ahead = np.full(len(text) + 1, -np.inf)
        ahead[0] = 0.0
        for i in range(len(text)):
            for j, pieces in self.edges(text, i):
                ahead[j] = np.logaddexp(ahead[j], ahead[i] + sum(self.logs[p] for p in pieces))
        return ahead

    def expect_alone(self, text: str, weight: float, sums: np.ndarray) -> None:
        ahead, back = self.alone(text), np.full(len(text) + 1, -np.inf)
        back[-1] = 0.0
        for i in range(len(text) - 1, -1, -1):
            for j, pieces in self.edges(text, i):
                way = back[j] + sum(self.logs[p] for p in pieces)
                back[i] = np.logaddexp(back[i], way)
                share = weight * math.exp(ahead[i] + way - ahead[-1])
                for p in pieces:
                    sums[p] += share


def _expected(words: DataFrame, model: bytes, logs: np.ndarray | None) -> np.ndarray:
    """The expected uses of the pieces in all training words; at most size numbers reach the driver from each task's sums."""
    context = words.sparkSession.sparkContext
    given = context.broadcast((model, logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lattice(*given.value)
        sums = np.zeros(own.size + 1)
        for batch in batches:
            own.expect([w.decode() for w in batch.column("word").to_pylist()], batch.column("c").to_numpy().astype(float), sums)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at])], names=["piece", "n"])

    found = words.where("c > 0").select("word", "c").mapInArrow(trimmed(run), "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(Lattice(model).size + 1)
    out[found["piece"].to_numpy()] = found["n"].to_numpy()
    return out


def learn(words: DataFrame, model: bytes, rounds: int = ROUNDS, prior: float = PRIOR) -> np.ndarray:
    """Natural logarithms of the pieces' probabilities, and of the end's by the vocabulary, from words (word, c)."""
    weights = Lattice(model).logs
    logs = weights
    for _ in range(rounds):
        uses = _expected(words, model, logs)[:-1] + prior * np.exp(weights[:-1])
        with np.errstate(divide="ignore"):  # control pieces have no uses
            logs = np.append(np.log(uses / uses.sum()), weights[-1])
    return logs


def score(docs: DataFrame, model: bytes, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id_col, marked (learnt from), n_tokens, n_known, train_tokens, base_score and score (log10 probabilities)."""
    spark = docs.sparkSession
    context = spark.sparkContext
    blocks = WordBlocks(docs, SpacedWords, id_col, text_col, learn_from, block_bytes)
    vocabulary = cut(blocks.vocabularies(), "vocabularies")
    words = cut(vocabulary.groupBy("word").agg(F.sum("marked").alias("c")).repartition(shuffle_partitions(spark)), "words")
    seen, kinds, once, twice = words.agg(F.coalesce(F.sum("c"), F.lit(0)), *[F.count_if(x) for x in (
        F.col("c") > 0, F.col("c") == 1, F.col("c") == 2)]).first()
    ends = blocks.rows.where("mark").count()
    tokens, kinds = int(seen) + ends, int(kinds) + (ends > 0)
    discount = once / (once + 2 * max(twice, 1)) if once else 0.5  # below 1, so that a word or an end that was seen once keeps a share
    logs = learn(words, model, rounds) if kinds > (ends > 0) else Lattice(model).logs
    given = context.broadcast((model, logs))
    floor = math.log10(tokens + kinds + 1)
    end_base = math.log10(ends + 1) - floor
    end_score = math.log10((ends - discount) / tokens) if ends else logs[-1] / math.log(10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lattice(*given.value)
        for batch in batches:
            values = own.forward([w.decode() for w in batch.column("word").to_pylist()]) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(values)], names=["word", "c", "value"])

    scored = cut(words.mapInArrow(trimmed(run), "word binary, c bigint, value double"), "scored-words")
    results = vocabulary.select("block", "slot", "word").join(scored, "word").select("block", "slot", "c", "value")

    def finish(own: pa.Table, ids: list, marks: list, sizes: np.ndarray, slots: np.ndarray) -> list[pa.RecordBatch]:
        c, value = (own.column(k).to_numpy() for k in ("c", "value"))
        owner = np.repeat(np.arange(len(ids)), sizes)
        total = lambda x: np.bincount(owner, x[slots], len(ids)) if len(slots) else np.zeros(len(ids))
        base, mixed = np.log10(c + 1.0) - floor, value
        if tokens:
            freed = math.log10(discount * kinds / tokens) + value
            mixed = np.where(c > 0, np.logaddexp(np.log(np.maximum(c - discount, 1e-300) / tokens), freed * math.log(10)) / math.log(10), freed)
        return [pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(marks, pa.bool_()), pa.array(sizes + 1), pa.array(total(c > 0).astype(np.int64) + (ends > 0)),
             pa.array(np.full(len(ids), tokens)), pa.array(total(base) + end_base), pa.array(total(mixed) + end_score)],
            names=[id_col, "marked", "n_tokens", "n_known", "train_tokens", "base_score", "score"])]

    return blocks.assemble(results, finish, f"`{id_col}` bigint, marked boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
