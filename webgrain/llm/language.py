"""Language identification of whole texts that may mix languages.

Words are runs of letters. The script of a word's first letter narrows the candidate languages
to those whose training text uses that script; the word's score in each is the sum of the log
probabilities of its letter n-grams (hashed, with word ends). A Viterbi search over the words
with a penalty for each switch labels spans; the language with most letters is the prediction
and its share of all letters the score.

Learning counts n-grams over a bounded sample of labelled documents: about `sample_per_lang` of
each language, picked by a hash of the id. The model has BUCKETS x languages numbers, and there are
MOST_LANGS languages at most.

Defined results: a null text, an empty one or one without a letter is `und` with score 0 and no
span; without any training document everything is `und`; ties go to the alphabetically first
language; rows that repeat and null ids are predicted like others; a very long text is one row of
words like any other, held whole; an empty table gives an empty result; other columns (the label,
the source) are never read by a prediction, and columns that are kept may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.llm.caches import trim, trimmed

UNKNOWN = "und"
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
#: Cost of a change of language, in nats.
SWITCH = 25.0
#: Taken from a language that does not use a word's script.
FOREIGN = 50.0
#: A language uses a script that has at least this share of its letters.
SCRIPT_SHARE = 0.01
#: Code points that are judged at once, besides what one text has more.
LETTERS_AT_ONCE = 1_000_000
CACHE_WORDS = 150_000
MOST_LANGS = 1000

#: First code points of the ranges of common scripts, and the script that starts there (0: any other).
SCRIPT_STARTS = [
    (0x0000, 0), (0x0041, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0),
    (0x0750, 6), (0x0780, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 0), (0x0B80, 9), (0x0C00, 0), (0x0E00, 10), (0x0E80, 0),
    (0x10A0, 11), (0x1100, 12), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 13), (0x3100, 0), (0x3400, 14),
    (0xA000, 0), (0xAC00, 12), (0xD800, 0), (0xF900, 14), (0xFB00, 1), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0x20000, 14), (0x30000, 0),
]
SCRIPTS = 15
_STARTS, _SCRIPT = (np.array(x) for x in zip(*SCRIPT_STARTS, strict=True))
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the word) of every n-gram; a word's ends count as letters."""
    codes = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = codes == 0
    number = np.cumsum(end) - 1
    buckets, owners = [], []
    mixed = np.zeros(len(codes), np.uint64)
    inside = np.ones(len(codes), bool)  # no word ends strictly within the n-gram
    for n in range(1, max(ORDERS) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        if n > 2:
            inside = inside[:size] & ~end[n - 2:n - 2 + size]
        mixed = mixed[:size] * np.uint64(0x100000001B3) + codes[n - 1:] + np.uint64(n)
        if n in ORDERS:
            ok = inside[:size] & ~(end[:size] & end[n - 1:]) if n > 1 else ~end
            h = mixed[ok] * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((h >> np.uint64(48)).astype(np.int64))
            owners.append(number[:size][ok])
    return np.concatenate(buckets), np.concatenate(owners)


def first_script(words: list[str]) -> np.ndarray:
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return _SCRIPT[np.searchsorted(_STARTS, first, side="right") - 1]


@dataclass
class LanguageModel:
    """weights: log probability of each bucket in each language; uses: whether a language uses a script."""

    langs: list[str]
    weights: np.ndarray
    uses: np.ndarray
    _index: dict[str, int] = field(default_factory=dict)
    _scores: np.ndarray | None = None
    _letters: np.ndarray | None = None
    _used: int = 0

    def __getstate__(self):
        return {"langs": self.langs, "weights": self.weights, "uses": self.uses, "_index": {}, "_scores": None, "_letters": None, "_used": 0}

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The scores of some words, and their letters (0: not a word after all)."""
        buckets, owners = word_features(words)
        out = np.stack([np.bincount(owners, self.weights[buckets, i], len(words)) for i in range(len(self.langs))], axis=1)
        use = self.uses[first_script(words)]
        out -= FOREIGN * (~use & use.any(axis=1, keepdims=True))
        letters = np.fromiter((sum(map(str.isalpha, w)) for w in words), np.int64, len(words))
        return (out - out.max(axis=1, keepdims=True)).astype(np.float32), letters

    def lookup(self, words: list[str]) -> np.ndarray:
        """Row numbers into the tables of cached scores."""
        new = list(dict.fromkeys(w for w in words if w not in self._index))
        if new:
            if self._scores is None or self._used + len(new) > len(self._scores):
                grown = max(1 << 16, 2 * (self._used + len(new)))
                scores, letters = np.empty((grown, len(self.langs)), np.float32), np.empty(grown, np.int64)
                if self._scores is not None:
                    scores[:self._used], letters[:self._used] = self._scores[:self._used], self._letters[:self._used]
                self._scores, self._letters = scores, letters
            at, stop = self._used, self._used + len(new)
            self._scores[at:stop], self._letters[at:stop] = self.score_words(new)
            self._index.update(zip(new, range(at, stop), strict=True))
            self._used = stop
        return np.fromiter(map(self._index.__getitem__, words), np.int64, len(words))

    def forget(self, most: int = CACHE_WORDS) -> None:
        if self._used > most:
            self._index, self._scores, self._letters, self._used = {}, None, None, 0


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word; texts lie one after the other and all move one word a step."""
    total, labels = scores.shape
    out = np.zeros(total, np.int16)
    if not total:
        return out
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")  # texts with a word at this step
    came = np.empty((total, labels), np.int16)
    best = scores[starts[:active[0]]].astype(np.float64)
    own = np.arange(labels, dtype=np.int16)
    last = np.empty(active[0], np.int16)
    for t in range(1, len(active)):
        n = int(active[t])
        if n < len(best):
            last[n:len(best)] = best[n:].argmax(axis=1)
            best = best[:n]
        top = best.argmax(axis=1)
        jump = best[np.arange(n), top][:, None] - switch
        at = starts[:n] + t
        came[at] = np.where(best >= jump, own, top[:, None].astype(np.int16))
        best = np.maximum(best, jump) + scores[at]
    last[:len(best)] = best.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        at = starts[:n] + t
        out[at] = last[:n]
        if t:
            last[:n] = came[at, last[:n]]
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = 2000,
          smoothing: float = 0.5) -> LanguageModel:
    """Learn from the rows of docs that have a label and a text."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().limit(MOST_LANGS + 1).collect()}
    langs = sorted(counts)
    if len(langs) > MOST_LANGS:
        raise ValueError(f"{lang_col} has more than {MOST_LANGS} languages")
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros((SCRIPTS, 0), bool))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, -(-1_000_000 * min(n, sample_per_lang) // n))])
    picked = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < F.element_at(share, F.col(lang_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {lang: i for i, lang in enumerate(langs)}
        sums = np.zeros((len(langs), BUCKETS + SCRIPTS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                if words:
                    sums[at[lang], :BUCKETS] += np.bincount(word_features(words)[0], minlength=BUCKETS)
                    sums[at[lang], BUCKETS:] += np.bincount(first_script(words), [len(w) for w in words], SCRIPTS).astype(np.int64)
        i, j = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(i, pa.int32()), "slot": pa.array(j, pa.int32()), "n": pa.array(sums[i, j])})

    found = picked.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), "lang int, slot int, n bigint")
    sums = np.zeros((BUCKETS + SCRIPTS, len(langs)))
    table = found.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()  # at most (BUCKETS + SCRIPTS) x languages rows
    sums[table["slot"].to_numpy(), table["lang"].to_numpy()] = table["n"].to_numpy()
    grams, scripts = sums[:BUCKETS] + smoothing, sums[BUCKETS:]
    return LanguageModel(langs, np.log(grams / grams.sum(axis=0)), scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0)))


def _spans(text: str, labels: np.ndarray, langs: list[str]) -> list[dict]:
    """Runs of equally labelled words as code point ranges that cover the text."""
    change = np.flatnonzero(labels[1:] != labels[:-1]) + 1
    at = [0]
    if len(change):
        low = text.lower()
        begins = [m.start() for m in _WORD.finditer(low if len(low) == len(text) else text)]
        at += [begins[c] if c < len(begins) else len(text) for c in change]
    return [{"start": a, "end": b, "lang": langs[labels[w]]}
            for a, b, w in zip(at, [*at[1:], len(text)], [0, *change], strict=True)]


FOUND = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))])


def judge(texts: list[str], m: LanguageModel, switch: float = SWITCH, with_spans: bool = True) -> list[dict]:
    """What `found` gives for each text."""
    langs = m.langs
    if not langs:
        return [{"lang_pred": UNKNOWN, "score": 0.0, "spans": []} for _ in texts]
    m.forget()
    found = [words_of(t) for t in texts]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    rows = m.lookup([w for ws in found for w in ws])
    weight = m._letters[rows] if len(rows) else np.empty(0, np.int64)
    labels = viterbi(m._scores[rows], lengths, switch) if len(rows) else np.empty(0, np.int16)
    owner = np.repeat(np.arange(len(texts)), lengths)
    sums = np.bincount(owner * len(langs) + labels, weight, len(texts) * len(langs)).reshape(len(texts), len(langs))
    total, top, stops = sums.sum(axis=1), sums.argmax(axis=1), np.cumsum(lengths)
    scores = (sums[np.arange(len(texts)), top] / np.maximum(1, total)).tolist()
    return [{"lang_pred": langs[k] if n else UNKNOWN, "score": x, "spans": _spans(t, labels[e - w:e], langs) if with_spans and n else []}
            for t, k, n, x, e, w in zip(texts, top, total, scores, stops, lengths, strict=True)]


def found(spark: SparkSession, text: Column, model: LanguageModel, switch: float = SWITCH, with_spans: bool = True) -> Column:
    """A struct of lang_pred, score and the spans (start, end in code points, lang). Of a row only the text goes to Python, once."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,spans:array<struct<start:int,end:int,lang:string>>>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for column in columns:
                out, texts, size = [], [], 0
                for value in column:
                    text = value.as_py()
                    if texts and size + len(text) > LETTERS_AT_ONCE:
                        out.append(pa.array(judge(texts, shared.value, switch, with_spans), FOUND))
                        texts, size = [], 0
                    texts.append(text)
                    size += len(text)
                out.append(pa.array(judge(texts, shared.value, switch, with_spans), FOUND))
                yield pa.concat_arrays(out)
        finally:
            shared.value.forget(0)
            trim()

    return run.asNondeterministic()(F.coalesce(text, F.lit("")))  # so that no filter makes it run twice


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", switch: float = SWITCH,
             with_spans: bool = True) -> DataFrame:
    """The kept columns of docs, lang_pred, score and spans."""
    rows = docs.select(F.struct(*keep).alias("_row"), found(docs.sparkSession, F.col(text_col), model, switch, with_spans).alias("_found"))
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in keep], "_found.*")
