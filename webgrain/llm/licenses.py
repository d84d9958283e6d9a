"""License scans as an exact set-similarity join (DataFrame functions only).

Texts are cut into blocks of 2 x STRIDE words, each STRIDE words after the one before, so any stretch
of STRIDE + 1 words lies whole in a block. A template is a set of tokens; a block meets it if it
holds at least a given share of them. Tokens are ordered by their uses in all texts, rarest first. Of a
template's n tokens, of which need must be met, a block that meets it has one of the n - need + 1
rarest (prefix filter); it has need words at least (length filter); and its first common token with
the template has, counting itself, need tokens from it on in the order on both sides (positional
filter). What is left is compared whole.

Phrases are templates of which a block must hold all tokens, in their order and next to each other;
all their places are returned, each from the block in whose first half it begins.

A document's words are split once, and only those that templates know are written, with their places.
Only documents with a token of some prefix are shuffled on, by document and block, so no document is a
group. The uses of the templates' tokens, one row a token, are all that reaches the driver.

Defined results: a null or empty text has no words and no matches; rows that repeat are scanned each;
a null id stays null; a very long text is scanned whole; labels that several templates share count once;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.llm.exact_dedup import ascii_lower
from webgrain.llm.scratch import cut

#: Fixed value: what stands between words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STRIDE = 16
THRESHOLD = Fraction(4, 5)


@dataclass(frozen=True)
class Template:
    """phrase: the words must stand in this order; else a block must hold the threshold's share of them."""
    label: str
    text: str
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split(" ")

    def need(self, threshold: Fraction) -> int:
        n = len(set(self.words))
        return n if self.phrase else -int(-threshold * n // 1)


#: Sentences that stand in license notices and say which one it is, each with the label it gives.
NOTICES = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("apache-2", "you may not use this file except in compliance with the license"),
    Template("gpl", "licensed under the gnu general public license version 3"),
    Template("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("creative-commons", "licensed under a creative commons attribution 4 0 international license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def _rows(templates: Sequence[Template], uses: dict[str, int], threshold: Fraction) -> list[tuple]:
    """(template, label, phrase, words, need, tokens in the order of their uses)."""
    return [(i, t.label, t.phrase, t.words, t.need(threshold), sorted(set(t.words), key=lambda w: (uses.get(w, 0), w))) for i, t in enumerate(templates)]


def _one_of(token: Column, known: Sequence[str]) -> Column:
    return token.isin(*known)


def token_hits(docs: DataFrame, templates: Sequence[Template], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of all documents: key (its own number), id_col, n_words, hits (pos, tok), the words that templates know."""
    known = sorted({w for t in templates for w in t.words})
    hits = F.array_compact(F.transform("words", lambda w, i: F.when(_one_of(w, known), F.struct(i.alias("pos"), w.alias("tok")))))
    return cut(docs.select(F.col(id_col), words_of(F.col(text_col)).alias("words")).select(
        F.monotonically_increasing_id().alias("key"), id_col, F.size("words").cast("bigint").alias("n_words"), hits.alias("hits")), "license-hits")


def matches(hits: DataFrame, templates: Sequence[Template], threshold: Fraction = THRESHOLD, stride: int = STRIDE) -> DataFrame:
    """key, block (its first word is block x stride), template, label, phrase, containment, places (first words of a phrase).

    One row for each block and template that meet; a phrase's rows are those that have places.
    """
    spark = hits.sparkSession
    if any(len(t.words) > stride + 1 for t in templates):
        raise ValueError(f"a template has {stride + 1} words at most")
    uses = {r["tok"]: r["count"] for r in hits.select(F.explode("hits.tok").alias("tok")).groupBy("tok").count().collect()}
    rows = _rows(templates, uses, threshold)
    rare = sorted({w for r in rows for w in r[5][:len(r[5]) - r[4] + 1]})
    known = sorted({w for r in rows for w in r[5]}, key=lambda w: (uses.get(w, 0), w))
    rank = F.array_position(F.lit(known), F.col("h.tok")).cast("int")
    block = F.floor(F.col("h.pos") / stride).cast("int")
    some = hits.where(F.exists("hits.tok", lambda w: _one_of(w, rare))).select("key", "n_words", F.explode("hits").alias("h"))
    placed = some.select("key", "n_words", F.explode(F.when(block > 0, F.array(block, block - 1)).otherwise(F.array(block))).alias("block"),
                         F.struct(rank.alias("rank"), F.col("h.pos").alias("pos")).alias("at"))
    blocks = placed.groupBy("key", "block").agg(F.collect_list("at").alias("ats"), F.first("n_words").alias("n_words")).select(
        "key", "block", F.sort_array(F.array_distinct("ats.rank")).alias("ranks"), "ats", F.least(F.lit(2 * stride), F.col("n_words") - F.col("block") * stride).alias("n_block"))
    number = {w: i + 1 for i, w in enumerate(known)}
    prefixes = spark.createDataFrame(
        [(number[w], *r[:3], [number[x] for x in r[3]], r[4], [number[x] for x in r[5]], i) for r in rows for i, w in enumerate(r[5][:len(r[5]) - r[4] + 1])],
        "rank int, template int, label string, phrase boolean, words array<int>, need int, tokens array<int>, i int")
    common = F.array_intersect("tokens", "ranks")
    pairs = (blocks.where(F.arrays_overlap("ranks", F.lit([number[w] for w in rare]))).withColumn("rank", F.explode("ranks"))
             .join(F.broadcast(prefixes), "rank")  # a row for each prefix token of a template
             .where((F.col("n_block") >= F.col("need"))
                    & (F.size("tokens") - F.col("i") >= F.col("need")) & (F.size("ranks") - F.array_position("ranks", F.col("rank")) + 1 >= F.col("need")))
             .withColumn("common", common).where((F.col("common")[0] == F.col("rank")) & (F.size("common") >= F.col("need"))))
    from_place = F.transform("ats", lambda a: a["pos"] - F.array_position("words", a["rank"]) + 1)
    starts = F.array_sort(F.filter(F.array_distinct(from_place), lambda s: (s >= F.col("block") * stride) & (s < (F.col("block") + 1) * stride) & F.forall(
        F.sequence(F.lit(0), F.size("words") - 1), lambda k: F.exists("ats", lambda a: (a["pos"] == s + k) & (a["rank"] == F.get("words", k))))))
    found = pairs.withColumn("places", F.when(F.col("phrase"), starts).otherwise(F.array().cast("array<bigint>")))
    return found.where(~F.col("phrase") | (F.size("places") > 0)).select(
        "key", "block", "template", "label", "phrase", (F.size("common") / F.size("tokens")).alias("containment"), "places")


def scan(docs: DataFrame, templates: Sequence[Template], threshold: Fraction = THRESHOLD, stride: int = STRIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, n_words, n_base, first_word, last_word (places of phrases), base_labels, labels, score (the greatest containment that meets its template, else 0)."""
    hits = token_hits(docs, templates, id_col, text_col)
    found = matches(hits, templates, threshold, stride).groupBy("key").agg(
        F.sum(F.size("places")).alias("n_base"), F.min(F.array_min("places")).alias("first_word"), F.max(F.array_max("places")).alias("last_word"),
        F.collect_set(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), F.collect_set("label").alias("labels"), F.max("containment").alias("score"))
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return hits.select("key", id_col, "n_words").join(found, "key", "left").select(
        id_col, "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), F.col("first_word").cast("bigint").alias("first_word"),
        F.col("last_word").cast("bigint").alias("last_word"), joined("base_labels").alias("base_labels"), joined("labels").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
