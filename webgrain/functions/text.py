"""Column expressions over text: words, excerpts, dates, prices, contact data, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webgrain.functions import vocab as V

#: A word: letters, digits and underscore, with the combining marks and joiners inside it.
WORD = r"[\p{L}\p{N}_][\p{L}\p{N}\p{M}_" + "‌‍]*"
MIN_WORDS, MIN_HITS, MARGIN = 120, 8, 1.6


def pattern(name: str) -> str:
    """A named pattern with its flags and Unicode classes, as Java reads them."""
    text, flags = V.PATTERNS[name]
    return f"(?uU{flags.lower()})" + text


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def matches(text: Column, name: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(pattern(name))


def first_match(text: Column, name: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern(name), group), F.lit(""))


def all_matches(text: Column, name: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern(name)), F.lit(group))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_span(text: Column, name: str) -> Column:
    """struct(start, stop, m) of the first match, places from 0; null without a match."""
    full = F.coalesce(text, F.lit(""))
    found = lambda at: F.when(at > 0, F.struct((at - 1).alias("start"), F.regexp_extract(full, pattern(name), 0).alias("m")))  # noqa: E731  a text without a match is searched once
    return let(let(F.regexp_instr(full, F.lit(pattern(name))), found), lambda x: F.when(x.isNotNull(), F.struct(x["start"].alias("start"), (x["start"] + F.char_length(x["m"])).alias("stop"), x["m"].alias("m"))))


def spans(text: Column, name: str) -> Column:
    """struct(start, stop, m) of all matches in order: what stands between them gives their places."""
    full = F.coalesce(text, F.lit(""))
    cut = F.arrays_zip(F.split(full, pattern(name), -1).alias("gap"), F.regexp_extract_all(full, F.lit(pattern(name)), F.lit(0)).alias("m"))
    span = "array<struct<start:int,stop:int,m:string>>"

    def add(done: Column, x: Column) -> Column:
        start = done["at"] + F.char_length(x["gap"])
        stop = start + F.char_length(x["m"])
        return F.struct(stop.alias("at"), F.concat(done["list"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["m"].alias("m")))).alias("list"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("list"))
    found = F.aggregate(F.filter(cut, lambda x: x["m"].isNotNull()), begin, add, lambda done: done["list"])
    return F.when(full.rlike(pattern(name)), found).otherwise(F.array().cast(span))  # a text without a match is searched once


def guarded(text: Column, name: str, ok) -> Column:
    """The first match that ok(text, span) lets pass, as a span; null without one."""
    return let(F.coalesce(text, F.lit("")), lambda t: F.get(F.filter(spans(t, name), lambda s: ok(t, s)), F.lit(0)))


def window(text: Column, low: Column, high: Column) -> Column:
    """The characters from low to high, places from 0."""
    start = F.greatest(F.lit(0), low)
    return F.substring(text, start + 1, F.greatest(F.lit(0), high - start))


def around(text: Column, span: Column, before: int | Column = 40, after: int | Column = 100) -> Column:
    """A span with its surroundings, cut at spaces, with an ellipsis on each cut side; null without a span."""
    def sides(m: Column) -> Column:
        full, start, stop = m["t"], m["s"]["start"], m["s"]["stop"]
        low, high = F.greatest(F.lit(0), start - before), F.least(F.char_length(full), stop + after)
        return F.struct(full.alias("t"), low.alias("low"), high.alias("high"), F.locate(" ", F.substring(full, low + 1, start - low)).alias("gap"),
                        F.locate(" ", F.reverse(F.substring(full, stop + 1, high - stop))).alias("back"))

    def cut(x: Column) -> Column:
        return F.struct(x["t"].alias("t"), F.when((x["low"] > 0) & (x["gap"] > 0), x["low"] + x["gap"]).otherwise(x["low"]).alias("low"),
                        F.when((x["high"] < F.char_length(x["t"])) & (x["back"] > 0), x["high"] - x["back"]).otherwise(x["high"]).alias("high"))

    def show(x: Column) -> Column:
        return F.concat(F.when(x["low"] > 0, "…").otherwise(""), F.trim(F.substring(x["t"], x["low"] + 1, x["high"] - x["low"])),
                        F.when(x["high"] < F.char_length(x["t"]), "…").otherwise(""))

    found = F.struct(F.coalesce(text, F.lit("")).alias("t"), span.alias("s"))
    return let(found, lambda m: F.when(m["s"].isNotNull(), let(let(sides(m), cut), show)))


def excerpt(text: Column, name: str, before: int = 40, after: int = 100) -> Column:
    """The first match with its surroundings."""
    return around(text, first_span(text, name), before, after)


def clip(text: Column, limit: int = 200) -> Column:
    one = squeeze(text)
    return F.when(F.char_length(one) <= limit, one).otherwise(F.concat(F.substring(one, 1, limit - 1), F.lit("…")))


def clip_title(text: Column, limit: int = 90) -> Column:
    """At most `limit` characters, cut at a space of the second half where there is one."""
    one = squeeze(text)
    cut = F.substring(one, 1, limit - 1)
    trimmed = F.rtrim(cut)
    last = F.char_length(trimmed) - F.locate(" ", F.reverse(trimmed)) + 1
    at_space = F.locate(" ", F.substring(cut, limit // 2 + 1, limit)) > 0
    kept = F.when(at_space & (F.locate(" ", trimmed) > 0), F.substring(cut, F.lit(1), last - 1)).otherwise(cut)
    return F.when(F.char_length(one) <= limit, one).otherwise(F.concat(F.regexp_replace(kept, r"[ ,;:\-]+$", ""), F.lit("…")))


def usable_value(value: Column, context: Column | None = None) -> Column:
    """Text that the site states, rather than navigation: not blank, no menu separators, not from a header, nav or aside."""
    ok = (F.trim(F.coalesce(value, F.lit(""))) != "") & ~F.coalesce(value, F.lit("")).rlike(r"[|≡•·]")
    return ok if context is None else ok & ~F.coalesce(F.lower(F.trim(context)), F.lit("")).isin("header", "nav", "aside")


def looks_like_prose(text: Column, min_words: int = 4) -> Column:
    full = F.trim(F.coalesce(text, F.lit("")))
    return (full != "") & ~matches(full, "chrome_sep") & (F.size(F.split(full, r"\s+")) >= min_words) & matches(full, "prose_glue")


def normal_name(name: Column) -> Column:
    """Letters and digits of a brand name in lower case, without the legal form."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), pattern("legal_suffix"), ""), r"(?U)[^\p{L}\p{N}]+", "")


def parse_date(text: Column) -> Column:
    """ISO or written English dates; null for anything else, impossible days included."""
    iso = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
    plain = F.regexp_replace(F.regexp_replace(F.initcap(F.trim(text)), r"(\d)(?i:st|nd|rd|th)\b", "$1"), r"[.,]", "")
    short = F.regexp_replace(plain, r"\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\b", "$1")
    return F.coalesce(iso, F.try_to_date(short, "d MMM yyyy"), F.try_to_date(short, "MMM d yyyy"), F.try_to_date(F.concat(F.lit("1 "), short), "d MMM yyyy"))


def copyright_years(text: Column, as_of: Column) -> Column:
    """The year of each copyright notice: the later one of a range, the year of as_of for an open range."""
    first, last = all_matches(text, "copyright_year", 1), all_matches(text, "copyright_year", 2)
    return F.zip_with(first, last, lambda a, b: F.when(b.rlike(r"^\d{4}$"), b.cast("int")).when(b != "", F.year(as_of)).otherwise(a.cast("int")))


def emails(text: Column) -> Column:
    return F.filter(all_matches(text, "email"), lambda m: ~F.lower(m).rlike(r"\.(png|jpg|svg|gif)$"))


def prices(text: Column) -> Column:
    return all_matches(text, "price")


def detect_language(rows: DataFrame, key: str, text: str, stopwords: DataFrame) -> DataFrame:
    """(key, lang): the language of most function words, where 120 words hold 8 of them and 1.6 times the next language's; else null.

    One hash aggregation over the words that are function words; the dimension has about a hundred rows.
    """
    tokens = rows.select(key, word_count(F.col(text)).alias("n"), F.explode_outer(words(F.lower(F.col(text)))).alias("word"))
    hits = tokens.join(F.broadcast(stopwords.select("lang", "word").distinct()), "word").groupBy(key, "lang").agg(F.count(F.lit(1)).alias("hits"))
    ranked = hits.groupBy(key).agg(F.reverse(F.array_sort(F.collect_list(F.struct("hits", "lang")))).alias("best"))
    top, second = F.col("best")[0], F.coalesce(F.get("best", 1)["hits"], F.lit(0))
    sized = rows.select(key, word_count(F.col(text)).alias("n")).join(ranked, key, "left")
    clear = (F.col("n") >= MIN_WORDS) & (top["hits"] >= MIN_HITS) & ((second == 0) | (top["hits"] >= second * MARGIN))
    return sized.select(key, F.when(clear, top["lang"]).alias("lang"))


def majority(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the value of most rows; of equals, the one that comes first by order. Null values do not vote."""
    votes = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("at"))
    best = W.partitionBy(key).orderBy(F.desc("n"), "at")
    return votes.withColumn("rank", F.row_number().over(best)).where("rank = 1").select(key, value)
