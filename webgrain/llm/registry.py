"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.llm import bytebpe as _bytebpe
from webgrain.llm import chunk_dedup as _chunks
from webgrain.llm import clusters as _clusters
from webgrain.llm import exact_dedup as _exact
from webgrain.llm import language as _language
from webgrain.llm import lattice as _lattice
from webgrain.llm import licenses as _licenses
from webgrain.llm import packing as _packing
from webgrain.llm import records as _records
from webgrain.llm import runs as _runs
from webgrain.llm import simhash as _simhash
from webgrain.llm import sketch as _sketch
from webgrain.llm import url_filter as _url
from webgrain.llm.scratch import fresh_path

#: The rules that op8 judges by.
OP8_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simhash.near_classes(_table(spark, sf_dir, "documents"), words=4, max_bits=4)


def vocabulary(name: str) -> bytes:
    """A vocabulary file of the public tokenizers; operators take its bytes, so any other file will do."""
    return Path(public_tokenizers.path(name)).read_bytes()


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-records")
    _records.write_records(_table(spark, sf_dir, "documents"), f"{path}/data", vocabulary("word_bpe_49k.json"), end_id=1)
    _records.write_index(spark, f"{path}/data", f"{path}/index")
    starts = _records.file_starts(spark.read.parquet(f"{path}/index"))
    rows = _records.read_records(spark, f"{path}/data").select(
        "part", "piece", "doc_id", "start_in_file", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return rows.join(starts, ["part", "piece"]).select(
        "doc_id", (F.col("start") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return _chunks.dedup_passages(docs).select(
        "doc_id", "text", F.coalesce(F.size("_removed"), F.lit(0)).alias("n_removed"),
        F.coalesce(F.aggregate("_removed", F.lit(0), lambda n, r: n + r["end"] - r["start"]), F.lit(0)).alias("removed_bytes"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2, max_len=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def fold(modulus: int):
    """crc32 of doc_id as text, modulo modulus (null: null)."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = _language.train(docs.where(fold(3) != 1))
    return _language.identify(docs, model).select(
        "doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sketch.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    encoded = _bytebpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return _bytebpe.decode(encoded, ranks).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _url.judge_urls(_table(spark, sf_dir, "pages"), _url.rule_table(spark, OP8_RULES))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _lattice.score(docs, vocabulary("piece_bpe_32k.model"), F.coalesce(fold(7) != 2, F.lit(True))).select(
        "doc_id", (~F.col("marked")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: The phrases that op11's base labels rest on.
OP11_PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = [_licenses.Template(label, text, phrase=True) for label, text in OP11_PHRASES] + _licenses.NOTICES
    return _licenses.scan(_table(spark, sf_dir, "documents"), templates)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; of every tenth crc32(doc_id) the words from some place on go round with some period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_words"), F.floor(h / 10).alias("_g"))
    n = F.size("_words")
    rows = rows.withColumn("_a", F.when(n > 0, F.col("_g") % n)).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    turned = F.array_join(F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(
        F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))), " ")
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), turned).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _runs.periodic_runs(with_periodic_tails(_table(spark, sf_dir, "documents").select("doc_id", "text")), least_exponent=4, least_length=6)
    better = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)  # noqa: E731  of equal ones the earlier stays
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    runs_text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(runs_text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = _clusters.cluster(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64.0, salt="1:")
    return _clusters.with_inertia(found, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_records": op2_token_records,
    "op3_passages": op3_passages,
    "op4_packing": op4_packing,
    "op5_language": op5_language,
    "op6_fingerprints": op6_fingerprints,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_url_filter": op8_url_filter,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_lm_score": op10_lm_score,
    "op11_license_scan": op11_license_scan,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_clusters": op13_clusters,
}

ASCII_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _clusters_sql(k: int, rounds: int, dim: int) -> str:
    """Assignments and means by turns, each a table expression."""
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c, q FROM v QUALIFY c < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS (SELECT rid, c, list_sum(list_transform(list_zip(v.q, c{i}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i}),
        a{i} AS MATERIALIZED (SELECT rid, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM d{i} GROUP BY rid)""")
        if i < rounds:
            parts.append(f"""p{i} AS (SELECT c, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS pos FROM a{i} JOIN v USING (rid)) GROUP BY ALL),
        m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS q FROM p{i} GROUP BY c),
        c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN m{i} USING (c))""")
    return f"""
        WITH {", ".join(parts)}
        SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (rid) JOIN c{rounds} USING (c)"""


def _licenses_sql(stride: int = 16) -> str:
    """Places by comparing slices; blocks and templates by intersecting sets."""
    phrases = ", ".join(f"('{label}', string_split('{text}', ' '))" for label, text in OP11_PHRASES)
    notices = ", ".join(f"('{t.label}', list_distinct(string_split('{t.text}', ' ')))" for t in _licenses.NOTICES)
    return f"""
        WITH phrase(label, ws) AS (VALUES {phrases}), notice(label, ws) AS (VALUES {notices}),
        d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id,
            regexp_extract_all({ASCII_LOWER_SQL.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        place AS (SELECT rid, label, unnest(list_filter(range(len(d.ws)), lambda i: d.ws[i + 1] = p.ws[1] AND d.ws[i + 1:i + len(p.ws)] = p.ws)) AS pos
            FROM d, phrase p WHERE list_has_all(d.ws, p.ws)),
        based AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY rid),
        block AS (SELECT rid, list_distinct(ws[b * {stride} + 1:(b + 2) * {stride}]) AS ws FROM (SELECT rid, ws, unnest(range((len(ws) + {stride - 1}) // {stride})) AS b FROM d)),
        met AS (SELECT rid, label, len(list_intersect(b.ws, n.ws)) / len(n.ws) AS score FROM block b, notice n WHERE len(list_intersect(b.ws, n.ws)) * 5 >= len(n.ws) * 4),
        label AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
            FROM (SELECT rid, label, score FROM met UNION ALL SELECT rid, label, 1.0 FROM place) GROUP BY rid)
        SELECT doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
        FROM d LEFT JOIN based USING (rid) LEFT JOIN label USING (rid)"""


SQL = {
    "op11_license_scan": _licenses_sql(),
    "op8_url_filter": f"""
        WITH p AS (
            SELECT page_id,
                   {ASCII_LOWER_SQL.format("regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1)")} AS host,
                   regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
            FROM pages),
        r(h, pre, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        m AS (
            SELECT p.host, p.path, max_by(h || pre, length(h) + length(pre)) AS rule,
                   max_by(v, length(h) + length(pre)) AS verdict
            FROM (SELECT DISTINCT host, path FROM p) p
            JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.pre)
            GROUP BY ALL)
        SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
        FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path""",
    "op9_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({ASCII_LOWER_SQL.format("coalesce(text, '')")}) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
        FROM d JOIN g ON d.text_sha256 = g.text_sha256""",
    "op13_clusters": _clusters_sql(16, 3, 64),
}
