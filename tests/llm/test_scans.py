"""License scans, runs and clusters against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from webgrain.llm import clusters, licenses, registry, runs
from webgrain.llm.licenses import Template
from webgrain.llm.scratch import cut

NOTICE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
TEXTS = [None, "", "...", "one", "Released under the MIT License.", "UNDERÉTHE MIT license", "under the mit license under the MIT-License, under the the mit license",
         "Licensed under CC BY-NC 4.0. and cc by nc cc by nc", "Licensed under the Apache License, Version 2.0.", "the license, mit under", NOTICE, NOTICE.replace("hereby ", "").replace("free ", "FREE!"),
         "This work is licensed under the GNU General Public License, version 3.", "x " * 40 + NOTICE + " y" * 50, "permission is hereby granted", "Apache license" + " pad" * 20 + " version 2",
         "日本語 under the mit license 日本語", "w " * 15 + "under the mit license", "w " * 16 + "cc by nc", "mit " * 3000 + "under the mit license" + " license" * 3000]


def words(text):
    low = "".join(c.lower() if c < "\x80" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def scanned(text, templates, stride, threshold=licenses.THRESHOLD):
    own = words(text)
    places = sorted((i, t.label) for t in templates if t.phrase for i in range(len(own)) if own[i:i + len(t.words)] == t.words)
    scores = [(t.label, len(set(own[b:b + 2 * stride]) & set(t.words)) / len(set(t.words))) for t in templates if not t.phrase for b in range(0, len(own), stride)
              if len(set(own[b:b + 2 * stride]) & set(t.words)) >= threshold * len(set(t.words))]
    at = [i for i, _ in places]
    return (len(own), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})),
            ",".join(sorted({x for _, x in places} | {x for x, _ in scores})), max([1.0 for _ in places] + [s for _, s in scores], default=0.0))


def row(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(TEXTS + TEXTS[4:9])]
    wide = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *[F.lit(i).alias(c) for i, c in enumerate(("key", "words", "hits", "block", "rank", "score", "runs", "id", "label"))])
    return cut(wide.repartition(3, "text"), "awkward-scans")


TEMPLATES = [Template(label, text, phrase=True) for label, text in registry.OP11_PHRASES] + licenses.NOTICES


def test_license_scan(spark, docs):
    got = Counter((r.doc_id, *row(r)) for r in licenses.scan(docs, TEMPLATES).collect())
    want = Counter((r.doc_id, *scanned(r.text, TEMPLATES, licenses.STRIDE)) for r in docs.collect())
    assert got == want and sum(want.values()) == len(TEXTS) + 5
    assert {x for r in got for x in r[6].split(",")} >= {"mit", "apache-2", "cc-by-nc", "gpl"}
    assert licenses.scan(docs.limit(0), TEMPLATES).count() == 0


def test_license_scan_of_random_words(spark):
    """Few words, so that blocks, prefixes and places meet in all ways; repeated words within templates too."""
    rng = random.Random(5)
    templates = [Template("p", "a b", True), Template("q", "a a b", True), Template("r", "c", True), Template("s", "a b c d e"), Template("t", "b c e f g h i j"), Template("t", "k l m k")]
    rows = [(i, " ".join(rng.choices("aabcdefghijklmnop", k=rng.randint(0, 60)))) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    for stride in (8, 13):
        got = {r.doc_id: row(r) for r in licenses.scan(table, templates, stride=stride).collect()}
        assert got == {i: scanned(t, templates, stride) for i, t in rows}
    with pytest.raises(ValueError):
        licenses.scan(table, templates, stride=3)


def all_runs(own, e, least):
    """By extending every pair of equal words, period by period."""
    out = set()
    for p in range(1, len(own) // 2 + 1):
        i = 0
        while i + p < len(own):
            j = i
            while j + p < len(own) and own[j] == own[j + p]:
                j += 1
            n = j - i + p
            if j > i and n >= max(least, e * p) and not any(own[i:i + n - q] == own[i + q:i + n] for q in range(1, p)):
                out.add((i, n, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_all_runs_are_found():
    rng = random.Random(1)
    for _ in range(1500):
        own = rng.choices(range(rng.randint(1, 4)), k=rng.randint(0, 50))
        if rng.random() < 0.4:
            s, p = rng.randint(0, len(own)), rng.randint(1, 5)
            own = [own[s + (i - s) % p] if s + p <= len(own) and i >= s else w for i, w in enumerate(own)]
        own = own * rng.choice((1, 1, 2, 3))
        for e, least in ((2, 2), (3, 3), (4, 6)):
            assert runs.find_runs(np.array(own, np.int64), e, least) == all_runs(own, e, least)
    with pytest.raises(ValueError):
        runs.find_runs(np.arange(5), 1, 2)


def periodic(i, text):
    own = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(own)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = [w if k < a else own[a + (k - a) % p] for k, w in enumerate(own)]
    return own


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(9)
    rows = [(None, "a b " * 9), (1, None), (2, ""), (3, " \n\t "), (4, "na " * 6), (4, "na " * 6), (5, "x y z " * 12), (6, "a b c " * 4 + "d"), (7, "r s " * 3000), (8, "q" * 200_000)]
    rows += [(i, " ".join(rng.choices("abc", k=rng.randint(0, 80)))) for i in range(10, 400)]
    spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_words", F.lit(1)).withColumn("runs", F.lit(2)).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for i, t in rows:
        own = periodic(i, t)
        found = all_runs(own, 4, 6) if len(own) < 500 else [(0, len(own), 2)]
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        want[(i, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest(),
              hashlib.sha256(b" ".join(w for k, w in enumerate(own) if k not in gone)).hexdigest())] += 1
    got = registry.op12_periodic_runs(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == want
    assert sum(n for r, n in want.items() if r[1]) > 60 and any(r[1] > 1 for r in want)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert runs.periodic_runs(empty).count() == 0
    assert [tuple(x) for x in runs.periodic_runs(spark.createDataFrame([(1, "a b a b")], "doc_id bigint, text string"), 2, 2).first().runs] == [(0, 4, 2)]


def lloyd(vectors, k, rounds):
    first = sorted(range(len(vectors)), key=lambda i: (vectors[i][0] is None, hashlib.sha256(f"1:{vectors[i][0]}".encode()).hexdigest(), vectors[i][1]))[:k]
    centroids = [vectors[i][1] for i in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in vectors:
            groups[nearest(v)[1]].append(v)
        for j, own in groups.items():
            centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, *nearest(v)[::-1]) for i, v in vectors], centroids


def test_clusters(spark):
    rng = random.Random(3)
    spots = [[rng.uniform(-1, 1) for _ in range(5)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(spots)]) for i in range(400)]
    rows += [(i + 400, [float(rng.randint(-1, 1)) for _ in range(5)]) for i in range(200)]  # many ties
    rows += rows[:20] + [(None, [0.5] * 5), (7, [0.0] * 5)]
    bad = [(900, None), (901, [1.0] * 4), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [float("nan")] * 5), (904, [float("inf")] + [0.0] * 4), (905, [])]
    table = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>").withColumn("vec", F.lit("x")).withColumn("cluster", F.lit("y"))
    whole = [(i, [int(np.floor(8 * x)) for x in v]) for i, v in rows]
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    for k, rounds, width in ((9, 0, None), (9, 6, None), (9, 12, 1), (4, 5, 3), (1, 2, None)):
        found, centroids = clusters.cluster(table, k=k, rounds=rounds, dim=5, scale=8.0, width=width)
        want, centres = lloyd(whole, k, rounds)
        got = found.collect()
        assert sorted(map(key, ((r.vec_id, r.cluster, r.distance) for r in got))) == sorted(map(key, want))
        assert centroids.tolist() == centres
        if rounds > 5:
            assert sum(r.scans for r in got) < 0.6 * len(rows) * k * (rounds + 1)  # bounds spare work
    few, centroids = clusters.cluster(table.where("vec_id in (30, 50, 900)"), k=9, rounds=2, dim=5, scale=8.0)
    assert len(centroids) == 2 and [r.distance for r in few.collect()] == [0, 0]
    none, centroids = clusters.cluster(table.limit(0), dim=5)
    assert clusters.with_inertia(none, centroids).count() == 0
    with pytest.raises(PySparkException):
        clusters.cluster(spark.createDataFrame([(1, [1e30] * 5)], "vec_id bigint, embedding array<double>"), dim=5)
    large = spark.createDataFrame([(i, [rng.uniform(-1e6, 1e6) for _ in range(5)]) for i in range(50)], "vec_id bigint, embedding array<double>")
    rows = [(r.vec_id, [int(np.floor(64 * x)) for x in r.embedding]) for r in large.collect()]
    assert sorted((r.vec_id, r.cluster, r.distance) for r in clusters.cluster(large, k=7, dim=5)[0].collect()) == sorted(lloyd(rows, 7, 3)[0])


def test_twins(spark):
    from tests.conftest import SF
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name in ("op11_license_scan", "op13_clusters"):
        own = registry.QUERIES[name](spark, SF)
        twin = con.sql(registry.SQL[name])
        at = [own.columns.index(c) for c in twin.columns]
        assert Counter(tuple(r[i] for i in at) for r in own.collect()) == Counter(twin.fetchall()), name
