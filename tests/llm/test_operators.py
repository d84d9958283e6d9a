"""The training-text operators on one awkward table, against brute force."""

import base64
import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
import public_tokenizers
import regex
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webgrain.llm import bytebpe, chunk_dedup, exact_dedup, language, lattice, near_dedup, packing, records, registry, scratch, simhash, sketch, url_filter
from webgrain.llm.components import components
from webgrain.llm.scratch import cut, fresh_path
from webgrain.llm.wordpiece import PieceEncoder

EN = "The quick brown fox jumps over the lazy dog and then it's gone, far away from the old house. "
DE = "Der schnelle braune Fuchs springt über den faulen Hund und läuft dann weit weg vom alten Haus. "
PASSAGE = " ".join(f"shared{i} word{i}" for i in range(40))
LONG = " ".join(f"tok{i % 977}x{i}" for i in range(20_000))
ROWS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "Hello World 42!"), (6, "hello WORLD 42!"), (6, "hello WORLD 42!"), (None, "no id at all"), (None, None),
    (7, EN * 20), (8, (EN * 20).replace("lazy", "LAZY")), (9, DE * 20), (10, EN * 6 + DE * 6), (11, "é\u0301 İstanbul ΣΑΣ\u2003x\u00a0y\x1cz  double  spaces \n\n mixed \n"),
    (12, LONG), (13, "12345 67890 !!! ???"), (14, "alpha beta. " + PASSAGE + " gamma delta."), (15, "other start, " + PASSAGE + " another end here."),
    (16, "日本語のテキスト русский текст ελληνικά"), (17, "<|endoftext|> it's we'll I'M\r\nok\tz"),
]
CLASHING = ["_removed", "_found", "unit", "class", "node", "root", "_row", "_key", "_id", "id", "fp", "digest", "mark", "row_id", "lang_pred", "score", "ids", "text2", "block", "slot"]


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    lang = F.when(F.col("doc_id").isin(9), "de").when(F.col("doc_id").isin(7, 8), "en")
    wide = table.select("*", lang.alias("lang"), F.lit("s").alias("source"), F.char_length("text").cast("bigint").alias("n_chars"), *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)])
    return cut(wide.repartition(3, "text"), "awkward")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def key(r):
    return -1 if r is None else r


def lower(text):
    return (text or "").encode().lower().decode()


# ---- tables between steps


def test_steps_drop_what_led_to_the_last_result(spark):
    import pathlib
    own = pathlib.Path(scratch.folder(spark).removeprefix("file:"))
    before = {p.name for p in own.iterdir()}
    outside = cut(spark.range(3), "outside")
    with scratch.step(spark):
        first = cut(spark.range(5), "first")
    assert first.count() == 5
    with scratch.step(spark):
        assert {p.name.split("-")[0] for p in own.iterdir() if p.name not in before} == {"outside"}
        second = cut(spark.range(7), "second")
    assert (outside.count(), second.count()) == (3, 7)


# ---- 9 exact dedup


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(ROWS)
    groups = collections.defaultdict(list)
    for i, t in ROWS:
        groups[hashlib.sha256(lower(t).encode()).hexdigest()].append(i)
    for r in got:
        own = groups[r.text_sha256]
        assert r.group_size == len(own) and r.keep_id == max((i for i in own if i is not None), default=None)
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept) == set(groups) and set(kept.values()) == {1}  # one row of each group, repeated rows included
    assert exact_dedup.exact_dedup(none).count() == 0


def test_digest_index_keeps_the_first_batch(spark):
    index = exact_dedup.DigestIndex(spark, "index_of_two_batches", 4)
    index.add(spark.createDataFrame([(5, "A"), (3, "a"), (4, "b")], "doc_id bigint, text string"))
    got = {r.doc_id: (r.keep_id, r.kept) for r in index.add(spark.createDataFrame([(9, "a"), (1, "c")], "doc_id bigint, text string")).collect()}
    assert got == {9: (5, False), 1: (1, True)}
    assert index.table().count() == 3
    again = lambda: {r.doc_id: (r.keep_id, r.kept) for r in index.add(spark.createDataFrame([(8, "d"), (7, "D"), (6, "b")], "doc_id bigint, text string"), batch="third").collect()}
    assert again() == again() == {8: (8, True), 7: (8, False), 6: (4, False)}  # a job that died after it had appended, run again
    assert index.table().count() == 4 and exact_dedup.DigestIndex(spark, "index_of_two_batches").buckets == 4
    tables = len(spark.catalog.listTables())
    exact_dedup.exact_dedup(spark.createDataFrame([(1, "x")], "doc_id bigint, text string")).collect()
    assert len(spark.catalog.listTables()) == tables


# ---- 8 URL rules


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/x", "block"), ("a.example.net", "/", "allow"), ("org", "/fr/", "allow"), ("org", "/fr/", "block")]
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.net", "http://example.net/", "http://www.example.net/en/y?q#f", "x://example.net/en/xyz", "http://a.example.net/en/x", "http://notexample.net/en/",
            "http://example.org/fr/1", "http://example.org/frx", "http://example.com/en/", "a://b://c/d", "http://example.net/en/\U0010ffff", "http://example.net/en/", "http://example.net/en/"]

    def brute(url):
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        m = regex.match(r"(?s)([^/?#]*)([^?#]*)", rest)
        host, path = "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]
        fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[2], best[3] if best else "allow"

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark, rules)).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark, rules)).count() == 0


# ---- 1 SimHash


def brute_fingerprint(text, words):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k:k + words]) for k in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_classes(docs, none):
    got = simhash.near_classes(docs).collect()
    assert sorted(key(r.doc_id) for r in got) == sorted(key(i) for i, _ in ROWS)
    want = collections.Counter((key(i), f"{brute_fingerprint(t, 4):016x}") for i, t in ROWS)
    assert collections.Counter((key(r.doc_id), r.fingerprint) for r in got) == want
    prints = {int(r.fingerprint, 16) for r in got}
    by_print = {int(r.fingerprint, 16): r.component_id for r in got}
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 4:
                assert by_print[a] == by_print[b]
    rows = [(key(r.doc_id), int(r.fingerprint, 16), key(r.component_id)) for r in got]
    for i, f, component in rows:  # the smallest id that links lead to
        reached, todo = {f}, [f]
        while todo:
            a = todo.pop()
            todo += (more := {b for b in prints if (a ^ b).bit_count() <= 4} - reached)
            reached |= more
        assert component == min((k for k, g, _ in rows if g in reached and k >= 0), default=-1), i
    assert simhash.near_classes(none).count() == 0


@pytest.mark.parametrize("max_bits", [3, 4, 5, 8])
def test_range_join_misses_no_link(spark, max_bits):
    rng = np.random.default_rng(max_bits)
    fps = list(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
    for f in fps[:40]:
        for flips in range(1, max_bits + 2):
            g = int(f)
            for b in rng.choice(64, flips, replace=False).tolist():
                g ^= 1 << b
            fps.append(np.uint64(g))
    values = np.unique(np.array(fps, np.uint64))
    table = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint")
    label = {int(v): int(v) for v in values}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for i, v in enumerate(values):
        for w in values[i + 1:][np.bitwise_count(values[i + 1:] ^ v) <= max_bits]:
            a, b = find(int(v)), find(int(w))
            label[max(a, b)] = min(a, b)
    for cell_rows in (4096, 8):  # whole cells, and cells dealt into pairs of blocks
        links = simhash.fingerprint_links(table, max_bits, cell_rows).collect()
        own = dict(label)
        assert all((r.a ^ r.b) % (1 << 64) in range(1 << 64) for r in links)
        mine = {int(v): int(v) for v in values}

        def root(x, mine=mine):
            while mine[x] != x:
                x = mine[x]
            return x
        for r in links:
            a, b = root(r.a % (1 << 64)), root(r.b % (1 << 64))
            mine[max(a, b)] = min(a, b)
        assert {v: root(v) for v in mine} == {v: find(v) for v in own}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- near copies


def test_near_dedup(spark, docs, none):
    words = [f"w{i * 7919 % 1000:03d}x" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:100] + ["changed"] + words[101:])), (3, " ".join(reversed(words))), (4, " ".join(words[:50])), (5, "")]
    for class_rows in (1024, 2):
        kept = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), class_rows=class_rows)
        assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    out = near_dedup.near_dedup(docs)
    assert out.columns == docs.columns
    left = {key(r.doc_id) for r in out.collect()}
    assert {9, 12, 14}.issubset(left) and not {7, 8} <= left
    assert near_dedup.near_dedup(none).count() == 0


def test_near_dedup_finds_block_edits(spark):
    """Pairs that differ by one block, at Jaccard 0.8 and more, among brute-force pairs."""
    rng = np.random.default_rng(11)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(3000)]
    rows = []
    for i, n in enumerate(np.repeat([30, 60, 120, 400, 1500], 12).tolist()):
        words = [vocabulary[k] for k in rng.integers(0, 3000, n)]
        block = [vocabulary[k] for k in rng.integers(0, 3000, n // 7)]
        other = (words + block, words[:n - n // 7], words[:n // 2] + block[:n // 12] + words[n // 2:])[i % 3]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    alike = [len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(alike) > 40
    kept = {r.doc_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {2 * i for i in range(len(alike))} | {2 * i + 1 for i, same in enumerate(alike) if not same}


# ---- 3 passages


def test_passages(spark, docs, none):
    out = chunk_dedup.dedup_passages(docs)
    assert out.columns == [*(c for c in docs.columns if c != "_removed"), "_removed"]
    got = {key(r.doc_id): r for r in out.collect()}
    assert PASSAGE in got[14].text and got[14]._removed is None
    assert "shared20" not in got[15].text and got[15].text.startswith("other start, ") and got[15].text.endswith(" another end here.")
    assert got[1].text is None and got[2].text == "" and got[12].text == LONG
    assert got[8].text.strip() == "" or "LAZY" in got[8].text
    assert out.count() == len(ROWS) and chunk_dedup.dedup_passages(none).count() == 0


def left_by_brute_force(rows, n=50):
    """What is left of each text when all its stretches of n words that a smaller id has are taken out."""
    spans = {i: [m.span() for m in chunk_dedup._WORD.finditer(t.encode())] for i, t in rows}
    owners, own = {}, {}
    for i, t in sorted(rows):
        words = [t.encode()[a:b] for a, b in spans[i]]
        own[i] = [b" ".join(words[w:w + n]) for w in range(len(words) - n + 1)]
        for x in own[i]:
            owners.setdefault(x, i)
    return {i: chunk_dedup.without(t.encode(), chunk_dedup.union([(spans[i][w][0], spans[i][w + n - 1][1]) for w, x in enumerate(own[i]) if owners[x] < i])).decode()
            for i, t in rows}


def test_passages_quoted_out_of_texts_that_have_copies(spark):
    """Quotations from the middle of a text that has a copy or a near copy, against brute force."""
    rng = np.random.default_rng(12)
    words = lambda n: ["".join(chr(97 + c) for c in rng.integers(0, 26, k)) for k in rng.integers(2, 11, n).tolist()]
    rows = []
    for n in np.repeat([50, 51, 55, 60, 70, 120], 10).tolist():
        host, at, i = words(300), int(rng.integers(60, 110)), len(rows)
        near = [*host[:280], *words(20)]
        rows += [(i, " ".join(host)), (i + 1, " ".join(host if n % 20 else near)), (i + 2, " ".join([*words(40), *host[at:at + n], *words(40)]))]
    got = {r.doc_id: r.text for r in chunk_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = left_by_brute_force(rows)
    assert [i for i in want if got[i] != want[i]] == []


def test_chunks_resist_insertions():
    rng = np.random.default_rng(5)
    text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(3000)).encode()

    def cut_at(t):
        ends = chunk_dedup.chunk_ends([t])[0]
        return {t[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)}

    a, b = cut_at(text), cut_at(text[:500] + b"INSERTED" + text[500:])
    assert len(a & b) >= len(a) - 4
    assert b"".join(text[x:y] for x, y in zip([0, *chunk_dedup.chunk_ends([text])[0][:-1]], chunk_dedup.chunk_ends([text])[0], strict=True)) == text
    assert max(len(c) for c in cut_at(b"a" * 5000)) <= chunk_dedup.CHUNK_MOST


# ---- 2 and 4 tokens


@pytest.fixture(scope="module")
def word_bpe():
    return registry.vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def word_ids(word_bpe):
    t = Tokenizer.from_str(word_bpe.decode())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_piece_encoder_is_the_library(word_bpe, word_ids):
    enc = PieceEncoder(word_bpe, cache_bytes=10_000)
    more = ["ǰ J\u030c", "don't won't 'S x'll", "ÀÉÎ ßtraße ÿ × ÷ ª º µ", "a\u0085b\u2028c", "<|ENDOFTEXT|> <|startoftext|>", "a<|endoftext|>b <|startoftext|", "A < B <|ENDOFTEXT|>", "x\x1fy", "1st 2nd 3,000.50", "Ünïcödé—dash…", "\u1e9e ﬁ Å A\u030a"]
    for text in [t or "" for _, t in ROWS] + more:
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == word_ids(text), text[:40]


def test_records_round_trip(spark, docs, none, word_bpe, word_ids):
    path = fresh_path(spark, "records")
    records.write_records(docs, f"{path}/data", word_bpe, end_id=1, files=2, block_bytes=16)
    records.write_index(spark, f"{path}/data", f"{path}/index")
    got = sorted(records.read_records(spark, f"{path}/data").collect(), key=lambda r: (r.part, r.piece, r.offset))
    want = collections.Counter((key(i), tuple([*word_ids(t), 1])) for i, t in ROWS)
    assert collections.Counter((key(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    order = [key(r.doc_id) for r in got]
    assert order == sorted(order)
    index = sorted(records.read_index(spark, f"{path}/index").collect(), key=lambda r: r.start)
    assert [r.start for r in index] == np.cumsum([0] + [r.n_tokens for r in index])[:-1].tolist()
    blob = {(r.part, r.piece): r.path for r in spark.read.format("binaryFile").load(f"{path}/data").select(
        F.regexp_extract("path", r"part-(\d+)-", 1).cast("int").alias("part"), F.regexp_extract("path", r"-c(\d+)", 1).cast("int").alias("piece"), "path").collect()}
    last = index[-1]
    with open(blob[last.part, last.piece].removeprefix("file:"), "rb") as file:
        doc_id, ids = records.read_at(file, last.offset, last.length)
    assert (doc_id, len(ids) // 4) == (last.doc_id, last.n_tokens)
    assert max(r.piece for r in got) > 0  # blocks so small that a part has a second file
    for r in spark.read.format("binaryFile").load(f"{path}/data").collect():  # frames and nothing else
        records.verify(bytes(r.content), *records.outline(bytes(r.content)))
    records.write_records(none, f"{path}/none", word_bpe, end_id=1)
    assert records.read_records(spark, f"{path}/none").count() == 0


def test_checksums_are_crc32c_and_found_wrong():
    data = np.frombuffer(b"123456789" + bytes(32) + bytes(range(256)) * 3, np.uint8)
    unmask = lambda m: ((m - records.MASK) % (1 << 32) >> 17 | (m - records.MASK) % (1 << 32) << 15) % (1 << 32)
    got = [unmask(int(x)) for x in records.masked_crc32c(data, np.array([0, 9]), np.array([9, 32]))]
    assert got == [0xE3069283, 0x8A9136AA]
    for n in range(40):  # the checksum of the last frame ends in the byte that the writer adds, whatever the payload
        block = bytearray(records.pack_block([n, None], [b"\5\0", bytes([n, 0, n, 1])], 2) + bytes([records.END]))
        offsets, lengths = records.outline(bytes(block))
        assert (offsets.tolist(), lengths.tolist()) == ([0, 27], [11, 15])
        records.verify(bytes(block), offsets, lengths)
        assert records.payload(bytes(block), 0, 11) == (n, b"\5\0\0\0") and records.payload(bytes(block), 27, 15) == (None, bytes([n, 0, 0, 0, n, 1, 0, 0]))
    for at in (3, 9, 14, 30, len(block) - 3):
        bad = block.copy()
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.verify(bytes(bad), *records.outline(bytes(bad)))


def test_packing(docs, none, word_bpe, word_ids):
    got = packing.pack(docs, word_bpe, end_id=2, max_len=64).collect()
    want = collections.Counter((key(i), tuple([*word_ids(t), 2])) for i, t in ROWS)
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 64 for r in got)
    whole = collections.defaultdict(list)
    for r in got:
        whole[key(r.doc_id)].append((r.start, r.length, r.doc_tokens, np.frombuffer(r.ids, "<u4").tolist()))
    for (i, ids), n in want.items():
        own = sorted(p for p in whole[i] if p[2] == len(ids))
        lengths = packing.piece_lengths(len(ids), 64)
        same = {m for (j, other), m in want.items() if j == i and len(other) == len(ids)}
        assert len(own) >= n * len(lengths) and same
        ids_of = collections.Counter((p[0], tuple(p[3])) for p in own)
        start = 0
        for length in lengths:  # repeated rows and rows without an id, too
            assert ids_of[start, ids[start:start + length]] >= n
            start += length
    assert len(got) == sum(n * len(packing.piece_lengths(len(ids), 64)) for (_, ids), n in want.items())
    path = fresh_path(docs.sparkSession, "buckets")
    packing.write_buckets(packing.pack(docs, word_bpe, end_id=2, max_len=64), path)
    assert {(r.bucket, r.length) for r in docs.sparkSession.read.parquet(path).select("bucket", "length").distinct().collect()} == {(r.length, r.length) for r in got}
    assert packing.pack(none, word_bpe, end_id=2).count() == 0
    assert packing.piece_lengths(4096 * 2 + 5, 4096) == [4096, 4096, 4, 1]


# ---- 5 languages


def test_language(spark, docs, none):
    model = language.train(docs)
    assert model.langs == ["de", "en"]
    got = {key(r.doc_id): r for r in language.identify(docs, model, keep=("doc_id",)).collect()}
    assert got[7].lang_pred == "en" and got[9].lang_pred == "de" and got[7].score == 1
    assert [s.lang for s in got[10].spans] == ["en", "de"] and abs(got[10].spans[0].end - 6 * len(EN)) < 30
    for i in (1, 2, 3, 13):
        assert (got[i].lang_pred, got[i].score, got[i].spans) == ("und", 0.0, [])
    assert language.identify(none, model).count() == 0
    blank = language.train(none)
    assert {r.lang_pred for r in language.identify(docs, blank).collect()} == {"und"}


def test_viterbi_is_exact():
    rng = np.random.default_rng(1)
    lengths = np.array([0, 1, 5, 3, 7])
    scores = rng.normal(0, 3, (lengths.sum(), 3)).astype(np.float32)
    got = language.viterbi(scores, lengths, 2.0)
    at = 0
    for n in lengths.tolist():
        own = scores[at:at + n].astype(float)
        worth = lambda p, own=own: sum(own[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        if n:
            best = max(worth([(k // 3**i) % 3 for i in range(n)]) for k in range(3**n))
            assert abs(worth(got[at:at + n].tolist()) - best) < 1e-5
        at += n


def test_viterbi_has_room_for_many_labels():
    scores = np.full((4, 300), -5.0, np.float32)
    scores[:, 250] = 0
    assert language.viterbi(scores, np.array([4]), 2.0).tolist() == [250] * 4


def test_language_against_plain_version(spark):
    """Every prediction and score of the query on the smallest table, with n-grams, scripts and the search written out word by word."""
    from tests.conftest import SF
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs.where(registry.fold(3) != 1))
    rows = {r.doc_id: (r.text or "", r.lang) for r in docs.collect()}
    taught = [(t, lang) for i, (t, lang) in rows.items() if zlib.crc32(str(i).encode()) % 3 != 1 and lang is not None]
    mask = (1 << 64) - 1

    def grams(word):
        letters = [0, *map(ord, word), 0]
        for n in language.ORDERS:
            for at in range(len(letters) - n + 1):
                part = letters[at:at + n]
                if n == 1 and part == [0] or part[0] == 0 == part[-1] and n == 2:
                    continue
                h = 0
                for k, c in enumerate(part, 1):
                    h = (h * 0x100000001B3 + c + k) & mask
                if 0 in part[1:-1] or part[0] == 0 == part[-1]:
                    continue
                yield (h * 0x9E3779B97F4A7C15 & mask) >> 48

    counts = {lang: collections.Counter() for lang in model.langs}
    for text, lang in taught:
        for w in language.words_of(text):
            counts[lang].update(grams(w))
    totals = {lang: sum(c.values()) + 0.5 * language.BUCKETS for lang, c in counts.items()}
    for i, (text, _) in sorted(rows.items())[::7]:
        words, best, back = language.words_of(text), None, []
        for w in words:
            own = [sum(math.log((counts[lang][g] + 0.5) / totals[lang]) for g in grams(w)) for lang in model.langs]
            if best is None:
                best = own
                continue
            top = max(best)
            back.append([k if b >= top - language.SWITCH else best.index(top) for k, b in enumerate(best)])
            best = [max(b, top - language.SWITCH) + x for b, x in zip(best, own, strict=True)]
        letters = collections.Counter()
        if best:
            label = best.index(max(best))
            for w, step in zip(reversed(words), [*reversed(back), None], strict=True):
                letters[label] += len(w)
                label = step[label] if step else label
        total = sum(letters.values())
        k = max(range(len(model.langs)), key=lambda x: (letters[x], -x))
        got = language.judge([text], model)[0]
        assert (got["lang_pred"], round(got["score"], 6)) == ((model.langs[k], round(letters[k] / total, 6)) if total else ("und", 0.0)), i


def test_held_out_accuracy(spark):
    from tests.conftest import SF
    got = registry.op5_language(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


# ---- 6 sketches


def test_sketch_laws():
    a, b = sketch.sketch(" ".join(f"w{i}" for i in range(3000))), sketch.sketch(" ".join(f"w{i}" for i in range(1000, 4000)))
    whole = sketch.sketch("")
    assert sketch.resemblance(whole, whole) == 1 and sketch.resemblance(a, whole) == 0 and sketch.resemblance(a, a) == 1
    assert abs(sketch.resemblance(a, b) - 0.5) < 0.12 and abs(sketch.containment(a, b) - 2 / 3) < 0.12
    assert abs(sketch.distinct_shingles(a) - 2996) < 600
    assert np.array_equal(sketch.from_text(sketch.to_text(a)), a)
    assert np.array_equal(sketch.merge(a, b), np.unique(np.concatenate([a, b]))[:sketch.SIZE])


def test_fingerprint_documents(spark, docs, none):
    got = sketch.fingerprint_documents(docs).collect()
    order = sorted(ROWS, key=lambda r: (-(key(r[0]) if r[0] is not None else -(1 << 63)), (r[1] or "").encode()))
    want = collections.Counter()
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        n = len(t) // 3
        want[key(i), len(t), hashlib.sha256((t[:len(t) - n] + nxt[:n]).encode()).hexdigest()] += 1
    assert collections.Counter((key(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == want

    def least(t):
        w = t.encode().lower().split()
        shingles = {b" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        return sorted({xxhash.xxh64_intdigest(x, 42) for x in shingles})[:sketch.SIZE]

    def alike(a, b):
        union = sorted({*a, *b})[:sketch.SIZE]
        return round(len(set(a) & set(b) & set(union)) / len(union), 9) if union else 1.0

    text = lambda a: base64.b64encode(b"".join(x.to_bytes(8, "big") for x in a)).decode()
    full = collections.Counter()
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        n = len(t) // 3
        a, b, c = least(t), least(t[:len(t) - n] + nxt[:n]), least(nxt)
        full[key(i), text(a), text(b), alike(a, b), alike(a, c)] += 1
    assert collections.Counter((key(r.doc_id), r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == full
    assert sketch.fingerprint_documents(none).count() == 0
    one = sketch.fingerprint_documents(spark.createDataFrame([(1, "abc def")], "doc_id bigint, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1


# ---- 7 byte-level BPE


def test_byte_bpe(docs, none):
    ranks = registry.vocabulary("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(ranks), special_tokens={})
    got = bytebpe.decode(bytebpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks).collect()
    want = collections.Counter((key(i), tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in ROWS)
    assert collections.Counter((key(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in got) == want
    small = bytebpe.encode(docs, ranks, public_tokenizers.PATTERN, block_bytes=300).collect()  # many blocks a partition
    assert collections.Counter((key(r.doc_id), bytes(r.ids)) for r in small) == collections.Counter((key(r.doc_id), bytes(r.ids)) for r in got)
    for pattern in (public_tokenizers.PATTERN, r"[^ ]+ ?| ", r"\w+ \w+|(?s:.)"):  # the last two reach across spaces
        other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bytebpe.read_ranks(ranks), special_tokens={})
        own = bytebpe.PreTokens(pattern)
        for _, t in ROWS:
            slots = np.frombuffer(own.slots(t or ""), np.uint32).tolist()
            names = {n: w for w, n in own.words.items()}
            assert [x for k in slots for x in other._core_bpe.encode_single_piece(names[k])] == other.encode_ordinary(t or ""), pattern
    assert bytebpe.splits_at_spaces(public_tokenizers.PATTERN) and not bytebpe.splits_at_spaces(r"[^ ]+ ?| ")
    assert bytebpe.encode(none, ranks, public_tokenizers.PATTERN).count() == 0


# ---- 10 lattice scores


def ways(text, own, logs):
    """(pieces, probability) of every segmentation of a marked word."""
    if not text:
        yield [], 1.0
        return
    found = [(own.pieces[text[:n]],) for n in range(1, len(text) + 1) if text[:n] in own.pieces]
    lengths = [n for n in range(1, len(text) + 1) if text[:n] in own.pieces]
    if 1 not in lengths:
        found, lengths = [*found, tuple(own.bytes[b] for b in text[0].encode())], [*lengths, 1]
    for pieces, n in zip(found, lengths, strict=True):
        for rest, p in ways(text[n:], own, logs):
            yield [*pieces, *rest], math.exp(sum(logs[x] for x in pieces)) * p


def test_lattice_sums_all_segmentations(monkeypatch):
    model = registry.vocabulary("piece_bpe_32k.model")
    size = lattice.Lattice(model).size
    logs = np.log(np.random.default_rng(3).dirichlet(np.ones(size + 1)))
    own = lattice.Lattice(model, logs)
    words, counts = ["the", "banana", "ünï", "日", "x", "a" * 9, "\U0001f600ok", "▁▁b", "q%%%"], np.arange(1.0, 10.0)
    every = [list(ways(lattice.MARK + w, own, logs)) for w in words]
    want = np.array([math.log(sum(p for _, p in e)) for e in every])
    uses = np.zeros(size + 1)
    for e, c, total in zip(every, counts, want, strict=True):
        for pieces, p in e:
            for x in pieces:
                uses[x] += c * p / math.exp(total)
    for long_word, cells in ((512, 1 << 16), (512, 20), (2, 1 << 16)):  # side by side, in small batches, each word alone
        monkeypatch.setattr(lattice, "LONG_WORD", long_word)
        monkeypatch.setattr(lattice, "CELLS", cells)
        sums = np.zeros(size + 1)
        own.expect(words, counts, sums)
        assert np.allclose(own.forward(words), want, rtol=1e-9) and np.allclose(sums, uses, atol=1e-9)
    assert own.forward([]).size == 0


def test_lm_scores(docs, none):
    """All columns against a plain version: counts, two rounds of expectation word by word, discounts, the end."""
    model = registry.vocabulary("piece_bpe_32k.model")
    mark = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    tokens = lambda t: [*(t or "").encode().lower().decode().split(), None]
    split = lambda t: [*(w.decode() for w in (t or "").encode().lower().split()), None]
    seen = collections.Counter(w for i, t in ROWS if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in split(t))
    n, v, ends = sum(seen.values()), len(seen), seen[None]
    once, twice = (sum(c == k for w, c in seen.items() if w is not None) for k in (1, 2))
    discount = once / (once + 2 * max(twice, 1))
    first = lattice.Lattice(model)
    logs = first.logs
    for _ in range(lattice.ROUNDS):
        own, uses = lattice.Lattice(model, logs), lattice.PRIOR * np.exp(first.logs[:-1])
        uses = np.append(uses, 0.0)
        for w, c in seen.items():
            if w is not None:
                own.expect_alone(lattice.MARK + w, float(c), uses)
        with np.errstate(divide="ignore"):
            logs = np.append(np.log(uses[:-1] / uses[:-1].sum()), first.logs[-1])
    own = lattice.Lattice(model, logs)

    def worth(w):
        if w is None:
            return math.log10((ends - discount) / n)
        return math.log10(max(seen[w] - discount, 0) / n + discount * v / n * math.exp(own.alone(lattice.MARK + w)[-1]))

    known = {w: worth(w) for _, t in ROWS for w in split(t)}
    want = collections.Counter((key(i), len(split(t)), sum(seen[w] > 0 for w in split(t)), n, round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in split(t)), 4),
                                round(sum(known[w] for w in split(t)), 3)) for i, t in ROWS)
    assert tokens("a B") == split("a B")
    for block_bytes in (lattice.BLOCK_BYTES, 300):  # one block a partition, and many
        got = lattice.score(docs, model, mark, block_bytes=block_bytes).collect()
        assert collections.Counter((key(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 3)) for r in got) == want
    assert lattice.score(none, model, mark).count() == 0
    untaught = lattice.score(docs, model, F.lit(False)).collect()
    assert len(untaught) == len(ROWS) and all(r.score < 0 and r.train_tokens == 0 for r in untaught)


@pytest.mark.parametrize("rows", [[(3, "alpha beta gamma")], [(3, "alpha beta gamma"), (4, "held out beta")], [(3, "")], [(3, "alpha alpha alpha")], [(3, "a b"), (5, "c d e")]])
def test_lm_scores_of_few_training_words(spark, rows):
    """One training document, words that all occur once, none at all: finite scores, and the learnt words are the likelier ones."""
    few = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in lattice.score(few, registry.vocabulary("piece_bpe_32k.model"), F.col("doc_id") != 4).collect()}
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score < 0 for r in got.values())
    if 4 in got:
        assert got[3].score / got[3].n_tokens > got[4].score / got[4].n_tokens


# ---- pipeline


def test_pipeline(spark):
    import corpus_pipeline
    from tests.conftest import SF
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, SF), name)
        if name != "packing":
            assert out.columns == docs.columns and out.count() <= docs.count()
            docs = out
    assert out.select(F.sum("length")).first()[0] > docs.count()
    assert out.select("doc_id").distinct().count() == docs.count()


def test_pipeline_stages_against_brute_force(spark):
    """Exact, near and passages stages on sf0.001 with planted block edits and quotations."""
    import corpus_pipeline
    from tests.conftest import SF
    stages = dict(corpus_pipeline.STAGES)

    def quoted(text, first, last):
        spans = [m.span() for m in chunk_dedup._WORD.finditer(text.encode())]
        return text.encode()[spans[first][0]:spans[last - 1][1]].decode()

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = [r for r in docs.orderBy("doc_id").collect() if len(r.text.split()) >= 150][:12]
    made = []
    for i, r in enumerate(long):
        words, other = r.text.split(), long[i - 1].text.split()
        made += [(10**6 + 2 * i, " ".join(words + other[:len(words) // 8] if i % 2 else words[:len(words) * 7 // 8])),
                 (10**6 + 2 * i + 1, f"own {i} {quoted(r.text, 30, 81 + i)} end")]
    added = spark.createDataFrame(made, "doc_id bigint, text string")
    docs = cut(docs.unionByName(added.select([added[c].cast(docs.schema[c].dataType).alias(c) if c in added.columns else F.lit(None).cast(docs.schema[c].dataType).alias(c)
                                              for c in docs.columns])), "planted")
    rows = {r.doc_id: r.text for r in docs.collect()}
    exact = {text: max(i for i, t in rows.items() if t == text) for text in set(rows.values())}
    docs = cut(stages["exact"](spark, docs, SF), "exact")
    assert {r.doc_id for r in docs.collect()} == set(exact.values())
    ids = sorted(exact.values())
    sets = {i: set(simhash.shingle_hashes(rows[i].encode(), 5).tolist()) for i in ids}
    root = {i: i for i in ids}
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    docs = cut(stages["near"](spark, docs, SF), "near")
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept) == set(root.values()) and len(kept) < len(ids) - 6
    left = {r.doc_id: r.text for r in stages["passages"](spark, docs, SF).collect()}
    want = left_by_brute_force(list(kept.items()))
    assert [i for i, t in want.items() if t != left.get(i, t if not t.strip() and t != kept[i] else None)] == []


def test_language_stage_keeps_mixed_text(spark):
    """A document in three languages, none with half of the letters, stays; one without letters goes."""
    import corpus_pipeline
    from tests.conftest import SF
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = {r.lang: r.text for r in docs.where("length(text) > 800").orderBy("doc_id").collect()}
    langs = sorted(long)[:3]
    mixed = "\n".join(long[lang][:n] for lang, n in zip(langs, (320, 240, 240), strict=True))
    made = spark.createDataFrame([(10**9, mixed), (10**9 + 1, "123 456 ...")], "doc_id bigint, text string")
    every = docs.unionByName(made.select([made[c].cast(docs.schema[c].dataType).alias(c) if c in made.columns else F.lit(None).cast(docs.schema[c].dataType).alias(c)
                                          for c in docs.columns]))
    left = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, every, SF).select("doc_id").collect()}
    assert 10**9 in left and 10**9 + 1 not in left


def test_pipeline_stages_take_awkward_tables(spark, docs, none):
    import corpus_pipeline
    from tests.conftest import SF
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, none, SF).count() == 0, name
        left = stage(spark, docs, SF)
        assert left.columns == docs.columns, name
        rows = left.collect()
        assert rows and all(r[c] == f"x{i}" for r in rows for i, c in enumerate(CLASHING)), name  # columns of any name keep their values
        assert collections.Counter(r.doc_id for r in rows) <= collections.Counter(i for i, _ in ROWS)
    assert corpus_pipeline.STAGES[4][1](spark, none, SF).count() == 0
    pieces = collections.Counter()
    for r in corpus_pipeline.STAGES[4][1](spark, docs, SF).collect():
        pieces[r.doc_id] += r.length
    assert set(pieces) == {i for i, _ in ROWS}
