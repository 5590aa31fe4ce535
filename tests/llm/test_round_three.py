"""Product codes, rank merges and importance resampling: brute force, the rank library, edge cases."""

import base64
import hashlib
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from lanternway.llm import byte_merge, queries, repeats, resampling, vector_codes
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_merge.default_vocabulary(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def by_sql(name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con.sql(queries.ORACLE[name])


# --- codes of vectors


@pytest.mark.parametrize("seed", range(8))
def test_partial_distance_finds_the_first_nearest_entry(seed):
    rng = np.random.default_rng(seed)
    width, k, top = int(rng.integers(1, 20)), int(rng.integers(1, 257)), [3, 500, 2**26][seed % 3]
    x, book = rng.integers(-top, top, (400, width)), rng.integers(-top, top, (k, width))
    book[rng.integers(0, k, k // 3)] = book[rng.integers(0, k, k // 3)]  # repeated entries: ties
    far = ((x[:, None] - book[None]).astype(np.int64) ** 2).sum(2)
    entry, distance = vector_codes.nearest(x, book)
    assert entry.tolist() == far.argmin(1).tolist() and distance.tolist() == far.min(1).tolist()


def brute_codes(vectors, rounds=4, parts=4, entries=256):
    """Codes by complete distances, with Python's integers."""
    x = [[math.floor(1024 * c) for c in v] for _, v in vectors]
    p = len(x[0]) // parts
    order = sorted(range(len(x)), key=lambda i: (vectors[i][0], vectors[i][1]))
    books = [[x[i][m * p : m * p + p] for i in order[:entries]] for m in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    for r in range(rounds + 1):
        code = [[min(range(len(books[m])), key=lambda e: (far(row[m * p : m * p + p], books[m][e]), e)) for m in range(parts)] for row in x]
        if r == rounds:
            break
        for m in range(parts):
            for e in range(len(books[m])):
                own = [x[i][m * p : m * p + p] for i in range(len(x)) if code[i][m] == e]
                if own:
                    books[m][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    error = [sum(far(row[m * p : m * p + p], books[m][c[m]]) for m in range(parts)) for row, c in zip(x, code, strict=True)]
    return ["".join(f"{v:02x}" for v in c) for c in code], error, hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def test_op11_is_its_sql(spark):
    got = queries.op11_partial_distance(spark, SMALL)
    want = by_sql("op11_partial_distance", "embeddings")
    assert got.columns == want.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_codes_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [round(float(c), 3) for c in rng.normal(0, 1, 8)]) for i in range(40)]
    good += [(7, good[3][1]), (7, good[3][1])]
    bad = [(50, None), (51, [0.1] * 7 + [None]), (52, [0.1] * 7 + [float("nan")]), (53, [0.1] * 7 + [float("inf")]), (54, [0.5] * 3), (55, []), (56, [1e30] * 8)]
    rows = [(i, v, i % 3 if i % 3 else None, "k", 1.0) for i, v in good + bad]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, key string, n double").repartition(3)
    used, books = vector_codes.learn(frame, entries=5)
    got = vector_codes.with_total(vector_codes.encode(used, books), "label", "error", "whole")
    code, error, digest = brute_codes(good, entries=5)
    assert books.sha256() == digest and got.columns == ["vec_id", "label", "key", "n", "code", "error", "whole"]
    assert sorted((r["vec_id"], r["code"].hex(), r["error"]) for r in got.collect()) == sorted((i, c, e) for (i, _), c, e in zip(good, code, error, strict=True))
    whole = {}
    for (i, _), e in zip(good, error, strict=True):
        whole[i % 3] = whole.get(i % 3, 0) + e
    assert all(r["whole"] == whole[r["vec_id"] % 3] for r in got.collect())
    used, books = vector_codes.learn(frame.limit(0))
    assert vector_codes.with_total(vector_codes.encode(used, books), "label", "error", "whole").collect() == []


def test_total_of_hot_and_rare_keys(spark):
    frame = spark.range(9000).select("id", F.when(F.col("id") % 3 > 0, F.col("id")).alias("key"), F.lit(2).cast("long").alias("n"))
    got = vector_codes.with_total(frame, "key", "n", "sum").groupBy((F.col("id") % 3 > 0).alias("rare"), "sum").count().collect()
    assert sorted(map(tuple, got)) == [(False, 6000, 3000), (True, 2, 6000)]


# --- merges by rank


def brute_merge(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], math.inf), i) for i in range(len(parts) - 1))
        if rank == math.inf:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_tree_merges_as_a_plain_loop():
    v, rng = byte_merge.vocabulary_at(byte_merge.default_vocabulary()), random.Random(4)
    for _ in range(400):
        piece = "".join(rng.choice(rng.choice(["ab", "the anding", "éüñ中日本語", "  \n", "01"])) for _ in range(rng.randint(1, 70))).encode()
        assert byte_merge.merged(piece, v.ranks) == brute_merge(piece, v.ranks)
    for least, most in ((2, 2), (3, 4), (5, 8), (9, 16), (17, 32), (33, 64)):
        pieces = [bytes(rng.choice(rng.choice([b"ab", b"the anding", b"\xc3\xa9\xe4", b"0123"])) for _ in range(rng.randint(least, most))) for _ in range(300)]
        assert byte_merge.merged_together(pieces, v.single, v.pairs) == [tuple(brute_merge(p, v.ranks)) for p in pieces]


ODD = ["", " ", "a", "it's I'LL we've", "  two  blanks \n\n x", "naïve 北京 привет ½ Ⅷ", "<|endoftext|>", "é ‍👩‍👩‍👧 ﻿", "a՘b࢏ 1\U00011de0", "\x00\x1c\x85 　", "ab" * 3000, "9" * 4000, " " * 5000 + "x", "\U00020000" * 300]


@pytest.mark.parametrize("text", ODD)
def test_ids_of_odd_texts_are_the_librarys(library, text):
    v = byte_merge.vocabulary_at(byte_merge.default_vocabulary())
    ids = v.encode([text])[0].tolist()
    assert ids == library.encode_ordinary(text) and v.decode(ids) == text.encode()


def test_every_code_point_is_cut_as_the_library_cuts_it(library):
    v = byte_merge.vocabulary_at(byte_merge.default_vocabulary())
    every = [lead + chr(c) + "z" for c in range(0x110000) if not 0xD800 <= c < 0xE000 for lead in "a1"]
    texts = ["\n".join(every[i : i + 65_536]) for i in range(0, len(every), 65_536)]
    for text, ids in zip(texts, v.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)


def test_op12_is_the_library_over_the_whole_table(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in texts.items():
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode_bytes(ids))))
    found = queries.op12_byte_merge(spark, SMALL)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_merges_of_odd_rows(spark):
    frame = spark.createDataFrame([(1, None, 1), (1, None, 1), (None, "", 2), (2, "x" * 70_000, 3)], "doc_id long, text string, ids int").repartition(1)
    got = {(r["doc_id"], len(r["ids"]), len(r["decoded"])) for r in byte_merge.encode(frame).collect()}
    assert {(i, d) for i, _, d in got} == {(1, 0), (None, 0), (2, 70_000)}
    assert byte_merge.encode(frame.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["x" * 1_000_000, " " * 2_000_000 + "a", "中" * 300_000, "ab" * 400_000])
def test_a_megabyte_in_one_piece_ends_within_a_minute(text):
    v, began = byte_merge.vocabulary_at(byte_merge.default_vocabulary()), time.time()
    assert v.decode(v.encode([text])[0].tolist()) == text.encode()
    assert time.time() - began < 60


# --- rows of one id, in the removal of repeats


def test_rows_of_one_id_are_told_apart_by_more_than_a_hash(spark):
    """1,000 rows without an id, and two texts of one 32-bit hash in rows of one id, against brute force."""
    text = F.concat(F.sha2(F.col("id").cast("string"), 256), F.sha2(F.concat(F.lit("x"), F.col("id").cast("string")), 256))
    same = spark.range(200_000).select(text.alias("text")).groupBy(F.hash("text")).agg(F.sort_array(F.collect_list("text")).alias("t")).where(F.size("t") > 1).first()
    a, b = same["t"][:2]
    rng = random.Random(8)
    parts = ["".join(rng.choice("abcdefg hij") for _ in range(120)) for _ in range(30)]
    rows = [(1, a), (5, a), (5, b)] + [(None, f"{i} " + " ".join(rng.sample(parts, 2))) for i in range(1000)]
    seen, want = {}, []
    rank = lambda i: -1 if i is None else i
    raws = sorted(((rank(i), t.encode()) for i, t in rows))
    for i, raw in raws:
        for p in range(len(raw) - 99):
            seen[raw[p : p + 100]] = min(seen.get(raw[p : p + 100], (i, p)), (i, p))
    for i, raw in raws:
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if seen[raw[p : p + 100]] < (i, p):
                gone[p : p + 100] = True
        want.append((i, len(raw), np.frombuffer(raw, np.uint8)[~gone].tobytes()))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((rank(r["doc_id"]), r["n_bytes"], bytes(r["kept"])) for r in repeats.remove_repeats(frame).collect()) == sorted(want)


# --- resampling


def brute_resample(texts, target, orders=1, percent=10, least=20):
    """`texts`: (id, text)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = lambda w: [" ".join(w[i : i + n]) for n in range(1, orders + 1) for i in range(len(w) - n + 1)]
    place = lambda f: zlib.crc32(f.encode()) % 10_000
    words = [split(t) for _, t in texts]
    s, t = np.zeros(10_000), np.zeros(10_000)
    for table, found in ((s, words), (t, map(split, target))):
        for w in found:
            for f in runs(w):
                table[place(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    out = []
    for (i, _), w in zip(texts, words, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[place(f)] for f in runs(w))
        out.append((i, len(runs(w)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {}
    for n, r in enumerate(able[: percent * len(able) // 100]):
        rank.setdefault(r, []).append(n + 1)
    return [(*r[:4], rank[r].pop() if rank.get(r) else None) for r in out]


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_op13_is_its_sql_and_a_plain_loop(spark):
    got = queries.op13_importance_resampling(spark, SMALL)
    want = by_sql("op13_importance_resampling", "documents", "benchmark")
    assert got.columns == want.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    texts = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert in_order(got.collect()) == in_order(want.fetchall()) == in_order(brute_resample(texts, target))


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_resampling_of_odd_rows(spark, orders):
    rng = random.Random(orders)
    texts = [(i, " ".join(rng.choice(["Alpha", "beta", "γάμμα", "delta9", "EPSILON", "-"]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    texts += [(3, texts[5][1]), (3, texts[5][1]), (None, texts[6][1]), (None, None), (70, ""), (71, None), (72, "..."), (73, "x y z" * 4000)]
    target = ["alpha beta alpha", None, "γάμμα Beta"]
    frame = spark.createDataFrame([(i, t, 1, "w") for i, t in texts], "doc_id long, text string, row int, word string")
    aims = spark.createDataFrame([(t, 5) for t in target], "text string, bucket int")
    got = resampling.resample(frame, aims, orders=orders, percent=50)
    assert in_order(got.collect()) == in_order(brute_resample(texts, target, orders, 50))


def test_resampling_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    assert [tuple(r)[:2] for r in resampling.resample(some, none).collect()] == [(1, 2)]


def test_no_word_is_shuffled_for_order_one(spark):
    rows = spark.createDataFrame([(1, "a b c")], "row long, text string")
    assert "Exchange" not in resampling.features(rows)._jdf.queryExecution().executedPlan().toString()
