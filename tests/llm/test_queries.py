"""The registered queries op2 to op10 against plain versions over the whole small tables."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from lanternway.llm import language_id, packing, queries
from test_methods import brute_fingerprint, plain_pii, plain_secrets
from tokenizers import Tokenizer

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def tokens(texts):
    full = Tokenizer.from_file(packing.default_vocabulary())
    return {i: np.array([*full.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}


def rows_of(spark, query, *columns):
    found = query(spark, SMALL)
    assert found.columns[: len(columns)] == list(columns)
    return [tuple(r)[: len(columns)] for r in found.collect()]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_op2(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    vectors = {r[0]: np.array(r[1], np.float64) for r in rows if r[1] is not None and len(r[1]) and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])}
    found = {}
    for q, rank, v, score in sorted(rows_of(spark, queries.op2_vector_search, "query_id", "rank", "vec_id", "score")):
        assert score == pytest.approx(float(vectors[q] @ vectors[v]), rel=1e-12, abs=1e-12)
        found.setdefault(q, []).append((rank, v))
    hit = total = 0
    for q in (i for i in vectors if i % 20 == 0):
        best = sorted((-float(vectors[q] @ x), i) for i, x in vectors.items() if i != q)[:20]
        assert [r for r, _ in found[q]] == list(range(1, len(best) + 1))
        hit, total = hit + len({i for _, i in best} & {v for _, v in found[q]}), total + len(best)
    assert hit >= 0.9 * total and found.keys() == {i for i in vectors if i % 20 == 0}


def test_op3(spark, tokens):
    rows = rows_of(spark, queries.op3_best_fit_packing, "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    at, fill = dict.fromkeys(tokens, 0), {}
    for i, start, length, crc, n, _, _ in sorted(rows):
        assert start == at[i] and n == len(tokens[i]) and crc == zlib.crc32(tokens[i][start : start + length].tobytes())
        at[i] += length
    assert at == {i: len(t) for i, t in tokens.items()}
    for _, _, length, _, _, s, offset in sorted(rows, key=lambda r: r[5:]):
        assert fill.get(s, 0) == offset
        fill[s] = offset + length
    assert max(fill.values()) <= 1024 and len(fill) <= 1.02 * sum(at.values()) / 1024 + 1


def test_op4(spark, texts):
    got = {r[0]: r[1:] for r in rows_of(spark, queries.op4_simhash_cover, "doc_id", "fingerprint", "component_id")}
    fp = {i: brute_fingerprint(t) for i, t in texts.items()}
    name = {i: i for i in fp}
    links = [(i, j) for i in fp for j in fp if i < j and (fp[i] ^ fp[j]).bit_count() <= 2]
    while any(name[i] != name[j] for i, j in links):
        for i, j in links:
            name[i] = name[j] = min(name[i], name[j])
    assert got == {i: (f"{fp[i]:016x}", name[i]) for i in fp}


def test_op5(spark, texts):
    """Held-out rows are those of the contract; the chosen language is that of a plain nearest-profile vote in most cases."""
    rows = rows_of(spark, queries.op5_language_id, "doc_id", "held_out", "lang_pred", "score")
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r[0]: r[1] for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    assert all((p == "und") == (not any(c.isalpha() for c in texts[i])) and 0 <= s <= 1 for i, _, p, s in rows)
    learned = [(i, z) for i, z in lang.items() if z and texts[i] and zlib.crc32(str(i).encode()) % 5]
    assert {p for _, _, p, _ in rows} <= {z for _, z in learned} | {"und"}
    x = language_id.profiles([texts[i] for i, _ in learned])
    mean = {z: x[[k for k, (_, y) in enumerate(learned) if y == z]].mean(0) for z in {z for _, z in learned}}
    asked = [(i, p) for i, _, p, _ in rows if p != "und"]
    near = [max(mean, key=lambda z: float(v @ mean[z])) for v in language_id.profiles([texts[i] for i, _ in asked])]
    assert np.mean([a == p for a, (_, p) in zip(near, asked, strict=True)]) >= 0.9
    known = [(p, lang[i]) for i, h, p, _ in rows if h and lang[i] and p != "und"]
    assert np.mean([p == z for p, z in known]) >= 0.95


def test_op6(spark, texts):
    seen, want = set(), {}
    for i in sorted(texts):
        raw = texts[i].encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        want[i] = len(raw), int(gone.sum()), int((np.diff(np.append(False, gone).astype(int)) == 1).sum()), sha(kept)
    assert {r[0]: r[1:] for r in rows_of(spark, queries.op6_suffix_array, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")} == want


@pytest.mark.parametrize(("query", "plain", "kinds"), [(queries.op7_secret_scan, plain_secrets, ("assign", "access", "hex")), (queries.op10_pii_crf, plain_pii, ("email", "ip", "card", "phone"))])
def test_op7_and_op10(spark, texts, query, plain, kinds):
    for i, *counts, base, spans in rows_of(spark, query, "doc_id", *(f"n_{k}" for k in kinds), "base_sha256", "spans"):
        want = [f"{kinds[k]}:{a}:{b}" for a, b, k in plain(texts[i])]
        assert counts == [sum(w.startswith(f"{k}:") for w in want) for k in kinds] and base == sha(",".join(want))
        assert set(want) <= set(filter(None, spans.split(",")))
        assert all(re.fullmatch(r"[a-z_]+:\d+:\d+", s) for s in filter(None, spans.split(",")))


def test_op8(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    want = con.sql(queries.ORACLE["op8_exact_dedup"]).fetchall()
    assert sorted(rows_of(spark, queries.op8_exact_dedup, "doc_id", "keep_id", "group_size", "kept", "text_sha256")) == sorted(want)


def test_op9(spark, tokens):
    want, at = [], 0
    for i in sorted(tokens):
        want.append((i, at, len(tokens[i]), zlib.crc32(tokens[i].tobytes())))
        at += len(tokens[i])
    assert sorted(rows_of(spark, queries.op9_token_files, "doc_id", "start", "n_tokens", "ids_crc32")) == want
