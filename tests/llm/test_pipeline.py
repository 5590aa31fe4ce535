"""The corpus pipeline against a plain version on a small table."""

import tracemalloc

import corpus_pipeline
import numpy as np
from lanternway.llm import byte_tokens, language_id, simhash
from pyspark.sql import functions as F


def test_stages_decide(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "personal", "pack"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.written(stage(spark, now, ""), name)
        assert now.columns == docs.columns
        seen[name] = {r["doc_id"]: r["text"] for r in now.select("doc_id", "text").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    lettered = {i: t for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    assert seen["language"] == lettered
    last = {t: i for i, t in sorted(lettered.items())}
    assert set(seen["exact"]) == set(last.values())
    fp = dict(zip(seen["exact"], simhash.fingerprints(list(seen["exact"].values())).tolist(), strict=True))
    name = {i: i for i in fp}
    links = [(i, j) for i in fp for j in fp if i < j and (fp[i] ^ fp[j]).bit_count() <= 2]
    for _ in links:
        for i, j in links:
            name[i] = name[j] = min(name[i], name[j])
        if all(name[i] == name[j] for i, j in links):
            break
    assert set(seen["near"]) == {i for i in fp if name[i] == i}
    assert set(seen["personal"]) == set(seen["near"])
    assert any("[EMAIL]" in t for t in seen["personal"].values())
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
    tokens = {i: len(x) for i, x in zip(seen["personal"], byte_tokens.encode(list(seen["personal"].values()), byte_tokens.default_vocabulary()), strict=True)}
    got = {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == tokens


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").where("sequence_id is null").count() == 0


def test_pack_runs_one_python_step_a_stage(spark, monkeypatch):
    """Two in one stage would double an executor's Python workers, and these stay."""
    seen, pack = [], corpus_pipeline.packing.pack
    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda pieces: seen.append(pieces._jdf.queryExecution().executedPlan().toString()) or pack(pieces))
    corpus_pipeline.pack(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "")
    assert len(seen) == 1 and "MapInArrow" not in seen[0]


def test_comparing_near_copies_stays_small():
    """2,000 fingerprints that nearly all link, at one anchor: 4 million pairs in bounded memory."""
    one = np.uint64(0x0123456789ABCDEF)
    value = one ^ simhash.near_masks(2)[:2000]
    tracemalloc.start()
    a, b = simhash.compare(np.zeros(len(value), np.uint64), value, np.ones(len(value), bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(a.tolist()) | set(b.tolist()) == set(value.tolist()) and len(set(b.tolist())) == 1
    assert peak < 60e6


def test_no_profile_reaches_the_driver(spark, monkeypatch):
    """The language model is the same as one trained here on all rows, while only its weights are collected."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    frame, held = type(docs), []
    for method in ("collect", "toArrow", "toPandas"):
        monkeypatch.setattr(frame, method, lambda self, f=getattr(frame, method): held.append(f(self)) or held[-1])
    model = language_id.learn(docs)
    monkeypatch.undo()
    assert all(isinstance(x, list) for x in held)
    sizes = [sum(len(v) for v in r if isinstance(v, (bytes, bytearray))) for rows in held for r in rows]
    assert 0 < sum(sizes) < 1 << 20
    learned = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~language_id.held_out(F.col("doc_id"))).collect()
    assert len(learned) * 4 * language_id.WIDTH > 10 << 20
    learned.sort(key=lambda r: str(r["doc_id"]))
    plain = language_id.Model.fit(language_id.profiles([r["text"] for r in learned]), [r["lang"] for r in learned])
    assert model.families.names == plain.families.names and list(model.within) == list(plain.within)
    for a, b in [(model.families, plain.families), *((model.within[f], plain.within[f]) for f in plain.within)]:
        assert a.names == b.names and a.pairs == b.pairs and np.array_equal(a.weights, b.weights)


def test_all_machines_are_dealt(spark):
    """More machines than trainers, and languages that are families of their own."""
    langs = ["en", "de", "nl", "sv", "fr", "es", "ja", "zh", "ko"]
    rows = [(i, f"{z} text {z * (1 + i % 3)} {i % 7}", z) for i, z in enumerate(langs * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    learned = docs.where(~language_id.held_out(F.col("doc_id"))).collect()
    learned.sort(key=lambda r: str(r["doc_id"]))
    # a language with few rows may have its share cut; here all are far below it
    plain = language_id.Model.fit(language_id.profiles([r["text"] for r in learned]), [r["lang"] for r in learned])
    assert len(plain.families.pairs) + sum(len(m.pairs) for m in plain.within.values()) == 17 > language_id.TRAINERS
    for a, b in [(model.families, plain.families), *((model.within[f], plain.within[f]) for f in plain.within)]:
        assert a.names == b.names and a.pairs == b.pairs and np.array_equal(a.weights, b.weights)
