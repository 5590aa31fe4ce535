"""The methods themselves, without Spark, against brute force and the public libraries."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lanternway.llm import byte_tokens, exact_dedup, language_id, packing, pii, repeats, secret_scan, simhash, token_files, vector_search, word_bpe
from lanternway.llm.components import local_stars

ODD = ["", " ", "a", "a  <|endoftext|> b", "<|STARTOFTEXT|> x's don't", "ΑΣ Σ É é", "=" * 300 + "abc" * 100, "a\x1cb　c\x85d", "İstanbul ﬁ ½ Ⅷ 12345 日本語 مرحبا 👍🏽 naïve", "<|startoftext|>́x", "\n\n\n", "x" * 5000]


@pytest.fixture(scope="module")
def vocabulary():
    return word_bpe.Vocabulary(word_bpe.default_vocabulary())


@pytest.mark.parametrize("size", [0, 3, 1000])
def test_word_bpe_equals_the_library(vocabulary, size):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcdeéß .,'1x") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    words = sorted({w for t in texts for w in word_bpe.words_of(t, vocabulary) if w[0] != " "})[:size]
    lexicon = word_bpe.Lexicon.compile(words, vocabulary)
    ids, n = word_bpe.encode_batch(texts, vocabulary, lexicon, lexicon.mapped())
    ends = np.append(0, np.cumsum(n))
    full = Tokenizer.from_file(word_bpe.default_vocabulary())
    want = full.encode_batch(texts, add_special_tokens=False)
    assert [w.ids for w in want] == [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]
    assert word_bpe.decode(ids, ends, vocabulary) == full.decode_batch([w.ids for w in want], skip_special_tokens=False)


@settings(max_examples=40, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=40), st.lists(st.text(max_size=4), max_size=20))
def test_transducer_places(words, others):
    words = sorted(words)
    automaton = word_bpe.Transducer(word_bpe.Transducer.build(words))
    asked = [w.decode("latin-1") for w in words] + others
    want = {w: i for i, w in enumerate(words)}
    assert automaton.places(asked).tolist() == [want.get(a.encode("utf-8", "surrogatepass"), -1) for a in asked]


def test_transducer_shares_suffixes():
    few = word_bpe.Transducer(word_bpe.Transducer.build(sorted(a + b"tion" for a in (b"a", b"b", b"c"))))
    assert len(few.final) == 6


def test_byte_tokens_equal_the_library():
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(byte_tokens.default_vocabulary())
    got = byte_tokens.encode(ODD, byte_tokens.default_vocabulary())
    assert [g.tolist() for g in got] == [[*full.encode(t, add_special_tokens=False).ids, 0] for t in ODD]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=1500))
def test_simple8b_round_trip(ids):
    x = np.array(ids, np.uint64)
    assert token_files.unpack_ids(token_files.pack_ids(x)).tolist() == ids


@pytest.mark.parametrize("seed", range(20))
def test_packing_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 32, 50])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
    left = []
    for n in sorted(lengths, reverse=True):
        fit = min(((r, i) for i, r in enumerate(left) if r >= n), default=None)
        if fit:
            left[fit[1]] -= n
        else:
            left.append(capacity - n)
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.best_fit_decreasing(counts, capacity)
    size = np.array([n for n in counts for _ in range(counts[n])], np.int64)
    rank = np.array([k for n in counts for k in range(counts[n])], np.int64)
    window, offset = plan.place(size, rank) if len(size) else (size, size)
    filled = {}
    for w, o, n in sorted(zip(window.tolist(), offset.tolist(), size.tolist(), strict=True)):
        assert filled.get(w, 0) == o
        filled[w] = o + n
    assert sorted(filled) == list(range(len(filled)))
    assert sorted(capacity - v for v in filled.values()) == sorted(left)


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    own = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_fingerprints():
    rng = random.Random(2)
    texts = [*(t for t in ODD), "A b", "É à  B\tc\x0bd e", *[" ".join(rng.choice(["ab", "Cd", "é", "x"]) for _ in range(rng.randint(1, 700))) for _ in range(12)]]
    assert simhash.fingerprints(texts).tolist() == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("blocks", [16, 21, 32])
def test_cover_loses_no_link(blocks):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 150).astype(np.uint64) * np.uint64(2)
    near = [base]
    for k in (1, 2, 3):
        y = base.copy()
        for _ in range(k):
            y = y ^ (np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64))
        near.append(y)
    x = np.unique(np.concatenate([*near, base[0] ^ simhash.near_masks()]))  # the last: a crowd around one
    i, j = np.nonzero((np.bitwise_count(x[:, None] ^ x[None]) <= 2) & (x[:, None] != x[None]))
    want = dict(zip(*(v.tolist() for v in local_stars(x[i], x[j])), strict=True))
    row, anchor, home = simhash.Cover(blocks).visits(x)
    got = dict(zip(*(v.tolist() for v in simhash.compare(anchor, x[row], home)), strict=True))
    assert got == want


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("limit", [1 << 20, 700])
def test_repeats_equal_brute_force(seed, limit):
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abcdefgh ", "a"])
    docs = []
    for _ in range(12):
        t = "".join(rng.choice(letters) for _ in range(rng.choice([0, 50, 99, 100, 101, 300, 700])))
        if docs and rng.random() < 0.7 and len(s := rng.choice(docs)) > 150:
            a = rng.randrange(len(s) - 100)
            t = t[: rng.randrange(len(t) + 1)] + s[a : a + rng.randrange(90, 400)] + t[:30]
        docs.append(t)
    docs = [t.encode() for t in docs]
    seen, want = set(), [np.zeros(len(r), bool) for r in docs]
    for i, r in enumerate(docs):
        for p in range(len(r) - 99):
            if r[p : p + 100] in seen:
                want[i][p : p + 100] = True
            seen.add(r[p : p + 100])
    size = np.array([len(r) for r in docs])
    first, data = np.cumsum(size) - size, np.frombuffer(b"".join(docs), np.uint8)
    text, window, n, h = repeats.anchors(data, first, size)
    rec = np.zeros(len(text), repeats.RECORD)
    rec["h"], rec["doc"], rec["start"], rec["n"] = h, text, window - first[text], n
    context = data[repeats.spread(window, n + 99)] if len(n) else data[:0]
    got = [np.zeros(len(r), bool) for r in docs]
    for part in repeats.find_repeats(rec, context, limit):
        for x in part:
            got[x["doc"]][x["start"] : x["n"]] = True
    assert all((a == b).all() for a, b in zip(got, want, strict=True))


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    data = rng.choice(np.frombuffer(b"ab", np.uint8), 600)
    data = np.concatenate([data, data[50:400], data[:300]])
    raw = data.tobytes()
    order, rank = repeats.suffix_array(data, 100)
    assert all(raw[a : a + 100] <= raw[b : b + 100] for a, b in zip(order, order[1:], strict=False))
    shared = repeats.common_prefixes(data, order, rank, 100)
    for k in range(1, len(order)):
        a, b = raw[order[k - 1] :], raw[order[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared[k] == min(n, 100)


def plain_pii(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((*m.span(), 0))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), 1))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((*m.span(), 2))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.findall("[0-9]", m[0])) <= 15:
            out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "+", "1", "256", "0.0", " ", "-", "(", "4111 1111 1111 1111", "+1 (389) 555-5010", "9.9.9.9", "x@y.zz", "\n", "é", "%"]), max_size=40))
def test_pii_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain_pii(text)


def test_pii_field_learns_its_table():
    field = pii.trained()
    wrong = 0
    for line, labels in pii.LABELLED:
        words = line.split()
        flat = field.scores(list(zip(words, ["", *words], strict=False)))
        flat[[not re.search("[0-9@]", w) for w in words], 1:] = -1e9
        whole = field.decode(flat, np.array([len(words)]), np.array([False]), np.array([False])).tolist()
        wrong += sum(pii.LABELS[k] != y for k, y in zip(whole, labels.split(), strict=True))
        # runs of words with a digit or an @, cut out of their line, take the labels of the whole line
        starts = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
        want = {starts[t]: k for t, k in enumerate(whole) if k}
        base, every = pii.find_personal([line], field)[0]
        got = {max(s for s in starts if s <= a): k - len(pii.BASE_KINDS) + 1 for a, _, k in every if k >= len(pii.BASE_KINDS)}
        assert all(want.get(s) == k for s, k in got.items()) and all(s in got or any(a < s + 60 and s <= b for a, b, _ in base) for s in want)
    assert wrong <= 2
    found = pii.find_personal(["call 555-010-7788 now\nssn 123-45-6789\nin 2020 page 12 costs 3.50"], field)[0][1]
    assert [pii.KINDS[k] for _, _, k in found] == ["crf_phone", "crf_id"]
    assert pii.masked("a x@y.zz b", [(2, 8, 0)]) == "a [EMAIL] b"


def plain_secrets(text):
    out = [(*m.span(), 0) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6 and m[1].isascii()]
    out += [(*m.span(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(*m.span(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["password", "TOKEN", "api_key", "ApiKey", "=", ":", " ", '"', "'", "abc123", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "\n", "é", "x."]), max_size=25))
def test_secret_patterns(parts):
    text = "".join(parts)
    assert secret_scan.base_spans(text) == plain_secrets(text)


def test_secret_novelty():
    novelty = secret_scan.Novelty()
    key = "Zk9qX2vL7pRw4TbYh3NcUe8Df"
    base, every = secret_scan.scan_text(f"private signing blob {key} end; private username_password_token_1", novelty)
    assert base == [] and [(secret_scan.KINDS[k], b - a) for a, b, k in every] == [("novel", len(key))]
    assert novelty.marginal("x " + key, key) < len(key) / 2


@pytest.mark.parametrize("key", ["ZkqXvLpRwTbYhNcUeDfGm", "4037590409210456", "qjxvzkwpyhgbtmfd"])
def test_secret_novelty_measures_letters_and_digits_alone(key):
    _, every = secret_scan.scan_text(f"private signing blob {key} end; bearer {'-' * 40} auth_token_authorization", secret_scan.Novelty())
    assert [(secret_scan.KINDS[k], a, b) for a, b, k in every] == [("novel", 21, 21 + len(key))]


def test_language_machines_separate():
    rng = random.Random(4)
    make = lambda pieces: " ".join("".join(rng.choice(pieces) for _ in range(3)) for _ in range(30))
    kinds = {"en": ["th", "ing", "er"], "de": ["sch", "ung", "er"], "fr": ["eau", "tre", "é"], "es": ["ción", "ar", "ll"]}
    texts = [(make(p), z) for z, p in kinds.items() for _ in range(40)]
    model = language_id.Model.fit(language_id.profiles([t for t, _ in texts]), [z for _, z in texts])
    langs, score = model.predict([make(p) for p in kinds.values()] + ["", "123 !"])
    assert langs == [*kinds, "und", "und"]
    assert ((score >= 0) & (score <= 1)).all()


def test_directory_splits_overfull_buckets():
    weight = np.zeros(1 << 8)
    weight[:4], weight[200] = 10, 100
    found = exact_dedup.Directory(weight, 15)
    key = (np.arange(256, dtype=np.uint64) << np.uint64(56)).view(np.int64)
    bucket = found.bucket(key)
    assert len(set(bucket[:4].tolist())) == 4 and found.depth == 8
    assert max(weight[bucket == b].sum() for b in set(bucket.tolist()) if b != bucket[200]) <= 15
    rng = np.random.default_rng(0)
    weight = rng.exponential(1, 1 << 10)
    found = exact_dedup.Directory(weight, 20.0)
    bucket = found.bucket((np.arange(1 << 10, dtype=np.uint64) << np.uint64(54)).view(np.int64))
    assert (np.bincount(bucket, weights=weight) == pytest.approx(found.fill)) and found.fill.max() <= 20
    owner = found.owners(8)
    assert (np.diff(owner[bucket]) >= 0).all() and set(owner.tolist()) == set(range(8))
    assert np.bincount(owner[bucket], weights=weight).max() < 1.5 * weight.sum() / 8


def test_quantiser_recall():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    fitted = vector_search.Quantiser.fit(x, len(x))
    cell, codes = fitted.code(x)
    q = x[::100]
    rough = fitted.tables(q)
    score = (q @ fitted.centre.T)[:, cell] + sum(rough[:, m][:, codes[:, m]] for m in range(codes.shape[1]))
    exact = q @ x.T
    near = [len(set(np.argsort(-e)[:20]) & set(np.argsort(-s)[:60])) / 20 for e, s in zip(exact, score, strict=True)]
    assert np.mean(near) > 0.9




@pytest.mark.parametrize("seed", range(4))
def test_repeats_of_hot_anchors(seed):
    """Contexts cut by the place of their anchor give the same ranges as whole ones."""
    rng = random.Random(seed)
    passage = "".join(rng.choice("abcdef ") for _ in range(260))
    docs = [("".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 150))) + passage[rng.randint(0, 40) :] + "".join(rng.choice("ab") for _ in range(rng.randint(0, 150)))).encode() for _ in range(30)]
    size = np.array([len(r) for r in docs])
    first, data = np.cumsum(size) - size, np.frombuffer(b"".join(docs), np.uint8)

    def found(text, window, n, h):
        rec = np.zeros(len(text), repeats.RECORD)
        rec["h"], rec["doc"], rec["start"], rec["n"] = h, text, window - first[text], n
        got = [np.zeros(len(r), bool) for r in docs]
        for part in repeats.find_repeats(rec, data[repeats.spread(window, n + 99)]):
            for x in part:
                got[x["doc"]][x["start"] : x["n"]] = True
        return b"".join(g.tobytes() for g in got)

    text, window, n, h = repeats.anchors(data, first, size)
    row, *cuts = repeats.split_hot(data, window, n, h)
    assert sum(cuts[1]) == sum(n) and max(cuts[1]) <= repeats.PLACES
    assert found(text[row], *cuts) == found(text, window, n, h)
