"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

1. All normalised words (texts between white space) of the corpus are counted, over all documents.
2. The `LEXICON` most frequent become a minimal acyclic transducer: sorted words go in one by one,
   equal suffixes are shared, and the numbers along a word's path add up to its place in a table of
   id sequences. The size is bounded, so it can be broadcast; each worker writes it to a file that
   is deleted once it is memory-mapped.
3. A batch looks up its distinct words, all at once, one byte a step. Words that the lexicon lacks
   are merged exactly, lowest rank and leftmost first: short ones all at once in numpy, long ones
   with a heap. So the lexicon's size changes speed only, never a result.
4. Decoding joins the vocabulary's token strings by a space, as the tokenizers library does where a
   tokenizer has no decoder.

Special tokens that a text spells are matched before normalisation, as the library does.
Defined results: null text is empty: no ids, empty decoded text. Rows are handled one by one, so
repeated rows repeat. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import tempfile
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternway.llm.common import pick, slices, strings, written

#: Words of the lexicon at most, and symbols up to which unseen words are merged in numpy.
LEXICON, SHORT = 65_536, 48
SPACE_ONLY_IN_PYTHON = re.compile("[\x1c-\x1f]")
WHITE = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[^{WHITE}]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = count(0x100)
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens, merge ranks and patterns of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, table = spec["model"], dict(spec["model"]["vocab"])
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        table |= self.special
        self.tokens = [""] * (max(table.values()) + 1)
        for t, i in table.items():
            self.tokens[i] = t
        letters = byte_letters()
        self.inner = np.array([table[c] for c in letters], np.int32)
        self.last = np.array([table[c + self.suffix] for c in letters], np.int32)
        left, right, made = ([] for _ in range(3))
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            left.append(table[a])
            right.append(table[b])
            made.append(table[a + b])
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(key, kind="stable")
        self.pair, self.rank, self.made = key[order], order.astype(np.int32), np.array(made, np.int32)[order]
        self.merge = dict(zip(key.tolist(), zip(range(len(key)), made, strict=True), strict=True))
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.spelled = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, made token) of pairs; a pair that never merges has the largest rank."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        ok = self.pair[at] == key
        return np.where(ok, self.rank[at], NEVER), np.where(ok, self.made[at], -1)

    def merge_long(self, ids: list[int]) -> list[int]:
        """Exact merges of one word with a heap of pairs and a linked list of symbols."""
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(*self.merge[k], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (k := ids[i] << 32 | ids[i + 1]) in self.merge]
        heap = [(r, i, a, b, m) for r, m, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (found := self.merge.get(ids[p] << 32 | ids[q])):
                    heapq.heappush(heap, (found[0], p, ids[p], ids[q], found[1]))
        return [x for x in ids if x >= 0]

    def merge_short(self, ids: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Exact merges of many words at once; `word` numbers the word of each symbol, ascending."""
        done_ids, done_word = [], []
        rank, made = _pairs(self, ids, word)
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(ids)))
            live = least < NEVER
            keep = np.repeat(live, size)
            done_ids.append(ids[~keep])
            done_word.append(word[~keep])
            if not live.any():
                break
            hit = np.flatnonzero((rank == np.repeat(least, size)) & keep)
            hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]  # the leftmost of each word
            ids[hit] = made[hit]
            keep[hit + 1] = False
            rank[hit], made[hit] = rank[hit + 1], made[hit + 1]
            place = np.cumsum(keep) - 1
            at = place[hit]
            ids, word, rank, made = ids[keep], word[keep], rank[keep], made[keep]
            for spot in (at, at[at > 0] - 1):
                ok = spot[(spot + 1 < len(ids))]
                same = word[np.minimum(ok + 1, len(ids) - 1)] == word[ok]
                r, m = self.lookup(ids[ok], ids[np.minimum(ok + 1, len(ids) - 1)])
                rank[ok], made[ok] = np.where(same, r, NEVER), np.where(same, m, -1)
                rank[spot[spot + 1 >= len(ids)]] = NEVER
        ids, word = np.concatenate(done_ids or [ids]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=words)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, ids per word) by exact merges."""
        symbols, owner, long_ = [], [], []
        n = 0
        per = np.zeros(len(words), np.int64)
        for w, text in enumerate(words):
            for piece in self.pieces.findall(text):
                raw = piece.encode("utf-8", "surrogatepass")
                if len(raw) > SHORT:
                    long_.append((n, raw))
                else:
                    symbols.append(raw)
                    owner.append(n)
                n += 1
                per[w] += 1
        size = np.array([len(s) for s in symbols], np.int64)
        raw = np.frombuffer(b"".join(symbols), np.uint8)
        ids = self.inner[raw]
        if len(size):
            ends = np.cumsum(size) - 1
            ids[ends] = self.last[raw[ends]]
        flat, made = self.merge_short(ids, np.repeat(np.arange(len(size)), size), len(size))
        sizes = np.zeros(n, np.int64)
        sizes[np.array(owner, np.int64)] = made
        merged = {}
        for k, text in long_:
            own = self.inner[np.frombuffer(text, np.uint8)].tolist()
            own[-1] = int(self.last[text[-1]])
            merged[k] = self.merge_long(own)
            sizes[k] = len(merged[k])
        out, first = np.empty(int(sizes.sum()), np.int32), np.cumsum(sizes) - sizes
        if len(size):
            out[_spread(first[np.array(owner)], made)] = flat
        for k, own in merged.items():
            out[first[k] : first[k] + len(own)] = own
        stops = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(per))]
        return out, np.diff(stops)


NEVER = np.int32(2**31 - 1)


def _pairs(v: Vocabulary, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rank, made = np.full(len(ids), NEVER), np.full(len(ids), -1, np.int32)
    if len(ids) > 1:
        same = word[1:] == word[:-1]
        r, m = v.lookup(ids[:-1], ids[1:])
        rank[:-1], made[:-1] = np.where(same, r, NEVER), np.where(same, m, -1)
    return rank, made


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, one behind the other."""
    ahead = np.cumsum(size) - size
    return np.repeat(first - ahead, size) + np.arange(int(size.sum()))


class Transducer:
    """Minimal acyclic transducer: arcs sorted by (state, byte), each with a target and an output.

    Outputs along the path of a word add up to its place among the sorted words.
    """

    @staticmethod
    def build(words: list[bytes]) -> bytes:
        """Arcs and final states of the automaton of sorted, distinct words, as one block of bytes."""
        register: dict[tuple, int] = {}
        arcs: list[tuple[tuple[int, int], ...]] = []
        final: list[bool] = []
        below: list[int] = []  # words under each state

        def frozen(state: list) -> int:
            key = (state[0], tuple(state[1]))
            found = register.get(key)
            if found is None:
                found = register[key] = len(arcs)
                arcs.append(key[1])
                final.append(key[0])
                below.append(key[0] + sum(below[t] for _, t in key[1]))
            return found

        path: list[list] = [[False, []]]  # open states of the last word: final, arcs
        last = b""
        for word in [*words, None]:
            shared = 0
            if word is not None:
                while shared < min(len(last), len(word)) and last[shared] == word[shared]:
                    shared += 1
            while len(path) > shared + 1:
                closed = frozen(path.pop())
                path[-1][1].append((last[len(path) - 1], closed))
            if word is None:
                break
            path += [[False, []] for _ in word[shared:]]
            path[-1][0] = True
            last = word
        root = frozen(path[0])
        key, target, output = [], [], []
        for s, own in enumerate(arcs):
            ahead = int(final[s])
            for b, t in own:
                key.append(s << 8 | b)
                target.append(t)
                output.append(ahead)
                ahead += below[t]
        head = np.array([len(key), len(arcs), root], "<i8")
        return head.tobytes() + np.array(key, "<i8").tobytes() + np.array(target, "<i4").tobytes() + np.array(output, "<i4").tobytes() + np.array(final, "u1").tobytes()

    def __init__(self, block: bytes | mmap.mmap) -> None:
        n, states, self.root = (int(x) for x in np.frombuffer(block, "<i8", 3))
        self.key = np.frombuffer(block, "<i8", n, 24)
        self.target = np.frombuffer(block, "<i4", n, 24 + 8 * n)
        self.output = np.frombuffer(block, "<i4", n, 24 + 12 * n)
        self.final = np.frombuffer(block, "u1", states, 24 + 16 * n)

    def places(self, words: list[str]) -> np.ndarray:
        """The place of each word, or -1: all words step through the automaton together."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        first = np.cumsum(size) - size
        data = np.frombuffer(b"".join(raw), np.uint8)
        place = np.full(len(words), -1, np.int64)
        if not len(self.key):
            return place
        live = np.arange(len(words))
        state, total = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            ended = size[live] == step
            if ended.any():
                stop = ended & (self.final[state] == 1)
                place[live[stop]] = total[stop]
                live, state, total = live[~ended], state[~ended], total[~ended]
                if not len(live):
                    break
            key = state << 8 | data[first[live] + step]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[at] == key
            live, at = live[ok], at[ok]
            state, total = self.target[at].astype(np.int64), total[ok] + self.output[at]
            step += 1
        return place


class Lexicon:
    """The transducer and the id sequences of its words."""

    def __init__(self, block: bytes, size: np.ndarray, ids: np.ndarray) -> None:
        self.block, self.size, self.ids = block, size, ids

    @staticmethod
    def compile(words: list[str], vocabulary: Vocabulary) -> Lexicon:
        raw = sorted({w.encode("utf-8", "surrogatepass") for w in words})
        ids, size = vocabulary.encode_words([r.decode("utf-8", "surrogatepass") for r in raw])
        return Lexicon(Transducer.build(raw), size, ids)

    def mapped(self) -> Transducer:
        with tempfile.TemporaryFile() as f:  # deleted at once; the mapping stays
            f.write(self.block)
            f.flush()
            return Transducer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


@lru_cache(maxsize=2)
def vocabulary_at(path: str) -> Vocabulary:
    return Vocabulary(path)


def normalised(text: str) -> str:
    """Composed, lower-cased letter by letter."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


def words_of(text: str, v: Vocabulary) -> list[str]:
    """Normalised words; a special token is a blank and its id, which no word can be."""
    if "<|" in text and v.spelled.search(text):
        out: list[str] = []
        for part in v.spelled.split(text):
            out += [f" {v.special[part]}"] if part in v.special else words_of(part, v)
        return out
    text = normalised(text)
    return _CHUNK.findall(text) if SPACE_ONLY_IN_PYTHON.search(text) else text.split()


def frequent_words(rows: DataFrame, path: str, size: int) -> list[str]:
    """The most frequent words of `rows.text`, `size` at most, counted over all documents.

    Words fall into classes by the logarithm of their count; the highest classes that together hold
    no more than `size` words are taken whole. So the driver gets a few hundred class sizes and then
    `size` words at most, however many tasks have counted.
    """

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_at(path)
        for batch in slices(batches, "text", 8 << 20):
            seen: Counter[str] = Counter()
            for t in strings(batch.column(0)):
                seen.update(words_of(t, v))
            own = [w for w in seen if w[0] != " "]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([seen[w] for w in own], pa.int64())], ["word", "n"])

    counted = rows.select("text").mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    level = F.floor(8 * F.log2("n")).cast("int")
    ranked = written(counted.select("word", level.alias("level")), "word-counts")
    least, total = None, 0
    for r in sorted(ranked.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        total += r["count"]
        if total > size:
            break
        least = r["level"]
    return [] if least is None else [r["word"] for r in ranked.where(F.col("level") >= least).collect()]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, lexicon_words: int = LEXICON) -> DataFrame:
    """One row per document: ``doc_id, ids`` (array of int) ``, decoded``."""
    rows, path = pick(docs, doc_id=id_col, text=text_col), vocabulary or default_vocabulary()
    lexicon = Lexicon.compile(frequent_words(rows, path, lexicon_words), vocabulary_at(path))
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.block, lexicon.size, lexicon.ids))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, own = vocabulary_at(path), Lexicon(*shared.value)
        automaton = own.mapped()
        for batch in slices(batches, "text", 4 << 20):
            ids, size = encode_batch(strings(batch.column(1)), v, own, automaton)
            ends = np.append(0, np.cumsum(size)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
            decoded = decode(ids, ends, v)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def encode_batch(texts: list[str], v: Vocabulary, lexicon: Lexicon, automaton: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, ids per text)."""
    number: defaultdict[str, int] = defaultdict(count().__next__)
    order = [np.fromiter(map(number.__getitem__, words_of(t, v)), np.int32) for t in texts]
    words = list(number)
    place = automaton.places(words)
    size, first = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    known = np.flatnonzero(place >= 0)
    ahead = np.cumsum(lexicon.size) - lexicon.size
    size[known], first[known] = lexicon.size[place[known]], ahead[place[known]]
    rest = np.flatnonzero(place < 0)
    special = np.array([words[i][0] == " " for i in rest.tolist()], bool)
    unseen = rest[~special]
    new, per = v.encode_words([words[i] for i in unseen.tolist()])
    size[unseen], first[unseen] = per, len(lexicon.ids) + np.cumsum(per) - per
    marks = np.array([int(words[i]) for i in rest[special].tolist()], np.int32)
    size[rest[special]], first[rest[special]] = 1, len(lexicon.ids) + len(new) + np.arange(len(marks))
    table = np.concatenate([lexicon.ids, new, marks]).astype(np.int32)
    flat = np.concatenate(order) if order else np.zeros(0, np.int32)
    ids = table[_spread(first[flat], size[flat])]
    stops = np.append(0, np.cumsum(size[flat]))[np.append(0, np.cumsum([len(o) for o in order]))]
    return ids, np.diff(stops)


def decode(ids: np.ndarray, ends: np.ndarray, v: Vocabulary) -> list[str]:
    """The text of each range of ids."""
    tokens = list(map(v.tokens.__getitem__, ids.tolist()))
    return [" ".join(tokens[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
