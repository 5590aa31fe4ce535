"""Byte-level BPE by ranks: a segment tree finds the leftmost pair of least rank.

A text is cut into pieces by a pattern. A piece that is a token is that token. Any other is merged: the tree
has a leaf per byte position, with the rank of the pair of tokens that begins there and the position; its root
is the least rank and, of equals, the leftmost. A merge joins the token with its live neighbour and updates
three leaves: the pair that is gone, the pair that now begins here and the one that ends here. So a piece of n
bytes takes O(n log n), however it merges. Pieces of up to 64 bytes have their trees side by side in one array
and are merged together, one merge of each at a time; a piece met before is looked up.

Defined results: null text counts as empty and gives no ids; text that spells a special token is ordinary
text; equal rows give equal results; other columns are not read. An empty table gives no rows.
Distribution: one scan, no shuffle; a task holds one slice of texts and its pieces, and `KNOWN` bytes
of pieces from slices before.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lanternway.llm.common import pick, slices, strings

#: Bytes of the pieces that a task remembers, pieces cut at once, and pieces merged together, each at most so long.
KNOWN, PIECES, TOGETHER, LONGEST = 8 << 20, 1 << 18, 1 << 13, 64
NO_PAIR = 1 << 62


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: pairs are joined by least rank, of equal ranks the leftmost first."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 1).bit_length()
    shift, mask = size.bit_length() - 1, size - 1
    rank = ranks.get
    tree = [NO_PAIR] * (2 * size)
    for i in range(n - 1):
        if (r := rank(piece[i : i + 2])) is not None:
            tree[size + i] = r << shift | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    stop, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that begins at a place: its end, the token before

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            a, b = tree[k], tree[k ^ 1]
            k >>= 1
            low = a if a < b else b
            if tree[k] == low:
                return
            tree[k] = low

    while (root := tree[1]) != NO_PAIR:
        i = root & mask
        gone = stop[i]
        end = stop[i] = stop[gone]
        put(gone, NO_PAIR)
        if end < n:
            before[end] = i
            r = rank(piece[i : stop[end]])
            put(i, NO_PAIR if r is None else r << shift | i)
        else:
            put(i, NO_PAIR)
        if (left := before[i]) >= 0:
            r = rank(piece[left:end])
            put(left, NO_PAIR if r is None else r << shift | left)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : stop[i]]])
        i = stop[i]
    return ids


class Pairs:
    """Rank of the token that two tokens make together, looked up for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.many = max(ranks.values(), default=0) + 1
        found = [(a * self.many + b, r) for token, r in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        table = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.key, self.rank = np.append(table[:, 0], np.iinfo(np.int64).max), np.append(table[:, 1], -1)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """-1 where two tokens make none."""
        key = left * self.many + right
        at = np.searchsorted(self.key, key)
        return np.where(self.key[at] == key, self.rank[at], -1)


def merged_together(pieces: list[bytes], single: np.ndarray, pairs: Pairs) -> list[tuple[int, ...]]:
    """The same as `merged` for many pieces of two bytes and more and about one length: a tree each, one merge of all at a time.

    `single`: ids of the 256 bytes.
    """
    n = np.array([len(p) for p in pieces])
    size = 1 << (int(n.max()) - 1).bit_length()
    levels, mask = size.bit_length() - 1, size - 1
    token = single[np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(-1, size)]
    place = np.arange(size)
    stop, before = np.tile(place + 1, (len(n), 1)), np.tile(place - 1, (len(n), 1))
    tree = np.full((len(n), 2 * size), NO_PAIR, np.int64)
    rank = pairs(token[:, :-1], token[:, 1:])
    tree[:, size : 2 * size - 1] = np.where((rank >= 0) & (place[:-1] < n[:, None] - 1), rank << levels | place[:-1], NO_PAIR)
    for k in range(levels - 1, -1, -1):
        tree[:, 1 << k : 2 << k] = tree[:, 2 << k : 4 << k].reshape(len(n), -1, 2).min(2)

    def put(rows: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
        k = size + i
        tree[rows, k] = value
        for _ in range(levels):
            value = np.minimum(value, tree[rows, k ^ 1])
            k = k >> 1
            tree[rows, k] = value

    def coded(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank = pairs(token[rows, left], token[rows, right])
        return np.where(rank >= 0, rank << levels | left, NO_PAIR)

    rows = np.arange(len(n))
    while len(rows := rows[tree[rows, 1] != NO_PAIR]):
        root = tree[rows, 1]
        i = root & mask
        gone = stop[rows, i]
        end = stop[rows, gone]
        token[rows, i], stop[rows, i] = root >> levels, end
        put(rows, gone, np.full(len(rows), NO_PAIR))
        inner = end < n[rows]
        r, j, e = rows[inner], i[inner], end[inner]
        before[r, e] = j
        value = np.full(len(rows), NO_PAIR)
        value[inner] = coded(r, j, e)
        put(rows, i, value)
        left = before[rows, i]
        some = left >= 0
        put(rows[some], left[some], coded(rows[some], left[some], i[some]))
    out = []
    for ids, ends, length in zip(token.tolist(), stop.tolist(), n.tolist(), strict=True):
        own, i = [], 0
        while i < length:
            own.append(ids[i])
            i = ends[i]
        out.append(tuple(own))
    return out


@lru_cache
def unlike() -> tuple[frozenset[str], dict[int, int]]:
    """(set, translation) of letters and digits that are too new for the rank library.

    Its tables of letters are of another Unicode version than those of the pattern's engine here. So each code
    point that this Python's own tables lack is asked there: does it stay in one piece with a letter, or a digit?
    Those that do not are read as an unassigned code point, U+0378, when a text is cut.
    """
    import public_tokenizers
    import tiktoken

    young = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn"]
    young = regex.findall(r"[\p{L}\p{N}]", "".join(young))
    ranks = {bytes([b]): b for b in range(256)}
    for c in young:
        for lead in "a1":
            ranks[(lead + c).encode()] = len(ranks)
    asked = tiktoken.Encoding("asked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    new = [c for c in young if all(len(asked.encode_ordinary(lead + c)) > 1 for lead in "a1")]
    return frozenset(new), {ord(c): 0x378 for c in new}


class Vocabulary:
    """Ranks of a file of lines ``base64 rank``, the tokens by rank, and the pattern that cuts a text."""

    def __init__(self, path: str, pattern: str) -> None:
        lines = map(bytes.split, Path(path).read_bytes().splitlines())
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs, self.cut = Pairs(self.ranks), regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def cuts(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, as the rank library cuts it, `PIECES` at a time."""
        shown = text
        if not text.isascii():
            new, instead = unlike()
            if not new.isdisjoint(text):
                shown = text.translate(instead)
        if shown is text and len(text) < PIECES:
            yield self.cut.findall(text)
            return
        found = (text[m.start() : m.end()] for m in self.cut.finditer(shown))
        while own := list(islice(found, PIECES)):
            yield own

    def meet(self, pieces: Iterable[str]) -> None:
        """Learns the ids of all pieces that are not known."""
        if self.held > KNOWN:
            self.known, self.held = {}, 0
        new = [(p, p.encode("utf-8", "surrogatepass")) for p in set(pieces) if p not in self.known]
        self.held += sum(len(raw) for _, raw in new)
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece, raw in new:
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[piece] = (whole,)
            elif len(raw) > LONGEST:
                self.known[piece] = tuple(merged(raw, self.ranks))
            else:
                groups.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for group in groups.values():
            for i in range(0, len(group), TOGETHER):
                names, raws = zip(*group[i : i + TOGETHER], strict=True)
                self.known.update(zip(names, merged_together(list(raws), self.single, self.pairs), strict=True))

    def ids(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.known.__getitem__, pieces)), np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; short texts meet their pieces together."""
        short = {i: own for i, t in enumerate(texts) if len(t) < PIECES for own in self.cuts(t)}
        self.meet(chain.from_iterable(short.values()))
        out = [self.ids(short[i]) if i in short else np.zeros(0, np.int32) for i in range(len(texts))]
        for i, t in enumerate(texts):
            if len(t) >= PIECES:
                runs = []
                for own in self.cuts(t):
                    self.meet(own)
                    runs.append(self.ids(own))
                out[i] = np.concatenate(runs)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def vocabulary_at(path: str, pattern: str | None = None) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(path, pattern or public_tokenizers.PATTERN)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, ids`` (array of int) ``, decoded`` (binary, from the ids)."""
    rows, path = pick(docs, doc_id=id_col, text=text_col), vocabulary or default_vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_at(path, pattern)
        for batch in slices(batches, "text", 2 << 20):
            ids = v.encode(strings(batch.column(1)))
            ends = pa.array(np.fromiter(accumulate(map(len, ids), initial=0), np.int32, len(ids) + 1))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))
            decoded = pa.array([v.decode(x.tolist()) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, decoded], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")
