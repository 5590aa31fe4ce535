"""Suffix-array dedup: remove bytes of 100-byte strings that also start earlier in the corpus.

Every 100-byte window has one anchor: the 32-byte gram in it with the smallest hash (leftmost on
ties). That choice depends on the window's bytes alone, so equal windows have equal anchors, wherever
they stand. Windows are dealt to shards by the hash of their anchor; no match crosses anchors.

1. A scan counts anchors. A bit table of bounded size (`FILTER_BITS`) notes those met more than once;
   if it fills up, more is sent in step 2 and nothing is lost.
2. A scan cuts, for every anchor that may repeat, the *context*: the bytes of all its windows. Equal
   contexts of `HELD_BYTES`, and again of a range of anchors, share one entry of a dictionary, that of
   the earliest; the windows of the others repeat its windows. Contexts travel compressed. Those of a
   hot anchor (met in over `HOT` contexts) are cut further, by the place of the anchor in the window
   and all bytes that windows of such places must share, so that no anchor's group fills a task.
3. Each shard holds at most `SHARD_BYTES` of distinct contexts and gets a suffix array by Larsson-Sadakane
   refinement (only groups that are not yet single are sorted again, by the rank `h` further on), and
   Kasai common prefixes, in numpy. Neighbours that share 100 bytes form classes; the earliest start
   of a class stays. An anchor whose contexts fill more than one shard has its shards' sorted
   windows merged by binary search.
4. Repeated windows are joined to their documents; covered bytes are removed.

Order is by document id, then start. Defined results: null text is empty (no bytes, no spans); texts
under 100 bytes keep all; null ids come first. Rows that share an id stand at the same place in the
order, so they are no repeats of each other; a number written with each row tells them apart. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternway.llm.common import pick, slices, written

WINDOW, GRAM = 100, 32
SHARD_BYTES, FILTER_BITS = 1 << 19, 29
#: Bytes of text cut at once, of contexts held before they travel, and of text for one range of anchors.
SLICE_BYTES, HELD_BYTES, RANGE_BYTES = 1 << 20, 8 << 20, 6 << 20
#: Bytes of text for one task of the shuffles, and of anchor counts for one part of the bit table.
TASK_BYTES, PART_BYTES = 64 << 20, 8 << 20
#: Contexts from which an anchor is hot (or one in 2**22 of all anchors, so that the list of hot ones stays
#: below 32 MB), and the places of a hot anchor in its window that share a range.
HOT, PLACES = 4096, 12
RECORD = np.dtype([("h", "<u8"), ("doc", "<i8"), ("tid", "<i8"), ("start", "<i4"), ("n", "<i4")])
#: What travels of a context (of `h` the upper half), and of a range that is known to repeat.
SENT = ({"h": "<u4", "doc": "<i8", "tid": "<i8", "start": "<i4", "n": "u1"}, {"doc": "<i8", "tid": "<i8", "start": "<i4", "n": "<i4"})
_FIRST = -(2**63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, one behind the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def gathered(raw: bytes, first: np.ndarray, length: np.ndarray) -> bytes:
    """The bytes of many ranges; unlike an index array, it takes no more room than they do."""
    view = memoryview(raw)
    return b"".join([view[a : a + n] for a, n in zip(first.tolist(), length.tolist(), strict=True)])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the `GRAM` bytes from each position on, by doubling."""
    h, step = _BYTE[data], 1
    while step < GRAM:
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + h[step:]
        step *= 2
    return _mixed(h)


def anchors(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, anchor hash) of each run of windows with the same anchor.

    An anchor's gram has the smallest hash of its window, so that hash is near zero; it is mixed once more
    before any of its bits deals or filters.
    """
    empty = np.zeros(0, np.int64)
    long_ = np.flatnonzero(size >= WINDOW)
    if not len(long_):
        return empty, empty, empty, np.zeros(0, np.uint64)
    h = gram_hashes(data)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # smallest hash, then leftmost
    width, step = WINDOW - GRAM + 1, 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: step - width], least[width - step :])
    n = size[long_] - WINDOW + 1
    at = spread(first[long_], n)
    anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))
    begin = np.flatnonzero(new)
    return np.repeat(long_, n)[begin], at[begin], np.diff(np.append(begin, len(at))), _mixed(h[anchor[begin]])


def split_hot(data: np.ndarray, first: np.ndarray, n: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, first window, windows, hash) of hot contexts, cut by the place of the anchor in the window.

    Windows with the anchor at place a or the `PLACES` - 1 after it hold the bytes from a before the anchor to
    the end of a window with the anchor at the last of these places; the hash is that of those bytes.
    """
    grams = gram_hashes(data)
    marks, widest = _mixed(grams), WINDOW - GRAM
    at = first[:, None] + n[:, None] - 1 + np.arange(widest + 1)
    anchor = at[np.arange(len(at)), (marks[np.minimum(at, len(grams) - 1)] == h[:, None]).argmax(1)]
    out = []
    for a in range(0, widest + 1, PLACES):
        last = min(a + PLACES - 1, widest)
        lo, hi = np.maximum(first, anchor - last), np.minimum(first + n - 1, anchor - a)
        row = np.flatnonzero(lo <= hi)
        begin, size = (anchor - a)[row], WINDOW - (last - a)
        mix = np.full(len(row), a + 1, np.uint64)
        for step in (*range(0, size - GRAM, GRAM), size - GRAM):
            mix = _mixed(mix * np.uint64(0x9E3779B97F4A7C15) + grams[begin + step])
        out.append((row, lo[row], (hi - lo + 1)[row], mix))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(4))


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, rank) in the order of their first `depth` bytes at least, by Larsson-Sadakane refinement."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : n + i]
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1]) if n else np.zeros(0, bool)
    group = np.flatnonzero(new)[np.cumsum(new) - 1] if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int32)
    rank[order] = group
    h = 8
    while h < depth:
        single = new & np.append(new[1:], True)
        live = np.flatnonzero(~single)
        if not len(live):
            break
        own = order[live]
        ahead = own + h
        behind = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        pair = rank[own].astype(np.uint64) << np.uint64(32) | behind.astype(np.uint64)
        by = np.argsort(pair, kind="stable")
        order[live], pair = own[by], pair[by]
        new[live] = np.append(True, pair[1:] != pair[:-1])
        group = np.flatnonzero(new)[np.cumsum(new) - 1]
        rank[order[live]] = group[live]
        h *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """Kasai: common prefix of each suffix with the one before it in order, `most` at the most.

    A suffix shares at least one byte less than its left neighbour in the text does. The bound is used
    level by level: every 64th suffix first, then those half way between, all of a level at once.
    Suffixes of equal rank agree to the depth of the array: they need no comparison, and as their
    order is arbitrary they give no bound.
    """
    n = len(data)
    before = np.empty(n, np.int32)
    before[order[1:]], before[order[:1]] = order[:-1], -1
    tied = np.zeros(n, bool)
    tied[order[1:]] = rank[order[1:]] == rank[order[:-1]]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(n + 1, np.uint64)
    for i in range(8):
        word[:n] |= padded[i : n + i].astype(np.uint64) << np.uint64(8 * i)
    shared = np.zeros(n, np.int32)
    stride = 64
    level = np.arange(0, n, stride)
    while True:
        if stride < 64:
            level = np.arange(stride, n, 2 * stride)
            shared[level] = np.where(tied[level - stride], 0, np.maximum(shared[level - stride] - stride, 0))
        shared[level[tied[level]]] = most
        live = level[(before[level] >= 0) & ~tied[level]]
        shared[level[before[level] < 0]] = 0
        while len(live):
            a, b = live + shared[live], before[live] + shared[live]
            inside = (a < n) & (b < n)
            diff = word[np.minimum(a, n)] ^ word[np.minimum(b, n)]
            low = diff & (~diff + np.uint64(1))
            same = np.where(diff == 0, 8, (np.bitwise_count(low - np.uint64(1)) // 8)).astype(np.int32)
            same = np.where(inside, np.minimum(same, np.minimum(n - a, n - b)), 0)
            shared[live] = np.minimum(shared[live] + same, most)
            live = live[(same == 8) & (shared[live] < most)]
        if stride == 1:
            return shared[order]
        stride //= 2


class Shard:
    """Contexts of one shard: which windows repeat an earlier one, and the sorted windows that do not."""

    def __init__(self, records: np.ndarray, data: np.ndarray) -> None:
        self.records = records
        n = records["n"].astype(np.int64)
        length = n + WINDOW - 1
        self.at = spread(np.cumsum(length) - length, n).astype(np.int32)  # places of the windows
        self.row = np.repeat(np.arange(len(records), dtype=np.int32), n)
        self.start = np.repeat(records["start"].astype(np.int64), n) + np.arange(len(self.row)) - np.repeat(np.cumsum(n) - n, n)
        self.start = self.start.astype(np.int32)
        self.doc = records["doc"][self.row]
        order, rank = suffix_array(data, WINDOW)
        shared = common_prefixes(data, order, rank, WINDOW)
        of = np.full(len(data), -1, np.int32)
        of[self.at] = np.arange(len(self.at))
        kind = np.cumsum(np.append(True, shared[1:] < WINDOW)) if len(data) else np.zeros(0, np.int64)
        keep = of[order] >= 0
        self.window, self.kind = of[order][keep], kind[keep]  # in the order of the suffix array
        by = np.lexsort((self.start[self.window], self.doc[self.window], self.kind))
        window, kind = self.window[by], self.kind[by]
        new = np.append(True, kind[1:] != kind[:-1]) if len(kind) else np.zeros(0, bool)
        self.best = window[np.flatnonzero(new)]  # earliest of each class, classes in suffix order
        lead = self.best[np.cumsum(new) - 1] if len(new) else window
        self.repeat = np.zeros(len(self.at), bool)
        self.repeat[window] = (self.doc[window] != self.doc[lead]) | (self.start[window] != self.start[lead])
        self.lead = np.empty(len(self.at), np.int32)
        self.lead[window] = lead
        self.data = data
        del self.window, self.kind

    def sorted_windows(self) -> np.ndarray:
        """The bytes of each class, in order; all have one width, so trailing zeros compare right."""
        view = np.lib.stride_tricks.sliding_window_view(self.data, WINDOW)
        return np.ascontiguousarray(view[self.at[self.best]]).view(f"S{WINDOW}").ravel()

    def beaten(self, classes: np.ndarray) -> None:
        """Classes whose earliest window is a repeat of an earlier one in another shard."""
        gone = np.zeros(len(self.at), bool)
        gone[self.best[classes]] = True
        self.repeat |= gone[self.lead]

    def intervals(self) -> np.ndarray:
        """Maximal runs of repeated windows of a context: rows of doc, tid, start, end."""
        hit = np.flatnonzero(self.repeat)
        if not len(hit):
            return np.zeros(0, RECORD)
        new = np.append(True, (hit[1:] != hit[:-1] + 1) | (self.row[hit[1:]] != self.row[hit[:-1]]))
        begin = np.flatnonzero(new)
        last = hit[np.append(begin[1:], len(hit)) - 1]
        out = np.zeros(len(begin), RECORD)
        first = hit[begin]
        out["doc"], out["tid"] = self.doc[first], self.records["tid"][self.row[first]]
        out["start"], out["n"] = self.start[first], self.start[last] + WINDOW
        return out


def merge_shards(shards: list[Shard]) -> None:
    """Binary search of each shard's sorted windows in the others'; later ones become repeats."""
    for i, a in enumerate(shards):
        own = a.sorted_windows()
        for b in shards[:i]:
            other = b.sorted_windows()  # made anew, so that only two shards' windows are held at once
            if not len(own) or not len(other):
                continue
            at = np.minimum(np.searchsorted(other, own), len(other) - 1)
            same = np.flatnonzero(other[at] == own)
            x, y = a.best[same], b.best[at[same]]
            first_b = (b.doc[y] < a.doc[x]) | ((b.doc[y] == a.doc[x]) & (b.start[y] < a.start[x]))
            first_a = (a.doc[x] < b.doc[y]) | ((b.doc[y] == a.doc[x]) & (a.start[x] < b.start[y]))
            a.beaten(same[first_b])
            b.beaten(at[same[first_a]])


def combined(records: np.ndarray, raw: bytes, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are the earliest with their context, later rows with an equal one)."""
    by = np.lexsort((records["start"], records["doc"]))
    ends = first + records["n"] + WINDOW - 1
    seen: dict[tuple[int, bytes], int] = {}
    place = np.array([seen.setdefault((h, raw[a:b]), i) for i, a, b, h in zip(by.tolist(), first[by].tolist(), ends[by].tolist(), records["h"][by].tolist(), strict=True)], np.int64)
    own = records[by]
    lead = records[place] if len(place) else own
    stays = (lead["doc"] == own["doc"]) & (lead["start"] == own["start"])
    return by[stays], by[~stays]


def whole(records: np.ndarray) -> np.ndarray:
    """The byte ranges of contexts all of whose windows are repeats."""
    out = records.copy()
    out["n"] += out["start"] + WINDOW - 1
    return out


class Contexts:
    """Contexts held in memory; equal ones are combined whenever `limit` more bytes have come."""

    def __init__(self, limit: int) -> None:
        self.limit, self.records, self.data, self.size, self.least = limit, [], [], 0, 0

    def add(self, records: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Takes contexts; returns the byte ranges found to repeat."""
        self.records.append(records)
        self.data.append(data)
        self.size += len(data)
        return self.combine() if self.size > self.least + self.limit else np.zeros(0, RECORD)

    def combine(self) -> np.ndarray:
        if not self.records:
            return np.zeros(0, RECORD)
        records, data = np.concatenate(self.records), np.concatenate(self.data)
        self.records, self.data = [], []
        length = records["n"].astype(np.int64) + WINDOW - 1
        first = np.cumsum(length) - length
        raw = data.tobytes()
        stay, again = combined(records, raw, first)
        done = whole(records[again])
        if len(again):
            records, data = records[stay], np.frombuffer(gathered(raw, first[stay], length[stay]), np.uint8)
        self.records, self.data, self.size, self.least = [records], [data], len(data), len(data)
        return done

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """All that is held, which is held no more."""
        out = np.concatenate([np.zeros(0, RECORD), *self.records]), np.concatenate([np.zeros(0, np.uint8), *self.data])
        self.records, self.data, self.size, self.least = [], [], 0, 0
        return out


def find_repeats(records: np.ndarray, data: np.ndarray, limit: int = SHARD_BYTES) -> Iterator[np.ndarray]:
    """Repeated windows of all contexts of a range of anchors."""
    held = Contexts(len(data))
    held.add(records, data)
    yield held.combine()
    yield from distinct_repeats(*held.take(), limit)


def distinct_repeats(records: np.ndarray, data: np.ndarray, limit: int = SHARD_BYTES) -> Iterator[np.ndarray]:
    """Repeated windows of contexts of which no two are equal."""
    length = records["n"].astype(np.int64) + WINDOW - 1
    first = np.cumsum(length) - length
    held, size = [], 0
    many = np.unique(records["h"], return_inverse=True, return_counts=True)
    stay = np.flatnonzero(many[2][many[1]] > 1)  # an anchor met once has no partner
    if not len(stay):
        return
    by = stay[np.argsort(records["h"][stay], kind="stable")]
    records, first, length = records[by], first[by], length[by]
    anchor = np.cumsum(np.append(True, records["h"][1:] != records["h"][:-1])) - 1
    count, total = np.bincount(anchor), np.bincount(anchor, weights=length)

    def shard(rows: np.ndarray) -> Shard:
        return Shard(records[rows], data[spread(first[rows], length[rows])])

    edges = np.append(0, np.cumsum(count))
    for g in range(len(count)):
        rows = np.arange(edges[g], edges[g + 1])
        if total[g] > limit:
            part = np.cumsum(length[rows]) // limit
            several = [shard(rows[part == p]) for p in np.unique(part)]
            merge_shards(several)
            yield from (s.intervals() for s in several)
            continue
        held.append(rows)
        size += int(total[g])
        if size >= limit:
            yield shard(np.concatenate(held)).intervals()
            held, size = [], 0
    if held:
        yield shard(np.concatenate(held)).intervals()


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [("" if t is None else t).encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
    size = np.array([len(r) for r in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size


def _by_range(to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(to, kind="stable")
    places, first = np.unique(to[order], return_index=True)
    return order, places, np.append(first, len(to))


def _by_key(batches: Iterable[pa.RecordBatch], value: int) -> Iterator[tuple[int, list[bytes]]]:
    """The values of each key of rows that are sorted by their first column."""
    key, held = None, []
    for batch in batches:
        for k, v in zip(batch.column(0).to_pylist(), batch.column(value), strict=True):
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append(v.as_py())
    if held:
        yield key, held


def repeated_anchors(rows: DataFrame, bits: int, parts: int, tasks: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """(bit table of anchors met more than once, sorted anchors met over `hot` times).

    `parts`, a power of two, is in how many the table is counted: each holds 8 bytes for every anchor of its
    share. A task counts one part after the other.
    """

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            h, n = np.unique(anchors(*_texts(batch))[3], return_counts=True)
            places, first = np.unique((h >> np.uint64(64 - bits)).astype(np.int64) * parts >> bits, return_index=True)
            cuts, n = np.append(first, len(h)), np.minimum(n, 255).astype(np.uint8)
            blobs = [h[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "h"])

    def tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, own in _by_key(batches, 1):
            h = np.concatenate([np.frombuffer(b, np.uint64, len(b) // 9) for b in own])
            n = np.concatenate([np.frombuffer(b, np.uint8, offset=len(b) // 9 * 8) for b in own])
            del own
            order = np.argsort(h)
            h, n = h[order], n[order]
            new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            h, n = h[new], np.add.reduceat(n, new, dtype=np.int64)
            again = np.unique(h[n > 1] >> np.uint64(64 - bits)).astype(np.int64)
            bit = np.zeros((1 << bits) // parts, bool)
            bit[again - p * len(bit)] = True
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(bit).tobytes()], pa.binary()), pa.array([h[n > hot].tobytes()], pa.binary())], ["part", "bits", "hot"])

    found = rows.select("doc", "text").mapInArrow(tally, "part int, h binary").repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(tables, "part int, bits binary, hot binary")
    table = np.zeros(parts * max(1, (1 << bits) // parts // 8), np.uint8)
    size, many = len(table) // parts, [np.zeros(0, np.uint64)]
    for r in found.collect():  # bounded: the table's size, and the list of hot anchors
        table[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
        many.append(np.frombuffer(r["hot"], np.uint64))
    return table, np.sort(np.concatenate(many))


def _packed(kind: int, rows: np.ndarray, length: np.ndarray | None, data: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Rows as one compressed blob per range of anchors."""
    order, places, cuts = _by_range((rows["h"] % np.uint64(ranges)).astype(np.int64))
    rows, press, blobs = rows[order], zstandard.ZstdCompressor(level=5), []
    first = None if length is None else (np.cumsum(length) - length)[order]
    for a, b in zip(cuts, cuts[1:], strict=False):
        columns = [(rows["h"][a:b] >> np.uint64(32) if c == "h" else rows[c][a:b]).astype(t).tobytes() for c, t in SENT[kind].items()]
        context = b"" if first is None else data[spread(first[a:b], length[order[a:b]])].tobytes()
        blobs.append(int(b - a).to_bytes(8, "little") + press.compress(b"".join(columns) + context))
    return pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), pa.array([kind] * len(places), pa.int32()), pa.array(blobs, pa.binary())], ["range", "kind", "rows"])


def _unpacked(kind: int, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, plain, at = int.from_bytes(blob[:8], "little"), zstandard.ZstdDecompressor().decompress(blob[8:]), 0
    rows = np.zeros(n, RECORD)
    for c, t in SENT[kind].items():
        rows[c] = np.frombuffer(plain, t, n, at)
        at += n * np.dtype(t).itemsize
    return rows, np.frombuffer(plain, np.uint8, offset=at).copy()


def repeats(rows: DataFrame) -> DataFrame:
    """``doc, tid, start, end``: byte ranges of `rows` (doc, tid, text) that repeat earlier windows; written once."""
    spark = rows.sparkSession
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    bits = int(np.clip((256 * count).bit_length(), 16, FILTER_BITS))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a task takes several ranges of anchors, one after the other, and holds one at a time
    tasks, ranges = max(least, size // TASK_BYTES, 1), max(least, size // RANGE_BYTES, 1)
    # the first count has 9 bytes for about every 35 of text: parts of 4 to 8 MB of them
    parts = 1 << int(np.clip((size // 35 * 9 // PART_BYTES).bit_length(), 8, bits - 3))
    shared = spark.sparkContext.broadcast(repeated_anchors(rows, bits, parts, tasks, max(HOT, size // 35 >> 22)))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hot = shared.value
        held = Contexts(HELD_BYTES)

        def sent(done: np.ndarray, everything: bool = False) -> Iterator[pa.RecordBatch]:
            if len(done):
                yield _packed(1, done, None, done, ranges)
            if everything or 2 * held.size > held.limit:
                own, data = held.take()
                if len(own):
                    yield _packed(0, own, own["n"].astype(np.int64) + WINDOW - 1, data, ranges)

        for batch in slices(batches, "text", SLICE_BYTES):
            data, first, size = _texts(batch)
            text, window, n, h = anchors(data, first, size)
            bit = (h >> np.uint64(64 - bits)).astype(np.int64)
            may = np.flatnonzero(table[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
            text, window, n, h = text[may], window[may], n[may], h[may]
            if len(hot) and len(h):
                much = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                if much.any():
                    row, *cuts = split_hot(data, window[much], n[much], h[much])
                    text = np.concatenate([text[~much], text[much][row]])
                    window, n, h = (np.concatenate([old[~much], new]) for old, new in zip((window, n, h), cuts, strict=True))
            own = np.zeros(len(h), RECORD)
            own["h"], own["start"], own["n"] = h, window - first[text], n
            own["doc"] = batch.column(0).to_numpy(zero_copy_only=False)[text]
            own["tid"] = batch.column(2).to_numpy(zero_copy_only=False)[text]
            length = n + WINDOW - 1
            part = np.cumsum(length) // SLICE_BYTES
            for p in np.unique(part):
                now = np.flatnonzero(part == p)
                done = held.add(own[now], data[spread(window[now], length[now])])
                if held.size == held.least:  # just combined
                    yield from sent(done)
        yield from sent(held.combine(), True)

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(own: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(own[c])) for c in ("doc", "tid", "start", "n")], ["doc", "tid", "start", "end"])

        def finished(held: Contexts) -> Iterator[pa.RecordBatch]:
            yield out(held.combine())
            for own in distinct_repeats(*held.take()):
                if len(own):
                    yield out(own)

        held, now = Contexts(HELD_BYTES), None
        for batch in batches:
            for at, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if at != now and held.records:
                    yield from finished(held)
                now = at
                own, data = _unpacked(kind, blob.as_py())
                if len(done := own if kind else held.add(own, data)):
                    yield out(done)
        yield from finished(held)

    contexts = rows.mapInArrow(cut, "range int, kind int, rows binary")
    found = written(contexts.repartition(tasks, "range").sortWithinPartitions("range").mapInArrow(meet, "doc long, tid long, start int, end int"), "repeats")
    shared.unpersist()  # workers need not hold the tables any longer
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``doc_id, n_bytes, spans`` (removed byte ranges) ``, kept`` (the bytes that stay)."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    # a number tells rows of one id apart; it is written with them, so that every reading gives a row the same one
    keyed = written(rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("doc"), "text", F.monotonically_increasing_id().alias("tid"), "doc_id"), "numbered-rows")
    found = repeats(keyed.select("doc", "text", "tid"))
    per = found.groupBy("tid").agg(F.collect_list(F.struct("start", "end")).alias("hits"))
    joined = keyed.join(per, "tid", "left").select("doc_id", "text", "hits")

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches, "text"):
            size, spans, kept = [], [], []
            for t, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                own = merged([(x["start"], x["end"]) for x in hits or ()])
                edges = [0, *(e for s in own for e in s), len(raw)]
                size.append(len(raw))
                spans.append([{"start": a, "end": b} for a, b in own])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(apply, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
