"""Packing by best-fit decreasing, with a segment tree indexed by remaining capacity.

Documents are tokenised and cut into full windows and a remainder where they are read. Best-fit
decreasing only looks at lengths, and lengths are at most the capacity, so the plan is made once from
the histogram of lengths: the tree finds the tightest open window for a length, and all pieces of
that length that best-fit would place alike are placed in one step. The plan has a bounded number of
runs at any corpus size (lengths times distinct remaining capacities); it gives the same windows as
placing piece after piece. Each piece finds its run from its rank among the pieces of its length:
its rank in its task, plus the counts of the tasks before (a window over tasks, per length).

Defined results: a null text is empty and yields its end id only. Pieces with equal length are ranked
by task, then place. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternway.llm.byte_tokens import default_vocabulary, encode
from lanternway.llm.common import pick, slices, strings, written

CAPACITY = 1024


class CapacityTree:
    """Segment tree over remaining capacities: how many open windows have each."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.size)

    def add(self, remaining: int, windows: int) -> None:
        at = remaining + self.size
        while at:
            self.sums[at] += windows
            at //= 2

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of an open window that is `need` or more."""
        at = need + self.size
        if self.sums[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.sums[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


@dataclass(frozen=True)
class Plan:
    """Runs of pieces of one length: rank `first` on goes to windows from `window` on, `each` to a window."""

    capacity: int
    length: np.ndarray
    first: np.ndarray
    window: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    fill_from: np.ndarray
    fill: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, offset in it) of pieces."""
        key = lambda size, at: (size.astype(np.int64) << 44) + at
        run = np.searchsorted(key(self.length, self.first), key(length, rank), side="right") - 1
        k = rank - self.first[run]
        return self.window[run] + k // self.each[run], self.offset[run] + k % self.each[run] * length

    def filled(self, window: np.ndarray) -> np.ndarray:
        return self.fill[np.searchsorted(self.fill_from, window, side="right") - 1]


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Place `counts[length]` pieces of each length, longest first, each into the tightest open window."""
    tree, open_, runs, windows = CapacityTree(capacity), {}, [], 0

    def keep(remaining: int, first: int, n: int) -> None:
        if n:
            open_.setdefault(remaining, []).append((first, n))
            tree.add(remaining, n)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                new = -(-left // (capacity // length))
                keep(capacity, windows, new)
                windows += new
                continue
            first, n = open_[room].pop()
            tree.add(room, -n)
            each = room // length
            whole = min(n, left // each)
            if whole:
                runs.append((length, rank, first, each, capacity - room))
                keep(room - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < n:
                if left:  # the last few share one window
                    runs.append((length, rank, first + whole, left, capacity - room))
                    keep(room - left * length, first + whole, 1)
                    keep(room, first + whole + 1, n - whole - 1)
                    left = 0
                else:
                    keep(room, first + whole, n - whole)
    runs.sort()
    fills = sorted((first, capacity - room) for room, own in open_.items() for first, n in own if n)
    cols = [np.array([r[i] for r in runs], np.int64) for i in range(5)]
    return Plan(capacity, *cols, np.array([f for f, _ in fills], np.int64), np.array([v for _, v in fills], np.int64))


def cut_documents(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Pieces ``doc_id, start, length, ids, doc_tokens``: full windows, then the remainder; `ids` little-endian uint32."""
    rows, path = pick(docs, doc_id=id_col, text=text_col), vocabulary or default_vocabulary()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            row, start, length, ids, total = [], [], [], [], []
            for i, own in enumerate(encode(strings(batch.column(1)), path)):
                for a in range(0, len(own), capacity):
                    part = own[a : a + capacity]
                    row.append(i)
                    start.append(a)
                    length.append(len(part))
                    ids.append(part.astype("<u4").tobytes())
                    total.append(len(own))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())], ["doc_id", "start", "length", "ids", "doc_tokens"])

    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All columns of `pieces` (one is ``length``, 1 to `capacity`) plus the window of each piece.

    Adds ``sequence_id, offset, sequence_tokens`` and ``sequence_padded``: the tokens a sequence is
    padded to, the capacity, or just its tokens where these are a power of two.
    """
    pieces = pieces.drop("sequence_id", "offset", "sequence_tokens", "sequence_padded", "part", "rank", "base")
    at, fields = pieces.columns.index("length"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(length, kind="stable")
            sizes, first, n = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(first - seen[sizes], n)
            seen[sizes] += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(rank)], [*batch.schema.names, "part", "rank"])

    numbered = written(pieces.mapInArrow(number, f"{fields}, part int, rank long"), "pack-pieces")
    tasks = numbered.groupBy("part", "length").count()
    plan = best_fit_decreasing({r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = tasks.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = numbered.join(base, ["part", "length"]).select(*pieces.columns, (F.col("rank") + F.col("base")).alias("rank"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            window, offset = plan.place(length, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64))
            fill = plan.filled(window)
            padded = np.where(fill & (fill - 1) == 0, fill, capacity)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, (window, offset, fill, padded))], [*batch.schema.names[:-1], "sequence_id", "offset", "sequence_tokens", "sequence_padded"])

    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long, sequence_tokens long, sequence_padded long")


def sequences(packed: DataFrame) -> DataFrame:
    """The windows themselves, ``sequence_id, ids``, from packed pieces that still hold their ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
