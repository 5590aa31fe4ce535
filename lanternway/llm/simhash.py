"""SimHash near-dedup by anchor-point covering.

Anchors are the words of a covering code: the 64 bits are cut into blocks and each block is covered
by a repetition code, whose nearest word is the block's majority bit. The home of a fingerprint is its
nearest anchor. A fingerprint is replicated to every anchor that can be the home of a fingerprint within
the threshold, that is, to those where the blocks' cheapest majority flips together cost no more
(a subset of all anchors within covering radius plus threshold, and no partner is lost by it). At each
anchor, homes are compared with visitors; one-sided homes make the comparisons a square root fewer.

Only distinct fingerprints are compared, and each anchor range returns its links as stars, never all
pairs of a group. Where an anchor has more homes than a fingerprint has neighbours within the threshold,
its visitors' neighbours are looked up instead, so the work per fingerprint is bounded.

The number of blocks grows with the number of distinct fingerprints (`blocks_for`); at each size all
links are found.

Defined results: null text is empty; without a word the fingerprint is zero and links like any other;
one or two words are one shingle. Equal texts have equal fingerprints, so copies always meet.
Null ids stand in their component but never name it (it is null if all are). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternway.llm.common import pick, slices, strings, written
from lanternway.llm.components import local_stars, stars

SHINGLE, SEED, THRESHOLD = 3, 42, 2
#: Pairs compared at once, in numpy; fingerprints of a component that meet at one key; bytes of text hashed at once.
PAIRS, HOT, HASHED = 1 << 18, 1 << 16, 1 << 20
# For each byte value, its bits as eight counters of eight bits.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(texts: list[str], words: int = SHINGLE) -> np.ndarray:
    """The 64-bit SimHash of each text over its word shingles, repeats included."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    size = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = t.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
        if not own:
            continue
        line = b" ".join(own)
        ends, at = [], -1
        for w in own:
            at += len(w) + 1
            ends.append(at)
        n = max(1, len(own) - words + 1)
        size[i] = n
        if n == 1:
            hashes.append(digest(line, SEED))
        else:
            starts = [0, *[e + 1 for e in ends[: n - 1]]]
            hashes += [digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)]
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    n = size[some]
    first = np.cumsum(n) - n
    # counters of eight bits hold 255 hashes: sum runs of 255 first, then the runs of each text
    runs = -(-n // 255)
    run_first = np.repeat(first, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs))
    bytes_ = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    counts = np.add.reduceat(_SPREAD[bytes_], run_first, axis=0).view(np.uint8).reshape(-1, 64)
    total = np.add.reduceat(counts.astype(np.int64), np.cumsum(runs) - runs, axis=0)
    out[some] = np.packbits(2 * total > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


class Cover:
    """A direct sum of repetition codes over `blocks` blocks of the 64 bits."""

    def __init__(self, blocks: int) -> None:
        edge = np.linspace(0, 64, blocks + 1).astype(int)
        self.sizes = np.diff(edge)
        self.masks = np.array([((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edge, edge[1:], strict=False)], np.uint64)
        self.blocks = blocks

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest anchor, flips that move each block's majority) of fingerprints."""
        ones = np.stack([np.bitwise_count(x & m).astype(np.int16) for m in self.masks], 1)
        half = self.sizes // 2
        bit = ones > half
        cost = np.where(bit, ones - half, half + 1 - ones)
        return (bit.astype(np.uint64) << np.arange(self.blocks, dtype=np.uint64)).sum(1, dtype=np.uint64), cost

    def visits(self, x: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, is home): all anchors that may be the home of a fingerprint within `threshold`."""
        home, cost = self.homes(x)
        rows, anchors = [np.arange(len(x))], [home]
        level = [(np.arange(len(x)), home, np.zeros(len(x), np.int16), np.full(len(x), -1))]
        while level:
            grown = []
            for row, anchor, spent, last in level:
                for b in range(self.blocks):
                    ok = (last < b) & (spent + cost[row, b] <= threshold)
                    if ok.any():
                        grown.append((row[ok], anchor[ok] ^ np.uint64(1 << b), spent[ok] + cost[row[ok], b], np.full(int(ok.sum()), b)))
            if grown:
                merged = tuple(np.concatenate([g[i] for g in grown]) for i in range(4))
                rows.append(merged[0])
                anchors.append(merged[1])
                level = [merged] if (merged[2] < threshold).any() else []
            else:
                level = []
        row = np.concatenate(rows)
        return row, np.concatenate(anchors), np.arange(len(row)) < len(x)


def blocks_for(distinct: int) -> int:
    """Blocks of the code: 16 up to 2**24 distinct fingerprints, more beyond, 32 at most."""
    return int(np.clip(16 + (max(distinct, 1).bit_length() - 24), 16, 32))


def near_masks(threshold: int = THRESHOLD) -> np.ndarray:
    """All non-zero 64-bit words of at most `threshold` set bits."""
    level, every = np.zeros(1, np.uint64), []
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for _ in range(threshold):
        level = np.unique(level[:, None] ^ bits[None])
        every.append(level)
    masks = np.unique(np.concatenate(every))
    return masks[masks != 0]


def compare(anchor: np.ndarray, value: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links between homes and visitors of the same anchor, as stars of each component found."""
    order = np.lexsort((value, anchor))
    anchor, value, home = anchor[order], value[order], home[order]
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, int)
    stop = np.append(first[1:], len(anchor)).astype(int)
    before = np.append(0, np.cumsum(home))
    homes = before[stop] - before[first] if len(first) else np.zeros(0, int)
    ok = (homes > 0) & (stop - first > 1)
    a, b, most = np.zeros(0, np.uint64), np.zeros(0, np.uint64), PAIRS

    def add(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal a, b, most
        a, b = np.concatenate([a, x]), np.concatenate([b, y])
        if len(a) > most:  # stars that are many themselves wait until as many links have come again
            a, b = local_stars(a, b)
            most = max(PAIRS, 2 * len(a))

    masks = near_masks(threshold)
    for f, s in zip(first[ok & (homes > len(masks))].tolist(), stop[ok & (homes > len(masks))].tolist(), strict=True):
        known = np.sort(value[f:s][home[f:s]])
        for m in masks:
            other = value[f:s] ^ m
            at = np.minimum(np.searchsorted(known, other), len(known) - 1)
            hit = known[at] == other
            if hit.any():
                add(value[f:s][hit], other[hit])
    small = np.flatnonzero(ok & (homes <= len(masks)))
    # one row per home of a small anchor, with the range of its visitors
    at_home = np.flatnonzero(home & np.repeat(np.isin(np.arange(len(first)), small), stop - first)) if len(small) else np.zeros(0, int)
    group = np.searchsorted(first, at_home, side="right") - 1
    lo, n = first[group], stop[group] - first[group]
    i = 0
    while i < len(at_home):
        upto = np.cumsum(n[i : i + PAIRS])
        j = i + max(1, int(np.searchsorted(upto, PAIRS, side="right")))
        size = n[i:j]
        left = np.repeat(at_home[i:j], size)
        right = np.repeat(lo[i:j] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        x, y = value[left], value[right]
        hit = (np.bitwise_count(x ^ y) <= threshold) & (x != y)
        if hit.any():
            add(x[hit], y[hit])
        i = j
    return local_stars(a, b)


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rep, fp, ids``: documents of a batch with the same fingerprint in one row; written once."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", HASHED):
            fp = fingerprints(strings(batch.column(1)))
            order = np.argsort(fp, kind="stable")
            distinct, first = np.unique(fp[order], return_index=True)
            ids = pa.ListArray.from_arrays(pa.array(np.append(first, len(fp)).astype(np.int32)), batch.column(0).take(pa.array(order)))
            rep = (np.int64(part) << 40) + n + np.arange(len(distinct))
            n += len(distinct)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(distinct.view(np.int64)), ids], ["rep", "fp", "ids"])

    return written(rows.mapInArrow(run, f"rep long, fp long, ids array<{id_type}>"), "simhash")


def links(distinct: DataFrame, count: int, threshold: int = THRESHOLD) -> DataFrame:
    """``u, v``: links between distinct fingerprints ``fp``, as stars per range of anchors."""
    cover = Cover(blocks_for(count))
    spark = distinct.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // 50_000, 1)

    def scatter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(x), 8192):
                row, anchor, home = cover.visits(x[i : i + 8192], threshold)
                spread = (anchor * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                to = (spread % np.uint64(ranges)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                places, first = np.unique(to[order], return_index=True)
                packed = np.empty(len(row), [("a", "<u4"), ("v", "<u8"), ("h", "u1")])
                packed["a"], packed["v"], packed["h"] = anchor[order], x[i : i + 8192][row[order]], home[order]
                cuts = np.append(first, len(row))
                blobs = [packed[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(blobs, pa.binary())], ["range", "rows"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(r, [("a", "<u4"), ("v", "<u8"), ("h", "u1")]) for batch in batches for r in batch.column(1).to_pylist()]
        own = np.concatenate(held) if held else np.zeros(0, [("a", "<u4"), ("v", "<u8"), ("h", "u1")])
        u, v = compare(own["a"].copy(), own["v"].copy(), own["h"] == 1, threshold)
        yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.uint64).view(np.int64)), pa.array(v.astype(np.uint64).view(np.int64))], ["u", "v"])

    scattered = distinct.select("fp").mapInArrow(scatter, "range int, rows binary")
    return written(scattered.repartition(ranges, "range").mapInArrow(meet, "u long, v long"), "simhash-links")


def components_of(table: DataFrame, least: Column, threshold: int = THRESHOLD) -> DataFrame:
    """``fp, least``: every fingerprint of `table` with the smallest `least` of its component.

    Fingerprints without a link name themselves. The others meet the smallest one of their component at its
    root; roots of over `HOT` fingerprints (at most one in `HOT` of them all, so their list is broadcast)
    are dealt over several keys, so that no component fills a task.
    """
    distinct = written(table.groupBy("fp").agg(F.min(least).alias("least")), "simhash-distinct")
    joined = stars(links(distinct, distinct.count(), threshold)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    roots = joined.groupBy("root").agg(F.ceil(F.count("*") / HOT).cast("int").alias("of"))
    hot = F.broadcast(roots.where("of > 1"))
    members = joined.unionByName(roots.select(F.col("root").alias("fp"), "root")).join(hot, "root", "left").withColumn("of", F.coalesce("of", F.lit(1)))
    members = written(members.join(distinct, "fp").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("of")).cast("int")), "simhash-members")
    best = members.groupBy("root", "of").agg(F.min("least").alias("best")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).drop("of")
    named = members.join(best, ["root", "part"]).select("fp", F.col("best").alias("least"))
    return distinct.join(members.select("fp"), "fp", "left_anti").select("fp", "least").unionByName(named)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fp`` (long) ``, component_id``: the smallest id reachable by links."""
    table = fingerprint_table(docs, id_col, text_col)
    named = components_of(table, F.array_min("ids")).withColumnRenamed("least", "component_id")
    spread = table.join(named, "fp").repartition("rep")
    return spread.select(F.explode("ids").alias("doc_id"), "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of `docs` of which one of each component stays: that with the smallest id.

    Null ids come last; of rows with the same id that read first. Rows are told apart by a number of
    their own, so rows that share an id but not a component all stay.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows, at = docs.toDF(*names), docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in slices(batches, names[at], HASHED):
            fp = fingerprints(strings(batch.column(at)), words).view(np.int64)
            row = (np.int64(part) << 40) + n + np.arange(len(fp))
            n += len(fp)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp), pa.array(row)], [*batch.schema.names, "fp", "row"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    keyed = written(rows.mapInArrow(run, f"{fields}, fp long, row long"), "simhash-rows")
    own = F.col(names[docs.columns.index(id_col)])
    stays = components_of(keyed, F.struct(own.isNull().alias("none"), own.alias("id"), "row"), threshold).select(F.col("least.row").alias("row"))
    return keyed.join(stays, "row", "left_semi").select(*names).toDF(*docs.columns)
