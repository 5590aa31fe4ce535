"""Exact dedup by an extendible-hash index on shared files.

1. The directory is built from a histogram of key prefixes, in which texts of one 64-bit hash key weigh
   once, `ENTRY_BYTES` added (bounded: 2**`RESOLUTION` counts). It starts with one bucket; an overfull
   bucket splits on its next key bit, and the directory doubles when the bucket already uses all its bits.
   Buckets hold `BUCKET_BYTES`, more where the texts would fill over 2**18 of them. It is stored beside the index.
2. One scan combines equal texts of a batch: an *entry* has the text once, its key and bucket, the ids of
   its rows and all columns of the row with the largest id.
   For `assignments()` entries are written as the scan makes them, ids and all: their numbers are durable.
3. Entries go, without the ids, to the owner task of their bucket; each owner has a range of keys of about
   the same weight. They come sorted by key, then largest id first. The owner keeps a chain of different texts per key and
   compares bytes, so a collision never merges texts. It writes the index: sorted by key, a text only in
   the first entry of its chain, which holds the row that stays.
4. `kept()` reads these first entries. `assignments()` needs the size of each group too: sizes are summed
   per chain, and only entries of chains of several are joined to them, by their own unique number; so are
   the ids, last of all. A text shared by a third of all rows moves once per batch, not once per row, and
   its ids, a batch of them in a row, are spread by the entries' numbers: no task gathers them.

Defined results: null text counts as empty. Rows with equal texts form a group; the largest id stays
(nulls are smallest); of rows that share that id exactly one stays. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternway.llm.common import pick, slices, written

#: Key bits that the histogram resolves, bytes of distinct text that fill a bucket, and what a text weighs beside its bytes.
RESOLUTION, BUCKET_BYTES, ENTRY_BYTES = 20, 4 << 20, 128


class Directory:
    """Extendible hashing: `depth` leading key bits select a slot, a slot names its bucket."""

    def __init__(self, weight: np.ndarray, capacity: float) -> None:
        most = int(len(weight)).bit_length() - 1
        total = np.concatenate([[0.0], np.cumsum(weight)])
        self.depth, self.slots = 0, np.zeros(1, np.int64)
        first, local = np.zeros(1, np.int64), np.zeros(1, np.int64)  # of each bucket: its first prefix, the bits it uses
        span = len(weight)
        for bits in range(most):
            over = np.flatnonzero((local == bits) & (total[np.minimum(first + span, len(weight))] - total[first] > capacity))
            if not len(over):
                break
            # the directory doubles; an overfull bucket had one slot, of its two the upper names a new bucket
            self.slots, self.depth, span = np.repeat(self.slots, 2), self.depth + 1, span // 2
            local[over] += 1
            self.slots[2 * (first[over] // (2 * span)) + 1] = len(first) + np.arange(len(over))
            first, local = np.concatenate([first, first[over] + span]), np.concatenate([local, local[over]])
        self.first, self.local = first, local
        self.fill = total[np.minimum(first + (len(weight) >> local), len(weight))] - total[first]

    def bucket(self, key: np.ndarray) -> np.ndarray:
        if not self.depth:
            return np.zeros(len(key), np.int64)
        return self.slots[(key.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)]

    def owners(self, tasks: int) -> np.ndarray:
        """The task of each bucket: ranges of keys of about the same weight."""
        order = np.argsort(self.first)
        ahead = np.cumsum(self.fill[order]) - self.fill[order] / 2
        owner = np.empty(len(order), np.int32)
        owner[order] = np.minimum(ahead * tasks / max(float(self.fill.sum()), 1.0), tasks - 1).astype(np.int32)
        return owner


def key_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def directory_of(rows: DataFrame, capacity: int = BUCKET_BYTES) -> Directory:
    """The directory over keys of `rows.text`; texts of one key weigh once."""
    once = rows.groupBy(key_of(F.col("text")).alias("k")).agg((F.max(F.octet_length(F.coalesce("text", F.lit("")))) + ENTRY_BYTES).alias("w"))
    prefix = F.shiftrightunsigned("k", 64 - RESOLUTION).cast("int")
    counts = once.groupBy(prefix.alias("p")).agg(F.sum("w").cast("double").alias("w")).toArrow()  # at most 12 MB
    weight = np.zeros(1 << RESOLUTION)
    weight[counts["p"].to_numpy()] = counts["w"].to_numpy()
    return Directory(weight, max(capacity, weight.sum() / (1 << 18)))


class ExactDedup:
    """Exact duplicates of `docs`: `assignments()` names every row's group, `kept()` gives the rows that stay."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.docs, self.id_col, self.text_col = docs, id_col, text_col
        self.id_type = docs.schema[id_col].dataType.simpleString()
        self.directory = directory_of(pick(docs, text=text_col))

    def _entries(self, docs: DataFrame, id_col: str, text_col: str, tasks: int) -> DataFrame:
        """Entries: equal texts of a batch in one row, with all columns (c0, c1 ...) of the largest id."""
        directory, owner, at_id, at_text = self.directory, self.directory.owners(tasks), docs.columns.index(id_col), docs.columns.index(text_col)
        names = [f"c{i}" for i in range(len(docs.columns))]
        rows = docs.toDF(*names).withColumn("key", key_of(F.col(names[at_text])))

        def combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, n = TaskContext.get().partitionId(), 0
            for batch in slices(batches, names[at_text], 16 << 20):
                texts = ["" if t is None else t for t in batch.column(at_text).to_pylist()]
                ids = batch.column(at_id).to_pylist()
                groups: dict[str, list[int]] = {}
                for i, t in enumerate(texts):
                    groups.setdefault(t, []).append(i)
                for own in groups.values():
                    if len(own) > 1:
                        own.sort(key=lambda i: (ids[i] is not None, ids[i]), reverse=True)
                top = pa.array([own[0] for own in groups.values()])
                key = batch.column(len(names)).take(top).to_numpy(zero_copy_only=False).astype(np.int64)
                bucket = directory.bucket(key)
                reps = (np.int64(part) << 40) + n + np.arange(len(groups))
                n += len(groups)
                new = {
                    "rep": pa.array(reps), "key": pa.array(key), "bucket": pa.array(bucket), "owner": pa.array(owner[bucket]),
                    "ids": pa.array([[ids[i] for i in own] for own in groups.values()], pa.list_(batch.schema.field(at_id).type)),
                    "digest": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in groups]),
                }
                yield pa.RecordBatch.from_arrays([*new.values(), *(batch.column(i).take(top) for i in range(len(names)))], [*new, *names])

        fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
        return rows.mapInArrow(combine, f"rep long, key long, bucket long, owner int, ids array<{self.id_type}>, digest string, {fields}")

    @cached_property
    def tasks(self) -> int:
        return max(int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def _index(self, entries: DataFrame, text: str) -> DataFrame:
        """The index, written: an entry a row, its chain, digest and columns c0, c1 ...; of a chain only the first entry has its `text`."""
        tasks, spark = self.tasks, entries.sparkSession
        more = [c for c in entries.columns if c.startswith("c") and c != text]
        own = entries.select("rep", "key", "bucket", "owner", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("top"), "digest", F.coalesce(text, F.lit("")).cast("binary").alias("text"), F.col(text).isNull().alias("absent"), *more)
        placed = own.repartitionById(tasks, "owner").sortWithinPartitions("key", F.desc_nulls_last("top"), "rep")
        types = {f.name: f.dataType.simpleString() for f in placed.schema}
        kinds = ", ".join(f"{c} {types[c]}" for c in ("rep", "key", "bucket", "n", "digest", "text", "absent", *more))
        index = written(placed.mapInArrow(chained, f"chain long, first boolean, keep_id {self.id_type}, {kinds}"), "exact-index")
        d = self.directory
        written(spark.createDataFrame([(d.depth, d.slots.astype("<i4").tobytes(), d.local.astype("<i4").tobytes())], "depth int, slots binary, local binary"), "exact-directory")
        return index

    @cached_property
    def scanned(self) -> DataFrame:
        """Entries of ids and texts alone, written by the scan."""
        return written(self._entries(pick(self.docs, doc_id=self.id_col, text=self.text_col), "doc_id", "text", self.tasks), "exact-entries")

    @cached_property
    def narrow(self) -> DataFrame:
        """The index of ids and texts alone."""
        return self._index(self.scanned, "c1")

    def ids_of(self, text: str) -> DataFrame:
        """``doc_id`` of all rows with this text, by its bucket of the index."""
        spark = self.docs.sparkSession
        key = spark.range(1).select(key_of(F.lit(text))).first()[0]
        own = self.narrow.where((F.col("bucket") == int(self.directory.bucket(np.array([key], np.int64))[0])) & (F.col("key") == key))
        chain = own.where(F.col("first") & (F.col("text") == F.lit(text).cast("binary"))).select("chain")
        return self.scanned.select("rep", "ids").join(own.join(chain, "chain", "left_semi"), "rep", "left_semi").select(F.explode("ids").alias("doc_id"))

    def assignments(self) -> DataFrame:
        """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
        index = self.narrow
        several = index.groupBy("chain").agg(F.sum("n").alias("size"), F.count("*").alias("entries")).where("entries > 1")
        sizes = index.select("chain", "rep").join(several, "chain").select("rep", "size")
        rows = index.select("rep", "first", "keep_id", "n", "digest").join(sizes, "rep", "left").join(self.scanned.select("rep", "ids"), "rep")
        each = rows.select(F.coalesce("size", "n").alias("group_size"), "first", "keep_id", "digest", F.posexplode("ids").alias("place", "doc_id"))
        return each.select("doc_id", "keep_id", "group_size", (F.col("first") & (F.col("place") == 0)).alias("kept"), F.col("digest").alias("text_sha256"))

    def kept(self) -> DataFrame:
        """The rows that stay, with all columns of the input: the first entry of each chain of the index."""
        names = [f"c{i}" for i in range(len(self.docs.columns))]
        text = names[self.docs.columns.index(self.text_col)]
        first = self._index(self._entries(self.docs, self.id_col, self.text_col, self.tasks), text).where("first")
        whole = F.when(~F.col("absent"), F.col("text").cast("string")).alias(text)
        return first.select(*[whole if n == text else F.col(n) for n in names]).toDF(*self.docs.columns)


def chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner task: rows sorted by key, the largest id first; each gets the number of its chain of equal texts."""
    task, n = TaskContext.get(), 0
    base = (task.partitionId() if task else 0) << 40
    key, chains = None, {}  # of the open key: text -> (number, id that stays)
    for batch in batches:
        place = batch.schema.get_field_index
        at_text = place("text")
        texts, chain, first, keep = batch.column(at_text), [], [], []
        for i, (k, top) in enumerate(zip(batch.column(place("key")).to_pylist(), batch.column(place("top")).to_pylist(), strict=True)):
            if k != key:
                key, chains = k, {}
            text = texts[i].as_py()
            first.append(text not in chains)
            if first[-1]:
                chains[text] = base + n, top
                n += 1
            chain.append(chains[text][0])
            keep.append(chains[text][1])
        once = texts.take(pa.array([i if f else None for i, f in enumerate(first)], pa.int64()))
        rest = [(once if c == "text" else batch.column(place(c)), c) for c in batch.schema.names if c not in ("owner", "top")]
        yield pa.RecordBatch.from_arrays([pa.array(chain, pa.int64()), pa.array(first, pa.bool_()), pa.array(keep, batch.schema.field(place("top")).type), *(c for c, _ in rest)], ["chain", "first", "keep_id", *(c for _, c in rest)])
