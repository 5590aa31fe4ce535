"""Token files: ids in Simple-8b words, in ascending order of document id.

A word is a 4-bit selector and 60 bits of data; the selector says how many ids of how many bits the
word holds. Ids are coded in blocks of `BLOCK`; a stream keeps the word offset of every block, so all
blocks are coded, and decoded, at once in numpy. A value that does not fit in 60 bits is an escape:
the word holds 0 and the value stands, with its position, in the stream's escape list.

Stream: magic ``S8B1``, then little-endian uint64 counts (ids, blocks, words, escapes), the blocks'
word offsets (uint32), escape positions and values (uint64), words (uint64).

A file row holds a stream of about `CHUNK` ids and the ids and lengths of its documents; rows are
written as a table by Spark's own writer, so any store that Spark writes will do. Documents are
range-partitioned by id; each shard knows its ids before, so every row is read back on its own.

Defined results: null text is empty and yields its end id; null document ids come first; rows with the
same id are ordered by text. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternway.llm.byte_tokens import default_vocabulary, encode
from lanternway.llm.common import pick, slices, strings, written

BLOCK, CHUNK = 512, 1 << 20
#: Selectors of Simple-8b, fixed values: ids in a word, bits of each.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
MAGIC = b"S8B1"
_WIDTH = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _selectors(width: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, start, selector) of every word.

    The widest of the next c ids is found once for each c, from every place on, by sliding maxima; a denser
    selector (more ids, fewer bits) fits only where all less dense ones do, so their number names the
    densest. Then all blocks follow their chain of words, one word at a time.
    """
    flat, columns = width.ravel(), width.shape[1]  # columns behind a block's ids are 0, so they fit anywhere
    chosen, most, held = np.full(len(flat), len(COUNTS) - 1, np.uint8), flat, 1
    for s in range(len(COUNTS) - 2, -1, -1):  # ever more ids with ever fewer bits
        while held < COUNTS[s]:
            step = min(held, int(COUNTS[s]) - held)
            most, held = np.maximum(most[:-step], most[step:]), held + step
        chosen[: len(most)] -= most <= int(BITS[s])
    ahead = COUNTS.astype(np.uint8)[chosen]
    base = np.arange(len(n), dtype=np.int64) * columns
    at, end, steps = base.copy(), base + n, []
    while (live := at < end).any():
        steps.append(np.where(live, at, -1))
        at = np.where(live, at + ahead.take(at, mode="clip"), at)
    place = np.stack(steps, 1).ravel() if steps else base[:0]
    place = place[place >= 0]
    return place // columns, place % columns, chosen[place].astype(np.int64)


def pack_ids(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A stream of unsigned ids (up to 64 bits)."""
    ids = np.asarray(ids)
    ids = ids if ids.dtype.kind == "u" else ids.astype(np.uint64)
    top = int(ids.max()) if len(ids) else 0
    wide = np.flatnonzero(ids >> np.uint64(60)) if top >> 60 else np.zeros(0, np.int64)
    values = ids
    if len(wide):
        values = ids.copy()
        values[wide] = 0
    blocks, whole = -(-len(ids) // block), len(ids) // block
    padded = np.zeros((blocks, block + 240), ids.dtype)
    n = np.minimum(block, len(ids) - np.arange(blocks) * block)
    padded[:whole, :block] = values[: whole * block].reshape(whole, block)
    if whole < blocks:
        padded[whole, : n[-1]] = values[whole * block :]
    width = np.zeros(padded.shape, np.uint8)
    # bits of each id, 0 for 0
    width[:, :block] = _WIDTH.take(padded[:, :block]) if top < len(_WIDTH) else np.frexp(padded[:, :block].astype(np.float64))[1]
    own, start, sel = _selectors(width, n)
    words = sel.astype(np.uint64) << np.uint64(60)
    line, first = padded.ravel(), own * padded.shape[1] + start
    for s in np.unique(sel):
        at, bits = np.flatnonzero(sel == s), int(BITS[s])
        if bits:
            acc = np.zeros(len(at), np.uint64)
            for k in range(int(COUNTS[s])):
                acc |= line.take(first[at] + k).astype(np.uint64) << np.uint64(bits * k)
            words[at] |= acc
    offsets = np.searchsorted(own, np.arange(blocks)).astype("<u4")
    head = MAGIC + struct.pack("<4Q", len(ids), blocks, len(words), len(wide)) + struct.pack("<I", block)
    return head + offsets.tobytes() + wide.astype("<u8").tobytes() + ids[wide].astype("<u8").tobytes() + words.astype("<u8").tobytes()


def unpack_ids(stream: bytes) -> np.ndarray:
    """The ids of a stream; all blocks at once."""
    if stream[:4] != MAGIC:
        raise ValueError("not a Simple-8b stream")
    n, blocks, words, wide = struct.unpack_from("<4Q", stream, 4)
    (block,) = struct.unpack_from("<I", stream, 36)
    at = 40
    offsets = np.frombuffer(stream, "<u4", blocks, at).astype(np.int64)
    at += 4 * blocks
    where, value = np.frombuffer(stream, "<u8", wide, at), np.frombuffer(stream, "<u8", wide, at + 8 * wide)
    data = np.frombuffer(stream, "<u8", words, at + 16 * wide)
    sel = (data >> np.uint64(60)).astype(np.int64)
    each = COUNTS[sel]
    ahead = np.cumsum(each) - each
    per = np.diff(np.append(offsets, words))
    start = ahead - np.repeat(ahead[offsets] if blocks else ahead, per) + np.repeat(np.arange(blocks) * block, per)
    out = np.zeros(n + 240, np.uint64)
    stop = np.minimum(np.repeat((np.arange(blocks) + 1) * block, per), n)
    for s in np.unique(sel):
        rows, bits = np.flatnonzero(sel == s), int(BITS[s])
        if not bits:
            continue
        mask = np.uint64((1 << bits) - 1)
        for k in range(int(COUNTS[s])):
            to = start[rows] + k
            ok = to < stop[rows]
            out[to[ok]] = (data[rows[ok]] >> np.uint64(bits * k)) & mask
    out = out[:n]
    out[where.astype(np.int64)] = value
    return out


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Write the token files; returns their table ``shard, before, doc_ids, lengths, n_ids, stream``."""
    rows, path = pick(docs, doc_id=id_col, text=text_col), vocabulary or default_vocabulary()
    id_type = rows.schema["doc_id"].dataType.simpleString()
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        doc_ids, own, id_arrow = [], [], pa.int64()

        def row() -> pa.RecordBatch:
            nonlocal before
            ids = np.concatenate(own)
            cols = [pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([doc_ids], pa.list_(id_arrow)), pa.array([[len(x) for x in own]], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([pack_ids(ids)], pa.binary())]
            before += len(ids)
            return pa.RecordBatch.from_arrays(cols, ["shard", "before", "doc_ids", "lengths", "n_ids", "stream"])

        held = 0
        for batch in slices(batches, "text", 1 << 20):
            id_arrow = batch.schema.field(0).type
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(strings(batch.column(1)), path), strict=True):
                doc_ids.append(doc_id)
                own.append(ids)
                held += len(ids)
                if held >= CHUNK:
                    yield row()
                    doc_ids, own, held = [], [], 0
        if own:
            yield row()

    return written(ordered.mapInArrow(code, f"shard int, before long, doc_ids array<{id_type}>, lengths array<long>, n_ids long, stream binary"), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """Documents read back from the files: ``doc_id, start, n_tokens, ids`` (little-endian uint32)."""
    totals = {r["shard"]: r["n"] for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}  # one number per shard
    starts, total = {}, 0
    for shard in sorted(totals):
        starts[shard] = total
        total += totals[shard]
    id_type = files.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, before, docs, lengths, _, stream = (batch.column(k).slice(i, 1) for k in range(6))
                ids = unpack_ids(stream[0].as_py()).astype("<u4")
                size = np.array(lengths[0].as_py(), np.int64)
                first = np.cumsum(size) - size
                ends = np.append(4 * first, 4 * len(ids)).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.tobytes())])
                start = first + before[0].as_py() + starts[shard[0].as_py()]
                yield pa.RecordBatch.from_arrays([docs.flatten(), pa.array(start), pa.array(size), blob], ["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(decode, f"doc_id {id_type}, start long, n_tokens long, ids binary")
