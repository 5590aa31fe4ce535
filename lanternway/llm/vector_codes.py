"""Vector code compression: integer product codes, assigned by partial-distance search.

A component x becomes floor(`scale` * x); a vector is cut into `parts` equal consecutive parts, and each
part is named by one of at most 256 entries of its codebook. Codebooks start as the parts of the rows with
the smallest ids; a round assigns every part of all rows to its nearest entry, then replaces each entry by
its parts' componentwise floor(sum / count). All arithmetic is in integers, so results are the same however
rows are dealt.

Partial-distance search: components are taken in descending variance of the codebook. The first quarter is
summed for all entries; the entry that leads gets its complete distance, and from then on a pair of part
and entry is dropped once what it has summed strictly exceeds the best complete distance. Halfway the
leader is asked again, so the bound tightens.

A round is one scan without a shuffle of rows: a task sends one row per part and entry (count and sums).
The codebooks (256 times the vector's length) and these sums are all that reaches the driver.

Defined results: rows whose vector is null, or holds null or non-finite components, take no part; nor do
vectors of another length than most (ties to the longer), nor those whose error could not be held in a
long (from components of about 2**30 / sqrt(length) after scaling on). Lengths that `parts` does not divide
give parts that differ by one component. Fewer rows than entries make smaller codebooks. Null ids come
last in the order of ids; rows that share an id each count, the smaller vector first. Of equally near
entries the lower index wins; an entry without parts stays. An empty table gives no rows. Other columns
are carried on.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternway.llm.common import free_name, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows searched at once; a label with more than a `SHARE`-th of all rows is a hot one, so there are fewer than `SHARE`.
CHUNK, SHARE = 1024, 1024


def bound(length: int) -> int:
    """Scaled components below it give errors that a long holds: length * (2 * bound)**2 <= 2**62."""
    return math.isqrt((1 << 60) // max(length, 1))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row of integers; ties to the lower index."""
    n, width = x.shape
    if not n or not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    most = int(max(np.abs(x).max(), np.abs(book).max()))
    kind = np.int32 if 4 * width * most * most < 1 << 31 else np.int64
    order = np.argsort(-book.var(0), kind="stable")
    x, book = x[:, order].astype(kind), np.ascontiguousarray(book[:, order].T.astype(kind))
    head = max(1, width // 4)
    sums = np.zeros((n, book.shape[1]), kind)
    for j in range(head):
        gap = x[:, j, None] - book[j]
        sums += gap * gap

    def whole(entry: np.ndarray) -> np.ndarray:
        gap = x - book[:, entry].T
        return (gap * gap).sum(1, dtype=kind)

    best = whole(sums.argmin(1))
    row, entry = np.nonzero(sums <= best[:, None])
    part = sums[row, entry]
    for j in range(head, width):
        gap = x[row, j] - book[j, entry]
        part += gap * gap
        if j == (head + width) // 2:
            best = np.minimum(best, whole(entry[_leaders(row, part)]))
        live = part <= best[row]
        if not live.all():
            row, entry, part = row[live], entry[live], part[live]
    first = _leaders(row, part)
    return entry[first], part[first].astype(np.int64)


def _leaders(row: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Place of the first smallest sum of each row; every row has one, as its best entry is never dropped."""
    low = np.minimum.reduceat(part, np.flatnonzero(np.diff(row, prepend=-1)))
    at = np.flatnonzero(part == low[row])
    return at[np.flatnonzero(np.diff(row[at], prepend=-1))]


@dataclass(frozen=True)
class Codebooks:
    """`books[m]`: entries (rows) of part m. `length`: of the vectors."""

    books: list[np.ndarray]
    length: int

    def cuts(self) -> list[tuple[int, int]]:
        n = len(self.books)
        return [(m * self.length // n, (m + 1) * self.length // n) for m in range(n)]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry of each part, distance of each part) of whole integer vectors, `CHUNK` rows at a time."""
        code, far = np.zeros((len(x), len(self.books)), np.int64), np.zeros((len(x), len(self.books)), np.int64)
        for i in range(0, len(x), CHUNK):
            for m, (a, b) in enumerate(self.cuts()):
                code[i : i + CHUNK, m], far[i : i + CHUNK, m] = nearest(x[i : i + CHUNK, a:b], self.books[m])
        return code, far

    def sha256(self) -> str:
        """Of all entries' components in decimal, by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(str(v) for book in self.books for v in book.ravel().tolist()).encode()).hexdigest()


def integers(column: pa.ListArray, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of one length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * scale).astype(np.int64).reshape(len(column), -1)


def usable(vectors: DataFrame, vector_col: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, int]:
    """(rows that take part, the length of their vectors)."""
    v = F.col(f"`{vector_col}`")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    finite = vectors.where(v.isNotNull() & F.forall(v, number))
    most = finite.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = most["n"] if most else 0
    return finite.where((F.size(v) == length) & F.forall(v, lambda x: F.abs(x.cast("double")) * scale < bound(length) - 1)), length


def learn(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """(rows that take part, codebooks after `rounds` rounds over all of them)."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index is one byte: 1 to 256 entries")
    rows, length = usable(vectors, vector_col, scale)
    only = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    first = only.orderBy(F.asc_nulls_last("id"), "v").limit(entries).toArrow()  # `entries` rows at most
    start = integers(first["v"].combine_chunks(), scale) if first.num_rows else np.zeros((0, length), np.int64)
    found = Codebooks([start[:, m * length // parts : (m + 1) * length // parts] for m in range(parts)], length)
    for _ in range(rounds if first.num_rows else 0):
        found = updated(only.select("v"), found, scale)
    return rows, found


def updated(only: DataFrame, at: Codebooks, scale: int = SCALE) -> Codebooks:
    """Codebooks after one more round over all rows of `only.v`."""
    widest = max(b - a for a, b in at.cuts())

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(book), np.int64) for book in at.books]
        total = [np.zeros(book.shape, np.int64) for book in at.books]
        for batch in batches:
            x = integers(batch.column(0), scale)
            code, _ = at.assign(x)
            for m, (a, b) in enumerate(at.cuts()):
                count[m] += np.bincount(code[:, m], minlength=len(count[m]))
                np.add.at(total[m], code[:, m], x[:, a:b])
        for m, (n, s) in enumerate(zip(count, total, strict=True)):
            own = np.flatnonzero(n)
            lists = pa.array([row.tolist() for row in s[own]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), m, np.int32)), pa.array(own.astype(np.int32)), pa.array(n[own]), lists], ["part", "entry", "n", "sums"])

    each = only.mapInArrow(tally, "part int, entry int, n long, sums array<long>")
    sums = [F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(widest)]
    books = [book.copy() for book in at.books]
    for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():  # parts * entries rows
        book = books[r["part"]]
        book[r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(book.shape[1])]
    return Codebooks(books, at.length)


def encode(rows: DataFrame, books: Codebooks, vector_col: str = "embedding", scale: int = SCALE, into: tuple[str, str] = ("code", "error")) -> DataFrame:
    """`rows` (of `learn`) with the code of each vector, a byte per part, and its squared error, in place of the vector."""
    names = [c for c in rows.columns if c != vector_col]
    lists = rows.select(F.col(f"`{vector_col}`").alias("v"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    fields = [f"c{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(names)]

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, far = books.assign(integers(batch.column(0), scale))
            raw = pa.array([r.tobytes() for r in own.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], raw, pa.array(far.sum(1))], [*batch.schema.names[1:], "code", "error"])

    return lists.mapInArrow(code, ", ".join([*fields, "code binary", "error long"])).toDF(*names, *into)


def with_total(rows: DataFrame, key: str, value: str, into: str) -> DataFrame:
    """`rows` with the sum of `value` over rows of equal `key` (nulls are equal).

    Keys of more than a `SHARE`-th of all rows are fewer than `SHARE`, so their sums are broadcast; the
    other rows meet their sums in a shuffle in which no key is large.
    """
    rows = written(rows, "rows-to-total")
    name, size = free_name(rows, "key"), free_name(rows, "n")
    k = F.col(f"`{key}`")
    sums = written(rows.groupBy(k.alias(name)).agg(F.sum(f"`{value}`").alias(into), F.count("*").alias(size)), "totals")
    hot = F.col(size) * SHARE > (sums.agg(F.sum(size)).first()[0] or 0)
    columns = [F.col(f"`{c}`") for c in rows.columns]
    placed = rows.join(F.broadcast(sums.where(hot)), k.eqNullSafe(F.col(name)), "left")
    crowd = placed.where(F.col(size).isNotNull()).select(*columns, into)
    rest = placed.where(F.col(size).isNull()).select(*columns).join(sums.where(~hot), k.eqNullSafe(F.col(name))).select(*columns, into)
    return crowd.unionByName(rest)


def hexed(code: Column) -> Column:
    return F.lower(F.hex(code))
