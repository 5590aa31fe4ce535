"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Fitted on a bounded sample (`SAMPLE` vectors or four a centroid, by a hash of the id): coarse centroids,
and per sub-vector a codebook of the residuals. The number of centroids grows as the square root of the
rows, up to `CELLS` (from 268 million rows on cells grow instead: the same results, more work a query).
Every row is then indexed: its cell, a byte per sub-vector, and how far its codewords are from it.
How many cells a query probes, and how far a score by codewords may fall short, are calibrated against
brute force: `ASKED` of the queries look at every row of the index. `TARGET` of their true neighbours lie in
probed cells, and `WITHIN` within the shortfall. Rows much longer than the others (`STRAYS` of them or one
in as many, at least twice the median norm) fit no cell: they have one of their own that every query probes.
Ranking is scale-free: queries count as unit vectors, rows in median norms.

Cells are spread over shards by size, big cells in blocks, so that no cell has to fit in one task. A
query goes to the shards that hold a cell it probes; a shard is copied only as often as the number of
queries that ask it calls for. There its asymmetric distance tables (inner
products with all codewords) score the codes of a block; the best `SHORTLIST` of a block, and all others that may
beat the `k` best met so far, are scored again on the original vectors in double precision, and a shard returns
its best `k` per query. Of equal vectors a shard scores the `k` + 1 with the smallest ids: no other can be an answer.

Defined results: of rows that share an id one counts, that with the smallest vector. Vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, nor do rows with a null id. A query's own row (same id) is no candidate. Ties
go to the smaller id. Fewer candidates than `k` give them all. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternway.llm.common import pick, written

SAMPLE, CELLS, TARGET, SHORTLIST, NEAREST = 16_384, 16_384, 0.97, 40, 20
#: Rows of an index block and of a shard, and queries that a shard takes at once.
BLOCK, SHARD, QUERIES = 2048, 16_384, 4096
SUB, CODES = 4, 256
#: Sample rows from which centroids are fitted on one half and probes calibrated on the other.
APART = 4096
#: Queries that are searched by brute force to calibrate, and the part of their neighbours whose score by codes may not fall shorter.
ASKED, WITHIN = 512, 0.99
#: Rows of outlying norm that every query looks at: so many, or one row in as many.
STRAYS = 1024
#: Pairs scored again at once.
PAIRS = 1 << 16
#: Shards up to which the table of queries per shard is broadcast (two numbers a shard: 16 MB).
BROADCAST = 1 << 20


def means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means centroids; an empty centroid moves to the point farthest from its own."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own, far = nearest(x, centre)
        n = np.bincount(own, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
        for c, p in zip(np.flatnonzero(n == 0).tolist(), np.argsort(-far).tolist(), strict=False):
            centre[c] = x[p]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest centroid, squared distance) of each row."""
    norm = np.einsum("ij,ij->i", centre, centre)
    own, far = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    for i in range(0, len(x), 8192):
        d = norm - 2 * x[i : i + 8192] @ centre.T
        own[i : i + 8192] = d.argmin(1)
        far[i : i + 8192] = d.min(1) + np.einsum("ij,ij->i", x[i : i + 8192], x[i : i + 8192])
    return own, far


def cells_for(rows: int) -> int:
    """Coarse centroids: a power of two near the square root of the rows."""
    return int(np.clip(2 ** round(np.log2(max(rows, 1)) / 2), 1, CELLS))


@dataclass(frozen=True)
class Quantiser:
    """Coarse centroids and a codebook for each run of `SUB` components of the residuals."""

    centre: np.ndarray
    books: np.ndarray
    probes: int
    unit: float = 1.0
    longest: float = np.inf
    slack: float = 1.0

    @staticmethod
    def of_sample(x: np.ndarray, rows: int, k: int = NEAREST) -> Quantiser:
        """Fitted on original vectors: in median norms, without strays."""
        size = norms(x)
        unit = float(np.median(size))
        longest = max(2.0, float(np.quantile(size, 1 - min(1.0, max(STRAYS, rows / STRAYS) / rows))) / unit)
        usual = x[size / unit <= longest] / unit
        return replace(Quantiser.fit(usual.astype(np.float32), rows, k), unit=unit, longest=longest)

    @staticmethod
    def fit(x: np.ndarray, rows: int, k: int = NEAREST) -> Quantiser:
        apart = len(x) >= APART  # a smaller sample serves both ends
        fit, rest = (x[::2], x[1::2]) if apart else (x, x)
        centre = means(fit, cells_for(rows))
        own, _ = nearest(fit, centre)
        left = split(fit - centre[own])
        books = np.zeros((left.shape[1], CODES, SUB), np.float32)
        for m in range(left.shape[1]):
            found = means(left[:, m], CODES)
            books[m, : len(found)] = found
        return Quantiser(centre, books, calibrated(rest, centre, nearest(rest, centre)[0], k))

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, _ = nearest(x, self.centre)
        rest = split(x - self.centre[own])
        return own, np.stack([nearest(rest[:, m], self.books[m])[0] for m in range(rest.shape[1])], 1).astype(np.uint8)

    def index(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, codes, distance from the codewords) of original vectors; strays are infinitely far, in the cell after the last."""
        stray = norms(x) / self.unit > self.longest
        small = np.where(stray[:, None], 0.0, x / self.unit).astype(np.float32)
        cell, codes = self.code(small)
        parts = np.arange(codes.shape[1])
        away = split(small - self.centre[cell]) - self.books[parts, codes]
        off = np.sqrt(np.einsum("nms,nms->n", away, away)).astype(np.float32)
        return np.where(stray, len(self.centre), cell), codes, np.where(stray, np.float32(np.inf), off)

    def rough(self, q: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Score by codes of each unit query with the row beside it."""
        word = self.books[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)[:, : q.shape[1]]
        return np.einsum("ij,ij->i", q, self.centre[np.minimum(cell, len(self.centre) - 1)] + word)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Asymmetric distance tables: inner products of each query's sub-vectors with all codewords."""
        return np.einsum("qms,mcs->qmc", split(q), self.books).astype(np.float32)

    def probed(self, q: np.ndarray) -> np.ndarray:
        """The cells a query probes: those with the largest inner products, and that of the strays."""
        score = q @ self.centre.T
        n = min(self.probes, score.shape[1])
        usual = np.argpartition(-score, n - 1, axis=1)[:, :n] if n < score.shape[1] else np.tile(np.arange(n), (len(q), 1))
        return np.pad(usual, ((0, 0), (0, 1)), constant_values=score.shape[1])


@dataclass(frozen=True)
class Home:
    """Where a cell stands in the order of all cells: rows before it, its blocks, its rows."""

    start: int
    blocks: int
    rows: int

    def shards(self) -> range:
        """Shards that hold its blocks."""
        return range(self.start // SHARD, (self.start + (self.blocks - 1) * self.rows // self.blocks) // SHARD + 1)


def shard_of(start: Column, block: Column, blocks: Column, rows: Column) -> Column:
    """The shard of a block of a cell; `Home.shards` has all of a cell."""
    return F.floor((start + F.floor(block * rows / blocks)) / SHARD)


def split(x: np.ndarray) -> np.ndarray:
    """Rows as sub-vectors, the last filled up with zeros."""
    spare = -x.shape[1] % SUB
    return np.pad(x, ((0, 0), (0, spare))).reshape(len(x), -1, SUB)


def calibrated(x: np.ndarray, centre: np.ndarray, own: np.ndarray, k: int) -> int:
    """Cells to probe so that `TARGET` of the sample's true neighbours are met, on average."""
    asked = np.arange(0, len(x), max(1, len(x) // 512))
    q = x[asked]
    score = q @ x.T
    score[np.arange(len(q)), asked] = -np.inf  # not the query itself
    k = min(k, x.shape[0])
    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
    rank = np.empty((len(q), len(centre)), np.int64)
    np.put_along_axis(rank, np.argsort(-(q @ centre.T), axis=1), np.arange(len(centre))[None].repeat(len(q), 0), axis=1)
    need = np.take_along_axis(rank, own[top], axis=1).ravel()
    return int(np.sort(need)[min(len(need) - 1, int(np.ceil(TARGET * len(need))))]) + 1


def usable(v: Column) -> Column:
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & sound & F.exists(v, lambda x: x != 0), F.lit(False))


def one_per_id(rows: DataFrame) -> DataFrame:
    """Of rows (vec_id, v) that share an id the one with the smallest vector; only ids are shuffled to find them."""
    again = rows.groupBy("vec_id").count().where("count > 1").select("vec_id")
    if again.isEmpty():
        return rows
    again = written(again, "vector-ids")
    one = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows.join(again, "vec_id", "left_anti").unionByName(one)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norms, of very large and very small vectors too."""
    peak = np.abs(x).max(1, initial=0.0)
    safe = np.where(peak > 0, peak, 1.0)
    return peak * np.sqrt(np.square(x / safe[:, None]).sum(1))


def directions(x: np.ndarray) -> np.ndarray:
    """Unit vectors for ranking; their scores keep the order of the original ones."""
    peak = np.abs(x).max(1, keepdims=True)
    flat = x / np.where(peak > 0, peak, 1.0)
    return (flat / np.sqrt(np.square(flat).sum(1, keepdims=True))).astype(np.float32)


def exact(q: np.ndarray, x: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of pairs of original vectors; equal pairs give equal numbers."""
    parts = [np.einsum("ij,ij->i", q[row[i : i + PAIRS]], x[at[i : i + PAIRS]]) for i in range(0, len(row), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def smallest_of_equals(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows but those with `k` equal vectors of smaller ids, in their order."""
    _, same = np.unique(np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)
    return np.sort(best_rows(same, ids, np.zeros(len(ids)), k))


def score_block(q: np.ndarray, qid: np.ndarray, unit: np.ndarray, ids: np.ndarray, codes: np.ndarray, off: np.ndarray, x: np.ndarray, base: np.ndarray, tables: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, exact score) of all rows of one block that may be among the best for the queries that probe its cell.

    `top`: the best exact scores each query has met, updated here; `unit`: what a rough score of 1 means for
    each query; `off`: by how much a rough score may fall short.
    """
    n = min(SHORTLIST + 1, len(ids))
    rough = np.repeat(base[:, None], len(ids), 1)
    for m in range(codes.shape[1]):
        rough += tables[:, m].take(codes[:, m], axis=1)
    part = np.argpartition(-rough, n - 1, axis=1)[:, :n] if n < len(ids) else np.tile(np.arange(n), (len(q), 1))
    row, at = np.repeat(np.arange(len(q)), n), part.ravel()
    score = np.where(ids[at] != qid[row], exact(q, x, row, at), -np.inf)
    k = top.shape[1]
    top[:] = np.partition(np.concatenate([top, score.reshape(len(q), n)], 1), -k, axis=1)[:, -k:]
    least = top.min(1)
    found = row, at, score
    if n < len(ids):
        open_ = rough + off >= (least / unit)[:, None]
        np.put_along_axis(open_, part, False, axis=1)
        if open_.mean() > 1 / 16:  # one product of matrices is quicker than so many pairs; its rounding is allowed for
            open_ &= q @ x.T >= least[:, None] - 1e-12 * norms(q)[:, None] * norms(x)
        more, there = np.nonzero(open_)
        new = np.where(ids[there] != qid[more], exact(q, x, more, there), -np.inf)
        found = tuple(np.concatenate(f) for f in zip(found, (more, there, new), strict=True))
    keep = (found[2] >= least[found[0]]) & (found[2] > -np.inf)
    return found[0][keep], ids[found[1][keep]], found[2][keep]


def best_rows(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` best of each query, in order."""
    order = np.lexsort((ids, -score, query))
    own = query[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = best_rows(query, ids, score, k)
    return query[at], ids[at], score[at]


def measured(index: DataFrame, fitted: Quantiser, k: int, every: int) -> Quantiser:
    """The quantiser with probes (no fewer than the sample calls for) and slack for the true neighbours of `ASKED` queries, over every row."""
    asked = index.where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id", F.lit("asked"))).limit(ASKED).select("vec_id", "x").collect()
    if not asked:
        return fitted
    spark = index.sparkSession
    qid = np.array([r["vec_id"] for r in asked])
    q = np.stack([np.frombuffer(r["x"], np.float64) for r in asked])
    shared = spark.sparkContext.broadcast((fitted, qid, q))

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quant, qid, q = shared.value
        small, unit = directions(q), norms(q) * quant.unit
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32), np.zeros(0)]
        least = np.full(len(q), -np.inf)
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(i, BLOCK)
                ids = batch.column(0).to_numpy()
                x = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float64).reshape(len(ids), -1)
                score = np.where(ids[None] == qid[:, None], -np.inf, q @ x.T)
                n = min(k, len(ids))
                at = np.argpartition(-score, n - 1, axis=1)[:, :n].ravel()
                row = np.repeat(np.arange(len(q)), n)
                better = score[row, at] > least[row]
                row, at = row[better], at[better]
                if not len(row):
                    continue
                cell, off = batch.column(1).to_numpy()[at], batch.column(3).to_numpy()[at].astype(np.float64)
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)[at]
                coded = np.isfinite(off) & (off > 0)
                short = np.where(coded, (score[row, at] / unit[row] - quant.rough(small[row], cell, codes)) / np.where(coded, off, 1), 0.0)
                both = [np.concatenate(p) for p in zip(held, (row, ids[at], score[row, at], cell, short), strict=True)]
                held = [p[best_rows(both[0], both[1], both[2], k)] for p in both]
                full = np.bincount(held[0], minlength=len(q)) == k
                low = np.full(len(q), np.inf)
                np.minimum.at(low, held[0], held[2])
                least = np.where(full, low, -np.inf)
        order = small @ quant.centre.T
        need = np.zeros(len(held[0]), np.int32)  # 0: a stray, which all queries meet
        for i in range(0, len(need), 256):
            own, cell = order[held[0][i : i + 256]], held[3][i : i + 256]
            mark = np.take_along_axis(own, np.minimum(cell, own.shape[1] - 1)[:, None], 1)
            need[i : i + 256] = np.where(cell < own.shape[1], (own > mark).sum(1) + 1, 0)
        held[3] = need
        yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], ["query", "vec_id", "score", "need", "short"])

    near = index.select("vec_id", "cell", "codes", "off", "x").mapInArrow(look, "query long, vec_id long, score double, need int, short double").where("score > double('-inf')")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    true = near.withColumn("rank", rank).where(F.col("rank") <= k).select("need", "short").toArrow()  # `k` rows for each of these queries
    if not true.num_rows:
        return fitted
    need, short = np.sort(true["need"].to_numpy()), np.sort(true["short"].to_numpy())
    at = lambda part: min(len(need) - 1, int(np.ceil(part * len(need))))
    return replace(fitted, probes=max(fitted.probes, int(need[at(TARGET)])), slack=max(1e-3, float(short[at(WITHIN)])))


def search(vectors: DataFrame, k: int = NEAREST, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the `k` nearest found for each row whose id `every` divides."""
    spark = vectors.sparkSession
    rows = pick(vectors, vec_id=id_col, v=vector_col).where(F.col("vec_id").isNotNull()).withColumn("v", F.col("v").cast("array<double>")).where(usable(F.col("v")))
    lengths = {r["d"]: r["n"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()}
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    (width, total), = lengths.items()
    rows = one_per_id(rows.where(F.size("v") == width))
    most = max(SAMPLE, 4 * cells_for(total))
    share = min(1.0, most / total)
    draw = (F.xxhash64("vec_id", F.lit("sample")) % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003
    got = sorted(((r["vec_id"], r["v"]) for r in rows.where(draw <= share).limit(2 * most).collect()), key=lambda r: r[0])
    fitted = Quantiser.of_sample(np.array([v for _, v in got], np.float64), total, k)
    first = spark.sparkContext.broadcast(fitted)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            for i in range(0, len(x), 4096):
                cell, codes, off = first.value.index(x[i : i + 4096])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(cell)), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), pa.array([r.tobytes() for r in x[i : i + 4096]], pa.binary())], ["vec_id", "cell", "codes", "off", "x"])

    index = written(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(code, "vec_id long, cell int, codes binary, off float, x binary"), "vector-index")
    fitted = measured(index, fitted, k, every)
    shared = spark.sparkContext.broadcast(fitted)
    sizes = {r["cell"]: r["n"] for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most one number per cell
    shards = max(1, -(-total // SHARD))
    along = np.append(fitted.centre @ fitted.centre.mean(0), -np.inf)  # strays before all others
    homes, start = {}, 0  # neighbouring cells share a shard; a big cell spans several
    for c in sorted(sizes, key=lambda c: (float(along[c]), c)):
        homes[c] = Home(start, -(-sizes[c] // BLOCK), sizes[c])
        start += sizes[c]
    cells = spark.createDataFrame([(c, h.start, h.blocks, h.rows) for c, h in homes.items()], "cell int, first long, of int, n long")

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(batch.num_rows, -1)
            own = [sorted({s for c in cells if c in homes for s in homes[c].shards()}) for cells in shared.value.probed(directions(x)).tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.list_(pa.int64()))], ["vec_id", "x", "shards"])

    asked = written(index.where(F.col("vec_id") % every == 0).select("vec_id", "x").mapInArrow(ask, "vec_id long, x binary, shards array<long>"), "vector-queries")
    load = asked.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    load = F.broadcast(load) if shards <= BROADCAST else load
    queries = asked.select("vec_id", "x", F.explode("shards").alias("shard")).join(load, "shard")
    queries = queries.select("vec_id", "x", "shard", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"))
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("of")).cast("int")
    # a shard is held once for every `QUERIES` queries that ask it, and not at all if none does
    placed = index.join(F.broadcast(cells), "cell").withColumn("block", block).withColumn("shard", shard_of(F.col("first"), F.col("block"), F.col("of"), F.col("n")))
    stored = placed.select("vec_id", "cell", "codes", "off", "x", "block", "shard").join(load, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not left.num_rows or not right.num_rows:
            return pa.table(empty)
        quant: Quantiser = shared.value
        ids, cell, block = (left[c].to_numpy().astype(np.int64) for c in ("vec_id", "cell", "block"))
        x = np.frombuffer(b"".join(left["x"].to_pylist()), np.float64).reshape(len(ids), -1)
        by = smallest_of_equals(x, ids, k + 1)
        by = by[np.lexsort((ids[by], block[by], cell[by]))]
        codes = np.frombuffer(b"".join(left["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)[by]
        off = quant.slack * left["off"].to_numpy()[by]
        x, ids, cell, block = x[by], ids[by], cell[by], block[by]
        qid = right["vec_id"].to_numpy()
        q = np.frombuffer(b"".join(right["x"].to_pylist()), np.float64).reshape(len(qid), -1)
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        edges = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (block[1:] != block[:-1])))
        for i in range(0, len(q), 512):
            part = q[i : i + 512]
            small, unit = directions(part), norms(part) * quant.unit
            tables, probes = quant.tables(small), quant.probed(small)
            base = np.pad(small @ quant.centre.T, ((0, 0), (0, 1)))
            probes_cell = np.zeros(base.shape, bool)
            np.put_along_axis(probes_cell, probes, True, axis=1)
            held, top = [[], [], []], np.full((len(part), k), -np.inf)
            for a, b in zip(edges, np.append(edges[1:], len(ids)), strict=True):
                own = np.flatnonzero(probes_cell[:, cell[a]])
                if len(own):
                    met = top[own]
                    row, near, score = score_block(part[own], qid[i + own], unit[own], ids[a:b], codes[a:b], off[a:b], x[a:b], base[own, cell[a]], tables[own], met)
                    top[own] = met
                    for h, new in zip(held, (own[row] + i, near, score), strict=True):
                        h.append(new)
            if held[0]:
                best_here = best(*(np.concatenate(h) for h in held), k)
                found = [np.concatenate([f, t]) for f, t in zip(found, best_here, strict=True)]
        return pa.table({"query_id": pa.array(qid[found[0]]), "vec_id": pa.array(found[1]), "score": pa.array(found[2])})

    near = stored.groupBy("shard", "part").cogroup(queries.groupBy("shard", "part")).applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
