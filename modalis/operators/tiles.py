"""Products of all columns or blocks with all others, by tiles that one task works on at a time.

A matrix is cut into pieces, each piece is sent to the tiles that need it, and a task goes through a tile's pieces in order and
adds up what they give; what comes out of a tile is reduced before it leaves the task. So nothing of the size of columns x
columns exists anywhere, a task holds one tile and two pieces, and what is shuffled is the matrix as often as there are
blocks of columns (``nearest``; not at all for one block), the vectors as often as there are blocks of them
(``nearest_vectors``), or each factor as often as the other one has blocks (``matmul``).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.matrix import of_width, width
from . import linalg as L

#: Columns of a block, rows of a piece at most, and bytes of pieces that a tile's task reads, about.
BLOCK, ROWS, TILE_BYTES = 512, 256, 2**26

#: Vectors of a block at most, blocks at least (of ROWS vectors or more), and pairs whose differences are held at a time.
VECTORS, LEAST_BLOCKS, PAIRS = 16_384, 8, 32_768


def in_order(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of rows that follow each other and have the first ``keys`` values in common. A group is what one step needs."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, group in itertools.groupby(rows, key=lambda r: r[:keys]):
        yield key, [r[keys:] for r in group]


# --- nearest columns -------------------------------------------------------------------------------------


def pieces(rows: DataFrame, block: int) -> DataFrame:
    """chunk, block, x: some rows' entries in the columns of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x = L.block(b.slice(at, ROWS))
                starts = range(0, x.shape[1], block)
                data = [np.ascontiguousarray(x[:, s : s + block]).tobytes() for s in starts]
                yield pa.RecordBatch.from_arrays([pa.array([task + n] * len(data)), pa.array(range(len(data)), pa.int32()), pa.array(data, pa.binary())], names=["chunk", "block", "x"])
                n += 1

    return rows.select("x").mapInArrow(run, "chunk bigint, block int, x binary")


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of columns, from differences and not from products, which would cancel."""
    return np.stack([((a - b[:, k : k + 1]) ** 2).sum(axis=0) for k in range(b.shape[1])], axis=1)


def nearest(rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """i, near (of d, j; the nearest first, ties by index): the ``k`` nearest other columns of each column. A task adds up
    some rows' share of a tile, and what several tasks have of one is added up by slices. Columns of one block need no tile
    of rows sent to them: each task adds up what it has."""
    n = width(rows)
    blocks = -(-n // block)
    if not n:
        return rows.sparkSession.createDataFrame([], NEAREST)
    step = max(1, L.SLICE // min(n, block))  # rows of a tile in a slice

    def slices(at: tuple[int, int], total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for first in range(0, len(total), step):
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (*at, first)] + [pa.array([total[first : first + step].tobytes()], pa.binary())], names=["lo", "hi", "first", "x"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x = L.block(b.slice(at, ROWS))
                g = gaps(x, x)
                total = g if total is None else np.add(total, g, out=total)
        if total is not None:
            yield from slices((0, 0), total)

    def tiled(batches: Iterator[pa.RecordBatch], out: Callable[[tuple[int, int], np.ndarray], Iterable[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for (lo, hi, _, _), two in in_order(batches, 4):
            if (lo, hi) != at:
                if at is not None:
                    yield from out(at, total)
                at, total = (lo, hi), np.zeros((min(block, n - lo * block), min(block, n - hi * block)))
            a, b = (np.frombuffer(x).reshape(-1, w) for (_, x), w in zip((two[0], two[-1]), total.shape, strict=True))
            total += gaps(a, b)
        if at is not None:
            yield from out(at, total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for key, group in in_order(batches, 3):
            for (x,) in group:
                some = np.frombuffer(x).reshape(-1, min(block, n - key[1] * block))
                if key == at:
                    total += some
                    continue
                if at is not None:
                    yield from found(at, total)
                at, total = key, some.copy()
        if at is not None:
            yield from found(at, total)

    def found(at: tuple[int, ...], d: np.ndarray) -> Iterable[pa.RecordBatch]:
        """Each column's nearest ones among those of the other block that a slice of a tile has."""
        lo, hi, first = *at[:2], at[2] if len(at) > 2 else 0
        if lo == hi:
            d[np.arange(len(d)), first + np.arange(len(d))] = np.inf
        for table, mine, theirs in ((d, lo * block + first, hi * block), (d.T, hi * block, lo * block + first))[: 1 if lo == hi else 2]:
            few = min(k, table.shape[1] - (lo == hi))
            if few > 0:
                order = np.argsort(table, axis=1, kind="stable")[:, :few]
                yield near_batch(np.arange(mine, mine + len(order)), np.sqrt(np.take_along_axis(table, order, axis=1)), theirs + order)

    partial = "lo int, hi int, first int, x binary"
    if blocks == 1:
        tasks, shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.select("x").mapInArrow(own, partial)
    else:
        p = cut(pieces(rows, block))
        # Rows that a tile's task reads: about TILE_BYTES of two blocks.
        shared = max(1, -(-p.filter("block = 0").count() * 2 * ROWS * block * 8 // TILE_BYTES))
        sent = p.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(shared)).cast("int"))
        sent = sent.select(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "part", "chunk", "block", "x")
        tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), shared * blocks * (blocks + 1) // 8)
        dealt = sent.repartition(tasks, "lo", "hi", "part").sortWithinPartitions("lo", "hi", "part", "chunk", "block")
        if shared == 1:
            return merged(dealt.mapInArrow(lambda batches: tiled(batches, found), NEAREST), k)
        shares = dealt.mapInArrow(lambda batches: tiled(batches, slices), partial)
    return merged(shares.repartition(tasks, "lo", "hi", "first").sortWithinPartitions("lo", "hi", "first").mapInArrow(added, NEAREST), k)


def merged(some: DataFrame, k: int) -> DataFrame:
    return some.groupBy("i").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def near_batch(i: np.ndarray, d: np.ndarray, j: np.ndarray, sizes: np.ndarray | None = None) -> pa.RecordBatch:
    """Neighbours of ``i``, all as many or ``sizes`` of them."""
    ends = np.concatenate([[0], np.cumsum(np.full(len(i), d.shape[1]) if sizes is None else sizes)]).astype(np.int32)
    both = pa.StructArray.from_arrays([pa.array(d.ravel()), pa.array(j.ravel().astype(np.int64))], fields=list(NEAR.value_type))
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), both)], names=["i", "near"])


NEAR = pa.list_(pa.struct([("d", pa.float64()), ("j", pa.int64())]))
NEAREST = "i bigint, near array<struct<d:double,j:bigint>>"


# --- nearest vectors -------------------------------------------------------------------------------------


class Nearest:
    """The nearest so far of some vectors, by distance and number."""

    def __init__(self, n: int, k: int):
        self.k, self.s, self.j, self.limit = k, np.full((n, k), np.nan), np.full((n, k), np.iinfo(np.int64).max), np.full(n, np.inf)

    def take(self, at: np.ndarray, s: np.ndarray, j: np.ndarray) -> None:
        """Pairs with exact squared distances."""
        mine, place = np.unique(at, return_inverse=True)
        owner = np.concatenate([np.repeat(np.arange(len(mine)), self.k), place])
        s, j = np.concatenate([self.s[mine].ravel(), s]), np.concatenate([self.j[mine].ravel(), j])
        order = np.lexsort((j, np.sqrt(s), owner))
        best = order[np.searchsorted(owner[order], np.arange(len(mine)))[:, None] + np.arange(self.k)]
        self.s[mine], self.j[mine] = s[best], j[best]
        last = self.s[mine, -1] * (1 + 1e-15)
        self.limit[mine] = np.where(np.isnan(last), np.inf, last)  # no number is NaN: fewer than k so far, or real ones

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        held = self.j != np.iinfo(np.int64).max
        some = held.any(axis=1)
        return near_batch(ids[some], np.sqrt(self.s[held]), self.j[held], held[some].sum(axis=1))


def exact_squares(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of columns i of ``a`` and j of ``b``, from differences."""
    return np.concatenate([((a[:, i[at : at + PAIRS]] - b[:, j[at : at + PAIRS]]) ** 2).sum(axis=0) for at in range(0, len(i), PAIRS)] or [np.zeros(0)])


def compare(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray] | None, k: int) -> list[Nearest]:
    """Nearest ones of vectors ``a`` (numbers, columns) among ``b`` and of ``b`` among ``a``; without ``b`` among themselves.
    Products tell which pairs can be near, within a bound of their rounding; those are taken by differences."""
    (ia, x), (ib, y) = a, b or a
    sides = [Nearest(len(ia), k)] + ([Nearest(len(ib), k)] if b else [])
    xx, yy = (x * x).sum(axis=0), (y * y).sum(axis=0)
    rounding = 8 * (len(x) + 8) * np.finfo(float).eps
    with np.errstate(invalid="ignore", over="ignore"):
        for r in range(0, len(ia), ROWS * 4):
            for c in range(0, len(ib), ROWS * 8):
                p, q = xx[r : r + ROWS * 4], yy[c : c + ROWS * 8]
                d = x[:, r : r + len(p)].T @ y[:, c : c + len(q)]
                d *= -2
                d += p[:, None]
                d += q
                if not (np.isfinite(p).all() and np.isfinite(q).all()):
                    d[~np.isfinite(d)] = -np.inf  # to be seen by their differences
                if not b:
                    own = np.arange(max(r, c), min(r + len(p), c + len(q)))
                    d[own - r, own - c] = np.nan
                for axis, side in enumerate(sides):
                    mine = slice(r, r + len(p)) if not axis else slice(c, c + len(q))
                    off = rounding * ((p + q.max()) if not axis else (q + p.max()))
                    limit, size = side.limit[mine], d.shape[1 - axis] - (not b)
                    if size >= k and np.isinf(limit).any():
                        least = np.partition(d, k - 1, axis=1 - axis)
                        limit = np.fmin(limit, (least[:, k - 1] if not axis else least[k - 1]) + off)
                    limit = np.where(np.isfinite(off), limit + off, np.inf)
                    i, j = np.nonzero(d <= (limit[:, None] if not axis else limit))
                    if len(i):
                        s = exact_squares(x, y, r + i, c + j)
                        side.take(*((r + i, s, ib[c + j]) if not axis else (c + j, s, ia[r + i])))
    return sides


def nearest_vectors(vectors: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """i, near as of ``nearest``, for vectors as rows: i (numbers from 0, without gaps) and x. Blocks of vectors meet in tiles,
    two in a task at a time: vectors go out as often as there are blocks, of at most VECTORS each."""
    session = vectors.sparkSession
    top = vectors.agg(F.max("i")).first()[0]
    if top is None:
        return session.createDataFrame([], NEAREST)
    n = top + 1
    block = block or min(VECTORS, max(ROWS, -(-n // LEAST_BLOCKS)))
    blocks = -(-n // block)
    kind = np.float32 if dict(vectors.dtypes)["x"] == "array<float>" else np.float64

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), L.block(b).astype(kind)
            for g in np.unique(ids // block):
                at = ids // block == g
                yield pa.RecordBatch.from_arrays([pa.array([int(g)], pa.int32()), pa.array([ids[at].tobytes()], pa.binary()), pa.array([x[at].tobytes()], pa.binary())], names=["block", "ids", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lo, hi), parts in in_order(batches, 2):
            two = []
            for g in (lo, hi)[: 1 if lo == hi else 2]:
                ids = np.concatenate([np.frombuffer(p[1], np.int64) for p in parts if p[0] == g] or [np.zeros(0, np.int64)])
                x = np.concatenate([np.frombuffer(p[2], kind).reshape(len(p[1]) // 8, -1) for p in parts if p[0] == g] or [np.zeros((0, 0))])
                order = np.argsort(ids)
                two.append((ids[order], np.ascontiguousarray(x[order].T, dtype=np.float64)))
            for (ids, _), side in zip(two, compare(two[0], two[1] if lo != hi else None, k), strict=True):
                yield side.batch(ids)

    p = cut(vectors.select("i", "x").mapInArrow(packed, "block int, ids binary, x binary"))
    sent = p.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.select(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "ids", "x")
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), blocks * (blocks + 1) // 2)
    return merged(sent.repartition(tasks, "lo", "hi").sortWithinPartitions("lo", "hi").mapInArrow(run, NEAREST), k)


# --- products --------------------------------------------------------------------------------------------


def matmul(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """A B of two large dense factors as rows: entry k of a row of A goes with the row of B whose row_id is k (absent ones
    are 0). Rows of A are dealt into groups of ``block``, so are B's columns and the inner index; a tile of the result
    takes its pieces in order of the inner index and multiplies them by BLAS. Each row of A goes out once for each block of
    B's columns, each row of B once for each group of A's rows."""
    inner, columns = width(a), width(b)
    rows = a.agg(F.min("row_id"), F.max("row_id")).first()
    if not inner or not columns or rows[0] is None:
        return of_width(a.select("row_id", F.array().cast("array<double>").alias("x")).limit(0), columns)
    across, deep, first = -(-columns // block), -(-inner // block), rows[0] // block
    down = rows[1] // block - first + 1
    part = lambda x, k: F.slice(x, (k * block + 1).cast("int"), block)
    left = a.select(F.floor(F.col("row_id") / block).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("j"), "row_id", "x")
    left = left.select("i", "j", F.explode(F.sequence(F.lit(0), F.lit(deep - 1))).alias("k"), F.lit(0).alias("side"), "row_id", "x").withColumn("x", part("x", F.col("k")))
    right = b.filter((F.col("row_id") >= 0) & (F.col("row_id") < inner)).select(F.explode(F.sequence(F.lit(first), F.lit(first + down - 1))).alias("i"), "row_id", "x")
    right = right.select("i", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("j"), F.floor(F.col("row_id") / block).cast("int").alias("k"), F.lit(1).alias("side"), "row_id", "x").withColumn("x", part("x", F.col("j")))
    sent = left.unionByName(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, total = None, None, None
        for (i, j, k), group in in_order(batches, 3):
            if (i, j) != at:
                if at is not None:
                    yield out(at, ids, total)
                at, ids, total = (i, j), sorted({r for side, r, _ in group if not side}), None
                place = {r: q for q, r in enumerate(ids)}
                total = np.zeros((len(ids), min(block, columns - j * block)))
            x, y = np.zeros((len(ids), min(block, inner - k * block))), np.zeros((min(block, inner - k * block), total.shape[1]))
            for side, r, values in group:
                if side:
                    y[r - k * block] = values
                else:
                    x[place[r]] = values
            total += x @ y
        if at is not None:
            yield out(at, ids, total)

    def out(at: tuple[int, int], ids: list[int], total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([at[1]] * len(ids), pa.int32()), L.list_array(total)], names=["row_id", "j", "x"])

    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), across * down // 4)
    tiles = sent.repartition(tasks, "i", "j").sortWithinPartitions("i", "j", "k", "side").mapInArrow(run, "row_id bigint, j int, x array<double>")
    whole = tiles.groupBy("row_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"])).alias("x"))
    return of_width(whole, columns)
