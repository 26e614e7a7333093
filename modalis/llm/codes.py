"""Vector codes: product quantisation by Lloyd's rounds that rescan only what may have changed.

Components become whole numbers, vectors are cut into PARTS parts, and each part position has a codebook of ENTRIES
entries. A task keeps its vectors in blocks. In a block each position has a heap for each entry, of the parts assigned to
it, keyed by their slack: the distance to the second-nearest entry less that to their own (a lower less an upper bound as
soon as entries move), plus the entry's cumulative drift at that time. A round adds to an entry's drift how far it
moved and how far any other one did at most; a part whose key is above it is still nearest to its entry. So a
round looks at the tops of the heaps, pops the parts that drift has overtaken, compares those with all entries exactly, and
pushes them back. Only parts that changed their entry take part in the sums, which are kept from round to round.

Sums are of whole numbers, and the least of equal distances is the lower index, so results do not hang on partitions.
Blocks are written to the checkpoint folder after each round; codebooks (PARTS x ENTRIES x width / PARTS numbers) are all that the
driver holds.

Defined cases: vectors that are null or hold a null or non-finite component go; repeated rows and ids are coded one
by one (equal ids are ordered by their vectors, null ids last); with fewer rows than ENTRIES there are as many entries as
rows; null labels are one label; an empty table gives an empty result; other columns are ignored. Vectors of several lengths,
or of one that PARTS does not divide, and components from 2**19 on are refused.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ddl, few, sized, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block, components from which on nothing is exact, and what roundings of a bound may come to at most.
BLOCK, LARGEST, SLIP = 4096, 1 << 29, 1e-5
#: Tasks that share a label's rows, where labels are too many to be broadcast.
SALTS = 64
STATE = "ids array<long>, labels array<int>, vectors binary, entries binary, keys binary, rows binary, moved array<struct<position:int,entry:int,n:long,s:array<long>>>, scanned long"
MOVED = pa.struct({"position": pa.int32(), "entry": pa.int32(), "n": pa.int64(), "s": pa.list_(pa.int64())})
ARROW = pa.schema({"ids": pa.list_(pa.int64()), "labels": pa.list_(pa.int32()), "vectors": pa.binary(), "entries": pa.binary(), "keys": pa.binary(), "rows": pa.binary(), "moved": pa.list_(MOVED), "scanned": pa.int64()})


@dataclass
class Books:
    """Entries (position, entry, component), and the cumulative drift of each."""

    entries: np.ndarray
    drift: np.ndarray

    def moved_to(self, entries: np.ndarray) -> Books:
        step = np.sqrt(((entries - self.entries).astype(float) ** 2).sum(axis=2))
        others = np.zeros_like(step)
        if step.shape[1] > 1:
            top = np.sort(step, axis=1)[:, -2:]
            # The farthest move of any other entry.
            others = np.where(np.arange(step.shape[1]) == step.argmax(axis=1)[:, None], top[:, :1], top[:, 1:])
        return Books(entries, self.drift + step + others)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of whole numbers, exactly: in floating point where all of its sums are whole, else in integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if x.shape[1] * 4 * most * most < 1 << 53:
        a, b = x.astype(float), entries.astype(float)
        return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each part, its squared distance, and the slack to the second-nearest."""
    d = squares(x, entries)
    best, at = d.argmin(axis=1), np.arange(len(d))
    own = d[at, best]
    if d.shape[1] == 1:
        return best, own, np.full(len(d), np.inf)
    d = d.astype(float)
    d[at, best] = np.inf
    return best, own, np.sqrt(d.min(axis=1)) - np.sqrt(own.astype(float))


class Heaps:
    """The heaps of one part position of a block, one after another in flat arrays, each in heap order."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> None:
        self.keys, self.rows, self.ends = keys, rows, np.cumsum(sizes)
        self.heaps: dict[int, list[tuple[float, int]]] = {}

    def heap(self, entry: int) -> list[tuple[float, int]]:
        if entry not in self.heaps:
            span = slice(self.ends[entry - 1] if entry else 0, self.ends[entry])
            self.heaps[entry] = list(zip(self.keys[span].tolist(), self.rows[span].tolist(), strict=True))
        return self.heaps[entry]

    def pop(self, drift: np.ndarray) -> np.ndarray:
        """Rows whose keys are not above their entry's drift; heaps whose top is above it are not looked into."""
        starts = np.concatenate([[0], self.ends[:-1]])
        some = np.flatnonzero(self.ends > starts)
        out = []
        for entry in some[self.keys[starts[some]] <= drift[some] + SLIP].tolist():
            heap, limit = self.heap(entry), drift[entry] + SLIP
            while heap and heap[0][0] <= limit:
                out.append(heapq.heappop(heap)[1])
        return np.array(sorted(out), np.int64)

    def push(self, entries: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
        for entry, key, row in zip(entries.tolist(), keys.tolist(), rows.tolist(), strict=True):
            heapq.heappush(self.heap(entry), (key, row))

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        keys, rows = [], []
        for entry in range(len(self.ends)):
            if entry in self.heaps:
                keys.append(np.array([k for k, _ in self.heaps[entry]], float))
                rows.append(np.array([r for _, r in self.heaps[entry]], np.int32))
            else:
                span = slice(self.ends[entry - 1] if entry else 0, self.ends[entry])
                keys.append(self.keys[span])
                rows.append(self.rows[span])
        return np.concatenate(keys), np.concatenate(rows)


def whole(values: np.ndarray) -> np.ndarray:
    q = np.floor(values.astype(float) * SCALE)
    if len(q) and np.abs(q).max() >= LARGEST:
        raise ValueError("components from 2**19 on are refused")
    return q.astype(np.int32)


def moves(position: int, before: np.ndarray | None, after: np.ndarray, x: np.ndarray) -> list[dict]:
    """What changes of an entry's number and sum of parts (``before``: None for parts that had no entry)."""
    out: dict[int, list] = {}
    for entries, sign in ((before, -1), (after, 1)):
        if entries is not None and len(entries):
            order = np.argsort(entries, kind="stable")
            names, starts, counts = np.unique(entries[order], return_index=True, return_counts=True)
            for e, n, s in zip(names.tolist(), counts.tolist(), np.add.reduceat(x[order].astype(np.int64), starts, axis=0), strict=True):
                old = out.setdefault(e, [0, np.zeros(x.shape[1], np.int64)])
                out[e] = [old[0] + sign * n, old[1] + sign * s]
    return [{"position": position, "entry": e, "n": n, "s": s.tolist()} for e, (n, s) in sorted(out.items())]


def assigned(block: dict, books: Books) -> dict:
    """A block after an assignment: all parts of a fresh block are compared with all entries, of another one those popped."""
    n = len(block["ids"])
    width = books.entries.shape[2]
    x = np.frombuffer(block["vectors"], np.int32).reshape(n, PARTS, width).astype(np.int64)
    fresh = block["entries"] is None
    entries = np.zeros((PARTS, n), np.int32) if fresh else np.frombuffer(block["entries"], np.int32).reshape(PARTS, n).copy()
    keys, rows = ((np.zeros((PARTS, n)), np.zeros((PARTS, n), np.int32)) if fresh else (np.frombuffer(block["keys"]).reshape(PARTS, n).copy(), np.frombuffer(block["rows"], np.int32).reshape(PARTS, n).copy()))
    moved, scanned = [], 0
    for p in range(PARTS):
        k = books.entries.shape[1]
        sizes = np.zeros(k, np.int64) if fresh else np.bincount(entries[p], minlength=k)
        heaps = Heaps(keys[p][: sizes.sum()], rows[p][: sizes.sum()], sizes)
        some = np.arange(n) if fresh else heaps.pop(books.drift[p])
        if not len(some):
            continue
        best, _, slack = nearest(x[some, p], books.entries[p])
        other = some if fresh else some[best != entries[p][some]]
        after = best if fresh else best[best != entries[p][some]]
        moved += moves(p, None if fresh else entries[p][other], after, x[other, p])
        entries[p][some] = best
        heaps.push(best, slack + books.drift[p][best], some)
        keys[p], rows[p] = heaps.flat()
        scanned += len(some)
    return block | {"entries": entries.tobytes(), "keys": keys.tobytes(), "rows": rows.tobytes(), "moved": moved, "scanned": scanned}


def blocks_of(kept: DataFrame) -> DataFrame:
    """Blocks of a task's vectors (vec_id, label, embedding), in which nothing is assigned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                q = whole(part.column(2).flatten().to_numpy(zero_copy_only=False))
                yield batch([{"ids": part.column(0).to_pylist(), "labels": part.column(1).to_pylist(), "vectors": q.tobytes(), "entries": None, "keys": None, "rows": None, "moved": [], "scanned": 0}])

    return kept.mapInArrow(run, ddl(STATE))


def batch(blocks: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(blocks, schema=ARROW)


def each_block(df: DataFrame, f: Callable[[dict], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield f(b.slice(k, 1).to_pylist()[0])

    return df.mapInArrow(run, ddl(schema))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding (doubles) of the rows that are coded."""
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return d.filter(F.col("embedding").isNotNull() & good)


def updated(state: DataFrame, counts: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and sums of parts by position and entry, with what a round moved: one aggregate, of which the driver gets
    a row for each entry at most."""
    width = sums.shape[2]
    m = state.select(F.explode("moved").alias("m")).groupBy("m.position", "m.entry").agg(F.sum("m.n").alias("n"), *(F.sum(F.col("m.s")[j]).alias(f"s{j}") for j in range(width)))
    counts, sums = counts.copy(), sums.copy()
    for r in m.collect():
        counts[r[0], r[1]] += r[2]
        sums[r[0], r[1]] += np.array(r[3:], np.int64)
    return counts, sums


def lloyd(kept: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, Books, list[int]]:
    """Blocks with the final entries, the final codebooks, and how many parts each assignment compared with all entries.
    ``kept``: the rows of ``usable``, at least one."""
    widths = kept.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if widths[0] != widths[1] or not widths[0] or widths[0] % PARTS:
        raise ValueError(f"vectors need one length, which {PARTS} divides, and not {widths[0]} to {widths[1]}")
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(entries).collect()
    start = np.stack([whole(np.array(r[0])) for r in first]).astype(np.int64)
    width = widths[0] // PARTS
    books = Books(start.reshape(len(first), PARTS, width).transpose(1, 0, 2), np.zeros((PARTS, len(first))))
    counts, sums = np.zeros((PARTS, len(first)), np.int64), np.zeros((PARTS, len(first), width), np.int64)
    state, scanned = blocks_of(kept), []
    for r in range(rounds + 1):
        shared = kept.sparkSession.sparkContext.broadcast(books)
        state = cut(each_block(state, lambda b, shared=shared: batch([assigned(b, shared.value)]), STATE))
        scanned.append(state.agg(F.sum("scanned")).first()[0] or 0)
        if r < rounds:
            counts, sums = updated(state, counts, sums)
            used = counts[:, :, None]
            books = books.moved_to(np.where(used > 0, sums // np.maximum(used, 1), books.entries))
    return state, books, scanned


CODES = "vec_id long, label int, code string, error long"


def coded(state: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, code, error of each vector of the blocks."""
    shared = state.sparkSession.sparkContext.broadcast(books.entries)

    def rows(b: dict) -> pa.RecordBatch:
        n, book = len(b["ids"]), shared.value
        x = np.frombuffer(b["vectors"], np.int32).reshape(n, PARTS, -1).astype(np.int64)
        entries = np.frombuffer(b["entries"], np.int32).reshape(PARTS, n)
        error = sum(((x[:, p] - book[p][entries[p]]) ** 2).sum(axis=1) for p in range(PARTS))
        code = ["".join(f"{e:02x}" for e in four) for four in entries.T.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(b["ids"], pa.int64()), pa.array(b["labels"], pa.int32()), pa.array(code), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return each_block(state, rows, CODES)


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row that is coded."""
    kept = usable(vectors)
    n = kept.count()
    if not n:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    state, books, _ = lloyd(kept)
    rows = coded(state, books)
    sums = cut(rows.groupBy("label").agg(F.sum("error").alias("label_error")), n)
    shared = few(sums)
    if shared is sums:
        # A label may hold a third of all rows: its sum goes to as many tasks as share its rows.
        salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
        rows, shared = rows.withColumn("salt", salt), sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    else:
        rows, shared = rows.withColumn("salt", F.lit(0)), F.broadcast(sums.withColumn("salt", F.lit(0)))
    shared = shared.withColumnsRenamed({"label": "of", "salt": "its"})
    out = rows.join(shared, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("its")))
    return sized(out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")), n)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))
