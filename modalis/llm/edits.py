"""Document fingerprints by a randomised edit embedding.

A text is read by random walks: at step j a walk shows the character it stands on and, by a bit that is
shared by all texts and depends on j and the character, moves on or stays. What it shows is the embedding: it
maps edit distance to Hamming distance, since two walks that an insertion or deletion set apart meet
again. One walk reads the first half from the start and one the second half from the end, so that edits set apart
only the walk of their own half. A fingerprint samples the embedding at fixed random steps, at two scales, the text's
own and twice that, so that texts of like lengths share a scale. Likeness is the share of equal samples.

Texts that share a band, a few samples that follow each other, are candidates, and a bit-parallel edit distance verifies
each. ``edited_fingerprints`` puts every text and its edited and next one through both steps; ``links`` joins all
documents: distinct texts are dealt by band, long bands into blocks and pairs of blocks into tasks.

Defined cases: null texts are empty; equal texts are alike (1) and at distance 0, empty ones too; likeness is 0
where scales are more than one step apart, and such texts share no band; documents are in order of doc_id, null
first, then text; the only row is its own next one; repeated rows follow each other; an empty table gives an empty
result; other columns are ignored. Texts are walked whole, in stretches, whatever their length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_rows, sized, stream_rows, table

#: Samples at a scale (half of them of either walk), characters of which a sample tells, and the least scale.
SAMPLES, GRAM, LEAST = 96, 2, 64
#: Shared walks: classes of characters, steps after which the bits repeat, characters of a stretch.
CLASSES, PERIOD, STRETCH, SEED = 16, 65_536, 16_384, 9_241
#: Rows of one range of doc_id, about, and ranges at most.
RANGE_ROWS, RANGES = 2_000, 65_536
#: Bands of a scale (fewer and so longer ones suit more texts), the edits that may lie between linked texts, as a share of the longer one, and texts of a
#: block of a band.
BANDS, EDITS_SHARE, BLOCK = 32, 0.05, 256


@lru_cache(1)
def walks() -> list[list[int]]:
    """For each class and step, the step at which the walk stands on the next character."""
    rng = np.random.default_rng(SEED)
    steps = PERIOD + 4 * STRETCH
    out = []
    shared = list(range(steps + PERIOD + 2))  # equal numbers are one object
    for _ in range(CLASSES):
        bits = rng.integers(0, 2, PERIOD)
        bits[-1] = 1
        moves = np.flatnonzero(np.tile(bits, steps // PERIOD + 2))
        nxt = moves[np.searchsorted(moves, np.arange(steps))] + 1
        out.append([shared[x] for x in nxt.tolist()])
    return out


def classes(codes: np.ndarray) -> bytes:
    return ((codes * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint8).tobytes()


def walk(codes: np.ndarray) -> np.ndarray:
    """The step at which each character is first shown, and the step after the last."""
    table_ = walks()
    parts = []
    t = 0
    for at in range(0, len(codes), STRETCH):
        base = t - t % PERIOD
        now, out = t - base, []
        show = out.append
        stretch = classes(codes[at : at + STRETCH])
        try:
            for c in stretch:
                show(now)
                now = table_[c][now]
        except IndexError:  # far slower than two steps a character: wrap at each step
            out.clear()
            base, now = 0, t
            for c in stretch:
                show(now)
                now += table_[c][now % PERIOD] - now % PERIOD
        parts.append(np.array(out, np.int64) + base)
        t = now + base
    return np.concatenate([*parts, [t]]).astype(np.int64)


@lru_cache(64)
def sample_steps(scale: int) -> np.ndarray:
    return np.sort(np.random.default_rng(scale).integers(0, scale, SAMPLES // 2))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def samples(codes: np.ndarray, steps: np.ndarray, scale: int) -> np.ndarray:
    """One byte a sample, from the characters shown at and after it; 0 past the end."""
    at = sample_steps(scale)
    i = np.searchsorted(steps, at, "right") - 1
    padded = np.concatenate([codes, np.zeros(GRAM, codes.dtype)]).astype(np.uint64)
    h = np.zeros(len(at), np.uint64)
    inside = at < steps[-1]
    i = np.where(inside, i, 0)
    for k in range(GRAM):
        h = (h ^ padded[i + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.where(inside, (h % np.uint64(255)).astype(np.uint8) + 1, 0).astype(np.uint8)


Print = tuple[int, bytes, bytes]


def halves(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first half, the longer one, and the second one from its end."""
    h = (len(codes) + 1) // 2
    return codes[:h], codes[h:][::-1]


def fingerprint(codes: np.ndarray, ahead: np.ndarray | None = None) -> Print:
    """``ahead``: the walk over the first half, if it is known."""
    first, second = halves(codes)
    ahead, back = walk(first) if ahead is None else ahead, walk(second)
    scale = LEAST
    while scale < len(codes):
        scale *= 2
    return scale, *(samples(first, ahead, s).tobytes() + samples(second, back, s).tobytes() for s in (scale, 2 * scale))


def spelt(p: Print) -> str:
    return f"{p[0].bit_length() - 1}." + base64.b64encode(p[1]).decode() + "." + base64.b64encode(p[2]).decode()


def read(text: str) -> Print:
    power, a, b = text.split(".")
    return 1 << int(power), base64.b64decode(a), base64.b64decode(b)


def likeness(a: Print, b: Print) -> float:
    if a[0] == b[0]:
        x, y = a[1], b[1]
    elif a[0] == 2 * b[0]:
        x, y = a[1], b[2]
    elif b[0] == 2 * a[0]:
        x, y = a[2], b[1]
    else:
        return 0.0
    u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    either = int(((u > 0) | (v > 0)).sum())
    return int(((u == v) & (u > 0)).sum()) / either if either else 1.0


def share_band(a: Print, b: Print, bands: int = BANDS) -> bool:
    """Whether two fingerprints agree in all samples of a band."""
    if a[0] == b[0]:
        x, y = a[1], b[1]
    elif a[0] == 2 * b[0]:
        x, y = a[1], b[2]
    elif b[0] == 2 * a[0]:
        x, y = a[2], b[1]
    else:
        return False
    u, v = banded(x, bands), banded(y, bands)
    return bool(((u == v).all(axis=1) & (u > 0).any(axis=1)).any())


def banded(samples_: bytes, bands: int) -> np.ndarray:
    """A band's samples a row: bands are of one walk each where they divide its samples."""
    size = SAMPLES // bands
    return np.frombuffer(samples_, np.uint8)[: bands * size].reshape(bands, size)


def verified(a: Print, b: Print, text: str, other: str, share: float = EDITS_SHARE) -> tuple[bool, int | None]:
    """Whether two texts are candidates, and the edit distance of candidates if it is at most ``share`` of the longer
    one: equal ones are candidates at distance 0."""
    if text == other:
        return True, 0
    if not share_band(a, b):
        return False, None
    most = int(share * max(len(text), len(other)))
    n = edit_distance(text, other, most)
    return True, n if n <= most else None


def in_order(docs: DataFrame) -> DataFrame:
    """range, tail, doc_id, text: tasks hold ranges of doc_id in order, and at the end of each range, as
    its tail, the row that follows it: the first of the next one, or after the last range of the first."""
    low = F.lit(-(1 << 63))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.coalesce("doc_id", low))
    n = d.count()
    ranges = max(1, min(RANGES, n // RANGE_ROWS))
    cuts = d.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("q")).first()["q"] if ranges > 1 else None
    splits = [-float("inf"), *sorted({float(x) for x in cuts or []}), float("inf")]
    if len(splits) > 2:
        d = Bucketizer(splits=splits, inputCol="v", outputCol="range").transform(d.withColumn("v", F.col("k").cast("double"))).drop("v").withColumn("range", F.col("range").cast("int"))
    else:
        d = d.withColumn("range", F.lit(0))
    firsts = sorted((r["range"], r["k"]) for r in d.groupBy("range").agg(F.min("k").alias("k")).collect())  # at most RANGES rows
    before = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    tails = docs.sparkSession.createDataFrame(before or [(0, 0)], "k long, before int")
    both = F.when(F.col("before").isNull(), F.array(F.struct("range", F.lit(0).alias("tail")))).otherwise(F.array(F.struct("range", F.lit(0).alias("tail")), F.struct(F.col("before").alias("range"), F.lit(1).alias("tail"))))
    d = d.join(F.broadcast(tails), "k", "left").select("doc_id", "k", "text", F.explode(both).alias("p")).select("p.range", "p.tail", "k", "doc_id", "text")
    return d.repartition("range").sortWithinPartitions("range", "tail", "k", "text").drop("k")


def edit_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    kept = None
    for part, tail, doc_id, text in rows:
        codes = codes_of(text)
        ahead = walk(halves(codes)[0])
        mine = (part, doc_id, text, codes, ahead, fingerprint(codes, ahead))
        if kept is not None and kept[0] == part:
            yield edited_row(*kept[1:], text, codes, mine[5])
        kept = None if tail else mine


def edited_row(doc_id, text, codes, ahead, own: Print, next_text, next_codes, following: Print) -> tuple:
    n = len(codes)
    half = n // 2
    at = n - half
    other = np.concatenate([codes[:at], next_codes[:half]])
    # The edited text's first half is a part of this text's: so is its walk.
    edited = fingerprint(other, ahead[: (len(other) + 1) // 2 + 1])
    other_text = text[:at] + next_text[:half]
    digest = hashlib.sha256(other_text.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, n, digest, spelt(own), spelt(edited), likeness(own, edited), likeness(own, following), *verified(own, edited, text, other_text), *verified(own, following, text, next_text)


EDITS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "band_edited boolean, edits_edited long, band_next boolean, edits_next long"
)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    return sized(stream_rows(in_order(docs), edit_rows, EDITS), docs.count())


def fingerprints(docs: DataFrame) -> DataFrame:
    def make():
        def each(doc_id, text):
            yield doc_id, spelt(fingerprint(codes_of(text or "")))

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, fingerprint string")


def edit_distance(a: str, b: str, most: int) -> int:
    """The edit distance, or ``most`` + 1 if it is larger. A column of the dynamic programme is two whole numbers of a
    bit a character (where it rises and where it falls), and a step over a character of ``b`` is a few operations on
    them. Now and then the places that ``most`` edits can reach are looked at: if all are beyond, it ends."""
    if len(a) > len(b):
        a, b = b, a
    far = most + 1
    if len(b) - len(a) > most:
        return far
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    k = len(a)
    while k and a[k - 1] == b[k - 1 - len(a) + len(b)]:
        k -= 1
    a, b = a[:k], b[: k - len(a) + len(b)]
    m = len(a)
    if not m:
        return len(b)
    places: dict[str, bytearray] = {}
    for i, c in enumerate(a):
        if c not in places:
            places[c] = bytearray((m + 7) // 8)
        places[c][i >> 3] |= 1 << (i & 7)
    equal = {c: int.from_bytes(x, "little") for c, x in places.items()}
    every = (1 << m) - 1
    rises, falls, end = every, 0, m
    look = max(64, most)
    for j, c in enumerate(b, 1):
        e = equal.get(c, 0)
        level = (((e & rises) + rises) ^ rises) | e
        up, down = falls | every & ~(level | rises), rises & level
        end += (up >> m - 1 & 1) - (down >> m - 1 & 1)
        up, down = up << 1 | 1, down << 1
        kept = e | falls
        rises, falls = (down | ~(kept | up)) & every, up & kept & every
        if j % look == 0 and least_near(rises, falls, j, most, m) > most:
            return far
    return min(end, far)


def least_near(rises: int, falls: int, j: int, most: int, m: int) -> int:
    """The least entry of the j-th column among rows j - most .. j + most."""
    low, high = max(0, j - most), min(m, j + most)
    if low > high:
        return most + 1
    first = j + (rises & (1 << low) - 1).bit_count() - (falls & (1 << low) - 1).bit_count()
    n = high - low
    if not n:
        return first
    bits = [np.unpackbits(np.frombuffer((x >> low & (1 << n) - 1).to_bytes((n + 7) // 8, "little"), np.uint8), count=n, bitorder="little") for x in (rises, falls)]
    return first + min(0, int(np.cumsum(bits[0].astype(np.int64) - bits[1]).min()))


def links(docs: DataFrame, share: float = EDITS_SHARE, bands: int = BANDS) -> DataFrame:
    """doc_id, with, distance: distinct texts that share a band and whose edit distance is at most ``share`` of the
    longer one, each named by its least doc_id, and at distance 0 the other documents of a text with that one. Rows
    are told apart by doc_id and text; a null doc_id stands for a text that has no other."""

    def make():
        def each(t, text):
            scale, a, b = fingerprint(codes_of(text))
            for s, p in ((scale, a), (2 * scale, b)):
                for k, band in enumerate(banded(p, bands)):
                    if band.any():
                        yield t, len(text), f"{s}:{k}:{band.tobytes().hex()}"

        return each

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(text.cast("binary")).alias("t"))
    d = rows.select("t", "text").dropDuplicates(["t"])
    least = cut(rows.groupBy("t").agg(F.min("doc_id").alias("with")))
    copies = rows.select("doc_id", "t").distinct().join(least, "t").filter(~F.col("doc_id").eqNullSafe(F.col("with"))).select("doc_id", "with", F.lit(0).cast("long").alias("distance"))

    entries = cut(map_rows(d, make, "t string, size long, band string"))
    shared = entries.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = entries.join(shared, "band").withColumn("part", F.pmod(F.xxhash64("t"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = cut(dealt.select("band", "t", "size", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")))
    x, y = (dealt.select("band", "lo", "hi", *(F.col(c).alias(f"{c}_{s}") for c in ("t", "size", "part"))) for s in "xy")
    once = (F.col("lo") == F.col("hi")) | (F.col("part_x") != F.col("part_y"))
    near = F.abs(F.col("size_x") - F.col("size_y")) <= share * F.greatest("size_x", "size_y")
    pairs = x.join(y, ["band", "lo", "hi"]).filter((F.col("t_x") < F.col("t_y")) & once & near).select("t_x", "t_y").distinct()
    texts = pairs.join(d.withColumnsRenamed({"t": "t_x"}), "t_x").join(d.withColumnsRenamed({"t": "t_y", "text": "other"}), "t_y").select("t_x", "t_y", "text", "other")

    def verify():
        def each(a, b, text, other):
            most = int(share * max(len(text), len(other)))
            if (n := edit_distance(text, other, most)) <= most:
                yield a, b, n

        return each

    found = map_rows(texts, verify, "t_x string, t_y string, distance long")
    found = found.join(least.select(F.col("t").alias("t_x"), F.col("with").alias("a")), "t_x").join(least.select(F.col("t").alias("t_y"), F.col("with").alias("b")), "t_y")
    low = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.least("a", "b"))
    return found.select(F.greatest("a", "b").alias("doc_id"), low.alias("with"), "distance").unionByName(copies)


def op7_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
