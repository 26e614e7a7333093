"""Best-fit packing with a swap-based local search.

Texts are tokenised with a public vocabulary, cut into pieces of at most ``capacity`` ids (only documents
that are longer are cut) and packed into as few sequences as can be. Pieces of full length are sequences of
their own. Each task packs the other pieces that hash to it: best fit in decreasing order, then a local
search that empties the lightest bins by moving a document to a fuller bin or exchanging one for one, one
for two or two for one with it; every step raises the sum of squared fills. The pieces of bins that stay
underfull are packed once more over fewer tasks, so that tasks leave next to nothing open.

Defined cases: null and empty texts are one piece with the end id alone; repeated rows are packed one by
one; an empty table gives an empty result; other columns are ignored; texts of any length are whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, map_rows, sized, table

CAPACITY, VOCABULARY = 2048, "word_bpe_49k.json"
#: Pieces that a task packs, about; share of the capacity below which a bin is packed again; sources that
#: may fail in a row before the search ends.
PIECES_A_TASK, UNDERFULL, FAILURES = 8192, 0.97, 24
#: Words whose ids a worker keeps at a time: a bound on memory, not on what is tokenised.
CACHE = 200_000


class Words(dict):
    """Ids of single words as little-endian unsigned 32-bit bytes, made on first use by the vocabulary's merges."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.model = tokenizer.model
        self.bytes = {k: tokenizer.pre_tokenizer.pre_tokenize_str(chr(k))[0][0] for k in range(256) if tokenizer.pre_tokenizer.pre_tokenize_str(chr(k))}

    def __missing__(self, word: str) -> bytes:
        ids = np.array([t.id for t in self.model.tokenize(word.translate(self.bytes))], "<u4").tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[word] = ids
        return ids


#: How the vocabulary splits lower-cased Latin-1 text; words are encoded on their own.
LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^ \t-\r\x85\xa00-9a-zªµºß-öø-ÿ²³¹¼-¾]+")


class Encoder:
    """Ids of texts by one of the public vocabularies, equal to the tokenizer's own.

    Texts in Latin-1 are split here and looked up word by word; others, and those that may hold special
    tokens, go through the tokenizer whole.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.words = Words(self.tokenizer) if vocabulary == VOCABULARY else None

    def __call__(self, text: str) -> bytes:
        if self.words is not None and "<|" not in text:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return b"".join(map(self.words.__getitem__, LATIN.findall(text.lower())))
        text = text.encode("utf-8", "replace").decode()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(4)
def encoder(vocabulary: str) -> Encoder:
    """One encoder a worker process: its tasks share the words."""
    return Encoder(vocabulary)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest first, each into the open bin that it leaves least room in."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        if room > n:
            by_room.setdefault(room - n, []).append(k)
            rooms |= 1 << room - n
    return bins


def exchange(source: list[int], target: list[int], room: int) -> tuple[list[int], list[int]] | None:
    """Lengths to give from ``source`` and to take from ``target`` that fill at most ``room``, the most
    that one of the steps can."""
    best, step = 0, None
    for a, p in enumerate(source):
        if best < p <= room:
            best, step = p, ([p], [])
        for b, q in enumerate(target):
            if best < p - q <= room:
                best, step = p - q, ([p], [q])
            for r in target[b + 1 :]:
                if best < p - q - r <= room:
                    best, step = p - q - r, ([p], [q, r])
            for s in source[a + 1 :]:
                if best < p + s - q <= room:
                    best, step = p + s - q, ([p, s], [q])
        if best == room:
            break
    return step


def local_search(bins: list[list[int]], capacity: int, failures: int = FAILURES) -> list[list[int]]:
    """Bins of lengths after moves and exchanges out of the lightest bins; stops at the lower bound."""
    bins = [sorted(b, reverse=True) for b in bins]
    fills = [sum(b) for b in bins]
    least = -(-sum(fills) // capacity)
    live, failed = len(bins), 0
    order = sorted((k for k in range(len(bins)) if fills[k] < capacity), key=lambda k: fills[k])
    for source in order:
        if live <= least or failed >= failures:
            break
        moved = True
        while bins[source] and moved:
            moved = False
            for target in sorted((k for k in order if k != source and fills[source] <= fills[k] < capacity and bins[k]), key=lambda k: fills[k]):
                room = capacity - fills[target]
                if not (step := exchange(bins[source], bins[target], room)):
                    continue
                give, take = step
                gain = sum(give) - sum(take)
                for n in give:
                    bins[source].remove(n)
                for n in take:
                    bins[target].remove(n)
                bins[source] = sorted(bins[source] + take, reverse=True)
                bins[target] = sorted(bins[target] + give, reverse=True)
                fills[source] -= gain
                fills[target] += gain
                moved = True
                if not bins[source]:
                    break
        failed = 0 if not bins[source] else failed + 1
        live -= not bins[source]
    return [b for b in bins if b]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item."""
    bins = [[int(lengths[i]) for i in b] for b in best_fit(lengths, capacity)]
    if len(bins) > -(-int(lengths.sum()) // capacity):
        bins = local_search(bins, capacity)
    items: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable")[::-1].tolist():
        items.setdefault(int(lengths[i]), []).append(i)
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, b in enumerate(bins):
        at = 0
        for n in b:
            i = items[n].pop()
            number[i], offset[i] = k, at
            at += n
    return number, offset


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces_of(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every row, in no sequence yet."""

    def make():
        encode = encoder(vocabulary)

        def each(doc_id, text):
            ids = encode(text or "") + b"\0\0\0\0"
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                yield doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), None, None

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, PIECES)


def pack_tasks(pieces: DataFrame, tasks: int, first: int, capacity: int) -> DataFrame:
    """Pack what each of ``tasks`` partitions gets. Sequence numbers are ``first`` and up, apart by partition; bins
    that stay underfull are told by ``fill``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if got:
            f = pd.concat(got).sort_values(["doc_id", "piece", "ids_crc32"], ignore_index=True)
            number, f["offset"] = pack(f["length"].to_numpy(np.int64), capacity)
            f["fill"] = np.bincount(number, f["length"])[number].astype(np.int64)
            f["sequence_id"] = number + (first + (int(f["part"][0]) << 32))
            yield f.drop(columns="part")

    # A task may run several partitions: the partition's own number tells them apart.
    dealt = pieces.repartition(tasks, "doc_id", "piece", "ids_crc32").withColumn("part", F.spark_partition_id())
    return dealt.mapInPandas(run, PIECES + ", fill long")


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    rows = docs.count()
    pieces = cut(pieces_of(docs, vocabulary, capacity))
    whole = F.col("length") == capacity
    full = pieces.filter(whole).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = pieces.filter(~whole)
    n = rest.count()
    tasks = max(1, n // PIECES_A_TASK)
    once = cut(pack_tasks(rest, tasks, 0, capacity))
    if tasks == 1:
        return sized(full.unionByName(once.drop("fill")), rows)
    low = F.col("fill") < UNDERFULL * capacity
    again = pack_tasks(once.filter(low).drop("fill"), max(1, tasks // 32), 1 << 56, capacity)
    return sized(full.unionByName(once.filter(~low).drop("fill")).unionByName(again.drop("fill")), rows)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
