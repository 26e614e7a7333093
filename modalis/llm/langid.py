"""Language identification by compression.

One raw-content zstandard dictionary a language is built from a bounded sample of labelled training texts;
a text belongs to the language whose dictionary makes it smallest, and is rejected when the margin to the
second is narrow. Long texts are encoded whole, in pieces that each start from the dictionary, so that the
dictionary counts throughout and memory stays bounded.

Bounds (parameters of :func:`train`): ``per_lang`` sampled documents and ``dict_bytes`` of whole texts a
language. Everything else covers all rows.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and rejected; null labels and
null texts teach nothing; a null doc_id is not held out and teaches nothing; with no training rows every text is ``und``; equal sizes go to the language with
the most training rows, then to the first in code-point order; repeated rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_rows, sized, table

UNKNOWN = "und"
PER_LANG, DICT_BYTES = 64, 98_304
#: Sampled ids up to which they are broadcast.
FEW_IDS = 100_000
#: Bytes of one encoded piece, and the share of the best size by which the second must be larger.
PIECE, MARGIN = 16_384, 0.004
#: Matches from four bytes on, found by a lazy search: words and their endings count.
SEARCH = {"window_log": 18, "hash_log": 17, "chain_log": 17, "search_log": 4, "min_match": 4, "target_length": 16, "strategy": zstandard.STRATEGY_LAZY2}
OTHERS = re.compile(r"[\W\d_]+")
#: Ends what is encoded, so that even a word of text makes a compressed block and not a stored one.
TAIL = b"\n" * 64


def letters(text: str) -> bytes:
    """The text's words in lower case: digits, marks and layout say little about a language."""
    return f" {OTHERS.sub(' ', text.lower())} ".encode("utf-8", "surrogatepass")


def has_letter(text: str) -> bool:
    """Whether a character of Unicode's letter categories occurs: neither digits, as ², ½ or Ⅷ, nor marks are letters."""
    return any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(labelled: DataFrame, per_lang: int = PER_LANG, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """A dictionary for each value of ``lang``, from ``labelled`` (doc_id, text, lang), most frequent first.

    Of every language the text with the smallest hash of doc_id (then doc_id and digest) in each of ``per_lang`` classes is taken:
    two aggregates that grow with languages alone, not with rows, and whole texts up to ``dict_bytes``.
    """
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    h = F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid"))
    known = known.withColumn("md5", F.md5(F.col("text").cast("binary")))
    ids = known.groupBy("lang", F.pmod(h, F.lit(per_lang)).alias("c")).agg(F.min(F.struct(h.alias("h"), F.col("doc_id"), F.col("md5"))).alias("m"), F.count("*").alias("n"))
    ids = ids.select("lang", F.col("m.doc_id").alias("doc_id"), F.col("m.md5").alias("md5"), F.col("m.h").alias("h"), F.sum("n").over(Window.partitionBy("lang")).alias("n"))
    # At most per_lang different rows a language, and of each text no more than a dictionary holds.
    languages = labelled.select("lang").distinct().count()
    picked = known.join(F.broadcast(ids) if languages * per_lang <= FEW_IDS else ids, ["lang", "doc_id", "md5"]).select(-F.col("n"), "lang", "h", F.substring("text", 1, dict_bytes).alias("text"))
    kept: dict[str, list[bytes]] = {}
    left: dict[str, int] = {}
    for _, lang, _, text in sorted(picked.distinct().toLocalIterator(), key=tuple):
        data = letters(text)
        room = left.setdefault(lang, dict_bytes)
        if len(data) <= room or lang not in kept:
            kept.setdefault(lang, []).append(data[:room])
            left[lang] -= len(data[:room])
    return {lang: b"".join(parts) for lang, parts in kept.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], margin: float = MARGIN) -> None:
        self.langs = list(dictionaries)
        self.margin = margin
        self.encoders = []
        search = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **SEARCH)
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=search)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=search))

    def sizes(self, text: str) -> list[int]:
        data = letters(text) + TAIL
        pieces = [data] if len(data) <= PIECE else [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return [sum(len(e.compress(p)) for p in pieces) for e in self.encoders]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected."""
        if not text or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        best = min(sizes)
        # Each size is a code length; the softmax of their relative gaps is a score from 1/n to 1.
        score = 1 / sum(math.exp(-100 * (s - best) / best) for s in sizes)
        second = min([s for k, s in enumerate(sizes) if k != sizes.index(best)], default=best * 2)
        return self.langs[sizes.index(best)], score, second - best < self.margin * best


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row. The dictionaries go out with the tasks: at most
    DICT_BYTES a language."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def make():
        c = Classifier(shared.value)
        return lambda doc_id, text: [(doc_id, *c.predict(text))]

    out = map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, lang_pred string, score double, rejected boolean")
    return sized(out, docs.count())


def kept(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """The rows of ``docs`` (columns of documents) whose language is not rejected, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    names = docs.columns
    at = names.index("text")

    def make():
        c = Classifier(shared.value)
        return lambda *row: [] if c.predict(row[at])[2] else [row]

    return map_rows(docs, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(training_rows(docs)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
