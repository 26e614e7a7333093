"""Personal data: fixed patterns, and terms that give protected entities away, with DataFrame operations alone.

The base kinds (email, ip, card, phone) are leftmost non-overlapping matches of fixed patterns, each kind on
its own. Every distinct value found is a protected entity. Terms (words of at least ``LETTERS`` letters) of the
documents that hold an entity are weighed by what they tell about it, over all documents:

    disclosure(t, e) = PMI(t, e) / IC(e) = log2(N df(t, e) / (df(t) df(e))) / log2(N / df(e))

df counts documents, df(t, e) those that hold both. It is 1 where t is seen with e alone. From ``SUPPORT``
joint documents on, a term at or above ``REMOVE`` is removed and one at or above ``GENERALISE`` is generalised,
wherever it stands in a document with that entity. Documents without an entity stay as they are.

Defined cases: null texts are empty and have no spans; offsets are code points, end exclusive; repeated rows
get equal spans and count once in df; an empty table gives an empty result; other columns are ignored;
texts are searched whole, with patterns that neither recurse nor backtrack over long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, sized, table

LETTERS, SUPPORT, GENERALISE, REMOVE = 4, 2, 0.8, 0.95
#: Terms up to which they are broadcast to count documents; beyond, a join by key does it.
FEW_TERMS = 200_000

# Fixed patterns. Possessive loops and the look-behinds only spare Java's matcher retries: a match of the
# plain pattern starts where a run of its first class starts, or where the last match ended.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for its pattern to be tried.
GATES = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": lambda t: t.contains("+")}
TERM = rf"(?<![\p{{L}}\p{{N}}@._%+-])\p{{L}}{{{LETTERS},}}+(?![\p{{N}}@_%+-]|\.[\p{{L}}\p{{N}}])"
TERM_KINDS = ("generalised", "removed")
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalised": "[TERM]", "removed": ""}
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the check."""
    n = F.length(d)

    def weighed(k: Column) -> Column:
        x = F.substring(d, n - k + 1, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, k: s + weighed(k)) % 10 == 0


def holds(kind: str, v: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(v, r"\."), lambda p: (F.length(part(p)) < 3) | (F.length(part(p)) == 3) & (part(p) <= "255"))
    if kind == "card":
        d = digits(v)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(digits(v)).between(8, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, kind: str, shift: Column | int = 0) -> Column:
    """Spans of every match: the lengths of matches and of the gaps between them add up to offsets."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("got"))

    def add(s: Column, x: Column) -> Column:
        a = s["at"] + F.length(x["gap"])
        b = a + F.length(x["hit"])
        return F.struct(b.alias("at"), F.concat(s["got"], F.array(F.struct(F.lit(kind).alias("kind"), (a + shift).cast("int").alias("start"), (b + shift).cast("int").alias("end"), x["hit"].alias("value")))).alias("got"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, start, add, lambda s: s["got"])


def base_spans(text: Column) -> Column:
    def of(kind: str) -> Column:
        kept = F.filter(matches(text, PATTERNS[kind], kind), lambda s: holds(kind, s["value"]))
        return F.when(GATES[kind](text), kept).otherwise(F.array().cast(SPAN))

    return F.concat(*map(of, KINDS))


def number_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def canonical(kind: Column, value: Column) -> Column:
    return F.when(kind == "email", F.lower(value)).when(kind == "ip", value).otherwise(digits(value))


def found(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, ``columns``, text (null: empty), base, key of every row. Rows with equal doc_id and text have equal keys;
    rows without personal data have none."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns, F.coalesce("text", F.lit("")).alias("text"))
    return d.withColumn("base", base_spans(F.col("text"))).withColumn("key", F.when(F.size("base") > 0, row_key()))


def row_key() -> Column:
    """Of rows with doc_id and text; equal for equal rows alone."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))).cast("binary"))


def repeats(docs: DataFrame) -> DataFrame:
    """key, more: the rows that occur again, and how often again."""
    return cut(docs.groupBy(row_key().alias("key")).agg((F.count("*") - 1).alias("more")).filter("more > 0"))


def terms_of(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def places(texts: DataFrame) -> DataFrame:
    """key, term, start, end: every term of each text. Offsets are running sums over a text's rows, not an array that grows."""
    hits = F.regexp_extract_all(F.col("text"), F.lit(TERM), F.lit(0))
    gaps = F.transform(F.split("text", TERM, -1), F.length)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    p = texts.select("key", F.posexplode(pairs).alias("pos", "p")).select("key", "pos", F.col("p.gap").alias("gap"), F.length("p.hit").alias("n"), F.lower("p.hit").alias("term"))
    so_far = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(so_far).cast("int"))
    return p.select("key", "term", (F.col("end") - F.col("n")).alias("start"), "end")


def terms_in(docs: DataFrame, terms: DataFrame, few: bool, weight: Column) -> DataFrame:
    """term, c: ``weight`` summed over the rows of ``docs`` that hold each of ``terms``."""
    every = docs.select(F.explode(terms_of(F.coalesce(F.col("text"), F.lit("")))).alias("term"), weight.alias("w"))
    if few:
        every = every.join(F.broadcast(terms), "term", "left_semi")
    return every.groupBy("term").agg(F.sum("w").alias("c"))


def disclosing(docs: DataFrame, held: DataFrame, n: int, support: int = SUPPORT) -> DataFrame:
    """key, term, disclosure: for each row with entities the terms that tell enough about one of them, and the most that
    each tells, from counts over all of ``docs`` (``n`` rows); rows that repeat count once. ``held``: key, text, base of the rows with entities. Only
    what cannot reach ``GENERALISE`` is left out before pairs are made: entities and terms in fewer than ``support``
    documents, and terms too frequent for an entity."""
    held = held.dropDuplicates(["key"])
    entities = held.select("key", F.explode("base").alias("s")).select("key", F.concat_ws(":", "s.kind", canonical(F.col("s.kind"), F.col("s.value"))).alias("entity")).distinct()
    again = repeats(docs)
    surplus = again.agg(F.sum("more")).first()[0] or 0
    size = F.lit(float(max(2, n - surplus)))
    df_e = entities.groupBy("entity").agg(F.count("*").alias("df_e")).filter(F.col("df_e") >= support)
    # df(t, e) <= df(e), so a pair at GENERALISE has df(t) <= most.
    most = size * F.pow(F.least(F.col("df_e"), size / 2) / size, F.lit(GENERALISE)) * (1 + 1e-9)
    e = cut(entities.join(df_e, "entity").withColumn("most", most), n)
    words = held.join(e.select("key").distinct(), "key", "left_semi").select("key", F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    terms = cut(words.groupBy("term").agg(F.count("*").alias("c")).filter(F.col("c") >= support).select("term"), n)
    few = terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS
    top = e.agg(F.max("most").alias("top")).first()["top"] or 0.0
    df_t = terms_in(docs, terms, few, F.lit(1)).withColumnRenamed("c", "df_t")
    if surplus:
        # What repeated rows count beyond once is taken off again: one row of each says its terms.
        one = docs.select(row_key().alias("key"), "text").join(again, "key").dropDuplicates(["key"])
        df_t = df_t.join(terms_in(one, terms, few, F.col("more")), "term", "left").select("term", (F.col("df_t") - F.coalesce("c", F.lit(0))).alias("df_t"))
    rare = cut(df_t.filter(F.col("df_t") <= top).join(terms, "term"), n)
    rare = words.join(F.broadcast(rare) if few else rare, "term")
    joint = e.join(rare, "key").filter(F.col("df_t") <= F.col("most"))
    pairs = joint.groupBy("entity", "term", "df_t", "df_e").agg(F.count("*").alias("df_te")).filter(F.col("df_te") >= support)
    information = F.log2(size / F.least(F.col("df_e"), size / 2))
    told = pairs.select("entity", "term", (F.log2(size * F.col("df_te") / (F.greatest("df_t", "df_te") * F.col("df_e"))) / information).alias("disclosure"))
    told = told.filter(F.col("disclosure") >= GENERALISE)
    # A row takes part with the pairs that it holds, not with all terms that tell about its entities.
    return joint.select("key", "entity", "term").join(told, ["entity", "term"]).groupBy("key", "term").agg(F.max("disclosure").alias("disclosure"))


def term_spans(docs: DataFrame, held: DataFrame, n: int) -> DataFrame:
    """key, terms: spans of the terms to generalise or remove, in order, of rows that have any."""
    marked = cut(disclosing(docs, held, n), n)
    texts = held.join(marked.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    spans = places(texts).join(marked, ["key", "term"])
    span = F.struct(F.when(F.col("disclosure") >= REMOVE, TERM_KINDS[1]).otherwise(TERM_KINDS[0]).alias("kind"), F.col("start"), F.col("end"), F.col("term").alias("value"))
    return spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", span.alias("s")))).alias("x")).select("key", F.col("x.s").alias("terms"))


def spell(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, key, base, terms of every row. One pass over texts finds the base spans and keeps the texts of rows that
    have some; a second one counts the terms of those in all rows."""
    n = docs.count()
    kept = cut(found(docs).withColumn("text", F.when(F.col("key").isNotNull(), F.col("text"))))
    hit = kept.filter("key is not null")
    near = term_spans(docs, hit, n)
    none = F.array().cast(SPAN)
    clear = kept.filter("key is null").select("doc_id", "key", "base", none.alias("terms"))
    return sized(clear.unionByName(hit.select("doc_id", "key", "base").join(near, "key", "left").withColumn("terms", F.coalesce("terms", none))), n)


def op10_disclosure_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_data(table(spark, sf_dir, "documents"))
    counts = [number_of(k).alias(f"n_{k}") for k in KINDS]
    every = F.concat_ws(",", F.when(F.size("base") > 0, spell(F.col("base"))), F.when(F.size("terms") > 0, spell(F.col("terms"))))
    return rows.select("doc_id", *counts, F.sha2(spell(F.col("base")).cast("binary"), 256).alias("base_sha256"), every.alias("spans"), F.size("terms").cast("long").alias("n_terms"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind's mark; overlapping spans go together."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    mark = F.create_map(*(F.lit(x) for kv in MARKS.items() for x in kv))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        more = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), mark[x["kind"]])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(fresh, more).otherwise(s["out"]).alias("out"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.aggregate(ordered, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` (columns of documents) with every span replaced; rows without personal data are untouched."""
    n = docs.count()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
    hit = cut(found(d, "lang", "source").filter("key is not null"))
    near = term_spans(d, hit, n)
    text = replaced(F.col("text"), F.concat("base", F.coalesce("terms", F.array().cast(SPAN))))
    hit = hit.join(near, "key", "left").withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    clear = d.filter(F.size(base_spans(F.coalesce("text", F.lit("")))) == 0)
    return clear.unionByName(hit.select(*clear.columns))
