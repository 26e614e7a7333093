"""Windows, spectra, delay embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import signal as G
from .base import EMB, long_of, query, r, rows_of, table


@query(f"WITH {EMB} SELECT i, j, round((0.54 - 0.46 * cos(2 * pi() * j / 63)) * v, 7) + 0.0 AS v FROM emb")
def hammwin(spark: SparkSession, d: str) -> DataFrame:
    """Every vector under the window."""
    return long_of(spark, d).select("i", "j", r(C.hamming("j", 64) * F.col("v"), "v", 7))


def series(spark: SparkSession, d: str) -> DataFrame:
    return long_of(spark, d).select(F.col("i").alias("s"), F.col("j").alias("pos"), "v")


SERIES = f"{EMB}, s AS (SELECT i AS s, j AS pos, v FROM emb), k AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS k)"


@query(f"""
    WITH {SERIES}
    SELECT s, k, round(k / (0.5 * 64), 6) + 0.0 AS f, round((sum(v * cos(2 * pi() * k * pos / 64)) ** 2 + sum(v * sin(2 * pi() * k * pos / 64)) ** 2) / 64, 6) + 0.0 AS psd FROM s CROSS JOIN k GROUP BY s, k
""")
def fft_psd_equi(spark: SparkSession, d: str) -> DataFrame:
    return G.power_spectrum(series(spark, d), 64, 0.0, 0.5, 31.5).select("s", "k", r("f", "f"), r("psd", "psd"))


@query(f"""
    WITH {SERIES}
    SELECT s, k, round((k - 31.5) / 31.5, 6) + 0.0 AS f,
           round((sum(v * cos(2 * pi() * (k - 32) * (pos / 64 - 0.5))) ** 2 + sum(v * sin(2 * pi() * (k - 32) * (pos / 64 - 0.5))) ** 2) / 64, 6) + 0.0 AS psd FROM s CROSS JOIN k GROUP BY s, k
""")
def fft_psd_shifted(spark: SparkSession, d: str) -> DataFrame:
    return G.power_spectrum(series(spark, d), 64, 0.0, 0.5, 31.5, False).select("s", "k", r("f", "f"), r("psd", "psd"))


@query(f"""
    WITH {EMB}, k AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS k)
    SELECT i, k, round((sum(v * cos(2 * pi() * k * j / 64)) ** 2 + sum(v * sin(2 * pi() * k * j / 64)) ** 2) / 64, 6) + 0.0 AS psd FROM emb CROSS JOIN k GROUP BY i, k
""")
def fft_rows(spark: SparkSession, d: str) -> DataFrame:
    """All rows by fast transforms in their tasks."""
    return G.row_spectra(rows_of(spark, d), 0.5).select(F.col("row_id").alias("i"), F.posexplode("x").alias("k", "psd")).select("i", "k", r("psd", "psd"))


DELAY = f"WITH {EMB}, k AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS d) SELECT i AS s, j AS pos, k.d, coalesce(CASE k.d WHEN 4 THEN v WHEN 3 THEN lag(v, 1) OVER w WHEN 2 THEN lag(v, 2) OVER w WHEN 1 THEN lag(v, 3) OVER w ELSE lag(v, 4) OVER w END, 0.0) AS v FROM emb CROSS JOIN k WINDOW w AS (PARTITION BY i, k.d ORDER BY j)"


@query(DELAY)
def time_delay_embedding(spark: SparkSession, d: str) -> DataFrame:
    s = long_of(spark, d).select(F.col("i").alias("s"), F.col("j").alias("pos"), "v")
    return G.delay_embedding(s, 5)


@query(DELAY)
def time_delay_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same from array rows, without a shuffle."""
    e = G.delay_rows(rows_of(spark, d), 5).select(F.col("row_id").alias("s"), F.posexplode("x").alias("pos", "e"))
    return e.select("s", "pos", F.posexplode("e").alias("d", "v"))


@query(f"""
    WITH {EMB}, b AS (SELECT CAST(unnest(range(7)) AS INTEGER) AS block)
    SELECT i AS s, block, CAST(j - block * 8 AS INTEGER) AS pos, v FROM emb JOIN b ON j >= block * 8 AND j < block * 8 + 16
""")
def welch_blocks(spark: SparkSession, d: str) -> DataFrame:
    s = long_of(spark, d).select(F.col("i").alias("s"), F.col("j").alias("pos"), "v")
    return G.welch_blocks(s, 64, 16, 8)


@query("""
    WITH c AS (SELECT CAST(floor((epoch(ts) - (SELECT min(epoch(date_trunc('hour', ts))) FROM events)) / 3600) AS INTEGER) AS pos, count(*) AS n FROM events GROUP BY 1)
    SELECT pos, CAST(coalesce(n, 0) AS DOUBLE) AS v FROM (SELECT CAST(unnest(range(720)) AS INTEGER) AS pos) LEFT JOIN c USING (pos)
""")
def hourly_series(spark: SparkSession, d: str) -> DataFrame:
    """Counts by hour with holes filled by 0."""
    e = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").cast("double").alias("v"))
    start = e.agg(F.min(F.unix_timestamp("hour")).alias("s")).first()["s"]
    return G.fill_series(e, start, 720)
