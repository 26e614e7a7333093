"""Statistics of matrices and of regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import stats as S
from .base import EMB, long_of, query, r, rows_of, table


@query(f"WITH {EMB} SELECT i, round(avg(v), 6) + 0.0 AS m FROM emb GROUP BY i")
def temporal_mean(spark: SparkSession, d: str) -> DataFrame:
    return rows_of(spark, d).select(F.col("row_id").alias("i"), r(C.temporal_mean("x"), "m"))


@query(f"WITH {EMB} SELECT i, round(var_pop(v), 6) + 0.0 AS s FROM emb GROUP BY i")
def temporal_variance(spark: SparkSession, d: str) -> DataFrame:
    return rows_of(spark, d).select(F.col("row_id").alias("i"), r(C.temporal_variance("x"), "s"))


@query(f"WITH {EMB} SELECT i, j, round(v - avg(v) OVER (PARTITION BY i), 6) + 0.0 AS v FROM emb")
def subtract_mean(spark: SparkSession, d: str) -> DataFrame:
    return rows_of(spark, d).select(F.col("row_id").alias("i"), F.posexplode(C.subtract_mean("x")).alias("j", "v")).select("i", "j", r("v", "v"))


@query(f"WITH {EMB} SELECT i, j, round((v - avg(v) OVER w) / var_pop(v) OVER w, 5) + 0.0 AS v FROM emb WINDOW w AS (PARTITION BY i)")
def norm_variance(spark: SparkSession, d: str) -> DataFrame:
    return rows_of(spark, d).select(F.col("row_id").alias("i"), F.posexplode(C.norm_variance("x")).alias("j", "v")).select("i", "j", r("v", "v", 5))


START = 8


@query(f"WITH {EMB} SELECT i, round(sum(v), 6) + 0.0 AS s FROM emb WHERE j >= {START} GROUP BY i")
def vector_sum(spark: SparkSession, d: str) -> DataFrame:
    return rows_of(spark, d).select(F.col("row_id").alias("i"), r(C.vector_sum("x", START), "s"))


@query(f"WITH {EMB} SELECT i, round(sqrt(sum(v * v)), 6) + 0.0 AS s FROM emb WHERE j >= {START} GROUP BY i")
def vector_norm(spark: SparkSession, d: str) -> DataFrame:
    return rows_of(spark, d).select(F.col("row_id").alias("i"), r(C.vector_norm("x", START), "s"))


@query(f"WITH {EMB} SELECT i, round(avg(v), 6) + 0.0 AS s FROM emb WHERE j >= {START} GROUP BY i")
def vector_mean(spark: SparkSession, d: str) -> DataFrame:
    return rows_of(spark, d).select(F.col("row_id").alias("i"), r(C.vector_mean("x", START), "s"))


PAIRS = f"{EMB}, p AS (SELECT i, j, v AS a, 0.9 * v + 0.01 * (j % 3) AS b FROM emb)"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Entries beside a distorted copy of theirs, joined by place."""
    a = long_of(spark, d)
    return S.paired(a, a.withColumn("v", 0.9 * F.col("v") + 0.01 * (F.col("j") % 3)))


@query(f"WITH {PAIRS} SELECT round(sqrt(sum((a - b) * (a - b)) / sum(a * a)), 6) + 0.0 AS v FROM p")
def rmse_rel(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).agg(r(S.rmse(), "v"))


@query(f"WITH {PAIRS} SELECT round(sqrt(avg((a - b) * (a - b))), 6) + 0.0 AS v FROM p")
def rmse_abs(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).agg(r(S.rmse(False), "v"))


@query(f"WITH {PAIRS} SELECT round(avg(abs(a - b)), 6) + 0.0 AS v FROM p")
def mae(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).agg(r(S.mae(), "v"))


@query(f"WITH {PAIRS} SELECT round(1 - sum((a - b) * (a - b)) / (count(*) * var_pop(a)), 6) + 0.0 AS v FROM p")
def r2(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).agg(r(S.r2(), "v"))


@query(f"WITH {PAIRS} SELECT i, round(sum((a - b) * (a - b)) / sum(b * b), 6) + 0.0 AS mre FROM p GROUP BY i")
def mre_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.mre_array(pairs(spark, d), 1).select("i", r("mre", "mre"))


@query(f"WITH {PAIRS} SELECT j, round(sum((a - b) * (a - b)) / sum(b * b), 6) + 0.0 AS mre FROM p GROUP BY j")
def mre_cols(spark: SparkSession, d: str) -> DataFrame:
    return S.mre_array(pairs(spark, d), 0).select("j", r("mre", "mre"))


@query(f"WITH {PAIRS} SELECT round(1 - sum((a - b) * (a - b)) / sum(a * a), 6) + 0.0 AS v FROM p")
def energy(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).agg(r(S.energy(), "v"))


@query("""
    WITH t AS (SELECT l_extendedprice / 1000 AS y, 1.4 * l_quantity + 0.5 AS p FROM lineitem), e AS (SELECT y, p, y - p AS d FROM t)
    SELECT round(avg(d * d), 5) + 0.0 AS mse, round(sqrt(avg(d * d)), 5) + 0.0 AS rmse, round(avg(abs(d)), 5) + 0.0 AS mae,
           round(avg(abs(d / (p + 1e-4))) * 100, 5) + 0.0 AS mre, round(quantile_cont(abs(d), 0.95), 5) + 0.0 AS ae_95,
           round(quantile_cont(abs(d), 0.99), 5) + 0.0 AS ae_99, round(1 - sum(d * d) / (count(*) * var_pop(y)), 5) + 0.0 AS r2,
           round(sqrt(sum(d * d) / sum(p * p)), 5) + 0.0 AS l2_error FROM e
""")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), (1.4 * F.col("l_quantity") + 0.5).alias("p"))
    m = S.regression_metrics(t)
    return m.select(*(r(c, c, 5) for c in m.columns))


@query("""
    WITH s AS (SELECT l_quantity AS q, CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS dd, l_tax AS t FROM lineitem)
    SELECT 'l_discount' AS field, min(dd) AS low, max(dd) AS high, round(avg(dd), 6) + 0.0 AS mean FROM s
    UNION ALL SELECT 'l_quantity', min(q), max(q), round(avg(q), 6) + 0.0 FROM s UNION ALL SELECT 'l_tax', min(t), max(t), round(avg(t), 6) + 0.0 FROM s
""")
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    """Discounts of 0 stand for NaN here."""
    t = table(spark, d, "lineitem").withColumn("l_discount", F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")))
    return S.summary(t, ["l_quantity", "l_discount", "l_tax"]).select("field", "low", "high", r("mean", "mean"))


@query(f"""
    WITH {PAIRS}
    SELECT i, round(1 - sum((a - b) * (a - b)) / sum(a * a), 6) + 0.0 AS energy, round(2 * avg(a) * avg(b) / (avg(a) * avg(a) + avg(b) * avg(b)), 5) + 0.0 AS mean_similarity,
           round(2 * stddev_samp(a) * stddev_samp(b) / (var_samp(a) + var_samp(b)), 6) + 0.0 AS std_similarity FROM p GROUP BY i
""")
def reconstruction_similarity(spark: SparkSession, d: str) -> DataFrame:
    m = S.similarity(pairs(spark, d), ["i"])
    return m.select("i", r("energy", "energy"), r("mean_similarity", "mean_similarity", 5), r("std_similarity", "std_similarity"))


@query(f"""
    WITH {EMB}, w AS (SELECT i, max(CASE WHEN j = 0 THEN v END) AS z0, max(CASE WHEN j = 1 THEN v END) AS z1, max(CASE WHEN j = 2 THEN v END) AS z2 FROM emb GROUP BY i)
    SELECT round(corr(z0, z1), 6) + 0.0 AS c01, round(corr(z0, z2), 6) + 0.0 AS c02, round(corr(z1, z2), 6) + 0.0 AS c12,
           round(100 * (1 + 2 * corr(z0, z1) * corr(z0, z2) * corr(z1, z2) - corr(z0, z1) ** 2 - corr(z0, z2) ** 2 - corr(z1, z2) ** 2), 4) + 0.0 AS det FROM w
""")
def latent_correlation(spark: SparkSession, d: str) -> DataFrame:
    z = [F.element_at("x", k) for k in (1, 2, 3)]
    c = rows_of(spark, d).agg(F.corr(z[0], z[1]).alias("a"), F.corr(z[0], z[2]).alias("b"), F.corr(z[1], z[2]).alias("c"))
    det = 100 * (1 + 2 * F.col("a") * F.col("b") * F.col("c") - F.col("a") ** 2 - F.col("b") ** 2 - F.col("c") ** 2)
    return c.select(r("a", "c01"), r("b", "c02"), r("c", "c12"), r(det, "det", 4))


@query("""
    WITH e AS (SELECT user_id, max(value) AS best, count(*) AS n FROM events GROUP BY user_id)
    SELECT count(*) AS n, round(quantile_cont(best, 0.5), 6) + 0.0 AS median, round(quantile_cont(best, 0.75) - quantile_cont(best, 0.25), 6) + 0.0 AS iqr,
           round(avg(best), 6) + 0.0 AS mean, round(stddev_pop(best), 6) + 0.0 AS std FROM e WHERE n > 20
""")
def rl_summary(spark: SparkSession, d: str) -> DataFrame:
    """A user stands for an episode that converges after more than 20 events."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("best"), (F.count("*") > 20).alias("converged"))
    m = S.episode_summary(e)
    return m.select("n", *(r(c, c) for c in m.columns[1:]))


@query("""
    SELECT event_type AS name, count(*) AS n, round(sum(value), 4) + 0.0 AS total, min(value) AS low, max(value) AS high FROM events GROUP BY event_type
""")
def channel_report(spark: SparkSession, d: str) -> DataFrame:
    """Counters by channel: calls, total, least and most."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"), r(F.sum("value"), "total", 4), F.min("value").alias("low"), F.max("value").alias("high"))
