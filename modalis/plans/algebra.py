"""Linear algebra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import matrix as M
from ..operators import linalg as L
from ..operators import tiles
from .base import EMB, STATUS, entries, long_of, query, r, rows_of, status_rows, table, vectors_as_columns


@query(f"WITH {EMB} SELECT CAST(j AS BIGINT) AS i, CAST(i AS INTEGER) AS j, v FROM emb")
def transpose(spark: SparkSession, d: str) -> DataFrame:
    return L.transpose(long_of(spark, d))


#: A small factor with whole entries.
WEIGHTS = np.array([[(7 * j + 3 * k) % 5 - 2 for k in range(4)] for j in range(64)], float)


@query(f"""
    WITH {EMB}, w AS (SELECT a.j, b.k, CAST((7 * a.j + 3 * b.k) % 5 - 2 AS DOUBLE) AS w FROM (SELECT CAST(unnest(range(64)) AS INTEGER) AS j) a CROSS JOIN (SELECT CAST(unnest(range(4)) AS INTEGER) AS k) b)
    SELECT i, k AS j, round(sum(v * w), 6) + 0.0 AS v FROM emb JOIN w USING (j) GROUP BY i, k
""")
def matmul(spark: SparkSession, d: str) -> DataFrame:
    """Relational: a join on the inner index."""
    w = L.as_table(rows_of(spark, d), WEIGHTS)
    return L.matmul(long_of(spark, d), w).select("i", "j", r("v", "v"))


@query(f"""
    WITH {EMB}, w AS (SELECT a.j, b.k, CAST((7 * a.j + 3 * b.k) % 5 - 2 AS DOUBLE) AS w FROM (SELECT CAST(unnest(range(64)) AS INTEGER) AS j) a CROSS JOIN (SELECT CAST(unnest(range(4)) AS INTEGER) AS k) b)
    SELECT i, k AS j, round(sum(v * w), 6) + 0.0 AS v FROM emb JOIN w USING (j) GROUP BY i, k
""")
def matmul_dense(spark: SparkSession, d: str) -> DataFrame:
    """The same by blocks of rows, without a shuffle."""
    return L.times(rows_of(spark, d), WEIGHTS).select(F.col("row_id").alias("i"), F.posexplode("x").alias("j", "v")).select("i", "j", r("v", "v"))


@query(f"WITH {EMB} SELECT CAST(a.j AS BIGINT) AS i, b.j, round(sum(a.v * b.v), 5) + 0.0 AS v FROM emb a JOIN emb b USING (i) GROUP BY a.j, b.j")
def matmulp(spark: SparkSession, d: str) -> DataFrame:
    """X'X, added up over tasks."""
    rows = rows_of(spark, d)
    return L.as_table(rows, L.gram(rows)).select("i", "j", r("v", "v", 5))


@query(f"WITH {EMB} SELECT CAST(a.j AS BIGINT) AS i, b.j, round(sum(a.v * b.v), 5) + 0.0 AS v FROM emb a JOIN emb b USING (i) GROUP BY a.j, b.j")
def matmul_tiles(spark: SparkSession, d: str) -> DataFrame:
    """The same as a product of two large factors, X' and X, by tiles of 48 rows and columns."""
    return entries(tiles.matmul(vectors_as_columns(spark, d), M.of_width(rows_of(spark, d), 64), 48), 5)


@query(f"WITH {EMB} SELECT i, j, round((i % 7 - 3) * v, 6) + 0.0 AS v FROM emb")
def vecmat(spark: SparkSession, d: str) -> DataFrame:
    a = long_of(spark, d)
    v = a.select("i").distinct().withColumn("s", (F.col("i") % 7 - 3).cast("double"))
    return L.vecmat(v, a).select("i", "j", r("v", "v"))


@query(f"WITH {EMB} SELECT CAST(j AS BIGINT) AS i, round(sum(v * v), 5) + 0.0 AS v FROM emb GROUP BY j")
def diag(spark: SparkSession, d: str) -> DataFrame:
    """The diagonal of the Gram matrix."""
    rows = rows_of(spark, d)
    return L.diagonal(L.as_table(rows, L.gram(rows))).select("i", r("v", "v", 5))


@query("SELECT a.s_suppkey AS i, CAST(b.s_suppkey AS INTEGER) AS j, CASE WHEN a.s_suppkey = b.s_suppkey THEN a.s_acctbal ELSE 0.0 END AS v FROM supplier a CROSS JOIN supplier b")
def diag_build(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers' balances as a diagonal matrix."""
    s = table(spark, d, "supplier")
    return L.build_diagonal(s.select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v")), s.count())


COMPLEX = f"{EMB}, z AS (SELECT a.i, a.v AS re, b.v AS im FROM emb a JOIN emb b USING (i) WHERE a.j = 0 AND b.j = 1)"


def complex_of(spark: SparkSession, d: str) -> DataFrame:
    return rows_of(spark, d).select(F.col("row_id").alias("i"), F.element_at("x", 1).alias("re"), F.element_at("x", 2).alias("im"))


@query(f"WITH {COMPLEX} SELECT i, round(sqrt(re * re + im * im), 6) + 0.0 AS modulus, round(atan2(im, re), 6) + 0.0 AS argument FROM z")
def polar(spark: SparkSession, d: str) -> DataFrame:
    re, im = F.col("re"), F.col("im")
    return complex_of(spark, d).select("i", r(C.modulus(re, im), "modulus"), r(F.atan2(im, re), "argument"))


@query(f"WITH {COMPLEX} SELECT i, re, round(-im, 9) + 0.0 AS im FROM z")
def conj(spark: SparkSession, d: str) -> DataFrame:
    return complex_of(spark, d).select("i", "re", r(-F.col("im"), "im", 9))


VANDER = "WITH {0}, k AS (SELECT CAST(unnest(range(6)) AS INTEGER) AS j) SELECT i, j, round(sqrt(re * re + im * im) ** ({1}) * cos(atan2(im, re) * ({1})), 6) + 0.0 AS re, round(sqrt(re * re + im * im) ** ({1}) * sin(atan2(im, re) * ({1})), 6) + 0.0 AS im FROM z CROSS JOIN k"


def powers(spark: SparkSession, d: str, at) -> DataFrame:
    z = complex_of(spark, d).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(5))))
    re, im = C.complex_power(F.col("re"), F.col("im"), at(F.col("j")))
    return z.select("i", "j", r(re, "a"), r(im, "b")).toDF("i", "j", "re", "im")


@query(VANDER.format(COMPLEX, "j"))
def vandermonde(spark: SparkSession, d: str) -> DataFrame:
    return powers(spark, d, lambda j: j)


@query(VANDER.format(COMPLEX, "0.2 * j + 0.5"))
def vandermonde_time(spark: SparkSession, d: str) -> DataFrame:
    return powers(spark, d, lambda j: 0.2 * j + 0.5)


@query(f"WITH {EMB} SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY v, j) - 1 AS INTEGER) AS rank, j FROM emb")
def argsort(spark: SparkSession, d: str) -> DataFrame:
    return L.argsort(long_of(spark, d))


@query(f"WITH {EMB} SELECT i, CAST(63 - j AS INTEGER) AS j, v FROM emb")
def flip(spark: SparkSession, d: str) -> DataFrame:
    return rows_of(spark, d).select(F.col("row_id").alias("i"), F.posexplode(F.reverse("x")).alias("j", "v"))


@query(f"WITH {EMB} SELECT CAST(a.j AS BIGINT) AS i, b.j, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 6) + 0.0 AS v FROM emb a JOIN emb b USING (i) GROUP BY a.j, b.j")
def euclidean_d(spark: SparkSession, d: str) -> DataFrame:
    rows = rows_of(spark, d)
    return L.as_table(rows, L.column_distances(rows)).select("i", "j", r("v", "v"))


def regression_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.lit(1.0).alias("one"), F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / 1000).alias("y"))


FIT = """
    WITH t AS (SELECT l_quantity AS q, l_extendedprice / 1000 AS y FROM lineitem),
         s AS (SELECT count(*) + {0} AS n, sum(q) AS sq, sum(q * q) + {0} AS sqq, sum(y) AS sy, sum(q * y) AS sqy FROM t)
    SELECT 0 AS term, round((sqq * sy - sq * sqy) / (n * sqq - sq * sq), 5) + 0.0 AS coefficient FROM s
    UNION ALL SELECT 1, round((n * sqy - sq * sy) / (n * sqq - sq * sq), 5) + 0.0 FROM s
"""


@query(FIT.format("0"))
def least_squares(spark: SparkSession, d: str) -> DataFrame:
    c = L.least_squares(regression_rows(spark, d), ["one", "q"], "y")
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(c)], "term int, c double").select("term", r("c", "coefficient", 5))


@query(FIT.format("100.0"))
def ridge(spark: SparkSession, d: str) -> DataFrame:
    c = L.ridge_regression(regression_rows(spark, d), ["one", "q"], "y", 100.0)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(c)], "term int, c double").select("term", r("c", "coefficient", 5))


GRAM3 = f"{EMB}, e AS (SELECT i, max(CASE WHEN j = 0 THEN v END) AS a, max(CASE WHEN j = 1 THEN v END) AS b, max(CASE WHEN j = 2 THEN v END) AS c FROM emb GROUP BY i), g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc FROM e)"


def gram3(spark: SparkSession, d: str) -> np.ndarray:
    return L.gram(rows_of(spark, d).select("row_id", F.slice("x", 1, 3).alias("x")))


@query(f"""
    WITH {GRAM3}, det AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS d FROM g)
    SELECT round((bb * cc - bc * bc) / d, 5) + 0.0 AS i00, round((ac * bc - ab * cc) / d, 5) + 0.0 AS i01, round((aa * bb - ab * ab) / d, 5) + 0.0 AS i22 FROM det
""")
def inverse(spark: SparkSession, d: str) -> DataFrame:
    m = np.linalg.inv(gram3(spark, d))
    return spark.createDataFrame([(float(m[0, 0]), float(m[0, 1]), float(m[2, 2]))], "a double, b double, c double").select(r("a", "i00", 5), r("b", "i01", 5), r("c", "i22", 5))


@query(f"WITH {GRAM3} SELECT round(sqrt(aa), 5) + 0.0 AS l00, round(ab / sqrt(aa), 5) + 0.0 AS l10, round(sqrt(bb - ab * ab / aa), 5) + 0.0 AS l11 FROM g")
def cholesky(spark: SparkSession, d: str) -> DataFrame:
    m = np.linalg.cholesky(gram3(spark, d))
    return spark.createDataFrame([(float(m[0, 0]), float(m[1, 0]), float(m[1, 1]))], "a double, b double, c double").select(r("a", "l00", 5), r("b", "l10", 5), r("c", "l11", 5))


@query(f"WITH {GRAM3} SELECT round(aa + bb + cc, 5) + 0.0 AS trace, round(aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac), 2) + 0.0 AS product, CAST(0 AS DOUBLE) AS imaginary FROM g")
def eigen(spark: SparkSession, d: str) -> DataFrame:
    """General eigenvalues, by their sum and product."""
    w = np.linalg.eig(gram3(spark, d))[0].astype(complex)
    return spark.createDataFrame([(float(w.sum().real), float(np.prod(w).real), float(abs(w.imag).max()))], "a double, b double, c double").select(r("a", "trace", 5), r("b", "product", 2), r("c", "imaginary"))


@query(f"WITH {EMB} SELECT round(sum(v * v), 5) + 0.0 AS energy, round(sqrt(sum(CASE WHEN j = 0 THEN v * v END)), 5) + 0.0 AS r00 FROM emb")
def tsqr(spark: SparkSession, d: str) -> DataFrame:
    """R of the tall factorisation: its energy is the matrix's, its first entry the first column's norm."""
    m = L.tsqr(rows_of(spark, d).repartition(5))
    return spark.createDataFrame([(float((m**2).sum()), float(m[0, 0]))], "a double, b double").select(r("a", "energy", 5), r("b", "r00", 5))


@query(f"WITH {EMB} SELECT i, round(sum(v * v), 6) + 0.0 AS v FROM emb GROUP BY i")
def tsqr_svd(spark: SparkSession, d: str) -> DataFrame:
    """Rows of U diag(S) keep the norms of the matrix's rows."""
    u, s, _ = L.tsqr_svd(rows_of(spark, d))
    scaled = F.aggregate(F.zip_with("x", F.array(*map(F.lit, s.tolist())), lambda x, y: x * x * y * y), F.lit(0.0), lambda a, v: a + v)
    return u.select(F.col("row_id").alias("i"), r(scaled, "v"))


@query(f"WITH {STATUS} SELECT i, CAST(j AS INTEGER) AS j, round(CASE j WHEN 0 THEN a ELSE b END, 5) + 0.0 AS v FROM st CROSS JOIN (SELECT unnest([0, 1]) AS j)")
def randomized_qr(spark: SparkSession, d: str) -> DataFrame:
    """Q B, which gives a matrix back whose rank is that of the sketch."""
    q, b = L.randomized_qr(status_rows(spark, d), 2, 1, 25)
    return entries(L.times(q, b), 5)


@query("""
    SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(CASE WHEN i = j THEN 1 ELSE 0 END AS DOUBLE) AS v, n
    FROM (SELECT unnest(range(8)) AS i) CROSS JOIN (SELECT unnest(range(8)) AS j) CROSS JOIN (SELECT count(*) AS n FROM embeddings)
""")
def randomized_basis(spark: SparkSession, d: str) -> DataFrame:
    """Q'Q of eight columns over all rows, and their number."""
    q, _ = L.randomized_qr(rows_of(spark, d), 8, 1, 25)
    g, n = L.gram(q), q.count()
    return spark.createDataFrame([(a, b, float(g[a, b])) for a in range(8) for b in range(8)], "i int, j int, w double").select("i", "j", r("w", "v"), F.lit(n).cast("bigint").alias("n"))


@query(f"WITH {STATUS} SELECT 0 AS mode, round(sqrt(l1), 4) + 0.0 AS s, round(p * p, 6) + 0.0 AS weight FROM ei UNION ALL SELECT 1, round(sqrt(l2), 4) + 0.0, round(q * q, 6) + 0.0 FROM ei")
def randomized_svd(spark: SparkSession, d: str) -> DataFrame:
    """Singular values by sketching, and the first square of each right vector."""
    _, s, vt = L.randomized_svd(status_rows(spark, d), 2, 3, 25)
    return spark.createDataFrame([(k, float(s[k]), float(vt[k, 0] ** 2)) for k in range(2)], "mode int, s double, w double").select("mode", r("s", "s", 4), r("w", "weight"))


@query("SELECT p_partkey AS n, CAST(CASE WHEN p_partkey < 2 THEN 1 ELSE 2 ** length(ltrim(bin(p_partkey - 1), '0')) END AS BIGINT) AS p FROM part")
def next_power_of_2(spark: SparkSession, d: str) -> DataFrame:
    """The least power of two that is not below each part's key."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("n"), C.next_power_of_2(F.col("p_partkey")).alias("p"))
