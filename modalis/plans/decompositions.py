"""Modal decompositions. Results that a factorisation fixes only up to sign are compared by invariants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matrix as M
from ..operators import gappy as P
from ..operators import linalg as L
from ..operators import manifold, modal, tiles, wide
from .base import EMB, FLAGS, MONTH, MONTHS, STATUS, entries, flag_rows, month_cells, month_rows, numbered_vectors, query, r, rows_of, squared, status_rows, vectors_as_columns


def numbered(spark: SparkSession, names: list[str], *columns: np.ndarray) -> DataFrame:
    rows = [(k, *(float(c[k]) for c in columns)) for k in range(len(columns[0]))]
    return spark.createDataFrame(rows, "mode int, " + ", ".join(f"{n} double" for n in names))


@query()
def pod_modes(spark: SparkSession, d: str) -> DataFrame:
    """Singular values, energies and residuals of the part x month matrix: the flagship."""
    m = modal.pod(month_rows(spark, d))
    e = m.s**2 / (m.s**2).sum()
    out = numbered(spark, ["s", "energy", "cumulative", "residual"], m.s, e, np.cumsum(e), modal.residuals(m.s))
    return out.select("mode", r("s", "s", 4), r("energy", "energy"), r("cumulative", "cumulative"), r("residual", "residual"))


@query(f"WITH {MONTH} SELECT round(sum((v - m) * (v - m)), 3) + 0.0 AS total FROM (SELECT v, avg(v) OVER (PARTITION BY i) AS m FROM x)")
def pod_total_energy(spark: SparkSession, d: str) -> DataFrame:
    """Squared singular values add up to the energy of the fluctuations."""
    m = modal.pod(month_rows(spark, d))
    return spark.createDataFrame([(float((m.s**2).sum()),)], "t double").select(r("t", "total", 3))


@query(f"WITH {EMB} SELECT i, j, round(v, 6) + 0.0 AS v FROM emb")
def pod_reconstruct_full(spark: SparkSession, d: str) -> DataFrame:
    """All modes give the matrix back."""
    m = modal.pod(rows_of(spark, d), remove_mean=False)
    return modal.reconstruct(m).select(F.col("row_id").alias("i"), F.posexplode("x").alias("j", "v")).select("i", "j", r("v", "v"))


@query(f"WITH {EMB} SELECT i, j, round(v - avg(v) OVER (PARTITION BY i), 6) + 0.0 AS v FROM emb")
def pod_reconstruct_centred(spark: SparkSession, d: str) -> DataFrame:
    """Means are not added back."""
    m = modal.pod(rows_of(spark, d))
    return modal.reconstruct(m).select(F.col("row_id").alias("i"), F.posexplode("x").alias("j", "v")).select("i", "j", r("v", "v"))


@query(f"""
    WITH RECURSIVE {MONTH}, y AS (SELECT i, j, v - avg(v) OVER (PARTITION BY i) AS v FROM x), g AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM y a JOIN y b ON a.i = b.i GROUP BY a.j, b.j),
         {squared("g")}, e AS (SELECT sum(g.v * l.v) AS s2 FROM g JOIN lead_ l USING (i, j)), t AS (SELECT sum(v) AS t FROM g WHERE i = j)
    SELECT CAST(l.i AS INTEGER) AS t, round(sqrt(s2), 4) + 0.0 AS s, round(s2 / t, 6) + 0.0 AS energy, round(l.v, 6) + 0.0 AS weight FROM lead_ l CROSS JOIN e CROSS JOIN t WHERE l.i = l.j
""")
def pod_leading_mode(spark: SparkSession, d: str) -> DataFrame:
    """The leading mode of the part x month matrix: S, its share of the energy, and the squares of its coefficients."""
    m = modal.pod(month_rows(spark, d))
    share = float(m.s[0] ** 2 / (m.s**2).sum())
    rows = [(k, float(m.s[0]), share, float(v * v)) for k, v in enumerate(m.vt[0])]
    return spark.createDataFrame(rows, "t int, a double, b double, c double").select("t", r("a", "s", 4), r("b", "energy"), r("c", "weight"))


@query(f"""
    WITH {STATUS}
    SELECT 0 AS mode, round(sqrt(l1), 4) + 0.0 AS s, round(l1 / (l1 + l2), 6) + 0.0 AS energy, round(l1 / (l1 + l2), 6) + 0.0 AS cumulative, CAST(1 AS DOUBLE) AS residual FROM ei
    UNION ALL SELECT 1, round(sqrt(l2), 4) + 0.0, round(l2 / (l1 + l2), 6) + 0.0, CAST(1 AS DOUBLE), round(sqrt(l2 / (l1 + l2)), 6) + 0.0 FROM ei
""")
def pod_status_modes(spark: SparkSession, d: str) -> DataFrame:
    """The same columns as the flagship's, of a matrix of two columns."""
    m = modal.pod(status_rows(spark, d), remove_mean=False)
    e = m.s**2 / (m.s**2).sum()
    out = numbered(spark, ["s", "energy", "cumulative", "residual"], m.s, e, np.cumsum(e), modal.residuals(m.s))
    return out.select("mode", r("s", "s", 4), r("energy", "energy"), r("cumulative", "cumulative"), r("residual", "residual"))


@query(f"WITH {STATUS} SELECT i, CAST(j AS INTEGER) AS j, round((a * p + b * q) * CASE j WHEN 0 THEN p ELSE q END, 5) + 0.0 AS v FROM st CROSS JOIN ei CROSS JOIN (SELECT unnest([0, 1]) AS j)")
def pod_truncated(spark: SparkSession, d: str) -> DataFrame:
    """The reconstruction by one mode of two."""
    return entries(modal.reconstruct(modal.truncate(modal.pod(status_rows(spark, d), remove_mean=False), 1)), 5)


@query(f"""
    WITH {STATUS}, w AS (SELECT a - (a * p + b * q) * p AS da, b - (a * p + b * q) * q AS db, a, b FROM st CROSS JOIN ei)
    SELECT round(sqrt(sum(da * da + db * db) / sum(a * a + b * b)), 9) + 0.0 AS residual FROM w
""")
def pod_residual(spark: SparkSession, d: str) -> DataFrame:
    """What one mode leaves out of two columns, as the rows tell."""
    y = status_rows(spark, d)
    m = modal.truncate(modal.pod(y, remove_mean=False), 1)
    both = y.join(modal.reconstruct(m).withColumnRenamed("x", "y"), "row_id")
    pairs = both.select(F.explode(F.arrays_zip(F.col("x").alias("a"), F.col("y").alias("b"))).alias("p")).select("p.a", "p.b")
    return pairs.agg(r(F.sqrt(F.sum((F.col("a") - F.col("b")) ** 2) / F.sum(F.col("a") ** 2)), "residual", 9))


LIMITS = (-0.81, -0.5, -0.1, 2.0, 0.9, 0.6, 0.3)


@query(f"""
    WITH {MONTH}, s AS (SELECT sqrt(sum(v * v)) AS s FROM x GROUP BY j), o AS (SELECT s, row_number() OVER (ORDER BY s DESC) - 1 AS k FROM s),
         c AS (SELECT k, sum(s) OVER (ORDER BY k) / sum(s) OVER () AS share, sqrt(sum(s * s) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / sum(s * s) OVER ()) AS rest FROM o),
         l AS (SELECT unnest([{", ".join(f"CAST({x} AS DOUBLE)" for x in LIMITS)}]) AS r)
    SELECT r, CAST(CASE WHEN r >= 1 THEN least(floor(r), (SELECT count(*) FROM o)) WHEN r > 0 THEN coalesce((SELECT min(k) FROM c WHERE rest < r), (SELECT count(*) FROM o))
        ELSE coalesce((SELECT min(k) + 1 FROM c WHERE share > -r), (SELECT count(*) FROM o)) END AS INTEGER) AS n FROM l
""")
def pod_truncation(spark: SparkSession, d: str) -> DataFrame:
    """Modes that each rule keeps of a spectrum: the norms of the months' columns."""
    norms = month_cells(spark, d).groupBy("i", "j").agg(F.sum("v").alias("v")).groupBy("j").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("s")).toPandas()["s"].to_numpy()
    s = np.zeros(MONTHS)
    s[: len(norms)] = np.sort(norms)[::-1]
    return spark.createDataFrame([(c, modal.truncation(s, c)) for c in LIMITS], "r double, n int")


@query()
def pod_randomized(spark: SparkSession, d: str) -> DataFrame:
    """Leading singular values by sketching."""
    m = modal.pod(month_rows(spark, d), randomized=True, r=8, q=3, seed=25)
    return numbered(spark, ["s"], m.s[:6]).select("mode", r("s", "s", 3))


@query(f"WITH {EMB} SELECT CAST(i // 2 AS BIGINT) AS point, round(max(CASE WHEN j = 2 THEN v END), 9) + 0.0 AS a, round(max(CASE WHEN j = 0 THEN v END), 9) + 0.0 AS b FROM emb WHERE i % 2 = 1 GROUP BY 1")
def extract_modes(spark: SparkSession, d: str) -> DataFrame:
    """Second of two interleaved fields, modes 3 and 1."""
    e = modal.extract_modes(rows_of(spark, d), 2, 2, [3, 1])
    return e.select("point", r(F.element_at("x", 1), "a", 9), r(F.element_at("x", 2), "b", 9))


@query(f"""
    WITH {EMB}, y AS (SELECT i, j, (v - avg(v) OVER w) / var_pop(v) OVER w AS v FROM emb WINDOW w AS (PARTITION BY i))
    SELECT j AS t, round(sqrt(sum(v * v)), 4) + 0.0 AS norm FROM y GROUP BY j
""")
def pca_scores_norm(spark: SparkSession, d: str) -> DataFrame:
    """Scores keep the norms of the scaled snapshots."""
    _, scores = modal.pca(rows_of(spark, d))
    n = np.sqrt((scores**2).sum(axis=1))
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(n)], "t int, n double").select("t", r("n", "norm", 4))


@query(f"""
    WITH RECURSIVE {EMB}, y AS (SELECT i, j, (v - avg(v) OVER w) / var_pop(v) OVER w AS v FROM emb WINDOW w AS (PARTITION BY i)),
         g AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM y a JOIN y b ON a.i = b.i GROUP BY a.j, b.j), {squared("g", 18)}
    SELECT CAST(i AS INTEGER) AS t, round(v * ((SELECT count(DISTINCT j) FROM emb) - 1), 4) + 0.0 AS t2 FROM lead_ WHERE i = j
""")
def pca_t2(spark: SparkSession, d: str) -> DataFrame:
    """Scores of snapshots over the first component."""
    _, scores = modal.pca(rows_of(spark, d))
    t2, _ = modal.t2_score(scores)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(t2)], "t int, t2 double").select("t", r("t2", "t2", 4))


@query()
def coherent_modes(spark: SparkSession, d: str) -> DataFrame:
    m = modal.pod(month_rows(spark, d))
    scores, limit, _, _ = modal.coherent_modes(m.vt, np.arange(MONTHS, dtype=float))
    return numbered(spark, ["t2"], scores).select("mode", r("t2", "t2", 4), (F.col("t2") > float(limit)).alias("coherent"))


ROOTS = f"""{FLAGS}, di AS (SELECT *, c2 * c2 + 4 * c1 AS d FROM co),
     mu AS (SELECT *, c2 / 2 + CASE WHEN d >= 0 THEN k * sqrt(d) / 2 ELSE 0 END AS re, CASE WHEN d < 0 THEN k * sqrt(-d) / 2 ELSE 0 END AS im,
                   c2 / 2 - CASE WHEN d >= 0 THEN k * sqrt(d) / 2 ELSE 0 END AS re2, CASE WHEN d < 0 THEN -k * sqrt(-d) / 2 ELSE 0 END AS im2 FROM di CROSS JOIN (SELECT unnest([1, -1]) AS k)),
     am AS (SELECT *, sqrt((bb - 2 * re2 * ab + (re2 * re2 + im2 * im2) * aa) / ((re - re2) ** 2 + (im - im2) ** 2)) AS amplitude FROM mu)"""


@query(f"""
    WITH {ROOTS}
    SELECT CAST(row_number() OVER (ORDER BY round(amplitude, 6) DESC, im DESC) - 1 AS INTEGER) AS mode, round(ln(sqrt(re * re + im * im)), 5) + 0.0 AS damping, round(atan2(im, re), 5) + 0.0 AS frequency,
           round(amplitude, 3) + 0.0 AS amplitude FROM am
""")
def dmd_flag_modes(spark: SparkSession, d: str) -> DataFrame:
    """Damping, frequency and amplitude of the modes of three snapshots, strongest first, of a pair the one that turns
    forward: roots of the polynomial that foretells the third from the others."""
    m = modal.dmd(flag_rows(spark, d), 2, remove_mean=False)
    damping, frequency = modal.frequency_damping(m.mu, 1.0)
    return numbered(spark, ["damping", "frequency", "amplitude"], damping, frequency, np.abs(m.amplitude)).select("mode", r("damping", "damping", 5), r("frequency", "frequency", 5), r("amplitude", "amplitude", 3))


RECONSTRUCTED = f"WITH {FLAGS} SELECT i, CAST(j AS INTEGER) AS j, round(CASE j WHEN 0 THEN (c - c2 * b) / c1 WHEN 1 THEN b ELSE c END, 4) + 0.0 AS v FROM fl CROSS JOIN co CROSS JOIN (SELECT unnest([0, 1, 2]) AS j)"


@query(RECONSTRUCTED)
def dmd_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    """Three snapshots from two modes: the last two come back, the first is what leads to them."""
    m = modal.dmd(flag_rows(spark, d), 2, remove_mean=False)
    return entries(modal.dmd_reconstruct(m, np.arange(3.0)), 4)


@query(f"WITH {STATUS} SELECT i, CAST(j AS INTEGER) AS j, round((a * p + b * q) / sqrt(l1) * CASE j WHEN 0 THEN 0.6 ELSE 0.8 END, 6) + 0.0 AS v FROM st CROSS JOIN ei CROSS JOIN (SELECT unnest([0, 1]) AS j)")
def dmd_mode_computation(spark: SparkSession, d: str) -> DataFrame:
    """X V / S times the moduli of given complex weights."""
    rows = status_rows(spark, d)
    m = modal.pod(rows, remove_mean=False)
    out = modal.mode_computation(rows, m.vt[:1] * (1 if m.vt[0].sum() > 0 else -1), m.s[:1], np.array([[0.6j, -0.8]]))
    return entries(out)


@query()
def dmd_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """Damping, frequency and amplitude of the ten strongest dynamic modes of the part x month matrix."""
    m = modal.dmd(month_rows(spark, d), 12)
    damping, frequency = modal.frequency_damping(m.mu, 1.0)
    return numbered(spark, ["damping", "frequency", "amplitude"], damping[:10], frequency[:10], np.abs(m.amplitude)[:10]).select("mode", r("damping", "damping", 4), r("frequency", "frequency", 4), r("amplitude", "amplitude", 2))


@query()
def spod_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """Energy by frequency and block of the part x month matrix."""
    m = modal.spod(month_rows(spark, d), np.arange(MONTHS, dtype=float), 16, 8)
    return numbered(spark, ["frequency", "first", "second"], m.frequency, m.energy[:, 0], m.energy[:, 1]).select("mode", r("frequency", "frequency"), r("first", "first", 1), r("second", "second", 1))


#: Two blocks of 40 of 64 snapshots: transforms (xr, xi) of the first and (yr, yi) of the second, their products, and
#: the eigenvalues of two by two.
BLOCKS = f"""{EMB}, m AS (SELECT i, j, v - avg(v) OVER (PARTITION BY i) AS v FROM emb), k AS (SELECT CAST(unnest(range(21)) AS INTEGER) AS f),
     w AS (SELECT pos, 0.54 - 0.46 * cos(2 * pi() * pos / 39) AS h FROM (SELECT CAST(unnest(range(40)) AS INTEGER) AS pos)), u AS (SELECT avg(h) AS u FROM w),
     s AS (SELECT i, f, b, sum(v * h * cos(2 * pi() * ((f * pos) % 40) / 40)) * CASE WHEN f IN (0, 20) THEN 1 ELSE 2 END / 40 / min(u) / sqrt(2) AS re,
                  -sum(v * h * sin(2 * pi() * ((f * pos) % 40) / 40)) * CASE WHEN f IN (0, 20) THEN 1 ELSE 2 END / 40 / min(u) / sqrt(2) AS im
           FROM m JOIN (SELECT pos, h, b FROM w CROSS JOIN (SELECT unnest([0, 1]) AS b)) q ON m.j = q.pos + 24 * q.b CROSS JOIN k CROSS JOIN u GROUP BY i, f, b),
     t AS (SELECT i, f, max(CASE WHEN b = 0 THEN re END) AS xr, max(CASE WHEN b = 0 THEN im END) AS xi, max(CASE WHEN b = 1 THEN re END) AS yr, max(CASE WHEN b = 1 THEN im END) AS yi FROM s GROUP BY i, f),
     g AS (SELECT f, sum(xr * xr + xi * xi) AS p, sum(yr * yr + yi * yi) AS q, sum(xr * yr + xi * yi) AS cr, sum(xr * yi - xi * yr) AS ci FROM t GROUP BY f),
     l AS (SELECT *, (p + q) / 2 + sqrt(((p - q) / 2) ** 2 + cr * cr + ci * ci) AS l1, (p + q) / 2 - sqrt(((p - q) / 2) ** 2 + cr * cr + ci * ci) AS l2 FROM g),
     o AS (SELECT *, row_number() OVER (ORDER BY l1 DESC) AS place, sqrt(cr * cr + ci * ci) AS c FROM l)"""


def two_blocks(spark: SparkSession, d: str) -> modal.Spectral:
    return modal.spod(rows_of(spark, d), np.arange(64.0), 40, 16)


@query(f"WITH {BLOCKS} SELECT CAST(place - 1 AS INTEGER) AS mode, round(f / 40, 6) + 0.0 AS frequency, round(l1, 6) + 0.0 AS first, round(l2, 6) + 0.0 AS second FROM o")
def spod_two_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies by leading energy, and the energies of both blocks."""
    m = two_blocks(spark, d)
    return numbered(spark, ["frequency", "first", "second"], m.frequency, m.energy[:, 0], m.energy[:, 1]).select("mode", r("frequency", "frequency"), r("first", "first"), r("second", "second"))


#: The leading eigenvector (c, l1 - p), turned so that its larger part is real and positive.
SPOD_MODES = f"""
    WITH {BLOCKS}, v AS (SELECT f, place, sqrt(l1) AS s, sqrt(c * c + (l1 - p) ** 2) AS n, CASE WHEN c > l1 - p THEN c ELSE cr END AS ar, CASE WHEN c > l1 - p THEN 0 ELSE ci END AS ai,
        CASE WHEN c > l1 - p THEN (l1 - p) * cr / c ELSE l1 - p END AS br, CASE WHEN c > l1 - p THEN -(l1 - p) * ci / c ELSE 0 END AS bi FROM o),
        z AS (SELECT i, place, (xr * ar - xi * ai + yr * br - yi * bi) / n / s AS v FROM t JOIN v USING (f))
    SELECT CAST(i // 2 AS BIGINT) AS point, round(max(CASE WHEN place = 1 THEN v END), 5) + 0.0 AS a, round(max(CASE WHEN place = 3 THEN v END), 5) + 0.0 AS b FROM z WHERE i % 2 = 1 GROUP BY 1
"""


@query(SPOD_MODES)
def extract_spod_modes(spark: SparkSession, d: str) -> DataFrame:
    """Second of two interleaved fields, the first block's modes of the strongest and the third frequency."""
    e = modal.extract_spectral(two_blocks(spark, d), 2, 2, [1, 3])
    return e.select("point", r(F.element_at("x", 1), "a", 5), r(F.element_at("x", 2), "b", 5))


@query(f"""
    WITH {ROOTS}, o AS (SELECT *, row_number() OVER (ORDER BY round(amplitude, 6) DESC, im DESC) AS place FROM am)
    SELECT CAST(i // 2 AS BIGINT) AS point, round(sqrt(sum(CASE WHEN i % 2 = 1 THEN ((c - re2 * b) ** 2 + (im2 * b) ** 2) / ((re - re2) ** 2 + (im - im2) ** 2) / amplitude ** 2 / (re * re + im * im) ELSE 0 END)), 6) + 0.0 AS modulus
    FROM fl CROSS JOIN o WHERE place = 1 AND i % 2 = 1 GROUP BY 1
""")
def extract_dmd_modes(spark: SparkSession, d: str) -> DataFrame:
    """Second of two interleaved fields, moduli of the strongest dynamic mode from its real and imaginary parts."""
    m = modal.dmd(flag_rows(spark, d), 2, remove_mean=False)
    parts = [modal.extract_dynamics(m.phi, 2, 2, [1], real).select("point", F.element_at("x", 1).alias(n)) for n, real in (("re", True), ("im", False))]
    return parts[0].join(parts[1], "point").select("point", r(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2), "modulus"))


@query(f"""
    WITH {EMB}, y AS (SELECT i, j, v - avg(v) OVER (PARTITION BY i) AS v FROM emb), b AS (SELECT CAST(unnest(range(7)) AS INTEGER) AS block),
         w AS (SELECT CAST(unnest(range(16)) AS INTEGER) AS pos), k AS (SELECT CAST(unnest(range(9)) AS INTEGER) AS f),
         x AS (SELECT i, block, f, sum(v * (0.54 - 0.46 * cos(2 * pi() * pos / 15)) * cos(2 * pi() * f * pos / 16)) AS re,
                      sum(v * (0.54 - 0.46 * cos(2 * pi() * pos / 15)) * sin(2 * pi() * f * pos / 16)) AS im
               FROM y JOIN (SELECT block, pos FROM b CROSS JOIN w) p ON y.j = p.block * 8 + p.pos CROSS JOIN k GROUP BY ALL)
    SELECT f, round(sum(re * re + im * im) * CASE WHEN f IN (0, 8) THEN 1 ELSE 4 END / 7 / 256 / (0.54 - 0.46 / 16) ** 2, 4) + 0.0 AS energy FROM x GROUP BY f
""")
def spod_parseval(spark: SparkSession, d: str) -> DataFrame:
    """Energies of a frequency add up to that of its windowed transforms."""
    m = modal.spod(rows_of(spark, d), np.arange(64.0), 16, 8)
    f = np.round(m.frequency * 16).astype(int)
    return spark.createDataFrame([(int(k), float(e)) for k, e in zip(f, m.energy.sum(axis=1), strict=True)], "f int, e double").select("f", r("e", "energy", 4))


GAPS = f"{EMB}, g AS (SELECT i, j, CASE WHEN (i * 31 + j * 17) % 7 = 0 THEN 0.0 ELSE v END AS v FROM emb)"


def gappy_rows(spark: SparkSession, d: str) -> DataFrame:
    gap = lambda v, j: F.when((F.col("row_id") * 31 + j * 17) % 7 == 0, 0.0).otherwise(v)
    return rows_of(spark, d).select("row_id", F.transform("x", gap).alias("x"))


@query(f"WITH {GAPS} SELECT i, j, round(v, 6) + 0.0 AS v FROM g WHERE v <> 0")
def gpod_known_entries(spark: SparkSession, d: str) -> DataFrame:
    """Refilling never changes an observed entry."""
    rows = gappy_rows(spark, d)
    filled, _ = P.reconstruct_full_set(rows, 1, truncation=6)
    both = rows.withColumnRenamed("x", "seen").join(filled, "row_id")
    e = both.select(F.col("row_id").alias("i"), F.posexplode(F.arrays_zip("seen", "x")).alias("j", "p")).filter("p.seen <> 0")
    return e.select("i", "j", r("p.x", "v"))


@query(f"WITH {GAPS}, m AS (SELECT i, j, v, sum(v) OVER (PARTITION BY i) / count(CASE WHEN v <> 0 THEN 1 END) OVER (PARTITION BY i) AS m FROM g) SELECT i, j, round(CASE WHEN v = 0 THEN m ELSE v END, 6) + 0.0 AS v FROM m")
def gpod_mean_fill(spark: SparkSession, d: str) -> DataFrame:
    """The first guess: means of the observed entries."""
    return P.observed_mean_fill(gappy_rows(spark, d)).select(F.col("row_id").alias("i"), F.posexplode("x").alias("j", "v")).select("i", "j", r("v", "v"))


@query(f"""
    WITH {STATUS}, w AS (SELECT i, j, CASE j WHEN 0 THEN a ELSE b END * CASE WHEN (i * 31 + j * 17) % 7 = 0 THEN 0 ELSE 1 END AS v, a * p + b * q AS u FROM st CROSS JOIN ei CROSS JOIN (SELECT unnest([0, 1]) AS j)),
         k AS (SELECT j, sum(CASE WHEN v <> 0 THEN u * v ELSE 0 END) / sum(CASE WHEN v <> 0 THEN u * u ELSE 0 END) AS k FROM w GROUP BY j)
    SELECT i, CAST(j AS INTEGER) AS j, round(u * k, 4) + 0.0 AS v FROM w JOIN k USING (j)
""")
def gpod_predict(spark: SparkSession, d: str) -> DataFrame:
    """Columns with holes from one mode, by the entries that are there."""
    rows = status_rows(spark, d)
    gap = lambda v, j: F.when((F.col("row_id") * 31 + j * 17) % 7 == 0, 0.0).otherwise(v)
    model = P.GappyPOD(truncation=1, ridge=None).fit(rows)
    return entries(model.predict(rows.select("row_id", F.transform("x", gap).alias("x"))), 4)


@query(f"""
    WITH {EMB}, g AS (SELECT a.j AS j1, b.j AS j2, sqrt(sum((a.v - b.v) ** 2)) AS d FROM emb a JOIN emb b USING (i) WHERE a.j < b.j GROUP BY ALL)
    SELECT j1, j2, round(d, 5) + 0.0 AS d FROM g
""")
def mds_distances(spark: SparkSession, d: str) -> DataFrame:
    """With all dimensions the embedding keeps every distance."""
    y = manifold.mds(rows_of(spark, d), 64)
    n = y.shape[1]
    rows = [(a, b, float(np.sqrt(((y[:, a] - y[:, b]) ** 2).sum()))) for a in range(n) for b in range(a + 1, n)]
    return spark.createDataFrame(rows, "j1 int, j2 int, d double").select("j1", "j2", r("d", "d", 5))


def paths(entries_: str, size: int) -> str:
    """g (k, i, j, d): lengths of paths of up to 2 ** k edges of the graph of ``size`` nearest columns."""
    return f"""d0 AS (SELECT a.j AS i, b.j AS j, sqrt(sum((a.v - b.v) ** 2)) AS d FROM {entries_} a JOIN {entries_} b ON a.i = b.i GROUP BY a.j, b.j),
     near AS (SELECT i, j, d FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM d0) WHERE k <= {size} + 1),
     e AS (SELECT i, j, min(d) AS d FROM (SELECT * FROM near UNION ALL SELECT j, i, d FROM near) GROUP BY i, j),
     g(k, i, j, d) AS (SELECT 0, i, j, d FROM e UNION ALL SELECT k + 1, i, j, d FROM (SELECT x.k AS k, x.i AS i, y.j AS j, min(x.d + y.d) AS d FROM g x JOIN g y ON x.j = y.i GROUP BY x.k, x.i, y.j) WHERE k < 7)"""


@query(f"""
    WITH RECURSIVE {MONTH}, {paths("x", 12)}, q AS (SELECT i, j, d * d AS d FROM g WHERE k = 7),
         b AS (SELECT i, j, -0.5 * (d - avg(d) OVER (PARTITION BY i) - avg(d) OVER (PARTITION BY j) + avg(d) OVER ()) AS v FROM q),
         f AS (SELECT sqrt(sum(v * v)) AS f FROM b), s1 AS (SELECT i, j, v + CASE WHEN i = j THEN f ELSE 0 END AS v FROM b CROSS JOIN f), {squared("s1", 20)},
         l AS (SELECT sum(b.v * p.v) AS l FROM b JOIN lead_ p USING (i, j)), b2 AS (SELECT b.i, b.j, b.v - l.l * p.v AS v FROM b JOIN lead_ p USING (i, j) CROSS JOIN l),
         s2 AS (SELECT i, j, v + CASE WHEN i = j THEN f ELSE 0 END AS v FROM b2 CROSS JOIN f), {squared("s2", 20, "p2", "lead2")},
         l2 AS (SELECT sum(b2.v * p.v) AS l FROM b2 JOIN lead2 p USING (i, j))
    SELECT CAST(x.i AS INTEGER) AS t, round(sqrt(greatest(0, l.l * x.v)), 2) + 0.0 AS a, round(sqrt(greatest(0, l2.l * y.v)), 2) + 0.0 AS b FROM lead_ x JOIN lead2 y USING (i, j) CROSS JOIN l CROSS JOIN l2 WHERE x.i = x.j
""")
def isomap_embed(spark: SparkSession, d: str) -> DataFrame:
    """Moduli of two coordinates of each month. The statement shifts its matrix: paths make some eigenvalues negative."""
    y, _, _ = manifold.landmark_isomap(month_rows(spark, d), 2, 12)
    return y.select(F.col("node").cast("int").alias("t"), r(F.abs(F.col("y")[0]), "a", 2), r(F.abs(F.col("y")[1]), "b", 2))


@query(f"WITH {EMB}, p AS (SELECT a.j AS j1, b.j AS j2, sqrt(sum((a.v - b.v) ** 2)) AS d FROM emb a JOIN emb b USING (i) WHERE a.j <> b.j GROUP BY ALL), n AS (SELECT j1, j2, d, row_number() OVER (PARTITION BY j1 ORDER BY d, j2) AS k FROM p) SELECT j1, j2, round(d, 5) + 0.0 AS d FROM n WHERE k <= 6")
def nearest_columns(spark: SparkSession, d: str) -> DataFrame:
    """The six nearest other snapshots of each, by tiles of columns."""
    near = tiles.nearest(rows_of(spark, d), 6, 24).select("i", F.explode("near").alias("x"))
    return near.select(F.col("i").cast("int").alias("j1"), F.col("x.j").cast("int").alias("j2"), r("x.d", "d", 5))


#: Vectors by their place, and as many as LANDMARKS of them that come first by a hash of it.
LANDMARKS = 12
PLACES = f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS j, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
     d0 AS (SELECT a.j AS i, b.j AS j, list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.j <> b.j),
     e AS MATERIALIZED (SELECT i, j, min(d) AS d FROM (SELECT i, j, d FROM d0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 5 UNION ALL SELECT j, i, d FROM d0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 5) GROUP BY i, j),
     l AS (SELECT j AS source FROM v ORDER BY md5('0:' || j), j LIMIT {LANDMARKS})"""


@query(f"""
    WITH RECURSIVE {PLACES}, g(k, node, source, d) AS (
        SELECT 0, source, source, 0.0::DOUBLE FROM l
        UNION ALL SELECT k, node, source, d FROM (
            SELECT k + 1 AS k, node, source, min(d) AS d FROM (SELECT k, node, source, d FROM g UNION ALL SELECT g.k, e.j, g.source, g.d + e.d FROM g JOIN e ON e.i = g.node) GROUP BY k, node, source) WHERE k <= 40)
    SELECT CAST(node AS BIGINT) AS node, CAST(source AS BIGINT) AS source, round(d, 5) + 0.0 AS d FROM g WHERE k = 40
""")
def landmark_paths(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of the shortest paths from a few vectors to all others, over the graph of the five nearest of each."""
    x = numbered_vectors(spark, d)
    edges = manifold.vector_edges(x, 5)
    sources = spark.createDataFrame([(j,) for j in manifold.landmark_numbers(x.count(), LANDMARKS)], "source long")
    return manifold.paths_from(edges, sources).select("node", "source", r("d", "d", 5))


@query(f"WITH {PLACES} SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(d, 5) + 0.0 AS d FROM e")
def neighbour_graph(spark: SparkSession, d: str) -> DataFrame:
    """The graph of the five nearest vectors of each, either way round."""
    return manifold.vector_edges(numbered_vectors(spark, d), 5).select("i", "j", r("d", "d", 5))


@query(f"WITH RECURSIVE {EMB}, {paths("emb", 4)} SELECT CAST(i AS INTEGER) AS j1, CAST(j AS INTEGER) AS j2, round(d, 5) + 0.0 AS d FROM g WHERE k = 7 AND i < j")
def isomap_paths(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of the shortest paths over the four nearest snapshots of each, where there is a path."""
    x = rows_of(spark, d)
    every = spark.createDataFrame([(j,) for j in range(M.width(x))], "source long")
    g = manifold.paths_from(manifold.neighbour_edges(x, 4), every).filter("source < node")
    return g.select(F.col("source").cast("int").alias("j1"), F.col("node").cast("int").alias("j2"), r("d", "d", 5))


@query(f"""
    WITH RECURSIVE {EMB}, {paths("emb", 1)}, c AS (SELECT i, min(j) AS name FROM g WHERE k = 7 GROUP BY i), n AS (SELECT name, count(*) AS n FROM c GROUP BY name),
         o AS (SELECT name, n, row_number() OVER (ORDER BY n DESC, name) AS place FROM n)
    SELECT CAST(place AS INTEGER) AS component, CAST(i AS INTEGER) AS t FROM c JOIN o USING (name) WHERE place <= 2
""")
def isomap_components(spark: SparkSession, d: str) -> DataFrame:
    """Members of the two largest components of the graph of nearest snapshots."""
    g = manifold.shortest_paths(manifold.neighbours(L.column_distances(rows_of(spark, d)), 1))
    parts = {k: manifold.component_members(g, k) for k in (1, 2)}
    if np.array_equal(parts[1], parts[2]):  # there is no second one
        del parts[2]
    return spark.createDataFrame([(k, int(t)) for k, m in parts.items() for t in m], "component int, t int")


@query(f"WITH {EMB} SELECT count(*) AS n, CAST(floor(count(*) * 0.15) AS BIGINT) AS zeros FROM emb WHERE j = 0")
def zero_fraction(spark: SparkSession, d: str) -> DataFrame:
    """An exact share of entries is set to 0."""
    v = rows_of(spark, d).select(F.col("row_id").alias("i"), F.element_at("x", 1).alias("v"))
    return P.zero_fraction(v, 15).agg(F.count("*").alias("n"), F.count(F.when(F.col("v") == 0, 1)).alias("zeros"))


@query(f"WITH {MONTH} SELECT a.j AS i, b.j, round(sum(a.v * b.v) / 1000, 4) + 0.0 AS v FROM x a JOIN x b USING (i) GROUP BY a.j, b.j")
def panel_factor(spark: SparkSession, d: str) -> DataFrame:
    """R'R of a factorisation by panels of 20 columns is X'X."""
    _, r_ = wide.panel_qr(month_rows(spark, d), 20)
    e = wide.factor_entries(r_)
    both = e.select("i", F.col("j").alias("a"), F.col("v").alias("va")).join(e, "i")
    return both.groupBy("a", "j").agg(F.sum(F.col("va") * F.col("v")).alias("v")).select(F.col("a").alias("i"), "j", r(F.col("v") / 1000, "v", 4))


@query(f"WITH {EMB} SELECT DISTINCT a.j AS i, b.j, CASE WHEN a.j = b.j THEN 1.0::DOUBLE ELSE 0 END AS v FROM emb a JOIN emb b USING (i)")
def panel_basis(spark: SparkSession, d: str) -> DataFrame:
    """Q'Q of such a factorisation is the identity, where columns are independent."""
    q, _ = wide.panel_qr(M.of_width(rows_of(spark, d), 64), 20)
    g = L.as_table(q, L.gram(q))
    return g.select(F.col("i").cast("int").alias("i"), "j", r("v", "v", 8))


@query(f"WITH {EMB}, v AS (SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS n FROM embeddings) SELECT e.j AS i, v.n AS j, round(e.v, 5) + 0.0 AS v FROM emb e JOIN v ON e.i = v.vec_id")
def wide_factors(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as columns, more than rows: singular factors by sketching give them back."""
    u, s, vt = L.randomized_svd(vectors_as_columns(spark, d), 64, 1, 3)
    return L.times(u, s[:, None] * vt).select(F.col("row_id").cast("int").alias("i"), F.posexplode("x").alias("j", "v")).select("i", "j", r("v", "v", 5))
