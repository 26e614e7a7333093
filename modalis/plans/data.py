"""Dataset handling: fields and axes, splits, scaling, samples on parameters x points, coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions import matrix as M
from ..operators import aero
from ..operators import tables as T
from .base import EMB, MONTH, long_of, month_rows, query, r, rows_of, table


@query(f"WITH {MONTH} SELECT i, j, round(v, 4) + 0.0 AS v FROM x")
def dense_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Part x month, holes filled with 0."""
    return M.to_long(month_rows(spark, d)).select("i", "j", r("v", "v", 4))


FIELDS = f"{EMB}, f AS (SELECT CASE WHEN j < 32 THEN 'a' ELSE 'b' END AS field, 0 AS comp, i AS point_id, j % 32 AS t, v FROM emb)"


def fields_of(spark: SparkSession, d: str) -> DataFrame:
    e = long_of(spark, d)
    return e.select(F.when(F.col("j") < 32, "a").otherwise("b").alias("field"), F.lit(0).alias("comp"), F.col("i").alias("point_id"), (F.col("j") % 32).cast("int").alias("t"), "v")


@query(f"WITH {FIELDS} SELECT point_id * 2 + CASE field WHEN 'b' THEN 0 ELSE 1 END AS i, CAST(t AS INTEGER) AS j, v FROM f")
def build_x(spark: SparkSession, d: str) -> DataFrame:
    """Two fields interleaved by point, in the order that is asked for."""
    return T.build_x(fields_of(spark, d), ["b", "a"])


@query(f"WITH {EMB} SELECT i // 2 AS i, j, v FROM emb WHERE i % 2 = 1")
def get_dim(spark: SparkSession, d: str) -> DataFrame:
    return T.get_dim(long_of(spark, d), 2, 1)


@query(f"WITH {EMB} SELECT i, j, v FROM emb WHERE j % 3 = 0")
def mask_field(spark: SparkSession, d: str) -> DataFrame:
    return T.mask_columns(long_of(spark, d), F.col("j") % 3 == 0)


@query(f"WITH {EMB} SELECT i, CAST(j - CASE WHEN j > 5 THEN 1 ELSE 0 END - CASE WHEN j > 20 THEN 1 ELSE 0 END AS INTEGER) AS j, v FROM emb WHERE j NOT IN (5, 20)")
def delete_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return T.delete_snapshots(long_of(spark, d), [5, 20])


@query("""
    WITH b AS (SELECT 0 AS part, CAST(p_size AS INTEGER) AS pos, min(p_retailprice) AS value FROM part GROUP BY p_size
               UNION ALL SELECT 1, CAST(n_nationkey AS INTEGER), 900 + n_nationkey * 4.5::DOUBLE FROM nation)
    SELECT part, pos, round(value, 6) + 0.0 AS value, CAST(row_number() OVER (ORDER BY value, part, pos) - 1 AS INTEGER) AS at FROM b
""")
def append_variable(spark: SparkSession, d: str) -> DataFrame:
    """A second part of an axis, sorted in: least prices by size, and places by nation."""
    a = table(spark, d, "part").groupBy(F.col("p_size").cast("int").alias("pos")).agg(F.min("p_retailprice").alias("value"))
    b = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("pos"), (900 + F.col("n_nationkey") * 4.5).alias("value"))
    return T.append_sorted(a, b).select("part", "pos", r("value", "value"), "at")


@query("""
    WITH w AS (SELECT CAST(unnest(range(7)) AS INTEGER) AS worker), q AS (SELECT count(*) // 7 AS q, count(*) % 7 AS m FROM lineitem)
    SELECT worker, worker * q + least(worker, m) AS first, (worker + 1) * q + least(worker + 1, m) AS last FROM w CROSS JOIN q
""")
def worksplit(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(T.worksplit(0, table(spark, d, "lineitem").count(), 7), "worker int, first bigint, last bigint")


@query("SELECT CAST(s_nationkey AS BIGINT) AS part, count(*) AS n, CAST(coalesce(sum(count(*)) OVER (ORDER BY s_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM supplier GROUP BY s_nationkey")
def partition_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each part starts: exclusive prefix sums over one row a part."""
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    n = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("bigint").alias("part")).agg(F.count("*").alias("n"))
    return n.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0)))


@query("""
    WITH n AS (SELECT count(*) AS n FROM part), f AS (SELECT k AS split, CAST(floor(n * w) AS BIGINT) AS f, n FROM n CROSS JOIN (VALUES (0, 0.7), (1, 0.15), (2, 0.15)) t(k, w))
    SELECT split, f + CASE WHEN split < n - sum(f) OVER () THEN 1 ELSE 0 END AS n FROM f
""")
def split_exact(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of a random split into exact fractions."""
    p = table(spark, d, "part").select("p_partkey")
    return T.split_exact(p, "p_partkey", [0.7, 0.15, 0.15]).groupBy("split").agg(F.count("*").alias("n"))


@query("""
    WITH n AS (SELECT count(*) AS n FROM part)
    SELECT p_partkey, CASE WHEN row_number() OVER (ORDER BY p_partkey) <= floor(n * 0.6) + (n - floor(n * 0.6) - floor(n * 0.4)) THEN 0 ELSE 1 END AS split FROM part CROSS JOIN n
""")
def split_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Without shuffling, by key."""
    return T.split_exact(table(spark, d, "part").select("p_partkey"), "p_partkey", [0.6, 0.4], None)


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS shared FROM part")
def split_by_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Rows with equal sizes stay together: no size is in two parts."""
    s = T.split_by_parameters(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", [0.6, 0.4])
    per = s.groupBy("p_size").agg(F.countDistinct("split").alias("k"), F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n"), F.count(F.when(F.col("k") > 1, 1)).alias("shared"))


@query("""
    WITH n AS (SELECT count(*) AS n FROM supplier), k AS (SELECT unnest(range((SELECT n FROM n))) AS k), o AS (SELECT k, row_number() OVER (ORDER BY md5('7:' || k)) AS place FROM k),
         t AS (SELECT k, place <= (SELECT n * 7 // 10 FROM n) OR k = 0 OR k = (SELECT n - 1 FROM n) AS train FROM o),
         q AS (SELECT k, row_number() OVER (ORDER BY k) AS p FROM t WHERE NOT train)
    SELECT CAST(k AS INTEGER) AS pos, CASE WHEN train THEN 'train' WHEN p % 2 = 1 THEN 'valid' ELSE 'test' END AS part FROM t LEFT JOIN q USING (k)
""")
def split_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    """70 % and both ends train; the others are shared evenly."""
    return spark.createDataFrame(T.split_reconstruct(table(spark, d, "supplier").count(), 7), "pos int, part string")


NAMES = ["l_quantity", "l_extendedprice", "l_tax"]


@query("""
    WITH m AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS e, min(l_tax) AS f, max(l_tax) AS g FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((l_quantity - a) / (b - a) * 2 - 1, 6) + 0.0 AS l_quantity, round((l_extendedprice - c) / (e - c) * 2 - 1, 6) + 0.0 AS l_extendedprice,
           round((l_tax - f) / (g - f) * 2 - 1, 6) + 0.0 AS l_tax FROM lineitem CROSS JOIN m
""")
def minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *NAMES)
    return T.minmax_scale(t, T.minmax_fit(t, NAMES), -1.0, 1.0).select("l_orderkey", "l_linenumber", *(r(n, n) for n in NAMES))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity, 4) + 0.0 AS l_quantity, round(l_extendedprice, 4) + 0.0 AS l_extendedprice, round(l_tax, 4) + 0.0 AS l_tax FROM lineitem")
def minmax_inverse(spark: SparkSession, d: str) -> DataFrame:
    """There and back."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *NAMES)
    m = T.minmax_fit(t, NAMES)
    return T.minmax_inverse(T.minmax_scale(t, m, -1.0, 1.0), m, -1.0, 1.0).select("l_orderkey", "l_linenumber", *(r(n, n, 4) for n in NAMES))


CROSS = "par AS (SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS par, n_nationkey FROM nation), pt AS (SELECT vec_id AS pt, label FROM embeddings)"


def cross_of(spark: SparkSession, d: str) -> DataFrame:
    par = table(spark, d, "nation").select((F.row_number().over(Window.orderBy("n_nationkey")) - 1).cast("bigint").alias("par"), "n_nationkey")
    pt = table(spark, d, "embeddings").select(F.col("vec_id").alias("pt"), "label")
    return T.cross_samples(par, pt)


@query(f"WITH {CROSS} SELECT par * (SELECT count(*) FROM embeddings) + pt AS idx, n_nationkey, pt, label FROM par CROSS JOIN pt")
def nn_cross_index(spark: SparkSession, d: str) -> DataFrame:
    """Samples on parameters x points by their number."""
    return cross_of(spark, d).select("idx", "n_nationkey", "pt", "label")


@query(f"WITH {CROSS}, s AS (SELECT par * (SELECT count(*) FROM embeddings) + pt AS idx, n_nationkey, label FROM par CROSS JOIN pt) SELECT * FROM s WHERE idx BETWEEN 490 AND 509")
def nn_slice(spark: SparkSession, d: str) -> DataFrame:
    return T.filtered(cross_of(spark, d), F.col("idx").between(490, 509)).select("idx", "n_nationkey", "label")


@query("SELECT vec_id, label * 2 + 1 AS label FROM embeddings")
def nn_map(spark: SparkSession, d: str) -> DataFrame:
    """A function of pandas frames over all samples."""
    return T.mapped(table(spark, d, "embeddings").select("vec_id", "label"), lambda p: p.assign(label=p["label"] * 2 + 1), "vec_id bigint, label int")


@query("SELECT vec_id, label FROM embeddings WHERE label % 2 = 0")
def nn_filter(spark: SparkSession, d: str) -> DataFrame:
    return T.filtered(table(spark, d, "embeddings").select("vec_id", "label"), lambda p: p["label"] % 2 == 0)


GRID = f"{EMB}, g AS (SELECT i, CAST(j // 8 AS INTEGER) AS h, CAST(j % 8 AS INTEGER) AS w, v FROM emb)"


def grid_of(spark: SparkSession, d: str) -> DataFrame:
    return T.grid(long_of(spark, d).withColumnRenamed("j", "pos"), 8).select("i", "h", "w", "v")


@query(f"WITH {GRID} SELECT i, h, w, v FROM g WHERE h < 5 AND w < 6")
def crop(spark: SparkSession, d: str) -> DataFrame:
    return T.crop(grid_of(spark, d), h=5, w=6)


@query(f"WITH {GRID}, t AS (SELECT CAST(a.h AS INTEGER) AS h, CAST(b.w AS INTEGER) AS w FROM (SELECT unnest(range(10)) AS h) a CROSS JOIN (SELECT unnest(range(9)) AS w) b) SELECT s.i, t.h, t.w, coalesce(v, 0.0) AS v FROM (SELECT DISTINCT i FROM g) s CROSS JOIN t LEFT JOIN g ON g.i = s.i AND g.h = t.h AND g.w = t.w")
def pad(spark: SparkSession, d: str) -> DataFrame:
    return T.pad(grid_of(spark, d), "i", 10, 9)


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def concat(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return T.concatenated(a, table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))


@query("SELECT n_nationkey, n_regionkey FROM nation")
def remove_column(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return t.drop(t.columns[1])


@query("SELECT DISTINCT p_size FROM part")
def unique_parameters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_size").distinct()


SURFACE = f"{EMB}, s AS (SELECT i % 5 AS n, i, max(CASE WHEN j = 0 THEN v END) AS x, max(CASE WHEN j = 1 THEN v END) AS z, max(CASE WHEN j = 2 THEN v END) AS nx, max(CASE WHEN j = 3 THEN v END) AS ny, max(CASE WHEN j = 4 THEN v END) AS nz, max(CASE WHEN j = 5 THEN v END) AS cp, max(CASE WHEN j = 6 THEN v END) AS cfx, max(CASE WHEN j = 7 THEN v END) AS cfz FROM emb GROUP BY i)"


def surface_of(spark: SparkSession, d: str) -> DataFrame:
    names = ["x", "z", "nx", "ny", "nz", "cp", "cfx", "cfz"]
    s = rows_of(spark, d).select((F.col("row_id") % 5).alias("n"), F.col("row_id").alias("i"), *(F.element_at("x", k + 1).alias(f"_{n}") for k, n in enumerate(names)))
    return s.select("n", "i", *(F.col(f"_{n}").alias(n) for n in names))


@query(f"""
    WITH {SURFACE}, f AS (SELECT *, -cp * nx + cfx * sqrt(nx * nx + ny * ny + nz * nz) AS fx, -cp * nz + cfz * sqrt(nx * nx + ny * ny + nz * nz) AS fz, n * pi() / 180 AS a FROM s)
    SELECT n, round(sum(fz * cos(a) - fx * sin(a)) / 2.0, 6) + 0.0 AS cl, round(sum(fz * sin(a) + fx * cos(a)) / 2.0, 6) + 0.0 AS cd, round(sum(z * fx - (x - 0.25) * fz) / 3.0, 6) + 0.0 AS cm FROM f GROUP BY n
""")
def aero_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """Lift, drag and moment of five cases, their angle in degrees being their number."""
    c = aero.coefficients(surface_of(spark, d), ["n"], 2.0, 1.5, (0.25, 0.0, 0.0), F.col("n"), friction=True)
    return c.select("n", r("cl", "cl"), r("cd", "cd"), r("cm", "cm"))


@query(f"WITH {SURFACE}, a AS (SELECT *, n * pi() / 180 AS a FROM s) SELECT i, round((nx * sin(a) - nz * cos(a)) / 2.0, 6) + 0.0 AS dcl, round((-nx * cos(a) - nz * sin(a)) / 2.0, 6) + 0.0 AS dcd, round(((x - 0.25) * nz - z * nx) / 3.0, 6) + 0.0 AS dcm FROM a")
def pressure_jacobians(spark: SparkSession, d: str) -> DataFrame:
    j = aero.pressure_jacobians(surface_of(spark, d), 2.0, 1.5, (0.25, 0.0, 0.0), F.col("n"))
    return j.select("i", r("dcl", "dcl"), r("dcd", "dcd"), r("dcm", "dcm"))


@query("SELECT p_partkey AS i, p_size AS epoch, round(CASE WHEN p_size < 5 THEN 0 WHEN p_size < 20 THEN 0.1 + 0.9 * (p_size - 5) / 15 ELSE 1 END, 9) + 0.0 AS beta FROM part")
def beta_schedule(spark: SparkSession, d: str) -> DataFrame:
    """The weight of each part's size as an epoch."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").alias("epoch"), r(C.beta_schedule(F.col("p_size"), 0.1, 1.0, 5, 20), "beta", 9))


BASIS = f"{EMB}, x AS (SELECT i, j, tanh(v) AS x FROM emb)"


def basis_of(spark: SparkSession, d: str) -> DataFrame:
    return long_of(spark, d).select("i", "j", F.tanh("v").alias("x"))


@query(f"WITH {BASIS} SELECT i, j, round(x, 6) + 0.0 AS t1, round(2 * x * x - 1, 6) + 0.0 AS t2, round(4 * x ** 3 - 3 * x, 6) + 0.0 AS t3, round(8 * x ** 4 - 8 * x * x + 1, 6) + 0.0 AS t4 FROM x")
def chebyshev_basis(spark: SparkSession, d: str) -> DataFrame:
    t = C.chebyshev(F.col("x"), 4)
    return basis_of(spark, d).select("i", "j", *(r(t[k], f"t{k}") for k in range(1, 5)))


@query(f"WITH {BASIS} SELECT i, j, round(2 * x, 6) + 0.0 AS p1, round((15 * x * x - 3) / 4, 6) + 0.0 AS p2, round(7 * x ** 3 - 3 * x, 6) + 0.0 AS p3 FROM x")
def jacobi_basis(spark: SparkSession, d: str) -> DataFrame:
    p = C.jacobi(F.col("x"), 3)
    return basis_of(spark, d).select("i", "j", *(r(p[k], f"p{k}") for k in range(1, 4)))


@query(f"WITH {EMB} SELECT i, round(exp(-2.0 * (v / 0.3 - 1) ** 2), 6) + 0.0 AS factor, round(least(greatest(v, -0.1), 0.1), 6) + 0.0 AS clipped FROM emb WHERE j = 0")
def shape_constraints(spark: SparkSession, d: str) -> DataFrame:
    """The penalty of a thickness, and parameters kept within bounds."""
    v = F.element_at("x", 1)
    return rows_of(spark, d).select(F.col("row_id").alias("i"), r(C.thickness_factor(v, 0.3, 2.0), "factor"), r(C.clip(v, -0.1, 0.1), "clipped"))


@query(f"WITH {EMB}, e AS (SELECT i, sum(v * v) AS e FROM emb GROUP BY i) SELECT i, round(sum(e) OVER (ORDER BY i) / sum(e) OVER (), 6) + 0.0 AS share FROM e")
def cumulative_energy(spark: SparkSession, d: str) -> DataFrame:
    """A running share over all rows: ranges of keys run on their own, from the sums of those before."""
    e = rows_of(spark, d).select(F.col("row_id").alias("i"), (C.vector_norm("x") ** 2).alias("e"))
    return T.running_share(e, "i", "e").select("i", r("share", "share"))


@query("SELECT n_nationkey AS id, n_name AS label, CAST(n_regionkey * 2 AS INTEGER) AS twice FROM nation")
def edit_fields(spark: SparkSession, d: str) -> DataFrame:
    """A field renamed, one deleted, one added."""
    t = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return t.withColumnsRenamed({"n_nationkey": "id", "n_name": "label"}).withColumn("twice", (F.col("n_regionkey") * 2).cast("int")).drop("n_regionkey")


@query("""
    WITH v AS (SELECT event_id, event_type AS g, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS v FROM events)
    SELECT g, round(sum(v), 4) + 0.0 AS total, min(v) AS low, max(v) AS high, arg_min(event_id, (v, event_id)) FILTER (WHERE v IS NOT NULL) AS at_low, count(v) AS n FROM v GROUP BY g
""")
def reductions(spark: SparkSession, d: str) -> DataFrame:
    """Sum, least, most and the place of the least by group; NaN is left out, ties go to the first."""
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("g"), F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("v"))
    v = F.when(~F.isnan("v"), F.col("v"))
    low = F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), "event_id")))
    return e.groupBy("g").agg(r(F.sum(v), "total", 4), F.min(v).alias("low"), F.max(v).alias("high"), low["event_id"].alias("at_low"), F.count(v).alias("n"))


@query("SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
def running_best(spark: SparkSession, d: str) -> DataFrame:
    """The least value so far, by series."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.min("value").over(w).alias("best"))


@query(f"WITH {EMB} SELECT i, j, round(sqrt(sum(v * v) OVER (PARTITION BY i ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / sum(v * v) OVER (PARTITION BY i)), 6) + 0.0 AS residual FROM emb")
def residual_curve(spark: SparkSession, d: str) -> DataFrame:
    """What is left out of each row's entries after each: a running sum from the end, without a shuffle."""
    e = rows_of(spark, d).select(F.col("row_id").alias("i"), F.posexplode(C.residual_curve("x")).alias("j", "residual"))
    return e.select("i", "j", r("residual", "residual"))


@query("SELECT event_type, arg_max(value, (abs(value), value)) AS value FROM events GROUP BY event_type")
def reduced_by_any_operation(spark: SparkSession, d: str) -> DataFrame:
    """The value of largest modulus of each kind, by an operation of two values."""
    e = table(spark, d, "events").select("event_type", "value")
    return T.reduced(e, "event_type", "value", lambda a, b: max(a, b, key=lambda v: (abs(v), v)))


@query("SELECT DISTINCT vec_id % 7 AS point FROM embeddings")
def unique_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that parts share, once."""
    return table(spark, d, "embeddings").select((F.col("vec_id") % 7).alias("point")).distinct()
