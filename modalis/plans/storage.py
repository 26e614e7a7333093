"""Sources, sinks and streams: what is written is read back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matrix as M
from ..functions.lineage import cut
from ..operators import linalg as L
from ..operators import modal, surrogates
from ..operators import tables as T
from ..sources import layout
from ..streaming import append, sketch
from .base import EMB, FLAGS, STATUS, entries, flag_rows, long_of, query, r, rows_of, scratch, status_rows, table
from .data import fields_of
from .decompositions import RECONSTRUCTED, SPOD_MODES, two_blocks
from .geometry import C2, P2, cells2, points2
from .models import given_weights, layer_sql


def dataset_of(spark: SparkSession, d: str) -> layout.Dataset:
    f = fields_of(spark, d)
    points = f.select("point_id").distinct().select("point_id", F.col("point_id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    axes = spark.range(32).select(F.lit("time").alias("axis"), F.lit(0).alias("idim"), F.col("id").cast("int").alias("pos"), (F.col("id") * 0.2).alias("value"))
    return layout.Dataset(points, axes, f)


@query(f"WITH {EMB} SELECT i AS point_id, CAST(j % 32 AS INTEGER) AS t, v FROM emb WHERE j >= 32")
def save_load_dataset(spark: SparkSession, d: str) -> DataFrame:
    """One field of a saved dataset: other fields' files aren't read."""
    path = scratch(spark)
    dataset_of(spark, d).save(path)
    return layout.Dataset.load(spark, path, ["b"]).fields.select("point_id", "t", "v")


@query(f"WITH {EMB} SELECT CAST(j // 16 % 2 AS INTEGER) AS part, count(*) AS n, round(sum(v), 4) + 0.0 AS s FROM emb GROUP BY 1")
def append_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Two parts of time, written one after the other."""
    path, ds = scratch(spark), dataset_of(spark, d)
    for part in (0, 1):
        here = F.floor(F.col("t") / 16) == part
        layout.Dataset(ds.points, ds.axes, ds.fields.filter(here)).save(path, part, part > 0)
    return layout.Dataset.load(spark, path).fields.groupBy("part").agg(F.count("*").alias("n"), r(F.sum("v"), "s", 4))


@query("SELECT 'price' AS axis, 1 AS idim, CAST(p_partkey AS INTEGER) AS pos, p_retailprice AS value FROM part")
def load_variables(spark: SparkSession, d: str) -> DataFrame:
    """One axis of a saved dataset with two: the parts' prices."""
    path, ds = scratch(spark), dataset_of(spark, d)
    prices = table(spark, d, "part").select(F.lit("price").alias("axis"), F.lit(1).alias("idim"), F.col("p_partkey").cast("int").alias("pos"), F.col("p_retailprice").alias("value"))
    layout.Dataset(ds.points, ds.axes.unionByName(prices), ds.fields).save(path)
    return layout.Dataset.load(spark, path, variables=["price"]).axes.select("axis", "idim", "pos", "value")


@query(f"""
    WITH {EMB} SELECT i AS point_id, CAST(j % 32 AS INTEGER) AS t, round(j % 32 * 0.2::DOUBLE, 9) + 0.0 AS time, CAST(i AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS z, max(CASE WHEN j >= 32 THEN v END) AS b, max(CASE WHEN j < 32 THEN v END) AS a
    FROM emb GROUP BY i, j % 32
""")
def nn_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Samples for a network from a saved dataset: fields beside their variables and the mesh's coordinates."""
    path = scratch(spark)
    dataset_of(spark, d).save(path)
    return layout.Dataset.load(spark, path).samples(["b", "a"], ["time"]).withColumn("time", r("time", "time", 9))


@query("SELECT vec_id AS point_id, CAST(vec_id AS DOUBLE) AS x FROM embeddings")
def save_unique_points(spark: SparkSession, d: str) -> DataFrame:
    """Points that two parts share are written once."""
    path, ds = scratch(spark), dataset_of(spark, d)
    layout.Dataset(ds.points.unionByName(ds.points), ds.axes, ds.fields).save_unique(path, "point_id")
    return layout.Dataset.load(spark, path).points.select("point_id", "x")


@query(f"WITH {P2}, {C2} SELECT cell_id, CAST(node AS INTEGER) AS first, round(x, 9) + 0.0 AS x, round(y, 9) + 0.0 AS y, h FROM c2 JOIN p2 ON node = point_id WHERE k = 0")
def save_load_mesh(spark: SparkSession, d: str) -> DataFrame:
    """Cells with the places of their first nodes, of the mesh of the parts."""
    path = scratch(spark)
    layout.save_mesh(points2(spark, d), cells2(spark, d), path)
    points, cells = layout.load_mesh(spark, path)
    c = cells.select("cell_id", F.element_at("nodes", 1).alias("first"))
    return c.join(points, F.col("first") == F.col("point_id")).select("cell_id", "first", r("x", "x", 9), r("y", "y", 9), "h")


@query(f"WITH {STATUS} SELECT i, CAST(j AS INTEGER) AS j, round((a * p + b * q) * CASE j WHEN 0 THEN p ELSE q END, 5) + 0.0 AS v FROM st CROSS JOIN ei CROSS JOIN (SELECT unnest([0, 1]) AS j)")
def save_load_modes(spark: SparkSession, d: str) -> DataFrame:
    """The reconstruction by the first mode of a saved decomposition: others aren't read."""
    path = scratch(spark)
    layout.save_modes(modal.pod(status_rows(spark, d), remove_mean=False), path)
    return entries(modal.reconstruct(layout.load_modes(spark, path, 1)), 5)


@query(RECONSTRUCTED)
def save_load_dynamics(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots from saved dynamic modes, eigenvalues and amplitudes."""
    path = scratch(spark)
    layout.save_dynamics(modal.dmd(flag_rows(spark, d), 2, remove_mean=False), path)
    return entries(modal.dmd_reconstruct(layout.load_dynamics(spark, path), np.arange(3.0)), 4)


@query(SPOD_MODES)
def save_load_spectral(spark: SparkSession, d: str) -> DataFrame:
    """Modes of the three strongest frequencies of a saved spectral decomposition."""
    path = scratch(spark)
    layout.save_spectral(two_blocks(spark, d), path)
    e = modal.extract_spectral(layout.load_spectral(spark, path, 3), 2, 2, [1, 3])
    return e.select("point", r(F.element_at("x", 1), "a", 5), r(F.element_at("x", 2), "b", 5))


@query(f"WITH {STATUS} SELECT i, CAST(j AS INTEGER) AS j, round(CASE j WHEN 0 THEN a / sqrt(aa) ELSE (b - ab / aa * a) / sqrt(bb - ab * ab / aa) END, 6) + 0.0 AS v FROM st CROSS JOIN mo CROSS JOIN (SELECT unnest([0, 1]) AS j)")
def save_load_factors(spark: SparkSession, d: str) -> DataFrame:
    """Q of a saved factorisation, from which R is subtracted again: Q R R^-1."""
    path = scratch(spark)
    q, small = L.orthonormal(status_rows(spark, d))
    layout.save_tall(L.times(q, small), f"{path}/qr")
    layout.save_small(spark, f"{path}/small", r=small)
    return entries(L.times(layout.load_tall(spark, f"{path}/qr"), np.linalg.inv(layout.load_small(spark, f"{path}/small")["r"])))


POLAR = "p AS (SELECT p_size AS k, p_partkey % 3 AS a, avg(p_retailprice) AS cp FROM part GROUP BY ALL)"


@query(f"WITH {POLAR} SELECT CAST(k AS DOUBLE) AS x, round(max(CASE WHEN a = 0 THEN cp END), 3) + 0.0 AS a0, round(max(CASE WHEN a = 1 THEN cp END), 3) + 0.0 AS a1, round(max(CASE WHEN a = 2 THEN cp END), 3) + 0.0 AS a2 FROM p GROUP BY k")
def tsv_polars(spark: SparkSession, d: str) -> DataFrame:
    """Tab-separated polars, regrouped by case."""
    path = scratch(spark)
    p = table(spark, d, "part").groupBy(F.lit(1.0).alias("re"), (F.col("p_partkey") % 3).cast("double").alias("alpha"), F.col("p_size").cast("double").alias("x"), F.lit(0.0).alias("y")).agg(F.avg("p_retailprice").alias("cp"))
    p.write.csv(path, sep="\t")
    m = layout.polar_matrix(layout.read_polars(spark, path), [(1.0, 0.0), (1.0, 1.0), (1.0, 2.0)])
    return m.select("x", *(r(F.col(f"`1.0:{k}.0`"), f"a{k}", 3) for k in range(3)))


@query("SELECT n_nationkey, n_name FROM nation")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    layout.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.csv(path, header=True, schema="n_nationkey int, n_name string")


@query("SELECT 'l_quantity' AS name, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax) FROM lineitem")
def scaler_json(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    layout.save_scaler(spark, T.minmax_fit(table(spark, d, "lineitem"), ["l_quantity", "l_tax"]), path)
    return spark.createDataFrame([(n, a, b) for n, (a, b) in layout.load_scaler(spark, path).items()], "name string, low double, high double")


@query(f"WITH {EMB} SELECT j AS t, CAST(5 + 3 + 2 * count(*) AS BIGINT) AS lines, round(sum(v), 6) + 0.0 AS total FROM emb GROUP BY j")
def vtk_files(spark: SparkSession, d: str) -> DataFrame:
    """One folder a time for viewers: head, places, head, values."""
    path = scratch(spark)
    v = long_of(spark, d).select(F.col("j").alias("t"), F.col("i").alias("point_id"), "v")
    layout.write_vtk(dataset_of(spark, d).points, v, path, 400)
    value = F.when(F.col("part").startswith("3-"), F.col("value").cast("double"))
    return spark.read.text(path).groupBy("t").agg(F.count("*").alias("lines"), r(F.sum(value), "total"))


COLUMNS = f"WITH {FLAGS} SELECT i, CAST(j AS INTEGER) AS j, round(CASE j WHEN 0 THEN a WHEN 1 THEN b ELSE c END, 4) + 0.0 AS v FROM fl CROSS JOIN (SELECT unnest([0, 1, 2]) AS j)"


@query(COLUMNS)
def qr_streaming(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of two and one columns in turn: Q B gives all of them back."""
    rows = flag_rows(spark, d)
    s = sketch.start(rows.select("row_id", F.slice("x", 1, 2).alias("x")), 3, 1, 7)
    s = sketch.update(s, rows.select("row_id", F.slice("x", 3, 1).alias("x")), 3, 1, 7)
    return entries(L.times(s.q, s.b), 4)


@query(COLUMNS)
def qr_stream_query(spark: SparkSession, d: str) -> DataFrame:
    """The same as a structured stream over files, one block a micro-batch, with empty ones before, between and behind; the last
    version is read back. A block is as many files as there are tasks: the stream takes all that has come since its last run."""
    path = scratch(spark)
    rows = cut(flag_rows(spark, d))

    def write(df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("row_id bigint, x array<double>").parquet(f"{path}/in").filter("row_id >= 0")
        sketch.run(stream, f"{path}/out", f"{path}/state", 3, 1, 3)

    none = rows.select((-1 - F.col("row_id")).alias("row_id"), "x")
    for first, n in ((1, 2), (3, 1)):
        write(none)
        write(rows.select("row_id", F.slice("x", first, n).alias("x")))
    write(none)
    last = sketch.latest(spark, f"{path}/out")
    return entries(L.times(last.q, last.b), 4)


@query(f"""
    WITH {FLAGS}, v AS (SELECT i, CAST(j AS INTEGER) AS j, CASE j WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS v FROM fl CROSS JOIN (SELECT unnest([0, 1, 2]) AS j))
    SELECT i, j, round(CASE WHEN j = 0 AND i % 2 = 0 THEN v + 1 ELSE v END, 4) + 0.0 AS v FROM v
""")
def append_stream(spark: SparkSession, d: str) -> DataFrame:
    """Instants that arrive one after another; then nothing; then corrections of the first one, which are late. The last batch is
    run twice. A micro-batch is all files that have come since the last one, as many as there were tasks."""
    path = scratch(spark)
    field = M.to_long(cut(flag_rows(spark, d))).select(F.col("i").alias("row_id"), F.col("j").alias("t"), "v")
    late = field.filter("t = 0 and row_id % 2 = 0").withColumn("v", F.col("v") + 1)
    for part in (field.filter("t = 0"), field.filter("t = 1"), field.filter("t = 2"), field.filter("t = 9"), late):
        part.write.mode("append").parquet(f"{path}/in")
        append.run(spark.readStream.schema(append.VALUES).parquet(f"{path}/in"), f"{path}/out", f"{path}/state")
    append.take(late, append.batches(spark, f"{path}/out")[-1], f"{path}/out")
    return append.read(spark, f"{path}/out").select(F.col("row_id").alias("i"), F.col("t").alias("j"), r("v", "v", 4))


@query(f"WITH {EMB} SELECT i, j, v FROM emb")
def matrix_forms(spark: SparkSession, d: str) -> DataFrame:
    """Rows to entries and back."""
    return M.to_long(M.to_rows(long_of(spark, d)))


LAYER = layer_sql(["x"], 3, 0, True)


@query(f"WITH h AS (SELECT c_custkey, {', '.join(f'{e} AS h{k}' for k, e in enumerate(LAYER))} FROM (SELECT c_custkey, c_acctbal / 1000 AS x FROM customer)) SELECT c_custkey, round({layer_sql(['h0', 'h1', 'h2'], 1, 1, False)[0]}, 6) + 0.0 AS p FROM h")
def model_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """A perceptron that is written, read back, and applied to every customer."""
    path = scratch(spark)
    layout.save_model(spark, path, given_weights(1, 3, 1), {"rate": 0.01, "epochs": 20})
    weights, settings = layout.load_model(spark, path)
    model = surrogates.Perceptron((3,), int(settings["epochs"]), weights=weights)
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"))
    return surrogates.predict_rows(rows, ["x"], model, ["q"]).select("c_custkey", r("q", "p"))
