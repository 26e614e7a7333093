"""Registration of queries, and the inputs that they share, for Spark and as DuckDB common tables."""

from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matrix as M
from ..functions.columns import rounded
from ..functions.lineage import scratch
from ..operators.tables import ranked

__all__ = ["EMB", "FLAGS", "MONTH", "MONTHS", "ORACLE_SQL", "QUERIES", "STATUS", "entries", "flag_rows", "long_of", "month_cells", "month_rows", "numbered_vectors", "query", "r", "rows_of", "scratch", "squared", "status_rows", "table", "vectors_as_columns"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = dedent(sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a matrix of rows."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x"))


def long_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.to_long(rows_of(spark, sf_dir))


def vectors_as_columns(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as snapshots: a row for each of their components, a column for each vector, in order of vec_id."""
    v = rows_of(spark, d)
    n = v.count()
    long = v.select(F.posexplode("x").alias("i", "v"), F.col("row_id").cast("int").alias("j"))
    return M.of_width(M.to_rows(long.select(F.col("i").cast("long").alias("i"), "j", "v")), n)


def numbered_vectors(spark: SparkSession, d: str) -> DataFrame:
    """i, x: the embeddings by their place in order of vec_id, as rows."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = v.agg(F.min("vec_id").alias("low"), F.max("vec_id").alias("high"), F.count("*").alias("n")).first()
    if b["n"] and b["high"] - b["low"] + 1 == b["n"]:
        return v.select((F.col("vec_id") - b["low"]).cast("long").alias("i"), "x")
    return ranked(v, "vec_id", None, b["n"]).select(F.col("rank").cast("long").alias("i"), "x")


EMB = "emb AS (SELECT vec_id AS i, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"

MONTHS = 83


def month_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by part and month: i, j, v."""
    li = table(spark, sf_dir, "lineitem")
    j = (F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1
    return li.select(F.col("l_partkey").alias("i"), j.cast("int").alias("j"), F.col("l_quantity").alias("v")).filter(F.col("j").between(0, MONTHS - 1))


def month_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part x month matrix, 0 where nothing was shipped."""
    return M.dense_rows(month_cells(spark, sf_dir), MONTHS)


MONTH = f"""cells AS (SELECT l_partkey AS i, CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS INTEGER) AS j, sum(l_quantity) AS v
             FROM lineitem GROUP BY ALL),
     x AS (SELECT i, j, coalesce(v, 0.0) AS v FROM (SELECT DISTINCT i FROM cells WHERE j BETWEEN 0 AND {MONTHS - 1})
           CROSS JOIN (SELECT CAST(unnest(range({MONTHS})) AS INTEGER) AS j) LEFT JOIN cells USING (i, j))"""


def status_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by part and line status (F, O): a matrix of two columns, whose factors SQL has in closed form."""
    of = lambda s: F.sum(F.when(F.col("l_linestatus") == s, F.col("l_quantity")).otherwise(0.0))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("row_id")).agg(F.array(of("F"), of("O")).alias("x"))


def flag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by part and return flag (A, N, R): three columns, taken as snapshots."""
    of = lambda s: F.sum(F.when(F.col("l_returnflag") == s, F.col("l_quantity")).otherwise(0.0))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("row_id")).agg(F.array(*map(of, "ANR")).alias("x"))


def by_case(column: str, names: dict[str, str]) -> str:
    return ", ".join(f"sum(CASE WHEN {column} = '{v}' THEN l_quantity ELSE 0 END) AS {n}" for n, v in names.items())


#: Rows, moments, and the unit right vector (p, q) and squares (l1, l2) of singular values.
STATUS = f"""st AS (SELECT l_partkey AS i, {by_case("l_linestatus", {"a": "F", "b": "O"})} FROM lineitem GROUP BY 1),
     mo AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM st),
     la AS (SELECT *, (aa + bb) / 2 + sqrt(((aa - bb) / 2) ** 2 + ab * ab) AS l1, (aa * bb - ab * ab) / ((aa + bb) / 2 + sqrt(((aa - bb) / 2) ** 2 + ab * ab)) AS l2 FROM mo),
     ei AS (SELECT *, ab / sqrt(ab * ab + (l1 - aa) ** 2) AS p, (l1 - aa) / sqrt(ab * ab + (l1 - aa) ** 2) AS q FROM la)"""

#: Rows, moments, and the combination c1 a + c2 b of the first two snapshots that is nearest to the third.
FLAGS = f"""fl AS (SELECT l_partkey AS i, {by_case("l_returnflag", {"a": "A", "b": "N", "c": "R"})} FROM lineitem GROUP BY 1),
     fm AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * c) AS ac, sum(b * c) AS bc FROM fl),
     co AS (SELECT *, (bb * ac - ab * bc) / (aa * bb - ab * ab) AS c1, (aa * bc - ab * ac) / (aa * bb - ab * ab) AS c2 FROM fm)"""


def squared(matrix: str, steps: int = 16, name: str = "p", last: str = "lead_") -> str:
    """``name`` (k, i, j, v): a symmetric matrix (a table i, j, v) squared again and again, of trace 1: the ``last`` one is
    the outer product of its leading eigenvector with itself."""
    return f"""{name}(k, i, j, v) AS (
         SELECT 0, i, j, v / (SELECT sum(v) FROM {matrix} WHERE i = j) FROM {matrix}
         UNION ALL SELECT k + 1, i, j, v / sum(CASE WHEN i = j THEN v ELSE 0 END) OVER ()
         FROM (SELECT x.k AS k, x.i AS i, y.j AS j, sum(x.v * y.v) AS v FROM {name} x JOIN {name} y ON x.j = y.i GROUP BY x.k, x.i, y.j) WHERE k < {steps}),
     {last} AS (SELECT i, j, v FROM {name} WHERE k = {steps})"""


def entries(rows: DataFrame, digits: int = 6) -> DataFrame:
    """i, j, v of array rows, for comparison."""
    return rows.select(F.col("row_id").alias("i"), F.posexplode("x").alias("j", "v")).select("i", "j", r("v", "v", digits))


def r(c: Column | str, name: str, digits: int = 6) -> Column:
    return rounded(F.col(c) if isinstance(c, str) else c, digits).alias(name)
