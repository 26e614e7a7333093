"""Training over all rows of a table. The statements make the same steps: slopes as averages, parameters as columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import training as T
from .base import query, r, table

LINES = "li AS (SELECT l_quantity / 25 - 1 AS x0, l_discount * 20 - 1 AS x1, l_extendedprice / 100000 AS y FROM lineitem)"
STEPS, RATE = 3, 0.05


def lines(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return T.samples(li, [F.col("l_quantity") / 25 - 1, F.col("l_discount") * 20 - 1], [F.col("l_extendedprice") / 100000])


def given(n: int) -> np.ndarray:
    """Parameters to start from, by a rule that SQL can spell."""
    return np.sin(1.0 + np.arange(n)) / 2


def adam_sql(n: int, layers: list[str], loss: str, slopes: list[str]) -> str:
    """Steps of Adam for ``n`` parameters t0, t1, ...: ``layers`` are what each row's values are made of, one nested query each."""
    each = lambda f: ", ".join(f(i) for i in range(n))
    out = [LINES, f"p0 AS (SELECT {each(lambda i: f'sin({i + 1}) / 2 AS t{i}, 0.0::DOUBLE AS m{i}, 0.0::DOUBLE AS v{i}')})"]
    for k in range(1, STEPS + 1):
        rows = f"(SELECT * FROM li CROSS JOIN p{k - 1})"
        for layer in layers:
            rows = f"(SELECT *, {layer} FROM {rows})"
        new = each(lambda i, k=k: f"t{i} - {RATE} * (m{i} / {1 - 0.9**k!r}) / (sqrt(v{i} / {1 - 0.999**k!r}) + 1e-8) AS t{i}, m{i}, v{i}")
        out += [
            f"g{k} AS (SELECT avg({loss}) AS loss, {', '.join(f'avg({s}) AS g{i}' for i, s in enumerate(slopes))} FROM {rows})",
            f"p{k} AS (SELECT {new} FROM (SELECT {each(lambda i: f't{i}, 0.9 * m{i} + 0.1 * g{i} AS m{i}, 0.999 * v{i} + 0.001 * g{i} * g{i} AS v{i}')} FROM p{k - 1} CROSS JOIN g{k}))",
        ]
    rows = " UNION ALL ".join([*(f"SELECT {k} AS step, -1 AS k, loss AS v FROM g{k}" for k in range(1, STEPS + 1)), *(f"SELECT {STEPS}, {i}, t{i} FROM p{STEPS}" for i in range(n))])
    return f"WITH {', '.join(out)} SELECT CAST(step AS INTEGER) AS step, CAST(k AS INTEGER) AS k, round(v, 7) + 0.0 AS v FROM ({rows})"


def trained_rows(spark: SparkSession, t: T.Trained) -> DataFrame:
    """step, k, v: the loss before each step (k = -1), and the parameters after the last one."""
    rows = [(i + 1, -1, float(x)) for i, x in enumerate(t.losses)] + [(STEPS, k, float(x)) for k, x in enumerate(t.theta)]
    return spark.createDataFrame(rows, "step int, k int, w double").select("step", "k", r("w", "v", 7))


#: Two inputs, three hidden values, one output: weights of the first layer t0 to t5, biases to t8, weights to t11, bias t12.
MLP_SLOPES = [f"2 * e * t{9 + j} * (1 - h{j} * h{j}) * x{i}" for i in range(2) for j in range(3)] + [f"2 * e * t{9 + j} * (1 - h{j} * h{j})" for j in range(3)] + [f"2 * e * h{j}" for j in range(3)] + ["2 * e"]
MLP_LAYERS = [", ".join(f"tanh(x0 * t{j} + x1 * t{3 + j} + t{6 + j}) AS h{j}" for j in range(3)), "h0 * t9 + h1 * t10 + h2 * t11 + t12 - y AS e"]


@query(adam_sql(13, MLP_LAYERS, "e * e", MLP_SLOPES))
def mlp_fit(spark: SparkSession, d: str) -> DataFrame:
    """Steps of training over all lines: each is one pass, and no row comes to the driver."""
    net = T.Dense((2, 3, 1))
    return trained_rows(spark, T.adam(lines(spark, d), net, STEPS, T.Adam(RATE), theta=given(13)))


#: Two inputs, two hidden values, one output, functions 1, u and 2 u u - 1 of u = tanh: coefficient (i, o, f) of the first
#: layer is t(6 i + 3 o + f), (i, f) of the second t(12 + 3 i + f).
BASIS = ["1", "{u}", "(2 * {u} * {u} - 1)"]
KAN_LAYERS = [
    "tanh(x0) AS u0, tanh(x1) AS u1",
    ", ".join("tanh(" + " + ".join(f"t{6 * i + 3 * o + f} * {b.format(u=f'u{i}')}" for i in range(2) for f, b in enumerate(BASIS)) + f") AS w{o}" for o in range(2)),
    " + ".join(f"t{12 + 3 * i + f} * {b.format(u=f'w{i}')}" for i in range(2) for f, b in enumerate(BASIS)) + " - y AS e",
]
KAN_SLOPES = [f"2 * e * (t{13 + 3 * o} + 4 * w{o} * t{14 + 3 * o}) * (1 - w{o} * w{o}) * {b.format(u=f'u{i}')}" for i in range(2) for o in range(2) for b in BASIS] + [f"2 * e * {b.format(u=f'w{i}')}" for i in range(2) for b in BASIS]


@query(adam_sql(18, KAN_LAYERS, "e * e", KAN_SLOPES))
def kan_fit(spark: SparkSession, d: str) -> DataFrame:
    """The same for a network of polynomials."""
    net = T.Functions((2, 2, 1), 2)
    return trained_rows(spark, T.adam(lines(spark, d), net, STEPS, T.Adam(RATE), theta=given(18)))


#: Three values through one and back: t0 to t2 and t3 make the code, t4 to t6 weights and t7 to t9 biases of what is decoded.
CODER_LAYERS = ["tanh(x0 * t0 + x1 * t1 + y * t2 + t3) AS h", "h * t4 + t7 - x0 AS e0, h * t5 + t8 - x1 AS e1, h * t6 + t9 - y AS e2", "2 * (e0 * t4 + e1 * t5 + e2 * t6) / 3 * (1 - h * h) AS s"]
CODER_SLOPES = ["s * x0", "s * x1", "s * y", "s", *(f"2 * e{k} / 3 * h" for k in range(3)), *(f"2 * e{k} / 3" for k in range(3))]


@query(adam_sql(10, CODER_LAYERS, "(e0 * e0 + e1 * e1 + e2 * e2) / 3", CODER_SLOPES))
def autoencoder_fit(spark: SparkSession, d: str) -> DataFrame:
    """The same for a network that gives back what goes in."""
    both = lines(spark, d).select(F.concat("x", "y").alias("x")).withColumn("y", F.col("x"))
    return trained_rows(spark, T.adam(both, T.Dense((3, 1, 3)), STEPS, T.Adam(RATE), theta=given(10)))
