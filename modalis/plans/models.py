"""Surrogate models and their parts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import episodes, gp
from ..operators import surrogates as S
from ..operators.sparse_gp import SparseFidelities, SparseProcess, predicted, sums_of
from ..operators.training import samples
from ..sources import layout
from .base import EMB, entries, query, r, rows_of, scratch, table


#: Parts as samples: two inputs and an output.
PARTS = "pa AS (SELECT p_partkey AS i, p_size / 25.0::DOUBLE - 1 AS x0, (p_partkey % 37) / 18.5::DOUBLE - 1 AS x1, p_retailprice / 1000 AS y FROM part)"


def parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("i"), (F.col("p_size") / 25 - 1).alias("x0"), ((F.col("p_partkey") % 37) / 18.5 - 1).alias("x1"), (F.col("p_retailprice") / 1000).alias("y"))


#: Lines as training rows, two inducing points at the ends of the parts' sizes, variance 1, length scale 0.8, noise 0.01:
#: covariances of every row with both, and what they add up to.
NOISE, JITTER = 0.01, 1e-10
TWO = f"""{PARTS}, li AS (SELECT l_quantity / 25 - 1 AS x0, l_extendedprice / 100000 AS y FROM lineitem), ends AS (SELECT min(x0) AS a, max(x0) AS b FROM pa),
     ka AS (SELECT i, y, exp(-0.5 * ((x0 - a) / 0.8) ** 2) AS ka, exp(-0.5 * ((x0 - b) / 0.8) ** 2) AS kb FROM pa CROSS JOIN ends),
     tr AS (SELECT y, exp(-0.5 * ((x0 - a) / 0.8) ** 2) AS ka, exp(-0.5 * ((x0 - b) / 0.8) ** 2) AS kb FROM li CROSS JOIN ends), o AS (SELECT exp(-0.5 * ((a - b) / 0.8) ** 2) AS o, 1 + {JITTER}::DOUBLE AS d FROM ends)"""
THETA = np.log([1.0, 0.8])


def inverse(table: str, name: str) -> str:
    """The sums of a table of covariances and outputs, and the inverse (p, q; q, s) of the covariance of the points plus the sums
    over the noise, and the weights wa and wb of the mean."""
    return f"""{name}1 AS (SELECT d + aa / {NOISE} AS p, o + ab / {NOISE} AS q, d + bb / {NOISE} AS s, ay, by_ FROM o CROSS JOIN (SELECT sum(ka * ka) AS aa, sum(ka * kb) AS ab, sum(kb * kb) AS bb, sum(ka * y) AS ay, sum(kb * y) AS by_ FROM {table})),
     {name} AS (SELECT s / (p * s - q * q) AS ip, -q / (p * s - q * q) AS iq, p / (p * s - q * q) AS is_, (s * ay - q * by_) / (p * s - q * q) / {NOISE} AS wa, (p * by_ - q * ay) / (p * s - q * q) / {NOISE} AS wb FROM {name}1)"""


def two_points(spark: SparkSession, d: str) -> np.ndarray:
    return np.array(parts(spark, d).agg(F.min("x0"), F.max("x0")).first(), float)[:, None]


def line_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_quantity") / 25 - 1).alias("x0"), (F.col("l_extendedprice") / 100000).alias("y"))


@query(f"""
    WITH {TWO}, {inverse("tr", "iv")}
    SELECT i, round(ka * wa + kb * wb, 6) + 0.0 AS mean,
        round(sqrt(1 - (d * (ka * ka + kb * kb) - 2 * o * ka * kb) / (d * d - o * o) + ip * ka * ka + 2 * iq * ka * kb + is_ * kb * kb + {NOISE}), 6) + 0.0 AS std FROM ka CROSS JOIN iv CROSS JOIN o
""")
def gpr_predict(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation at every part of a process that is given all lines, through two points."""
    model = SparseProcess("rbf", NOISE, jitter=JITTER).condition(line_rows(spark, d), ["x0"], "y", two_points(spark, d), THETA)
    return model.predict_rows(parts(spark, d).select("i", "x0"), ["x0"]).select("i", r("mean", "mean"), r("std", "std"))


@query(f"""
    WITH {TWO}, {inverse("tr", "lo")}, be AS (SELECT i, ka, kb, y, ka * wa + kb * wb AS f FROM ka CROSS JOIN lo), rh AS (SELECT sum(f * y) / sum(f * f) AS rho FROM be),
         re AS (SELECT ka, kb, y - rho * f AS y FROM be CROSS JOIN rh), {inverse("re", "hi")}
    SELECT i, round(rho * f + ka * wa + kb * wb, 6) + 0.0 AS p FROM be CROSS JOIN rh CROSS JOIN hi
""")
def gpr_multifidelity(spark: SparkSession, d: str) -> DataFrame:
    """The parts' prices as a high fidelity on top of the lines' ones."""
    z = two_points(spark, d)
    model = SparseFidelities("rbf", NOISE, JITTER).fit([line_rows(spark, d), parts(spark, d)], ["x0"], "y", [z, z], THETA)
    return predicted(parts(spark, d).select("i", "x0"), ["x0"], model, "m", "s").select("i", r("m", "p"))


SCALES = [0.2, 0.5, 0.8, 1.5, 3.0]


@query(f"""
    WITH {PARTS}, li AS (SELECT l_quantity / 25 - 1 AS x0, l_extendedprice / 100000 AS y FROM lineitem), ends AS (SELECT min(x0) AS a, max(x0) AS b FROM pa),
         sc AS (SELECT unnest([{", ".join(f"{s}::DOUBLE" for s in SCALES)}]) AS scale),
         tr AS (SELECT scale, y, exp(-0.5 * ((x0 - a) / scale) ** 2) AS ka, exp(-0.5 * ((x0 - b) / scale) ** 2) AS kb FROM li CROSS JOIN ends CROSS JOIN sc),
         su AS (SELECT scale, sum(ka * ka) AS aa, sum(ka * kb) AS ab, sum(kb * kb) AS bb, sum(ka * y) AS ay, sum(kb * y) AS by_, count(*) AS n, sum(y * y) AS yy FROM tr GROUP BY scale),
         m AS (SELECT *, exp(-0.5 * ((a - b) / scale) ** 2) AS o, 1 + {JITTER}::DOUBLE AS d FROM su CROSS JOIN ends),
         f AS (SELECT *, d + aa / {NOISE} AS p, o + ab / {NOISE} AS q, d + bb / {NOISE} AS s FROM m)
    SELECT scale, round((0.5 * (n * ln({NOISE}) + yy / {NOISE} - (s * ay * ay - 2 * q * ay * by_ + p * by_ * by_) / (p * s - q * q) / {NOISE} / {NOISE}) + 0.5 * ln((p * s - q * q) / (d * d - o * o))
        + (n - (d * aa - 2 * o * ab + d * bb) / (d * d - o * o)) / (2 * {NOISE})) / n, 6) + 0.0 AS bound FROM f
""")
def gpr_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """The bound of the likelihood, by row, for several length scales in one pass over all lines."""
    model, z = SparseProcess("rbf", NOISE, jitter=JITTER), two_points(spark, d)
    found = sums_of(samples(line_rows(spark, d), ["x0"], ["y"]), z, "rbf", [np.log([s]) for s in SCALES])
    rows = []
    for scale, s in zip(SCALES, found, strict=True):
        model.z = z
        model.settle(np.log([scale]))
        rows.append((scale, model.bound(s, model.spectrum(s), 1.0, NOISE) / s.n))
    return spark.createDataFrame(rows, "scale double, b double").select("scale", r("b", "bound"))


KERNEL_SQL = {
    "rbf": "exp(-0.5 * h * h)", "matern32": "(1 + sqrt(3) * h) * exp(-sqrt(3) * h)", "matern52": "(1 + sqrt(5) * h + 5.0::DOUBLE / 3 * h * h) * exp(-sqrt(5) * h)", "exponential": "exp(-h)", "linear": "a * b / 0.49::DOUBLE",
    "rational_quadratic": "pow(1 + h * h / 3, -1.5)", "polynomial": "pow(a * b / 0.49::DOUBLE + 1.5, 3)", "periodic_exponential": "exp(-abs(sin(pi() * abs(a - b) / 1.5)) / 0.7)",
    "standard_periodic": "exp(-0.5 * sin(pi() * (a - b) / 1.5) ** 2 / 0.49::DOUBLE)", "white": "CASE WHEN a = b THEN 1 ELSE 0 END",
}


@query(
    "WITH n AS (SELECT n_nationkey / 10.0::DOUBLE AS x, n_nationkey AS k FROM nation), p AS (SELECT x.k AS i, y.k AS j, x.x AS a, y.x AS b, abs(x.x - y.x) / 0.7 AS h FROM n x CROSS JOIN n y) "
    + " UNION ALL ".join(f"SELECT '{k}' AS kernel, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round({f}, 7) + 0.0 AS v FROM p" for k, f in KERNEL_SQL.items())
)
def gpr_kernels(spark: SparkSession, d: str) -> DataFrame:
    """Every kernel between the nations' places."""
    keys = sorted(x[0] for x in table(spark, d, "nation").select("n_nationkey").collect())
    x = np.array(keys, float)[:, None] / 10
    rows = []
    for name, (k, f) in gp.KERNELS.items():
        m = f(x, x, np.full(1, 0.7), np.full(k, 1.5))
        rows += [(name, int(a), int(b), float(m[i, j])) for i, a in enumerate(keys) for j, b in enumerate(keys)]
    return spark.createDataFrame(rows, "kernel string, i int, j int, w double").select("kernel", "i", "j", r("w", "v", 7))


def given_weights(*sizes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers whose weights follow a rule that SQL can spell: w(i, j) = sin(1 + i + 2 j + 3 k), b(j) = cos(j + k) / 2 in layer k."""
    out = []
    for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
        i, j = np.indices((a, b))
        out.append((np.sin(1 + i + 2 * j + 3 * k), np.cos(np.arange(b) + k) / 2))
    return out


def layer_sql(inputs: list[str], outputs: int, k: int, tanh: bool) -> list[str]:
    sums = [" + ".join(f"sin({1 + i + 2 * j + 3 * k}) * {x}" for i, x in enumerate(inputs)) + f" + cos({j + k}) / 2" for j in range(outputs)]
    return [f"tanh({s})" if tanh else s for s in sums]


def network_sql(sizes: list[int], inputs: list[str]) -> tuple[str, list[str]]:
    """Common tables n1, n2, ... of each layer's values, and the names of the last one's."""
    source, out, names = "pa", [], inputs
    for k, n in enumerate(sizes[1:]):
        new = [f"h{k}_{j}" for j in range(n)]
        out.append(f"n{k} AS (SELECT *, {', '.join(f'{e} AS {c}' for e, c in zip(layer_sql(names, n, k, k < len(sizes) - 2), new, strict=True))} FROM {source})")
        source, names = f"n{k}", new
    return ", ".join(out), names


MLP, MLP_OUT = network_sql([2, 4, 3, 1], ["x0", "x1"])
MLP_SQL = f"WITH {PARTS}, {MLP} SELECT i, round({MLP_OUT[0]}, 6) + 0.0 AS p FROM n2"


@query(MLP_SQL)
def mlp_predict(spark: SparkSession, d: str) -> DataFrame:
    """A perceptron of given weights at every part."""
    model = S.Perceptron((4, 3), weights=given_weights(2, 4, 3, 1))
    return S.predict_rows(parts(spark, d).select("i", "x0", "x1"), ["x0", "x1"], model, ["p"]).select("i", r("p", "p"))


CODER, CODER_OUT = network_sql([3, 5, 1, 5, 3], ["x0", "x1", "y"])


@query(f"WITH {PARTS}, {CODER} SELECT i, {', '.join(f'round({c}, 6) + 0.0 AS {n}' for c, n in zip(CODER_OUT, ('a', 'b', 'c'), strict=True))} FROM n3")
def autoencoder(spark: SparkSession, d: str) -> DataFrame:
    """Three values through one and back, by given weights."""
    model = S.Perceptron((5, 1, 5), weights=given_weights(3, 5, 1, 5, 3))
    p = S.predict_rows(parts(spark, d), ["x0", "x1", "y"], model, ["oa", "ob", "oc"])
    return p.select("i", r("oa", "a"), r("ob", "b"), r("oc", "c"))


@query(f"""
    WITH {PARTS}, h AS (SELECT i, {", ".join(f"{e} AS h{j}" for j, e in enumerate(layer_sql(["x0", "x1", "y"], 4, 0, True)))} FROM pa),
         z AS (SELECT i, {", ".join(f"{e} AS z{j}" for j, e in enumerate(layer_sql(["h0", "h1", "h2", "h3"], 4, 1, False)))} FROM h),
         g AS (SELECT *, {", ".join(f"{e} AS g{j}" for j, e in enumerate(layer_sql(["z0", "z1"], 4, 2, True)))} FROM z)
    SELECT i, round(z0, 6) + 0.0 AS mean, round(z2, 6) + 0.0 AS log_variance, round({layer_sql(["g0", "g1", "g2", "g3"], 3, 3, False)[0]}, 6) + 0.0 AS a FROM g
""")
def variational_autoencoder(spark: SparkSession, d: str) -> DataFrame:
    """The first mean and log-variance of each part's code, and its first value decoded from the means."""
    layers = [given_weights(3, 4)[0], *(given_weights(*[1] * k, a, b)[-1] for k, a, b in ((1, 4, 4), (2, 2, 4), (3, 4, 3)))]
    v = S.VariationalAutoencoder(2, 4, weights={f"{n}{k}": x for k, pair in enumerate(layers) for n, x in zip("wb", pair, strict=True)})
    p = S.predict_rows(parts(spark, d), ["x0", "x1", "y"], Coded(v), ["m", "l", "d"])
    return p.select("i", r("m", "mean"), r("l", "log_variance"), r("d", "a"))


class Coded:
    """The first mean and log-variance of a variational code, and the first decoded value."""

    def __init__(self, model: S.VariationalAutoencoder) -> None:
        self.model = model

    def predict(self, x: np.ndarray) -> np.ndarray:
        mean, log_variance = self.model.encode(x)
        return np.column_stack([mean[:, 0], log_variance[:, 0], self.model.decode(mean)[:, 0]])


def three_terms(first: str, second: str) -> str:
    """Least squares of y on 1 and two terms, with the layer's ridge of 1e-9, by Cramer's rule."""
    return f"""
    WITH {PARTS}, t AS (SELECT i, y, {first} AS t, {second} AS u FROM (SELECT i, y, tanh(x0) AS x FROM pa)),
         m AS (SELECT count(*) + 1e-9 AS nn, sum(t) AS st, sum(u) AS su, sum(t * t) + 1e-9 AS tt, sum(t * u) AS tu, sum(u * u) + 1e-9 AS uu, sum(y) AS sy, sum(t * y) AS ty, sum(u * y) AS uy FROM t),
         c AS (SELECT nn * (tt * uu - tu * tu) - st * (st * uu - tu * su) + su * (st * tu - tt * su) AS d, sy * (tt * uu - tu * tu) - st * (ty * uu - tu * uy) + su * (ty * tu - tt * uy) AS a,
                      nn * (ty * uu - tu * uy) - sy * (st * uu - tu * su) + su * (st * uy - ty * su) AS b, nn * (tt * uy - ty * tu) - st * (st * uy - ty * su) + sy * (st * tu - tt * su) AS e FROM m)
    SELECT i, round((a + b * t + e * u) / d, 5) + 0.0 AS p FROM t CROSS JOIN c
    """


@query(three_terms("x", "2 * x * x - 1"))
def kan_layer(spark: SparkSession, d: str) -> DataFrame:
    """A Chebyshev layer, fitted by aggregates and evaluated in column expressions."""
    p = parts(spark, d)
    return S.PolynomialLayer(2).fit(p, ["x0"], "y").predict(p, ["x0"]).select("i", r("p", "p", 5))


@query(three_terms("2 * x", "(15 * x * x - 3) / 4"))
def kan_jacobi_layer(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d)
    return S.PolynomialLayer(2, "jacobi").fit(p, ["x0"], "y").predict(p, ["x0"]).select("i", r("p", "p", 5))


def network_of_functions(kind: str) -> str:
    """Two inputs, two hidden values, one output; the coefficient of function f from i to o in layer k is cos(1 + i + 2 o + 3 f + 5 k) / 2."""
    make = {"chebyshev": ["1", "tanh({x})", "2 * tanh({x}) * tanh({x}) - 1"], "sine": ["0", "sin({x})", "sin(2 * {x})"]}[kind]
    part = lambda x, i, o, k: " + ".join(f"cos({1 + i + 2 * o + 3 * f + 5 * k}) / 2 * ({e.format(x=x)})" for f, e in enumerate(make))
    layer = lambda xs, o, k: " + ".join(part(x, i, o, k) for i, x in enumerate(xs))
    return f"WITH {PARTS}, h AS (SELECT i, {layer(['x0', 'x1'], 0, 0)} AS h0, {layer(['x0', 'x1'], 1, 0)} AS h1 FROM pa) SELECT i, round({layer(['h0', 'h1'], 0, 1)}, 6) + 0.0 AS p FROM h"


def given_functions(spark: SparkSession, d: str, kind: str) -> DataFrame:
    coefficients = []
    for k, (a, b) in enumerate(((2, 2), (2, 1))):
        i, o, f = np.indices((a, b, 3))
        coefficients.append(np.cos(1 + i + 2 * o + 3 * f + 5 * k) / 2)
    model = S.PolynomialNetwork((2,), 2, kind, coefficients=coefficients)
    return S.predict_rows(parts(spark, d).select("i", "x0", "x1"), ["x0", "x1"], model, ["p"]).select("i", r("p", "p"))


@query(network_of_functions("chebyshev"))
def kan_network(spark: SparkSession, d: str) -> DataFrame:
    """Two layers of polynomials of given coefficients at every part."""
    return given_functions(spark, d, "chebyshev")


@query(network_of_functions("sine"))
def kan_sine_network(spark: SparkSession, d: str) -> DataFrame:
    """The same with sines."""
    return given_functions(spark, d, "sine")


FACTORS = [0.9, 1.0, 1.1, 1.2, 1.3]


@query(f"""
    WITH k AS (SELECT unnest([{", ".join(f"CAST({f} AS DOUBLE)" for f in FACTORS)}]) AS factor), l AS (SELECT factor, avg((l_extendedprice - factor * 1000 * l_quantity) ** 2) AS loss FROM lineitem CROSS JOIN k GROUP BY factor)
    SELECT factor, round(loss / 1e6, 4) + 0.0 AS loss, loss = min(loss) OVER () AS best FROM l
""")
def model_search(spark: SparkSession, d: str) -> DataFrame:
    """Every setting's loss over all lines, in one pass, and the best one, which is written and read back."""
    li = table(spark, d, "lineitem")
    off = lambda f: (F.col("l_extendedprice") - f * 1000 * F.col("l_quantity")) ** 2
    losses = li.agg(*(F.avg(off(f)) for f in FACTORS)).first()
    tried = [({"factor": f}, loss) for f, loss in zip(FACTORS, losses, strict=True)]
    path = scratch(spark)
    layout.save_params(spark, path, min(tried, key=lambda t: t[1])[0])
    best = layout.load_params(spark, path)["factor"]
    return spark.createDataFrame([(s["factor"], loss / 1e6, s["factor"] == best) for s, loss in tried], "factor double, l double, best boolean").select("factor", r("l", "loss", 4), "best")


@query("""
    WITH f AS (SELECT p_partkey AS k, p_retailprice AS y, CAST(p_partkey % 3 AS INTEGER) AS fold FROM part),
         m AS (SELECT a.fold AS fold, (SELECT avg(y) FROM f b WHERE b.fold <> a.fold) AS mean FROM (SELECT DISTINCT fold FROM f) a)
    SELECT fold, round(avg((y - mean) ** 2), 3) + 0.0 AS loss FROM f JOIN m USING (fold) GROUP BY fold
""")
def cross_validation(spark: SparkSession, d: str) -> DataFrame:
    """The loss of each fold's rows under the mean of the others'."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("y"))
    mean = lambda train: (lambda m: lambda test: test.withColumn("p", F.lit(m)))(train.agg(F.avg("y")).first()[0])
    losses = S.fold_losses(p, (F.col("k") % 3).cast("int"), 3, mean, F.avg((F.col("p") - F.col("y")) ** 2))
    return spark.createDataFrame(losses, "fold int, l double").select("fold", r("l", "loss", 3))


@query(f"""
    WITH {EMB}, c AS (SELECT i, max(CASE WHEN j = 0 THEN v END) AS cp, max(CASE WHEN j = 1 THEN v END) AS a, max(CASE WHEN j = 2 THEN v END) AS b FROM emb GROUP BY i),
         g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, 0.5 - sum(a * cp) AS ra, -0.2 - sum(b * cp) AS rb FROM c)
    SELECT i, round(cp + (ra * bb - rb * ab) / (aa * bb - ab * ab) * a + (rb * aa - ra * ab) / (aa * bb - ab * ab) * b, 6) + 0.0 AS adjusted FROM c CROSS JOIN g
""")
def interpolator(spark: SparkSession, d: str) -> DataFrame:
    """The least change of a field that meets two linear targets."""
    c = rows_of(spark, d).select(F.col("row_id").alias("i"), *(F.element_at("x", k + 1).alias(n) for k, n in enumerate(("cp", "a", "b"))))
    return S.adjust_field(c, {"a": 0.5, "b": -0.2}).select("i", r("adjusted", "adjusted"))


#: The embeddings as a field over a grid: components along x, vectors in order along time or y.
GRID = f"{EMB}, v AS (SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS n FROM embeddings), g AS (SELECT e.j AS i, v.n AS n, e.v AS u FROM emb e JOIN v ON e.i = v.vec_id)"
LAST = 63


def field(spark: SparkSession, d: str) -> DataFrame:
    """i, n, u. Vectors are numbered from 0 without gaps, as they come."""
    return rows_of(spark, d).select(F.col("row_id").cast("int").alias("n"), F.posexplode("x").alias("i", "u")).select("i", "n", "u")


BURGERS = "(lead(u) OVER t - lag(u) OVER t) / 0.02 + u * (lead(u) OVER x - lag(u) OVER x) / 0.2 - 0.3 * (lead(u) OVER x - 2 * u + lag(u) OVER x) / 0.01"


@query(f"WITH {GRID} SELECT i, n, round({BURGERS}, 5) + 0.0 AS residual FROM g WINDOW t AS (PARTITION BY i ORDER BY n), x AS (PARTITION BY n ORDER BY i) QUALIFY residual IS NOT NULL")
def pinn_burgers_residual(spark: SparkSession, d: str) -> DataFrame:
    return S.burgers_residual(field(spark, d), 0.1, 0.01, 0.3).filter("residual is not null").select("i", "n", r("residual", "residual", 5))


@query(f"""
    WITH {GRID}, r AS (SELECT i, n, u, {BURGERS} AS residual FROM g WINDOW t AS (PARTITION BY i ORDER BY n), x AS (PARTITION BY n ORDER BY i)),
        l AS (SELECT avg(residual ** 2) AS equation, avg(CASE WHEN n = 0 THEN (u - 0.1 * i) ** 2 END) AS start, avg(CASE WHEN i = 0 OR i = {LAST} THEN u ** 2 END) AS wall FROM r)
    SELECT round(equation, 4) + 0.0 AS equation, round(start, 6) + 0.0 AS start, round(wall, 6) + 0.0 AS wall, round(equation + start + wall, 4) + 0.0 AS loss FROM l
""")
def pinn_loss(spark: SparkSession, d: str) -> DataFrame:
    """What a field is off an equation, an initial and a boundary condition."""
    r_ = S.burgers_residual(field(spark, d), 0.1, 0.01, 0.3)
    conditions = {"start": (F.col("n") == 0, 0.1 * F.col("i")), "wall": ((F.col("i") == 0) | (F.col("i") == LAST), F.lit(0.0))}
    return S.physics_loss(r_, "residual", "u", conditions).select(r("equation", "equation", 4), r("start", "start"), r("wall", "wall"), r("loss", "loss", 4))


def difference(f: str, g: str) -> str:
    return f"(lead({f}) OVER x - lag({f}) OVER x) / 0.2 + (lead({g}) OVER y - lag({g}) OVER y) / 0.2"


def second(f: str) -> str:
    return f"(lead({f}) OVER x - 2 * {f} + lag({f}) OVER x) / 0.01 + (lead({f}) OVER y - 2 * {f} + lag({f}) OVER y) / 0.01"


def first(f: str, axis: str) -> str:
    return f"(lead({f}) OVER {axis} - lag({f}) OVER {axis}) / 0.2"


AXES = "WINDOW x AS (PARTITION BY j ORDER BY i), y AS (PARTITION BY i ORDER BY j)"


@query(f"""
    WITH {GRID}, f AS (SELECT i, n AS j, u, u * u - 0.3 AS v, 0.5 * u + 0.1 * i AS p FROM g),
         d AS (SELECT i, j, {first("u", "x")} + {first("v", "y")} AS continuity, u * ({first("u", "x")}) + v * ({first("u", "y")}) + {first("p", "x")} - ({second("u")}) / 50 AS momentum_x,
                   u * ({first("v", "x")}) + v * ({first("v", "y")}) + {first("p", "y")} - ({second("v")}) / 50 AS momentum_y FROM f {AXES})
    SELECT i, j, round(continuity, 5) + 0.0 AS continuity, round(momentum_x, 5) + 0.0 AS momentum_x, round(momentum_y, 5) + 0.0 AS momentum_y FROM d WHERE continuity IS NOT NULL AND momentum_x IS NOT NULL AND momentum_y IS NOT NULL
""")
def pinn_incompressible_residual(spark: SparkSession, d: str) -> DataFrame:
    """Of a flow whose velocities and pressure are made from the embeddings."""
    u = F.col("u")
    g = field(spark, d).select("i", F.col("n").alias("j"), "u", (u * u - 0.3).alias("v"), (0.5 * u + 0.1 * F.col("i")).alias("p"))
    s = S.incompressible_residual(g, 0.1, 0.1, 50.0)
    s = s.filter("momentum_x is not null and momentum_y is not null and continuity is not null")
    return s.select("i", "j", *(r(n, n, 5) for n in ("continuity", "momentum_x", "momentum_y")))


@query(f"""
    WITH {GRID}, f AS (SELECT i, n AS j, 1.2 + 0.1 * u AS rho, 0.7 + u AS u, u * u - 0.2 AS v, 0.9 + 0.3 * u AS p FROM g), e AS (SELECT *, p / 0.4::DOUBLE + 0.5 * rho * (u * u + v * v) + p AS h FROM f),
         d AS (SELECT i, j, {difference("rho * u", "rho * v")} AS mass, {difference("rho * u * u + p", "rho * u * v")} AS mx, {difference("rho * u * v", "rho * v * v + p")} AS my, {difference("h * u", "h * v")} AS energy FROM e {AXES})
    SELECT i, j, round(mass, 5) + 0.0 AS mass, round(mx, 5) + 0.0 AS momentum_x, round(my, 5) + 0.0 AS momentum_y, round(energy, 5) + 0.0 AS energy FROM d WHERE mass IS NOT NULL
""")
def pinn_euler_residual(spark: SparkSession, d: str) -> DataFrame:
    """Of a compressible flow made from the embeddings, which is no solution."""
    u = F.col("u")
    g = field(spark, d).select("i", F.col("n").alias("j"), (1.2 + 0.1 * u).alias("rho"), (0.7 + u).alias("u"), (u * u - 0.2).alias("v"), (0.9 + 0.3 * u).alias("p"))
    s = S.euler_residual(g, 0.1, 0.1)
    return s.filter("mass is not null").select("i", "j", *(r(n, n, 5) for n in ("mass", "momentum_x", "momentum_y", "energy")))


@query("SELECT p_partkey AS i, round(p_size / 10.0::DOUBLE * sqrt(1.1::DOUBLE), 6) + 0.0 AS adjusted FROM part")
def nonlinear_interpolator(spark: SparkSession, d: str) -> DataFrame:
    """The least change of a field that raises its sum of squares by a tenth: all of it grows alike."""
    c = table(spark, d, "part").select(F.col("p_partkey").alias("i"), (F.col("p_size") / 10).alias("cp"))
    now = c.agg(F.sum(F.col("cp") ** 2)).first()[0]
    return S.adjust_field_nonlinear(c, [(lambda v: v * v, lambda v: 2 * v, 1.1 * now)], tolerance=1e-9).select("i", r("adjusted", "adjusted"))


@query("SELECT p_partkey AS k, round(sqrt(x) * (1 - x) * (0.2 * (1 - x) ** 2 + 0.6 * x * (1 - x) + 0.25 * x * x) + 0.002 * x, 9) + 0.0 AS y FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS x FROM part)")
def airfoil_shape(spark: SparkSession, d: str) -> DataFrame:
    """The surface's height at each part's size, as a share of the largest."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") / 50).alias("x"))
    return t.select("k", r(S.airfoil(F.col("x"), [0.2, 0.3, 0.25], 0.002), "y", 9))


@query(f"""
    WITH {EMB}, z AS (SELECT j, coalesce(lag(v) OVER (ORDER BY j), 0) AS a, v AS b FROM emb WHERE i = (SELECT min(vec_id) FROM embeddings)),
         m AS (SELECT sum(a * a) + 0.5 AS aa, sum(a * b) AS ab, sum(b * b) + 0.5 AS bb FROM z),
         w AS (SELECT i, sum(v * a) AS va, sum(v * b) AS vb FROM emb JOIN z USING (j) GROUP BY i),
         c AS (SELECT i, (va * bb - vb * ab) / (aa * bb - ab * ab) AS ca, (vb * aa - va * ab) / (aa * bb - ab * ab) AS cb FROM w CROSS JOIN m)
    SELECT i, j, round(ca * a + cb * b, 6) + 0.0 AS v FROM c CROSS JOIN z
""")
def sensor_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    """Every vector from one vector's present and last entries, by ridge regression over entries: a linear form of
    reconstruction from few sensors and their past."""
    rows = rows_of(spark, d)
    first = rows.agg(F.min("row_id")).first()[0]
    return entries(S.sensor_reconstruction(rows, [first], 1, 0.5))


@query(f"""
    WITH {EMB}, k AS (SELECT unnest(range(3)) AS k), c AS (SELECT k, vec_id FROM embeddings CROSS JOIN k QUALIFY row_number() OVER (PARTITION BY k ORDER BY md5('5:' || k || ':' || vec_id), vec_id) = 1),
         z AS (SELECT k, j, v AS z FROM emb JOIN c ON emb.i = c.vec_id), m AS (SELECT k, sum(z * z) + 0.5 AS zz FROM z GROUP BY k),
         w AS (SELECT k, i, sum(v * z) AS vz FROM emb JOIN z USING (j) GROUP BY k, i)
    SELECT i, j, round(sum(vz / zz * z) / 3, 6) + 0.0 AS v FROM w JOIN z USING (k) JOIN m USING (k) GROUP BY i, j
""")
def sensor_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """The mean of reconstructions from three random choices of a sensor, without its past."""
    rows = rows_of(spark, d)
    return entries(S.sensor_reconstruction(rows, S.sensor_choices(rows, 3, 1, 5), 0, 0.5))


@query("SELECT p_size, count(*) AS n FROM part GROUP BY p_size")
def parameter_groups(spark: SparkSession, d: str) -> DataFrame:
    """Samples of each parameter value."""
    return table(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n"))


#: The distance from the best place halves at each step; a case ends when its reward gains less than 1e-9.
EPISODES = """c AS (SELECT CAST(c_custkey AS BIGINT) AS case_, (c_custkey % 50) / 25.0::DOUBLE - 1 - 0.3 AS e FROM customer), n AS (SELECT unnest(range(1, 41)) AS n),
     s AS (SELECT case_, e, coalesce(min(CASE WHEN 3 * e * e / pow(4, n) < 1e-9 THEN n END), 40) AS n FROM c CROSS JOIN n GROUP BY case_, e)"""
EPISODES_SQL = f"""WITH {EPISODES} SELECT case_ AS "case", round(-e * e / pow(4, n - 1), 7) + 0.0 AS best, n < 40 AS converged, CAST(n AS INTEGER) AS n_steps FROM s"""


def episode_rows(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("case"), ((F.col("c_custkey") % 50) / 25 - 1).alias("x"))
    return episodes.run_episodes(cases, "quadratic", 40).select("case", r("best", "best", 7), "converged", "n_steps")


@query(EPISODES_SQL)
def rl_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """An episode for each customer: best reward, whether it settled, and steps."""
    return episode_rows(spark, d)


@query(EPISODES_SQL)
def episode_csv(spark: SparkSession, d: str) -> DataFrame:
    """Results of episodes, written as CSV and read back."""
    path = scratch(spark)
    layout.write_csv(episode_rows(spark, d), path)
    return spark.read.csv(path, header=True, schema="case bigint, best double, converged boolean, n_steps int")
