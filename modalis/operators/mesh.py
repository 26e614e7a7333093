"""Meshes as tables: points (point_id, x, y, z) and cells (cell_id, eltype, nodes). Padding (-1) is dropped."""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions.lineage import cut, few

# Element types, what solvers and result formats call them, and kinds of mesh.
QUAD, HEXAHEDRON = 3, 5
SOLVER_TYPES = {-1: 0, 3: 1, 10: 2, 12: 3, 30: 4, 32: 7, 34: 6, 37: 5, 39: 15, 40: 25}
VTK_TYPES = {0: 0, 2: 5, 3: 9, 4: 10, 5: 12, 6: 13, 7: 14, 25: 72}
ENSIGHT_TYPES = {2: "tria3", 3: "quad4", 4: "tetra4", 5: "hexa8", 6: "penta6"}
MESH_KINDS = {"STRUCT2D": 1, "STRUCT3D": 2, "UNSTRUCT": 3}
#: Places in a cell of the grid on which nearest points are searched, about.
PER_CELL = 4
#: Looks of sensors into cells that one task takes, about, and that are broadcast at most.
LOOKS, FEW_LOOKS = 100_000, 100_000
#: Edges between parts of a mesh that the driver joins at most.
FEW_PAIRS = 50_000


def mapped(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def axis(i: Column, n: int, low: float, high: float) -> Column:
    return F.lit((high - low) / (n - 1)) * i + low


def struct2d_points(spark: SparkSession, nx: int, ny: int, dx: tuple[float, float], dy: tuple[float, float]) -> DataFrame:
    i, j = F.floor(F.col("id") / ny), F.col("id") % ny
    return spark.range(nx * ny).select(F.col("id").alias("point_id"), axis(i, nx, *dx).alias("x"), axis(j, ny, *dy).alias("y"), F.lit(0.0).alias("z"))


def struct2d_cells(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    i, j = F.floor(F.col("id") / (ny - 1)), F.col("id") % (ny - 1)
    at = lambda a, b: ((i + a) * ny + j + b).cast("int")
    return spark.range((nx - 1) * (ny - 1)).select(F.col("id").alias("cell_id"), F.lit(QUAD).alias("eltype"), F.array(at(0, 0), at(0, 1), at(1, 1), at(1, 0)).alias("nodes"))


def struct3d_points(spark: SparkSession, n: tuple[int, int, int], spans: tuple[tuple[float, float], ...]) -> DataFrame:
    nx, ny, nz = n
    i, j, k = F.floor(F.col("id") / (ny * nz)), F.floor(F.col("id") / nz) % ny, F.col("id") % nz
    return spark.range(nx * ny * nz).select(F.col("id").alias("point_id"), *(axis(c, m, *s).alias(a) for a, c, m, s in zip("xyz", (i, j, k), n, spans, strict=True)))


def struct3d_cells(spark: SparkSession, n: tuple[int, int, int]) -> DataFrame:
    nx, ny, nz = n
    i, j, k = F.floor(F.col("id") / ((ny - 1) * (nz - 1))), F.floor(F.col("id") / (nz - 1)) % (ny - 1), F.col("id") % (nz - 1)
    at = lambda a, b, c: (((i + a) * ny + j + b) * nz + k + c).cast("int")
    face = [(0, 0), (0, 1), (1, 1), (1, 0)]
    return spark.range((nx - 1) * (ny - 1) * (nz - 1)).select(F.col("id").alias("cell_id"), F.lit(HEXAHEDRON).alias("eltype"), F.array(*(at(a, b, c) for a in (0, 1) for b, c in face)).alias("nodes"))


def corners(points: DataFrame, cells: DataFrame) -> DataFrame:
    """cell_id, k, node, x, y, z: each cell's nodes in order, with their places. One equi-join."""
    nodes = cells.select("cell_id", F.posexplode(F.filter("nodes", lambda n: n >= 0)).alias("k", "node"))
    return nodes.join(points.select(F.col("point_id").alias("node"), "x", "y", "z"), "node").select("cell_id", "k", "node", "x", "y", "z")


def cell_centres(points: DataFrame, cells: DataFrame) -> DataFrame:
    return corners(points, cells).groupBy("cell_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"))


def structured_centres(points: DataFrame, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Midpoints of a structured mesh by its distinct coordinates: as many rows as cells, from 1-D tables."""
    out = None
    for a in axes:
        w = Window.orderBy(a)
        mid = points.select(a).distinct().select(a, F.lead(a).over(w).alias("n"), (F.row_number().over(w) - 1).alias(f"k{a}")).filter("n is not null")
        mid = mid.select(F.col(f"k{a}"), (F.col(a) + (F.col("n") - F.col(a)) / 2).alias(a))
        out = mid if out is None else out.crossJoin(few(mid))
    return out


def with_cell(points: DataFrame, cells: DataFrame) -> DataFrame:
    """cell_id and its corners in order, as one array: everything about a cell follows in its row."""
    return corners(points, cells).groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("k", "node", "x", "y", "z"))).alias("p"))


def place(p: Column) -> tuple[Column, Column, Column]:
    return p["x"], p["y"], p["z"]


def minus(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def area_vector(p: Column) -> tuple[Column, Column, Column]:
    """Half the sum of cross products of neighbouring corners about the centre."""
    n = F.size(p)
    centre = tuple(mean_of(p, a) for a in "xyz")

    def part(k: int) -> Column:
        def one(i: Column) -> Column:
            u = minus(place(F.element_at(p, (i + 1).cast("int"))), centre)
            v = minus(place(F.element_at(p, (F.when(i == 0, n).otherwise(i)).cast("int"))), centre)
            return 0.5 * C.cross(u, v)[k]

        return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), one), F.lit(0.0), lambda s, v: s + v)

    return part(0), part(1), part(2)


def mean_of(p: Column, a: str) -> Column:
    return F.aggregate(F.transform(p, lambda q: q[a]), F.lit(0.0), lambda s, v: s + v) / F.size(p)


def normals(points: DataFrame, cells: DataFrame) -> DataFrame:
    return with_cell(points, cells).select("cell_id", *(c.alias(a) for a, c in zip(("nx", "ny", "nz"), area_vector(F.col("p")), strict=True)))


def edges(cells: DataFrame) -> DataFrame:
    """cell_id, k, a, b, v1 < v2: the edges of each cell, in order."""
    n = F.size("nodes")
    c = cells.withColumn("nodes", F.filter("nodes", lambda x: x >= 0)).select("cell_id", "nodes", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    a, b = F.element_at("nodes", F.col("k") + 1), F.element_at("nodes", (F.col("k") + 1) % F.size("nodes") + 1)
    return c.select("cell_id", "k", a.alias("a"), b.alias("b"), F.least(a, b).alias("v1"), F.greatest(a, b).alias("v2"))


def edge_to_cells(cells: DataFrame) -> DataFrame:
    """v1, v2, cell_id, both directions of each edge."""
    e = edges(cells).select("v1", "v2", "cell_id").distinct()
    return e.unionByName(e.select(F.col("v2").alias("v1"), F.col("v1").alias("v2"), "cell_id"))


def edge_owners(cells: DataFrame) -> DataFrame:
    """a, b, n: the least and the greatest cell of each edge, and how many it has."""
    return edges(cells).groupBy("v1", "v2").agg(F.min("cell_id").alias("a"), F.max("cell_id").alias("b"), F.countDistinct("cell_id").alias("n")).select("a", "b", "n")


def cell_adjacency(cells: DataFrame) -> DataFrame:
    """cell_id, neighbour over edges that exactly two cells share."""
    pairs = edge_owners(cells).filter("n = 2")
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("cell_id"), F.col("b").alias("neighbour")), F.struct(F.col("b").alias("cell_id"), F.col("a").alias("neighbour")))).alias("p")).select("p.*").distinct()


def padded_neighbours(cells: DataFrame) -> DataFrame:
    """cell_id, neighbours: arrays of one length, padded with -1."""
    n = cell_adjacency(cells).groupBy("cell_id").agg(F.array_sort(F.collect_set("neighbour")).alias("n"))
    most = n.agg(F.max(F.size("n")).alias("m")).first()["m"] or 0
    every = cells.select("cell_id").join(n, "cell_id", "left").withColumn("n", F.coalesce("n", F.array().cast("array<bigint>")))
    return every.select("cell_id", F.concat("n", F.array_repeat(F.lit(-1).cast("bigint"), F.lit(most) - F.size("n"))).alias("neighbours"))


def border_cells(cells: DataFrame) -> DataFrame:
    return edges(cells).groupBy("v1", "v2").agg(F.min("cell_id").alias("cell_id"), F.countDistinct("cell_id").alias("n")).filter("n = 1").select("cell_id").distinct()


def interior_cells(cells: DataFrame) -> DataFrame:
    return cells.select("cell_id").join(border_cells(cells), "cell_id", "left_anti")


def at_sensors(fields: DataFrame, sensors: DataFrame) -> DataFrame:
    """Scalar fields (one component) at the sensors' points; they are broadcast if they are few."""
    scalar = fields.groupBy("field").agg(F.max("comp").alias("c")).filter("c = 0").select("field")
    return fields.join(few(scalar), "field", "left_semi").join(few(sensors.select("sensor", "point_id")), "point_id").select("sensor", "field", "t", "v")


def wall_normals(points: DataFrame, cells: DataFrame) -> DataFrame:
    """cell_id, k, nx, ny, nz: unit normals of each cell's edges, in its plane and outwards."""
    c = with_cell(points, cells)
    n = c.select("cell_id", "p", *(v.alias(a) for a, v in zip(("ax", "ay", "az"), area_vector(F.col("p")), strict=True)))
    n = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("p") - 1)))
    at = lambda d: place(F.element_at("p", ((F.col("k") + d) % F.size("p") + 1).cast("int")))
    v1, v2, third = at(0), at(1), at(2)
    raw = C.cross(minus(v2, v1), (F.col("ax"), F.col("ay"), F.col("az")))
    size = F.sqrt(C.dot(raw, raw))
    middle = tuple((a + b) / 2 for a, b in zip(v1, v2, strict=True))
    sign = F.when(C.dot(minus(middle, third), raw) < 0, -1.0).otherwise(1.0)
    return n.select("cell_id", F.col("k").cast("int"), *((sign * x / size).alias(a) for a, x in zip(("nx", "ny", "nz"), raw, strict=True)))


def joined(pairs: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Nodes of a small graph, the least node of each one's part, and the sign between the two."""
    near: dict[int, list[tuple[int, int]]] = {}
    for a, b, s in pairs:
        near.setdefault(a, []).append((b, s))
        near.setdefault(b, []).append((a, s))
    root: dict[int, tuple[int, int]] = {}
    for first in sorted(near):
        if first not in root:
            root[first], open_ = (first, 1), [first]
            while open_:
                a = open_.pop()
                for b, s in sorted(near[a]):
                    if b not in root:
                        root[b] = (first, root[a][1] * s)
                        open_.append(b)
    return [(k, r, s) for k, (r, s) in root.items() if k != r]


def agreeing_signs(owners: DataFrame, area: DataFrame) -> DataFrame:
    """cell_id, root, sign: signs that make normals agree with those of the root of their connected part. ``owners``: of edges.

    Each node hooks on to the neighbour that comes first by a hash, if that comes before itself; chains of hooks are short
    then. What hangs together becomes one node, and only edges between those are left for the next round: a round has a
    fraction of the last one's, so that all rounds cost little more than the first. At most FEW_PAIRS edges are left to the driver.
    """
    n = area.select("cell_id", "nx", "ny", "nz")
    pairs = owners.filter("n = 2").select("a", "b").distinct().join(n.toDF("a", "nx", "ny", "nz"), "a").join(n.toDF("b", "mx", "my", "mz"), "b")
    inner = C.dot((F.col("nx"), F.col("ny"), F.col("nz")), (F.col("mx"), F.col("my"), F.col("mz")))
    pairs = cut(pairs.select("a", "b", F.when(inner < 0, -1).otherwise(1).alias("s")))
    hooks: list[DataFrame] = []
    while True:
        rest = pairs.limit(FEW_PAIRS + 1).toArrow()
        if rest.num_rows <= FEW_PAIRS:
            if rest.num_rows:
                hooks.append(cut(pairs.sparkSession.createDataFrame(joined(zip(*(rest.column(c).to_pylist() for c in "abs"), strict=True)), "ra bigint, rb bigint, s int")))
            break
        at = lambda x: F.struct(F.xxhash64(x, F.lit(len(hooks))).alias("h"), F.col(x).alias("k"))  # noqa: B023, E731
        two = pairs.select("s", at("a").alias("a"), at("b").alias("b")).select("s", F.least("a", "b").alias("to"), F.greatest("a", "b")["k"].alias("ra"))
        hook = cut(two.groupBy("ra").agg(F.min(F.struct("to", "s")).alias("m")).select("ra", F.col("m.to.k").alias("rb"), F.col("m.s").alias("s")))
        while True:
            longer = hook.join(hook.toDF("rb", "up", "t"), "rb", "left")
            hook = cut(longer.select("ra", F.coalesce("up", "rb").alias("rb"), (F.col("s") * F.coalesce("t", F.lit(1))).alias("s"), F.col("up").isNotNull().alias("on")))
            on, hook = hook.filter("on"), hook.drop("on")
            if on.isEmpty():
                break
        hooks.append(hook)
        for x, r, t in (("a", "ra", "ta"), ("b", "rb", "tb")):
            pairs = pairs.join(hook.toDF(x, r, t), x, "left").withColumns({x: F.coalesce(r, x), "s": F.col("s") * F.coalesce(t, F.lit(1))}).drop(r, t)
        pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s")
        pairs = cut(pairs.groupBy("a", "b").agg(F.min("s").alias("s")))
    last = None
    for hook in reversed(hooks):  # roots of the last round for those of every round before it
        if last is not None:
            hook = hook.join(last.toDF("rb", "up", "t"), "rb", "left").select("ra", F.coalesce("up", "rb").alias("rb"), (F.col("s") * F.coalesce("t", F.lit(1))).alias("s"))
            hook = hook.unionByName(last.join(hook.select("ra"), "ra", "left_anti"))
        last = cut(hook)
    cells = area.select("cell_id")
    if last is None:
        return cells.select("cell_id", F.col("cell_id").alias("root"), F.lit(1).alias("sign"))
    return cells.join(last.toDF("cell_id", "rb", "s"), "cell_id", "left").select("cell_id", F.coalesce("rb", "cell_id").alias("root"), F.coalesce("s", F.lit(1)).alias("sign"))


def coherent_normals(cells: DataFrame, area: DataFrame) -> DataFrame:
    """cell_id, nx, ny, nz with signs that agree across shared edges with the least border cell's; parts that
    it doesn't reach stay. Then the border is turned if it stands against the inside."""
    area = cut(area)
    owners = cut(edge_owners(cells))
    border = owners.filter("n = 1").select(F.col("a").alias("cell_id")).distinct().withColumn("b", F.lit(True))
    n = area.join(agreeing_signs(owners, area), "cell_id").join(border, "cell_id", "left").withColumn("b", F.coalesce("b", F.lit(False)))
    n = cut(n)
    start = n.filter("b").agg(F.min(F.struct("cell_id", "root", "sign")).alias("m")).first()["m"]
    turn = F.when(F.col("root") == start["root"], F.col("sign") * start["sign"]).otherwise(1)
    n = n.select("cell_id", "b", *((F.col(a) * turn).alias(a) for a in ("nx", "ny", "nz")))
    m = {r["b"]: np.array([r["x"], r["y"], r["z"]]) for r in n.groupBy("b").agg(F.avg("nx").alias("x"), F.avg("ny").alias("y"), F.avg("nz").alias("z")).collect()}
    against = len(m) == 2 and float(m[True] @ m[False]) < 0
    sign = F.when(F.col("b"), -1.0 if against else 1.0).otherwise(1.0)
    return n.select("cell_id", *((F.col(a) * sign).alias(a) for a in ("nx", "ny", "nz")))


def find_point(points: DataFrame, x: float, y: float, z: float) -> DataFrame:
    return points.filter((F.col("x") == x) & (F.col("y") == y) & (F.col("z") == z)).select("point_id")


def find_cells(cells: DataFrame, eltype: int) -> DataFrame:
    return cells.filter(F.col("eltype") == eltype).select("cell_id")


def cells_of_node(cells: DataFrame, node: int) -> DataFrame:
    return cells.filter(F.array_contains("nodes", node)).select("cell_id")


def nearest_points(points: DataFrame, sensors: list[tuple[float, float, float]]) -> DataFrame:
    """sensor, point_id, d2: the nearest point to each of a few sensors, the first of equals. The sensors are
    literals of the plan: one pass, with minima combined before the shuffle."""
    s = F.array(*(F.struct(F.lit(k).alias("sensor"), F.lit(float(a)).alias("sx"), F.lit(float(b)).alias("sy"), F.lit(float(c)).alias("sz")) for k, (a, b, c) in enumerate(sensors)))
    p = points.withColumn("s", F.explode(s)).select("s.*", "point_id", "x", "y", "z")
    d2 = (F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2 + (F.col("z") - F.col("sz")) ** 2
    return p.withColumn("d2", d2).groupBy("sensor").agg(F.min(F.struct("d2", "point_id")).alias("m")).select("sensor", "m.point_id", "m.d2")


def nearest_on_grid(points: DataFrame, sensors: DataFrame, digits: int | None = None) -> DataFrame:
    """sensor, point_id, d2: the nearest point to each sensor (sensor, x, y, z), the first of equals, for any number of both.

    Points and sensors fall into the cells of a grid, about PER_CELL places each. A sensor, or the place within the points'
    bounds that is nearest to it, looks into its own cell and those around it; it is done when nothing outside of them
    can be nearer than what it found. Those that aren't look again on a grid of twice the width, and at last all
    points are around them. Points at one place count as its first, so that a crowd at a place is one row. With ``digits``
    squared distances that are equal when rounded to them count as equal. Cells are dealt to as many tasks as keep about LOOKS
    looks in one; more than FEW_LOOKS are never broadcast, though the planner, which takes the size of the sensors' file for
    theirs, would have the driver hold them all."""
    p = cut(points.filter("x is not null and y is not null and z is not null").groupBy("x", "y", "z").agg(F.min("point_id").alias("point_id")))
    b = p.agg(F.count("*").alias("n"), *(f(a).alias(f"{n}{a}") for a in "xyz" for f, n in ((F.min, "low"), (F.max, "high")))).first()
    found = "sensor bigint, point_id bigint, d2 double"
    if not b["n"]:
        return points.sparkSession.createDataFrame([], found)
    axes = [a for a in "xyz" if b[f"high{a}"] > b[f"low{a}"]]
    spans = [b[f"high{a}"] - b[f"low{a}"] for a in axes]
    h = max((np.prod(spans) * PER_CELL / b["n"]) ** (1 / len(axes)), max(spans) / 2**20) if axes else 1.0
    kind = dict(points.dtypes)["point_id"]
    state = sensors.filter("x is not null and y is not null and z is not null").select("sensor", *(F.col(a).cast("double").alias(f"s{a}") for a in "xyz"), F.lit(None).cast(f"struct<key:double,point_id:{kind},d2:double>").alias("best"))
    state = cut(state)
    step = 0.0 if digits is None else 10.0**-digits
    out = None
    while True:
        inside = {a: F.least(F.greatest(F.col(f"s{a}"), F.lit(b[f"low{a}"])), F.lit(b[f"high{a}"])) for a in "xyz"}
        cell = lambda c, a: F.floor((c - b[f"low{a}"]) / h).cast("bigint")  # noqa: B023, E731
        away = sum(((F.col(f"s{a}") - inside[a]) ** 2 for a in "xyz"), F.lit(0.0))
        part = {a: (inside[a] - b[f"low{a}"]) / h - cell(inside[a], a) for a in axes}
        margin = F.least(F.lit(1.0), *(c for a in axes for c in (part[a], 1 - part[a]))) * h if axes else F.lit(0.0)
        around = F.array(*(F.struct(*(F.lit(k).alias(a) for a, k in zip(axes, o, strict=True)), F.lit(0).alias("own")) for o in itertools.product((-1, 0, 1), repeat=len(axes))))
        looks = state.withColumn("o", F.explode(around)).select("sensor", "sx", "sy", "sz", *((cell(inside[a], a) + F.col("o")[a]).alias(f"c{a}") for a in axes), F.lit(0).alias("c"))
        near = p.select("point_id", "x", "y", "z", *(cell(F.col(a), a).alias(f"c{a}") for a in axes), F.lit(0).alias("c"))
        d2 = sum(((F.col(a) - F.col(f"s{a}")) ** 2 for a in "xyz"), F.lit(0.0))
        by = [*(f"c{a}" for a in axes), "c"]
        n = state.count() * 3 ** len(axes)
        if n > FEW_LOOKS:
            tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // LOOKS))
            near, looks = near.repartition(tasks, *by), looks.repartition(tasks, *by).hint("merge")
        else:
            looks = F.broadcast(looks)
        key = (d2 if digits is None else F.round(d2, digits)).alias("key")
        met = near.join(looks, by).groupBy("sensor").agg(F.min(F.struct(key, F.col("point_id"), d2.alias("d2"))).alias("now"))
        last = not axes or h >= max(spans)
        whole = F.lit(True) if last else F.coalesce(F.col("best.key") + step < away + (h + margin) ** 2 * (1 - 1e-12), F.lit(False))
        state = state.join(met, "sensor", "left").withColumn("best", F.least("best", "now")).drop("now")
        state = cut(state.withColumn("whole", whole))
        done = state.filter("whole").select("sensor", "best.point_id", "best.d2")
        out = done if out is None else out.unionByName(done)
        state = state.filter("not whole").drop("whole")
        if last or state.isEmpty():
            return out
        h *= 2


def sensor_places(bounds: list[float], n: int, seed: int = 0) -> list[tuple[float, float, float]]:
    """Random places within bounds of two or three axes."""
    low, high = np.array(bounds[0::2]), np.array(bounds[1::2])
    at = np.random.default_rng(seed).uniform(low, high, (n, len(low)))
    return [(*map(float, r), *[0.0] * (3 - len(r))) for r in at]


def random_sensors(points: DataFrame, bounds: list[float], n: int, seed: int = 0) -> DataFrame:
    return nearest_points(points, sensor_places(bounds, n, seed))


def pad_vectors(df: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Two components as three, the last 0."""
    return df.withColumn("vector", F.array(F.col(names[0]), F.col(names[1]), F.lit(0.0)))
