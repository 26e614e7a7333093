"""Streams: empty, repeated, broken-off and late micro-batches, and rows that come or stay away."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from modalis.operators import linalg as L
from modalis.streaming import append, sketch


def block(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "row_id bigint, x array<double>")


def whole(s):
    return {r.row_id: np.array(r.x) for r in L.times(s.q, s.b).collect()}


def low_rank(seed, rows=30, columns=9, rank=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(rows, rank)) @ rng.normal(size=(rank, columns))


def test_empty_batches_repeats_and_restarts(spark, tmp_path):
    x, path = low_rank(1), str(tmp_path / "out")
    none = block(spark, x, range(30)).filter("row_id < 0")
    parts = [none, block(spark, x[:, :4], range(30)), none, block(spark, x[:, 4:], range(30))]
    for number, b in enumerate(parts):
        sketch.take(b, number, path, 4, 1, 5)
    assert sketch.versions(spark, path) == [(1, 1), (2, 3)]
    got = whole(sketch.latest(spark, path))
    assert all(np.allclose(got[i], x[i], atol=1e-8) for i in range(30))
    sketch.take(parts[3], 3, path, 4, 1, 5)  # run again
    again = whole(sketch.latest(spark, path))
    assert sketch.versions(spark, path) == [(1, 1), (2, 3)] and all(np.allclose(got[i], again[i], atol=1e-9) for i in range(30))
    # A version that broke off before its manifest is not seen, and is written again.
    fs = tmp_path / "out/manifest/00000002"
    (fs / "_SUCCESS").unlink()
    assert sketch.latest(spark, path).blocks == 1
    sketch.take(parts[3], 3, path, 4, 1, 5)
    assert sketch.latest(spark, path).blocks == 2
    assert sketch.latest(spark, str(tmp_path / "nothing")) is None


def test_a_stream_whose_first_file_is_filtered_out(spark, tmp_path):
    x, rows = low_rank(2), "row_id bigint, x array<double>"
    for k, b in enumerate((block(spark, x[:, :4], range(-30, 0)), block(spark, x[:, :4], range(30)), block(spark, x[:, 4:], range(-30, 0)), block(spark, x[:, 4:], range(30)))):
        b.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").filter("row_id >= 0")
    sketch.run(stream, f"{tmp_path}/out", f"{tmp_path}/state", 4, 1, 7)
    got = whole(sketch.latest(spark, f"{tmp_path}/out"))
    assert all(np.allclose(got[i], x[i], atol=1e-8) for i in range(30))


def test_rows_that_come_or_stay_away_are_zero(spark, tmp_path):
    x = low_rank(3, rank=2)
    x[20:, :4] = 0
    x[:5, 4:] = 0
    sketch.take(block(spark, x[:20, :4], range(20)), 0, str(tmp_path), 6, 1, 3)
    sketch.take(block(spark, x[5:, 4:], range(5, 30)).unionByName(block(spark, x[5:7, 4:] * 0, (5, 6))), 1, str(tmp_path), 6, 1, 3)
    got = whole(sketch.latest(spark, str(tmp_path)))
    assert len(got) == 30 and all(np.allclose(got[i], x[i], atol=1e-8) for i in range(30))


def values(spark, *rows):
    return spark.createDataFrame(list(rows), append.VALUES)


def test_appended_instants(spark, tmp_path):
    path = str(tmp_path / "field")
    assert append.read(spark, path).count() == 0
    append.take(values(spark, (1, 0, 1.0), (2, 0, 2.0), (2, 0, 3.0), (None, 0, 9.0), (3, None, 9.0)), 0, path)
    append.take(values(spark, (1, 1, 5.0)).limit(0), 1, path)
    append.take(values(spark, (1, 1, 5.0), (2, 1, None)), 2, path)
    append.take(values(spark, (2, 0, -1.0)), 3, path)  # late
    want = [(1, 0, 1.0), (1, 1, 5.0), (2, 0, -1.0), (2, 1, None)]
    assert sorted((tuple(r) for r in append.read(spark, path).collect()), key=repr) == want
    append.take(values(spark, (1, 1, 5.0), (2, 1, None)), 2, path)  # run again: the later correction stays
    assert sorted((tuple(r) for r in append.read(spark, path).collect()), key=repr) == want
    assert append.batches(spark, path) == [0, 2, 3]
    append.take(values(spark, (9, 9, 9.0)), 4, path)
    (tmp_path / "field/batch=000000000004/manifest/_SUCCESS").unlink()
    assert append.read(spark, path).filter(F.col("t") == 9).count() == 0


def test_arriving_blocks_are_many_files(spark, monkeypatch):
    """No block of the stream queries is written or read by one task; each file set is one micro-batch."""
    from modalis.plans import storage

    parts, taken = [], []
    keep, take = append.run, append.take

    def run(stream, path, checkpoint):
        parts.append(stream.sparkSession.read.parquet(path.removesuffix("/out") + "/in").rdd.getNumPartitions())
        keep(stream, path, checkpoint)

    monkeypatch.setattr(append, "run", run)
    monkeypatch.setattr(append, "take", lambda b, n, p: (taken.append(n), take(b, n, p)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert storage.append_stream(spark, "/root/testdata/sf0.001").count() == 600
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert parts[0] > 1 and taken == [0, 1, 2, 3, 4, 4]
