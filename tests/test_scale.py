"""What must not grow with the tables: rows of one task, work of one ring, what Python holds at once."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldframe.operators import analyze, geometry, objects, outline, polygon, severity, threshold, tile
from fieldframe.plans import analysis_queries, shape_queries


@pytest.fixture
def dealt(spark):
    """Joins as they are planned for large tables."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def largest_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def three_images(spark):
    px = spark.range(0, 12000, 1, 8).select("id", (F.col("id") % 3).cast("string").alias("img"), (F.col("id") * 37 % 1009 / 1009.0).alias("v"), (F.col("id") * 11 % 101 / 101.0).alias("B"))
    return px.withColumn("img", F.when(F.col("id") % 1000 != 7, F.col("img")))


@pytest.mark.parametrize("few", [threshold.FEW, 0])
def test_pixels_are_not_dealt_by_image_alone(spark, dealt, monkeypatch, few):
    px = three_images(spark)
    monkeypatch.setattr(threshold, "FEW", few)
    mask = threshold.binary(px, "v", ["img"])
    assert largest_task(mask) < 12000 / 3 * 0.8
    cuts = {r["img"]: r["threshold"] for r in threshold.otsu(px, "v", ["img"]).collect()}
    rows = {r["id"]: (r["img"], r["v"]) for r in px.where("img is not null").collect()}
    assert {r["id"]: r["mask"] for r in mask.collect()} == {k: v < cuts[img] for k, (img, v) in rows.items()}
    one = threshold.otsu(px.where("img = '1'"), "v").first()[0]
    assert cuts["1"] == one and len(cuts) == 3


def test_two_stages_alike_with_few_and_many_images(spark, monkeypatch):
    of = lambda: sorted(map(tuple, severity.two_stage(three_images(spark), "v", "B", ["img"]).collect()))
    few = of()
    monkeypatch.setattr(threshold, "FEW", 0)
    assert of() == few and len(few) == 3


def test_labelled_pixels_stay_as_they_are(spark):
    px = spark.createDataFrame([(1, 2, 0.5), (1, 2, 0.5), (None, 3, 0.25), (4, 0, 1.0)], "k int, id int, R double")
    assert sorted(map(str, objects.object_rgb(px, None, ["k"], ["R"]).collect())) == sorted(map(str, px.where("id > 0").collect()))
    some = px.where("k = 4")
    assert objects.object_rgb(some.drop("id"), some.select("k", F.lit(7).alias("id")), ["k"], ["R"]).collect() == [(4, 7, 1.0)]


def seconds(df):
    took = []
    for _ in range(2):
        began = time.time()
        df.write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    return min(took)


RING = "id int, xs array<double>, ys array<double>"


@pytest.mark.parametrize("of", [
    lambda r: r.select(polygon.centre_distances(True)), lambda r: r.select(polygon.centre_distances()), polygon.centre, lambda r: polygon.spline(r, 20), lambda r: polygon.pcv(r, 1).select("pcv"),
])
def test_work_of_a_ring_grows_with_its_vertices(spark, of):
    small, large = (seconds(of(polygon.circle(spark, 1.0, n))) for n in (1000, 8000))
    assert large < 24 * small


def test_rounds_of_smoothing_are_cheap(spark):
    rings = spark.range(0, 20000, 1, 1).select("id", *[F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k, m=m: (F.col("id") * k * m % 97).cast("double")).alias(c) for c, m in (("xs", 7), ("ys", 11))])
    one, hundred = (seconds(polygon.pcv(rings, n).select("id", "pcv")) for n in (1, 100))
    assert hundred < 8 * one


def test_smoothing_with_gaps(spark):
    rows = [(1, [1.0, 2.0, 4.0, 7.0, 1.0, 0.5, 3.0], [0.0, None, 3.0, 1.0, 1.0, 5.0, 2.0]), (2, None, [1.0]), (3, [5.0], [2.0]), (4, [1.0, 2.0, float("nan")], [3.0, 1.0, 1.0]), (5, [], [])]
    got = {r["id"]: r for r in polygon.smooth(spark.createDataFrame(rows, RING), 2).collect()}
    for k, *both in rows:
        for c, v in zip(("xs", "ys"), both, strict=True):
            for _ in range(2):
                v = v and [None if None in (a := (v[i - 1], v[i], v[(i + 1) % len(v)])) else (a[0] + a[1] + a[2]) / 3 for i in range(len(v))]
            assert str(got[k][c]) == str(v)


def test_splines_of_mixed_rings(spark):
    rows = [(k, [float(k * i % 7) for i in range(n)], [float((k + i) % 5) for i in range(n)]) for k, n in enumerate((0, 1, 2, 3, 4, 9, 4))] + [(7, None, None), (8, [2.0, None, 1.0], [1.0, 2.0, 4.0])]
    for k, xs, ys in map(tuple, polygon.spline(spark.createDataFrame(rows, RING), 11).collect()):
        for new, v in ((xs, rows[k][1]), (ys, rows[k][2])):
            if v is None or len(v) < 2:
                assert new == v
                continue
            v = np.array(v, float)
            w = min(3, len(v))
            y = np.r_[v[-w:], v, v[:w]]
            m = len(y) - 2
            second = np.r_[0, np.linalg.solve(4 * np.eye(m) + np.eye(m, k=1) + np.eye(m, k=-1), 6 * np.diff(y, 2)), 0]
            t = w + np.arange(11) * (len(v) / 11)
            i = t.astype(int)
            u = t - i
            assert np.allclose(new, (1 - u) * y[i] + u * y[i + 1] + ((1 - u) ** 3 - 1 + u) * second[i] / 6 + (u**3 - u) * second[i + 1] / 6, equal_nan=True)


def near_by_expression(r, nharm, npoints):
    back = outline.inverse(outline.efourier(r, nharm), npoints).select(F.col("id").alias("__id"), F.col("xs").alias("px"), F.col("ys").alias("py"))
    d = r.join(back, F.col("id") == F.col("__id")).select("id", F.expr("transform(arrays_zip(xs, ys), v -> sqrt(array_min(transform(arrays_zip(px, py), w -> (v.xs - w.px) * (v.xs - w.px) + (v.ys - w.py) * (v.ys - w.py)))))").alias("d"))
    return d.select("id", F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / F.size("d"), F.array_max("d"), F.array_min("d"))


def test_outline_error_as_by_expressions_and_cheaper(spark):
    rows = [(k, [float(k * i * i % 13) for i in range(3 + k % 5)], [float((k + i * 3) % 11) for i in range(3 + k % 5)]) for k in range(40)] + [(40, [1.0, None, 3.0, 0.0], [1.0, 2.0, 0.0, 0.5])]
    r = spark.createDataFrame(rows, RING)
    got, want = (sorted(map(tuple, f(r, 3, 30).collect())) for f in (outline.error, near_by_expression))
    assert len(got) == len(want) == 41
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=1e-12)
    many = spark.range(3000).crossJoin(r.drop("id").limit(1))
    assert seconds(outline.error(many, 3, 400)) < seconds(near_by_expression(many, 3, 400)) / 2


def test_overlays_of_many_pairs_as_one_by_one(monkeypatch):
    rng = np.random.default_rng(2)
    turn = np.sort(rng.random((4, 400, 5)) * 2 * np.pi, axis=2)
    a, b = (np.stack((np.cos(t) * r + m, np.sin(t) * r)) for t, r, m in ((turn[0], 1 + turn[1] / 9, 0.0), (turn[2], 1 + turn[3] / 9, 0.7)))
    b[:, 100:200, 4], b[:, 200:220] = b[:, 100:200, 3], a[:, 200:220]  # level edges, equal rings
    began = time.time()
    one = {op: [geometry.overlay(a[0, k], a[1, k], b[0, k], b[1, k], op) for k in range(400)] for op in geometry.OPERATIONS}
    singly = time.time() - began
    for chunk in (1 << 21, 2000):
        monkeypatch.setattr(geometry, "CHUNK", chunk)
        began = time.time()
        many = {op: geometry.overlays(*a, *b, op) for op in geometry.OPERATIONS}
        if chunk > 2000:
            assert time.time() - began < singly / 4
        for op, (t, pair) in many.items():
            assert [list(map(tuple, t[pair == k].tolist())) for k in range(400)] == one[op]
            assert np.allclose(geometry.areas(t, pair, 400), [geometry.area(v) for v in one[op]], atol=1e-12)


@pytest.mark.parametrize("operation", list(geometry.OPERATIONS))
def test_combined_with_and_without_shapes(spark, operation):
    a = spark.createDataFrame([(1, [0.0, 2.0, 2.0, 0.0], [0.0, 0.0, 2.0, 2.0]), (2, [5.0, 6.0, 5.0], [5.0, 5.0, 6.0]), (3, [0.5, 1.0, 0.5], [0.5, 0.5, 1.0])], RING)
    b = spark.createDataFrame([(7, [1.0, 3.0, 3.0, 1.0], [1.0, 1.0, 3.0, 3.0]), (8, [5.0, 6.0, 6.0], [6.0, 6.0, 5.0])], RING)
    full = geometry.combined(a, b, 3.0, 3.0, operation).collect()
    assert sorted(r[:3] for r in full) == sorted(map(tuple, geometry.combined(a, b, 3.0, 3.0, operation, shapes=False).collect())) and full
    for r in full:
        one = geometry.overlay(*(v for p, k in ((a, r["a_id"]), (b, r["b_id"])) for v in p.where(F.col("id") == k).first()[1:]), operation)
        assert (r["area"], r["wkt"]) == (pytest.approx(geometry.area(one)), geometry.wkt(one))


def test_pieces_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(tile, "PIECE", 20)
    rows = [[1.0] * n for n in (3, 4, 50, 0, 5, 6, 7, 2)] + [None, [2.0]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(rows, pa.list_(pa.float64()))], ["img", "data"])
    got = list(tile.pieces([batch.slice(1), batch.slice(0, 0)]))
    assert [v for b in got for v in b.column("img").to_pylist()] == list(range(1, 10)) and [v for b in got for v in b.column("data").to_pylist()] == rows[1:]
    assert all(len(b) == 1 or sum(len(v or ()) for v in b.column("data").to_pylist()) <= 20 for b in got) and len(got) < 9


@pytest.mark.parametrize("queries, name", [(analysis_queries, "analyze_objects"), (analysis_queries, "analyze_objects_merged"), (analysis_queries, "analyze_objects_summary"), (shape_queries, "object_contour")])
def test_one_python_process_a_task(spark, queries, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_outlines_with_kernel_and_hulls_as_step_by_step(spark):
    rng = np.random.default_rng(4)
    images = spark.createDataFrame([(k, h, w, (rng.random(h * w) < 0.6).astype(float).tolist()) for k, (h, w) in enumerate([(3, 5), (8, 8), (1, 1), (20, 30), (6, 2)])], "img int, h int, w int, data array<double>")
    apart = polygon.hull_udf(analyze.outlines(tile.apply(images, tile.label)))
    want = sorted(map(tuple, apart.collect()))
    assert sorted(map(tuple, analyze.outlines(images, tile.label, hulls=True).collect())) == want and len(want) > 5
    assert sorted(map(tuple, tile.contours(images, tile.label).collect())) == sorted((r[0], r[1], n + 1, x, y) for r in want for n, (x, y) in enumerate(zip(r[4], r[5], strict=True)))


def test_k_means_holds_a_bounded_number_of_pixels(spark, monkeypatch):
    px = spark.range(0, 9000, 1, 2).select("id", *[((F.col("id") % 3) * m % 4 / 4.0 + F.col("id") % 7 / 1000.0).alias(c) for c, m in (("R", 1), ("G", 2), ("B", 3))])
    assert severity.spread(px, 4500) is px and severity.spread(px.limit(0), 1).count() == 0
    assert largest_task(severity.spread(px, 1000)) <= 1100 and severity.spread(px, 1000).distinct().count() == 9000
    of = lambda: sorted(tuple(round(v, 9) for v in r[1:]) for r in severity.palette(px, ["R", "G", "B"], 3).collect())
    want = of()
    sizes, fit = [], severity.spread
    monkeypatch.setattr(severity, "ROWS", 1000)
    monkeypatch.setattr(severity, "spread", lambda x, rows: sizes.append(largest_task(out := fit(x, rows))) or out)
    assert of() == want and [r[0] for r in want] == [3000] * 3 and sizes[0] <= 1100
