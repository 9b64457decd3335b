"""Whole analyses and geometry against plain numpy, and images through files."""

from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldframe.functions import colour, text, units
from fieldframe.operators import analyze, geometry, lines, mosaic, outline, polygon, raster, severity, tile
from fieldframe.sources import images, rasters, vector


def slow_label(mask, gap=1, eight=True):
    out = np.zeros(mask.shape, int)
    around = [(y, x) for y in range(-gap, gap + 1) for x in range(-gap, gap + 1) if (y or x) and (eight or abs(y) + abs(x) <= gap)]
    for start in zip(*np.nonzero(mask), strict=True):
        if not out[start]:
            out[start], queue = out.max() + 1, deque([start])
            while queue:
                r, c = queue.popleft()
                for p in ((r + y, c + x) for y, x in around):
                    if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not out[p]:
                        out[p] = out[r, c]
                        queue.append(p)
    return out


def test_labels_of_every_gap():
    rng = np.random.default_rng(0)
    for _ in range(60):
        m = rng.random(rng.integers(1, 14, 2)) < rng.choice((0.1, 0.3, 0.5, 0.7))
        for gap in (1, 2, 3):
            for eight in (True, False):
                assert (tile.label(m, gap, eight) == slow_label(m, gap, eight)).all()


def test_watershed_parts_touching_discs():
    y, x = np.mgrid[:40, :70]
    m = ((y - 20) ** 2 + (x - 20) ** 2 < 15**2) | ((y - 20) ** 2 + (x - 46) ** 2 < 15**2)
    out = tile.watershed(m)
    assert tile.label(m).max() == 1 and set(np.unique(out)) == {0, 1, 2}
    assert out[20, 20] != out[20, 46] and ((out > 0) == m).all()


def picture(spark, arrays):
    rows = [(k, *a.shape, a.ravel().tolist()) for k, a in arrays.items()]
    return spark.createDataFrame(rows, "img string, h int, w int, bands int, data array<double>")


def shapes(dpi=50):
    """A square of 10 cm, one of 5, a rectangle of 4 by 2 and a disc of 3 cm across, black on white."""
    px = dpi / 2.54
    a = np.ones((round(12 * px), round(24 * px), 3))
    y, x = np.mgrid[: a.shape[0], : a.shape[1]] / px
    for x0, y0, w, h in ((1, 1, 10, 10), (12, 1, 5, 5), (12, 7, 4, 2)):
        a[(x >= x0) & (x < x0 + w) & (y >= y0) & (y < y0 + h)] = 0
    a[(x - 20) ** 2 + (y - 4) ** 2 < 1.5**2] = 0
    return a * 0.9 + np.random.default_rng(0).random(a.shape) / 10


KNOWN = [100, 25, 8, np.pi * 1.5**2]


def test_known_areas(spark):
    df = picture(spark, {"shapes_a": shapes()})
    how = analyze.Segmentation(index="(R + G + B) / 3", watershed=False)
    got = analyze.analyze_objects(df, how, analyze.Filters(lower_noise=None), dpi=50).orderBy(F.desc("area")).collect()
    assert got and list(got[0].asDict()) == analyze.MEASURES
    assert [r.area for r in got] == pytest.approx(sorted(KNOWN, reverse=True), rel=0.03)
    square, disc = got[0], got[3]
    assert square.length == pytest.approx(10, rel=0.02) and square.diam_max == pytest.approx(200**0.5, rel=0.03) and square.solidity == pytest.approx(1, abs=0.03)
    assert disc.caliper == pytest.approx(3, rel=0.04) and disc.eccentricity < 0.2 and disc.radius_mean == pytest.approx(1.5, rel=0.04)
    by_reference = analyze.analyze_objects(df, how, analyze.Filters(lower_noise=None), reference_area=100.0).orderBy(F.desc("area")).collect()
    assert [r.area for r in by_reference] == pytest.approx(sorted(KNOWN, reverse=True)[1:], rel=0.03)
    noise = analyze.analyze_objects(df, how, analyze.Filters(lower_noise=0.3), dpi=50)
    assert noise.count() == 2
    one = analyze.summary(analyze.analyze_objects(df, how, analyze.Filters(lower_noise=None), dpi=50)).first()
    assert one.n == 4 and one.area_sum == pytest.approx(sum(KNOWN), rel=0.02) and 0 < one.coverage < 1
    assert analyze.merged(analyze.analyze_objects(df, how)).first()["sample"] == "shapes"
    assert set(analyze.MINIMAL) <= set(analyze.MEASURES) and set(analyze.LESION) <= set(analyze.MEASURES)


def test_object_index_crops_and_augmentation(spark):
    a = shapes(20)
    df = picture(spark, {"a": a, "b": np.ones((4, 5, 3))})
    labels = analyze.segment(df, analyze.Segmentation(index="R", threshold=0.5, watershed=False))
    own = tile.label(a[..., 0] < 0.5)
    means = {r.id: (r.n, r["mean"]) for r in analyze.object_index(df, labels, "G + 1").where("img = 'a'").collect()}
    assert {k: n for k, (n, _) in means.items()} == {k: (own == k).sum() for k in range(1, 5)}
    assert all(m == pytest.approx(1 + a[..., 1][own == k].mean()) for k, (_, m) in means.items())
    cut = analyze.crops(df, labels, lower_share=0.1).collect()
    assert len(cut) == 4 and all(r.h * r.w * 3 == len(r.data) for r in cut)
    assert {r.id: np.array(r.data).reshape(r.h, r.w, 3)[..., 0].tolist() for r in cut}[1][0][0] < 0.2
    turned = analyze.augment(df, 4).where("img = 'a'").orderBy("nth").collect()
    assert [r.degrees for r in turned] == [90, 180, 270, 360]
    assert (turned[0].h, turned[0].w) == (a.shape[1], a.shape[0])
    assert np.allclose(np.array(turned[3].data).reshape(a.shape), a, atol=1e-6)
    doubled = analyze.apply_bands(df, lambda v: v[::2]).collect()
    assert {r.img: r.h for r in doubled} == {"a": -(-a.shape[0] // 2), "b": 2}


def test_segmentation_steps():
    rng = np.random.default_rng(2)
    v = rng.random((30, 40))
    v[3, 4] = np.nan
    assert not analyze.mask_of(v, analyze.Segmentation(threshold=2.0))[3, 4]
    assert (analyze.mask_of(v, analyze.Segmentation(threshold=0.5, invert=True)) == (np.nan_to_num(v) >= 0.5)).all()
    size = 3
    mean = np.array([[np.nan_to_num(v)[max(r - size, 0) : r + size + 1, max(c - size, 0) : c + size + 1].mean() for c in range(40)] for r in range(30)])
    assert np.allclose(analyze.window_mean(v, size), mean)
    ring = np.zeros((9, 9))
    ring[2:7, 2:7] = 1
    ring[4, 4] = 0
    assert analyze.mask_of(1 - ring, analyze.Segmentation(threshold=0.5, fill_hull=True)).sum() == 25
    assert analyze.mask_of(1 - ring, analyze.Segmentation(threshold=0.5, erode=3)).sum() < 9


def test_plots_of_a_raster(spark):
    rng = np.random.default_rng(5)
    a = np.zeros((20, 30))
    a[2:5, 2:6] = a[10:13, 3:9] = a[4:9, 20:24] = 1
    a += rng.random(a.shape) / 10
    px = spark.createDataFrame([(r, c, float(a[r, c])) for r in range(20) for c in range(30)], "row int, col int, R double")
    plots = spark.createDataFrame([(1, 0.0, 15.0, 0.0, 20.0), (2, 15.0, 30.0, 0.0, 20.0)], "id int, xmin double, xmax double, ymin double, ymax double")
    got = mosaic.analyze_plots(px, plots, mosaic.Grid(0.0, 20.0, 1.0, 1.0), {"V": "R * 2"}, "V", 15.0, 20.0, 1.0)
    by = {r.plot: r for r in got.plots.collect()}
    assert by[1].covered_area == 12 + 18 and by[2].covered_area == 20 and by[1].plot_area == 300
    assert by[1]["mean.V"] == pytest.approx(2 * a[:, :15][a[:, :15] > 0.5].mean())
    one = {(r.plot, r.npixels): r for r in got.individuals.collect()}
    assert set(one) == {(1, 12), (1, 18), (2, 20)}
    assert (one[2, 20].x, one[2, 20].y) == pytest.approx((22.0, 20 - 6.5)) and one[2, 20]["mean.V"] == pytest.approx(2 * a[4:9, 20:24].mean())
    assert one[1, 18].area == 5 * 2 and one[1, 18].length == pytest.approx(5)
    s = {r.plot: r for r in got.summary.collect()}
    assert s[1].n == 2 and s[1].area_sum == 6 + 10 and s[1].coverage == pytest.approx(16 / 300)
    assert mosaic.analyze_plots(px, plots, mosaic.Grid(0.0, 20.0, 1.0, 1.0), {"V": "R * 2"}, "V", 15.0, 20.0, 1.0, topn_upper=1).individuals.count() == 2


def test_utm(spark):
    p = spark.createDataFrame([(9.0, 0.0), (-75.0, 40.0), (150.5, -33.75)], "lon double, lat double")
    e, n = mosaic.utm(F.col("lon"), F.col("lat"))
    got = [tuple(r) for r in p.select(e, n).collect()]
    assert got[0] == pytest.approx((500000.0, 0.0), abs=1e-3)
    assert got[1] == pytest.approx((500000.0, 4427757.219), abs=0.01)
    assert got[2][0] < 500000 and 6_200_000 < got[2][1] < 6_300_000


def star(rng, cx, cy):
    n = rng.integers(3, 12)
    t, r = np.sort(rng.random(n)) * 2 * np.pi, rng.uniform(0.3, 1, n)
    return cx + r * np.cos(t), cy + r * np.sin(t)


def holds(x, y, px, py):
    out = np.zeros(px.shape, bool)
    for k in range(len(x)):
        x0, y0, x1, y1 = x[k], y[k], x[(k + 1) % len(x)], y[(k + 1) % len(x)]
        with np.errstate(divide="ignore", invalid="ignore"):
            out ^= ((y0 > py) != (y1 > py)) & (px < (x1 - x0) * (py - y0) / (y1 - y0) + x0)
    return out


def test_set_operations_on_any_polygons():
    rng = np.random.default_rng(1)
    py, px = np.mgrid[-1.5:3:500j, -1.5:3:500j]
    for _ in range(15):
        a, b = star(rng, 0, 0), star(rng, *rng.uniform(-0.5, 1.2, 2))
        for name, f in geometry.OPERATIONS.items():
            assert geometry.area(geometry.overlay(*a, *b, name)) == pytest.approx(f(holds(*a, px, py), holds(*b, px, py)).sum() * (4.5 / 499) ** 2, abs=0.02)


def test_predicates_on_slanted_polygons(spark):
    diamond = ([0.0, 4.0, 8.0, 4.0], [4.0, 0.0, 4.0, 8.0])
    rows = [(1, [4.0, 5.0, 4.0, 3.0], [3.0, 4.0, 5.0, 4.0]), (2, [0.0, 1.0, 1.0, 0.0], [0.0, 0.0, 1.0, 1.0]), (3, [7.0, 9.0, 9.0, 7.0], [3.0, 3.0, 5.0, 5.0]), (4, [8.0, 9.0, 9.0, 8.0], [4.0, 4.0, 5.0, 5.0])]
    a, b = spark.createDataFrame(rows, "id int, xs array<double>, ys array<double>"), spark.createDataFrame([(9, *diamond)], "id int, xs array<double>, ys array<double>")
    got = {p: sorted(r.id for r in geometry.select(a, b, 3.0, 3.0, p).collect()) for p in ("within", "overlaps", "touches", "outside", "crosses", "intersects")}
    assert got == {"within": [1], "overlaps": [3], "touches": [4], "outside": [2, 4], "crosses": [3], "intersects": [1, 3, 4]}
    areas = {r.a_id: (r.a_area, r.b_area, r.both, r.meet) for r in geometry.related(a, b, 3.0, 3.0).collect()}
    assert areas[1] == (2.0, 32.0, 2.0, False) and areas[3][2] == pytest.approx(1.0) and areas[3][3] and areas[4][2:] == (0.0, True)
    (cut,) = geometry.combined(a.where("id = 1"), b, 3.0, 3.0, "difference").collect() or [None]
    assert cut is None or cut.area < 1e-9


def test_vector_files(spark, tmp_path):
    df = spark.createDataFrame([("p", [0.0, 2.0, 2.0], [0.0, 0.0, 1.5]), ("q", [1.5, 3.0, 3.0, -1e-7], [0.0, 0.0, 1.0, 2.0])], "name string, xs array<double>, ys array<double>")
    want = sorted(map(tuple, df.collect()))
    for kind in ("parquet", "json", "geojson"):
        vector.write_shapes(df, str(tmp_path / kind), kind)
        got = vector.read_shapes(spark, str(tmp_path / kind), kind)
        assert {"unique_id", "block", "plot_id", "row", "column"} <= set(got.columns)
        name = F.col("properties")["name"] if kind == "geojson" else F.col("name")
        assert sorted(map(tuple, got.select(name, "xs", "ys").collect())) == want
    odd = vector.from_wkt(spark.createDataFrame([("polygon((1 2,3 4,5 7,1 2))",), ("POINT (1 2)",), (None,), ("LINESTRING (0 0, 1 1)",)], "wkt string")).select("xs").collect()
    assert [r.xs for r in odd] == [[1, 3, 5], None, None, [0, 1]]


def test_polygon_operators(spark):
    disc = polygon.circle(spark, 2.0, 200)
    w = {r.height: r.width for r in polygon.width_at(disc, (0.25, 0.5)).collect()}
    assert w[0.5] == pytest.approx(4, rel=0.01) and w[0.25] == pytest.approx(2 * 3**0.5, rel=0.01)
    t = polygon.literal(spark, "t", [(0, 0), (2, 0), (1, 1)])
    a = polygon.apex_base_angle(t, 1.0, 0.0).first()
    assert a.apex == pytest.approx(90) and a.base is None
    smooth = polygon.spline(polygon.n_gon(spark, 8, 1.0), 80).first()
    assert np.hypot(smooth.xs, smooth.ys) == pytest.approx(np.ones(80), abs=0.02)
    p = geometry.point_at(polygon.literal(spark, "l", [(0, 0), (1, 0), (1, 3)]), 0.5).first()
    assert (p.x, p.y) == (1.0, 1.0)
    ends = [geometry.point_at(polygon.literal(spark, "l", [(0, 0), (1, 0), (1, 3)]), s).first() for s in (0.0, 1.0)]
    assert [(r.x, r.y) for r in ends] == [(0, 0), (1, 3)]
    odd = spark.createDataFrame([("a", [1.0, 2.0], [1.0, 2.0]), ("b", [1.0, None, 3.0], [1.0, 2.0, 3.0]), ("c", [1.0, 2.0, 3.0], [1.0, 5.0, 3.0])], "id string, xs array<double>, ys array<double>")
    assert [r.id for r in polygon.check(odd).collect()] == ["c"]
    cells = geometry.curved_grid([(0, 0), (4, 0)], [(0, 2), (4, 2)], 2, 4)
    assert len(cells) == 8 and cells[0] == (1, 1, [0, 1, 1, 0], [0, 0, 1, 1])
    assert {(r.xs[0], r.ys[0]) for r in geometry.buffered_points(spark.createDataFrame([(1, 2.0, 3.0)], "id int, x double, y double"), 0.5).collect()} == {(2.5, 3.0)}


def test_colour_card_and_palettes(spark):
    rng = np.random.default_rng(0)
    known = rng.random((24, 3))
    image = np.ones((80, 120, 3))
    for k, c in enumerate(known):
        r, q = divmod(k, 6)
        image[10 + r * 15 : 10 + r * 15 + 15, 20 + q * 14 : 20 + q * 14 + 14] = c
    card = np.zeros((80, 120), bool)
    card[10:70, 20:104] = True
    corners = colour.find_card(card)
    assert corners == [(20, 10), (103, 10), (103, 69), (20, 69)]
    assert np.allclose(colour.chips(image, corners), known)
    for model, terms in (("cubic", 9), ("root_polynomial", 20)):
        m = colour.fit_correction(known * 0.9, known, model)
        assert m.shape == (terms, 3) and np.allclose(np.stack(colour.MODELS[model](*(known * 0.9).T), 1) @ m, known, atol=1e-6)
    green, red, grey = (spark.createDataFrame((np.array(c) + rng.normal(0, 0.05, (40, 3))).tolist(), "R double, G double, B double") for c in ((0.2, 0.6, 0.3), (0.6, 0.3, 0.2), (0.9, 0.9, 0.9)))
    px = spark.createDataFrame([("i", 0.2, 0.6, 0.3)] * 30 + [("i", 0.6, 0.3, 0.2)] * 10 + [("i", 0.9, 0.9, 0.9)] * 60, "img string, R double, G double, B double")
    (got,) = severity.by_palette(px, green, red, ["R", "G", "B"], ["img"], grey).collect()
    assert (got.healthy, got.symptomatic) == (75.0, 25.0)


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    arrays = {"a": np.round(rng.random((7, 5, 3)) * 255) / 255, "b": np.round(rng.random((4, 6, 1)) * 255) / 255, "c": np.round(rng.random((3, 3, 4)) * 255) / 255}
    for a in arrays.values():
        assert np.allclose(images.decode(images.encode_png(a)), a)
    df = picture(spark, arrays)
    assert images.write(df, str(tmp_path / "out"), prefix="p_") == 3
    for got in (images.read_any(spark, str(tmp_path / "out")).collect(), images.read(spark, str(tmp_path / "out"), "*.png").collect()):
        found = {r.img.rsplit("/p_")[-1][0]: np.array(r.data).reshape(r.h, r.w, r.bands) for r in got}
        assert set(found) == set(arrays) and all(np.allclose(found[k], a) for k, a in arrays.items())
    # JPEG and TIFF written by the JVM, read by Spark's image source.
    jvm = spark.sparkContext._jvm
    for kind in ("jpg", "tiff"):
        jvm.javax.imageio.ImageIO.write(jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(tmp_path / "out/p_a.png"))), kind, jvm.java.io.File(str(tmp_path / f"x.{kind}")))
        (r,) = images.read_any(spark, str(tmp_path / f"x.{kind}")).collect()
        assert (r.h, r.w, r.bands) == (7, 5, 3)
        if kind == "tiff":
            assert np.allclose(np.array(r.data), arrays["a"].ravel())


@pytest.mark.parametrize("rule", range(5))
def test_png_line_filters(rule):
    import struct
    import zlib

    rng = np.random.default_rng(rule)
    a = rng.integers(0, 256, (5, 6, 3))
    rows = b""
    for y in range(5):
        rows += bytes([rule])
        for x in range(6):
            for k in range(3):
                l, u, c = (a[y, x - 1, k] if x else 0), (a[y - 1, x, k] if y else 0), (a[y - 1, x - 1, k] if x and y else 0)
                p = l + u - c
                paeth = min(((abs(p - v), n, v) for n, v in enumerate((l, u, c))))[2]
                rows += bytes([int(a[y, x, k] - (0, l, u, (l + u) // 2, paeth)[rule]) & 255])
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"
    blob = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (np.round(images.decode_png(blob) * 255) == a).all()


def test_text_and_units(spark):
    df = spark.createDataFrame([("TRAT_1", 0.125, float("inf")), ("A-b.c", 0.375, 1.0)], "x string, v double, w double")
    assert [r.v for r in text.round_cols(df, 2).collect()] == [0.12, 0.38]
    assert [(r.a, r.b) for r in text.separate_col(df, "x", ["a", "b"]).collect()] == [("TRAT", "1"), ("A", "b")]
    assert text.check_inf(df).columns == ["x", "v"]
    assert [r[0] for r in df.select(text.trunc_path(F.lit("abcdefghij"), 7)).collect()] == ["ab...ij"] * 2
    got = text.add_missing_columns(df).collect()
    assert [(r.unique_id, r.block, r.plot_id, r.row, r.column) for r in got] == [(1, "B01", "P0001", 1, 1), (2, "B01", "P0002", 1, 1)]
    assert text.check_cols_shp(df.withColumnRenamed("x", "geometry")).columns[-1] == "geometry"
    assert np.allclose(units.palette(3), [(0.65, 0.0, 0.15), (1.0, 1.0, 0.75), (0.0, 0.41, 0.22)]) and units.hues(4) == [15, 105, 195, 285] and len(units.random_colours(5)) == 5


def test_pixels_to_images_with_gaps(spark):
    px = spark.createDataFrame([("a", 0, 1, 2.0), ("a", 1, 0, 3.0), ("b", 0, 0, 1.0)], "img string, row int, col int, v double")
    got = {r.img: (r.h, r.w, r.data) for r in tile.from_pixels(px, "v").collect()}
    assert got == {"a": (2, 2, [None, 2.0, 3.0, None]), "b": (1, 1, [1.0])}


def test_rasters_as_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    for a, kind in ((rng.integers(0, 256, (4, 5, 2)).astype(float), "u1"), (rng.integers(0, 60000, (3, 3, 1)).astype(float), "u2"), (rng.normal(size=(6, 2, 3)).astype(np.float32).astype(float), "f4")):
        assert rasters.number_type(a) == kind
        back, corner, epsg = rasters.decode(rasters.encode(a, (10.0, 20.0, 0.5, 0.25), 4326))
        assert np.array_equal(back, a) and corner == (10.0, 20.0, 0.5, 0.25) and epsg == 4326
    a = np.arange(12.0).reshape(3, 4, 1)
    a[1, 1] = 65535
    (tmp_path / "m.tif").write_bytes(rasters.encode(a, (100.0, 50.0, 2.0, 2.0), 32723))
    (tmp_path / "bad.tif").write_bytes(b"II*")
    got = {r.img[-5:]: r for r in rasters.read(spark, str(tmp_path)).collect()}
    assert got["d.tif"].data is None and got["m.tif"].epsg == 32723 and got["m.tif"].data == [*range(5), None, *range(6, 12)]
    px = {(r.row, r.col): (r.x, r.y, r.v) for r in rasters.pixels(rasters.read(spark, str(tmp_path), glob="m*"), ["v"]).collect()}
    assert len(px) == 12 and px[0, 0] == (101.0, 49.0, 0.0) and px[2, 3] == (107.0, 45.0, 11.0)
    (one,) = rasters.encoded(rasters.read(spark, str(tmp_path), None, "m*")).collect()
    assert np.array_equal(rasters.decode(one.content)[0], a)


def test_lines_and_contours(spark):
    y, x = np.mgrid[:60, :80]
    a = np.where(x + y < 70, 0.0, 1.0)
    found = lines.segments(a)
    assert len(found) == 1
    x1, y1, x2, y2, width, alarms = found[0]
    assert abs(x1 + y1 - 70) < 2 and abs(x2 + y2 - 70) < 2 and np.hypot(x2 - x1, y2 - y1) > 70 and width < 5 and alarms > 10
    assert lines.segments(np.random.default_rng(0).normal(size=(40, 40))) == [] and lines.segments(np.ones((5, 5))) == []
    disc = np.hypot(x - 40.0, y - 30.0)
    (ring,) = lines.contour_lines(disc, 20.0)
    assert np.allclose(ring[0], ring[-1]) and np.allclose(np.hypot(ring[:, 0] - 40, ring[:, 1] - 30), 20, atol=0.02)
    (line,) = lines.contour_lines(x + 0.25 * y, 30.1)
    assert len(line) > 60 and np.allclose(line[:, 0] + 0.25 * line[:, 1], 30.1)
    df = spark.createDataFrame([("a", 60, 80, a.ravel().tolist()), ("b", 2, 2, [1.0] * 4)], "img string, h int, w int, data array<double>")
    assert [(r.img, r.id) for r in lines.line_segments(df).collect()] == [("a", 1)]
    assert {r.img for r in lines.contours(df, 0.5).collect()} == {"a"}


def test_surfaces_and_shapes(spark):
    rng = np.random.default_rng(1)
    p = np.c_[rng.uniform(0, 10, (30, 2)), np.zeros(30)]
    p[:, 2] = 2 + 0.5 * p[:, 0] - p[:, 1]
    u, v = rng.uniform(1, 9, (2, 20))
    for fit in (raster.loess, raster.thin_plate):
        assert np.allclose(fit(p)(u, v), 2 + 0.5 * u - v, atol=1e-6)
    for fit in (raster.thin_plate, lambda q: raster.kriging(q, 5.0)):
        assert np.allclose(fit(p)(p[:, 0], p[:, 1]), p[:, 2], atol=1e-6)
    shapes = outline.random_shapes(spark, 5).collect()
    assert shapes == outline.random_shapes(spark, 5).collect() and len({tuple(r.xs) for r in shapes}) == 5 and len(shapes[0].xs) == 60


def test_kernels_against_plain_loops():
    rng = np.random.default_rng(3)
    for _ in range(10):
        m = rng.random((9, 11)) < 0.6
        back = slow_label(np.pad(~m, 1, constant_values=True), 1, False)
        assert (tile.fill_hull(m) == (back != back[0, 0])[1:-1, 1:-1]).all()
        for f in (tile.thin, tile.thin_guo_hall):
            t = f(m)
            assert (t <= m).all() and slow_label(t).max() == slow_label(m).max()
        assert (tile.skeleton(m) <= m).all()
    a = rng.random((12, 9))
    edges = tile.canny(a)
    assert edges.any() and (edges <= (tile.sobel(tile.blur(a)) > 0)).all()
    flat = tile.clahe(np.linspace(0, 1, 64).reshape(8, 8))
    assert flat.min() >= 0 and flat.max() <= 1 + 1e-9 and (np.diff(flat, axis=1) > -0.3).all()
    g = np.minimum(((a - a.min()) / (a.max() - a.min()) * 4).astype(int), 3)
    p = np.zeros((4, 4))
    for r in range(12):
        for c in range(9):
            for y, x in ((0, 1), (1, 0), (1, 1), (1, -1)):
                if 0 <= r + y < 12 and 0 <= c + x < 9:
                    p[g[r, c], g[r + y, c + x]] += 1
                    p[g[r + y, c + x], g[r, c]] += 1
    p /= p.sum()
    i, j = np.mgrid[:4, :4]
    got = dict(zip(tile.HARALICK, tile.haralick(a, 4)[0], strict=True))
    assert got["asm"] == pytest.approx((p**2).sum()) and got["con"] == pytest.approx(((i - j) ** 2 * p).sum()) and got["idm"] == pytest.approx((p / (1 + (i - j) ** 2)).sum()) and got["ent"] == pytest.approx(-(p[p > 0] * np.log(p[p > 0])).sum())
    points = [tuple(q) for q in rng.random((40, 2))]
    h = polygon.hull(points)
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    assert all(side(h[k - 1], h[k], q) >= -1e-12 for k in range(len(h)) for q in points)
