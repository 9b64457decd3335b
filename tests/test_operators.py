import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldframe.functions import formula, indexes
from fieldframe.operators import outline, polygon, raster, spatial, stats, threshold, tile


def test_formula_refuses_code():
    for text in ("__import__('os')", "R.x", "R if G else B", "[R]", "f(R)"):
        with pytest.raises((ValueError, SyntaxError)):
            formula.parse(text)
    assert formula.bands("(750nm - R^2)/h") == {"nm750", "R", "hsb_h"}
    assert len(indexes.CATALOGUE) == 115


def test_entropy_known_value(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 2, 3, 3, 3, 4, 4, 4, 4)], "g string, v double")
    assert stats.entropy(df, "v", ["g"]).first().entropy == pytest.approx(1.279854, abs=1e-6)


def test_otsu_parts_two_heaps(spark):
    rng = np.random.default_rng(0)
    v = np.r_[rng.normal(0.2, 0.03, 400), rng.normal(0.8, 0.03, 300)]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),), (float("inf"),)], "v double")
    assert 0.27 < threshold.otsu(df, "v").first().threshold < 0.73
    assert threshold.otsu(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").first().threshold == 1.0


def test_circle_and_n_gons(spark):
    got = polygon.measures(polygon.circle(spark, 2.0, 1000)).first()
    assert got.perimeter == pytest.approx(4 * math.pi, rel=1e-4) and got.area == pytest.approx(4 * math.pi, rel=1e-4)
    for n in (6, 12, 100):
        r = polygon.n_gon(spark, n).select(polygon.area().alias("a"), polygon.perimeter().alias("p")).first()
        assert r.a == pytest.approx(n / 2 * math.sin(2 * math.pi / n)) and r.p == pytest.approx((n - 1) * 2 * math.sin(math.pi / n))


def test_hull_and_solidity(spark):
    star = polygon.literal(spark, "star", [(0, 0), (2, 1), (4, 0), (3, 2), (4, 4), (2, 3), (0, 4), (1, 2)])
    r = polygon.hull_measures(star).first()
    assert r.area_ch == 16.0 and r.solidity == pytest.approx(0.5)


def test_fourier_outline_comes_back(spark):
    ring = polygon.circle(spark, 3.0, 200)
    e = outline.efourier(ring, 6)
    back = outline.inverse(e, 60).first()
    assert all(abs(math.hypot(x, y) - 3.0) < 0.03 for x, y in zip(back.xs, back.ys, strict=True))
    first = outline.power(e).where("n = 1").first()
    assert first.cum > 0.999


def test_tile_kernels():
    a = np.zeros((7, 9))
    a[1:6, 1:4] = 1
    a[3, 4] = 1
    a[1:6, 5:8] = 1
    assert tile.label(a).max() == 1
    assert set(np.unique(tile.watershed(a))) == {0, 1, 2}
    assert tile.distance(a)[3, 2] == 2
    hole = np.ones((5, 5))
    hole[2, 2] = 0
    assert tile.fill_hull(hole).all()
    line = np.zeros((5, 11))
    line[1:4, 1:10] = 1
    for thin in (tile.thin, tile.thin_guo_hall):
        assert 5 <= thin(line).sum() <= 9
    assert tile.contour(np.pad(np.ones((3, 3)), 1)) == [(1, 1), (1, 2), (1, 3), (2, 3), (3, 3), (3, 2), (3, 1), (2, 1)]
    assert np.allclose(tile.rotate(line, 360), line)
    assert tile.canny(np.c_[np.zeros((8, 4)), np.ones((8, 4))]).any()


def test_surfaces_go_through_their_points():
    p = np.array([(0, 0, 1.0), (5, 0, 2.0), (0, 5, 0.0), (4, 4, 3.0)])
    for f in (raster.thin_plate(p), raster.kriging(p, 3.0)):
        assert np.allclose(f(p[:, 0], p[:, 1]), p[:, 2], atol=1e-6)


def test_downsampling_factor():
    assert spatial.aggregation_factor(100, 1000) == 0
    assert spatial.aggregation_factor(4000, 4000) == 4


def test_classes_and_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.0,), (0.5,), (9.0,)], "v double").select("v", threshold.classify(F.col("v"), [0.0, 1.0]).alias("c"))
    assert [r.c for r in df.collect()] == [None, 1, 1, 2, 3]
