"""Rasters (img, row, col, bands): projections of coordinates, canopy height, surfaces, classes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crop(px: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Pixels within both closed ranges, counted anew from zero."""
    kept = px.where(F.col("row").between(*rows) & F.col("col").between(*cols))
    return kept.withColumns({"row": F.col("row") - rows[0], "col": F.col("col") - cols[0]})


def dimensions(px: DataFrame) -> DataFrame:
    return px.groupBy("img").agg((F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"), F.count("*").alias("npixels"))


def trim(px: DataFrame, h: int, w: int, top: int = 0, bottom: int = 0, left: int = 0, right: int = 0) -> DataFrame:
    return crop(px, (top, h - 1 - bottom), (left, w - 1 - right))


def reflect(px: DataFrame, h: int, w: int, horizontal: bool = True) -> DataFrame:
    return px.withColumn("col", w - 1 - F.col("col")) if horizontal else px.withColumn("row", h - 1 - F.col("row"))


def rotate90(px: DataFrame, h: int, w: int, angle: int, clockwise: bool = True) -> DataFrame:
    """Turned by 90, 180 or 270 degrees."""
    angle = angle % 360 if clockwise else -angle % 360
    r, c = F.col("row"), F.col("col")
    new = {0: (r, c), 90: (c, h - 1 - r), 180: (h - 1 - r, w - 1 - c), 270: (w - 1 - c, r)}[angle]
    return px.withColumns({"row": new[0], "col": new[1]})


def aggregate(px: DataFrame, factor: int, values: list[str], how: str = "mean") -> DataFrame:
    """factor by factor pixels become one: their mean, median, min, max or sum, or the nearest one to the first corner."""
    f = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum}.get(how)
    r, c = F.floor(F.col("row") / factor).cast("int"), F.floor(F.col("col") / factor).cast("int")
    if f is None:
        return px.where((F.col("row") % factor == 0) & (F.col("col") % factor == 0)).withColumns({"row": r, "col": c})
    return px.groupBy("img", r.alias("row"), c.alias("col")).agg(*[f(v).alias(v) for v in values])


def resample_nearest(px: DataFrame, h: int, w: int, new_h: int, new_w: int) -> DataFrame:
    """Nearest-neighbour resampling: each pixel is sent to the places that it fills."""
    def places(old: str, n: int, new_n: int):
        first, after = F.ceil((F.col(old) * new_n) / n).cast("int"), F.ceil(((F.col(old) + 1) * new_n) / n).cast("int")
        return F.when(after > first, F.sequence(first, after - 1)).otherwise(F.array().cast("array<int>"))

    return px.withColumn("__r", F.explode(places("row", h, new_h))).withColumn("__c", F.explode(places("col", w, new_w))).withColumns({"row": F.col("__r"), "col": F.col("__c")}).drop("__r", "__c")


def expand(px: DataFrame, h: int, w: int, edge: int, value: str, background: float | None = 1.0) -> DataFrame:
    """A border around every image: of the background, or (None) of the nearest edge pixel. The border is four strips, made
    from the edge pixels alone."""
    inner = px.select("img", (F.col("row") + edge).alias("row"), (F.col("col") + edge).alias("col"), value)
    last_r, last_c = h + 2 * edge - 1, w + 2 * edge - 1
    rows = F.when(F.col("row") == edge, F.sequence(F.lit(0), F.lit(edge))).otherwise(F.array(F.col("row").cast("int")))
    rows = F.concat(rows, F.when(F.col("row") == last_r - edge, F.sequence(F.lit(last_r - edge + 1), F.lit(last_r))).otherwise(F.array().cast("array<int>")))
    cols = F.when(F.col("col") == edge, F.sequence(F.lit(0), F.lit(edge))).otherwise(F.array(F.col("col").cast("int")))
    cols = F.concat(cols, F.when(F.col("col") == last_c - edge, F.sequence(F.lit(last_c - edge + 1), F.lit(last_c))).otherwise(F.array().cast("array<int>")))
    rim = inner.where(F.col("row").isin(edge, last_r - edge) | F.col("col").isin(edge, last_c - edge)) if edge else inner.where("false")
    border = rim.withColumn("__r", F.explode(rows)).withColumn("__c", F.explode(cols)).where((F.col("__r") != F.col("row")) | (F.col("__c") != F.col("col")))
    border = border.select("img", F.col("__r").alias("row"), F.col("__c").alias("col"), (F.col(value) if background is None else F.lit(float(background))).alias(value))
    return inner.unionByName(border)


def alpha(px: DataFrame, mask: str | float) -> DataFrame:
    return px.withColumn("A", F.col(mask).cast("double") if isinstance(mask, str) else F.lit(float(mask)))


def chm(dsm: DataFrame, dtm: DataFrame, value: str = "v") -> DataFrame:
    """(img, row, col, height): surface less terrain, joined by cell."""
    t = dtm.select("img", "row", "col", F.col(value).alias("__t"))
    return dsm.join(t, ["img", "row", "col"]).select("img", "row", "col", (F.col(value) - F.col("__t")).alias("height"))


def ground(dsm: DataFrame, window: int, quantile: float = 0.0, value: str = "v", smooth: bool = False, accuracy: int | None = None) -> DataFrame:
    """Terrain from a surface: the quantile of each window by window block, given back to its pixels as it is or, with
    ``smooth``, bilinearly between the middles of the blocks around. accuracy: an approximate quantile, for blocks of many
    pixels (a block's distinct values are kept otherwise)."""
    size = lambda c: F.floor(F.col(c) / window).cast("int")
    q = F.percentile(value, F.lit(quantile)) if accuracy is None else F.percentile_approx(value, quantile, accuracy)
    low = dsm.groupBy("img", size("row").alias("__r"), size("col").alias("__c")).agg(q.alias("__g"))
    if not smooth:
        out = dsm.withColumns({"__r": size("row"), "__c": size("col")}).join(low, ["img", "__r", "__c"])
        return out.select("img", "row", "col", F.col("__g").alias(value))
    # A pixel lies between four middles, whose weights fall with distance; blocks beyond the border have none.
    y, x = (F.col("row") + 0.5) / window - 0.5, (F.col("col") + 0.5) / window - 0.5
    corner = F.explode(F.array(*[F.struct((F.floor(y) + r).cast("int").alias("__r"), (F.floor(x) + c).cast("int").alias("__c"), ((1 - r + (2 * r - 1) * (y - F.floor(y))) * (1 - c + (2 * c - 1) * (x - F.floor(x)))).alias("__w")) for r in (0, 1) for c in (0, 1)]))
    near = dsm.select("img", "row", "col", corner.alias("p")).select("img", "row", "col", "p.*").where("__w > 0").join(low, ["img", "__r", "__c"])
    return near.groupBy("img", "row", "col").agg((F.sum(F.col("__g") * F.col("__w")) / F.sum("__w")).alias(value))


def chm_extract(heights: DataFrame, by: list[str], cell: float = 1.0, threshold: float = 0.0, quantiles: tuple[float, ...] = (0, 0.05, 0.5, 0.95, 1)) -> DataFrame:
    """Per plot: quantiles, mean, cv (mean over sd), volume, coverage (share above the threshold) and entropy of heights."""
    v = F.col("height")
    counts = heights.groupBy(*by, F.round(v, 2).alias("__v")).agg(F.count("*").cast("double").alias("__n"))
    e = counts.groupBy(*by).agg((F.ln(F.sum("__n")) - F.sum(F.col("__n") * F.ln("__n")) / F.sum("__n")).alias("entropy"))
    g = heights.groupBy(*by).agg(*[F.percentile(v, F.lit(float(q))).alias(f"q{round(q * 100)}") for q in quantiles], F.avg(v).alias("mean"), F.try_divide(F.avg(v), F.stddev_samp(v)).alias("cv"), (F.sum(v) * cell).alias("volume"), (F.count_if(v > threshold) / F.count(v)).alias("coverage"))
    return g.join(e, by)


def chm_mask(heights: DataFrame, lower: float, upper: float | None = None) -> DataFrame:
    inside = F.col("height") > lower
    return heights.withColumn("mask", inside if upper is None else inside & (F.col("height") < upper))


def histogram(px: DataFrame, value: str, by: list[str], low: float, high: float, bins: int) -> DataFrame:
    """(by..., bin, count) over equal bins; the ends take what lies beyond."""
    k = F.greatest(F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)), F.lit(0)).cast("int")
    return px.where(F.col(value).isNotNull()).groupBy(*by, k.alias("bin")).agg(F.count("*").alias("count"))


def plane(px: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., b0, bx, by_): least-squares plane over row and col, by the normal equations from one aggregation."""
    x, y, z = F.col("col").cast("double"), F.col("row").cast("double"), F.col(value)
    g = px.groupBy(*by).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"), F.covar_pop(x, x).alias("xx"), F.covar_pop(y, y).alias("yy"), F.covar_pop(x, y).alias("xy"), F.covar_pop(x, z).alias("xz"), F.covar_pop(y, z).alias("yz"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    g = g.withColumns({"bx": F.try_divide(F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy"), det), "by_": F.try_divide(F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy"), det)})
    return g.select(*by, (F.col("mz") - F.col("bx") * F.col("mx") - F.col("by_") * F.col("my")).alias("b0"), "bx", "by_")


def thin_plate(points: np.ndarray, smooth: float = 0.0):
    """Thin-plate spline through control points (x, y, z): few by nature, so it is fitted on the driver. Returns f(x, y)."""
    p = points[:, :2]
    radial = lambda d2: np.where(d2 > 0, d2 * np.log(np.maximum(d2, 1e-300)) / 2, 0.0)
    n = len(p)
    k = radial(((p[:, None] - p[None]) ** 2).sum(2)) + smooth * np.eye(n)
    q = np.c_[np.ones(n), p]
    w = np.linalg.lstsq(np.block([[k, q], [q.T, np.zeros((3, 3))]]), np.r_[points[:, 2], 0, 0, 0], rcond=None)[0]
    return lambda x, y: radial((x[:, None] - p[:, 0]) ** 2 + (y[:, None] - p[:, 1]) ** 2) @ w[:n] + w[n] + w[n + 1] * x + w[n + 2] * y


def kriging(points: np.ndarray, scale: float, nugget: float = 0.0):
    """Ordinary kriging with an exponential covariance. Returns f(x, y)."""
    p = points[:, :2]
    n = len(p)
    cov = lambda d: np.exp(-d / scale)
    a = np.block([[cov(np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))) + nugget * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    w = np.linalg.solve(a, np.r_[points[:, 2], 0])
    return lambda x, y: cov(np.sqrt((x[:, None] - p[:, 0]) ** 2 + (y[:, None] - p[:, 1]) ** 2)) @ w[:n] + w[n]


def predict(px: DataFrame, surface, x: str = "col", y: str = "row", name: str = "value") -> DataFrame:
    """A fitted surface at every pixel, in Arrow batches."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            v = surface(b.column(x).to_numpy(zero_copy_only=False).astype(float), b.column(y).to_numpy(zero_copy_only=False).astype(float))
            yield b.append_column(name, pa.array(v, pa.float64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in px.schema)
    return px.mapInArrow(run, f"{kinds}, {name} double")




def loess(points, span: float = 0.75):
    """Local linear regression of control points (x, y, z) with tricube weights over the nearest share of them: a function
    of arrays x and y, for ``predict``."""
    import numpy as np

    p = np.asarray(points, float)
    k = max(int(np.ceil(span * len(p))), 3)

    def at(x, y):
        x, y = np.broadcast_arrays(np.asarray(x, float), np.asarray(y, float))
        out = np.empty(x.size)
        for i, (u, v) in enumerate(zip(x.ravel(), y.ravel(), strict=True)):
            d = np.hypot(p[:, 0] - u, p[:, 1] - v)
            near = np.argsort(d, kind="stable")[:k]
            w = np.sqrt(np.maximum(1 - (d[near] / max(d[near].max() * 1.0001, 1e-12)) ** 3, 0) ** 3)
            a = np.stack((np.ones(len(near)), p[near, 0] - u, p[near, 1] - v), axis=1)
            out[i] = np.linalg.lstsq(a * w[:, None], p[near, 2] * w, rcond=None)[0][0]
        return out.reshape(x.shape)

    return at
