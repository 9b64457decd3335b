"""Plot-level analysis of a raster: index, mask, individuals, zonal statistics, plot summary, spacing.

A raster is a pixel table (row, col, x, y, bands), x and y being the pixels' centres; plots are boxes (id, xmin, xmax,
ymin, ymax). Pixels find their plots by an equi-join on grid cells, and everything by plot is a partial aggregate. Only
individuals need neighbourhoods: a plot's mask becomes one row (plots are of bounded size), is labelled and traced there,
and its outlines go back to map coordinates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldframe.functions import formula

from . import analyze, objects, polygon, spatial, threshold, tile

#: The measures of an individual in a raster.
MEASURES = "area perimeter length width diam_min diam_mean diam_max".split()


@dataclass(frozen=True)
class Grid:
    """Where a raster lies: its upper left corner and the size of a pixel."""

    xmin: float
    ymax: float
    resx: float
    resy: float


def located(pixels: DataFrame, grid: Grid) -> DataFrame:
    """Pixels (row, col) with the map coordinates of their centres."""
    return pixels.withColumns({"x": F.lit(grid.xmin) + (F.col("col") + 0.5) * grid.resx, "y": F.lit(grid.ymax) - (F.col("row") + 0.5) * grid.resy})


def clip(pixels: DataFrame, plots: DataFrame, cell_x: float, cell_y: float, keep: list[str] | None = None) -> DataFrame:
    """The pixels of every plot, with the plot's id as ``plot``; partition a written table by it for a file a plot."""
    return spatial.contains(pixels, plots.withColumnRenamed("id", "plot"), cell_x, cell_y, ["plot", *(keep or [])])


def index(pixels: DataFrame, equations: dict[str, str]) -> DataFrame:
    return pixels.withColumns({name: formula.column(e) for name, e in equations.items()})


def masked(pixels: DataFrame, value: str, cut: float | None = None, invert: bool = False) -> DataFrame:
    """pixels with ``mask``: above the threshold (Otsu's over all pixels, or the one given); with ``invert`` not above.
    Pixels without a value are outside either way."""
    if cut is None:
        pixels = pixels.crossJoin(F.broadcast(threshold.otsu(pixels, value).withColumnRenamed("threshold", "__cut")))  # one row
    else:
        pixels = pixels.withColumn("__cut", F.lit(float(cut)))
    above = F.col(value) > F.col("__cut")
    return pixels.withColumn("mask", F.coalesce(~above if invert else above, F.lit(False))).drop("__cut")


def labelled(clipped: DataFrame, how: analyze.Segmentation = analyze.Segmentation(watershed=False)) -> DataFrame:
    """(img: the plot, h, w, data): label images of the plots' masks, after median, erosion, dilation, opening and closing."""

    def kernel(a):
        import numpy as np

        mask = np.nan_to_num(a) > 0
        if how.filter:
            mask = tile.median(mask.astype(float), how.filter) > 0.5
        for size, step in ((how.erode, tile.erode), (how.dilate, tile.dilate), (how.opening, tile.opening), (how.closing, tile.closing)):
            if size:
                mask = step(mask.astype(float), tile.brush(size)) > 0
        return analyze.labels_of(tile.fill_hull(mask) if how.fill_hull else mask, how)

    corner = clipped.groupBy("plot").agg(F.min("row").alias("__r"), F.min("col").alias("__c")).withColumnRenamed("plot", "__p")
    local = clipped.join(corner, F.col("plot") == F.col("__p")).select("plot", (F.col("row") - F.col("__r")).alias("row"), (F.col("col") - F.col("__c")).alias("col"), F.col("mask").cast("double").alias("v"))
    return tile.apply(tile.from_pixels(local, "v", "plot"), kernel)


def compute_measures(rings: DataFrame) -> DataFrame:
    """Rings in map coordinates with MEASURES beside them (area: of the outline)."""
    r = polygon.radius_stats(polygon.axes(rings))
    return r.withColumns({"area": polygon.area(), "perimeter": polygon.perimeter()})


def vectorize(labels: DataFrame, clipped: DataFrame, grid: Grid) -> DataFrame:
    """(plot, individual, npixels, x, y, xs, ys, MEASURES): the outline of every object of the plots' label images, in map
    coordinates. Objects of fewer than three border pixels are left out."""
    corner = clipped.groupBy(F.col("plot").alias("__p")).agg(F.min("row").alias("__r"), F.min("col").alias("__c"))
    found = analyze.outlines(labels).where(F.size("xs") >= 3).join(corner, F.col("img") == F.col("__p"))
    x = F.transform("xs", lambda v: F.lit(grid.xmin) + (v + F.col("__c") + 0.5) * grid.resx)
    y = F.transform("ys", lambda v: F.lit(grid.ymax) - (v + F.col("__r") + 0.5) * grid.resy)
    rings = found.select(F.col("img").alias("plot"), F.col("id").alias("individual"), F.col("area").alias("npixels"), x.alias("xs"), y.alias("ys"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    out = compute_measures(rings).withColumns({"x": mean(F.col("xs")), "y": mean(F.col("ys"))})
    return out.select("plot", "individual", "npixels", "x", "y", "xs", "ys", *MEASURES)


def zonal(clipped: DataFrame, by: list[str], indexes: list[str], functions: tuple[str, ...] = ("mean", "min", "max", "stddev_samp")) -> DataFrame:
    """(by..., function.index for each): statistics over the masked pixels of each zone."""
    return clipped.where("mask").groupBy(*by).agg(*[getattr(F, f)(i).alias(f"{f}.{i}") for i in indexes for f in functions])


def individual_pixels(clipped: DataFrame, labels: DataFrame) -> DataFrame:
    """The masked pixels with the ``individual`` that they are of."""
    corner = clipped.groupBy("plot").agg(F.min("row").alias("__r"), F.min("col").alias("__c")).withColumnRenamed("plot", "__p")
    at = tile.to_pixels(labels, "individual").where("individual > 0").join(corner, F.col("img") == F.col("__p"))
    at = at.select(F.col("img").alias("__plot"), (F.col("row") + F.col("__r")).alias("__row"), (F.col("col") + F.col("__c")).alias("__col"), F.col("individual").cast("int").alias("individual"))
    return clipped.join(at, (F.col("plot") == F.col("__plot")) & (F.col("row") == F.col("__row")) & (F.col("col") == F.col("__col"))).drop("__plot", "__row", "__col")


def plot_area(clipped: DataFrame, grid: Grid) -> DataFrame:
    """(plot, plot_area, covered_area, coverage)."""
    size = grid.resx * grid.resy
    g = clipped.groupBy("plot").agg((F.count("*") * size).alias("plot_area"), (F.count_if("mask") * size).alias("covered_area"))
    return g.withColumn("coverage", F.col("covered_area") / F.col("plot_area"))


@dataclass(frozen=True)
class Analysis:
    """What ``analyze`` returns: a table a plot, a table an individual, and the individuals' means a plot."""

    plots: DataFrame
    individuals: DataFrame
    summary: DataFrame


def analyze_plots(pixels: DataFrame, plots: DataFrame, grid: Grid, equations: dict[str, str], segment_index: str, cell_x: float, cell_y: float, cut: float | None = None, invert: bool = False, how: analyze.Segmentation = analyze.Segmentation(watershed=False), lower_size: float | None = None, upper_size: float | None = None, topn_lower: int | None = None, topn_upper: int | None = None) -> Analysis:
    """A raster (row, col, bands) by plots: the indexes, the mask by one of them, the statistics of its pixels by plot and by
    individual, the individuals' measures, and their number, mean measures, area and coverage by plot."""
    clipped = clip(masked(index(located(pixels, grid), equations), segment_index, cut, invert), plots, cell_x, cell_y)
    labels = labelled(clipped, how)
    found = vectorize(labels, clipped, grid).withColumnRenamed("individual", "id")
    found = objects.keep(found, None, lower_size, upper_size, topn_lower, topn_upper, within="plot").withColumnRenamed("id", "individual")
    zones = zonal(individual_pixels(clipped, labels), ["plot", "individual"], list(equations), ("mean",))
    individuals = found.join(zones, ["plot", "individual"], "left")
    areas = plot_area(clipped, grid)
    by_plot = areas.join(zonal(clipped, ["plot"], list(equations)), "plot", "left")
    numbers = found.groupBy("plot").agg(F.count("*").alias("n"), F.sum("area").alias("area_sum"), *[F.avg(m).alias(m) for m in MEASURES])
    summary = areas.select("plot", "plot_area").join(numbers, "plot", "left").withColumn("coverage", F.col("area_sum") / F.col("plot_area"))
    return Analysis(by_plot, individuals, summary)


def to_rgb(pixels: DataFrame, r: str = "R", g: str = "G", b: str = "B") -> DataFrame:
    """(row, col, R, G, B) of three bands, stretched over their ranges; the ranges are one row."""
    ends = pixels.agg(*[f(c).alias(f"__{n}{k}") for c, n in ((r, "r"), (g, "g"), (b, "b")) for k, f in enumerate((F.min, F.max))])
    one = lambda c, n: F.coalesce(F.try_divide(F.col(c) - F.col(f"__{n}0"), F.col(f"__{n}1") - F.col(f"__{n}0")), F.lit(0.0))
    return pixels.crossJoin(F.broadcast(ends)).select("row", "col", one(r, "r").alias("R"), one(g, "g").alias("G"), one(b, "b").alias("B"))


def aligned(dsm: DataFrame, of: Grid, to: Grid, value: str = "v") -> DataFrame:
    """(row, col, value) of another raster's grid: the mean of the pixels whose centres fall into each of its cells."""
    at = located(dsm, of)
    row, col = F.floor((F.lit(to.ymax) - F.col("y")) / to.resy).cast("int"), F.floor((F.col("x") - to.xmin) / to.resx).cast("int")
    return at.groupBy(row.alias("row"), col.alias("col")).agg(F.avg(value).alias(value))


def stacked(bands: dict[str, DataFrame]) -> DataFrame:
    """(row, col, a column for each band) of single-band rasters (row, col, v): one shuffle by place."""
    tagged = [df.select("row", "col", F.lit(k).alias("__b"), "v") for k, df in bands.items()]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    return every.groupBy("row", "col").agg(*[F.max(F.when(F.col("__b") == k, F.col("v"))).alias(k) for k in bands])


def along_line(pixels: DataFrame, grid: Grid, x0: float, y0: float, x1: float, y1: float, n: int, columns: list[str]) -> DataFrame:
    """(k, x, y, columns): the pixels under n places along a line, of whatever a user has drawn."""
    spark = pixels.sparkSession
    at = spark.range(n).select(F.col("id").cast("int").alias("k"), (F.lit(float(x0)) + (x1 - x0) * F.col("id") / max(n - 1, 1)).alias("x"), (F.lit(float(y0)) + (y1 - y0) * F.col("id") / max(n - 1, 1)).alias("y"))
    at = at.withColumns({"row": F.floor((F.lit(grid.ymax) - F.col("y")) / grid.resy), "col": F.floor((F.col("x") - grid.xmin) / grid.resx)})
    return at.join(pixels.select("row", "col", *columns), ["row", "col"]).select("k", "x", "y", *columns)


def utm(lon, lat) -> tuple:
    """Easting and northing (WGS 84) of longitudes and latitudes in degrees, in the UTM zone of each, as Columns: the
    transverse Mercator series to the fourth order, good to a millimetre within a zone."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    zone = F.floor((lon + 180.0) / 6.0) + 1
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    atanh = lambda v: F.log((1 + v) / (1 - v)) / 2
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + k0 * big * east, k0 * big * north + F.when(lat < 0, 10000000.0).otherwise(0.0)
