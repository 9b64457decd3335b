"""Measures of labelled objects from pixel tables (img, id, row/col or x/y, bands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def object_rgb(pixels: DataFrame, labels: DataFrame | None, on: list[str], bands: list[str]) -> DataFrame:
    """(on..., id, bands) of the pixels of objects; label 0 is background. Pixels that carry their label themselves (labels
    None) are not joined, so repeated ones and those without a key stay as they are."""
    labelled = pixels.where("id > 0") if labels is None else pixels.join(labels.where("id > 0"), on)
    return labelled.select(*on, "id", *bands)


def measures(pixels: DataFrame, x: str, y: str, indexes: list[str], by: tuple[str, ...] = ("img", "id")) -> DataFrame:
    """Per object: area (pixels), centroid, bounding box, moment axes, angle, eccentricity, mean of each index; one shuffle
    with partial aggregation."""
    vx, vy, c = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    aggs = pixels.groupBy(*by).agg(
        F.count("*").alias("area"), F.avg(x).alias("x"), F.avg(y).alias("y"), F.min(x).alias("xmin"), F.max(x).alias("xmax"), F.min(y).alias("ymin"), F.max(y).alias("ymax"),
        vx.alias("__vx"), vy.alias("__vy"), c.alias("__c"), *[F.avg(i).alias(i) for i in indexes],
    )
    root = F.sqrt(F.pow(F.col("__vx") - F.col("__vy"), F.lit(2.0)) + F.col("__c") * F.col("__c") * 4.0)
    major, minor = F.sqrt((F.col("__vx") + F.col("__vy") + root) / 2.0), F.sqrt(F.greatest((F.col("__vx") + F.col("__vy") - root) / 2.0, F.lit(0.0)))
    out = aggs.withColumns({"major_axis": major, "minor_axis": minor, "theta": F.atan2(F.col("__c") * 2.0, F.col("__vx") - F.col("__vy")) / 2.0})
    return out.withColumn("eccentricity", F.sqrt(1.0 - F.pow(F.try_divide(F.col("minor_axis"), F.col("major_axis")), F.lit(2.0)))).drop("__vx", "__vy", "__c")


def bbox(pixels: DataFrame, x: str, y: str, by: list[str], edge: float = 0) -> DataFrame:
    return pixels.groupBy(*by).agg((F.min(x) - edge).alias("xmin"), (F.max(x) + edge).alias("xmax"), (F.min(y) - edge).alias("ymin"), (F.max(y) + edge).alias("ymax"))


def keep(objects: DataFrame, lower_noise: float | None = None, lower_size: float | None = None, upper_size: float | None = None, topn_lower: int | None = None, topn_upper: int | None = None, within: str = "img", area: str = "area", tie: str = "id") -> DataFrame:
    """Objects whose area exceeds a share of the image's mean area and lies between the sizes; then the largest or smallest."""
    if lower_noise is not None:
        mean = objects.groupBy(F.col(within).alias("__g")).agg(F.avg(area).alias("__mean"))
        objects = objects.join(mean, F.col(within) == F.col("__g")).where(F.col(area) > F.col("__mean") * lower_noise).drop("__g", "__mean")
    if lower_size is not None:
        objects = objects.where(F.col(area) > lower_size)
    if upper_size is not None:
        objects = objects.where(F.col(area) < upper_size)
    for n, order in ((topn_lower, F.asc(area)), (topn_upper, F.desc(area))):
        if n is not None:
            objects = objects.withColumn("__r", F.row_number().over(Window.partitionBy(within).orderBy(order, tie))).where(F.col("__r") <= n).drop("__r")
    return objects


def statistics(objects: DataFrame, by: list[str], value: str = "area", *more: Column) -> DataFrame:
    """n, mean, min, max, sum and sample sd of a measure, and further aggregates."""
    v = F.col(value)
    return objects.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias(f"{value}_mean"), F.min(v).alias(f"{value}_min"), F.max(v).alias(f"{value}_max"), F.sum(v).alias(f"{value}_sum"), F.stddev_samp(v).alias(f"{value}_sd"), *more)


def scaled(objects: DataFrame, factor: Column, areas: list[str], lengths: list[str]) -> DataFrame:
    """Lengths times the factor, areas times its square."""
    return objects.withColumns({c: F.col(c) * factor for c in lengths} | {c: F.col(c) * factor * factor for c in areas})


def by_dpi(objects: DataFrame, dpi: float, areas: list[str], lengths: list[str]) -> DataFrame:
    """Pixels to centimetres."""
    return scaled(objects, F.lit(2.54 / dpi), areas, lengths)


def by_known(objects: DataFrame, known: Column, value: float, of: str, areas: list[str], lengths: list[str], by: str = "img", is_area: bool = True) -> DataFrame:
    """Scaled so that each image's known object has the value (an area, or a length); the known object is left out. One
    known object an image is what the join carries."""
    ratio = F.lit(float(value)) / F.max(F.when(known, F.col(of)))
    factor = objects.groupBy(F.col(by).alias("__g")).agg((F.sqrt(ratio) if is_area else ratio).alias("__f"))
    return scaled(objects.join(factor, F.col(by) == F.col("__g")).where(~known), F.col("__f"), areas, lengths).drop("__g", "__f")


def summary_within(pixels: DataFrame, index: str, cut: float, by: list[str]) -> DataFrame:
    """Per object: mean, min, max and sd of an index and how many pixels lie above and below the cut."""
    v = F.col(index)
    out = pixels.groupBy(*by).agg(F.count(v).alias("n"), F.count_if(v > cut).alias("n_greater"), F.count_if(v <= cut).alias("n_less"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_samp(v).alias("sd"))
    return out.withColumns({"greater_ratio": F.try_divide(F.col("n_greater"), F.col("n")), "less_ratio": F.try_divide(F.col("n_less"), F.col("n"))})


def spacing(points: DataFrame, by: list[str], order: str, x: str = "x", y: str = "y", tie: str = "id") -> DataFrame:
    """Distance of each object to the next one in order, within its group; groups are rows of plants, of bounded size."""
    w = Window.partitionBy(*by).orderBy(order, tie)
    dx, dy = F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y)
    return points.withColumn("distance", F.sqrt(dx * dx + dy * dy))


def spacing_summary(points: DataFrame, by: list[str], order: str) -> DataFrame:
    """Mean distance of neighbours and its coefficient of variation in per cent."""
    d = F.col("distance")
    return spacing(points, by, order).where(d.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("mean_distance"), (F.try_divide(F.stddev_samp(d), F.avg(d)) * 100.0).alias("cv"))
