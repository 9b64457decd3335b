"""Thresholds, masks, classes and ratios over pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 256
#: Up to FEW groups' rows (of a few numbers each) go to every task; those of more are joined in SHARES shares.
FEW, SHARES = 1 << 16, 64


def share(pixels: DataFrame) -> Column:
    """A number below SHARES by the pixel's own columns, the same whenever the pixel is read."""
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in pixels.columns]), F.lit(SHARES)).cast("int")


def beside(pixels: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """pixels with the columns of their group's row (by..., ...); pixels whose group has none are left out.

    One image may hold most pixels, so pixels are never dealt by group alone. Up to FEW rows are taken once and handed to
    every task, and no pixel is sent. The rows of more groups are repeated in SHARES shares, and pixels meet them by group
    and share.
    """
    few = groups.limit(FEW + 1).toArrow()
    if few.num_rows <= FEW:
        return pixels.join(F.broadcast(groups.sparkSession.createDataFrame(few, groups.schema)), by)
    dealt = pixels if "__share" in pixels.columns else pixels.withColumn("__share", share(pixels))
    rows = groups.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return dealt.join(rows, [*by, "__share"]).drop("__share")


def otsu(pixels: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., threshold) by Otsu's method over 256 bins of each group's range; nulls, NaN and infinities are left out.

    Pixels are only counted: the extremes and the bins are partial aggregates, and what is sorted has at most 256 rows a
    group. The groups' extremes reach the pixels as in ``beside``. The first bin of the largest between-class variance wins.
    """
    by = by or []
    v = F.col(value)
    some = pixels.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).select(*by, v.alias("__v"), share(pixels).alias("__share"))
    ends = some.groupBy(*by).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    joined = beside(some, ends, by) if by else some.crossJoin(F.broadcast(ends))  # one row without groups
    bin_ = F.coalesce(F.floor((F.try_divide(F.col("__v") - F.col("__hi"), F.col("__hi") - F.col("__lo")) + 1.0) * (BINS - 1)), F.lit(0))
    hist = joined.groupBy(*by, "__lo", "__hi", bin_.alias("__bin")).agg(F.count("*").cast("double").alias("__n"))
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = part.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.col("__bin") * F.col("__n")
    sums = hist.select(*by, "__lo", "__hi", "__bin", F.sum("__n").over(upto).alias("wb"), F.sum("__n").over(part).alias("n"), F.sum(weight).over(upto).alias("sb"), F.sum(weight).over(part).alias("s"))
    wf = F.col("n") - F.col("wb")
    between = F.coalesce(F.col("wb") * wf * F.pow(F.col("sb") / F.col("wb") - F.try_divide(F.col("s") - F.col("sb"), wf), F.lit(2.0)), F.lit(0.0))
    best = sums.groupBy(*by).agg(F.min_by(F.struct("__bin", "__lo", "__hi"), F.struct(-between, F.col("__bin"))).alias("b"))
    return best.select(*by, (F.col("b.__bin") * (F.col("b.__hi") - F.col("b.__lo")) / (BINS - 1) + F.col("b.__lo")).alias("threshold"))


def binary(pixels: DataFrame, value: str, by: list[str] | None = None, threshold: float | None = None, invert: bool = False) -> DataFrame:
    """pixels with a boolean ``mask``: below the threshold (Otsu's of the group, or the one given); null values are false."""
    if threshold is None:
        cuts = otsu(pixels, value, by).withColumnRenamed("threshold", "__cut")
        pixels = beside(pixels, cuts, by) if by else pixels.crossJoin(F.broadcast(cuts))
    else:
        pixels = pixels.withColumn("__cut", F.lit(float(threshold)))
    below = F.col(value) < F.col("__cut")
    return pixels.withColumn("mask", F.coalesce(~below if invert else below, F.lit(False))).drop("__cut")


def painted(pixels: DataFrame, bands: list[str], background: float | None = 1.0) -> DataFrame:
    """Bands outside the mask painted with the background (None: null)."""
    return pixels.withColumns({b: F.when(F.col("mask"), F.col(b)).otherwise(F.lit(background).cast("double")) for b in bands})


def adaptive(pixels: DataFrame, value: str, size: int, k: float = 0.15) -> DataFrame:
    """Mask of pixels below (1 - k) times the mean of their square window; one sort of each image by row and column is all
    that is shuffled."""
    row = Window.partitionBy("img", "col").orderBy("row").rangeBetween(-size, size)
    col = Window.partitionBy("img", "row").orderBy("col").rangeBetween(-size, size)
    part = pixels.withColumns({"__s": F.sum(value).over(row), "__n": F.count(value).over(row)})
    part = part.withColumns({"__s": F.sum("__s").over(col), "__n": F.sum("__n").over(col)})
    return part.withColumn("mask", F.coalesce(F.col(value) < F.col("__s") / F.col("__n") * (1.0 - k), F.lit(False))).drop("__s", "__n")


def segment_iter(pixels: DataFrame, steps: list[tuple[str, float, bool]], by: list[str]) -> DataFrame:
    """Chained segmentations in one pass: each step (value, threshold, invert) keeps part of what the one before kept.
    Rows (by..., stage, n, pct of the stage before)."""
    kept: Column = F.lit(True)
    aggs = [F.count("*").alias("n0")]
    for k, (value, cut, invert) in enumerate(steps, 1):
        below = F.col(value) < cut
        kept = kept & (~below if invert else below)
        aggs.append(F.count_if(kept).alias(f"n{k}"))
    counts = pixels.groupBy(*by).agg(*aggs)
    stage = F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), F.col(f"n{k}").alias("n"), (F.try_divide(F.col(f"n{k}"), F.col(f"n{max(k - 1, 0)}")) * 100.0).alias("pct")) for k in range(len(steps) + 1)]))
    return counts.select(*by, stage.alias("s")).select(*by, "s.*")


def classify(value: Column, breaks: list[float]) -> Column:
    """Class 1 .. len(breaks) + 1 of right-closed intervals between the breaks."""
    out = F.lit(len(breaks) + 1)
    for k in range(len(breaks) - 1, -1, -1):
        out = F.when(value <= breaks[k], k + 1).otherwise(out)
    return F.when(value.isNotNull(), out)


def class_frequency(pixels: DataFrame, value: str, breaks: list[float], by: list[str], cell_area: float = 1.0) -> DataFrame:
    """(by..., class, count, area_ha, percentage)."""
    counts = pixels.where(F.col(value).isNotNull()).groupBy(*by, classify(F.col(value), breaks).alias("class")).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(*by))  # at most one row for each class
    return counts.select(*by, "class", "count", (F.col("count") * cell_area / 10000.0).alias("area_ha"), (F.col("count") / total * 100.0).alias("percentage"))
