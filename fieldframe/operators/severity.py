"""Disease severity and injury from pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import threshold


def by_index(pixels: DataFrame, leaf: Column, healthy: Column, by: list[str]) -> DataFrame:
    """(by..., healthy, symptomatic): shares in per cent of the pixels of leaves. One pass."""
    g = pixels.where(leaf).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~healthy).alias("bad"))
    sick = F.col("bad") / F.col("n") * 100.0
    return g.select(*by, (100.0 - sick).alias("healthy"), sick.alias("symptomatic"))


def two_stage(pixels: DataFrame, leaf_index: str, sick_index: str, by: list[str]) -> DataFrame:
    """Otsu on one index parts leaf from background; Otsu on another, over the leaf alone, healthy from sick."""
    leaf = threshold.binary(pixels, leaf_index, by).where("mask").drop("mask")
    return by_index(threshold.binary(leaf, sick_index, by), F.lit(True), ~F.col("mask"), by)


def by_class(pixels: DataFrame, palette: DataFrame, bands: list[str], by: list[str]) -> DataFrame:
    """Severity by nearest palette colour: palette (code, bands) with the codes healthy, symptomatic and background. The
    palette is a handful of colours and becomes one array."""
    p = palette.agg(F.collect_list(F.struct("code", *bands)).alias("__p"))
    far = " + ".join(f"(q.{b} - {b}) * (q.{b} - {b})" for b in bands)
    best = F.expr(f"array_min(transform(__p, q -> named_struct('d', {far}, 'code', q.code))).code")
    g = pixels.crossJoin(F.broadcast(p)).withColumn("__c", best)
    return by_index(g, F.col("__c") != "background", F.col("__c") == "healthy", by)


def glm_mask(train: DataFrame, pixels: DataFrame, bands: list[str], label: str = "label") -> DataFrame:
    """pixels with the probability and mask (cut at 0.5) of an unpenalised logistic regression on sampled pixels."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    of = VectorAssembler(inputCols=bands, outputCol="__x", handleInvalid="skip")
    model = LogisticRegression(featuresCol="__x", labelCol=label, regParam=0.0, standardization=False, tol=1e-9, maxIter=100, probabilityCol="__p", predictionCol="__y", rawPredictionCol="__r").fit(of.transform(train))
    out = model.transform(of.transform(pixels)).withColumn("probability", vector_to_array("__p")[1])
    return out.withColumn("mask", F.col("probability") >= 0.5).drop("__x", "__p", "__y", "__r")


def by_palette(pixels: DataFrame, healthy: DataFrame, symptomatic: DataFrame, bands: list[str], by: list[str], background: DataFrame | None = None) -> DataFrame:
    """(by..., healthy, symptomatic): shares in per cent of the leaf pixels, by logistic regressions on the bands of palette
    pixels. With a background palette a first regression parts leaf (both other palettes) from background; the second parts
    healthy from symptomatic. The pixels are scored where they lie."""
    code = lambda df, y: df.select(*bands, F.lit(y).alias("label"))
    leaf = pixels
    if background is not None:
        train = code(background, 0.0).unionByName(code(healthy, 1.0)).unionByName(code(symptomatic, 1.0))
        leaf = glm_mask(train, pixels, bands).where("mask").drop("probability", "mask")
    scored = glm_mask(code(healthy, 0.0).unionByName(code(symptomatic, 1.0)), leaf, bands)
    return by_index(scored, F.lit(True), ~F.col("mask"), by)


#: Pixels that one task of a k-means fit may hold; it takes some 200 bytes for each.
ROWS = 1 << 22


def spread(pixels: DataFrame, rows: int) -> DataFrame:
    """pixels as they lie if no partition has more than so many, or else dealt evenly to as many partitions as that takes."""
    largest, total = pixels.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    return pixels if (largest or 0) <= rows else pixels.repartition(-(-total // rows))


def palette(pixels: DataFrame, bands: list[str], k: int = 5, seed: int = 10) -> DataFrame:
    """(cluster, n, prop, mean bands): k-means colours, the most frequent first. The first centres are drawn partition by
    partition, so which optimum is found depends on how the pixels lie."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=bands, outputCol="__x", handleInvalid="skip").transform(pixels)
    g = KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="cluster").fit(spread(x.select("__x"), ROWS)).transform(x).groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(b).alias(b) for b in bands])
    total = g.agg(F.sum("n").alias("__t"))  # one row
    return g.crossJoin(F.broadcast(total)).withColumn("prop", F.col("n") / F.col("__t")).drop("__t").orderBy(F.desc("n"), "cluster")


def injury(masks: DataFrame) -> DataFrame:
    """(img, injury): per cent of the filled outline that is hole, from mask images (img, h, w, data)."""
    from . import tile

    def kernel(a):
        full = tile.fill_hull(a).sum()
        return [[(full - (a > 0).sum()) / full * 100 if full else 0.0]]

    return tile.apply(masks, kernel).select("img", F.get("data", F.lit(0)).alias("injury"))
