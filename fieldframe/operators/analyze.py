"""Object analysis end to end: images to masks, labelled objects, measures, scaling, filters and summaries.

An image is one row (img, h, w, bands, data by pixel then band). What needs a whole image (threshold of its own pixels,
morphology, labels, outlines, texture) is one numpy kernel a row; it returns the object's outline and its pixel counts,
and all measures, filters, scaling and summaries are DataFrame expressions over the objects.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldframe.functions import formula
from fieldframe.sources.images import band

from . import objects, polygon, tile

#: The columns of the full table of measures, in order.
MEASURES = """img id x y area area_ch perimeter radius_mean radius_min radius_max radius_sd diam_mean diam_min diam_max major_axis minor_axis caliper length width radius_ratio theta eccentricity
form_factor narrow_factor asp_ratio rectangularity pd_ratio plw_ratio solidity convexity elongation circularity circularity_haralick circularity_norm coverage""".split()
MINIMAL = "img id x y area perimeter major_axis minor_axis length width circularity_norm".split()
LESION = "img id x y area perimeter radius_mean radius_min radius_max radius_sd major_axis minor_axis eccentricity theta solidity circularity".split()
AREAS = ("area", "area_ch")
LENGTHS = ("perimeter", "radius_mean", "radius_min", "radius_max", "radius_sd", "diam_mean", "diam_min", "diam_max", "major_axis", "minor_axis", "caliper", "length", "width")


@dataclass(frozen=True)
class Segmentation:
    """How an image becomes labelled objects.

    index: a band formula. threshold: "Otsu", "adaptive" or a number; foreground lies below it, with ``invert`` above. Then,
    each with a brush of so many pixels (0: not): erode, dilate, opening, closing, and a median of so many pixels, and
    holes filled. watershed parts touching objects.
    """

    index: str = "B"
    threshold: str | float = "Otsu"
    invert: bool = False
    erode: int = 0
    dilate: int = 0
    opening: int = 0
    closing: int = 0
    filter: int = 0
    fill_hull: bool = False
    watershed: bool = True
    adaptive_size: int = 0
    adaptive_k: float = 0.15


def otsu(v: np.ndarray) -> float:
    """Otsu's threshold over 256 bins; the first bin of the largest between-class variance."""
    v = v[np.isfinite(v)]
    if not len(v):
        return np.nan
    lo, hi = v.min(), v.max()
    if hi == lo:
        return float(lo)
    count = np.bincount((((v - hi) / (hi - lo) + 1) * 255).astype(int), minlength=256).astype(float)
    below, total = np.cumsum(count), count.sum()
    weight = np.arange(256) * count
    part, every = np.cumsum(weight), weight.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * (total - below) * (part / below - (every - part) / (total - below)) ** 2
    return float(np.argmax(np.nan_to_num(between)) * (hi - lo) / 255 + lo)


def window_mean(v: np.ndarray, size: int) -> np.ndarray:
    """Mean of each pixel's square window, cut at the borders, by a summed-area table."""
    s = np.pad(np.cumsum(np.cumsum(np.nan_to_num(v), 0), 1), ((1, 0), (1, 0)))
    r0, r1 = np.maximum(np.arange(v.shape[0]) - size, 0), np.minimum(np.arange(v.shape[0]) + size + 1, v.shape[0])
    c0, c1 = np.maximum(np.arange(v.shape[1]) - size, 0), np.minimum(np.arange(v.shape[1]) + size + 1, v.shape[1])
    total = s[r1][:, c1] - s[r0][:, c1] - s[r1][:, c0] + s[r0][:, c0]
    return total / ((r1 - r0)[:, None] * (c1 - c0)[None])


def mask_of(v: np.ndarray, how: Segmentation) -> np.ndarray:
    """The foreground of an index image, in the order threshold, inversion, missing pixels, morphology, filter, holes."""
    if how.threshold == "adaptive":
        mask = v < window_mean(v, how.adaptive_size or max(v.shape) // 10) * (1 - how.adaptive_k)
    else:
        mask = v < (otsu(v) if how.threshold == "Otsu" else float(how.threshold))
    mask = (~mask if how.invert else mask) & np.isfinite(v)
    for size, kernel in ((how.erode, tile.erode), (how.dilate, tile.dilate), (how.opening, tile.opening), (how.closing, tile.closing)):
        if size:
            mask = kernel(mask.astype(float), tile.brush(size)) > 0
    if how.filter:
        mask = tile.median(mask.astype(float), how.filter) > 0.5
    return tile.fill_hull(mask) if how.fill_hull else mask


def labels_of(mask: np.ndarray, how: Segmentation) -> np.ndarray:
    return tile.watershed(mask) if how.watershed else tile.label(mask)


def index_images(images: DataFrame, index: str, bands: tuple[str, ...] = ("R", "G", "B")) -> DataFrame:
    """(img, h, w, data): the index of every pixel, by DataFrame expressions over the bands of each."""
    names = sorted(formula.bands(index))
    zipped = F.arrays_zip(*[band(bands.index(b)).alias(b) for b in names])
    return images.where("data is not null").select("img", "h", "w", F.transform(zipped, lambda p: formula.column(index, {b: p[b] for b in names})).alias("data"))


def segment(images: DataFrame, how: Segmentation, bands: tuple[str, ...] = ("R", "G", "B")) -> DataFrame:
    """(img, h, w, data): label images, 0 being background."""
    return tile.apply(index_images(images, how.index, bands), lambda v: labels_of(mask_of(v, how), how))


def outlines(labels: DataFrame, kernel: Callable[[np.ndarray], np.ndarray] = lambda a: a, hulls: bool = False) -> DataFrame:
    """(img, id, area, npixels, xs, ys) of every object of label images: its pixel count, the image's, and its outline; with
    ``hulls`` also hull_xs, hull_ys. The kernel makes label images of what comes in, in the same process: each step in Python
    has one of its own in every task."""
    kinds = [("id", pa.int32()), ("area", pa.int64()), ("npixels", pa.int64()), *[(c, pa.list_(pa.float64())) for c in ("xs", "ys", *(("hull_xs", "hull_ys") if hulls else ()))]]

    def run(batches):
        for b in tile.pieces(batches):
            rows = []
            for at, (img, h, w) in enumerate(zip(*(b.column(c).to_pylist() for c in ("img", "h", "w")), strict=True)):
                a = kernel(b.column("data")[at].values.to_numpy(zero_copy_only=False).astype(float).reshape(h, w))
                for k, n, ring in tile.outlines(np.nan_to_num(a).astype(int)):
                    points = [(float(c), float(r)) for r, c in ring]
                    rows.append((img, k, n, h * w, *zip(*points, strict=True), *([[p[i] for p in polygon.hull(points)] for i in (0, 1)] if hulls else ())))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [b.schema.field("img").type, *[k for _, k in kinds]], strict=True)], ["img", *[c for c, _ in kinds]])

    sql = {pa.int32(): "int", pa.int64(): "long"}
    return labels.select("img", "h", "w", "data").mapInArrow(run, f"img {labels.schema['img'].dataType.simpleString()}, " + ", ".join(f"{c} {sql.get(k, 'array<double>')}" for c, k in kinds))


def compute_measures(rings: DataFrame) -> DataFrame:
    """The columns of MEASURES of outlines (img, id, area, npixels, xs, ys, and hulls if they are known). The area and the ratios over it count pixels;
    circularity_norm and convexity are those of the outline. Objects without a centroid (lines) are left out."""
    rings = rings.where(F.size("xs") >= 3)
    r = polygon.radius_stats(polygon.axes(rings if "hull_xs" in rings.columns else polygon.hull_udf(rings)))
    cx, cy = polygon.mass()
    r = r.withColumns({"perimeter": polygon.perimeter(), "caliper": polygon.caliper(), "x": cx, "y": cy, "__a": polygon.area(), "area": F.col("area").cast("double")})
    r = r.withColumns({"__xs": F.col("hull_xs"), "__ys": F.col("hull_ys")}).drop("xs", "ys").withColumnsRenamed({"__xs": "xs", "__ys": "ys"})
    r = r.withColumns({"area_ch": polygon.area(), "__p": polygon.perimeter()})
    p, a = F.col("perimeter"), F.col("area")
    r = r.withColumns({
        "form_factor": F.try_divide(a * (4 * np.pi), p * p), "narrow_factor": F.try_divide(F.col("caliper"), F.col("length")), "asp_ratio": F.try_divide(F.col("length"), F.col("width")),
        "rectangularity": F.try_divide(F.col("length") * F.col("width"), a), "pd_ratio": F.try_divide(p, F.col("caliper")), "plw_ratio": F.try_divide(p, F.col("length") + F.col("width")),
        "solidity": F.try_divide(a, F.col("area_ch")), "convexity": F.try_divide(F.col("__p"), p), "circularity": F.try_divide(p * p, a),
        "circularity_haralick": F.try_divide(F.col("radius_mean"), F.col("radius_sd")), "circularity_norm": F.try_divide(F.col("__a") * (4 * np.pi), p * p), "coverage": a / F.col("npixels"),
    })
    return r.where(F.col("x").isNotNull()).select(*MEASURES)


@dataclass(frozen=True)
class Filters:
    """Which objects stay: by area (a share of the image's mean area, bounds, the largest or smallest), eccentricity and
    circularity."""

    lower_noise: float | None = 0.1
    lower_size: float | None = None
    upper_size: float | None = None
    topn_lower: int | None = None
    topn_upper: int | None = None
    lower_eccent: float | None = None
    upper_eccent: float | None = None
    lower_circ: float | None = None
    upper_circ: float | None = None


def filtered(measures: DataFrame, keep: Filters, circularity: str = "circularity") -> DataFrame:
    """Windows are over the objects of an image, which came from one row; a join with the images' means would run the
    segmentation twice."""
    out = measures
    if keep.lower_noise is not None:
        out = out.withColumn("__mean", F.avg("area").over(Window.partitionBy("img"))).where(F.col("area") > F.col("__mean") * keep.lower_noise).drop("__mean")
    out = objects.keep(out, None, keep.lower_size, keep.upper_size, keep.topn_lower, keep.topn_upper)
    for name, low, high in (("eccentricity", keep.lower_eccent, keep.upper_eccent), (circularity, keep.lower_circ, keep.upper_circ)):
        if low is not None:
            out = out.where(F.col(name) > low)
        if high is not None:
            out = out.where(F.col(name) < high)
    return out


def scaled(measures: DataFrame, dpi: float | None = None, reference: Column | None = None, reference_area: float | None = None) -> DataFrame:
    """Measures in centimetres: by the image's resolution, or so that each image's reference object (which goes) has the
    given area."""
    areas, lengths = [c for c in AREAS if c in measures.columns], [c for c in LENGTHS if c in measures.columns]
    if dpi is not None:
        return objects.by_dpi(measures, dpi, areas, lengths)
    if reference is not None and reference_area is not None:
        return objects.by_known(measures, reference, reference_area, "area", areas, lengths)
    return measures


def reference_object(larger: bool = True) -> Column:
    """The largest (or smallest) object of an image."""
    order = F.desc("area") if larger else F.asc("area")
    return F.row_number().over(Window.partitionBy("img").orderBy(order, "id")) == 1


def analyze_objects(images: DataFrame, how: Segmentation = Segmentation(), keep: Filters = Filters(), dpi: float | None = None, reference_area: float | None = None, reference_larger: bool = True, bands: tuple[str, ...] = ("R", "G", "B"), minimal: bool = False) -> DataFrame:
    """The measures of every object of images (img, h, w, bands, data): index, mask, labels, outlines, measures, filters by
    size and shape in pixels, then centimetres where a resolution or a reference object's area is given."""
    found = compute_measures(outlines(index_images(images, how.index, bands), lambda v: labels_of(mask_of(v, how), how), hulls=True))
    shape = "circularity_norm" if minimal else "circularity"
    if reference_area is not None:
        # The factor of each image goes along with its objects; the reference object itself goes.
        w = Window.partitionBy("img")
        found = found.withColumn("__ref", reference_object(reference_larger))
        found = found.withColumn("__f", F.sqrt(reference_area / F.max(F.when(F.col("__ref"), F.col("area"))).over(w))).where(~F.col("__ref"))
        found = objects.scaled(filtered(found, keep, shape), F.col("__f"), list(AREAS), list(LENGTHS)).drop("__ref", "__f")
    else:
        found = scaled(filtered(found, keep, shape), dpi)
    return found.select(*MINIMAL) if minimal else found


def summary(measures: DataFrame) -> DataFrame:
    """Per image: n, mean, min, max, sum and sd of the areas, and the coverage, in one aggregation, so the analysis runs
    once."""
    return objects.statistics(measures, ["img"], "area", F.sum("coverage").alias("coverage"))


def merged(measures: DataFrame, sep: str = "[_-]") -> DataFrame:
    """Per sample, the part of an image's name before the first separator: objects, and the mean of each measure."""
    name = F.split(F.col("img").cast("string"), sep)[0]
    return measures.groupBy(name.alias("sample")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in measures.columns if c not in ("img", "id")])


def object_index(images: DataFrame, labels: DataFrame, equation: str, bands: tuple[str, ...] = ("R", "G", "B")) -> DataFrame:
    """(img, id, n, mean): an index over the pixels of each object. Both images are arrays of one row an image, joined on
    their name, so no pixel is sent."""
    values = index_images(images, equation, bands).select(F.col("img").alias("__img"), F.col("data").alias("values"))
    both = labels.join(values, F.col("img") == F.col("__img")).select("img", F.explode(F.arrays_zip(F.col("data").alias("id"), "values")).alias("p"))
    return both.where("p.id > 0").groupBy("img", F.col("p.id").cast("int").alias("id")).agg(F.count("p.values").alias("n"), F.avg("p.values").alias("mean"))


def crops(images: DataFrame, labels: DataFrame, edge: int = 0, background: float | None = 1.0, lower_share: float = 0.1) -> DataFrame:
    """(img, id, row, col, h, w, bands, data): every object whose area is more than a share of the image's mean area, cut out
    of its image at its box and an edge; other pixels in the background's colour (None: as they are)."""
    pairs = images.where("data is not null").join(labels.select(F.col("img").alias("__img"), F.col("data").alias("labels")), F.col("img") == F.col("__img"))
    kind = images.schema["img"].dataType.simpleString()

    def run(batches):
        for b in tile.pieces(batches):
            for img, h, w, n, data, marks in zip(*(b.column(c).to_pylist() for c in ("img", "h", "w", "bands", "data", "labels")), strict=True):
                a, at = np.array(data, float).reshape(h, w, n), np.array(marks, float).reshape(h, w).astype(int)
                areas = np.bincount(at.ravel())[1:]
                rows = []
                for k in np.flatnonzero(areas > lower_share * areas[areas > 0].mean()) + 1 if areas.any() else ():
                    r, c = np.nonzero(at == k)
                    r0, r1, c0, c1 = max(r.min() - edge, 0), min(r.max() + edge + 1, h), max(c.min() - edge, 0), min(c.max() + edge + 1, w)
                    cut = a[r0:r1, c0:c1].copy()
                    if background is not None:
                        cut[at[r0:r1, c0:c1] != k] = background
                    rows.append((img, int(k), int(r0), int(c0), *cut.shape, cut.ravel()))
                if rows:
                    kinds = [b.schema.field("img").type, *[pa.int32()] * 6, pa.list_(pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["img", "id", "row", "col", "h", "w", "bands", "data"])

    return pairs.select("img", "h", "w", "bands", "data", "labels").mapInArrow(run, f"img {kind}, id int, row int, col int, h int, w int, bands int, data array<double>")


def augment(images: DataFrame, times: int = 4) -> DataFrame:
    """(img, nth, degrees, h, w, bands, data): each image turned ``times`` times about a full circle, with the mean of its
    border as background, corners kept."""
    kind = images.schema["img"].dataType.simpleString()
    turns = images.where("data is not null").select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("nth"))

    def run(batches):
        for b in tile.pieces(batches):
            for img, h, w, n, data, nth in zip(*(b.column(c).to_pylist() for c in ("img", "h", "w", "bands", "data", "nth")), strict=True):
                a = np.array(data, float).reshape(h, w, n)
                degrees = 360 / times * nth
                parts = [tile.rotate(a[..., k], degrees, float(np.mean(np.r_[a[0, :, k], a[-1, :, k], a[:, 0, k], a[:, -1, k]])), True) for k in range(n)]
                out = np.stack(parts, axis=2)
                values = [[img], [nth], [degrees], *[[x] for x in out.shape], [out.ravel()]]
                kinds = [b.schema.field("img").type, pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], ["img", "nth", "degrees", "h", "w", "bands", "data"])

    return turns.select("img", "h", "w", "bands", "data", "nth").mapInArrow(run, f"img {kind}, nth int, degrees double, h int, w int, bands int, data array<double>")


def apply_bands(images: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Every image (h by w by bands) through a kernel that may change its size: the lift of any function over a folder."""
    kind = images.schema["img"].dataType.simpleString()

    def run(batches):
        for b in tile.pieces(batches):
            for img, h, w, n, data in zip(*(b.column(c).to_pylist() for c in ("img", "h", "w", "bands", "data")), strict=True):
                out = np.asarray(kernel(np.array(data, float).reshape(h, w, n)), float)
                out = out[..., None] if out.ndim == 2 else out
                values, kinds = [[img], *[[x] for x in out.shape], [out.ravel()]], [b.schema.field("img").type, pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], ["img", "h", "w", "bands", "data"])

    return images.where("data is not null").select("img", "h", "w", "bands", "data").mapInArrow(run, f"img {kind}, h int, w int, bands int, data array<double>")
