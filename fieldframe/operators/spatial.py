"""Plots, spatial joins and zonal statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUTS = ("tblr", "tbrl", "btlr", "btrl", "lrtb", "lrbt", "rltb", "rlbt")


def grid(spark: SparkSession, xmin: float, xmax: float, ymin: float, ymax: float, nrow: int, ncol: int, buffer_x: float = 0.0, buffer_y: float = 0.0) -> DataFrame:
    """(row, col, xmin, xmax, ymin, ymax) of nrow by ncol cells, the first row on top; buffers are shares of a cell that are
    taken off each side."""
    w, h = (xmax - xmin) / ncol, (ymax - ymin) / nrow
    cells = spark.range(nrow * ncol).select((F.floor(F.col("id") / ncol) + 1).cast("int").alias("row"), (F.col("id") % ncol + 1).cast("int").alias("col"))
    left, top = (F.col("col") - 1) * w + xmin, F.lit(float(ymax)) - (F.col("row") - 1) * h
    return cells.select("row", "col", (left + w * buffer_x).alias("xmin"), (left + w * (1 - buffer_x)).alias("xmax"), (top - h * (1 - buffer_y)).alias("ymin"), (top - h * buffer_y).alias("ymax"))


def plot_number(row: Column, col: Column, nrow: int, ncol: int, layout: str = "lrtb", serpentine: bool = False) -> Column:
    """Number of a plot (from 1). The layout's first two letters say which way plots follow each other, the last two which
    way the lines of plots do; serpentine: every second line runs backwards."""
    r, c = row - 1, col - 1
    if "bt" in layout:
        r = F.lit(nrow - 1) - r
    if "rl" in layout:
        c = F.lit(ncol - 1) - c
    line, place, size = (c, r, nrow) if layout[:2] in ("tb", "bt") else (r, c, ncol)
    if serpentine:
        place = F.when(line % 2 == 1, F.lit(size - 1) - place).otherwise(place)
    return (line * size + place + 1).cast("int")


def plot_name(number: Column, prefix: str = "P", width: int = 4) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def contains(points: DataFrame, boxes: DataFrame, cell_x: float, cell_y: float, keep: list[str]) -> DataFrame:
    """Points (x, y) joined to the boxes (xmin..ymax) that hold them (right and upper edges left out).

    An equi-join on grid cells: a point has one cell, a box is sent to each cell that it meets, so neither side is
    broadcast or compared with all of the other. Cells should be about as large as a box.
    """
    cell = lambda c, size: F.floor(c / size).cast("long")
    p = points.withColumns({"__cx": cell(F.col("x"), cell_x), "__cy": cell(F.col("y"), cell_y)})
    b = boxes.select(*keep, F.col("xmin").alias("__x0"), F.col("xmax").alias("__x1"), F.col("ymin").alias("__y0"), F.col("ymax").alias("__y1"))
    b = b.withColumn("__cx", F.explode(F.sequence(cell(F.col("__x0"), cell_x), cell(F.col("__x1"), cell_x)))).withColumn("__cy", F.explode(F.sequence(cell(F.col("__y0"), cell_y), cell(F.col("__y1"), cell_y))))
    j = p.join(b, ["__cx", "__cy"])
    inside = (F.col("x") >= F.col("__x0")) & (F.col("x") < F.col("__x1")) & (F.col("y") >= F.col("__y0")) & (F.col("y") < F.col("__y1"))
    return j.where(inside).drop("__cx", "__cy", "__x0", "__x1", "__y0", "__y1")


def zonal(points: DataFrame, boxes: DataFrame, value: str, cell_x: float, cell_y: float, by: list[str], quantiles: tuple[float, ...] = ()) -> DataFrame:
    """Per box: count, mean, median, sd, min, max and quantiles of a value over its points."""
    j = contains(points, boxes, cell_x, cell_y, by)
    v = F.col(value)
    return j.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), *[F.percentile(v, F.lit(q)).alias(f"q{round(q * 100)}") for q in quantiles])


def _boxes_met(a: DataFrame, b: DataFrame, cell_x: float, cell_y: float) -> DataFrame:
    """Pairs of boxes (id of each) that share a grid cell, once each: a pair counts in the cell of its common lower corner."""
    cell = lambda c, size: F.floor(c / size).cast("long")

    def cells(df: DataFrame, tag: str) -> DataFrame:
        df = df.select(F.col("id").alias(f"{tag}_id"), *[F.col(c).alias(f"{tag}_{c}") for c in ("xmin", "xmax", "ymin", "ymax")])
        df = df.withColumn("__cx", F.explode(F.sequence(cell(F.col(f"{tag}_xmin"), cell_x), cell(F.col(f"{tag}_xmax"), cell_x))))
        return df.withColumn("__cy", F.explode(F.sequence(cell(F.col(f"{tag}_ymin"), cell_y), cell(F.col(f"{tag}_ymax"), cell_y))))

    j = cells(a, "a").join(cells(b, "b"), ["__cx", "__cy"])
    first = (F.col("__cx") == cell(F.greatest("a_xmin", "b_xmin"), cell_x)) & (F.col("__cy") == cell(F.greatest("a_ymin", "b_ymin"), cell_y))
    return j.where(first).drop("__cx", "__cy")


def intersection(a: DataFrame, b: DataFrame, cell_x: float, cell_y: float) -> DataFrame:
    """(a_id, b_id, xmin, xmax, ymin, ymax, area) of boxes that overlap."""
    j = _boxes_met(a, b, cell_x, cell_y)
    j = j.select("a_id", "b_id", F.greatest("a_xmin", "b_xmin").alias("xmin"), F.least("a_xmax", "b_xmax").alias("xmax"), F.greatest("a_ymin", "b_ymin").alias("ymin"), F.least("a_ymax", "b_ymax").alias("ymax"))
    return j.where("xmin < xmax and ymin < ymax").withColumn("area", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")))


def _semi(a: DataFrame, b: DataFrame, cell_x: float, cell_y: float, test: Column, how: str = "left_semi") -> DataFrame:
    hits = _boxes_met(a, b, cell_x, cell_y).where(test).select(F.col("a_id").alias("__id")).distinct()
    return a.join(hits, F.col("id") == F.col("__id"), how)


_OVER = "a_xmin < b_xmax and b_xmin < a_xmax and a_ymin < b_ymax and b_ymin < a_ymax"
_IN = "a_xmin >= b_xmin and a_xmax <= b_xmax and a_ymin >= b_ymin and a_ymax <= b_ymax"
_OUT = "b_xmin >= a_xmin and b_xmax <= a_xmax and b_ymin >= a_ymin and b_ymax <= a_ymax"


def within(a: DataFrame, b: DataFrame, cell_x: float, cell_y: float) -> DataFrame:
    """Boxes of a that lie in a box of b."""
    return _semi(a, b, cell_x, cell_y, F.expr(_IN))


def overlaps(a: DataFrame, b: DataFrame, cell_x: float, cell_y: float) -> DataFrame:
    """Boxes of a whose inside meets one of b without either holding the other."""
    return _semi(a, b, cell_x, cell_y, F.expr(f"{_OVER} and not ({_IN}) and not ({_OUT})"))


def outside(a: DataFrame, b: DataFrame, cell_x: float, cell_y: float) -> DataFrame:
    """Boxes of a that neither lie in nor overlap any of b."""
    return _semi(a, b, cell_x, cell_y, F.expr(f"({_IN}) or ({_OVER} and not ({_OUT}))"), "left_anti")


def touches(a: DataFrame, b: DataFrame, cell_x: float, cell_y: float) -> DataFrame:
    """Boxes of a that share border points but no inside with one of b."""
    return _semi(a, b, cell_x, cell_y, F.expr(f"a_xmin <= b_xmax and b_xmin <= a_xmax and a_ymin <= b_ymax and b_ymin <= a_ymax and not ({_OVER})"))


def transform(boxes: DataFrame, shift_x: float = 0, shift_y: float = 0, angle: float = 0, scale_x: float = 1, scale_y: float = 1) -> DataFrame:
    """(id, seq, x, y): the corners of boxes shifted, turned by -angle degrees and scaled about the middle of all boxes."""
    mid = boxes.agg(((F.min("xmin") + F.max("xmax")) / 2.0).alias("__mx"), ((F.min("ymin") + F.max("ymax")) / 2.0).alias("__my"))
    corners = F.array(*[F.struct(F.lit(k + 1).alias("seq"), F.col(x).alias("x"), F.col(y).alias("y")) for k, (x, y) in enumerate((("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax")))])
    v = boxes.select("id", F.explode(corners).alias("p")).select("id", "p.*").crossJoin(F.broadcast(mid))  # the middle is one row
    c, s = F.cos(F.radians(F.lit(-float(angle)))), F.sin(F.radians(F.lit(-float(angle))))
    dx, dy = (F.col("x") - F.col("__mx")) * scale_x, (F.col("y") - F.col("__my")) * scale_y
    return v.select("id", "seq", (dx * c - dy * s + F.col("__mx") + shift_x).alias("x"), (dx * s + dy * c + F.col("__my") + shift_y).alias("y"))


def box_measures(boxes: DataFrame) -> DataFrame:
    """(id, xcoord, ycoord, area, perimeter, width, height)."""
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    return boxes.select("id", ((F.col("xmin") + F.col("xmax")) / 2.0).alias("xcoord"), ((F.col("ymin") + F.col("ymax")) / 2.0).alias("ycoord"), (w * h).alias("area"), ((w + h) * 2.0).alias("perimeter"), w.alias("width"), h.alias("height"))


def line_on_halfplot(boxes: DataFrame) -> DataFrame:
    """(id, wkt): the line between the middles of a box's short sides."""
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    mx, my = (F.col("xmin") + F.col("xmax")) / 2.0, (F.col("ymin") + F.col("ymax")) / 2.0
    n = lambda c: F.format_string("%.4f", c)
    line = lambda a, b, c, d: F.concat(F.lit("LINESTRING ("), n(a), F.lit(" "), n(b), F.lit(", "), n(c), F.lit(" "), n(d), F.lit(")"))
    return boxes.select("id", F.when(w <= h, line(mx, F.col("ymin"), mx, F.col("ymax"))).otherwise(line(F.col("xmin"), my, F.col("xmax"), my)).alias("wkt"))


def in_polygon(points: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """(point columns, ring id as ring_id): points joined to the rings (id, xs, ys) that hold them by crossing count, after
    an equi-join on the grid cells of the rings' boxes."""
    at = lambda c: F.floor(c / cell).cast("long")
    r = rings.select(F.col("id").alias("ring_id"), "xs", "ys")
    r = r.withColumn("__cx", F.explode(F.sequence(at(F.array_min("xs")), at(F.array_max("xs"))))).withColumn("__cy", F.explode(F.sequence(at(F.array_min("ys")), at(F.array_max("ys")))))
    j = points.withColumns({"__cx": at(F.col("x")), "__cy": at(F.col("y"))}).join(r, ["__cx", "__cy"])
    crossed = F.expr("aggregate(sequence(0, size(xs) - 1), 0, (n, i) -> n + if((ys[i] > y) != (ys[(i + 1) % size(xs)] > y) and x < (xs[(i + 1) % size(xs)] - xs[i]) * (y - ys[i]) / nullif(ys[(i + 1) % size(xs)] - ys[i], 0D) + xs[i], 1, 0))")
    return j.where(crossed % 2 == 1).drop("__cx", "__cy", "xs", "ys")


#: Most control points of an interpolation, which are one array.
CONTROL = 10_000


def idw(targets: DataFrame, points: DataFrame, z: str, p: float = 2.0) -> DataFrame:
    """(targets' columns, value): inverse-distance weighting. The control points (surveyed marks: a small set
    by nature) become one array."""
    if points.limit(CONTROL + 1).count() > CONTROL:
        raise ValueError(f"more than {CONTROL} control points: aggregate them first")
    c = points.agg(F.collect_list(F.struct(F.col("x").alias("x"), F.col("y").alias("y"), F.col(z).alias("z"))).alias("c"))  # one row
    j = targets.crossJoin(c)
    w = f"power((q.x - x) * (q.x - x) + (q.y - y) * (q.y - y), {p / 2}D)"
    total = F.expr(f"aggregate(c, named_struct('n', 0D, 'd', 0D), (s, q) -> named_struct('n', s.n + try_divide(q.z, {w}), 'd', s.d + try_divide(1D, {w})), s -> s.n / s.d)")
    return j.withColumn("value", total).drop("c")


def aggregation_factor(nrow: int, ncol: int, limit: int = 1_000_000) -> int:
    """How far to downsample a raster to about ``limit`` cells: the place, from 1, of the best of 0 .. 20, where k leaves a
    cell of each k + 1 in both directions; 0 if none is needed."""
    cells = [-(-nrow // (k + 1)) * -(-ncol // (k + 1)) for k in range(21)]
    best = min(range(21), key=lambda k: abs(cells[k] - limit))
    return 0 if best == 0 else best + 1


def epsg(lon: Column, lat: Column) -> Column:
    """UTM EPSG code of a longitude and latitude."""
    return (F.floor((lon + 180.0) / 6.0) + 1 + F.when(lat < 0, 32700).otherwise(32600)).cast("int")
