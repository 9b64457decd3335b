"""Polygon operators on rings: one row per polygon (id, xs, ys), vertex order kept in arrays.

A ring is bounded by its outline, so everything here is a projection over arrays: no shuffle. Most are expressions; what
goes over a ring many times (smoothing, splines) runs in Arrow batches, rings of equal numbers of vertices together.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARRAYS = ("xs", "ys")


def rings(vertices: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(id, seq, x, y) -> (id, xs, ys)."""
    by = by or ["id"]
    packed = vertices.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("v"))
    return packed.select(*by, F.col("v.x").alias("xs"), F.col("v.y").alias("ys"))


def vertices(rings_: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(id, xs, ys) -> (id, seq, x, y)."""
    by = by or ["id"]
    return rings_.select(*by, F.posexplode(F.arrays_zip("xs", "ys")).alias("pos", "p")).select(*by, (F.col("pos") + 1).alias("seq"), F.col("p.xs").alias("x"), F.col("p.ys").alias("y"))


def turned(a: Column, by: int = 1) -> Column:
    """The array from its place ``by`` on, then its start."""
    return F.concat(F.slice(a, F.lit(by + 1), F.size(a) - by), F.slice(a, 1, by))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _mean(a: Column) -> Column:
    return _sum(a) / F.size(a)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value computed once: a lambda computes what it names from outside again for every element."""
    return F.transform(F.array(value), f)[0]


def by_length(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, places) for each number of values: which rows have so many, and where theirs are in column.flatten()."""
    n = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    start = np.cumsum(n) - n
    return [(rows := np.flatnonzero(n == k), start[rows][:, None] + np.arange(k)) for k in np.unique(n)]


def rebuilt(column: pa.ListArray, kernel: Callable[[np.ndarray], np.ndarray], missing: Callable[[np.ndarray], np.ndarray]) -> pa.ListArray:
    """Lists of numbers through a kernel (rows by values) that may change their length; ``missing`` says which of its values
    are null, from which were."""
    flat = column.flatten()
    v, gone = flat.to_numpy(zero_copy_only=False).astype(float), flat.is_null().to_numpy(zero_copy_only=False)
    sizes, parts = np.zeros(len(column), np.int64), []
    for rows, places in by_length(column):
        new = kernel(v[places])
        sizes[rows] = new.shape[1]
        parts.append((rows, new, missing(gone[places]) if flat.null_count else False))
    start = np.r_[0, np.cumsum(sizes)]
    out, lost = np.empty(start[-1]), np.zeros(start[-1], bool)
    for rows, new, none in parts:
        places = start[rows][:, None] + np.arange(new.shape[1])
        out[places], lost[places] = new, none
    return pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(out, mask=lost), mask=column.is_null() if column.null_count else None)


def in_batches(r: DataFrame, kernel, missing) -> DataFrame:
    """Both arrays of every ring through a kernel, in Arrow batches."""
    names = r.columns
    at = [names.index(c) for c in ARRAYS]

    def run(batches):
        for b in batches:
            columns = list(b.columns)
            for k in at:
                columns[k] = rebuilt(columns[k], kernel, missing)
            yield pa.RecordBatch.from_arrays(columns, names)

    return r.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in r.schema))


def xs() -> Column:
    return F.col("xs")


def ys() -> Column:
    return F.col("ys")


def cross() -> Column:
    """x(i) y(i+1) - x(i+1) y(i), cyclic."""
    return F.zip_with(F.arrays_zip("xs", "ys"), F.arrays_zip(turned(xs()).alias("xs"), turned(ys()).alias("ys")), lambda a, b: a["xs"] * b["ys"] - b["xs"] * a["ys"])


def area() -> Column:
    return F.abs(_sum(cross())) / 2.0


def distances() -> Column:
    """Between consecutive vertices, without the closing edge."""
    n = F.size(xs()) - 1
    step = lambda a: F.zip_with(F.slice(a, F.lit(2), n), F.slice(a, F.lit(1), n), lambda p, q: p - q)
    return F.zip_with(step(xs()), step(ys()), lambda p, q: F.sqrt(p * p + q * q))


def perimeter() -> Column:
    return _sum(distances())


#: A polygon whose area is under this share of its squared perimeter has none: its vertices lie on a line, but for rounding.
FLAT = 1e-7


def some_area(a: Column, p: Column) -> Column:
    """The area a, null for a flat polygon of perimeter p."""
    return F.when(a > p * p * FLAT, a)


def centroid() -> Column:
    """The area-weighted centroid as a struct (x, y), null numbers for a flat polygon."""

    def of(c):
        six = F.when(some_area(F.abs(_sum(c)) / 2.0, perimeter()).isNotNull(), _sum(c) * 3.0)
        at = lambda a: _sum(F.zip_with(F.zip_with(a, turned(a), lambda p, q: p + q), c, lambda p, q: p * q))
        return bound(six, lambda v: F.struct(F.try_divide(at(xs()), v).alias("x"), F.try_divide(at(ys()), v).alias("y")))

    return bound(cross(), of)


def mass() -> tuple[Column, Column]:
    """Area-weighted centroid; null for a flat polygon."""
    return centroid()["x"], centroid()["y"]


def centre_distances(mass_: bool = False) -> Column:
    """Distance of each vertex to the vertex mean, or to the centroid of the area."""
    centre_ = centroid() if mass_ else F.struct(_mean(xs()).alias("x"), _mean(ys()).alias("y"))
    return bound(centre_, lambda m: F.zip_with(F.transform("xs", lambda p: p - m["x"]), F.transform("ys", lambda p: p - m["y"]), lambda p, q: F.sqrt(p * p + q * q)))


def moments(r: DataFrame) -> DataFrame:
    """Adds population moments __vx, __vy, __c of the vertices and the vertex mean __mx, __my."""
    r = r.withColumns({"__mx": _mean(xs()), "__my": _mean(ys())})
    dev = lambda a, m: F.transform(a, lambda p: p - F.col(m))
    dx, dy = dev(xs(), "__mx"), dev(ys(), "__my")
    mean2 = lambda a, b: _mean(F.zip_with(a, b, lambda p, q: p * q))
    return r.withColumns({"__vx": mean2(dx, dx), "__vy": mean2(dy, dy), "__c": mean2(dx, dy)})


def axes(r: DataFrame) -> DataFrame:
    """Adds major_axis, minor_axis, eccentricity, theta (of the moments), eigen_ratio, and length, width and elongation
    along the principal axes."""
    r = moments(r)
    vx, vy, c = F.col("__vx"), F.col("__vy"), F.col("__c")
    root = F.sqrt((vx - vy) * (vx - vy) + c * c * 4.0)
    big, small = (vx + vy + root) / 2.0, F.greatest((vx + vy - root) / 2.0, F.lit(0.0))
    r = r.withColumns({"theta": F.atan2(c * 2.0, vx - vy) / 2.0, "major_axis": F.sqrt(big), "minor_axis": F.sqrt(small), "eigen_ratio": F.try_divide(small, big)})
    r = r.withColumn("eccentricity", F.sqrt(1.0 - F.col("eigen_ratio")))
    cos, sin = F.cos("theta"), F.sin("theta")
    u = F.zip_with("xs", "ys", lambda p, q: p * cos + q * sin)
    v = F.zip_with("xs", "ys", lambda p, q: q * cos - p * sin)
    span = lambda a: F.array_max(a) - F.array_min(a)
    r = r.withColumns({"length": span(u), "width": span(v)})
    return r.withColumn("elongation", 1.0 - F.try_divide(F.col("width"), F.col("length"))).drop("__vx", "__vy", "__c", "__mx", "__my")


def is_closed() -> Column:
    return (F.element_at(xs(), 1) == F.element_at(xs(), -1)) & (F.element_at(ys(), 1) == F.element_at(ys(), -1))


def _both(r: DataFrame, f) -> DataFrame:
    return r.withColumns({c: f(F.col(c)) for c in ARRAYS})


def close(r: DataFrame) -> DataFrame:
    shut = is_closed()
    return r.withColumns({c: F.when(shut, F.col(c)).otherwise(F.concat(c, F.slice(c, 1, 1))) for c in ARRAYS})


def unclose(r: DataFrame) -> DataFrame:
    shut = is_closed()
    return r.withColumns({c: F.when(shut, F.slice(F.col(c), F.lit(1), F.size(c) - 1)).otherwise(F.col(c)) for c in ARRAYS})


def slide(r: DataFrame, first: int = 1) -> DataFrame:
    """Vertex order from vertex ``first`` (1-based) on."""
    return _both(r, lambda a: turned(a, first - 1)) if first > 1 else r


def rotate(r: DataFrame, degrees: float) -> DataFrame:
    c, s = F.cos(F.radians(F.lit(float(degrees)))), F.sin(F.radians(F.lit(float(degrees))))
    return r.withColumns({"xs": F.zip_with("xs", "ys", lambda p, q: p * c - q * s), "ys": F.zip_with("xs", "ys", lambda p, q: p * s + q * c)})


def centre(r: DataFrame) -> DataFrame:
    return _both(r, lambda a: bound(_mean(a), lambda m: F.transform(a, lambda p: p - m)))


def flip(r: DataFrame, axis: str) -> DataFrame:
    """Mirrored: the sign of the x or y coordinates changed."""
    return r.withColumn(axis + "s", F.transform(axis + "s", lambda p: -p))


def align(r: DataFrame) -> DataFrame:
    """Turned onto its principal axes (major first)."""
    full = axes(r.select("*"))
    cos, sin = F.cos("theta"), F.sin("theta")
    out = full.withColumns({"xs": F.zip_with("xs", "ys", lambda p, q: p * cos + q * sin), "ys": F.zip_with("xs", "ys", lambda p, q: q * cos - p * sin)})
    return out.select(*r.columns)


def sample(r: DataFrame, n: int) -> DataFrame:
    """n vertices at evenly spaced places, for polygons that have as many."""
    step = (F.size(xs()) - 1) / float(max(n - 1, 1))
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * step + 0.5).cast("int"))
    r = r.where(F.size(xs()) >= n).withColumn("__at", at)
    return _both(r, lambda a: F.transform("__at", lambda k: F.get(a, k))).drop("__at")


def sample_prop(r: DataFrame, prop: float) -> DataFrame:
    """A share of the vertices of every polygon, at evenly spaced places (two at least)."""
    n = F.greatest(F.floor(F.size(xs()) * prop).cast("int"), F.least(F.size(xs()), F.lit(2)))
    step = (F.size(xs()) - 1) / F.greatest(n - 1, F.lit(1))
    r = r.withColumn("__at", F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.floor(k * step + 0.5).cast("int")))
    return _both(r, lambda a: F.transform("__at", lambda k: F.get(a, k))).drop("__at")


def jitter(r: DataFrame, noise: float, seed: int = 0) -> DataFrame:
    """Vertices moved by up to ``noise`` each way; the same id, vertex and seed always move alike."""
    part = lambda tag: lambda v, k: v + (F.pmod(F.xxhash64(F.col("id"), k, F.lit(f"{tag}{seed}")), F.lit(2**32)) / float(2**31) - 1.0) * noise
    return r.withColumns({c: F.transform(c, part(c)) for c in ARRAYS})


def check(r: DataFrame, least: int = 3) -> DataFrame:
    """The rings that are polygons: as many xs as ys, at least three vertices, no missing or infinite number."""
    sound = lambda c: ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return r.where((F.size("xs") == F.size("ys")) & (F.size("xs") >= least) & sound("xs") & sound("ys"))


def spline(r: DataFrame, n: int, wrap: int = 3) -> DataFrame:
    """n vertices on the natural cubic spline through each ring, which first goes on by ``wrap`` vertices on both ends, so
    that it closes smoothly. Rings of equal numbers of vertices share one elimination, linear in their vertices; a ring with
    a missing number becomes NaN, one of a single vertex stays."""

    def curve(v: np.ndarray) -> np.ndarray:
        size = v.shape[1]
        if size < 2:
            return v
        k = min(wrap, size)
        y = np.ascontiguousarray(np.concatenate((v[:, size - k :], v, v[:, :k]), axis=1).T)
        m = len(y)
        second = np.zeros(y.shape)
        if m > 2:
            b = second[1:-1]
            b[:] = 6 * (y[2:] - 2 * y[1:-1] + y[:-2])
            pivots = [4.0]
            for i in range(1, m - 2):
                b[i] -= b[i - 1] * (1 / pivots[-1])
                pivots.append(4 - 1 / pivots[-1])
            b[-1] /= pivots[-1]
            for i in range(m - 4, -1, -1):
                b[i] = (b[i] - b[i + 1]) / pivots[i]
        t = k + np.arange(n) * (size / n)
        i = np.minimum(t.astype(int), m - 2)
        u = (t - i)[:, None]
        return ((1 - u) * y[i] + u * y[i + 1] + ((1 - u) ** 3 - (1 - u)) * second[i] / 6 + (u**3 - u) * second[i + 1] / 6).T

    return in_batches(r, curve, lambda gone: gone if gone.shape[1] < 2 else np.zeros((len(gone), n), bool))


def width_at(r: DataFrame, at: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(id, height, width): the extent of each ring, in x, at shares of its height, between the outermost crossings."""
    n = F.size("xs")
    y = lambda p: F.array_min("ys") + (F.array_max("ys") - F.array_min("ys")) * p

    def span(p):
        cross = F.filter(
            F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when((F.get("ys", k) > y(p)) != (F.get("ys", (k + 1) % n) > y(p)), (F.get("xs", (k + 1) % n) - F.get("xs", k)) * (y(p) - F.get("ys", k)) / F.nullif(F.get("ys", (k + 1) % n) - F.get("ys", k), F.lit(0.0)) + F.get("xs", k))),
            lambda v: v.isNotNull(),
        )
        return F.coalesce(F.array_max(cross) - F.array_min(cross), F.lit(0.0))

    return r.select("id", F.explode(F.array(*[F.struct(F.lit(p).alias("height"), span(p).alias("width")) for p in at])).alias("p")).select("id", "p.*")


def apex_base_angle(r: DataFrame, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """(id, apex, base): the angles in degrees at the top and at the bottom vertex, between the outermost vertices nearest to
    a share of the height on its left and on its right; null where a side has none."""
    points = F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y"))
    by = lambda f, sign: f(F.transform(points, lambda p: F.struct((p["y"] * sign).alias("k"), p["x"].alias("x"), p["y"].alias("y"))))

    def angle(tip, share):
        height = F.array_min("ys") + (F.array_max("ys") - F.array_min("ys")) * share
        side = lambda test: F.array_min(F.transform(F.filter(points, test), lambda p: F.struct(F.abs(p["y"] - height).alias("d"), p["x"].alias("x"), p["y"].alias("y"))))
        a, b = side(lambda p: p["x"] < tip["x"]), side(lambda p: p["x"] > tip["x"])
        ux, uy, vx, vy = a["x"] - tip["x"], a["y"] - tip["y"], b["x"] - tip["x"], b["y"] - tip["y"]
        return F.degrees(F.atan2(F.abs(ux * vy - uy * vx), ux * vx + uy * vy))

    return r.select("id", angle(by(F.array_max, 1.0), high).alias("apex"), angle(by(F.array_min, 1.0), low).alias("base"))


def smooth_open(r: DataFrame, window: int = 5) -> DataFrame:
    """Moving average over ``window`` vertices, cut at the ends of the line."""
    h = window // 2
    return _both(r, lambda a: F.transform(a, lambda v, k: _mean(F.slice(a, F.greatest(k - h, F.lit(0)) + 1, F.least(k + h, F.size(a) - 1) - F.greatest(k - h, F.lit(0)) + 1))))


def column_pixels(r: DataFrame) -> DataFrame:
    """(id, x, first, middle, last, n): of the integer points inside each ring, by column, the first, the middle and the last."""
    from .geometry import rasterise

    inside = r.select("id", F.explode(rasterise(F.col("xs"), F.col("ys"))).alias("p")).select("id", "p.x", "p.y")
    return inside.groupBy("id", "x").agg(F.min("y").alias("first"), F.median("y").alias("middle"), F.max("y").alias("last"), F.count("*").alias("n"))


def smooth(r: DataFrame, rounds: int = 1) -> DataFrame:
    """Cyclic moving average of three vertices, ``rounds`` times; a missing number spreads to its neighbours each round."""

    def turned_rows(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (np.arange(len(v)) - 1) % max(len(v), 1), (np.arange(len(v)) + 1) % max(len(v), 1)

    def moved(v: np.ndarray) -> np.ndarray:
        v = np.ascontiguousarray(v.T)
        before, after = turned_rows(v)
        for _ in range(rounds):
            v = (v[before] + v + v[after]) / 3
        return v.T

    def missing(gone: np.ndarray) -> np.ndarray:
        gone = gone.T
        before, after = turned_rows(gone)
        for _ in range(min(rounds, len(gone))):
            gone = gone[before] | gone | gone[after]
        return gone.T

    return in_batches(r, moved, missing) if rounds > 0 else r


def pcv(r: DataFrame, rounds: int = 100) -> DataFrame:
    """Perimeter complexity: sum times sample sd of the displacements by smoothing, over the perimeter."""
    moved = smooth(r.withColumns({"__x": F.col("xs"), "__y": F.col("ys")}), rounds)
    moved = moved.withColumn("__d", F.zip_with(F.zip_with("xs", "__x", lambda p, q: (p - q) * (p - q)), F.zip_with("ys", "__y", lambda p, q: (p - q) * (p - q)), lambda p, q: F.sqrt(p + q)))
    moved = moved.withColumns({"xs": F.col("__x"), "ys": F.col("__y")})
    sd = bound(_mean(F.col("__d")), lambda mean: F.sqrt(_sum(F.transform("__d", lambda d: (d - mean) * (d - mean))) / (F.size("__d") - 1)))
    return moved.withColumn("pcv", F.try_divide(_sum(F.col("__d")) * sd, perimeter())).drop("__x", "__y", "__d")


def angles() -> Column:
    """Interior angle in degrees at each vertex, between its sides; null where a side has no length."""
    n = F.size(xs())
    p, q = turned(xs(), 1), turned(ys(), 1)
    before = lambda a: F.concat(F.slice(a, n, F.lit(1)), F.slice(a, F.lit(1), n - 1))
    points = F.arrays_zip(before(xs()).alias("ax"), before(ys()).alias("ay"), xs().alias("bx"), ys().alias("by"), p.alias("cx"), q.alias("cy"))

    def one(t):
        ux, uy, vx, vy = t["ax"] - t["bx"], t["ay"] - t["by"], t["cx"] - t["bx"], t["cy"] - t["by"]
        return F.when(((ux != 0) | (uy != 0)) & ((vx != 0) | (vy != 0)), F.degrees(F.atan2(F.abs(ux * vy - uy * vx), ux * vx + uy * vy)))

    return F.transform(points, one)


def caliper() -> Column:
    """Largest distance between two vertices."""
    far = lambda at: F.transform(at, lambda a: F.array_max(F.transform(at, lambda b: (a["xs"] - b["xs"]) * (a["xs"] - b["xs"]) + (a["ys"] - b["ys"]) * (a["ys"] - b["ys"]))))
    return F.sqrt(F.array_max(bound(F.arrays_zip("xs", "ys"), far)))


def radius_stats(r: DataFrame) -> DataFrame:
    """Adds radius_mean, _min, _max, _sd of the distances to the vertex mean, diam_* and radius_ratio."""
    r = r.withColumn("__d", centre_distances()).withColumn("radius_mean", _mean(F.col("__d")))
    sd = F.sqrt(_sum(F.transform("__d", lambda d: (d - F.col("radius_mean")) * (d - F.col("radius_mean")))) / (F.size("__d") - 1))
    r = r.withColumns({"radius_min": F.array_min("__d"), "radius_max": F.array_max("__d"), "radius_sd": sd}).drop("__d")
    r = r.withColumns({f"diam_{k}": F.col(f"radius_{k}") * 2.0 for k in ("mean", "min", "max")})
    return r.withColumn("radius_ratio", F.try_divide(F.col("radius_max"), F.col("radius_min")))


def measures(r: DataFrame) -> DataFrame:
    """(id, ...) all measures of a polygon that need no hull; those over the area are null for a flat polygon."""
    r = radius_stats(axes(r)).withColumns({"area": area(), "perimeter": perimeter(), "caliper": caliper()})
    cx, cy = mass()
    p, a = F.col("perimeter"), some_area(F.col("area"), F.col("perimeter"))
    return r.withColumns({
        "x": cx, "y": cy, "form_factor": F.try_divide(a * (4 * 3.141592653589793), p * p), "narrow_factor": F.try_divide(F.col("caliper"), F.col("length")),
        "asp_ratio": F.try_divide(F.col("length"), F.col("width")), "rectangularity": F.try_divide(F.col("length") * F.col("width"), a), "pd_ratio": F.try_divide(p, F.col("caliper")),
        "plw_ratio": F.try_divide(p, F.col("length") + F.col("width")), "circularity": F.try_divide(p * p, a), "circularity_norm": F.try_divide(a * (4 * 3.141592653589793), p * p),
        "circularity_haralick": F.try_divide(F.col("radius_mean"), F.col("radius_sd")),
    }).drop("xs", "ys")


def hull_udf(r: DataFrame) -> DataFrame:
    """Adds hull_xs, hull_ys: the convex hull, counter-clockwise, not closed (monotone chain on each ring, in Arrow batches)."""
    from .tile import pieces

    names = r.columns
    at = [names.index(c) for c in ARRAYS]

    def run(batches):
        for b in pieces(batches, "xs"):
            out = [hull(list(zip(x, y, strict=True))) for x, y in zip(*(b.column(k).to_pylist() for k in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([[p[k] for p in h] for h in out], pa.list_(pa.float64())) for k in (0, 1)]], [*names, "hull_xs", "hull_ys"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in r.schema)
    return r.mapInArrow(run, f"{kinds}, hull_xs array<double>, hull_ys array<double>")


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(order):
        out: list[tuple[float, float]] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(reversed(points))


def hull_measures(r: DataFrame) -> DataFrame:
    """(id, area_ch, solidity, convexity)."""
    r = hull_udf(r).withColumns({"area": area(), "perimeter": perimeter()})
    r = r.withColumns({"xs": F.col("hull_xs"), "ys": F.col("hull_ys")}).withColumns({"area_ch": area(), "hull_perimeter": perimeter()})
    return r.withColumns({"solidity": F.try_divide(F.col("area"), F.col("area_ch")), "convexity": F.try_divide(F.col("hull_perimeter"), F.col("perimeter"))}).drop("xs", "ys", "hull_xs", "hull_ys", "area", "perimeter", "hull_perimeter")


# Shape generators: small rings of known size.
def circle(spark, radius: float = 1.0, n: int = 1000) -> DataFrame:
    """A closed circle of n points."""
    k = F.sequence(F.lit(0), F.lit(n - 1))
    turn = lambda f: F.transform(k, lambda i: f(i * (2 * 3.141592653589793 / (n - 1))) * radius)
    return spark.range(1).select(F.lit(f"circle_{n}").alias("id"), turn(F.cos).alias("xs"), turn(F.sin).alias("ys"))


def n_gon(spark, n: int, radius: float = 1.0) -> DataFrame:
    """A regular polygon of n vertices, not closed."""
    k = F.sequence(F.lit(1), F.lit(n))
    turn = lambda f: F.transform(k, lambda i: f(i * (2 * 3.141592653589793 / n)) * radius)
    return spark.range(1).select(F.lit(f"gon_{n}").alias("id"), turn(F.cos).alias("xs"), turn(F.sin).alias("ys"))


def literal(spark, name: str, points: list[tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame([(name, [float(p[0]) for p in points], [float(p[1]) for p in points])], "id string, xs array<double>, ys array<double>")


def rectangle(spark, a: float = 2, b: float = 3) -> DataFrame:
    return literal(spark, "rectangle", [(0, 0), (a, 0), (a, b), (0, b)])


def square(spark, side: float = 2) -> DataFrame:
    return literal(spark, "square", [(0, 0), (side, 0), (side, side), (0, side)])


def triangle_right(spark, a: float = 1, b: float = 2) -> DataFrame:
    return literal(spark, "triangle_right", [(0, 0), (a, 0), (0, b)])


def triangle_equilateral(spark, side: float = 2) -> DataFrame:
    return literal(spark, "triangle_equilateral", [(0, 0), (side, 0), (side / 2, side * 3**0.5 / 2)])
