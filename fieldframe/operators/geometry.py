"""Spatial predicates and set operations on polygons (id, xs, ys), of any simple shape.

Candidates come from an equi-join on the grid cells of the polygons' boxes. A pair is then cut into slabs between the
heights of all vertices and crossings; within a slab no edges cross, so what lies in both, in one or in either polygon is
a row of trapezoids. That gives exact areas and shapes for every predicate and operation, pair by pair in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATIONS = {"intersection": lambda a, b: a & b, "difference": lambda a, b: a & ~b, "union": lambda a, b: a | b}
#: Areas below this share of the smaller polygon's are nothing but rounding.
NOTHING = 1e-9


#: Numbers that a chunk of pairs makes at once.
CHUNK = 1 << 21


def edges(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """x0, y0, x1, y1 of the edges of many rings (rings by vertices), the lower end first, and which of them rise."""
    e = x, y, np.roll(x, -1, 1), np.roll(y, -1, 1)
    down = e[1] > e[3]
    x0, y0, x1, y1 = (np.where(down, e[(k + 2) % 4], e[k]) for k in range(4))
    return x0, y0, x1, y1, y0 < y1


def crossings(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """Heights at which an edge of a crosses one of b (pairs by pairs of edges), NaN where they do not."""
    dxa, dya = (a[2] - a[0])[:, :, None], (a[3] - a[1])[:, :, None]
    dxb, dyb = (b[2] - b[0])[:, None], (b[3] - b[1])[:, None]
    ox, oy = b[0][:, None] - a[0][:, :, None], b[1][:, None] - a[1][:, :, None]
    det = dxa * dyb - dya * dxb
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (ox * dyb - oy * dxb) / det, (ox * dya - oy * dxa) / det
        hit = a[4][:, :, None] & b[4][:, None] & (det != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        return np.where(hit, a[1][:, :, None] + t * dya, np.nan).reshape(len(det), -1)


def overlays(xa, ya, xb, yb, operation: str) -> tuple[np.ndarray, np.ndarray]:
    """The trapezoids (bottom, left, right, top, left, right) of the set operation on many pairs of rings (pairs by
    vertices), slab by slab, and the pair of each."""
    xa, ya, xb, yb = (np.asarray(v, float) for v in (xa, ya, xb, yb))
    n = xa.shape[1] + xb.shape[1]
    step = max(CHUNK // max((2 * n + xa.shape[1] * xb.shape[1]) * n, 1), 1)
    parts = [_overlays(*(v[k : k + step] for v in (xa, ya, xb, yb)), operation) for k in range(0, len(xa), step)]
    return np.concatenate([t for t, _ in parts] or [np.empty((0, 6))]), np.concatenate([p + k * step for k, (_, p) in enumerate(parts)] or [np.empty(0, int)])


def _overlays(xa, ya, xb, yb, operation: str) -> tuple[np.ndarray, np.ndarray]:
    a, b = edges(xa, ya), edges(xb, yb)
    x0, y0, x1, y1, rises = (np.hstack(v) for v in zip(a, b, strict=True))
    mine = np.arange(x0.shape[1]) < xa.shape[1]
    heights = np.sort(np.hstack((np.where(rises, y0, np.nan), np.where(rises, y1, np.nan), crossings(a, b))), axis=1)
    pair, k = np.nonzero(heights[:, :-1] < heights[:, 1:])
    low, high = heights[pair, k], heights[pair, k + 1]
    x0, y0, x1, y1 = x0[pair], y0[pair], x1[pair], y1[pair]
    over = rises[pair] & (y0 <= low[:, None]) & (y1 >= high[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (x1 - x0) / (y1 - y0)
        left, right = x0 + (low[:, None] - y0) * slope, x0 + (high[:, None] - y0) * slope
        order = np.argsort(np.where(over, left + right, np.inf), axis=1, kind="stable")
    left, right, over = (np.take_along_axis(v, order, 1) for v in (left, right, over))
    of = mine[order]
    inside = OPERATIONS[operation](np.cumsum(over & of, 1) % 2 == 1, np.cumsum(over & ~of, 1) % 2 == 1) & over
    before = np.pad(inside[:, :-1], ((0, 0), (1, 0)))
    begins, ends = inside & ~before, ~inside & before & over
    begins &= np.cumsum(begins, 1) <= ends.sum(1)[:, None]  # what is never left has no end
    slab, i = np.nonzero(begins)
    j = np.nonzero(ends)[1]
    return np.stack((low[slab], left[slab, i], left[slab, j], high[slab], right[slab, i], right[slab, j]), axis=1), pair[slab]


def overlay(xa, ya, xb, yb, operation: str) -> list[tuple[float, float, float, float, float, float]]:
    """The trapezoids of one pair."""
    return [tuple(t) for t in overlays([xa], [ya], [xb], [yb], operation)[0].tolist()]


def areas(trapezoids: np.ndarray, pair: np.ndarray, pairs: int) -> np.ndarray:
    """The area of each pair's trapezoids."""
    y0, l0, r0, y1, l1, r1 = trapezoids.T
    return np.bincount(pair, (y1 - y0) * (r0 - l0 + r1 - l1) / 2, pairs)


def area(trapezoids) -> float:
    return float(sum((t[3] - t[0]) * (t[2] - t[1] + t[5] - t[4]) / 2 for t in trapezoids))


def wkt(trapezoids) -> str:
    """A multipolygon of the trapezoids that have an area."""
    rings = []
    for y0, l0, r0, y1, l1, r1 in trapezoids:
        points = list(dict.fromkeys([(l0, y0), (r0, y0), (r1, y1), (l1, y1)]))
        if len(points) > 2:
            rings.append("((" + ", ".join(f"{float(x)!r} {float(y)!r}" for x, y in [*points, points[0]]) + "))")
    return "MULTIPOLYGON (" + ", ".join(rings) + ")" if rings else "MULTIPOLYGON EMPTY"


def _sides(ax, ay, bx, by, px, py):
    return np.sign((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def outlines_meet(xa, ya, xb, yb) -> tuple[np.ndarray, np.ndarray]:
    """Of many pairs of rings at once (pairs by vertices): whether their outlines have a point in common, and whether edges
    cross in the inside of both."""
    a = [v[:, :, None] for v in (xa, ya, np.roll(xa, -1, 1), np.roll(ya, -1, 1))]
    b = [v[:, None, :] for v in (xb, yb, np.roll(xb, -1, 1), np.roll(yb, -1, 1))]
    p, q = _sides(*a, b[0], b[1]), _sides(*a, b[2], b[3])
    r, t = _sides(*b, a[0], a[1]), _sides(*b, a[2], a[3])
    near = np.ones(p.shape, bool)
    for k in (0, 1):
        near &= (np.minimum(a[k], a[k + 2]) <= np.maximum(b[k], b[k + 2])) & (np.minimum(b[k], b[k + 2]) <= np.maximum(a[k], a[k + 2]))
    return (near & (p * q <= 0) & (r * t <= 0)).any((1, 2)), (near & (p * q < 0) & (r * t < 0)).any((1, 2))


def first_inside(xa, ya, xb, yb) -> np.ndarray:
    """Of many pairs of rings, whether the first vertex of a lies in b, by crossing counts."""
    x, y = xa[:, :1], ya[:, :1]
    x1, y1 = np.roll(xb, -1, 1), np.roll(yb, -1, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (((yb > y) != (y1 > y)) & (x < (x1 - xb) * (y - yb) / (y1 - yb) + xb)).sum(1) % 2 == 1


def ring_area(x, y) -> np.ndarray:
    return np.abs((x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(1)) / 2


def shared(xa, ya, xb, yb) -> tuple[np.ndarray, ...]:
    """Areas of a and b, the area that they share, and whether their outlines meet, of many pairs with equal numbers of
    vertices. Only pairs whose outlines meet are cut into slabs; of the others one holds the other, or they are apart."""
    mine, theirs = ring_area(xa, ya), ring_area(xb, yb)
    met, _ = outlines_meet(xa, ya, xb, yb)
    both = np.where(first_inside(xa, ya, xb, yb), mine, np.where(first_inside(xb, yb, xa, ya), theirs, 0.0))
    both[met] = areas(*overlays(xa[met], ya[met], xb[met], yb[met], "intersection"), int(met.sum()))
    return mine, theirs, np.where(both > NOTHING * np.minimum(mine, theirs), both, 0.0), met


def relations(xa, ya, xb, yb) -> tuple[np.ndarray, ...]:
    """Whether a lies in b, holds b, shares an inside with it, meets its outline. Where edges cross, neither holds the other,
    so the shared area need not be known; it is for outlines that meet without crossing."""
    met, crossed = outlines_meet(xa, ya, xb, yb)
    inside, holds = first_inside(xa, ya, xb, yb) & ~met, first_inside(xb, yb, xa, ya) & ~met
    share = inside | holds | crossed
    unsure = np.flatnonzero(met & ~crossed)
    if len(unsure):
        mine, theirs, both, _ = shared(*(v[unsure] for v in (xa, ya, xb, yb)))
        inside[unsure], holds[unsure], share[unsure] = (both >= mine * (1 - NOTHING)) & (mine > 0), (both >= theirs * (1 - NOTHING)) & (theirs > 0), both > 0
    return inside, holds, share, met


def by_shape(batch, kernel, kinds):
    """A kernel over a batch's pairs of rings, those of equal numbers of vertices together."""
    rings = [batch.column(c) for c in ("a_xs", "a_ys", "b_xs", "b_ys")]
    na, nb = rings[0].value_lengths().to_numpy(), rings[2].value_lengths().to_numpy()
    out = [np.empty(len(batch), k) for k in kinds]
    for n, m in sorted(set(zip(na.tolist(), nb.tolist(), strict=True))):
        at = np.flatnonzero((na == n) & (nb == m))
        some = [r.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1) for r in rings]
        for to, v in zip(out, kernel(*some), strict=True):
            to[at] = v
    return out


def candidates(a: DataFrame, b: DataFrame, cell_x: float, cell_y: float) -> DataFrame:
    """(a_id, a_xs, a_ys, b_id, b_xs, b_ys) of polygons whose boxes meet, once each: a pair counts in the grid cell of the
    lower corner of what its boxes share. Cells should be about as large as a polygon."""
    cell = lambda c, size: F.floor(c / size).cast("long")

    def cells(df: DataFrame, tag: str) -> DataFrame:
        df = df.select(F.col("id").alias(f"{tag}_id"), F.col("xs").alias(f"{tag}_xs"), F.col("ys").alias(f"{tag}_ys"))
        for v, k, size in (("x", "__cx", cell_x), ("y", "__cy", cell_y)):
            df = df.withColumns({f"{tag}_{v}0": F.array_min(f"{tag}_{v}s"), f"{tag}_{v}1": F.array_max(f"{tag}_{v}s")})
            df = df.withColumn(k, F.explode(F.sequence(cell(F.col(f"{tag}_{v}0"), size), cell(F.col(f"{tag}_{v}1"), size))))
        return df

    j = cells(a, "a").join(cells(b, "b"), ["__cx", "__cy"])
    first = (F.col("__cx") == cell(F.greatest("a_x0", "b_x0"), cell_x)) & (F.col("__cy") == cell(F.greatest("a_y0", "b_y0"), cell_y))
    near = F.expr("a_x0 <= b_x1 and b_x0 <= a_x1 and a_y0 <= b_y1 and b_y0 <= a_y1")
    return j.where(first & near).select("a_id", "a_xs", "a_ys", "b_id", "b_xs", "b_ys")


def related(a: DataFrame, b: DataFrame, cell_x: float, cell_y: float) -> DataFrame:
    """(a_id, b_id, a_area, b_area, both, meet) of polygons whose boxes meet: their areas, that of what they share (0 for
    rounding), and whether their outlines meet."""
    return _over_pairs(candidates(a, b, cell_x, cell_y), shared, {"a_area": float, "b_area": float, "both": float, "meet": bool})


def _over_pairs(pairs: DataFrame, kernel, columns: dict[str, type]) -> DataFrame:
    kinds = [pairs.schema[c].dataType.simpleString() for c in ("a_id", "b_id")]

    def run(batches):
        for batch in batches:
            out = by_shape(batch, kernel, list(columns.values()))
            yield pa.RecordBatch.from_arrays([batch.column("a_id"), batch.column("b_id"), *map(pa.array, out)], ["a_id", "b_id", *columns])

    more = ", ".join(f"{c} {({bool: 'boolean', float: 'double', object: 'string'})[t]}" for c, t in columns.items())
    return pairs.mapInArrow(run, f"a_id {kinds[0]}, b_id {kinds[1]}, {more}")


PREDICATES = {
    "within": "inside",
    "overlaps": "share and not inside and not holds",
    "touches": "meet and not share",
    "crosses": "share and meet and not inside",
    "intersects": "share or meet",
}


def select(a: DataFrame, b: DataFrame, cell_x: float, cell_y: float, predicate: str) -> DataFrame:
    """Polygons of a that are so related with some polygon of b. ``outside``: with none that they lie in or overlap."""
    test = f"({PREDICATES['within']}) or ({PREDICATES['overlaps']})" if predicate == "outside" else PREDICATES[predicate]
    found = _over_pairs(candidates(a, b, cell_x, cell_y), relations, dict.fromkeys(("inside", "holds", "share", "meet"), bool))
    hits = found.where(test).select(F.col("a_id").alias("__id")).distinct()
    return a.join(hits, F.col("id") == F.col("__id"), "left_anti" if predicate == "outside" else "left_semi")


def combined(a: DataFrame, b: DataFrame, cell_x: float, cell_y: float, operation: str, shapes: bool = True) -> DataFrame:
    """(a_id, b_id, area, wkt) of a set operation on every pair of polygons whose boxes meet (of others, the intersection is
    nothing, the difference a, the union both as they are); results without an area are left out. Without ``shapes`` there
    is no wkt."""

    def kernel(*rings):
        trapezoids, pair = overlays(*rings, operation)
        found = [areas(trapezoids, pair, len(rings[0]))]
        if shapes:
            ends = np.searchsorted(pair, np.arange(len(rings[0]) + 1))
            found.append(np.array([wkt(trapezoids[i:j].tolist()) for i, j in zip(ends[:-1], ends[1:], strict=True)] + [None], object)[:-1])
        return found

    return _over_pairs(candidates(a, b, cell_x, cell_y), kernel, {"area": float} | ({"wkt": object} if shapes else {})).where("area > 0")


def buffered_points(points: DataFrame, radius: float = 1e-3, sides: int = 8) -> DataFrame:
    """Points (id, x, y) as small polygons."""
    turn = [(2 * np.pi * k / sides) for k in range(sides)]
    return points.select("id", F.array(*[F.col("x") + float(radius * np.cos(t)) for t in turn]).alias("xs"), F.array(*[F.col("y") + float(radius * np.sin(t)) for t in turn]).alias("ys"))


def rasterise(xs: Column, ys: Column) -> Column:
    """The integer points (x, y) that lie in a ring, by crossing counts."""
    low, high = (lambda a: F.floor(F.array_min(a)).cast("int")), (lambda a: F.ceil(F.array_max(a)).cast("int"))
    n = F.size(xs)
    at = lambda a, k: F.get(a, k % n)

    def inside(x, y):
        cross = lambda s, k: s + F.when((at(ys, k) > y) != (at(ys, k + 1) > y), F.when(x < (at(xs, k + 1) - at(xs, k)) * (y - at(ys, k)) / F.nullif(at(ys, k + 1) - at(ys, k), F.lit(0.0)) + at(xs, k), 1).otherwise(0)).otherwise(0)
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), cross) % 2 == 1

    cells = F.flatten(F.transform(F.sequence(low(ys), high(ys)), lambda y: F.transform(F.sequence(low(xs), high(xs)), lambda x: F.struct(x.alias("x"), y.alias("y")))))
    return F.filter(cells, lambda p: inside(p["x"], p["y"]))


def point_at(r: DataFrame, share: float) -> DataFrame:
    """(id, x, y): the point at a share of the length along each line (id, xs, ys)."""
    n = F.size("xs")
    step = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.sqrt(F.pow(F.get("xs", k) - F.get("xs", k - 1), F.lit(2.0)) + F.pow(F.get("ys", k) - F.get("ys", k - 1), F.lit(2.0))))
    r = r.where(n > 1).withColumn("__d", F.aggregate(step, F.array(F.lit(0.0)), lambda s, d: F.concat(s, F.array(F.element_at(s, -1) + d))))
    r = r.withColumn("__t", F.element_at("__d", -1) * share)
    r = r.withColumn("__k", F.greatest(F.least(F.size(F.filter("__d", lambda d: d <= F.col("__t"))), n - 1), F.lit(1)))
    f = F.coalesce(F.try_divide(F.col("__t") - F.get("__d", F.col("__k") - 1), F.get("__d", F.col("__k")) - F.get("__d", F.col("__k") - 1)), F.lit(0.0))
    at = lambda c: F.get(c, F.col("__k") - 1) + f * (F.get(c, F.col("__k")) - F.get(c, F.col("__k") - 1))
    return r.select("id", at("xs").alias("x"), at("ys").alias("y"))


def closest_vertex(r: DataFrame, x: float, y: float, first: int = 0, reach: int = 1000) -> DataFrame:
    """(id, k): of the vertices from ``first`` on, at most ``reach`` of them, the place of the one nearest to a point."""
    far = F.transform(F.sequence(F.lit(first), F.least(F.size("xs"), F.lit(first + reach)) - 1), lambda k: F.struct((F.pow(F.get("xs", k) - x, F.lit(2.0)) + F.pow(F.get("ys", k) - y, F.lit(2.0))).alias("d"), k.alias("k")))
    return r.where(F.size("xs") > first).select("id", F.array_min(far)["k"].alias("k"))


def curved_grid(rail_a: list[tuple[float, float]], rail_b: list[tuple[float, float]], nrow: int, ncol: int) -> list[tuple[int, int, list[float], list[float]]]:
    """(row, col, xs, ys) of cells between two lines (rails), columns evenly along both, rows evenly from one to the other:
    curved, radial or anchored on landmarks, as the rails are. Rails are a few points that someone has drawn."""

    def along(rail, n):
        p = np.asarray(rail, float)
        d = np.r_[0, np.cumsum(np.hypot(*np.diff(p, axis=0).T))]
        t = np.linspace(0, d[-1], n + 1)
        return np.stack((np.interp(t, d, p[:, 0]), np.interp(t, d, p[:, 1])), axis=1)

    a, b = along(rail_a, ncol), along(rail_b, ncol)
    at = lambda r, c: a[c] + (b[c] - a[c]) * (r / nrow)
    cells = []
    for r in range(nrow):
        for c in range(ncol):
            corner = [at(r, c), at(r, c + 1), at(r + 1, c + 1), at(r + 1, c)]
            cells.append((r + 1, c + 1, [float(p[0]) for p in corner], [float(p[1]) for p in corner]))
    return cells


def radial_grid(x: float, y: float, inner: float, outer: float, nrow: int, ncol: int, points: int = 64) -> list[tuple[int, int, list[float], list[float]]]:
    """Cells of a ring about a centre: ``ncol`` sectors, ``nrow`` circles."""
    turn = np.linspace(0, 2 * np.pi, ncol * max(points // ncol, 1) + 1)
    rail = lambda r: [(x + r * float(np.cos(t)), y + r * float(np.sin(t))) for t in turn]
    return curved_grid(rail(outer), rail(inner), nrow, ncol)
