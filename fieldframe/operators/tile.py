"""Kernels over whole images: one row (img, h, w, data) an image, numpy on Arrow batches, no shuffle.

Neighbourhood operators need all of an image at once; an image is the unit of work and is bounded, so these run where the
rows are. ``apply`` lifts a kernel (array of h by w -> array) to a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def from_pixels(pixels: DataFrame, value: str, by: str = "img") -> DataFrame:
    """(img, row, col, value) -> (img, h, w, data): pixels of an image meet in one row; missing ones are null."""
    place = F.struct((F.col("row") * F.col("w") + F.col("col")).cast("int"), F.col(value).cast("double"))
    sizes = pixels.groupBy(F.col(by).alias("__img")).agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    known = pixels.join(sizes, F.col(by) == F.col("__img")).groupBy(by, "h", "w").agg(F.map_from_entries(F.collect_list(place)).alias("p"))
    full = F.transform(F.sequence(F.lit(0), (F.col("h") * F.col("w")).cast("int") - 1), lambda k: k)
    g = known.select(F.col(by).alias("img"), "h", "w", F.array_sort(F.map_entries("p")).alias("p"), full.alias("all"))
    dense = F.size("p") == F.col("h") * F.col("w")
    # Where pixels are missing, the places in between are merged in by one sort.
    gaps = F.array_sort(F.concat(F.col("p"), F.transform(F.array_except("all", F.col("p.key")), lambda k: F.struct(k.alias("key"), F.lit(None).cast("double").alias("value")))))
    return g.select("img", "h", "w", F.when(dense, F.col("p.value")).otherwise(F.transform(gaps, lambda q: q["value"])).alias("data"))


def from_embeddings(vectors: DataFrame, side: int = 8) -> DataFrame:
    """Vectors of side * side numbers as images."""
    return vectors.where(F.size("embedding") == side * side).select(F.col("vec_id").alias("img"), F.lit(side).alias("h"), F.lit(side).alias("w"), F.col("embedding").cast("array<double>").alias("data"))


def to_pixels(tiles: DataFrame, name: str = "v") -> DataFrame:
    return tiles.select("img", "w", F.posexplode("data").alias("pos", name)).select("img", F.floor(F.col("pos") / F.col("w")).cast("int").alias("row"), (F.col("pos") % F.col("w")).cast("int").alias("col"), name)


#: Numbers of images that a kernel's Python holds at once, or one image.
PIECE = 1 << 17


def pieces(batches, column: str = "data"):
    """Arrow batches in slices of at most PIECE numbers of a column (one row at least), so that what Python makes of them does
    not grow with the batch."""
    for b in batches:
        upto = np.cumsum(pc.list_value_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False) + 1)
        at = 0
        while at < len(b):
            end = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PIECE, "right")), at + 1)
            yield b.slice(at, end - at)
            at = end


def apply(tiles: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Every image through the kernel, which may change its size."""

    def run(batches):
        for b in pieces(batches):
            h, w, data = b.column("h").to_pylist(), b.column("w").to_pylist(), b.column("data")
            out = [np.asarray(kernel(data[k].values.to_numpy(zero_copy_only=False).astype(float).reshape(h[k], w[k])), float) for k in range(len(b))]
            sizes = [pa.array([o.shape[k] for o in out], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("img"), *sizes, pa.array([o.ravel() for o in out], pa.list_(pa.float64()))], ["img", "h", "w", "data"])

    kind = tiles.schema["img"].dataType.simpleString()
    return tiles.select("img", "h", "w", "data").mapInArrow(run, f"img {kind}, h int, w int, data array<double>")


def windows(a: np.ndarray, size: int, fill: float) -> np.ndarray:
    """All size by size neighbourhoods, borders filled: shape h, w, size, size."""
    r = size // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, r, constant_values=fill), (size, size))


def brush(size: int, shape: str = "disc") -> np.ndarray:
    """A structuring element of odd size: disc, box, diamond or line."""
    size += 1 - size % 2
    y, x = np.mgrid[: size, : size] - size // 2
    r = size // 2
    return {"disc": x * x + y * y <= (r + 0.5) ** 2, "box": np.ones((size, size), bool), "diamond": abs(x) + abs(y) <= r, "line": y == 0}[shape]


def erode(a, kern):
    return np.where(kern, windows(a, len(kern), np.inf), np.inf).min((2, 3))


def dilate(a, kern):
    return np.where(kern, windows(a, len(kern), -np.inf), -np.inf).max((2, 3))


def opening(a, kern):
    return dilate(erode(a, kern), kern)


def closing(a, kern):
    return erode(dilate(a, kern), kern)


def median(a, size=3):
    """Median of the pixels of the window that lie in the image."""
    return np.nanmedian(windows(a, size, np.nan), axis=(2, 3))


def blur(a, sigma=1.0):
    """Gaussian blur, borders repeated."""
    r = int(np.ceil(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    p = np.pad(a, r, mode="edge")
    p = np.apply_along_axis(np.convolve, 0, p, k, "valid")
    return np.apply_along_axis(np.convolve, 1, p, k, "valid")


def gradient(a):
    """Sobel gradients along x and y, borders repeated."""
    p = np.pad(a, 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    return gx, gy


def sobel(a):
    return np.hypot(*gradient(a))


def joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each of n things' sets, things i and j being joined."""
    up = np.arange(n)
    while True:
        low = np.minimum(up[i], up[j])
        new = up.copy()
        np.minimum.at(new, up[i], low)
        np.minimum.at(new, up[j], low)
        while not (new[new] == new).all():
            new = new[new]
        if (new == up).all():
            return up
        up = new


def label(mask, gap: int = 1, eight: bool = True):
    """Connected components numbered from 1 in scan order; pixels up to ``gap`` apart (Chebyshev) are neighbours, or with
    ``eight`` false those whose city-block distance is that small. Runs of a row's pixels are joined, not pixels."""
    mask = np.asarray(mask) > 0
    h, w = mask.shape
    step = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    if not len(row):
        return np.zeros(mask.shape, int)
    wide = w + 2 * gap + 2
    pairs_i, pairs_j = [], []
    for up in range(gap + 1):
        reach = gap if eight else gap - up
        above = (row - up) * wide
        first = np.searchsorted(row * wide + end, above + start - reach, "right")
        last = np.searchsorted(row * wide + start, above + end + reach, "left")
        first = np.maximum(first, np.searchsorted(row, row - up, "left"))
        last = np.minimum(last, np.searchsorted(row, row - up, "right"))
        n = np.maximum(last - first, 0)
        i = np.repeat(np.arange(len(row)), n)
        pairs_i.append(i)
        pairs_j.append(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n))
    _, number = np.unique(joined(len(row), np.concatenate(pairs_i), np.concatenate(pairs_j)), return_inverse=True)
    out = np.zeros(mask.shape, int)
    out[mask] = np.repeat(number + 1, end - start)
    return out


def fill_hull(mask):
    """Holes filled: background that no side-connected way joins to the border."""
    mask = np.asarray(mask) > 0
    back = label(np.pad(~mask, 1, constant_values=True), eight=False)
    return (back != back[0, 0])[1:-1, 1:-1]


def distance(mask):
    """City-block distance of foreground pixels to the nearest background pixel; outside the image is no background."""
    mask = np.asarray(mask) > 0
    out = np.where(mask, np.inf, 0.0)
    while True:
        p = np.pad(out, 1, constant_values=np.inf)
        new = np.minimum(out, np.minimum.reduce([p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]) + 1)
        if np.array_equal(new, out):
            return np.where(np.isinf(out), mask.size, out)
        out = new


#: Neighbours that share a side, columns first.
SIDES = ((0, -1), (0, 1), (-1, 0), (1, 0))


def flood(labels, mask):
    """Labels spread over the mask from side to side, one step a round; where two meet, the one whose pixel was reached
    first has it."""
    mask = np.pad(np.asarray(mask) > 0, 1)
    out = np.pad(labels, 1)
    wide = mask.shape[1]
    steps = np.array([y * wide + x for y, x in SIDES])
    flat, free = out.ravel(), mask.ravel()
    front = np.flatnonzero(out.T.ravel())
    front = front % out.shape[0] * wide + front // out.shape[0]  # column by column
    while len(front):
        to = (front[:, None] + steps).ravel()
        of = np.repeat(front, 4)
        new = free[to] & (flat[to] == 0)
        to, of = to[new], of[new]
        _, first = np.unique(to, return_index=True)
        first.sort()
        front = to[first]
        flat[front] = flat[of[first]]
    return out[1:-1, 1:-1]


def watershed(mask, share: float = 0.75):
    """Objects split at their necks: markers where the distance exceeds a share of the image's largest, flooded over the
    mask from side to side; then every pixel takes the label of its side neighbour of the smallest distance."""
    mask = np.asarray(mask) > 0
    if not mask.any():
        return np.zeros(mask.shape, int)
    d = distance(mask)
    full = flood(label(d > share * d.max()), mask)
    labels, far = np.pad(full, 1), np.pad(d.astype(float), 1)
    h, w = mask.shape
    best, out = np.full(mask.shape, np.inf), np.zeros(mask.shape, int)
    for y, x in SIDES:
        near, dist = labels[1 + y : 1 + y + h, 1 + x : 1 + x + w], far[1 + y : 1 + y + h, 1 + x : 1 + x + w]
        better = (near > 0) & (dist < best)
        best, out = np.where(better, dist, best), np.where(better, near, out)
    return np.where(mask, out, 0)


def _ring(a):
    p = np.pad(a, 1)
    return [p[:-2, 1:-1], p[:-2, 2:], p[1:-1, 2:], p[2:, 2:], p[2:, 1:-1], p[2:, :-2], p[1:-1, :-2], p[:-2, :-2]]


def thin(mask, rounds: int | None = None):
    """Zhang-Suen thinning, for so many rounds or until nothing changes."""
    a = (np.asarray(mask) > 0).astype(int)
    while rounds is None or rounds > 0:
        before = a.copy()
        for first in (True, False):
            n = _ring(a)
            count = sum(n)
            turns = sum((n[k] == 0) & (n[(k + 1) % 8] == 1) for k in range(8))
            up, right, down, left = n[0], n[2], n[4], n[6]
            free = (up * right * down == 0) & (right * down * left == 0) if first else (up * right * left == 0) & (up * down * left == 0)
            a = np.where((a == 1) & (count >= 2) & (count <= 6) & (turns == 1) & free, 0, a)
        if (a == before).all():
            break
        rounds = None if rounds is None else rounds - 1
    return a


def thin_guo_hall(mask):
    """Guo-Hall thinning until nothing changes."""
    a = (np.asarray(mask) > 0).astype(int)
    while True:
        before = a.copy()
        for first in (True, False):
            p2, p3, p4, p5, p6, p7, p8, p9 = (x.astype(bool) for x in _ring(a))
            c = (~p2 & (p3 | p4)).astype(int) + (~p4 & (p5 | p6)) + (~p6 & (p7 | p8)) + (~p8 & (p9 | p2))
            n1 = (p9 | p2).astype(int) + (p3 | p4) + (p5 | p6) + (p7 | p8)
            n2 = (p2 | p3).astype(int) + (p4 | p5) + (p6 | p7) + (p8 | p9)
            n = np.minimum(n1, n2)
            edge = (p2 | p3 | ~p5) & p4 if first else (p6 | p7 | ~p9) & p8
            a = np.where((a == 1) & (c == 1) & (n >= 2) & (n <= 3) & ~edge, 0, a)
        if (a == before).all():
            return a


def skeleton(mask, kern=None):
    """Morphological skeleton: what each erosion loses by opening, joined."""
    kern = brush(3, "diamond") if kern is None else kern
    a, out = np.asarray(mask, float), np.zeros(np.shape(mask))
    while a.any():
        eroded = np.where(np.isinf(erode(a, kern)), 0, erode(np.pad(a, 1), kern)[1:-1, 1:-1])
        out = np.maximum(out, a - np.minimum(a, np.maximum(dilate(eroded, kern), 0)))
        a = eroded
    return out


def canny(a, sigma=1.0, low=0.1, high=0.2):
    """Edges: blur, gradient, non-maximum suppression, hysteresis; thresholds are shares of the largest gradient."""
    gx, gy = gradient(blur(a, sigma))
    g = np.hypot(gx, gy)
    p = np.pad(g, 1)
    k = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    ahead = np.choose(k, [p[1:-1, 2:], p[2:, 2:], p[2:, 1:-1], p[2:, :-2]])
    behind = np.choose(k, [p[1:-1, :-2], p[:-2, :-2], p[:-2, 1:-1], p[:-2, 2:]])
    top = (g >= ahead) & (g > behind) & (g > 0)
    weak = top & (g >= low * g.max())
    parts = label(weak)
    return np.isin(parts, np.unique(parts[weak & (g >= high * g.max())])) & weak


def clahe(a, parts: int = 2, bins: int = 64, clip: float = 2.0):
    """Contrast-limited equalisation: per block, with bilinear blending of the blocks' maps."""
    lo, hi = a.min(), a.max()
    if hi <= lo:
        return a
    level = np.minimum(((a - lo) / (hi - lo) * bins).astype(int), bins - 1)
    h, w = a.shape
    rows, cols = np.array_split(np.arange(h), parts), np.array_split(np.arange(w), parts)
    maps = np.empty((parts, parts, bins))
    for i, r in enumerate(rows):
        for j, c in enumerate(cols):
            count = np.bincount(level[np.ix_(r, c)].ravel(), minlength=bins).astype(float)
            limit = max(clip * count.sum() / bins, 1)
            over = np.maximum(count - limit, 0).sum()
            count = np.minimum(count, limit) + over / bins
            maps[i, j] = np.cumsum(count) / count.sum()
    cy = np.clip(np.interp(np.arange(h), [r.mean() for r in rows], np.arange(parts)), 0, parts - 1)
    cx = np.clip(np.interp(np.arange(w), [c.mean() for c in cols], np.arange(parts)), 0, parts - 1)
    y0, x0 = np.floor(cy).astype(int), np.floor(cx).astype(int)
    y1, x1 = np.minimum(y0 + 1, parts - 1), np.minimum(x0 + 1, parts - 1)
    fy, fx = (cy - y0)[:, None], (cx - x0)[None]
    of = lambda y, x: maps[y[:, None], x[None], level]
    return lo + (hi - lo) * ((1 - fy) * ((1 - fx) * of(y0, x0) + fx * of(y0, x1)) + fy * ((1 - fx) * of(y1, x0) + fx * of(y1, x1)))


def rotate(a, degrees: float, background: float = 1.0, grow: bool = False):
    """Turned about the middle by inverse mapping (bilinear); same size, or with ``grow`` as large as the corners need."""
    h, w = a.shape
    t = np.radians(degrees)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    oh, ow = h, w
    if grow:
        oh, ow = int(np.ceil(h * abs(np.cos(t)) + w * abs(np.sin(t)) - 1e-9)), int(np.ceil(w * abs(np.cos(t)) + h * abs(np.sin(t)) - 1e-9))
    y, x = np.mgrid[:oh, :ow].astype(float)
    y, x = y - (oh - 1) / 2, x - (ow - 1) / 2
    sx, sy = np.cos(t) * x + np.sin(t) * y + cx, -np.sin(t) * x + np.cos(t) * y + cy
    return sample(a, sy, sx, background)


def sample(a, sy, sx, background: float):
    """Bilinear values at places; the background outside."""
    h, w = a.shape
    inside = (sy > -1e-9) & (sy < h - 1 + 1e-9) & (sx > -1e-9) & (sx < w - 1 + 1e-9)
    sy, sx = np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = sy - y0, sx - x0
    v = (1 - fy) * ((1 - fx) * a[y0, x0] + fx * a[y0, x1]) + fy * ((1 - fx) * a[y1, x0] + fx * a[y1, x1])
    return np.where(inside, v, background)


def resize(a, h: int, w: int):
    """Bilinear, corner to corner."""
    y, x = np.meshgrid(np.linspace(0, a.shape[0] - 1, h), np.linspace(0, a.shape[1] - 1, w), indexing="ij")
    return sample(a, y, x, 0.0)


def square(a, background: float = 1.0):
    """Padded to a square."""
    n = max(a.shape)
    t, l = (n - a.shape[0]) // 2, (n - a.shape[1]) // 2
    return np.pad(a, ((t, n - a.shape[0] - t), (l, n - a.shape[1] - l)), constant_values=background)


def autocrop(a, mask, edge: int = 0):
    r, c = np.nonzero(mask)
    return a if not len(r) else a[max(r.min() - edge, 0) : r.max() + edge + 1, max(c.min() - edge, 0) : c.max() + edge + 1]


STEPS = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def contour(mask) -> list[tuple[int, int]]:
    """Border pixels (row, col) of one object, in order, clockwise from its first pixel in scan order (Moore tracing)."""
    mask = np.pad(np.asarray(mask) > 0, 1)
    start = next(zip(*np.nonzero(mask), strict=True), None)
    if start is None:
        return []
    out, at, back = [start], start, 4
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            p = at[0] + STEPS[d][0], at[1] + STEPS[d][1]
            if mask[p]:
                break
        else:
            break
        if p == start and len(out) > 1 or len(out) > 4 * mask.size:
            break
        out.append(p)
        back = (d + 4) % 8
        at = p
    return [(int(r) - 1, int(c) - 1) for r, c in out]


def outlines(labels):
    """(label, pixels, outline) of each object of a label image; each is traced within its own box."""
    labels = np.asarray(labels).astype(int)
    r, c = np.nonzero(labels > 0)
    which, at, n = np.unique(labels[r, c], return_inverse=True, return_counts=True)
    ends = [np.full(len(which), v) for v in (labels.shape[0], -1, labels.shape[1], -1)]
    for to, f, v in zip(ends, (np.minimum, np.maximum) * 2, (r, r, c, c), strict=True):
        f.at(to, at, v)
    for k, count, r0, r1, c0, c1 in zip(which.tolist(), n.tolist(), *(e.tolist() for e in ends), strict=True):
        yield k, count, [(y + r0, x + c0) for y, x in contour(labels[r0 : r1 + 1, c0 : c1 + 1] == k)]


def contours(labels: DataFrame, kernel: Callable[[np.ndarray], np.ndarray] = lambda a: a) -> DataFrame:
    """Label images -> (img, id, seq, x, y): the outline of each object. The kernel makes label images of what comes in, in
    the same process: each step in Python has one of its own in every task."""

    def run(batches):
        for b in pieces(batches):
            rows = []
            for k, (img, h, w) in enumerate(zip(*(b.column(c).to_pylist() for c in ("img", "h", "w")), strict=True)):
                a = b.column("data")[k].values.to_numpy(zero_copy_only=False).astype(float).reshape(h, w)
                for of, _, ring in outlines(kernel(a)):
                    rows += [(img, of, n + 1, float(c), float(r)) for n, (r, c) in enumerate(ring)]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("img").type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3]), pa.array(cols[4])], ["img", "id", "seq", "x", "y"])

    return labels.select("img", "h", "w", "data").mapInArrow(run, f"img {labels.schema['img'].dataType.simpleString()}, id int, seq int, x double, y double")


def placed_brush(h: int, w: int, size: int, shape: str = "disc", rel_x: float = 0.5, rel_y: float = 0.5):
    """A mask with a brush about a place given in shares of the image's width and height."""
    kern = brush(size, shape)
    r = len(kern) // 2
    out = np.zeros((h + 2 * r, w + 2 * r), bool)
    y, x = round(rel_y * (h - 1)), round(rel_x * (w - 1))
    out[y : y + len(kern), x : x + len(kern)] = kern
    return out[r : r + h, r : r + w]


def masked(a, mask, background: float = 1.0):
    """The image inside a mask, the background's value outside."""
    return np.where(mask, a, background)


def horizontal(a):
    """A quarter turned if it is taller than wide."""
    return np.rot90(a) if a.shape[0] > a.shape[1] else a


def vertical(a):
    """A quarter turned if it is wider than tall."""
    return np.rot90(a) if a.shape[1] > a.shape[0] else a


def levelled(a, x1: float, y1: float, x2: float, y2: float, upright: bool = True, background: float = 1.0):
    """Turned so that the line between two points stands upright, or lies level."""
    return rotate(a, float(np.degrees(np.arctan2(x2 - x1, y2 - y1) if upright else -np.arctan2(y2 - y1, x2 - x1))), background, True)


def edges(a, sigma: float = 1.0):
    """One-pixel edges: blurred, Sobel gradient, Otsu's threshold, thinned."""
    from .analyze import otsu

    g = sobel(blur(a, sigma))
    return thin(g > otsu(g.ravel()))


def area_sums(a):
    """Summed-area table: at each pixel the sum of all above and left of it, itself included."""
    return np.cumsum(np.cumsum(a, 0), 1)


HARALICK = "asm con cor var idm sav sva sen ent dva den f12 f13".split()


def haralick(a, nbins: int = 32, step: int = 1) -> np.ndarray:
    """The 13 texture measures of grey-level co-occurrence over four directions together, in the order of HARALICK."""
    lo, hi = a.min(), a.max()
    g = np.zeros(a.shape, int) if hi <= lo else np.minimum(((a - lo) / (hi - lo) * nbins).astype(int), nbins - 1)
    m = np.zeros((nbins, nbins))
    h, w = g.shape
    for y, x in ((0, step), (step, 0), (step, step), (step, -step)):
        p = g[: h - y, max(0, -x) : w - max(0, x)]
        q = g[y:, max(0, x) : w - max(0, -x)]
        np.add.at(m, (p.ravel(), q.ravel()), 1)
    m = m + m.T
    p = m / max(m.sum(), 1)
    i, j = np.mgrid[:nbins, :nbins]
    px = p.sum(1)
    mu = (i * p).sum()
    var = ((i - mu) ** 2 * p).sum()
    s, d = np.bincount((i + j).ravel(), p.ravel(), 2 * nbins - 1), np.bincount(abs(i - j).ravel(), p.ravel(), nbins)
    ent = lambda v: -(v[v > 0] * np.log(v[v > 0])).sum()
    k = np.arange(2 * nbins - 1)
    sav = (k * s).sum()
    kd = np.arange(nbins)
    hxy, hx = ent(p), ent(px)
    pp = px[:, None] * px[None]
    hxy1, hxy2 = -(p[pp > 0] * np.log(pp[pp > 0])).sum(), ent(pp)
    return np.array([[
        (p**2).sum(), ((i - j) ** 2 * p).sum(), ((i * j * p).sum() - mu**2) / var if var > 0 else 0.0, var, (p / (1 + (i - j) ** 2)).sum(), sav, ((k - sav) ** 2 * s).sum(), ent(s), hxy,
        ((kd - (kd * d).sum()) ** 2 * d).sum(), ent(d), (hxy - hxy1) / hx if hx > 0 else 0.0, np.sqrt(max(0.0, 1 - np.exp(-2 * (hxy2 - hxy)))),
    ]])
