"""Line segments and sub-pixel contours of images: kernels for ``tile`` that return lists of shapes."""

from __future__ import annotations

from math import lgamma, log, log10, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tile import blur

#: Directions that agree to within this angle support one segment; their chance is the angle over half a turn.
TOLERANCE = pi / 8


def false_alarms(n: int, k: int, p: float, tests: float) -> float:
    """-log10 of the expected number of segments with k or more of n directions agreeing by chance."""
    if not n or not k:
        return -log10(tests)
    logs = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p) for i in range(k, n + 1)]
    top = max(logs)
    return -(top + log(sum(np.exp(x - top) for x in logs))) / log(10) - log10(tests)


def segments(a: np.ndarray, quantum: float = 2 / 255, least: float = 0.0) -> list[tuple[float, float, float, float, float, float]]:
    """(x1, y1, x2, y2, width, -log10 of false alarms): regions of pixels whose level lines agree are grown from the steepest
    gradients on; a region's rectangle along its principal axis is kept if so many directions would hardly agree by chance."""
    gx = (a[:-1, 1:] + a[1:, 1:] - a[:-1, :-1] - a[1:, :-1]) / 2
    gy = (a[1:, :-1] + a[1:, 1:] - a[:-1, :-1] - a[:-1, 1:]) / 2
    steep = np.hypot(gx, gy)
    angle = np.arctan2(gx, -gy)
    h, w = steep.shape
    free = steep > quantum / np.sin(TOLERANCE)
    tests = (h * w) ** 2.5
    smallest = int(-log10(tests) / log10(TOLERANCE / pi)) + 1
    out = []
    order = np.argsort(-steep, axis=None)
    for start in order[: int(free.sum())].tolist():
        r, c = divmod(start, w)
        if not free[r, c]:
            continue
        region, free[r, c] = [(r, c)], False
        s, t, mean = np.sin(angle[r, c]), np.cos(angle[r, c]), angle[r, c]
        for y, x in region:
            for v in range(max(y - 1, 0), min(y + 2, h)):
                for u in range(max(x - 1, 0), min(x + 2, w)):
                    if free[v, u] and abs((angle[v, u] - mean + pi) % (2 * pi) - pi) <= TOLERANCE:
                        free[v, u] = False
                        region.append((v, u))
                        s, t = s + np.sin(angle[v, u]), t + np.cos(angle[v, u])
                        mean = np.arctan2(s, t)
        if len(region) < smallest:
            continue
        p = np.array(region, float)
        weight = steep[p[:, 0].astype(int), p[:, 1].astype(int)]
        middle = (p * weight[:, None]).sum(0) / weight.sum()
        d = p - middle
        cov = (d * weight[:, None]).T @ d
        vec = np.linalg.eigh(cov)[1][:, 1]
        along, across = d @ vec, d @ np.array([-vec[1], vec[0]])
        lo, hi, width = along.min(), along.max(), across.max() - across.min() + 1
        n = max(int((hi - lo + 1) * width), len(region))
        alarms = false_alarms(n, len(region), TOLERANCE / pi, tests)
        if alarms >= least:
            (y1, x1), (y2, x2) = middle + lo * vec + 0.5, middle + hi * vec + 0.5
            out.append((float(x1), float(y1), float(x2), float(y2), float(width), float(alarms)))
    return out


def contour_lines(a: np.ndarray, level: float, sigma: float = 0.0) -> list[np.ndarray]:
    """Level lines at sub-pixel places: on every cell's edges where the level is crossed, joined cell by cell into chains (k by
    2: x, y). sigma: Gaussian blur first, for smooth lines."""
    a = (blur(a, sigma) if sigma else a) - level
    h, w = a.shape
    ends: dict[tuple, list[tuple]] = {}

    def place(r0, c0, r1, c1):
        f = a[r0, c0] / (a[r0, c0] - a[r1, c1])
        return (c0 + f * (c1 - c0), r0 + f * (r1 - r0))

    inside = a > 0
    mixed = (inside[:-1, :-1].astype(int) + inside[1:, :-1] + inside[:-1, 1:] + inside[1:, 1:]) % 4 != 0
    points = {}
    for r, c in zip(*np.nonzero(mixed), strict=True):
        corners = [(r, c), (r, c + 1), (r + 1, c + 1), (r + 1, c)]
        cut = []
        for k in range(4):
            p, q = sorted((corners[k], corners[(k + 1) % 4]))
            if inside[p] != inside[q]:
                points[p, q] = place(*p, *q)
                cut.append((p, q))
        if len(cut) == 4 and (a[r : r + 2, c : c + 2].mean() > 0) == inside[r, c]:
            cut = cut[1:] + cut[:1]
        for x, y in zip(cut[::2], cut[1::2], strict=True):
            ends.setdefault(x, []).append(y)
            ends.setdefault(y, []).append(x)
    out, seen = [], set()
    for first in sorted(ends, key=lambda e: (len(ends[e]), e)):  # open chains begin at their ends
        if first in seen:
            continue
        chain, at = [first], first
        seen.add(first)
        while nxt := [e for e in ends[at] if e not in seen]:
            at = nxt[0]
            seen.add(at)
            chain.append(at)
        if len(chain) > 2 and first in ends[at]:
            chain.append(first)
        out.append(np.array([points[e] for e in chain]))
    return out


def line_segments(tiles: DataFrame, quantum: float = 2 / 255, least: float = 0.0) -> DataFrame:
    """(img, id, x1, y1, x2, y2, width, log_nfa) of every image (img, h, w, data)."""

    def run(batches):
        for b in batches:
            rows = []
            for img, h, w, data in zip(*(b.column(c).to_pylist() for c in ("img", "h", "w", "data")), strict=True):
                rows += [(img, k, *s) for k, s in enumerate(segments(np.array(data, float).reshape(h, w), quantum, least), 1)]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("img").type), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.float64()) for c in cols[2:])], ["img", "id", "x1", "y1", "x2", "y2", "width", "log_nfa"])

    return tiles.select("img", "h", "w", "data").mapInArrow(run, f"img {tiles.schema['img'].dataType.simpleString()}, id int, x1 double, y1 double, x2 double, y2 double, width double, log_nfa double")


def contours(tiles: DataFrame, level: float, sigma: float = 0.0) -> DataFrame:
    """(img, id, seq, x, y): the level lines of every image."""

    def run(batches):
        for b in batches:
            rows = []
            for img, h, w, data in zip(*(b.column(c).to_pylist() for c in ("img", "h", "w", "data")), strict=True):
                for k, line in enumerate(contour_lines(np.array(data, float).reshape(h, w), level, sigma), 1):
                    rows += [(img, k, n, float(x), float(y)) for n, (x, y) in enumerate(line, 1)]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("img").type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3]), pa.array(cols[4])], ["img", "id", "seq", "x", "y"])

    return tiles.select("img", "h", "w", "data").mapInArrow(run, f"img {tiles.schema['img'].dataType.simpleString()}, id int, seq int, x double, y double")

