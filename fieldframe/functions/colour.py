"""Colour spaces and colour correction as column expressions over R, G, B in 0 to 1."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hsb(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Hue in degrees (may be negative; null for greys), saturation (null for black) and brightness in per cent."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    hue = F.when(high == r, F.try_divide(g - b, span)).when(high == g, F.try_divide(b - r, span) + 2.0).otherwise(F.try_divide(r - g, span) + 4.0) * 60.0
    return {"hsb_h": hue, "hsb_s": F.try_divide(span, high) * 100.0, "hsb_b": high * 100.0}


# Linear RGB to the sRGB mixture, and to CIE XYZ under D65 with its white point.
MIX = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def _mixed(bands: list[Column]) -> list[Column]:
    return [sum((c * m for c, m in zip(bands[1:], row[1:], strict=True)), bands[0] * row[0]) for row in MIX]


def srgb(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Gamma 2.2, then the mixture, clamped to 0 .. 1."""
    out = _mixed([F.pow(c, F.lit(2.2)) for c in (r, g, b)])
    return {n: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) for n, c in zip(("sR", "sG", "sB"), out, strict=True)}


def lab(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """CIE L*, a*, b* from bands raised by gamma 2.2, through XYZ and the D65 white point."""
    scaled = [c / w for c, w in zip(_mixed([F.pow(c, F.lit(2.2)) for c in (r, g, b)]), WHITE, strict=True)]
    x, y, z = (F.when(c > 216 / 24389, F.cbrt(c)).otherwise((c * (24389 / 27) + 16.0) / 116.0) for c in scaled)
    return {"lab_l": y * 116.0 - 16.0, "lab_a": (x - y) * 500.0, "lab_b": (y - z) * 200.0}


def cubic_terms(r, g, b) -> list:
    """Nine terms: the bands and their squares and cubes."""
    return [r, g, b, r * r, g * g, b * b, r * r * r, g * g * g, b * b * b]


def polynomial_terms(r, g, b) -> list:
    """Twenty terms: one, and all products of the bands up to the third power."""
    one = r * 0.0 + 1.0
    return [one, r, g, b, r * g, r * b, g * b, r * r, g * g, b * b, r * r * r, g * g * g, b * b * b, r * r * g, r * r * b, g * g * r, g * g * b, b * b * r, b * b * g, r * g * b]


MODELS = {"cubic": cubic_terms, "root_polynomial": polynomial_terms}


def fit_correction(card: np.ndarray, known: np.ndarray, model: str = "cubic") -> np.ndarray:
    """Least-squares matrix (terms by three bands) that takes a colour card's chips to their known colours. A card has a few
    dozen chips, so the fit is on the driver."""
    return np.linalg.pinv(np.stack(MODELS[model](*card.T), axis=1)) @ known


def correct(pixels: DataFrame, matrix: np.ndarray, model: str = "cubic") -> DataFrame:
    """Pixels with their R, G and B corrected."""
    terms = MODELS[model](F.col("R"), F.col("G"), F.col("B"))
    return pixels.withColumns({n: sum((t * float(m) for t, m in zip(terms[1:], matrix[1:, k], strict=True)), terms[0] * float(matrix[0, k])) for k, n in enumerate("RGB")})


def chips(image: np.ndarray, corners: list[tuple[float, float]], nrow: int = 4, ncol: int = 6, inner: float = 0.5) -> np.ndarray:
    """Mean colours (nrow * ncol by bands) of a colour card's chips, whose grid lies between four corners (x, y; clockwise
    from the upper left), over the inner share of each chip."""
    p = np.asarray(corners, float)
    out = []
    for r in range(nrow):
        for c in range(ncol):
            u = (c + 0.5 + np.linspace(-inner / 2, inner / 2, 7)[None]) / ncol
            v = (r + 0.5 + np.linspace(-inner / 2, inner / 2, 7)[:, None]) / nrow
            at = [(1 - v) * ((1 - u) * p[0, k] + u * p[1, k]) + v * ((1 - u) * p[3, k] + u * p[2, k]) for k in (0, 1)]
            x, y = (np.clip(np.round(a).astype(int), 0, n - 1) for a, n in zip(at, (image.shape[1], image.shape[0]), strict=True))
            out.append(image[y, x].mean((0, 1)))
    return np.array(out)


def find_card(mask: np.ndarray) -> list[tuple[float, float]]:
    """The corners (x, y; clockwise from the upper left) of the largest object of a mask."""
    from fieldframe.operators import tile

    labels = tile.label(mask)
    y, x = np.nonzero(labels == np.bincount(labels.ravel())[1:].argmax() + 1)
    far = [(s * x + t * y).argmin() for s, t in ((1, 1), (-1, 1), (-1, -1), (1, -1))]
    return [(float(x[k]), float(y[k])) for k in far]
