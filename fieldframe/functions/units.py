"""Lengths in pixels, inches and centimetres, and colour scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INCH = 2.54


def dpi_to_cm(dpi: Column) -> Column:
    """Centimetres of a pixel."""
    return INCH / dpi


def cm_to_dpi(cm: Column) -> Column:
    """Dots an inch, of pixels of so many centimetres."""
    return INCH / cm


def pixels_to_cm(pixels: Column, dpi: Column) -> Column:
    return pixels * (INCH / dpi)


def cm_to_pixels(cm: Column, dpi: Column) -> Column:
    return cm / (INCH / dpi)


def calibrate(x1: Column, y1: Column, x2: Column, y2: Column, known_cm: Column) -> Column:
    """Pixels a centimetre, from two points that are a known distance apart."""
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) / known_cm


def palette(n: int, colours: tuple[tuple[float, float, float], ...] = ((0.65, 0.0, 0.15), (1.0, 1.0, 0.75), (0.0, 0.41, 0.22))) -> list[tuple[float, float, float]]:
    """n colours evenly along the straight lines between the given ones."""
    out = []
    for k in range(n):
        at = k / max(n - 1, 1) * (len(colours) - 1)
        i = min(int(at), len(colours) - 2)
        out.append(tuple(a + (b - a) * (at - i) for a, b in zip(colours[i], colours[i + 1], strict=True)))
    return out


def hues(n: int) -> list[float]:
    """n hues (degrees) evenly around the colour circle, from 15 on."""
    return [15 + 360 * k / n for k in range(n)]


def random_colours(n: int, seed: int = 0) -> list[str]:
    import random

    rng = random.Random(seed)
    return [f"#{rng.randrange(1 << 24):06x}" for _ in range(n)]
