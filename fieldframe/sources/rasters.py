"""GeoTIFF rasters: strips, uncompressed or deflated, 8 to 64 bits, whole or floating numbers, bands by pixel or apart, with
the pixel size, corner and coordinate system of their tags. Read through Spark's binary files, a row a file; large mosaics
are read as the tiles that they are kept in."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import images

SCHEMA = "img string, h int, w int, bands int, xmin double, ymax double, resx double, resy double, epsg int, data array<double>"
# Tag numbers and number types of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, KIND = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 339
SCALE, TIEPOINT, KEYS = 33550, 33922, 34735
PROJECTED, GEOGRAPHIC = 3072, 2048
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
#: Web Mercator, for files that name no coordinate system.
DEFAULT_EPSG = 3857


def tags(blob: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(blob[:2])
    if order is None or struct.unpack_from(order + "H", blob, 2)[0] != 42:
        raise ValueError("no TIFF")
    at = struct.unpack_from(order + "I", blob, 4)[0]
    out = {}
    for k in range(struct.unpack_from(order + "H", blob, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", blob, at + 2 + 12 * k)
        if kind not in TYPES:
            continue
        form = order + TYPES[kind] * n
        size = struct.calcsize(form)
        place = at + 2 + 12 * k + 8
        out[tag] = struct.unpack_from(form, blob, place if size <= 4 else struct.unpack_from(order + "I", blob, place)[0])
    return order, out


def decode(blob: bytes) -> tuple[np.ndarray, tuple[float, float, float, float], int]:
    """h by w by bands as doubles; (xmin, ymax, resx, resy); the EPSG code."""
    order, t = tags(blob)
    w, h = t[WIDTH][0], t[HEIGHT][0]
    bands, planar, packed = t.get(SAMPLES, (1,))[0], t.get(PLANAR, (1,))[0], t.get(COMPRESSION, (1,))[0]
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[t.get(KIND, (1,))[0]] + str(t.get(BITS, (8,))[0] // 8))
    if OFFSETS not in t or packed not in (1, 8, 32946):
        raise ValueError("only strips, uncompressed or deflated")
    parts = [blob[o : o + n] for o, n in zip(t[OFFSETS], t[COUNTS], strict=True)]
    flat = np.frombuffer(b"".join(parts if packed == 1 else map(zlib.decompress, parts)), kind)
    a = flat[: h * w * bands].reshape((bands, h, w) if planar == 2 else (h, w, bands))
    a = np.moveaxis(a, 0, 2) if planar == 2 else a
    if t.get(PREDICTOR, (1,))[0] == 2:
        a = np.cumsum(a, axis=1, dtype=kind.newbyteorder("="))
    rx, ry = t.get(SCALE, (1.0, 1.0))[:2]
    i, j, _, x, y, _ = t.get(TIEPOINT, (0.0, 0.0, 0.0, 0.0, float(h), 0.0))[:6]
    keys = t.get(KEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    return a.astype(float), (x - i * rx, y + j * ry, rx, ry), codes.get(PROJECTED, codes.get(GEOGRAPHIC, DEFAULT_EPSG))


def number_type(a: np.ndarray) -> str:
    """The smallest type that holds all values: one or two whole bytes, or single precision."""
    whole = np.isfinite(a).all() and (a == np.floor(a)).all() and a.size and a.min() >= 0
    return "u1" if whole and a.max() < 256 else "u2" if whole and a.max() < 65536 else "f4"


def encode(a: np.ndarray, corner: tuple[float, float, float, float], epsg: int = DEFAULT_EPSG, kind: str | None = None) -> bytes:
    """A deflated GeoTIFF of one strip."""
    h, w, bands = a.shape
    kind = kind or number_type(a)
    body = zlib.compress(np.ascontiguousarray(a.astype("<" + kind)).tobytes())
    x, y, rx, ry = corner
    fields = {
        WIDTH: ("I", [w]), HEIGHT: ("I", [h]), BITS: ("H", [int(kind[1]) * 8] * bands), COMPRESSION: ("H", [8]), PHOTOMETRIC: ("H", [1]), OFFSETS: ("I", [8]), SAMPLES: ("H", [bands]), ROWS: ("I", [h]), COUNTS: ("I", [len(body)]),
        PLANAR: ("H", [1]), KIND: ("H", [{"u": 1, "f": 3}[kind[0]]] * bands), SCALE: ("d", [rx, ry, 0.0]), TIEPOINT: ("d", [0.0, 0.0, 0.0, x, y, 0.0]), KEYS: ("H", [1, 1, 0, 1, GEOGRAPHIC if 4000 <= epsg < 5000 else PROJECTED, 0, 1, epsg]),
    }
    numbers = {"H": 3, "I": 4, "d": 12}
    start = 8 + len(body) + len(body) % 2
    later = start + 2 + 12 * len(fields) + 4
    head, tail = struct.pack("<H", len(fields)), b""
    for tag, (form, values) in sorted(fields.items()):
        raw = struct.pack("<" + form * len(values), *values)
        head += struct.pack("<HHI", tag, numbers[form], len(values)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", later + len(tail)))
        tail += raw if len(raw) > 4 else b""
    return b"II" + struct.pack("<HI", 42, start) + body + b"\0" * (len(body) % 2) + head + b"\0\0\0\0" + tail


def read(spark: SparkSession, path: str, missing: float | None = 65535.0, glob: str = "*.tif*") -> DataFrame:
    """(img, h, w, bands, xmin, ymax, resx, resy, epsg, data by pixel then band); ``missing`` values are null; files that
    cannot be read have null sizes."""

    def run(batches):
        for b in batches:
            for path, blob in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    a, corner, epsg = decode(blob)
                    flat = a.ravel()
                    row = [path, *a.shape, *corner, epsg, pa.array(flat, mask=np.zeros(len(flat), bool) if missing is None else flat == missing)]
                except (ValueError, KeyError, struct.error, zlib.error):
                    row = [path, *[None] * 9]
                kinds = [pa.string(), *[pa.int32()] * 3, *[pa.float64()] * 4, pa.int32()]
                data = pa.array([None if row[9] is None else row[9].to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip(row[:9], kinds, strict=True)), data], [x.split()[0] for x in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInArrow(run, SCHEMA)


def pixels(rasters: DataFrame, names: list[str]) -> DataFrame:
    """(img, row, col, x, y, a column for each band) of every pixel."""
    zipped = F.arrays_zip(*[images.band(k).alias(n) for k, n in enumerate(names)])
    at = rasters.where("data is not null").select("img", "w", "xmin", "ymax", "resx", "resy", F.posexplode(zipped).alias("k", "p"))
    row, col = F.floor(F.col("k") / F.col("w")).cast("int"), F.col("k") % F.col("w")
    return at.select("img", row.alias("row"), col.alias("col"), (F.col("xmin") + (col + 0.5) * F.col("resx")).alias("x"), (F.col("ymax") - (row + 0.5) * F.col("resy")).alias("y"), *[F.col(f"p.{n}").alias(n) for n in names])


def encoded(rasters: DataFrame) -> DataFrame:
    """(img, content): GeoTIFF bytes of rows as ``read`` gives them; null pixels become not-a-number."""
    columns = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for _, h, w, n, x, y, rx, ry, epsg, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.append(encode(np.array([np.nan if v is None else v for v in data], float).reshape(h, w, n), (x, y, rx, ry), epsg))
            yield pa.RecordBatch.from_arrays([b.column("img"), pa.array(out, pa.binary())], ["img", "content"])

    return rasters.where("data is not null").select(*columns).mapInArrow(run, "img string, content binary")
