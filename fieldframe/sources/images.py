"""Image files. JPEG, TIFF, PNG, GIF and BMP come through Spark's own image source, which decodes them in the JVM (eight bits
a channel); PNG of eight bits and binary PGM/PPM, in streams too, are decoded here from Spark's binary files. Written are
PNG and PGM/PPM, a file an image."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "img string, h int, w int, bands int, data array<double>"


def decode(blob: bytes) -> np.ndarray:
    """h by w by bands, values from 0 to 1."""
    return decode_png(blob) if blob[:8] == b"\x89PNG\r\n\x1a\n" else decode_pnm(blob)


def decode_pnm(blob: bytes) -> np.ndarray:
    if blob[:2] not in (b"P5", b"P6"):
        raise ValueError("neither PNG nor binary PGM or PPM")
    fields, at = [], 0
    while len(fields) < 4:
        if at >= len(blob):
            raise ValueError("no pixels")
        while blob[at : at + 1].isspace():
            at += 1
        if blob[at : at + 1] == b"#":
            at = blob.index(b"\n", at)
            continue
        end = at
        while end < len(blob) and not blob[end : end + 1].isspace():
            end += 1
        fields.append(blob[at:end])
        at = end
    bands = {b"P5": 1, b"P6": 3}[fields[0]]
    w, h, top = map(int, fields[1:])
    kind = np.dtype("u1") if top < 256 else np.dtype(">u2")
    return np.frombuffer(blob, kind, h * w * bands, at + 1).reshape(h, w, bands) / top


def encode_pnm(a: np.ndarray) -> bytes:
    h, w, bands = a.shape
    return b"P%d %d %d 255\n" % (5 if bands == 1 else 6, w, h) + np.clip(np.round(a * 255), 0, 255).astype(np.uint8).tobytes()


def decode_png(blob: bytes) -> np.ndarray:
    at, parts, palette = 8, [], None
    while at < len(blob):
        size, kind = struct.unpack(">I4s", blob[at : at + 8])
        body = blob[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        at += size + 12
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit PNG without interlacing")
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * bands)
    a = np.zeros((h, w, bands), np.uint8)
    up = np.zeros((w, bands), np.uint8)
    for y in range(h):
        rule, line = raw[y, 0], raw[y, 1:].reshape(w, bands)
        if rule in (0, 2):
            a[y] = line if not rule else line + up
        elif rule == 1:
            a[y] = np.cumsum(line, axis=0, dtype=np.uint8)  # sums of bytes wrap as the format wants
        else:
            a[y] = _filtered(line, up, bool(rule == 4))
        up = a[y]
    return (palette[a[..., 0]] if colour == 3 else a) / 255


def _filtered(line: np.ndarray, up: np.ndarray, paeth: bool) -> np.ndarray:
    """A line of average or Paeth differences, pixel by pixel: each needs the one before."""
    out = []
    for ups, diffs in zip(up.T.tolist(), line.T.tolist(), strict=True):
        left = corner = 0
        band = []
        for above, diff in zip(ups, diffs, strict=True):
            if paeth:
                p = left + above - corner
                x, y, z = abs(p - left), abs(p - above), abs(p - corner)
                guess = left if x <= y and x <= z else above if y <= z else corner
            else:
                guess = (left + above) // 2
            left = (diff + guess) & 255
            corner = above
            band.append(left)
        out.append(band)
    return np.array(out, np.uint8).T


def encode_png(a: np.ndarray) -> bytes:
    """Eight-bit PNG of values from 0 to 1: grey, grey and alpha, colour, or colour and alpha by the number of bands."""
    h, w, bands = a.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.clip(np.round(a * 255), 0, 255).astype(np.uint8).reshape(h, w * bands)
    body = np.hstack((np.zeros((h, 1), np.uint8), rows)).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[bands], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def read_any(spark: SparkSession, path: str, bands: int | None = None) -> DataFrame:
    """(img, h, w, bands, data) of the files of a folder that the JVM can decode; others are left out. Channels come in the
    order red, green, blue, alpha. The bytes become numbers from 0 to 1 in Arrow batches."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches):
        for b in batches:
            for img, h, w, n, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a = np.frombuffer(blob, np.uint8).reshape(h, w, n)
                a = a[..., [2, 1, 0, 3][:n]] if n >= 3 else a
                a = a[..., :bands] if bands else a
                values, kinds = [[img], *[[x] for x in a.shape], [(a / 255).ravel()]], [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], ["img", "h", "w", "bands", "data"])

    return rows.mapInArrow(run, SCHEMA)


def encoded(images: DataFrame, format: str = "png") -> DataFrame:
    """(img, content): the bytes of each image as a file."""
    encode = {"png": encode_png, "pnm": encode_pnm}[format]
    kind = images.schema["img"].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = [encode(np.array(d, float).reshape(h, w, n)) for _, h, w, n, d in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("img"), pa.array(out, pa.binary())], ["img", "content"])

    return images.where("data is not null").select("img", "h", "w", "bands", "data").mapInArrow(run, f"img {kind}, content binary")


def write(images: DataFrame, folder: str, format: str = "png", prefix: str = "") -> int:
    """A file an image, named by the prefix and the end of the image's name, and how many. The files are written by Hadoop's
    own file system on the driver's side of each batch of rows that arrives, one at a time, so any store that Spark knows
    will do; analyses of many images are better kept as tables."""
    spark = images.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    n = 0
    for r in encoded(images, format).toLocalIterator():
        name = str(r.img).rsplit("/", 1)[-1].rsplit(".", 1)[0]
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{prefix}{name}.{'png' if format == 'png' else 'ppm'}")
        out = at.getFileSystem(conf).create(at, True)
        out.write(bytes(r.content))
        out.close()
        n += 1
    return n


def create(spark: SparkSession, name: str, width: int, height: int, colour: tuple[float, ...] = (1.0, 1.0, 1.0)) -> DataFrame:
    """One image of one colour."""
    data = F.flatten(F.array_repeat(F.array(*[F.lit(float(c)) for c in colour]), width * height))
    return spark.range(1).select(F.lit(name).alias("img"), F.lit(height).alias("h"), F.lit(width).alias("w"), F.lit(len(colour)).alias("bands"), data.alias("data"))


def from_bands(bands: DataFrame, names: list[str]) -> DataFrame:
    """(img, h, w, one array for each band) -> (img, h, w, bands, data): band matrices as an image."""
    data = F.flatten(F.transform(F.arrays_zip(*names), lambda p: F.array(*[p[n] for n in names])))
    return bands.select("img", "h", "w", F.lit(len(names)).alias("bands"), data.alias("data"))


def tiles(files: DataFrame) -> DataFrame:
    """Rows of the binary file source (path, content), batch or stream -> (img, h, w, bands, data by pixel then band). Files
    that are no images have null sizes and data."""

    def run(batches):
        for b in batches:
            rows = []
            for path, blob in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    a = decode(blob)
                    rows.append((path, *a.shape, a.ravel()))
                except (ValueError, KeyError, IndexError, zlib.error, struct.error):
                    rows.append((path, None, None, None, None))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], ["img", "h", "w", "bands", "data"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return tiles(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path))


def band(k: int) -> Column:
    """The values of one band, pixel by pixel, of rows (bands, data by pixel then band); the last band stands for those that an
    image does not have."""
    return F.filter("data", lambda v, i: i % F.col("bands") == F.least(F.lit(k), F.col("bands") - 1))


def pixels(images: DataFrame, names: tuple[str, ...] = ("R", "G", "B")) -> DataFrame:
    """(img, row, col, one column for each band). Pixels become structs before they become rows, so that no row carries its
    image."""
    zipped = F.arrays_zip(*[band(k).alias(n) for k, n in enumerate(names)])
    at = images.where("data is not null").select("img", "w", F.posexplode(zipped).alias("k", "p"))
    return at.select("img", F.floor(F.col("k") / F.col("w")).cast("int").alias("row"), (F.col("k") % F.col("w")).alias("col"), *[F.col(f"p.{n}").alias(n) for n in names])
