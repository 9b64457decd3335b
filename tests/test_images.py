import struct
import zlib

import numpy as np

from fieldframe.sources import images
from fieldframe.streaming import ingest


def png(a):
    h, w, bands = a.shape
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    lines, before = [], np.zeros((w, bands), int)
    for y in range(h):
        line = a[y].astype(int)
        rule = (0, 1, 2)[y % 3]
        left = np.vstack((np.zeros((1, bands), int), line[:-1]))
        lines.append(bytes([rule]) + ((line - (0, left, before)[rule]) & 255).astype(np.uint8).tobytes())
        before = line
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[bands], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_files_batch_and_stream(spark, tmp_path):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 256, (5, 7, 3)), rng.integers(0, 256, (4, 3, 1))
    (tmp_path / "a.png").write_bytes(png(a))
    (tmp_path / "b.pgm").write_bytes(images.encode_pnm(b / 255))
    (tmp_path / "c.png").write_bytes(b"not an image")
    got = {r.img.rpartition("/")[2]: r for r in images.read(spark, str(tmp_path)).collect()}
    assert np.allclose(np.array(got["a.png"].data).reshape(5, 7, 3) * 255, a)
    assert np.allclose(np.array(got["b.pgm"].data).reshape(4, 3, 1) * 255, b)
    assert got["c.png"].h is None
    px = images.pixels(images.read(spark, str(tmp_path), "a.png")).where("row = 2 and col = 4").first()
    assert np.allclose([px.R, px.G, px.B], a[2, 4] / 255)
    q = ingest.index_means(ingest.image_stream(spark, str(tmp_path), "*.png"), "(R+G+B)/3").writeStream.outputMode("complete").format("memory").queryName("means").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    (row,) = spark.sql("select * from means").collect()
    assert row.npixels == 35 and abs(row["mean"] - a.mean() / 255) < 1e-9
