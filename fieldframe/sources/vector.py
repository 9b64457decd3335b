"""Vector data: polygons as WKT, WKB or GeoJSON, in and out, as rings (xs, ys; not closed) in array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.functions import text

NUMBER = r"-?[0-9.]+(?:[eE][-+]?[0-9]+)?"


def from_wkt(df: DataFrame, wkt: str = "wkt") -> DataFrame:
    """df with xs and ys of the outer ring of its POLYGON, or the points of its LINESTRING; null for other texts."""
    body = F.regexp_extract(F.upper(F.trim(wkt)), r"^(?:POLYGON\s*\(\s*\(|LINESTRING\s*\()([^()]*)\)", 1)
    points = F.transform(F.split(body, ","), lambda p: F.regexp_extract_all(p, F.lit(f"({NUMBER})"), F.lit(1)))
    return _opened(df.withColumn("__p", F.when(body != "", points)), lambda k: F.transform("__p", lambda p: F.get(p, F.lit(k)).cast("double"))).drop("__p")


def _opened(df: DataFrame, part) -> DataFrame:
    """xs and ys, without a repeated first point."""
    df = df.withColumns({"xs": part(0), "ys": part(1)})
    shut = (F.size("xs") > 3) & (F.get("xs", F.lit(0)) == F.element_at("xs", -1)) & (F.get("ys", F.lit(0)) == F.element_at("ys", -1))
    return df.withColumns({c: F.when(shut, F.slice(c, F.lit(1), F.size(c) - 1)).otherwise(F.col(c)) for c in ("xs", "ys")})


def to_wkt(xs: str = "xs", ys: str = "ys", kind: str = "POLYGON", digits: int | None = None) -> Column:
    """The ring as WKT; a polygon's first point is repeated at its end."""
    n = (lambda v: v.cast("string")) if digits is None else (lambda v: F.format_string(f"%.{digits}f", v))
    points = F.transform(F.arrays_zip(F.col(xs).alias("a"), F.col(ys).alias("b")), lambda p: F.concat(n(p["a"]), F.lit(" "), n(p["b"])))
    if kind == "POLYGON":
        return F.concat(F.lit("POLYGON (("), F.array_join(F.concat(points, F.slice(points, 1, 1)), ", "), F.lit("))"))
    return F.concat(F.lit(f"{kind} ("), F.array_join(points, ", "), F.lit(")"))


def from_wkb(df: DataFrame, wkb: str = "wkb") -> DataFrame:
    """The same of little-endian WKB polygons of one ring (in Arrow batches, since numbers are read from bytes)."""
    import struct

    import numpy as np
    import pyarrow as pa

    names = df.columns
    at = names.index(wkb)

    def ring(b: bytes | None):
        if b is None or len(b) < 13 or b[0] != 1 or struct.unpack_from("<I", b, 1)[0] != 3:
            return None, None
        n = struct.unpack_from("<I", b, 9)[0]
        p = np.frombuffer(b, "<f8", 2 * n, 13).reshape(n, 2)
        p = p[:-1] if n > 3 and (p[0] == p[-1]).all() else p
        return p[:, 0], p[:, 1]

    def run(batches):
        for b in batches:
            rings = [ring(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[k] for r in rings], pa.list_(pa.float64())) for k in (0, 1))], [*names, "xs", "ys"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, xs array<double>, ys array<double>")


def to_wkb(df: DataFrame, name: str = "wkb") -> DataFrame:
    """df with the rings (xs, ys) as little-endian WKB polygons."""
    import struct

    import numpy as np
    import pyarrow as pa

    names = df.columns

    def blob(x, y):
        if x is None or y is None:
            return None
        p = np.stack((np.r_[x, x[:1]], np.r_[y, y[:1]]), axis=1).astype("<f8")
        return struct.pack("<BIII", 1, 3, 1, len(p)) + p.tobytes()

    def run(batches):
        for b in batches:
            out = [blob(x, y) for x, y in zip(b.column(names.index("xs")).to_pylist(), b.column(names.index("ys")).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, `{name}` binary")


GEOMETRY = "struct<type: string, coordinates: array<array<array<double>>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(properties, xs, ys) of the polygons of GeoJSON files: a feature a line, or a collection a file."""
    feature = f"struct<type: string, properties: map<string, string>, geometry: {GEOMETRY}>"
    raw = spark.read.option("multiLine", True).schema(f"type string, properties map<string, string>, geometry {GEOMETRY}, features array<{feature}>").json(path)
    one = F.coalesce("features", F.array(F.struct("type", "properties", "geometry")))
    rows = raw.select(F.explode(one).alias("f")).where("f.geometry.type = 'Polygon'").select("f.properties", F.get("f.geometry.coordinates", F.lit(0)).alias("__p"))
    return _opened(rows, lambda k: F.transform("__p", lambda p: F.get(p, F.lit(k)))).drop("__p")


def to_geojson(df: DataFrame, properties: list[str]) -> DataFrame:
    """(value): one GeoJSON feature a row, ready for ``write.text``."""
    point = F.transform(F.arrays_zip("xs", "ys"), lambda p: F.array(p["xs"], p["ys"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(F.concat(point, F.slice(point, 1, 1))).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value"))


def read_shapes(spark: SparkSession, path: str, format: str = "parquet", wkt: str = "wkt") -> DataFrame:
    """Plots from a table with a WKT column (any Spark format, or geojson): rings, and the plot columns that are missing."""
    rows = read_geojson(spark, path) if format == "geojson" else from_wkt(spark.read.format(format).option("header", True).load(path), wkt)
    return text.add_missing_columns(rows)


def write_shapes(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Rings as a table with a WKT column, or as GeoJSON features."""
    plain = [c for c in df.columns if c not in ("xs", "ys")]
    if format == "geojson":
        to_geojson(df, plain).write.text(path)
    else:
        df.select(*plain, to_wkt().alias("wkt")).write.format(format).save(path)
