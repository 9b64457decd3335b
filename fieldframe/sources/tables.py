"""Domain tables (pixels, tiles, outlines, points) as views of the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
#: Wavelength layers of the hyperspectral pixels: NNN -> expression over the other bands.
WAVES = (535, 549, 570, 669, 699, 711, 722, 734, 750, 764, 799)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiband pixels: key, img (returnflag), id (the supplier: the object's label), R, G, B, RE, NIR, SWIR, TIR."""
    q = F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").select(
        *KEY,
        F.col("l_returnflag").alias("img"),
        F.col("l_suppkey").alias("id"),
        (q / 50.0).alias("R"),
        (F.col("l_extendedprice") / 100000.0).alias("G"),
        (F.col("l_discount") * 10.0 + 0.0).alias("B"),
        ((q % 7.0 + 1.0) / 8.0).alias("RE"),
        ((F.col("l_tax") * 10.0 + 1.0) / 2.0).alias("NIR"),
        (F.col("l_tax") * 5.0 + 0.25).alias("SWIR"),
        (q / 100.0 + 0.25).alias("TIR"),
    )


PIXELS_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS img, l_suppkey AS id, l_quantity / 50.0::DOUBLE AS R,
  l_extendedprice / 100000.0::DOUBLE AS G, l_discount * 10.0::DOUBLE + 0.0::DOUBLE AS B, (l_quantity % 7.0::DOUBLE + 1.0::DOUBLE) / 8.0::DOUBLE AS RE,
  (l_tax * 10.0::DOUBLE + 1.0::DOUBLE) / 2.0::DOUBLE AS NIR, l_tax * 5.0::DOUBLE + 0.25::DOUBLE AS SWIR, l_quantity / 100.0::DOUBLE + 0.25::DOUBLE AS TIR FROM lineitem"""


def hyper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with a layer nmNNN for each wavelength, between R and NIR."""
    return pixels(spark, sf_dir).withColumns({f"nm{w}": F.col("R") + (F.col("NIR") - F.col("R")) * ((w - 500) / 300) for w in WAVES})


HYPER_SQL = "SELECT *, " + ", ".join(f"R + (NIR - R) * {(w - 500) / 300!r}::DOUBLE AS nm{w}" for w in WAVES) + f" FROM ({PIXELS_SQL})"


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 by 8 single-band images: img, label, row, col (from 0), v."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v"))
    return e.select("img", "label", F.floor(F.col("pos") / 8).cast("int").alias("row"), (F.col("pos") % 8).alias("col"), "v")


TILES_SQL = """SELECT vec_id AS img, label, ((p - 1) // 8)::INT AS row, ((p - 1) % 8)::INT AS col, embedding[p]::DOUBLE AS v
  FROM embeddings, unnest(range(1, 65)) AS u(p) WHERE embedding[p] IS NOT NULL"""


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygon vertices: id (order), seq (from 1), x, y; orders of three lines and more."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") + 0.0).alias("x"), (F.col("l_extendedprice") / 1000.0).alias("y"))
    rings = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("v")).where(F.size("v") >= 3)
    return rings.select("id", F.posexplode("v").alias("pos", "p")).select("id", (F.col("pos") + 1).alias("seq"), "p.x", "p.y")


OUTLINES_SQL = """SELECT id, seq::INT AS seq, x, y FROM (SELECT l_orderkey AS id, row_number() OVER w AS seq, count(*) OVER (PARTITION BY l_orderkey) AS n,
  l_quantity + 0.0::DOUBLE AS x, l_extendedprice / 1000.0::DOUBLE AS y FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) WHERE n >= 3"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Individuals in a field: id (event), grp (user), kind (type), x (hour of the day), y (value)."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("grp"), F.col("event_type").alias("kind"), (F.expr("(hour(ts) * 3600 + minute(ts) * 60) * 1000000L + cast(extract(second from ts) * 1000000 as bigint)") / 3600000000.0).alias("x"), F.col("value").alias("y")
    )


POINTS_SQL = """SELECT event_id AS id, user_id AS grp, event_type AS kind, (epoch_us(ts) % 86400000000) / 3600000000.0::DOUBLE AS x, value AS y FROM events"""
