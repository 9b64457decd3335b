"""Shared pieces of the text operators: tables, shared storage, batches and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. On one machine alone it may be unset; then it is a
    temporary folder. On a cluster that would be each executor's own disk, so an unset one is an error there."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='fieldframe-')}")
        current = sc._jsc.sc().getCheckpointDir()
    return named or current.get()


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows live in the shared folder, so lost executors take nothing with them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def save(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back (cheaper than a checkpoint for many or wide rows). Tables of
    earlier calls that nothing reads any more go (``spent``)."""
    path = f"{shared_dir(df.sparkSession)}/fieldframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_saved_at"] = path
    drop(*spent)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that ``save`` returned."""
    for t in tables:
        jvm, session = t.sparkSession.sparkContext._jvm, t.sparkSession._jsparkSession
        at = jvm.org.apache.hadoop.fs.Path(t.__dict__["_saved_at"])
        at.getFileSystem(session.sessionState().newHadoopConf()).delete(at, True)


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links of integer nodes -> (node, component), component being the smallest node reachable.

    Nodes without a link to another node do not appear. Each round hooks every node to its smallest neighbour, shortens
    the hooks by pointer jumping and contracts the links; a round at least halves the nodes of a component, so rounds
    grow with the logarithm of a component's size. Neighbour minima are partial aggregates, and the joins have plain
    exchanges of stored tables on both sides, so that adaptive execution can split the rows of a hub.
    """
    links = checkpoint(
        edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    found = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        hooks = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("up")))
        while True:
            above = hooks.select(F.col("node").alias("__n"), F.col("up").alias("__u"))
            jumped = checkpoint(hooks.join(above, F.col("up") == F.col("__n")).select("node", F.col("__u").alias("up"), (F.col("__u") != F.col("up")).alias("moved")))
            if jumped.where("moved").isEmpty():
                break
            hooks = jumped.select("node", "up")
        of = lambda end: hooks.select(F.col("node").alias(end), F.col("up").alias(f"__{end}"))
        moved = links.join(of("a"), "a").join(of("b"), "b").where("__a <> __b")
        links = checkpoint(moved.select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b")).distinct())
        if found is None:
            found = hooks
        else:
            later = hooks.select(F.col("node").alias("__n"), F.col("up").alias("__u"))
            found = checkpoint(found.join(later, F.col("up") == F.col("__n"), "left").select("node", F.coalesce("__u", "up").alias("up")))
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.select("node", F.col("up").alias("component"))
