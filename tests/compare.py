"""Runs queries and their SQL side by side on one folder of tables."""

from __future__ import annotations

import math
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def key(row):
    return tuple(("" if v is None or isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)) for v in row)


def differs(spark, con, run, sql: str, sf_dir: str) -> str | None:
    """What differs between a query and its SQL; None if nothing does."""
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} and {sorted(rel.columns)}"
    a = sorted(key(r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    b = sorted(key(r) for r in rel.project(", ".join(f'"{n}"' for n in names)).fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows, {bad[:2]} of {names}" if bad else None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    d, names = sys.argv[1], sys.argv[2:]
    con, queries, oracle = connect(d), e.registry.queries(), e.oracle_sql()
    for name, run in queries.items():
        if not names or any(n in name for n in names):
            try:
                said = differs(spark, con, run, oracle[name], d) if name in oracle else f"no SQL; {run(spark, d).count()} rows"
            except Exception as x:
                said = f"{type(x).__name__} {' '.join(str(x).split())[:300]}"
            if said:
                print(name, "|", said, flush=True)
    print("done")
