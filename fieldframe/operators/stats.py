"""Agreement, entropy, principal components, list statistics, standard area diagrams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ccc(df: DataFrame, real: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """(by..., r, r2, ccc, d, rmse, rrmse, mae, bias). Two aggregations: the index of agreement needs the mean first."""
    by = by or []
    x, y = F.col(real), F.col(predicted)
    means = df.groupBy(*by).agg(F.avg(real).alias("__mx"))
    joined = df.join(means, by) if by else df.crossJoin(F.broadcast(means))  # one row without groups
    reach = F.abs(y - F.col("__mx")) + F.abs(x - F.col("__mx"))
    g = joined.groupBy(*by).agg(
        F.corr(x, y).alias("r"), F.covar_samp(x, y).alias("c"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.avg((y - x) * (y - x)).alias("mse"), F.avg(F.abs(y - x)).alias("mae"), F.avg(y - x).alias("bias"), F.sum((y - x) * (y - x)).alias("ss"), F.sum(reach * reach).alias("reach"),
    )
    gap = F.col("mx") - F.col("my")
    return g.select(
        *by, "r", (F.col("r") * F.col("r")).alias("r2"), F.try_divide(F.col("c") * 2.0, F.col("vx") + F.col("vy") + gap * gap).alias("ccc"),
        (1.0 - F.try_divide(F.col("ss"), F.col("reach"))).alias("d"), F.sqrt("mse").alias("rmse"), (F.try_divide(F.sqrt("mse"), F.col("mx")) * 100.0).alias("rrmse"), "mae", "bias",
    )


def entropy(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., entropy): Shannon entropy (natural logarithm) of the values rounded to two decimals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.round(value, 2).alias("__v")).agg(F.count("*").cast("double").alias("__n"))
    g = counts.groupBy(*by).agg(F.sum("__n").alias("n"), F.sum(F.col("__n") * F.ln("__n")).alias("s"))
    return g.select(*by, (F.ln("n") - F.col("s") / F.col("n")).alias("entropy"))


def list_stats(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Mean, sample sd, min and max of several columns in one pass."""
    kinds = {"mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max}
    return df.groupBy(*by).agg(*[f(c).alias(f"{c}_{k}") for c in cols for k, f in kinds.items()])


def covariance(df: DataFrame, cols: list[str], scale: bool = True) -> np.ndarray:
    """Covariance (or correlation) matrix by one aggregation; only the matrix comes to the driver."""
    f = F.corr if scale else F.covar_samp
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*[f(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"c{i}_{j}"] if row[f"c{i}_{j}"] is not None else float(i == j)
    return out


def pca(df: DataFrame, cols: list[str], scale: bool = True) -> tuple[DataFrame, np.ndarray]:
    """(component, eigenvalue, prop, accum) and the loadings; signs so that each component's largest loading is positive."""
    values, vectors = np.linalg.eigh(covariance(df, cols, scale))
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(cols))])
    share = values / values.sum()
    rows = [(k + 1, float(v), float(s), float(a)) for k, (v, s, a) in enumerate(zip(values, share, share.cumsum(), strict=True))]
    return df.sparkSession.createDataFrame(rows, "component int, eigenvalue double, prop double, accum double"), vectors


def pca_scores(df: DataFrame, cols: list[str], vectors: np.ndarray, keep: list[str], scale: bool = True) -> DataFrame:
    """Scores of every row, and the squared cosines of the first component."""
    stats = df.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(cols)], *[F.stddev_samp(c).alias(f"s{k}") for k, c in enumerate(cols)]).first()
    z = [(F.col(c) - float(stats[f"m{k}"])) / (float(stats[f"s{k}"]) if scale else 1.0) for k, c in enumerate(cols)]
    pcs = [sum((c * float(vectors[k, p]) for k, c in enumerate(z[1:], 1)), z[0] * float(vectors[0, p])) for p in range(len(cols))]
    total = sum((p * p for p in pcs[1:]), pcs[0] * pcs[0])
    return df.select(*keep, *[p.alias(f"pc{k + 1}") for k, p in enumerate(pcs)], F.try_divide(pcs[0] * pcs[0], total).alias("cos2_1"))


def sad(df: DataFrame, severity: str, n: int, by: list[str], tie: str) -> DataFrame:
    """Standard area diagram: n rows a group, evenly spaced over the rank of severity."""
    w = Window.partitionBy(*by).orderBy(severity, tie)
    r = df.withColumns({"rank": F.row_number().over(w), "__n": F.count("*").over(Window.partitionBy(*by))})
    step = (F.col("__n") - 1) / float(max(n - 1, 1))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * step + 0.5).cast("int") + 1)
    return r.where(F.array_contains(wanted, F.col("rank"))).drop("__n")
