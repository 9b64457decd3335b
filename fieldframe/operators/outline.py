"""Elliptic Fourier descriptors and landmarks of rings (id, xs, ys), as projections over arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import polygon

TWO_PI = 2 * 3.141592653589793


def efourier(r: DataFrame, nharm: int = 10) -> DataFrame:
    """(id, a0, c0, coefs array<struct<n, a, b, c, d>>): the edge to a vertex comes from the one before it, cyclically;
    edges without length count as 1e-10. Rings packed by id stay where they are: both groupings reuse their partitioning."""
    n = F.size("xs")
    before = lambda a: F.concat(F.slice(a, n, F.lit(1)), F.slice(a, F.lit(1), n - 1))
    zipped = F.arrays_zip("xs", "ys", before(F.col("xs")).alias("bx"), before(F.col("ys")).alias("by"))
    e = r.select("id", F.posexplode(zipped).alias("pos", "p")).select("id", "pos", F.col("p.xs").alias("x"), F.col("p.ys").alias("y"), (F.col("p.xs") - F.col("p.bx")).alias("dx"), (F.col("p.ys") - F.col("p.by")).alias("dy"))
    e = e.withColumn("dt", F.greatest(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), F.lit(1e-10)))
    ring = Window.partitionBy("id")
    e = e.withColumns({"t": F.sum("dt").over(ring.orderBy("pos")), "total": F.sum("dt").over(ring)})
    e = e.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(nharm))))
    at = lambda t: F.col("n") * TWO_PI * t / F.col("total")
    now, then = at(F.col("t")), at(F.col("t") - F.col("dt"))
    scale = F.max("total") / (F.col("n") * F.col("n") * (TWO_PI * TWO_PI / 2))
    part = lambda d, f: scale * F.sum(F.col(d) / F.col("dt") * (f(now) - f(then)))
    g = e.groupBy("id", "n").agg(
        part("dx", F.cos).alias("a"), part("dx", F.sin).alias("b"), part("dy", F.cos).alias("c"), part("dy", F.sin).alias("d"),
        (F.sum(F.col("x") * F.col("dt")) / F.max("total")).alias("a0"), (F.sum(F.col("y") * F.col("dt")) / F.max("total")).alias("c0"),
    )
    return g.groupBy("id").agg(F.max("a0").alias("a0"), F.max("c0").alias("c0"), F.array_sort(F.collect_list(F.struct("n", "a", "b", "c", "d"))).alias("coefs"))


def coefficients(e: DataFrame) -> DataFrame:
    """Long form (id, n, a, b, c, d)."""
    return e.select("id", F.explode("coefs").alias("k")).select("id", "k.*")


def wide(e: DataFrame, nharm: int) -> DataFrame:
    """(id, A1..An, B1..Bn, C1..Cn, D1..Dn)."""
    return e.select("id", *[F.get("coefs", F.lit(k))[c].alias(f"{c.upper()}{k + 1}") for c in "abcd" for k in range(nharm)])


def inverse(e: DataFrame, npoints: int = 500, nharm: int | None = None) -> DataFrame:
    """Outlines (id, xs, ys) of the series' first harmonics at equally spaced places."""
    k = "coefs" if nharm is None else f"slice(coefs, 1, {nharm})"
    at = f"(i * 2D * pi() / {npoints})"
    of = lambda base, p, q: F.expr(f"transform(sequence(0, {npoints - 1}), i -> {base} + aggregate({k}, 0D, (s, h) -> s + h.{p} * cos(h.n * {at}) + h.{q} * sin(h.n * {at})))")
    return e.select("id", of("a0", "a", "b").alias("xs"), of("c0", "c", "d").alias("ys"))


def power(e: DataFrame, first: bool = True) -> DataFrame:
    """(id, n, power, cum): power of each harmonic and its cumulative share."""
    skip = "" if first else "filter(coefs, h -> h.n > 1)"
    kept = skip or "coefs"
    rows = F.expr(f"transform({kept}, h -> named_struct('n', h.n, 'power', (h.a * h.a + h.b * h.b + h.c * h.c + h.d * h.d) / 2D))")
    out = e.select("id", rows.alias("p")).withColumn("total", F.aggregate("p", F.lit(0.0), lambda s, x: s + x["power"]))
    out = out.select("id", "total", F.expr("transform(p, (x, i) -> named_struct('n', x.n, 'power', x.power, 'upto', aggregate(slice(p, 1, i + 1), 0D, (s, y) -> s + y.power)))").alias("p"))
    return out.select("id", "total", F.explode("p").alias("p")).select("id", "p.n", "p.power", F.try_divide("p.upto", "total").alias("cum"))


def min_harmonics(e: DataFrame, thresholds: tuple[float, ...] = (0.8, 0.85, 0.9, 0.95, 0.99, 0.999), first: bool = True) -> DataFrame:
    """(id, thresh, n): fewest harmonics whose cumulative power reaches each threshold."""
    p = power(e, first).crossJoin(F.broadcast(e.sparkSession.createDataFrame([(t,) for t in thresholds], "thresh double")))  # a handful of thresholds
    return p.where("cum >= thresh").groupBy("id", "thresh").agg(F.min("n").alias("n"))


def normalise(e: DataFrame) -> DataFrame:
    """(id, size, theta, psi, n, A, B, C, D): coefficients freed of size, rotation and starting point by the first ellipse."""
    f = lambda c: F.expr(f"coefs[0].{c}")
    a, b, c, d = (f(x) for x in "abcd")
    theta = F.atan2((a * b + c * d) * 2.0, a * a + c * c - b * b - d * d) / 2.0
    theta = F.when(theta < 0, theta + TWO_PI / 2).otherwise(theta)
    r = e.withColumn("theta", theta)
    phase = F.col("theta")
    astar, cstar = a * F.cos(phase) + b * F.sin(phase), c * F.cos(phase) + d * F.sin(phase)
    r = r.withColumns({"__a": astar, "__c": cstar})
    r = r.withColumns({"psi": F.atan2("__c", "__a"), "size": F.sqrt(F.col("__a") * F.col("__a") + F.col("__c") * F.col("__c"))})
    long = r.select("id", "size", "theta", "psi", F.explode("coefs").alias("k")).select("id", "size", "theta", "psi", "k.*")
    turn, back = F.col("n") * F.col("theta"), F.col("psi")
    a2, b2 = F.col("a") * F.cos(turn) + F.col("b") * F.sin(turn), F.col("b") * F.cos(turn) - F.col("a") * F.sin(turn)
    c2, d2 = F.col("c") * F.cos(turn) + F.col("d") * F.sin(turn), F.col("d") * F.cos(turn) - F.col("c") * F.sin(turn)
    size = F.col("size")
    return long.select("id", "size", "theta", "psi", "n", F.try_divide(F.cos(back) * a2 + F.sin(back) * c2, size).alias("A"), F.try_divide(F.cos(back) * b2 + F.sin(back) * d2, size).alias("B"), F.try_divide(F.cos(back) * c2 - F.sin(back) * a2, size).alias("C"), F.try_divide(F.cos(back) * d2 - F.sin(back) * b2, size).alias("D"))


def error(r: DataFrame, nharm: int, npoints: int = 100) -> DataFrame:
    """(id, avg_dev, max_dev, min_dev): distance of each vertex to the nearest point of the outline rebuilt from nharm
    harmonics (in Arrow batches, rings of equal numbers of vertices together, point by point)."""
    back = efourier(r, nharm).select(F.col("id").alias("__id"), "a0", "c0", *[F.col(f"coefs.{c}").alias(c) for c in "abcd"])
    both = r.join(back, F.col("id") == F.col("__id")).select("id", "xs", "ys", "a0", "c0", *"abcd")
    angle = np.arange(1, nharm + 1)[:, None] * (np.arange(npoints) * TWO_PI / npoints)
    cos, sin = np.cos(angle), np.sin(angle)

    def run(batches):
        for batch in batches:
            flat = [batch.column(k).flatten() for k in ("xs", "ys")]
            x, y = (v.to_numpy(zero_copy_only=False) for v in flat)
            gone = np.logical_or(*(v.is_null().to_numpy(zero_copy_only=False) for v in flat))
            a0, c0 = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("a0", "c0"))
            a, b, c, d = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, nharm) for k in "abcd")
            out, none = np.zeros((3, len(batch))), np.ones((3, len(batch)), bool)
            for rows, places in polygon.by_length(batch.column("xs")):
                if not places.shape[1]:
                    continue
                vx, vy, lost = x[places], y[places], gone[places]
                near = np.full(vx.shape, np.inf)
                for k in range(npoints):
                    px, py = a0[rows] + a[rows] @ cos[:, k] + b[rows] @ sin[:, k], c0[rows] + c[rows] @ cos[:, k] + d[rows] @ sin[:, k]
                    near = np.fmin(near, (vx - px[:, None]) ** 2 + (vy - py[:, None]) ** 2)
                near = np.sqrt(near)
                out[:, rows] = near.sum(1) / near.shape[1], np.where(lost, -np.inf, near).max(1), np.where(lost, np.inf, near).min(1)
                none[:, rows] = lost.any(1), lost.all(1), lost.all(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(v, mask=m) for v, m in zip(out, none, strict=True)]], ["id", "avg_dev", "max_dev", "min_dev"])

    return both.mapInArrow(run, f"id {both.schema['id'].dataType.simpleString()}, avg_dev double, max_dev double, min_dev double")


def landmarks_dist(r: DataFrame) -> DataFrame:
    """(id, i, j, dist) for i < j."""
    pairs = F.expr("flatten(transform(sequence(1, size(xs)), i -> transform(filter(sequence(1, size(xs)), j -> j > i), j -> named_struct('i', i, 'j', j, 'dist', sqrt(power(xs[i - 1] - xs[j - 1], 2D) + power(ys[i - 1] - ys[j - 1], 2D))))))")
    return r.select("id", F.explode(pairs).alias("p")).select("id", "p.*")


def landmarks_angle(r: DataFrame, degrees: bool = False) -> DataFrame:
    """(id, i, j, angle) of the vectors from the origin to landmarks i < j; null for a landmark at the origin."""
    dot, cross = "xs[i - 1] * xs[j - 1] + ys[i - 1] * ys[j - 1]", "abs(xs[i - 1] * ys[j - 1] - ys[i - 1] * xs[j - 1])"
    some = "(xs[i - 1] != 0 or ys[i - 1] != 0) and (xs[j - 1] != 0 or ys[j - 1] != 0)"
    pairs = F.expr(f"flatten(transform(sequence(1, size(xs)), i -> transform(filter(sequence(1, size(xs)), j -> j > i), j -> named_struct('i', i, 'j', j, 'a', if({some}, atan2({cross}, {dot}), null)))))")
    angle = F.col("p.a")
    return r.select("id", F.explode(pairs).alias("p")).select("id", "p.i", "p.j", (F.degrees(angle) if degrees else angle).alias("angle"))


def landmarks_add(r: DataFrame, times: int = 1) -> DataFrame:
    """Midpoints put between consecutive vertices, ``times`` times."""
    for _ in range(times):
        r = r.withColumns({c: F.expr(f"concat(flatten(transform(sequence(1, size({c}) - 1), k -> array({c}[k - 1], ({c}[k - 1] + {c}[k]) / 2D))), slice({c}, size({c}), 1))") for c in polygon.ARRAYS})
    return r


def landmarks_regradi(r: DataFrame, n: int = 50) -> DataFrame:
    """(id, k, seq): for each of n equally spaced directions from the vertex mean, the vertex that lies nearest to it."""
    mean = lambda a: F.expr(f"aggregate({a}, 0D, (s, x) -> s + x) / size({a})")
    r = r.withColumns({"mx": mean("xs"), "my": mean("ys")})
    pick = F.expr(f"transform(sequence(0, {n - 1}), k -> named_struct('k', k + 1, 'best', array_max(transform(sequence(1, size(xs)), i -> named_struct('cos', round(try_divide((xs[i - 1] - mx) * cos(2 * pi() * k / {n}) + (ys[i - 1] - my) * sin(2 * pi() * k / {n}), sqrt(power(xs[i - 1] - mx, 2D) + power(ys[i - 1] - my, 2D))), 9), 'at', -i)))))")
    return r.select("id", F.explode(pick).alias("p")).select("id", "p.k", (-F.col("p.best.at")).alias("seq"))


def ellipse(points: DataFrame, by: list[str], x: str = "x", y: str = "y", conf: float = 0.95, np_: int = 100) -> DataFrame:
    """(by..., k, x, y): confidence ellipse of a group's points (chi-square with two degrees of freedom)."""
    from math import log, sqrt

    t = sqrt(-2 * log(1 - conf))
    g = points.groupBy(*by).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.stddev_samp(x).alias("sx"), F.stddev_samp(y).alias("sy"), F.covar_samp(x, y).alias("cxy"))
    g = g.withColumn("rho", F.try_divide(F.col("cxy"), F.col("sx") * F.col("sy")))
    d = F.acos(F.least(F.greatest("rho", F.lit(-1.0)), F.lit(1.0)))
    g = g.withColumn("d", d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(np_ - 1))))
    a = F.col("k") * (TWO_PI / (np_ - 1))
    return g.select(*by, "k", (F.col("mx") + F.col("sx") * t * F.cos(a + F.col("d") / 2.0)).alias("x"), (F.col("my") + F.col("sy") * t * F.cos(a - F.col("d") / 2.0)).alias("y"))


def random_shapes(spark, n: int, harmonics: int = 4, vertices: int = 60, seed: int = 0) -> DataFrame:
    """(id, xs, ys): n outlines from random Fourier coefficients whose size falls with the square of the harmonic; the same
    seed gives the same shapes."""
    def noise(k, tag):
        return F.pmod(F.xxhash64(F.col("id"), F.lit(k), F.lit(f"{tag}{seed}")), F.lit(2**32)) / float(2**31) - 1.0

    turn = F.sequence(F.lit(0), F.lit(vertices - 1))
    wave = lambda a, b: lambda i: sum((noise(k, a) * F.cos(i * (2 * 3.141592653589793 * k / vertices)) + noise(k, b) * F.sin(i * (2 * 3.141592653589793 * k / vertices))) / float(k * k) for k in range(2, harmonics + 1))
    first = lambda f: lambda i: f(i * (2 * 3.141592653589793 / vertices)) * 3.0
    x, y = wave("a", "b"), wave("c", "d")
    return spark.range(n).select("id", F.transform(turn, lambda i: first(F.cos)(i) + x(i)).alias("xs"), F.transform(turn, lambda i: first(F.sin)(i) + y(i)).alias("ys"))


def symmetric(pairs: DataFrame, value: str = "dist") -> DataFrame:
    """(id, i, j, value) of i < j -> all of the symmetric matrix, its zero diagonal too."""
    other = pairs.select("id", F.col("j").alias("i"), F.col("i").alias("j"), value)
    both = pairs.select("id", "i", "j", value).unionByName(other)
    return both.unionByName(both.select("id", "i").distinct().select("id", "i", F.col("i").alias("j"), F.lit(0.0).alias(value)))
