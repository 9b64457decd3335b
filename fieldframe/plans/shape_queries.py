"""Queries over outlines, plots, points and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldframe.operators import outline, polygon, raster, severity, spatial, stats, tile
from fieldframe.sources import tables
from fieldframe.sources.tables import OUTLINES_SQL, POINTS_SQL, TILES_SQL

from .common import rounded, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name, run, columns=None, body=None):
    QUERIES[name] = lambda spark, d: rounded(run(spark, d))
    if body is not None:
        SQL[name] = sql(columns, body)


rings = lambda s, d: polygon.rings(tables.outlines(s, d))
V = f"""SELECT *, lead(x) OVER w AS xn, lead(y) OVER w AS yn, coalesce(lead(x) OVER w, first(x) OVER w) AS xc, coalesce(lead(y) OVER w, first(y) OVER w) AS yc, count(*) OVER (PARTITION BY id) AS n,
  avg(x) OVER (PARTITION BY id) AS mx, avg(y) OVER (PARTITION BY id) AS my FROM ({OUTLINES_SQL}) WINDOW w AS (PARTITION BY id ORDER BY seq)"""
G = f"""SELECT id, abs(sum(x * yc - xc * y)) / 2 AS area, sum(sqrt(pow(xn - x, 2) + pow(yn - y, 2))) AS perimeter, sum((x + xc) * (x * yc - xc * y)) / nullif(sum(x * yc - xc * y) * 3, 0) AS cx, sum((y + yc) * (x * yc - xc * y)) / nullif(sum(x * yc - xc * y) * 3, 0) AS cy,
  avg(sqrt(pow(x - mx, 2) + pow(y - my, 2))) AS rmean, min(sqrt(pow(x - mx, 2) + pow(y - my, 2))) AS rmin, max(sqrt(pow(x - mx, 2) + pow(y - my, 2))) AS rmax, stddev_samp(sqrt(pow(x - mx, 2) + pow(y - my, 2))) AS rsd,
  avg(pow(x - mx, 2)) AS vx, avg(pow(y - my, 2)) AS vy, avg((x - mx) * (y - my)) AS c, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM ({V}) GROUP BY id"""
FLAT = "CASE WHEN area > perimeter * perimeter * 1e-7::DOUBLE THEN area END"
M = f"""SELECT *, atan2(2 * c, vx - vy) / 2 AS theta, (vx + vy + root) / 2 AS big, greatest((vx + vy - root) / 2, 0) AS small FROM (SELECT *, sqrt(pow(vx - vy, 2) + 4 * c * c) AS root FROM ({G}))"""
L = f"""SELECT id, max(x * cos(theta) + y * sin(theta)) - min(x * cos(theta) + y * sin(theta)) AS length, max(y * cos(theta) - x * sin(theta)) - min(y * cos(theta) - x * sin(theta)) AS width FROM ({OUTLINES_SQL}) JOIN (SELECT id, theta FROM ({M})) USING (id) GROUP BY id"""

add("outlines_from_lineitem", tables.outlines, "id seq | x y", OUTLINES_SQL)
add("poly_area", lambda s, d: rings(s, d).select("id", polygon.area().alias("area")), "id | area", G)
add("poly_perimeter", lambda s, d: rings(s, d).select("id", polygon.perimeter().alias("perimeter")), "id | perimeter", G)
add("poly_distpts", lambda s, d: rings(s, d).select("id", F.posexplode(polygon.distances()).alias("pos", "d")).select("id", (F.col("pos") + 1).alias("seq"), "d"), "id seq | d", f"SELECT id, seq, sqrt(pow(xn - x, 2) + pow(yn - y, 2)) AS d FROM ({V}) WHERE xn IS NOT NULL")
add("poly_mass", lambda s, d: rings(s, d).select("id", polygon.mass()[0].alias("cx"), polygon.mass()[1].alias("cy")), "id | cx cy", f"SELECT id, CASE WHEN {FLAT} IS NOT NULL THEN cx END AS cx, CASE WHEN {FLAT} IS NOT NULL THEN cy END AS cy FROM ({G})")
add("poly_moments", lambda s, d: polygon.axes(rings(s, d)).select("id", "major_axis", "minor_axis", "eccentricity", "theta"), "id | major_axis minor_axis eccentricity theta", f"SELECT id, sqrt(big) AS major_axis, sqrt(small) AS minor_axis, sqrt(1 - small / nullif(big, 0)) AS eccentricity, theta FROM ({M})")
add("poly_lw", lambda s, d: polygon.axes(rings(s, d)).select("id", "length", "width"), "id | length width", L)
add("poly_eccentricity", lambda s, d: polygon.axes(rings(s, d)).select("id", "eigen_ratio"), "id | eigen_ratio", f"SELECT id, small / nullif(big, 0) AS eigen_ratio FROM ({M})")
add("poly_elongation", lambda s, d: polygon.axes(rings(s, d)).select("id", "elongation"), "id | elongation", f"SELECT id, 1 - width / nullif(length, 0) AS elongation FROM ({L})")
add("poly_circularity3", lambda s, d: polygon.measures(rings(s, d)).select("id", "circularity", "circularity_norm", "circularity_haralick", "form_factor"), "id | circularity circularity_norm circularity_haralick form_factor",
    f"SELECT id, perimeter * perimeter / real_area AS circularity, 4 * pi() * real_area / nullif(perimeter * perimeter, 0) AS circularity_norm, rmean / nullif(rsd, 0) AS circularity_haralick, 4 * pi() * real_area / nullif(perimeter * perimeter, 0) AS form_factor FROM (SELECT *, {FLAT} AS real_area FROM ({G}))")
add("poly_centdist", lambda s, d: rings(s, d).select("id", F.posexplode(polygon.centre_distances()).alias("pos", "d")).select("id", (F.col("pos") + 1).alias("seq"), "d"), "id seq | d", f"SELECT id, seq, sqrt(pow(x - mx, 2) + pow(y - my, 2)) AS d FROM ({V})")
add("poly_centdist_mass", lambda s, d: rings(s, d).select("id", F.posexplode(polygon.centre_distances(True)).alias("pos", "d")).select("id", (F.col("pos") + 1).alias("seq"), "d"), "id seq | d", f"SELECT id, seq, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS d FROM ({OUTLINES_SQL}) JOIN (SELECT id, CASE WHEN {FLAT} IS NOT NULL THEN cx END AS cx, CASE WHEN {FLAT} IS NOT NULL THEN cy END AS cy FROM ({G})) USING (id)")
add("poly_radius", lambda s, d: polygon.radius_stats(rings(s, d)).select("id", "radius_mean", "radius_min", "radius_max", "radius_sd", "diam_mean", "diam_min", "diam_max", "radius_ratio"), "id | radius_mean radius_min radius_max radius_sd diam_mean diam_min diam_max radius_ratio", f"SELECT id, rmean AS radius_mean, rmin AS radius_min, rmax AS radius_max, rsd AS radius_sd, 2 * rmean AS diam_mean, 2 * rmin AS diam_min, 2 * rmax AS diam_max, rmax / nullif(rmin, 0) AS radius_ratio FROM ({G})")
CAL = f"SELECT a.id, sqrt(max(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS caliper FROM ({OUTLINES_SQL}) a JOIN ({OUTLINES_SQL}) b ON a.id = b.id GROUP BY a.id"
add("poly_caliper", lambda s, d: rings(s, d).select("id", polygon.caliper().alias("caliper")), "id | caliper", CAL)
add("poly_ratios", lambda s, d: polygon.measures(rings(s, d)).select("id", "narrow_factor", "asp_ratio", "rectangularity", "pd_ratio", "plw_ratio"), "id | narrow_factor asp_ratio rectangularity pd_ratio plw_ratio",
    f"SELECT id, caliper / nullif(length, 0) AS narrow_factor, length / nullif(width, 0) AS asp_ratio, length * width / ({FLAT}) AS rectangularity, perimeter / nullif(caliper, 0) AS pd_ratio, perimeter / nullif(length + width, 0) AS plw_ratio FROM ({G}) JOIN ({L}) USING (id) JOIN ({CAL}) USING (id)")
add("poly_limits", lambda s, d: rings(s, d).select("id", F.array_min("xs").alias("xmin"), F.array_max("xs").alias("xmax"), F.array_min("ys").alias("ymin"), F.array_max("ys").alias("ymax")), "id | xmin xmax ymin ymax", G)
CYC = f"SELECT *, coalesce(lag(x) OVER w, last(x) OVER z) AS xb, coalesce(lag(y) OVER w, last(y) OVER z) AS yb FROM ({V}) WINDOW w AS (PARTITION BY id ORDER BY seq), z AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
add("poly_angles", lambda s, d: polygon.vertices(rings(s, d).withColumn("xs", polygon.angles())).select("id", "seq", F.col("x").alias("angle")), "id seq | angle",
    f"SELECT id, seq, CASE WHEN (xb <> x OR yb <> y) AND (xc <> x OR yc <> y) THEN degrees(atan2(abs((xb - x) * (yc - y) - (yb - y) * (xc - x)), (xb - x) * (xc - x) + (yb - y) * (yc - y))) END AS angle FROM ({CYC})")
add("poly_rotate", lambda s, d: polygon.vertices(polygon.rotate(rings(s, d), 30)), "id seq | x y", f"SELECT id, seq, x * cos(radians(30)) - y * sin(radians(30)) AS x, x * sin(radians(30)) + y * cos(radians(30)) AS y FROM ({OUTLINES_SQL})")
add("poly_align", lambda s, d: polygon.vertices(polygon.align(rings(s, d))), "id seq | x y", f"SELECT id, seq, x * cos(theta) + y * sin(theta) AS x, y * cos(theta) - x * sin(theta) AS y FROM ({OUTLINES_SQL}) JOIN (SELECT id, theta FROM ({M})) USING (id)")
add("poly_center", lambda s, d: polygon.vertices(polygon.centre(rings(s, d))), "id seq | x y", f"SELECT id, seq, x - mx AS x, y - my AS y FROM ({V})")
add("poly_flip", lambda s, d: polygon.vertices(polygon.flip(polygon.flip(rings(s, d), "x"), "y")), "id seq | x y", f"SELECT id, seq, -x AS x, -y AS y FROM ({OUTLINES_SQL})")
add("poly_slide", lambda s, d: polygon.vertices(polygon.slide(rings(s, d), 2)), "id seq | x y", f"SELECT id, (CASE WHEN seq = 1 THEN n ELSE seq - 1 END)::INT AS seq, x, y FROM ({V})")
add("poly_close", lambda s, d: polygon.vertices(polygon.close(rings(s, d))), "id seq | x y", f"SELECT id, seq, x, y FROM ({OUTLINES_SQL}) UNION ALL SELECT a.id, (n + 1)::INT, a.x, a.y FROM ({V}) a JOIN (SELECT id, x AS lx, y AS ly FROM ({V}) WHERE seq = n) b ON a.id = b.id WHERE seq = 1 AND NOT (a.x = lx AND a.y = ly)")
add("poly_is_closed", lambda s, d: rings(s, d).select("id", polygon.is_closed().alias("closed")), "id closed", f"SELECT id, first(x ORDER BY seq) = last(x ORDER BY seq) AND first(y ORDER BY seq) = last(y ORDER BY seq) AS closed FROM ({OUTLINES_SQL}) GROUP BY id")
add("poly_unclose", lambda s, d: polygon.vertices(polygon.unclose(polygon.close(rings(s, d)))), "id seq | x y", f"SELECT a.id, a.seq, a.x, a.y FROM ({V}) a JOIN (SELECT id, first(x ORDER BY seq) = last(x ORDER BY seq) AND first(y ORDER BY seq) = last(y ORDER BY seq) AS shut FROM ({OUTLINES_SQL}) GROUP BY id) b ON a.id = b.id WHERE NOT (shut AND seq = n)")
add("poly_sample", lambda s, d: polygon.vertices(polygon.sample(rings(s, d), 4)), "id seq | x y", f"SELECT id, (k + 1)::INT AS seq, x, y FROM ({V}), unnest(range(0, 4)) AS u(k) WHERE n >= 4 AND seq = floor(k * ((n - 1) / 3::DOUBLE) + 0.5) + 1")
add("poly_smooth1", lambda s, d: polygon.vertices(polygon.smooth(rings(s, d), 1)), "id seq | x y", f"SELECT id, seq, (xb + x + xc) / 3 AS x, (yb + y + yc) / 3 AS y FROM ({CYC})")
add("poly_pcv", lambda s, d: polygon.pcv(rings(s, d), 1).select("id", "pcv"), "id | pcv", f"SELECT id, sum(e) * stddev_samp(e) / nullif(any_value(perimeter), 0) AS pcv FROM (SELECT id, sqrt(pow((xb + x + xc) / 3 - x, 2) + pow((yb + y + yc) / 3 - y, 2)) AS e FROM ({CYC})) JOIN (SELECT id, perimeter FROM ({G})) USING (id) GROUP BY id")
add("poly_pcv_100", lambda s, d: polygon.pcv(rings(s, d), 100).select("id", "pcv"))
add("conv_hull", lambda s, d: polygon.hull_measures(rings(s, d)))
add("poly_shapes", lambda s, d: polygon.measures(polygon.circle(s, 2.0, 1000).union(polygon.n_gon(s, 6)).union(polygon.rectangle(s)).union(polygon.square(s)).union(polygon.triangle_right(s)).union(polygon.triangle_equilateral(s))).select("id", "area", "perimeter"), "id | area perimeter",
    "SELECT * FROM (VALUES ('circle_1000', 999 * 4 * sin(2 * pi() / 999) / 2, 999 * 4 * sin(pi() / 999)), ('gon_6', 3 * sin(pi() / 3), 5.0::DOUBLE), ('rectangle', 6.0::DOUBLE, 7.0::DOUBLE), ('square', 4.0::DOUBLE, 6.0::DOUBLE), ('triangle_right', 1.0::DOUBLE, 1 + sqrt(5)), ('triangle_equilateral', sqrt(3), 4.0::DOUBLE)) AS t(id, area, perimeter)")

# Outlines.
ED = f"SELECT id, seq, x - xb AS dx, y - yb AS dy, x, y, greatest(sqrt(pow(x - xb, 2) + pow(y - yb, 2)), 1e-10) AS dt FROM ({CYC})"
ET = f"SELECT *, sum(dt) OVER (PARTITION BY id ORDER BY seq) AS t, sum(dt) OVER (PARTITION BY id) AS tt FROM ({ED})"
EF = f"""SELECT id, n::INT AS n, any_value(tt) / (2 * n * n * pi() * pi()) * sum(dx / dt * (cos(2 * n * pi() * t / tt) - cos(2 * n * pi() * (t - dt) / tt))) AS a, any_value(tt) / (2 * n * n * pi() * pi()) * sum(dx / dt * (sin(2 * n * pi() * t / tt) - sin(2 * n * pi() * (t - dt) / tt))) AS b,
  any_value(tt) / (2 * n * n * pi() * pi()) * sum(dy / dt * (cos(2 * n * pi() * t / tt) - cos(2 * n * pi() * (t - dt) / tt))) AS c, any_value(tt) / (2 * n * n * pi() * pi()) * sum(dy / dt * (sin(2 * n * pi() * t / tt) - sin(2 * n * pi() * (t - dt) / tt))) AS d
  FROM ({ET}), unnest(range(1, 4)) AS u(n) GROUP BY id, n"""
ef = lambda s, d: outline.efourier(rings(s, d), 3)
add("efourier", lambda s, d: outline.coefficients(ef(s, d)), "id n | a b c d", EF)
add("efourier_centre", lambda s, d: ef(s, d).select("id", "a0", "c0"), "id | a0 c0", f"SELECT id, sum(x * dt) / any_value(tt) AS a0, sum(y * dt) / any_value(tt) AS c0 FROM ({ET}) GROUP BY id")
add("efourier_coefs_wide", lambda s, d: outline.wide(ef(s, d), 2), "id | A1 A2 B1 B2 C1 C2 D1 D2", f"SELECT id, {', '.join(f'max({c}) FILTER (n = {k}) AS {c.upper()}{k}' for c in 'abcd' for k in (1, 2))} FROM ({EF}) GROUP BY id")
POWER = f"SELECT id, n, (a * a + b * b + c * c + d * d) / 2 AS power FROM ({EF})"
CUM = f"SELECT id, n, power, sum(power) OVER (PARTITION BY id ORDER BY n) / nullif(sum(power) OVER (PARTITION BY id), 0) AS cum FROM ({POWER})"
add("efourier_power", lambda s, d: outline.power(ef(s, d)), "id n | power cum", CUM)
add("efourier_min_harmonics", lambda s, d: outline.min_harmonics(ef(s, d), (0.8, 0.9)), "id n | thresh", f"SELECT id, thresh, min(n) AS n FROM ({CUM}), unnest([0.8::DOUBLE, 0.9::DOUBLE]) AS u(thresh) WHERE cum >= thresh GROUP BY id, thresh")
add("efourier_inv", lambda s, d: polygon.vertices(outline.inverse(ef(s, d), 12)), "id seq | x y", f"SELECT id, (i + 1)::INT AS seq, any_value(a0) + sum(a * cos(n * i * 2 * pi() / 12) + b * sin(n * i * 2 * pi() / 12)) AS x, any_value(c0) + sum(c * cos(n * i * 2 * pi() / 12) + d * sin(n * i * 2 * pi() / 12)) AS y FROM ({EF}) JOIN (SELECT id, sum(x * dt) / any_value(tt) AS a0, sum(y * dt) / any_value(tt) AS c0 FROM ({ET}) GROUP BY id) USING (id), unnest(range(0, 12)) AS u(i) GROUP BY id, i")
add("efourier_norm", lambda s, d: outline.normalise(ef(s, d)))
add("efourier_error", lambda s, d: outline.error(rings(s, d), 3, 60))
add("landmarks_dist", lambda s, d: outline.landmarks_dist(rings(s, d)), "id i j | dist", f"SELECT a.id, a.seq AS i, b.seq AS j, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM ({OUTLINES_SQL}) a JOIN ({OUTLINES_SQL}) b ON a.id = b.id AND a.seq < b.seq")
add("landmarks_angle", lambda s, d: outline.landmarks_angle(rings(s, d), True), "id i j | angle", f"SELECT a.id, a.seq AS i, b.seq AS j, CASE WHEN (a.x <> 0 OR a.y <> 0) AND (b.x <> 0 OR b.y <> 0) THEN degrees(atan2(abs(a.x * b.y - a.y * b.x), a.x * b.x + a.y * b.y)) END AS angle FROM ({OUTLINES_SQL}) a JOIN ({OUTLINES_SQL}) b ON a.id = b.id AND a.seq < b.seq")
add("landmarks_add", lambda s, d: polygon.vertices(outline.landmarks_add(rings(s, d))), "id seq | x y", f"SELECT id, (2 * seq - 1)::INT AS seq, x, y FROM ({V}) UNION ALL SELECT id, (2 * seq)::INT, (x + xn) / 2, (y + yn) / 2 FROM ({V}) WHERE xn IS NOT NULL")
add("landmarks_regradi", lambda s, d: outline.landmarks_regradi(rings(s, d), 6))
EL = f"SELECT kind, avg(x) AS mx, avg(y) AS my, stddev_samp(x) AS sx, stddev_samp(y) AS sy, acos(covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y))) AS d FROM ({POINTS_SQL}) GROUP BY kind"
add("ellipse", lambda s, d: outline.ellipse(tables.points(s, d), ["kind"], np_=20), "kind k | x y", f"SELECT kind, k::INT AS k, mx + sx * sqrt(-2 * ln(1 - 0.95::DOUBLE)) * cos(k * 2 * pi() / 19 + d / 2) AS x, my + sy * sqrt(-2 * ln(1 - 0.95::DOUBLE)) * cos(k * 2 * pi() / 19 - d / 2) AS y FROM ({EL}), unnest(range(0, 20)) AS u(k)")

# Plots and spatial joins: a field of 24 hours by 500 units.
NROW, NCOL = 5, 6
grid = lambda s, bx=0.0, by=0.0: spatial.grid(s, 0.0, 24.0, 0.0, 500.0, NROW, NCOL, bx, by)
plots = lambda s: grid(s).withColumn("id", (F.col("row") - 1) * NCOL + F.col("col"))
boxes = lambda s: grid(s, 0.1, 0.1).withColumn("id", (F.col("row") - 1) * NCOL + F.col("col"))


def grid_sql(bx=0.0, by=0.0):
    return f"""SELECT r::INT AS row, c::INT AS col, ((r - 1) * {NCOL} + c)::INT AS id, (c - 1) * 4.0::DOUBLE + 4 * {bx}::DOUBLE AS xmin, (c - 1) * 4.0::DOUBLE + 4 * (1 - {bx}::DOUBLE) AS xmax, 500 - (r - 1) * 100.0::DOUBLE - 100 * (1 - {by}::DOUBLE) AS ymin, 500 - (r - 1) * 100.0::DOUBLE - 100 * {by}::DOUBLE AS ymax
      FROM unnest(range(1, {NROW + 1})) AS u(r), unnest(range(1, {NCOL + 1})) AS w(c)"""


add("grid_rect", lambda s, d: grid(s, 0.1, 0.2), "row col | xmin xmax ymin ymax", grid_sql(0.1, 0.2))
add("image_grid_cells", lambda s, d: spatial.grid(s, 0, 8, 0, 8, 2, 4), "row col | xmin xmax ymin ymax", "SELECT r::INT AS row, c::INT AS col, (c - 1) * 2.0::DOUBLE AS xmin, c * 2.0::DOUBLE AS xmax, 8 - r * 4.0::DOUBLE AS ymin, 12 - r * 4.0::DOUBLE AS ymax FROM unnest([1, 2]) AS u(r), unnest([1, 2, 3, 4]) AS w(c)")


def layouts(s):
    df = grid(s).select("row", "col")
    both = [(layout, snake) for layout in spatial.LAYOUTS for snake in (False, True)]
    cell = F.explode(F.array(*[F.struct(F.lit(lay).alias("layout"), F.lit(sn).alias("serpentine"), spatial.plot_name(spatial.plot_number(F.col("row"), F.col("col"), NROW, NCOL, lay, sn)).alias("plot")) for lay, sn in both]))
    return df.select("row", "col", cell.alias("p")).select("row", "col", "p.*")


add("plot_layout_16", lambda s, d: layouts(s), "row col layout serpentine plot", f"""SELECT r::INT AS row, c::INT AS col, layout, serpentine, 'P' || lpad((CASE WHEN down THEN cc * {NROW} + CASE WHEN serpentine AND cc % 2 = 1 THEN {NROW - 1} - rr ELSE rr END ELSE rr * {NCOL} + CASE WHEN serpentine AND rr % 2 = 1 THEN {NCOL - 1} - cc ELSE cc END END + 1)::INT::VARCHAR, 4, '0') AS plot
  FROM (SELECT *, left(layout, 2) IN ('tb', 'bt') AS down, CASE WHEN contains(layout, 'bt') THEN {NROW} - r ELSE r - 1 END AS rr, CASE WHEN contains(layout, 'rl') THEN {NCOL} - c ELSE c - 1 END AS cc FROM unnest(range(1, {NROW + 1})) AS u(r), unnest(range(1, {NCOL + 1})) AS w(c), unnest({list(spatial.LAYOUTS)}) AS l(layout), unnest([false, true]) AS z(serpentine))""")
IN = "p.x >= b.xmin AND p.x < b.xmax AND p.y >= b.ymin AND p.y < b.ymax"
B9 = grid_sql(0.1, 0.1)
add("pip_assign_centroid", lambda s, d: spatial.contains(tables.points(s, d), boxes(s), 4.0, 100.0, ["row", "col"]).select("id", "row", "col"), "id row col", f"SELECT p.id, b.row, b.col FROM ({POINTS_SQL}) p JOIN ({B9}) b ON {IN}")
add("zonal_stats", lambda s, d: spatial.zonal(tables.points(s, d), boxes(s), "y", 4.0, 100.0, ["row", "col"], (0.05, 0.95)), "row col n | mean median sd min max q5 q95", f"SELECT b.row, b.col, count(p.y) AS n, avg(p.y) AS mean, median(p.y) AS median, stddev_samp(p.y) AS sd, min(p.y) AS min, max(p.y) AS max, quantile_cont(p.y, 0.05) AS q5, quantile_cont(p.y, 0.95) AS q95 FROM ({POINTS_SQL}) p JOIN ({B9}) b ON {IN} GROUP BY b.row, b.col")
add("zonal_coverage", lambda s, d: spatial.contains(tables.points(s, d), boxes(s), 4.0, 100.0, ["row", "col"]).groupBy("row", "col").agg((F.count_if(F.col("kind") == "click") / F.count("*")).alias("coverage")), "row col | coverage", f"SELECT b.row, b.col, count(*) FILTER (p.kind = 'click') / count(*)::DOUBLE AS coverage FROM ({POINTS_SQL}) p JOIN ({B9}) b ON {IN} GROUP BY b.row, b.col")
add("plot_summary", lambda s, d: spatial.contains(tables.points(s, d), plots(s), 4.0, 100.0, ["row", "col"]).groupBy("row", "col").agg(F.count("*").alias("n"), F.sum("y").alias("area_sum"), F.avg("x").alias("x"), (F.sum("y") / 400.0).alias("coverage")), "row col n | area_sum x coverage", f"SELECT b.row, b.col, count(*) AS n, sum(p.y) AS area_sum, avg(p.x) AS x, sum(p.y) / 400 AS coverage FROM ({POINTS_SQL}) p JOIN ({grid_sql()}) b ON {IN} GROUP BY b.row, b.col")
add("plot_left_joins", lambda s, d: plots(s).select("row", "col").join(spatial.contains(tables.points(s, d), plots(s), 4.0, 100.0, ["row", "col"]).groupBy("row", "col").agg(F.count("*").alias("n")), ["row", "col"], "left"), "row col n", f"SELECT g.row, g.col, n FROM ({grid_sql()}) g LEFT JOIN (SELECT b.row, b.col, count(*) AS n FROM ({POINTS_SQL}) p JOIN ({grid_sql()}) b ON {IN} GROUP BY b.row, b.col) USING (row, col)")
# Boxes of orders' outlines against plots.
ob = lambda s, d: rings(s, d).select("id", F.array_min("xs").alias("xmin"), F.array_max("xs").alias("xmax"), F.array_min("ys").alias("ymin"), F.array_max("ys").alias("ymax"))
OB = f"SELECT id, xmin, xmax, ymin, ymax FROM ({G})"
pl = lambda s: spatial.grid(s, 0, 60, 0, 110, 3, 3).withColumn("id", ((F.col("row") - 1) * 3 + F.col("col")).cast("long"))
PL = "SELECT ((r - 1) * 3 + c)::BIGINT AS id, (c - 1) * 20.0::DOUBLE AS xmin, (c - 1) * 20.0::DOUBLE + 20 AS xmax, 110 - (r - 1) * (110 / 3.0::DOUBLE) - 110 / 3.0::DOUBLE AS ymin, 110 - (r - 1) * (110 / 3.0::DOUBLE) AS ymax FROM unnest([1, 2, 3]) AS u(r), unnest([1, 2, 3]) AS w(c)"
plb = lambda s: spatial.grid(s, 0, 60, 0, 110, 3, 3, 0.4, 0.45).withColumn("id", ((F.col("row") - 1) * 3 + F.col("col")).cast("long"))
PLB = "SELECT id, xmin + 20 * 0.4::DOUBLE AS xmin, xmin + 20 * (1 - 0.4::DOUBLE) AS xmax, ymax - 110 / 3.0::DOUBLE * (1 - 0.45::DOUBLE) AS ymin, ymax - 110 / 3.0::DOUBLE * 0.45::DOUBLE AS ymax FROM (" + PL + ")"
W_, O_, H_ = "(a.xmin >= b.xmin AND a.xmax <= b.xmax AND a.ymin >= b.ymin AND a.ymax <= b.ymax)", "(a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax)", "(b.xmin >= a.xmin AND b.xmax <= a.xmax AND b.ymin >= a.ymin AND b.ymax <= a.ymax)"
semi = lambda test, word="EXISTS": f"SELECT id FROM ({OB}) a WHERE {word} (SELECT 1 FROM ({PL}) b WHERE {test})"
SIZE = (20.0, 37.0)
add("within_semi", lambda s, d: spatial.within(ob(s, d), pl(s), *SIZE).select("id"), "id", semi(W_))
add("overlaps_semi", lambda s, d: spatial.overlaps(ob(s, d), pl(s), *SIZE).select("id"), "id", semi(f"{O_} AND NOT {W_} AND NOT {H_}"))
add("outside_anti", lambda s, d: spatial.outside(ob(s, d), plb(s), *SIZE).select("id"), "id", f"SELECT id FROM ({OB}) a WHERE NOT EXISTS (SELECT 1 FROM ({PLB}) b WHERE ({W_} OR {O_} AND NOT {H_}))")
add("touches_semi", lambda s, d: spatial.touches(ob(s, d), pl(s), *SIZE).select("id"), "id", semi(f"a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax AND NOT {O_}"))
add("intersection_rect", lambda s, d: spatial.intersection(ob(s, d), pl(s), *SIZE), "a_id b_id | xmin xmax ymin ymax area", f"SELECT a.id AS a_id, b.id AS b_id, greatest(a.xmin, b.xmin) AS xmin, least(a.xmax, b.xmax) AS xmax, greatest(a.ymin, b.ymin) AS ymin, least(a.ymax, b.ymax) AS ymax, (least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) AS area FROM ({OB}) a JOIN ({PL}) b ON {O_} WHERE greatest(a.xmin, b.xmin) < least(a.xmax, b.xmax) AND greatest(a.ymin, b.ymin) < least(a.ymax, b.ymax)")
add("shape_transform", lambda s, d: spatial.transform(boxes(s), 1, 2, 30, 1.5, 0.5), "id seq | x y", f"""SELECT id, seq::INT AS seq, dx * cos(radians(-30)) - dy * sin(radians(-30)) + mx + 1 AS x, dx * sin(radians(-30)) + dy * cos(radians(-30)) + my + 2 AS y FROM (SELECT id, seq, ((CASE WHEN seq IN (1, 4) THEN xmin ELSE xmax END) - mx) * 1.5::DOUBLE AS dx,
  ((CASE WHEN seq < 3 THEN ymin ELSE ymax END) - my) * 0.5::DOUBLE AS dy, mx, my FROM ({B9}), (SELECT (min(xmin) + max(xmax)) / 2 AS mx, (min(ymin) + max(ymax)) / 2 AS my FROM ({B9})), unnest([1, 2, 3, 4]) AS u(seq))""")
add("shape_measures", lambda s, d: spatial.box_measures(ob(s, d)), "id | xcoord ycoord area perimeter width height", f"SELECT id, (xmin + xmax) / 2 AS xcoord, (ymin + ymax) / 2 AS ycoord, (xmax - xmin) * (ymax - ymin) AS area, (xmax - xmin + ymax - ymin) * 2 AS perimeter, xmax - xmin AS width, ymax - ymin AS height FROM ({OB})")
add("line_on_halfplot", lambda s, d: spatial.line_on_halfplot(plots(s)), "id wkt", f"SELECT id, printf('LINESTRING (%.4f %.4f, %.4f %.4f)', (xmin + xmax) / 2, ymin, (xmin + xmax) / 2, ymax) AS wkt FROM ({grid_sql()})")
add("in_polygon", lambda s, d: spatial.in_polygon(tables.points(s, d).withColumn("y", F.col("y") / 20.0), polygon.n_gon(s, 6, 8.0).withColumns({"xs": F.transform("xs", lambda v: v + 12.0), "ys": F.transform("ys", lambda v: v + 12.0)}), 4.0).select("id", "ring_id"),
    "id ring_id", f"SELECT id, 'gon_6' AS ring_id FROM ({POINTS_SQL}) WHERE abs(y / 20 - 12) < 8 * sqrt(3) / 2 AND abs(x - 12) < 8 - abs(y / 20 - 12) / sqrt(3)")
CONTROL = [(3.0, 50.0, 1.0), (12.5, 250.0, 4.0), (20.25, 400.0, 2.5), (6.75, 450.0, 3.0)]
add("idw", lambda s, d: spatial.idw(tables.points(s, d).select("id", "x", "y"), s.createDataFrame(CONTROL, "x double, y double, z double"), "z").select("id", "value"), "id | value", f"SELECT id, sum(z / (pow(x - qx, 2) + pow(y - qy, 2))) / sum(1 / (pow(x - qx, 2) + pow(y - qy, 2))) AS value FROM ({POINTS_SQL}), (VALUES {', '.join(str(c) for c in CONTROL)}) AS q(qx, qy, z) GROUP BY id")
add("epsg_from_lonlat", lambda s, d: tables.points(s, d).select("id", spatial.epsg(F.col("x") * 15.0 - 180.0, F.col("y") - 250.0).alias("epsg")), "id epsg", f"SELECT id, (floor((x * 15.0::DOUBLE - 180 + 180) / 6) + 1 + CASE WHEN y - 250 < 0 THEN 32700 ELSE 32600 END)::INT AS epsg FROM ({POINTS_SQL})")

# Images: 8 by 8 tiles.
T = tables.tiles
tl = lambda s, d: tile.from_embeddings(tables.read(s, d, "embeddings"))
PX = "img row col | v"
add("pixels_from_tiles", T, "img label row col | v", TILES_SQL)
add("npixels_dims", lambda s, d: raster.dimensions(T(s, d)), "img width height npixels", f"SELECT img, max(col) + 1 AS width, max(row) + 1 AS height, count(*) AS npixels FROM ({TILES_SQL}) GROUP BY img")
TS = f"SELECT img, row, col, v FROM ({TILES_SQL})"
px = lambda s, d: T(s, d).drop("label")
add("image_crop", lambda s, d: raster.crop(px(s, d), (2, 5), (1, 6)), PX, f"SELECT img, row - 2 AS row, col - 1 AS col, v FROM ({TS}) WHERE row BETWEEN 2 AND 5 AND col BETWEEN 1 AND 6")
add("image_trim", lambda s, d: raster.trim(px(s, d), 8, 8, 1, 2, 1, 1), PX, f"SELECT img, row - 1 AS row, col - 1 AS col, v FROM ({TS}) WHERE row BETWEEN 1 AND 5 AND col BETWEEN 1 AND 6")
add("image_hreflect", lambda s, d: raster.reflect(px(s, d), 8, 8), PX, f"SELECT img, row, 7 - col AS col, v FROM ({TS})")
add("image_vreflect", lambda s, d: raster.reflect(px(s, d), 8, 8, False), PX, f"SELECT img, 7 - row AS row, col, v FROM ({TS})")
add("mosaic_rotate", lambda s, d: raster.rotate90(px(s, d), 8, 8, 90), PX, f"SELECT img, col AS row, 7 - row AS col, v FROM ({TS})")
add("mosaic_aggregate", lambda s, d: raster.aggregate(px(s, d), 2, ["v"]), PX, f"SELECT img, row // 2 AS row, col // 2 AS col, avg(v) AS v FROM ({TS}) GROUP BY ALL")
add("mosaic_aggregate_nearest", lambda s, d: raster.aggregate(px(s, d), 2, ["v"], "nearest"), PX, f"SELECT img, row // 2 AS row, col // 2 AS col, v FROM ({TS}) WHERE row % 2 = 0 AND col % 2 = 0")
add("mosaic_resample", lambda s, d: raster.resample_nearest(px(s, d), 8, 8, 12, 4), PX, f"SELECT img, r::INT AS row, c::INT AS col, v FROM ({TS}), unnest(range(0, 12)) AS u(r), unnest(range(0, 4)) AS w(c) WHERE row = r * 8 // 12 AND col = c * 8 // 4")
add("image_expand", lambda s, d: raster.expand(px(s, d), 8, 8, 1, "v", 0.5), PX, f"SELECT img, row + 1 AS row, col + 1 AS col, v FROM ({TS}) UNION ALL SELECT img, r::INT, c::INT, 0.5 FROM (SELECT DISTINCT img FROM ({TS})), unnest(range(0, 10)) AS u(r), unnest(range(0, 10)) AS w(c) WHERE r IN (0, 9) OR c IN (0, 9)")
add("image_alpha", lambda s, d: raster.alpha(px(s, d), 0.25).select("img", "row", "col", "v", "A"), "img row col | v A", f"SELECT *, 0.25 AS A FROM ({TS})")
N9 = f"SELECT a.img, a.row, a.col, b.v AS w, b.row - a.row AS dr, b.col - a.col AS dc FROM ({TS}) a JOIN ({TS}) b ON a.img = b.img AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1"
kern = tile.brush(3, "box")
for name_, kernel_, text_ in (("dilate", lambda a: tile.dilate(a, kern), "max(w)"), ("erode", lambda a: tile.erode(a, kern), "min(w)"), ("median3", tile.median, "median(w)")):
    add(name_, lambda s, d, k=kernel_: tile.to_pixels(tile.apply(tl(s, d), k)), PX, f"SELECT img, row, col, {text_} AS v FROM ({N9}) GROUP BY img, row, col")
ERODED = f"SELECT img, row, col, min(w) AS v FROM ({N9}) GROUP BY img, row, col"
add("opening", lambda s, d: tile.to_pixels(tile.apply(tl(s, d), lambda a: tile.opening(a, kern))), PX, f"WITH e AS ({ERODED}) SELECT a.img, a.row, a.col, max(b.v) AS v FROM e a JOIN e b ON a.img = b.img AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL")
DILATED = ERODED.replace("min(w)", "max(w)")
add("closing", lambda s, d: tile.to_pixels(tile.apply(tl(s, d), lambda a: tile.closing(a, kern))), PX, f"WITH e AS ({DILATED}) SELECT a.img, a.row, a.col, min(b.v) AS v FROM e a JOIN e b ON a.img = b.img AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL")
REPEAT = f"SELECT a.img, a.row, a.col, dr, dc, b.v AS w FROM ({TS}) a, unnest([-1, 0, 1]) AS u(dr), unnest([-1, 0, 1]) AS z(dc), ({TS}) b WHERE b.img = a.img AND b.row = least(greatest(a.row + dr, 0), 7) AND b.col = least(greatest(a.col + dc, 0), 7)"
add("sobel", lambda s, d: tile.to_pixels(tile.apply(tl(s, d), tile.sobel)), PX, f"SELECT img, row, col, sqrt(pow(sum(w * dc * (2 - abs(dr))), 2) + pow(sum(w * dr * (2 - abs(dc))), 2)) AS v FROM ({REPEAT}) GROUP BY img, row, col")
KER = {o: repr(float(k)) for o, k in zip((-1, 0, 1), (lambda k: k / k.sum())(__import__("numpy").exp(-(__import__("numpy").arange(-1, 2) ** 2) / (2 * (1 / 3) ** 2))), strict=True)}
add("gauss_blur", lambda s, d: tile.to_pixels(tile.apply(tl(s, d), lambda a: tile.blur(a, 1 / 3))), PX, f"SELECT img, row, col, sum(w * (CASE dr WHEN 0 THEN {KER[0]} ELSE {KER[1]} END)::DOUBLE * (CASE dc WHEN 0 THEN {KER[0]} ELSE {KER[1]} END)::DOUBLE) AS v FROM ({REPEAT}) GROUP BY img, row, col")
fg = lambda s, d: tl(s, d).withColumn("data", F.transform("data", lambda v: F.when((v > 0.0) & ~F.isnan(v), 1.0).otherwise(0.0)))
FG = f"SELECT img, row, col FROM ({TS}) WHERE v > 0"
add("dist_transform", lambda s, d: tile.to_pixels(tile.apply(fg(s, d), tile.distance)), PX, f"SELECT a.img, a.row, a.col, coalesce(min(abs(a.row - b.row) + abs(a.col - b.col)), 64)::DOUBLE AS v FROM ({TS}) a LEFT JOIN ({TS}) b ON a.img = b.img AND b.v <= 0 GROUP BY ALL")
add("label_cc", lambda s, d: tile.to_pixels(tile.apply(fg(s, d), tile.label)), PX, f"""WITH RECURSIVE f AS (SELECT img, row * 8 + col AS k, row, col FROM ({FG})), r AS (SELECT img, k, k AS lo FROM f UNION SELECT r.img, b.k, r.lo FROM r JOIN f a ON a.img = r.img AND a.k = r.k JOIN f b ON b.img = a.img AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 WHERE b.k > r.lo)
  SELECT t.img, t.row, t.col, coalesce(nth, 0)::DOUBLE AS v FROM ({TS}) t LEFT JOIN (SELECT img, k, dense_rank() OVER (PARTITION BY img ORDER BY lo) AS nth FROM (SELECT img, k, min(lo) AS lo FROM r GROUP BY img, k)) l ON t.img = l.img AND t.row * 8 + t.col = l.k""")
for name_, kernel_ in (("label_gap", lambda a: tile.label(a, 2)), ("watershed2", tile.watershed), ("thin_zhang_suen", tile.thin), ("thin_guo_hall", tile.thin_guo_hall), ("skeleton", tile.skeleton), ("fill_hull", tile.fill_hull)):
    add(name_, lambda s, d, k=kernel_: tile.to_pixels(tile.apply(fg(s, d), k)))
for name_, kernel_ in (("canny", tile.canny), ("clahe", tile.clahe), ("image_rotate", lambda a: tile.rotate(a, 30)), ("image_resize", lambda a: tile.resize(a, 5, 12)), ("image_square", lambda a: tile.square(tile.autocrop(a, a > 0.05)))):
    add(name_, lambda s, d, k=kernel_: tile.to_pixels(tile.apply(tl(s, d), k)))
add("haralick", lambda s, d: tile.apply(tl(s, d), lambda a: tile.haralick(a, 8)).select("img", *[F.get("data", F.lit(k)).alias(n) for k, n in enumerate(tile.HARALICK)]))
add("object_contour", lambda s, d: tile.contours(fg(s, d), tile.label))
add("contour_measures", lambda s, d: polygon.measures(polygon.rings(tile.contours(fg(s, d), tile.label), ["img", "id"]).where(F.size("xs") >= 3)))
add("injury_ratio", lambda s, d: severity.injury(fg(s, d)))
add("tile_entropy", lambda s, d: stats.entropy(px(s, d), "v", ["img"]), "img | entropy", f"SELECT img, -sum(n / 64 * ln(n / 64)) AS entropy FROM (SELECT img, round(v, 2) AS v, count(*)::DOUBLE AS n FROM ({TS}) GROUP BY ALL) GROUP BY img")
GROUND = f"SELECT a.img, a.row, a.col, a.v - g AS height FROM ({TS}) a JOIN (SELECT img, row // 4 AS r, col // 4 AS c, quantile_cont(v, 0.1) AS g FROM ({TS}) GROUP BY ALL) b ON a.img = b.img AND a.row // 4 = r AND a.col // 4 = c"
heights = lambda s, d: raster.chm(px(s, d), raster.ground(px(s, d), 4, 0.1))
add("chm_ground_quantile", heights, "img row col | height", GROUND)
add("chm_from_dtm", lambda s, d: raster.chm(px(s, d), px(s, d).withColumn("v", F.col("v") / 2.0 - 0.1)), "img row col | height", f"SELECT img, row, col, v - (v / 2 - 0.1::DOUBLE) AS height FROM ({TS})")
add("chm_extract", lambda s, d: raster.chm_extract(heights(s, d), ["img"], 0.25, 0.1), "img | q0 q5 q50 q95 q100 mean cv volume coverage entropy", f"""SELECT img, quantile_cont(height, 0) AS q0, quantile_cont(height, 0.05) AS q5, quantile_cont(height, 0.5) AS q50, quantile_cont(height, 0.95) AS q95, quantile_cont(height, 1) AS q100, avg(height) AS mean, avg(height) / nullif(stddev_samp(height), 0) AS cv, sum(height) * 0.25 AS volume,
  count(*) FILTER (height > 0.1) / count(*)::DOUBLE AS coverage, any_value(entropy) AS entropy FROM ({GROUND}) JOIN (SELECT img, -sum(n / 64 * ln(n / 64)) AS entropy FROM (SELECT img, round(height, 2) AS v, count(*)::DOUBLE AS n FROM ({GROUND}) GROUP BY ALL) GROUP BY img) USING (img) GROUP BY img""")
add("chm_mask", lambda s, d: raster.chm_mask(heights(s, d), 0.05, 0.2).select("img", "row", "col", "mask"), "img row col mask", f"SELECT img, row, col, height > 0.05 AND height < 0.2 AS mask FROM ({GROUND})")
add("hist", lambda s, d: raster.histogram(T(s, d), "v", ["label"], -0.5, 0.5, 20), "label bin count", f"SELECT label, greatest(least(floor((v - (-0.5)) / (1 / 20::DOUBLE)), 19), 0)::INT AS bin, count(*) AS count FROM ({TILES_SQL}) GROUP BY ALL")
add("interp_lm", lambda s, d: raster.plane(px(s, d), "v", ["img"]), "img | b0 bx by_", f"SELECT img, mz - covar_pop_xz / 5.25 * 3.5 - covar_pop_yz / 5.25 * 3.5 AS b0, covar_pop_xz / 5.25 AS bx, covar_pop_yz / 5.25 AS by_ FROM (SELECT img, avg(v) AS mz, covar_pop(col, v) AS covar_pop_xz, covar_pop(row, v) AS covar_pop_yz FROM ({TS}) GROUP BY img)")


def surface(fit):
    import numpy as np

    return fit(np.array([(0, 0, 1.0), (7, 0, 2.0), (0, 7, 0.5), (7, 7, 3.0), (3, 4, 1.5)], float))


add("interp_tps", lambda s, d: raster.predict(px(s, d), surface(raster.thin_plate)))
add("interp_krig", lambda s, d: raster.predict(px(s, d), surface(lambda p: raster.kriging(p, 5.0))))
