"""Queries of whole analyses (objects, plots of a raster, severity by palettes) and of vector data."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldframe.functions import colour
from fieldframe.operators import analyze, geometry, lines, mosaic, outline, polygon, raster, severity, threshold, tile
from fieldframe.sources import images, rasters, tables, vector
from fieldframe.sources.tables import KEY, OUTLINES_SQL, PIXELS_SQL, POINTS_SQL, TILES_SQL

from .common import rounded, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name, run, columns=None, body=None):
    QUERIES[name] = lambda spark, d: rounded(run(spark, d))
    if body is not None:
        SQL[name] = sql(columns, body)


# Images: tiles as pictures of three bands.
def pictures(s, d):
    """(img, h, w, bands, data): R is the tile's value and a half, G a half, B a half less the value."""
    t = tile.from_embeddings(tables.read(s, d, "embeddings"))
    band = lambda f: F.transform("data", f)
    return images.from_bands(t.select("img", "h", "w", band(lambda v: v + 0.5).alias("R"), band(lambda v: v * 0.0 + 0.5).alias("G"), band(lambda v: F.lit(0.5) - v).alias("B")), ["R", "G", "B"])


HOW = analyze.Segmentation(index="B", threshold=0.5, watershed=False)
labels = lambda s, d: analyze.segment(pictures(s, d), HOW)
TS = f"SELECT img, row, col, v FROM ({TILES_SQL})"
LABELS = f"""WITH RECURSIVE f AS (SELECT img, row * 8 + col AS k, row, col FROM ({TS}) WHERE 0.5 - v < 0.5), r AS (SELECT img, k, k AS lo FROM f UNION SELECT r.img, b.k, r.lo FROM r JOIN f a ON a.img = r.img AND a.k = r.k JOIN f b ON b.img = a.img AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 WHERE b.k > r.lo),
  objects AS (SELECT img, k, dense_rank() OVER (PARTITION BY img ORDER BY lo)::INT AS id FROM (SELECT img, k, min(lo) AS lo FROM r GROUP BY img, k))"""
add("analyze_object_areas", lambda s, d: analyze.outlines(labels(s, d)).select("img", "id", "area", "npixels"), "img id area npixels", f"{LABELS} SELECT img, id, count(*) AS area, 64 AS npixels FROM objects GROUP BY img, id")
add("analyze_object_index", lambda s, d: analyze.object_index(pictures(s, d), labels(s, d), "R - B"), "img id n | mean", f"{LABELS} SELECT o.img, id, count(*) AS n, avg((v + 0.5) - (0.5 - v)) AS mean FROM objects o JOIN ({TS}) t ON t.img = o.img AND t.row * 8 + t.col = o.k GROUP BY o.img, id")
add("analyze_objects", lambda s, d: analyze.analyze_objects(pictures(s, d), analyze.Segmentation(index="B", watershed=True)))
add("analyze_objects_minimal", lambda s, d: analyze.analyze_objects(pictures(s, d), HOW, minimal=True, dpi=300))
add("analyze_objects_reference", lambda s, d: analyze.analyze_objects(pictures(s, d), HOW, reference_area=6.0))
add("analyze_objects_summary", lambda s, d: analyze.summary(analyze.analyze_objects(pictures(s, d), HOW)))
add("analyze_objects_merged", lambda s, d: analyze.merged(analyze.analyze_objects(pictures(s, d), HOW).withColumn("img", F.concat_ws("_", F.col("img") % 7, "img"))))
add("object_split", lambda s, d: analyze.crops(pictures(s, d), labels(s, d)))
add("object_isolate", lambda s, d: analyze.crops(pictures(s, d), labels(s, d), 1, None, 0.0).select("img", "id", "row", "col", "h", "w"), "img id row col h w", f"""{LABELS} SELECT img, id, greatest(min(k // 8) - 1, 0) AS row, greatest(min(k % 8) - 1, 0) AS col, least(max(k // 8) + 2, 8) - greatest(min(k // 8) - 1, 0) AS h,
  least(max(k % 8) + 2, 8) - greatest(min(k % 8) - 1, 0) AS w FROM objects GROUP BY img, id""")
add("image_augment", lambda s, d: analyze.augment(pictures(s, d), 3))
add("image_export_import", lambda s, d: images.pixels(images.tiles(images.encoded(pictures(s, d)).select(F.col("img").cast("string").alias("path"), "content"))), "img row col | R G B", f"SELECT img::VARCHAR AS img, row, col, round_even(least(greatest(v + 0.5, 0), 1) * 255, 0) / 255 AS R, round_even(0.5 * 255::DOUBLE, 0) / 255 AS G, round_even(least(greatest(0.5 - v, 0), 1) * 255, 0) / 255 AS B FROM ({TS})")
add("image_create", lambda s, d: images.pixels(images.create(s, "plain", 5, 3, (0.2, 0.4, 0.6))), "img row col | R G B", "SELECT 'plain' AS img, r::INT AS row, c::INT AS col, 0.2 AS R, 0.4 AS G, 0.6 AS B FROM unnest(range(0, 3)) AS u(r), unnest(range(0, 5)) AS w(c)")
flat = lambda s, d: tile.from_embeddings(tables.read(s, d, "embeddings"))
PX = "img row col | v"
add("image_segment_mask", lambda s, d: tile.to_pixels(tile.apply(flat(s, d), lambda a: tile.masked(a, tile.placed_brush(8, 8, 5)))), PX, f"SELECT img, row, col, CASE WHEN pow(row - 4, 2) + pow(col - 4, 2) <= 6.25 THEN v ELSE 1 END AS v FROM ({TS})")
add("int_sum", lambda s, d: tile.to_pixels(tile.apply(flat(s, d), tile.area_sums)), PX, f"SELECT a.img, a.row, a.col, sum(b.v) AS v FROM ({TS}) a JOIN ({TS}) b ON a.img = b.img AND b.row <= a.row AND b.col <= a.col GROUP BY ALL")
add("int_sum_squared", lambda s, d: tile.to_pixels(tile.apply(flat(s, d), lambda a: tile.area_sums(a * a))), PX, f"SELECT a.img, a.row, a.col, sum(b.v * b.v) AS v FROM ({TS}) a JOIN ({TS}) b ON a.img = b.img AND b.row <= a.row AND b.col <= a.col GROUP BY ALL")
add("threshold_adaptive", lambda s, d: threshold.adaptive(tables.tiles(s, d).withColumn("v", F.col("v") + 0.5), "v", 2).select("img", "row", "col", "mask"), "img row col mask", f"SELECT a.img, a.row, a.col, any_value(a.v + 0.5) < avg(b.v + 0.5) * 0.85 AS mask FROM ({TS}) a JOIN ({TS}) b ON a.img = b.img AND abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY a.img, a.row, a.col")
for name_, kernel_ in (("image_horizontal", lambda a: tile.horizontal(a[:, :])), ("image_vertical", tile.vertical), ("image_align", lambda a: tile.levelled(a, 1, 1, 3, 6)), ("object_edge", tile.edges)):
    add(name_, lambda s, d, k=kernel_: tile.to_pixels(tile.apply(flat(s, d), k)))

# Colour and severity.
CARD = [(0.45, 0.32, 0.27), (0.76, 0.58, 0.51), (0.38, 0.48, 0.61), (0.34, 0.42, 0.26), (0.52, 0.50, 0.69), (0.40, 0.74, 0.67), (0.84, 0.49, 0.17), (0.31, 0.36, 0.65), (0.76, 0.35, 0.39), (0.37, 0.24, 0.42), (0.62, 0.73, 0.25), (0.88, 0.64, 0.18), (0.22, 0.24, 0.59), (0.27, 0.58, 0.29), (0.69, 0.19, 0.23), (0.93, 0.78, 0.12), (0.73, 0.34, 0.58), (0.03, 0.53, 0.63), (0.95, 0.95, 0.95), (0.78, 0.78, 0.78), (0.63, 0.63, 0.63), (0.48, 0.48, 0.47), (0.33, 0.33, 0.33), (0.20, 0.20, 0.20)]


def _matrix():
    import numpy as np

    known = np.array(CARD)
    return colour.fit_correction(known * [0.9, 1.05, 1.0] + [0.02, -0.01, 0.03], known, "root_polynomial").round(6)


TWENTY = ["1", "R", "G", "B", "R * G", "R * B", "G * B", "R * R", "G * G", "B * B", "R * R * R", "G * G * G", "B * B * B", "R * R * G", "R * R * B", "G * G * R", "G * G * B", "B * B * R", "B * B * G", "R * G * B"]
MATRIX = _matrix()
K = " ".join(KEY)
add("color_correction_twenty", lambda s, d: colour.correct(tables.pixels(s, d), MATRIX, "root_polynomial").select(*KEY, "R", "G", "B"), f"{K} | R G B",
    f"SELECT {', '.join(KEY)}, {', '.join(' + '.join(f'{t} * {float(MATRIX[i, k])!r}::DOUBLE' for i, t in enumerate(TWENTY)) + f' AS {b}' for k, b in enumerate('RGB'))} FROM ({PIXELS_SQL})")


def palettes(s):
    import numpy as np

    rng = np.random.default_rng(3)
    of = lambda mean: s.createDataFrame((np.array(mean) + rng.normal(0, 0.08, (60, 3))).tolist(), "R double, G double, B double")
    return of((0.2, 0.6, 0.3)), of((0.6, 0.3, 0.2)), of((0.9, 0.9, 0.9))


def by_palette(s, d):
    healthy, sick, background = palettes(s)
    return severity.by_palette(tables.pixels(s, d), healthy, sick, ["R", "G", "B"], ["img"], background)


add("severity_palette_glm", by_palette)

# A raster: the tiles side by side, sixteen a row, as one mosaic; plots are squares of 16 pixels with a border of 2.
GRID = mosaic.Grid(100.0, 1000.0, 0.5, 0.5)


def field(s, d):
    """(row, col, R, NIR)."""
    t = tables.tiles(s, d)
    return t.select((F.floor(F.col("img") / 16) * 8 + F.col("row")).cast("int").alias("row"), (F.col("img") % 16 * 8 + F.col("col")).cast("int").alias("col"), (F.col("v") + 0.6).alias("R"), (F.col("v") / 2.0 + F.col("label") / 10.0 + 0.3).alias("NIR"))


RASTER = f"SELECT img // 16 * 8 + row AS row, img % 16 * 8 + col AS col, v + 0.6::DOUBLE AS R, v / 2 + label / 10.0::DOUBLE + 0.3::DOUBLE AS NIR FROM ({TILES_SQL})"
EQUATIONS = {"NDVI": "(NIR - R) / (NIR + R)", "RATIO": "R / NIR"}
CUT = 0.02


def plots(s, d):
    """Boxes (id, xmin, xmax, ymin, ymax) over the mosaic, a row of eight for every 32 tiles."""
    n = tables.read(s, d, "embeddings").select(F.col("vec_id")).where("vec_id % 32 = 0")
    rows = n.select((F.col("vec_id") / 32).cast("long").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("c"))
    return rows.select((F.col("r") * 8 + F.col("c")).alias("id"), (F.lit(100.0) + F.col("c") * 8.0 + 1.0).alias("xmin"), (F.lit(100.0) + F.col("c") * 8.0 + 7.0).alias("xmax"), (F.lit(1000.0) - F.col("r") * 8.0 - 7.0).alias("ymin"), (F.lit(1000.0) - F.col("r") * 8.0 - 1.0).alias("ymax"))


PLOTS = "SELECT vec_id // 32 * 8 + c AS id, 100.0::DOUBLE + c * 8 + 1 AS xmin, 100.0::DOUBLE + c * 8 + 7 AS xmax, 1000.0::DOUBLE - vec_id // 32 * 8 - 7 AS ymin, 1000.0::DOUBLE - vec_id // 32 * 8 - 1 AS ymax FROM embeddings, unnest(range(0, 8)) AS u(c) WHERE vec_id % 32 = 0"
LOCATED = f"SELECT *, 100 + (col + 0.5::DOUBLE) * 0.5 AS x, 1000 - (row + 0.5::DOUBLE) * 0.5 AS y, (NIR - R) / nullif(NIR + R, 0) AS NDVI, R / nullif(NIR, 0) AS RATIO FROM ({RASTER})"
CLIPPED = f"SELECT p.id AS plot, l.*, coalesce(NDVI > {CUT}, false) AS mask FROM ({LOCATED}) l JOIN ({PLOTS}) p ON l.x >= p.xmin AND l.x < p.xmax AND l.y >= p.ymin AND l.y < p.ymax"
ran = lambda s, d: mosaic.analyze_plots(field(s, d), plots(s, d), GRID, EQUATIONS, "NDVI", 8.0, 8.0, CUT)
add("mosaic_clip", lambda s, d: mosaic.clip(mosaic.located(field(s, d), GRID), plots(s, d), 8.0, 8.0), "plot row col | x y R NIR", CLIPPED)
STATS = ", ".join(f"{g}({i}) FILTER (mask) AS \"{f}.{i}\"" for i in EQUATIONS for f, g in (("mean", "avg"), ("min", "min"), ("max", "max"), ("stddev_samp", "stddev_samp")))
add("mosaic_analyze", lambda s, d: ran(s, d).plots, "plot | plot_area covered_area coverage " + " ".join(f"{f}.{i}" for i in EQUATIONS for f in ("mean", "min", "max", "stddev_samp")), f"SELECT plot, count(*) * 0.25 AS plot_area, count(*) FILTER (mask) * 0.25 AS covered_area, count(*) FILTER (mask) / count(*)::DOUBLE AS coverage, {STATS} FROM ({CLIPPED}) GROUP BY plot")
add("mosaic_individuals", lambda s, d: ran(s, d).individuals.drop("xs", "ys"))
add("mosaic_plot_summary", lambda s, d: ran(s, d).summary)


def individuals_wkt(s, d):
    return ran(s, d).individuals.select("plot", "individual", vector.to_wkt().alias("wkt"))


add("mosaic_vectorize", individuals_wkt)
add("mosaic_to_rgb", lambda s, d: mosaic.to_rgb(field(s, d), "R", "NIR", "R"), "row col | R G B", f"SELECT row, col, (m.R - r0) / (r1 - r0) AS R, (NIR - n0) / (n1 - n0) AS G, (m.R - r0) / (r1 - r0) AS B FROM ({RASTER}) m, (SELECT min(R) AS r0, max(R) AS r1, min(NIR) AS n0, max(NIR) AS n1 FROM ({RASTER}))")
add("align_dsm", lambda s, d: mosaic.aligned(field(s, d).select("row", "col", F.col("R").alias("v")), GRID, mosaic.Grid(100.0, 1000.0, 2.0, 1.0)), PX.replace("img ", ""), f"SELECT floor((1000 - (1000 - (row + 0.5::DOUBLE) * 0.5)) / 1)::INT AS row, floor((col + 0.5::DOUBLE) * 0.5 / 2)::INT AS col, avg(R) AS v FROM ({RASTER}) GROUP BY ALL")
add("stack_bands", lambda s, d: mosaic.stacked({b: field(s, d).select("row", "col", F.col(b).alias("v")) for b in ("R", "NIR")}), "row col | R NIR", RASTER)
add("mosaic_draw_line", lambda s, d: mosaic.along_line(field(s, d), GRID, 101.0, 999.0, 160.0, 985.0, 40, ["R", "NIR"]), "k | x y R NIR", f"SELECT k, x, y, R, NIR FROM (SELECT k::INT AS k, 101 + 59 * k / 39::DOUBLE AS x, 999 - 14 * k / 39::DOUBLE AS y FROM unnest(range(0, 40)) AS u(k)) JOIN ({RASTER}) m ON m.row = floor((1000 - y) / 0.5) AND m.col = floor((x - 100) / 0.5)")
add("mosaic_project", lambda s, d: tables.points(s, d).select("id", *[c.alias(n) for c, n in zip(mosaic.utm(F.col("x") * 15.0 - 180.0, F.col("y") / 10.0 - 25.0), ("easting", "northing"), strict=True)]))

# Vector data. Boxes around the points of a field, against its plots, both as rings.
R3 = f"SELECT id, seq, x, y, first(x) OVER w = last(x) OVER w AND first(y) OVER w = last(y) OVER w AS shut, count(*) OVER w AS n FROM ({OUTLINES_SQL}) WINDOW w AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
rings = lambda s, d: polygon.rings(tables.outlines(s, d))
OPEN = f"SELECT id, seq, x, y FROM ({R3}) WHERE NOT (shut AND n > 3 AND seq = n)"
opened = lambda s, d: rings(s, d).select("id", vector.to_wkt().alias("wkt"))
# Written with a repeated first point, so rings of three points and more lose just that one.
add("shape_wkt_round_trip", lambda s, d: polygon.vertices(vector.from_wkt(opened(s, d))), "id seq | x y", OUTLINES_SQL)
add("shape_wkb_round_trip", lambda s, d: polygon.vertices(vector.from_wkb(vector.to_wkb(rings(s, d)).select("id", "wkb"))), "id seq | x y", OUTLINES_SQL)
box = lambda x0, x1, y0, y1: (F.array(x0, x1, x1, x0).alias("xs"), F.array(y0, y0, y1, y1).alias("ys"))


def plants(s, d):
    p = tables.points(s, d)
    return p.select("id", *box(F.col("x") - 0.4, F.col("x") + 0.4, F.col("y") - 9.0, F.col("y") + 9.0))


def beds(s):
    r, c = F.floor(F.col("id") / 6), F.col("id") % 6
    return s.range(30).select("id", *box(c * 4.0 + 0.5, c * 4.0 + 3.5, r * 100.0 + 10.0, r * 100.0 + 90.0))


A = f"SELECT id, x - 0.4 AS xmin, x + 0.4 AS xmax, y - 9 AS ymin, y + 9 AS ymax FROM ({POINTS_SQL})"
B = "SELECT i AS id, i % 6 * 4 + 0.5::DOUBLE AS xmin, i % 6 * 4 + 3.5::DOUBLE AS xmax, i // 6 * 100 + 10::DOUBLE AS ymin, i // 6 * 100 + 90::DOUBLE AS ymax FROM unnest(range(0, 30)) AS u(i)"
IN_, OVER_ = "(a.xmin >= b.xmin AND a.xmax <= b.xmax AND a.ymin >= b.ymin AND a.ymax <= b.ymax)", "(a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax)"
CLOSED = OVER_.replace("<", "<=")
for name_, test_, word_ in (("within", IN_, "EXISTS"), ("overlaps", f"{OVER_} AND NOT {IN_}", "EXISTS"), ("outside", OVER_, "NOT EXISTS"), ("crosses", f"{OVER_} AND NOT {IN_}", "EXISTS"), ("intersects", CLOSED, "EXISTS")):
    add(f"shape_{name_}", lambda s, d, n=name_: geometry.select(plants(s, d), beds(s), 4.0, 100.0, n).select("id"), "id", f"SELECT id FROM ({A}) a WHERE {word_} (SELECT 1 FROM ({B}) b WHERE {test_})")
add("shape_touches", lambda s, d: geometry.select(beds(s), beds(s).select("id", F.transform("xs", lambda v: v + 3.0).alias("xs"), "ys"), 4.0, 100.0, "touches").select("id"), "id", f"SELECT id FROM ({B}) a WHERE EXISTS (SELECT 1 FROM ({B}) b WHERE a.xmax = b.xmin + 3 AND a.ymin = b.ymin)")
SHARED = "(least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))"
for name_, area_ in (("intersection", SHARED), ("difference", f"(a.xmax - a.xmin) * (a.ymax - a.ymin) - {SHARED}"), ("union", f"(a.xmax - a.xmin) * (a.ymax - a.ymin) + (b.xmax - b.xmin) * (b.ymax - b.ymin) - {SHARED}")):
    add(f"shape_{name_}", lambda s, d, n=name_: geometry.combined(plants(s, d), beds(s), 4.0, 100.0, n, shapes=False).where("area > 1e-6").select("a_id", "b_id", "area"), "a_id b_id | area", f"SELECT * FROM (SELECT a.id AS a_id, b.id AS b_id, {area_} AS area FROM ({A}) a JOIN ({B}) b ON {CLOSED}) WHERE area > 1e-6")


def cells(s, rows):
    return s.createDataFrame(rows, "row int, col int, xs array<double>, ys array<double>").withColumn("id", F.col("row") * 100 + F.col("col"))


add("grid_curved", lambda s, d: cells(s, geometry.curved_grid([(0, 0), (4, 1), (8, 0)], [(0, 5), (4, 7), (8, 5)], 3, 4)).select("id", "row", "col", polygon.area().alias("area"), vector.to_wkt(digits=6).alias("wkt")))
add("grid_radial", lambda s, d: cells(s, geometry.radial_grid(0, 0, 1, 3, 2, 8, 8)).select("row", "col", polygon.area().alias("area")), "row col | area", "SELECT r::INT AS row, c::INT AS col, (pow(4 - r, 2) - pow(3 - r, 2)) * sin(pi() / 4) / 2 AS area FROM unnest([1, 2]) AS u(r), unnest(range(1, 9)) AS w(c)")

# Further polygon operators.
V = f"SELECT *, count(*) OVER (PARTITION BY id) AS n FROM ({OUTLINES_SQL})"
add("poly_check", lambda s, d: polygon.check(rings(s, d)).select("id", F.size("xs").alias("n")), "id n", f"SELECT id, count(*) AS n FROM ({OUTLINES_SQL}) GROUP BY id")
add("poly_sample_prop", lambda s, d: polygon.vertices(polygon.sample_prop(rings(s, d), 0.5)), "id seq | x y", f"SELECT id, (k + 1)::INT AS seq, x, y FROM (SELECT *, greatest(floor(n * 0.5), least(n, 2)) AS m FROM ({V})), unnest(range(0, 8)) AS u(k) WHERE k < m AND seq = floor(k * ((n - 1) / greatest(m - 1, 1)::DOUBLE) + 0.5) + 1")
add("poly_smooth_open", lambda s, d: polygon.vertices(polygon.smooth_open(rings(s, d), 3)), "id seq | x y", f"SELECT id, seq, avg(x) OVER w AS x, avg(y) OVER w AS y FROM ({OUTLINES_SQL}) WINDOW w AS (PARTITION BY id ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
add("poly_closest_vertex", lambda s, d: geometry.closest_vertex(rings(s, d), 25.0, 50.0), "id k", f"SELECT id, arg_min(seq - 1, pow(x - 25, 2) + pow(y - 50, 2)) AS k FROM (SELECT * FROM ({OUTLINES_SQL}) ORDER BY id, seq) GROUP BY id")
add("poly_jitter", lambda s, d: polygon.vertices(polygon.jitter(rings(s, d), 0.5, 7)).join(tables.outlines(s, d).withColumnsRenamed({"x": "x0", "y": "y0"}), ["id", "seq"]).select("id", "seq", ((F.abs(F.col("x") - F.col("x0")) <= 0.5) & (F.abs(F.col("y") - F.col("y0")) <= 0.5) & (F.col("x") != F.col("x0"))).alias("moved")), "id seq moved", f"SELECT id, seq, true AS moved FROM ({OUTLINES_SQL})")
add("poly_spline", lambda s, d: polygon.vertices(polygon.spline(rings(s, d), 20)))
add("poly_width_at", lambda s, d: polygon.width_at(rings(s, d)))
add("poly_apex_base_angle", lambda s, d: polygon.apex_base_angle(rings(s, d)))
add("poly_point_at", lambda s, d: geometry.point_at(rings(s, d), 0.5))
add("polygon_to_binary", lambda s, d: polygon.column_pixels(polygon.rectangle(s, 5.5, 3.5).unionByName(polygon.triangle_right(s, 6, 6))), "id x first middle last n", "SELECT id, x::INT AS x, min(y)::INT AS first, median(y) AS middle, max(y)::INT AS last, count(*) AS n FROM (SELECT 'rectangle' AS id, x, y FROM unnest(range(0, 6)) AS u(x), unnest(range(0, 4)) AS w(y) UNION ALL SELECT 'triangle_right', x, y FROM unnest(range(0, 6)) AS u(x), unnest(range(0, 6)) AS w(y) WHERE x + y < 6) GROUP BY id, x")

# Lines and contours, borders, terrain, rasters as files, shapes.
add("image_line_segment", lambda s, d: lines.line_segments(flat(s, d), 0.02, -20.0))
add("image_contour_line", lambda s, d: lines.contours(flat(s, d), 0.0))
add("image_expand_edges", lambda s, d: raster.expand(tables.tiles(s, d).drop("label"), 8, 8, 2, "v", None), PX, f"SELECT img, r::INT AS row, c::INT AS col, v FROM ({TS}), unnest(range(0, 12)) AS u(r), unnest(range(0, 12)) AS w(c) WHERE row = least(greatest(r - 2, 0), 7) AND col = least(greatest(c - 2, 0), 7)")
LOW = f"SELECT img, row // 4 AS r, col // 4 AS c, quantile_cont(v, 0.1) AS g FROM ({TS}) GROUP BY ALL"
add("chm_ground_smooth", lambda s, d: raster.ground(tables.tiles(s, d).drop("label"), 4, 0.1, smooth=True), PX, f"SELECT img, row, col, sum(g * w) / sum(w) AS v FROM (SELECT t.img, row, col, g, greatest(1 - abs((row + 0.5) / 4 - 0.5 - r), 0) * greatest(1 - abs((col + 0.5) / 4 - 0.5 - c), 0) AS w FROM ({TS}) t JOIN ({LOW}) b ON t.img = b.img) WHERE w > 0 GROUP BY img, row, col")
SURVEYED = [(0, 0, 1.0), (7, 0, 2.0), (0, 7, 0.5), (7, 7, 3.0), (3, 4, 1.5), (5, 2, 2.2), (1, 5, 0.8)]
add("interp_loess", lambda s, d: raster.predict(tables.tiles(s, d).drop("label"), raster.loess(SURVEYED)))


def tiffs(s, d):
    """The tiles as GeoTIFF files and back."""
    t = flat(s, d).withColumns({"bands": F.lit(1), "xmin": F.col("img") * 4.0, "ymax": F.lit(100.0), "resx": F.lit(0.5), "resy": F.lit(0.25), "epsg": F.lit(32723)})
    files = rasters.encoded(t.withColumn("img", F.col("img").cast("string")))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for img, blob in zip(b.column("img").to_pylist(), b.column("content").to_pylist(), strict=True):
                a, corner, epsg = rasters.decode(blob)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([img, *a.shape, *corner, epsg, a.ravel()], [pa.string(), *[pa.int32()] * 3, *[pa.float64()] * 4, pa.int32(), pa.list_(pa.float64())], strict=True)], [x.split()[0] for x in rasters.SCHEMA.split(", ")])

    return rasters.pixels(files.mapInArrow(run, rasters.SCHEMA), ["v"])


add("mosaic_export_import", tiffs, "img row col | x y v", f"SELECT img::VARCHAR AS img, row, col, img * 4 + (col + 0.5::DOUBLE) * 0.5 AS x, 100 - (row + 0.5::DOUBLE) * 0.25 AS y, v::FLOAT AS v FROM ({TS})")
add("landmarks_matrix", lambda s, d: outline.symmetric(outline.landmarks_dist(rings(s, d))), "id i j | dist", f"SELECT a.id, a.seq AS i, b.seq AS j, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM ({OUTLINES_SQL}) a JOIN ({OUTLINES_SQL}) b ON a.id = b.id")
add("efourier_shape", lambda s, d: outline.random_shapes(s, 20).select("id", polygon.area().alias("area"), polygon.perimeter().alias("perimeter")))
