"""Embedding near-duplicates by product quantisation.

Coarse centroids, in one or more residual levels, cut the unit vectors into inverted lists; what a vector differs by from
its list's centroid is kept as one code per subspace. A vector visits the lists whose centroid is hardly further from it
than its own; of two lists, a fixed rule says which one's vectors visit the other, so every pair meets in one list. Lists
are cut into tiles, and a pair of tiles meets twice. First only codes meet: each query, in eight bits a number, has a
lookup table for each subspace, and asymmetric distances to the codes are summed from the tables; the triangle inequality
with the known errors rules pairs out. Then the vectors that have a pair left, most often few, are sent to the tile pair
once and compared by exact cosine in double precision. Exact copies are one class throughout. A tile pair returns link
counts and a spanning forest, never all links.
"""

from __future__ import annotations

from math import log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .simhash import forest

SUBSPACES = 8
CODES = 256
#: Centroids of a level; more lists than that have further levels, so that the index stays small at any number of lists.
LEVEL = 256
#: Bound of the rows that the centroids and codes are fitted to.
FIT_ROWS = 16_384
#: A list is visited if its centroid is further than the own one by no more than this share of the most that a linked
#: vector's position can change the difference by. The share that a change in a random direction has is normal with a
#: deviation of 1 / sqrt(dims), so this many deviations miss one link in a thousand at the threshold; 1 is exact.
DEVIATIONS = 3.0
TILE = 1024


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centers)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        filled = counts > 0
        centers[filled] = sums[filled] / counts[filled, None]
        empty = np.flatnonzero(~filled)
        centers[empty] = x[rng.choice(len(x), len(empty))]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    norms = (centers**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centers.T - norms, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, int)


class Index:
    """Coarse centroids and residual codebooks, fitted to unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, threshold: float, reach: float | None = None):
        x = sample.astype(np.float32)
        dims = x.shape[1]
        self.radius = sqrt(max(2 - 2 * threshold, 0))
        self.reach = min(1, DEVIATIONS / sqrt(dims)) if reach is None else reach
        rest, self.levels = x, []
        while lists > 1:
            self.levels.append(kmeans(rest, min(lists, LEVEL)))
            rest = rest - self.levels[-1][nearest(rest, self.levels[-1])]
            lists = -(-lists // LEVEL)
        self.levels = self.levels or [np.zeros((1, dims), np.float32)]
        self.shape = tuple(len(c) for c in self.levels)
        self.lists = int(np.prod(self.shape))
        # Half the squared length of every list's centroid, the sum of one of each level.
        total = np.zeros(1, np.float32)
        for k, c in enumerate(self.levels):
            before = np.unravel_index(np.arange(len(total)), self.shape[:k]) if k else ()
            cross = sum((self.levels[j][before[j]] @ c.T for j in range(k)), np.zeros((len(total), len(c)), np.float32))
            total = (total[:, None] + (c**2).sum(1)[None] / 2 + cross).reshape(-1)
        self.halves = total
        self.parts = np.array_split(np.arange(dims), min(SUBSPACES, dims))
        home = self._products(x).argmax(1) if len(x) else np.empty(0, int)
        rest = x - self.center(home)
        self.books = [kmeans(rest[:, p], CODES, 6) for p in self.parts]

    def _spread(self, x: np.ndarray) -> np.ndarray:
        """Inner products of rows with the centroids of all lists."""
        total = np.zeros((len(x), 1), np.float32)
        for c in self.levels:
            total = (total[:, :, None] + (x @ c.T)[:, None, :]).reshape(len(x), -1)
        return total

    def _products(self, x: np.ndarray) -> np.ndarray:
        """Largest for the nearest list."""
        return self._spread(x) - self.halves

    def center(self, at: np.ndarray) -> np.ndarray:
        return sum(c[k] for c, k in zip(self.levels, np.unravel_index(at, self.shape), strict=True))

    def encode(self, x: np.ndarray):
        """home, lists to visit, codes and their error of unit vectors."""
        x = x.astype(np.float32)
        home, visits = np.empty(len(x), np.int32), []
        every = np.arange(self.lists)
        step = max(1, (1 << 22) // self.lists)
        for i in range(0, len(x), step):
            part = x[i : i + step]
            near = self._products(part)
            at = near.argmax(1)
            home[i : i + step] = at
            over = 2 * (near[np.arange(len(part)), at][:, None] - near)  # squared distance beyond that of the own list
            gaps = np.sqrt(np.maximum(2 * (self.halves[at][:, None] + self.halves[None] - self._spread(self.center(at))), 0))
            visit = over <= 2 * self.radius * self.reach * gaps + 1e-6
            # Of two lists the lower one's vectors visit if both are odd or both are even, else the higher one's.
            visit &= (at[:, None] < every) == ((at[:, None] + every) % 2 == 0)
            visit[np.arange(len(part)), at] = False
            visits += [np.flatnonzero(v).astype(np.int32) for v in visit]
        rest = x - self.center(home)
        codes = np.stack([nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8) if len(x) else np.empty((0, len(self.parts)), np.uint8)
        near = np.hstack([b[codes[:, k]] for k, b in enumerate(self.books)])
        return home, visits, codes, np.sqrt(((rest - near) ** 2).sum(1))

    def candidates(self, queries: np.ndarray, error_q: np.ndarray, at: int, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Which of list ``at``'s codes may be linked with which query: rows queries, columns codes."""
        rest = queries - self.center(np.array([at]))
        total = np.zeros((len(queries), len(codes)), np.float32)
        for k, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            q = rest[:, p]
            table = (q**2).sum(1)[:, None] - 2 * (q @ book.T) + (book**2).sum(1)
            total += table[:, codes[:, k]]
        return total <= (self.radius + error[None] + error_q[:, None] + 1e-3) ** 2


def prepare(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vec, key) of every row: vec as bytes of doubles, null where it can link with nothing; key: its MD5."""

    def run(batches):
        for b in batches:
            out = []
            ok = b.column("label").is_valid().to_numpy(zero_copy_only=False) & b.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            for good, v in zip(ok, b.column("embedding"), strict=True):
                v = np.array([np.nan if x is None else x for x in v.as_py()], float) if good and v.is_valid else np.empty(0)
                out.append(v.tobytes() if len(v) and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, label long, vec binary").withColumn("key", F.unhex(F.md5("vec")))


def unit(blobs: list[bytes]) -> np.ndarray:
    """Rows of length 1. Each is first divided by its largest number, so that no square is too large or too small."""
    x = np.frombuffer(b"".join(blobs)).reshape(len(blobs), -1)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def shortened(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in eight bits a number, what a step is worth, and the length of the rounding's error."""
    scale = np.abs(x).max(1) / 127
    small = np.rint(x / scale[:, None]).astype(np.int8)
    return small, scale.astype(np.float32), np.sqrt(((small * scale[:, None].astype(np.float32) - x) ** 2).sum(1)).astype(np.float32)


CODED = "label long, dims int, key binary, home int, visits array<int>, code binary, error float, short binary, scale float, rounding float"


def encoded(classes: DataFrame, indexes: dict[int, Index]) -> DataFrame:
    """Classes (label, dims, key, vec) without their vectors. Lengths without an index have one list and no codes."""
    shared = classes.sparkSession.sparkContext.broadcast(indexes)

    def run(batches):
        for b in batches:
            every = b.column("dims").to_numpy()
            for dims in np.unique(every):
                some = b.filter(pa.array(every == dims))
                x = unit(some.column("vec").to_pylist())
                index = shared.value.get(int(dims))
                if index:
                    home, visits, codes, error = index.encode(x)
                else:
                    home, visits, codes, error = np.zeros(len(x), np.int32), [[]] * len(x), np.empty((len(x), 0), np.uint8), np.zeros(len(x))
                small, scale, rounding = shortened(x)
                blobs = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
                more = [pa.array(home), pa.array(visits, pa.list_(pa.int32())), blobs(codes), pa.array(error.astype(np.float32)), blobs(small), pa.array(scale), pa.array(rounding)]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("label", "dims", "key")), *more], [x.split()[0] for x in CODED.split(", ")])

    return classes.select("label", "dims", "key", "vec").mapInArrow(run, CODED)


#: What names a tile pair.
PAIR = ["label", "dims", "list", "i", "visiting", "j"]


def possible(shared):
    """Tile pairs of codes -> the rows of them that have a pair left."""

    def run(key, rows):
        dims, at = key[1].as_py(), key[2].as_py()
        index = shared.value.get(dims)
        mine = rows.column("mine").to_numpy(zero_copy_only=False)
        if index:
            floats = lambda name, some: rows.column(name).to_numpy()[some]
            matrix = lambda name, some, kind: np.frombuffer(b"".join(rows.column(name).filter(pa.array(some)).to_pylist()), kind).reshape(int(some.sum()), -1)
            alone = mine.all()
            asks = mine if alone else ~mine
            if not asks.any() or not mine.any() or alone and len(mine) < 2:
                return rows.select([*PAIR, "mine", "key"]).slice(0, 0)
            queries = matrix("short", asks, np.int8) * floats("scale", asks)[:, None]
            maybe = index.candidates(queries, floats("rounding", asks), at, matrix("code", mine, np.uint8), floats("error", mine))
            if alone:
                np.fill_diagonal(maybe, False)
                maybe &= maybe.T
                left = maybe.any(1)
            else:
                left = np.empty(len(mine), bool)
                left[mine], left[asks] = maybe.any(0), maybe.any(1)
            rows = rows.filter(pa.array(left))
        return rows.select([*PAIR, "mine", "key"])

    return run


def compare(threshold: float):
    """Tile pairs of vectors -> counts (a, -1, n) of links and edges (a, b, 0) that join what they join."""

    def run(key, rows):
        mine = rows.column("mine").to_numpy(zero_copy_only=False)
        x = unit(rows.column("vec").to_pylist())
        ids, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
        if mine.all():
            i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        else:
            here, there = np.flatnonzero(mine), np.flatnonzero(~mine)
            i, j = np.nonzero(x[here] @ x[there].T >= threshold)
            i, j = here[i], there[j]
        count = (np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))).astype(np.int64)
        some = np.flatnonzero(count)
        a, c = forest(ids, i, j) if len(some) else (ids[:0], ids[:0])
        out = (np.r_[ids[some], a], np.r_[np.full(len(some), -1), c], np.r_[count[some], np.zeros(len(a), np.int64)])
        return pa.table([pa.array(o.astype(np.int64)) for o in out], names=["a", "b", "n"])

    return run


def fit(classes: DataFrame, threshold: float, rows: int = FIT_ROWS, tile: int = TILE) -> dict[int, Index]:
    """For each length of vectors an index with about as many lists as the square root of the largest label's classes,
    fitted to at most ``rows`` of them, chosen by a hash of their ids. A length whose classes of a label fit in one tile
    needs none: its list is compared whole."""
    sizes = classes.groupBy("dims", "label").count().groupBy("dims").agg(F.max("count").alias("n")).where(F.col("n") > tile).collect()
    out = {}
    for dims, n in sorted(tuple(s) for s in sizes):
        lists = 2 ** round(log2(n) / 2)
        some = classes.where(F.col("dims") == dims).select("vec", "rep").orderBy(F.xxhash64("rep"), "rep").limit(min(rows, 64 * lists)).collect()
        out[dims] = Index(unit([r.vec for r in some]), lists, threshold)
    return out


def links(classes: DataFrame, indexes: dict[int, Index], threshold: float, tile: int = TILE) -> DataFrame:
    """(a, b, n): n > 0: class a has n linked vectors more; n = 0: a and b are joined."""
    found = common.save(encoded(classes, indexes))
    home = F.struct(F.col("home").alias("list"), F.lit(False).alias("visiting"))
    seats = F.explode(F.concat(F.array(home), F.transform("visits", lambda v: F.struct(v.alias("list"), F.lit(True).alias("visiting")))))
    sizes = found.select("label", "dims", seats.alias("seat")).select("label", "dims", "seat.*").groupBy("label", "dims", "list")
    sizes = sizes.agg(F.sum((~F.col("visiting")).cast("int")).alias("homes"), F.sum(F.col("visiting").cast("int")).alias("guests")).where("homes > 0 and homes + guests > 1")
    sizes = common.save(sizes.select(*(F.col(c).alias(f"__{c}") for c in ("label", "dims", "list")), F.ceil(F.col("homes") / tile).cast("int").alias("h"), F.ceil(F.col("guests") / tile).cast("int").alias("g")))
    rows = found.withColumn("seat", seats).drop("home", "visits").select("*", "seat.*").drop("seat")
    rows = rows.join(sizes, (F.col("label") == F.col("__label")) & (F.col("dims") == F.col("__dims")) & (F.col("list") == F.col("__list"))).drop("__label", "__dims", "__list")
    nth = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    key = lambda i, v, j, mine: F.struct(i.alias("i"), F.lit(v).alias("visiting"), j.alias("j"), mine.alias("mine"))
    some = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    among = F.transform(some("h"), lambda j: key(F.least(nth("h"), j), False, F.greatest(nth("h"), j), nth("h") <= j))
    met = F.transform(some("g"), lambda j: key(nth("h"), True, j, F.lit(True)))
    calls = F.transform(some("h"), lambda i: key(i, True, nth("g"), F.lit(False)))
    rows = rows.withColumn("pair", F.explode(F.when(F.col("visiting"), calls).otherwise(F.concat(among, met)))).drop("visiting", "h", "g").select("*", "pair.*").drop("pair")
    shared = classes.sparkSession.sparkContext.broadcast(indexes)
    left = rows.groupBy(*PAIR).applyInArrow(possible(shared), "label long, dims int, list int, i int, visiting boolean, j int, mine boolean, key binary")
    left = common.save(left, found, sizes)
    vectors = classes.select(F.col("label").alias("__of"), F.col("key").alias("__key"), "rep", "copies", "vec")
    met = left.join(vectors, (F.col("key") == F.col("__key")) & (F.col("label") == F.col("__of"))).drop("__key", "__of")
    return common.save(met.groupBy(*PAIR).applyInArrow(compare(threshold), "a long, b long, n long"), left)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) per row of vectors (vec_id, embedding, label).

    Links join vectors of equal label, length and a cosine of at least ``threshold``. A row whose label, id or vector is
    null, whose vector is empty, zero or holds null or non-finite numbers has no links and is its own component. Vectors
    of every length are compared among themselves, whatever the size of their numbers. Repeated rows are vectors of
    their own; rows of one id are one node. An empty table gives an empty result. Other columns are not looked at.
    """
    rows = common.save(prepare(vectors))
    classes = rows.where("vec is not null").groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    classes = common.save(classes.withColumn("dims", (F.length("vec") / 8).cast("int")))
    found = links(classes, fit(classes, threshold, tile=tile), threshold, tile)
    counts = found.where("n > 0").groupBy(F.col("a").alias("__a")).agg(F.sum("n").alias("n"))
    groups = common.connected_components(found.where("n = 0").select("a", "b")).withColumnRenamed("node", "__node")
    of = classes.join(counts, F.col("rep") == F.col("__a"), "left").join(groups, F.col("rep") == F.col("__node"), "left")
    of = of.select(F.col("label").alias("__label"), F.col("key").alias("__key"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(of, (F.col("label") == F.col("__label")) & (F.col("key") == F.col("__key")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
