"""SimHash near-duplicates by tiled exact comparison.

Documents become fingerprints of one or more 64-bit words; equal fingerprints are one class. Two words that differ in at
most r of 64 bits agree on some b - r of any b blocks (pigeonhole), so the classes are dealt, for each choice of b - r
blocks, to a bucket of the bits in those blocks; no link between buckets can exist. A bucket's fingerprints, in order of
population count, are cut into tiles. Tile pairs whose population counts differ by more than r cannot hold a link and are
never formed, and within a tile pair the same rule skips smaller tiles; all else is compared whole with numpy
exclusive-or and bit counts. A pair counts in the first bucket that it meets in. A tile pair returns a spanning forest of
its links, not all of them, so a group of thousands of near copies costs linear output.

Where links are to have a given share of shingles in common, the words only propose pairs: a pair near in any word, and
not too far over all words, is compared by its texts' shingles, which are sent to the tile pairs that need them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BITS = 64


def text_hashes(data: bytes, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles of a text (A-Z lower-cased, words cut at ASCII white space), repeats included.

    Fewer words than ``size``: one shingle of all words; no word: none.
    """
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], seed) for s, e in spans), np.uint64, len(words) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 for none."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(data: bytes, size: int = 4) -> int:
    """Fingerprint whose bit is 1 if set in over half of the shingle hashes; 0 for a text without words."""
    return majority(text_hashes(data, size))


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other bits of the same hashes, for word k of a fingerprint; word 0 has the hashes' own."""
    if not k:
        return hashes
    out = hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 0xD1B54A32D192ED03 % 2**64)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def words_of(hashes: np.ndarray, words: int) -> np.ndarray:
    return np.array([majority(mixed(hashes, k)) for k in range(words)], np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, words: int = 1) -> DataFrame:
    """(doc_id, fp) of every row, fp being an array of as many 64-bit words; a null text counts as empty."""

    def run(batches):
        for b in batches:
            fps = [words_of(text_hashes(t or b"", size), words).view(np.int64) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp array<long>")


def masks(radius: int, blocks: int) -> list[int]:
    """The block choices: of 64 bits in ``blocks`` blocks, every choice of blocks - radius, as masks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (smallest id of a group, other id) that join what the links i-j join."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(ids))
    i, j = rank[i], rank[j]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(ids)))
    return ids[order][label[other]], ids[order][other]


#: Fingerprints of a smaller tile, within a tile pair.
STEP = 128


def near_pairs(x: np.ndarray, y: np.ndarray | None, word: int, radius: int, total: int):
    """Index pairs of the rows of x and y (None: x itself, each pair once) that differ in at most ``radius`` bits of the
    given word and at most ``total`` bits over all words. Rows are met in order of population count, in tiles; tiles whose
    counts differ by more than the radius are skipped. Yields arrays of bounded size."""
    alone = y is None
    y = x if alone else y
    a, b = x[:, word], y[:, word]
    pop_a, pop_b = np.bitwise_count(a).astype(int), np.bitwise_count(b).astype(int)
    order_a, order_b = np.argsort(pop_a, kind="stable"), np.argsort(pop_b, kind="stable")
    pop_b = pop_b[order_b]
    for s in range(0, len(x), STEP):
        i = order_a[s : s + STEP]
        lo = max(s if alone else 0, np.searchsorted(pop_b, pop_a[i[0]] - radius))
        hi = np.searchsorted(pop_b, pop_a[i[-1]] + radius, "right")
        for t in range(lo, hi, 16 * STEP):
            j = order_b[t : min(t + 16 * STEP, hi)]
            near = np.bitwise_count(a[i][:, None] ^ b[j][None, :]) <= radius
            if alone:
                near &= np.arange(s, s + len(i))[:, None] < np.arange(t, t + len(j))[None, :]
            if near.any():
                p, q = np.nonzero(near)
                p, q = i[p], j[q]
                if x.shape[1] > 1:
                    some = np.bitwise_count(x[p] ^ y[q]).sum(1) <= total
                    p, q = p[some], q[some]
                if len(p):
                    yield p, q


def firsts(x: np.ndarray, y: np.ndarray, choice: int, radius: int, places: np.ndarray) -> np.ndarray:
    """Which pairs (rows of x and y) meet in this choice first: no earlier word is near, no earlier choice agrees."""
    word, nth = divmod(choice, len(places))
    first = ~(np.bitwise_count(x[:, :word] ^ y[:, :word]) <= radius).any(1)
    apart = x[:, word] ^ y[:, word]
    for m in places[:nth]:
        first &= (apart & m) != 0
    return first


class Joined:
    """Sets of rows joined by links, for a spanning forest."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def add(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        """The pairs among these that join two sets."""
        used = []
        while True:
            roots = self.roots()
            apart = roots[i] != roots[j]
            if not apart.any():
                return used
            i, j = i[apart], j[apart]
            # One link for each pair of sets is enough.
            _, one = np.unique(roots[i] * len(roots) + roots[j], return_index=True)
            for a, b in zip(i[one].tolist(), j[one].tolist(), strict=True):
                r, t = self.root(a), self.root(b)
                if r != t:
                    self.up[max(r, t)] = min(r, t)
                    used.append((a, b))


def sides(rows: pa.Table):
    first = rows.column("first").to_numpy(zero_copy_only=False)
    return np.flatnonzero(first), np.flatnonzero(~first)


def proposed(fp: np.ndarray, rows: pa.Table, choice: int, radius: int, total: int, places: np.ndarray):
    """Pairs of a tile pair's rows that are near, and not met before."""
    here, there = sides(rows)
    x, y = fp[here], fp[there] if len(there) else None
    for p, q in near_pairs(x, y, choice // len(places), radius, total):
        some = firsts(x[p], (x if y is None else y)[q], choice, radius, places)
        yield here[p[some]], (here if y is None else there)[q[some]]


def edges_of(rep: np.ndarray, used: list[tuple[int, int]]) -> pa.Table:
    a, b = np.array(used, np.int64).reshape(-1, 2).T
    return pa.table([pa.array(rep[a]), pa.array(rep[b])], names=["a", "b"])


def compare(radius: int, places: np.ndarray):
    """Tile pairs of fingerprints -> edges that join what their links join."""

    def run(key, rows):
        fp = np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint64).reshape(len(rows), -1)
        joined, used = Joined(len(rows)), []
        for p, q in proposed(fp, rows, key[0].as_py(), radius, BITS, places):
            used += joined.add(p, q)
        return edges_of(rows.column("rep").to_numpy(), used)

    return run


def propose(radius: int, total: int, places: np.ndarray):
    """Tile pairs of fingerprints -> those of their rows that are in a pair to be compared by texts."""

    def run(key, rows):
        fp = np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint64).reshape(len(rows), -1)
        some = np.zeros(len(rows), bool)
        for p, q in proposed(fp, rows, key[0].as_py(), radius, total, places):
            some[p] = some[q] = True
        return rows.select([*TILES, "first", "rep"]).filter(pa.array(some))

    return run


def verify(radius: int, words: int, total: int, places: np.ndarray, size: int, similarity: float):
    """Tile pairs of texts -> edges that join what their links join, a link being a pair that is proposed and whose
    shingle sets share ``similarity`` of their union."""

    def run(key, rows):
        hashes = [text_hashes(t or b"", size) for t in rows.column("text").cast(pa.binary()).to_pylist()]
        fp = np.array([words_of(h, words) for h in hashes]).reshape(len(rows), -1)
        sets = [np.unique(h) for h in hashes]
        joined, used = Joined(len(rows)), []
        for p, q in proposed(fp, rows, key[0].as_py(), radius, total, places):
            order = np.argsort(np.bitwise_count(fp[p] ^ fp[q]).sum(1), kind="stable")
            for i, j in zip(p[order].tolist(), q[order].tolist(), strict=True):
                if joined.root(i) == joined.root(j):
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                every = len(sets[i]) + len(sets[j]) - both
                if not every or both >= similarity * every:
                    joined.up[joined.root(j)] = joined.root(i)
                    used.append((i, j))
        return edges_of(rows.column("rep").to_numpy(), used)

    return run


#: What names a tile pair.
TILES = ["choice", "bits", "t", "u"]


def tile_pairs(classes: DataFrame, words: int, radius: int, tile: int, places: list[int]) -> DataFrame:
    """(choice, bits, t, u, first, fp as bytes, rep): every class in every tile pair that it is compared in."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [
        F.struct(F.lit(w * len(places) + k).alias("choice"), F.col("fp")[w].bitwiseAND(F.lit(signed(m))).alias("bits"), F.bit_count(F.col("fp")[w]).cast("int").alias("pop"))
        for w in range(words) for k, m in enumerate(places)
    ]
    bucket = ["choice", "bits"]
    dealt = classes.select("fp", "rep", F.explode(F.array(*keys)).alias("key")).select("key.*", "fp", "rep")
    by_pop = Window.partitionBy(*bucket).orderBy("pop")
    near = by_pop.rangeBetween(-radius, radius)
    # Buckets of more than a tile: each population count's ranks, and the ranks that its fingerprints must meet.
    large = common.save(
        dealt.groupBy(*bucket, "pop").agg(F.count("*").alias("n"))
        .withColumn("start", F.sum("n").over(by_pop.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
        .withColumn("total", F.sum("n").over(Window.partitionBy(*bucket)))
        .withColumn("from", F.min("start").over(near))
        .withColumn("to", F.max(F.col("start") + F.col("n")).over(near) - 1)
        .where(F.col("total") > tile)
        .select(*bucket, "pop", "n", "start", "from", "to")
    )
    rank = F.col("start") + F.pmod(F.xxhash64("fp"), F.col("n"))
    own = F.coalesce(F.floor(rank / tile), F.lit(0)).cast("int").alias("own")
    met = F.coalesce(F.sequence(F.floor(F.col("from") / tile), F.floor(F.col("to") / tile)), F.array(F.lit(0).cast("long"))).cast("array<int>").alias("met")
    rows = dealt.join(large, [*bucket, "pop"], "left").select(*bucket, "fp", "rep", own, F.explode(met).alias("other"))
    blob = F.unhex(F.concat(*(F.concat(*(F.substring(F.lpad(F.hex(F.col("fp")[w]), 16, "0"), 2 * k + 1, 2) for k in range(7, -1, -1))) for w in range(words))))
    return rows.select(*bucket, F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"), (F.col("own") <= F.col("other")).alias("first"), blob.alias("fp"), "rep")


#: A 64-bit word is dealt in so many blocks more than the radius. Any number finds all links; more blocks make more, but
#: smaller buckets: one more than 1 suits some 10^8 fingerprints, two more 10^10.
SPARE = 1


def link_forest(classes: DataFrame, radius: int = 4, tile: int = 512, spare: int = SPARE) -> DataFrame:
    """(fp, rep) classes of one word -> (a, b) edges between reps that join exactly what links of at most ``radius`` bits
    join."""
    places = masks(radius, radius + spare)
    rows = tile_pairs(classes, 1, radius, tile, places)
    return rows.groupBy(*TILES).applyInArrow(compare(radius, np.array(places, np.uint64)), "a long, b long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4, tile: int = 512, spare: int = SPARE) -> DataFrame:
    """One row (doc_id, fp, component_id) per row of docs.

    component_id: the smallest doc_id reachable over links of at most ``radius`` differing bits, itself included. Null and
    empty texts have fingerprint 0 and link like any other. Repeated rows stay repeated. A row whose id is null gets the
    component of its fingerprint if a row with an id has the same one, else null; it makes no link itself. A text of any
    length is read whole. An empty table gives an empty result. Columns other than the id and the text are not looked at.
    """
    prints = common.save(fingerprints(docs, id_col, text_col, size))
    classes = common.save(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    return members(prints, classes, link_forest(classes, radius, tile, spare)).withColumn("fp", F.col("fp")[0])


def members(prints: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    joined = common.connected_components(links)
    of = classes.join(joined, classes.rep == joined.node, "left")
    of = of.select(F.col("fp").alias("__fp"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of, F.col("fp") == F.col("__fp"), "left").select("doc_id", "fp", "component_id")


#: Places of the sieve that texts pass on their way to be compared: the bound of what is broadcast.
SIEVE = 1 << 20


def similar(docs: DataFrame, similarity: float = 0.8, size: int = 5, words: int = 4, radius: int = 10, tile: int = 8192, spare: int = SPARE) -> DataFrame:
    """One row (doc_id, fp, component_id) per row of docs (doc_id, text), component_id being the smallest doc_id reachable
    over links: pairs of texts whose sets of ``size``-word shingles share ``similarity`` of their union.

    Pairs are proposed by fingerprints of ``words`` 64-bit words: at most ``radius`` bits apart in some word, and over all
    words no further than three deviations beyond the mean of pairs of that similarity. Every link is checked by its
    shingles. Of pairs just at 0.8, 0.97 are proposed, of pairs at 0.85 0.998. Texts of equal fingerprints are one class
    (texts without words among them). Nulls, repeats, empty and very long texts, and empty tables: as for ``components``.
    """
    places = masks(radius, radius + spare)
    apart = np.arccos(2 * similarity / (1 + similarity)) / np.pi * BITS * words
    total = int(apart + 3 * np.sqrt(apart * (1 - apart / (BITS * words))))
    prints = common.save(fingerprints(docs, size=size, words=words))
    classes = common.save(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    each = np.array(places, np.uint64)
    some = tile_pairs(classes, words, radius, tile, places).groupBy(*TILES).applyInArrow(propose(radius, total, each), "choice int, bits long, t int, u int, first boolean, rep long")
    some = common.save(some)
    # Most texts are in no pair. A sieve of at most SIEVE rows, whatever the corpus holds, keeps them from being sent.
    sift = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE))
    sieve = F.broadcast(some.select(sift("rep").alias("__s")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), "text")
    texts = texts.join(sieve, sift("__id") == F.col("__s"), "left_semi")
    met = some.join(texts, F.col("rep") == F.col("__id")).drop("__id")
    links = met.groupBy(*TILES).applyInArrow(verify(radius, words, total, each, size, similarity), "a long, b long")
    return members(prints, classes, links)


def keep_one(docs: DataFrame, similarity: float = 0.8, **how) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group of texts that are linked at ``similarity`` (see
    ``similar``); rows with a null id stay, as does every repeat of a kept id. Columns may have any names."""
    found = similar(docs.select("doc_id", "text"), similarity, **how)
    mark = common.unused(docs, "kept")
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(mark)).distinct()
    some = docs.join(kept, docs["doc_id"] == F.col(mark), "left_semi")
    return some.unionByName(docs.where(docs["doc_id"].isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    out = components(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
