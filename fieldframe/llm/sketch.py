"""Threshold-scaled sketches (FracMinHash) of documents.

A sketch holds every shingle hash below a fixed fraction of the hash range, so the sketch of a union is the union of the
sketches, and the containment of one document in another is estimated without bias however unequal they are. A document
none of whose hashes is that low holds its smallest one instead; a merge keeps such a hash only while nothing lower joins.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .simhash import text_hashes

SIZE = 5
FRACTION = 1 / 8


def limit(fraction: float) -> np.uint64:
    return np.uint64(min(int(fraction * 2**64), 2**64 - 1))


def sketch(text: str | bytes, size: int = SIZE, fraction: float = FRACTION) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles that lie below the fraction; at least the smallest one."""
    hashes = np.unique(text_hashes(text.encode() if isinstance(text, str) else text, size))
    return hashes[: max(int(np.searchsorted(hashes, limit(fraction))), 1)]


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of both documents' shingles together."""
    both = np.union1d(a, b)
    return both[: max(int(np.searchsorted(both, limit(fraction))), 1)]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has too; 1 if a has none."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment of the smaller sketch in the larger one; two empty sketches are alike, an empty and another are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common_ = len(np.intersect1d(a, b, assume_unique=True))
    return common_ / (len(a) + len(b) - common_)


def encode(hashes: np.ndarray) -> str:
    """16 hex digits a hash, in order."""
    return hashes.astype(">u8").tobytes().hex()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def sketches(docs: DataFrame, size: int = SIZE, fraction: float = FRACTION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; a null text counts as empty."""

    def run(batches):
        for b in batches:
            prints = [encode(sketch(t or b"", size, fraction)) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the text's code points replaced by the first as many of the following text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


#: Output columns of ``against_next``.
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double"


def chained(batches):
    """Rows (range, guest, doc_id, text) sorted by range, then in the order of the chain -> the output rows.

    A guest is the first row of the following range: it ends its range's chain and gives no row itself.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64() if c.endswith("long") else pa.string() if c.endswith("string") else pa.float64() for c in SCHEMA.split(", ")]
    last = None  # (range, doc_id, text, sketch) that awaits its successor
    rows = []
    for b in batches:
        part, ids, guests = b.column("range").to_pylist(), b.column("doc_id").to_pylist(), b.column("guest").to_pylist()
        texts = b.column("text")
        for k in range(len(b)):
            text = texts[k].as_py() or ""
            own = sketch(text)
            if last is not None and last[0] == part[k]:
                change = edited(last[2], text)
                after = sketch(change)
                rows.append((last[1], len(last[2]), hashlib.sha256(change.encode()).hexdigest(), encode(last[3]), encode(after), likeness(last[3], after), likeness(last[3], own), jaccard(last[3], after), jaccard(last[3], own)))
            last = None if guests[k] else (part[k], ids[k], text, own)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows = []


def against_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Every row with its edited text's sketch and how alike its own is to that and to the next row's.

    Next: by descending doc_id, null ids last, repeated ids in the order of their texts; after the last row comes the
    first. The ids' quantiles cut the rows into ranges, and the first row of each range is also sent to the one before it
    as a guest, so a single shuffle brings every row beside its successor. A null text counts as empty; a table of one row
    is its own successor; an empty table gives an empty result; columns other than doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.where("doc_id is not null").approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (8 * n)))) if n > 1 else []
    ranger = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="at", outputCol="range") if cuts else None

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("at", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
        return (ranger.transform(df) if ranger else df.withColumn("range", F.lit(0.0))).withColumn("range", F.col("range").cast("int")).drop("at")

    # The first id of each range, in the order of the chain: a row for each range.
    firsts = placed(rows.select("doc_id")).groupBy("range").agg(F.max("doc_id").alias("first")).orderBy(F.desc("range")).collect()
    before = [(r["range"], r["first"], firsts[k - 1]["range"]) for k, r in enumerate(firsts)]
    heads = F.broadcast(spark.createDataFrame(before, "range int, first long, before int"))
    home = F.struct("range", F.lit(False).alias("guest"))
    visit = F.struct(F.col("before").alias("range"), F.lit(True).alias("guest"))
    seats = F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.array(home, visit)).otherwise(F.array(home))
    dealt = placed(rows).join(heads, "range").select("doc_id", "text", F.explode(seats).alias("seat")).select("seat.*", "doc_id", "text")
    order = ["range", "guest", F.desc_nulls_last("doc_id"), "text"]
    return dealt.repartitionById(max(len(cuts) + 1, 1), F.col("range")).sortWithinPartitions(*order).mapInArrow(chained, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return against_next(common.table(spark, sf_dir, "documents"))
