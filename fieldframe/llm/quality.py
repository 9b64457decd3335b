"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is described by counts of byte classes and their pairs, word lengths and
repeated words, and encoded by a learned layer; gated attention, learned from document labels alone, weights the
passages, and the weighted representation is scored by a logistic layer (Ilse, Tomczak, Welling 2018).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words in a passage.
PASSAGE = 50
#: Bound of the labelled rows that the model is fitted to; of each, every passage is used, as in scoring.
FIT_ROWS = 4000
SLICE = 1 << 20
SPACE, LOWER, UPPER, DIGIT, HIGH, STOP, BAR, BANG, QUOTE, OTHER = range(10)
KINDS = 10


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.int64)
    out[128:] = HIGH
    for kind, chars in ((SPACE, b" \t\n\x0b\x0c\r"), (DIGIT, b"0123456789"), (STOP, b".,;:?"), (BAR, b"|<>{}[]=_\\/"), (BANG, b"!"), (QUOTE, b"\"'()-")):
        out[list(chars)] = kind
    out[97:123] = LOWER
    out[65:91] = UPPER
    return out


CLASS = _classes()
FEATURES = KINDS + KINDS * KINDS + 5


def _slices(data: bytes):
    """The text in parts of about SLICE bytes, cut at white space."""
    at = 0
    while len(data) - at > SLICE:
        cut = next((k for k in range(at + SLICE, min(len(data), at + 2 * SLICE)) if data[k] in b" \t\n\r"), min(len(data), at + 2 * SLICE))
        yield data[at:cut]
        at = cut
    yield data[at:]


def passages(data: bytes) -> np.ndarray:
    """A row of FEATURES for each passage of the text; one row of zeros if it has no words."""
    rows = []
    for part in _slices(data):
        words = part.split()
        if not words:
            continue
        raw = np.frombuffer(part, np.uint8)
        kind = CLASS[raw]
        inside = kind != SPACE
        begins = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
        n = -(-len(words) // PASSAGE)
        of = np.repeat(np.arange(n), np.diff(np.r_[0, begins[PASSAGE::PASSAGE], len(raw)]))
        one = np.bincount(of * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS)
        pair = KINDS * KINDS
        two = np.bincount(of[1:] * pair + kind[:-1] * KINDS + kind[1:], minlength=n * pair).reshape(n, pair)
        size = np.maximum(one.sum(1, keepdims=True), 1)
        length = np.fromiter(map(len, words), np.float64, len(words))
        code = np.fromiter(map(hash, words), np.int64, len(words))
        same = np.r_[False, code[1:] == code[:-1]].astype(float)
        nth = np.arange(0, len(words), PASSAGE)
        count = np.diff(np.r_[nth, len(words)])
        # Distinct words in a passage: each passage's codes sorted; the last one is filled with values of its own.
        grid = np.r_[code, np.arange(n * PASSAGE - len(words)) - (1 << 62)].reshape(n, PASSAGE)
        grid.sort(axis=1)
        distinct = 1 + (grid[:, 1:] != grid[:, :-1]).sum(1) - (PASSAGE - count)
        mean = np.add.reduceat(length, nth) / count
        spread = np.sqrt(np.maximum(np.add.reduceat(length**2, nth) / count - mean**2, 0))
        extra = np.stack((mean / 10, np.minimum(spread, 100) / 10, np.add.reduceat(same, nth) / count, distinct / count, count / PASSAGE), axis=1)
        rows.append(np.hstack((np.sqrt(one / size), np.sqrt(two / size), extra)).astype(np.float32))
    return np.vstack(rows) if rows else np.zeros((1, FEATURES), np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Encoder h = tanh(xE + e), attention a = softmax(tanh(hV) * sigmoid(hU) w), score = sigmoid(sum(a h) c + b)."""

    def __init__(self, width: int = 24, gate: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "E": rng.normal(0, FEATURES**-0.5, (FEATURES, width)), "e": np.zeros(width),
            "V": rng.normal(0, width**-0.5, (width, gate)), "U": rng.normal(0, width**-0.5, (width, gate)), "w": rng.normal(0, gate**-0.5, gate),
            "c": np.zeros(width), "b": np.zeros(1),
        }
        self.mean, self.std = np.zeros(FEATURES), np.ones(FEATURES)

    def _forward(self, x: np.ndarray, starts: np.ndarray, counts: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a = (t * s) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), counts))
        a /= np.repeat(np.add.reduceat(a, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts)
        return h, t, s, a, z, _sigmoid(z @ p["c"] + p["b"])

    def _gradients(self, x: np.ndarray, starts: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of the bags."""
        p = self.p
        h, t, s, a, z, score = self._forward(x, starts, counts)
        d = (score - labels) / len(labels)
        dz = np.repeat(d[:, None] * p["c"], counts, axis=0)
        da = (dz * h).sum(1)
        da = a * (da - np.repeat(np.add.reduceat(a * da, starts), counts))
        dt, ds = da[:, None] * p["w"] * s * (1 - t**2), da[:, None] * p["w"] * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h**2)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ da, "c": z.T @ d, "b": d.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, steps: int = 120, rate: float = 0.02, decay: float = 1e-4) -> Model:
        """Full-batch Adam on the mean log loss of the bags."""
        if not bags:
            return self
        x, counts = np.vstack(bags).astype(np.float32), np.array([len(b) for b in bags])
        starts = np.cumsum(counts) - counts
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        x = np.clip((x - self.mean) / self.std, -6, 6).astype(np.float32)
        self.p = {k: q.astype(np.float32) for k, q in self.p.items()}
        labels = labels.astype(np.float32)
        p, m, v = self.p, {k: np.zeros_like(q) for k, q in self.p.items()}, {k: np.zeros_like(q) for k, q in self.p.items()}
        for step in range(1, steps + 1):
            grads = self._gradients(x, starts, counts, labels)
            for k, g in grads.items():
                g = g + decay * p[k]
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.empty(0)
        counts = np.array([len(b) for b in bags])
        x = np.clip((np.vstack(bags) - self.mean) / self.std, -6, 6).astype(np.float32)
        return self._forward(x, np.cumsum(counts) - counts, counts)[-1].astype(np.float64)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(bag, quality) of at most ``rows`` labelled documents whose crc32(doc_id) mod 4 is not 2, in the order of a hash of
    their ids. Several labels of one id are averaged; null labels and ids count as none."""
    known = labels.where("doc_id is not null and quality is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.avg("quality").alias("quality"))
    order = [F.xxhash64("__id"), F.col("__id")]
    known = known.orderBy(*order).limit(rows)  # at most ``rows`` ids: a proven bound for the broadcast
    chosen = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").join(F.broadcast(known), "__id")

    def run(batches):
        for b in batches:
            out = [passages(t or b"").tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("quality"), pa.array(out, pa.binary())], ["__id", "quality", "bag"])

    bags = chosen.select("__id", "quality", "text").mapInArrow(run, "__id long, quality double, bag binary")
    return bags.orderBy(*order, "bag").limit(rows).select("bag", "quality")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    found = training_rows(docs, labels, rows).collect()
    bags = [np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES) for r in found]
    return Model().fit(bags, np.array([r.quality for r in found]))


def score(docs: DataFrame, model: Model, to: str = "score") -> DataFrame:
    """docs with a further column ``to`` (0 to 1; higher: label 1 likelier) from the whole text alone. A null text scores as
    an empty one; repeated rows stay and score alike; an empty table gives an empty result; a text of any length is read
    in slices. The other columns pass through; one that is called ``to`` is an error."""
    names = docs.columns
    if to.lower() in (c.lower() for c in names):
        raise ValueError(f"there is a column {to!r} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index("text")

    def run(batches):
        for b in batches:
            out = []
            for k in range(0, len(b), 64):
                bags = [passages(t or b"") for t in b.column(at).slice(k, 64).cast(pa.binary()).to_pylist()]
                out.append(shared.value.score(bags))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())], [*names, to])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, `{to}` double")


def classify(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. A null text counts as empty; a null doc_id is not held out;
    repeated rows stay; with no label to learn from every score is 0.5."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that the classifier, fitted on the labelled ones among them, predicts to be good. Null and empty
    texts are scored like others; repeated rows go or stay together; rows with a null id stay by their text alone; with
    no label to learn from every score is 0.5, so with a threshold above it none stays; an empty table gives an empty
    result. Columns may have any names."""
    mark = common.unused(docs, "score")
    return score(docs, fit(docs, labels), mark).where(F.col(mark) >= threshold).drop(mark)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return classify(docs, fit(docs, labels))
