import hashlib
import random

import numpy as np
import xxhash

from fieldframe.llm import sketch

FIELDS = [c.split()[0] for c in sketch.SCHEMA.split(", ")]


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def brute_sketch(text):
    hashes = sorted({xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text)})
    return [h for h in hashes if h < 2**64 // 8] or hashes[:1]


def share(a, b):
    return float(a == b) if not a or not b else len(set(a) & set(b)) / min(len(a), len(b))


def texts(n=120, seed=5):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(500)]
    out = [" ".join(rng.choices(vocab, k=rng.choice((0, 1, 4, 50, 400)))) for _ in range(n)]
    return [rng.choice(out) if rng.random() < 0.2 else t for t in out]


def test_rows_against_brute_force(spark):
    docs = [(3 * i, t) for i, t in enumerate(texts())] + [(7, "é" * 30 + " two three four five six"), (8, None), (9, "w1 " * 60_000)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, range string")
    order = sorted(((i, t or "") for i, t in docs), key=lambda d: (-d[0], d[1]))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        n = len(t) // 2
        change = t[: len(t) - n] + after[:n]
        a, e, b = brute_sketch(t), brute_sketch(change), brute_sketch(after)
        hexed = lambda s: "".join("%016x" % h for h in s)
        want.append((i, len(t), hashlib.sha256(change.encode()).hexdigest(), hexed(a), hexed(e), share(a, e), share(a, b)))
    for ranges in (1, 5, 40):
        assert sorted(tuple(r)[:7] for r in sketch.against_next(df, ranges).collect()) == sorted(want)


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert sketch.against_next(spark.createDataFrame([], schema)).count() == 0
    (row,) = sketch.against_next(spark.createDataFrame([(5, "a b c d e f")], schema)).collect()
    assert (row.doc_id, row.near_next) == (5, 1.0)
    same = sketch.against_next(spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "z"), (None, None), (2, "x y")], schema), 3).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_chars) for r in same if r.doc_id is not None) == [(False, 1, 3), (False, 1, 3), (False, 2, 3)]
    assert len(same) == 5


def test_sketches_merge_and_estimate(spark):
    rng = np.random.default_rng(0)
    a, b = (" ".join("t%d" % k for k in rng.integers(0, 10**9, 4000)) for _ in range(2))
    x, y = sketch.sketch(a), sketch.sketch(b)
    union = {xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(a) | shingles(b)}
    assert sketch.merge(x, y).tolist() == sorted(h for h in union if h < 2**64 // 8)
    short = " ".join(a.split()[1000:1600])
    assert sketch.containment(sketch.sketch(short), x) == 1.0
    assert abs(sketch.containment(x, sketch.sketch(short)) - 596 / 3996) < 0.06
    assert sketch.decode(sketch.encode(x)).tolist() == x.tolist()
    assert sketch.merge(sketch.sketch("one"), np.empty(0, np.uint64)).tolist() == sketch.sketch("one").tolist()
    df = spark.createDataFrame([(1, a), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.fingerprint for r in sketch.sketches(df).collect()} == {1: sketch.encode(x), 2: ""}
