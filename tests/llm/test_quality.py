import random
import zlib

import numpy as np
import pytest

from fieldframe.llm import quality


def make(n, seed=3):
    rng = random.Random(seed)
    vocab = ["lorem", "ipsum", "dolor", "sit", "amet", "tempor", "magna", "aliqua", "the", "of"]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randrange(30, 300))
        good = rng.random() < 0.7
        if not good:
            at = rng.randrange(max(1, len(words) - 60))
            kind = rng.randrange(3)
            for k in range(at, len(words)):
                words[k] = (words[k] + "***", words[k].upper() + "!!", "the")[kind]
        docs.append((i, " ".join(words), "en", "s", None))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = make(500)
    d = spark.createDataFrame([*docs, (None, None, None, None, None), (9001, "", "en", "s", 0), (0, docs[0][1], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    y = spark.createDataFrame([*labels, (None, 1, 0), (9001, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(d, quality.fit(d, y)).collect()
    assert len(got) == 503
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_held_out_labels_do_not_matter(spark):
    docs, labels = make(120, 5)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    flip = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    a, b = ({(r.doc_id, r.score) for r in quality.classify(d, quality.fit(d, spark.createDataFrame(y, "doc_id long, quality int, toxic int"))).collect()} for y in (labels, flip))
    assert a == b


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    y = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(d, quality.fit(d, y)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r.score for r in quality.classify(one, quality.fit(one, y)).collect()] == [pytest.approx(0.5, abs=0.5)]


def test_slices_do_not_change_the_passages(monkeypatch):
    text = b"word another *** | x " * 3000
    whole = quality.passages(text)
    assert len(whole) == 5 * 3000 // 50
    monkeypatch.setattr(quality, "SLICE", 1000)
    parts = quality.passages(text)
    assert abs(parts[:, :-1].mean() - whole[:, :-1].mean()) < 0.02


def test_gradient_lowers_the_loss():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(rng.integers(1, 6), quality.FEATURES)).astype(np.float32) for _ in range(80)]
    y = np.array([float((b[:, 0] > 1).any()) for b in bags])
    model = quality.Model().fit(bags, y, steps=200)
    assert np.mean((model.score(bags) > 0.5) == y) > 0.9


def small_model():
    model, rng = quality.Model(width=5, gate=3, seed=2), np.random.default_rng(4)
    model.p["c"], model.p["b"] = rng.normal(size=5), rng.normal(size=1)
    bags = [rng.normal(size=(n, quality.FEATURES)) for n in (1, 4, 2, 7)]
    return model, bags, np.array([1.0, 0.0, 0.0, 1.0])


def plain_score(p, bag):
    """The same model, passage by passage."""
    from math import exp, tanh

    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    hidden = [[tanh(dot(x, p["E"][:, k]) + p["e"][k]) for k in range(len(p["e"]))] for x in bag]
    gates = [sum(tanh(dot(h, p["V"][:, k])) / (1 + exp(-dot(h, p["U"][:, k]))) * p["w"][k] for k in range(len(p["w"]))) for h in hidden]
    total = sum(map(exp, gates))
    z = [sum(exp(g) / total * h[k] for g, h in zip(gates, hidden, strict=True)) for k in range(len(p["e"]))]
    return 1 / (1 + exp(-dot(z, p["c"]) - p["b"][0]))


def flat(bags):
    counts = np.array([len(b) for b in bags])
    return np.vstack(bags), np.cumsum(counts) - counts, counts


def test_forward_pass_against_plain_arithmetic():
    model, bags, _ = small_model()
    assert np.allclose(model._forward(*flat(bags))[-1], [plain_score(model.p, b) for b in bags])


def test_gradients_against_differences():
    model, bags, y = small_model()
    grads = model._gradients(*flat(bags), y)

    def loss():
        s = model._forward(*flat(bags))[-1]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    rng = np.random.default_rng(1)
    for name, g in grads.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in g.shape)
            before = model.p[name][at]
            model.p[name][at] = before + 1e-5
            above = loss()
            model.p[name][at] = before - 1e-5
            below = loss()
            model.p[name][at] = before
            assert abs((above - below) / 2e-5 - g[at]) < 1e-6


def test_held_out_accuracy_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out and quality is not null").collect()
    right = np.mean([r.predicted == r.quality for r in got])
    assert len(got) > 50 and right > 0.95 and right > max(np.mean([r.quality for r in got]), 0.5) + 0.02


def test_all_passages_of_a_long_text_count(spark):
    words = ["w%d" % k for k in range(5000)]
    d = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    y = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    (row,) = quality.training_rows(d, y).collect()
    assert len(row.bag) == 100 * quality.FEATURES * 4


def test_names_may_clash(spark):
    docs, labels = make(60, 8)
    names = "doc_id long, text string, score string, __score int, quality string"
    d = spark.createDataFrame([(i, t, "x", 1, "y") for i, t, *_ in docs] + [(None, None, "x", 1, "y"), (3, "", "x", 1, "y")], names)
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = quality.keep_good(d, y, 0.0)
    assert kept.columns == d.columns and kept.count() == 62
    assert quality.classify(d, quality.fit(d, y)).count() == 62
    with pytest.raises(ValueError, match="already"):
        quality.score(d, quality.Model(), "Score")
