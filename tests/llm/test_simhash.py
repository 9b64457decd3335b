import random

import xxhash

from fieldframe.llm import simhash
from tests.llm.util import rows_of


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(docs, radius=4):
    prints = [(i, brute_print(t)) for i, t in docs]
    group = {i: i for i, _ in prints if i is not None}
    changed = True
    while changed:
        changed = False
        for i, f in prints:
            for j, g in prints:
                if i is not None and j is not None and (f ^ g).bit_count() <= radius and group[j] < group[i]:
                    group[i], changed = group[j], True
    return {(i, f, group.get(i)) for i, f in prints}


def texts(n=150, seed=1):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            words = rng.choice(out).split(" ")
            for _ in range(rng.choice((0, 1, 2))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = rng.choices(vocab, k=rng.choice((1, 5, 40, 200)))
        out.append(" ".join(words))
    return out


def test_against_brute_force(spark):
    docs = list(enumerate(texts())) + [(900, None), (901, ""), (902, " \t\n"), (903, "ÀB  c\x0bD"), (7, texts()[7])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for tile in (4, 512):
        got = simhash.components(df, tile=tile).collect()
        assert len(got) == len(docs)
        assert {(r.doc_id, r.fp % 2**64, r.component_id) for r in got} == brute(docs)


def test_blocks_of_every_width_find_the_same(spark):
    docs = list(enumerate(texts(80, 3)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for spare in (1, 2, 3):
        assert {(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.components(df, spare=spare).collect()} == brute(docs)


def test_nulls_empty_and_extra_columns(spark):
    schema = "doc_id long, text string, fp string, rep int, component_id string"
    assert simhash.components(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e", "x", 1, "y"), (5, "a b c d e", None, None, None), (None, "other", "x", 1, "y")], schema)
    got = {(r.doc_id, r.component_id) for r in simhash.components(df).collect()}
    assert got == {(None, 5), (5, 5), (None, None)}
    assert rows_of(simhash.keep_one(df)) == 3


def test_long_text_and_many_near_copies(spark):
    long = " ".join("v%d" % (i % 977) for i in range(200_000))
    base = texts(1, 9)[0].split(" ") * 3
    docs = [(0, long), (1, long)] + [(2 + i, " ".join(base + ["z%d" % i])) for i in range(60)]
    got = simhash.components(spark.createDataFrame(docs, "doc_id long, text string"), tile=8).collect()
    assert {(r.doc_id, r.fp % 2**64, r.component_id) for r in got} == brute(docs)


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, vocab, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(vocab)
    return words


def test_links_of_shingles(spark):
    """Every link is a pair of similarity 0.8 or more, and all but very few such pairs are found."""
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(5000)]
    docs = []
    for _ in range(150):
        words = rng.choices(vocab, k=rng.choice((60, 250, 800)))
        docs.append(" ".join(words))
        docs.append(" ".join(edited(rng, words, vocab, rng.randrange(0, max(1, len(words) // 25)))))
    docs = list(enumerate(docs))
    sets = [shingles(t) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if share(sets[i], sets[j]) >= 0.8]
    below = sum(share(sets[k], sets[k + 1]) < 0.8 for k in range(0, len(docs), 2))
    assert len(links) > 60 and below > 20
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for tile in (16, 4096):
        got = {r.doc_id: r.component_id for r in simhash.similar(df, tile=tile).collect()}
        found = [(i, got[i]) for i in got if got[i] != i]
        assert set(found) <= set(links)
        assert len(found) >= 0.95 * len(links)
        assert sorted(r.doc_id for r in simhash.keep_one(df, tile=tile).collect()) == sorted(set(got.values()))


def test_recall_of_proposals():
    """The shares that the docstring of ``similar`` states, over sets of random shingles."""
    import numpy as np

    rng = np.random.default_rng(2)
    for at, least in ((0.8, 0.94), (0.85, 0.98), (0.9, 0.995)):
        found = 0
        for _ in range(300):
            n = 400
            both = round(2 * n * at / (1 + at))
            h = rng.integers(0, 2**64, 2 * n - both, dtype=np.uint64)
            apart = np.bitwise_count(simhash.words_of(h[:n], 4) ^ simhash.words_of(h[n - both :], 4))
            found += apart.min() <= 10 and apart.sum() <= 56
        assert found >= least * 300


def test_keep_one_with_odd_rows_and_names(spark):
    schema = "doc_id long, text string, kept string, __id long, KEPT2 int"
    rows = [(3, "one two three four five six", "a", 1, 1), (1, "one two three four five six", "b", 2, 2), (2, None, "c", 3, 3), (5, "", "d", 4, 4), (1, "one two three four five six", "b", 2, 2), (None, "x", "e", 5, 5), (7, "one two", None, None, None), (8, "two one", None, None, None)]
    got = simhash.keep_one(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "kept", "__id", "KEPT2"]
    assert sorted((r.doc_id or 0, r.kept or "") for r in got.collect()) == [(0, "e"), (1, "b"), (1, "b"), (2, "c"), (7, ""), (8, "")]
    assert simhash.keep_one(spark.createDataFrame([], schema)).count() == 0
