import random
import re

from fieldframe.llm import substring


def brute_runs(text, run=3, words=31):
    """(words with their places, {(first, end): whether it is a part})."""
    ws = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^ \t\n\r\x0b\x0c]+", text)]

    units, now = [], 0
    for k, (w, _, e) in enumerate(ws):
        if w[-1] in ".!?" or k + 1 == len(ws) or "\n" in text[e : ws[k + 1][1]]:
            units.append((now, k + 1))
            now = k + 1
    out = {}
    for s in range(len(units)):
        e = next((e for e in range(s + run, len(units) + 1) if units[e - 1][1] - units[s][0] >= words), None)
        if e:
            out[units[s][0], units[e - 1][1]] = False
    weights = [sum(int(substring.WEIGHT[b]) for b in w.encode()) for w, _, _ in ws] + [0, 0]
    rank = [sum(w * int(m) for w, m in zip(weights[k : k + 3], substring.MIX, strict=True)) * int(substring.MIX[0]) % 2**64 for k in range(len(ws))]
    parts = set()
    for a in range(len(ws) - 50):
        inside = {k for (s, e) in out if a < s and e < a + 51 for k in range(s, e)}
        if len(inside) < 31:
            k = min(range(a, a + 21), key=lambda k: (rank[k], k))
            parts.add((k, k + 31))
    return ws, {x: True for x in parts} | out


def brute(docs):
    """Runs as tuples of words, compared one by one."""
    cut = [(i, *brute_runs(text)) for i, text in docs if text is not None]
    owner: dict = {}
    for i, ws, spans in cut:
        for s, e in spans:
            if i is not None:
                key = tuple(w.lower() for w, _, _ in ws[s:e])
                owner[key] = min(owner.get(key, i), i)
    out = []
    for i, ws, spans in cut:
        gone, local = set(), {}
        for (s, e), part in sorted(spans.items()):
            key = tuple(w.lower() for w, _, _ in ws[s:e])
            if i is not None and owner[key] != i or key in local and (not part or local[key] <= s):
                gone.update(range(s, e))
            else:
                local.setdefault(key, e)
        out.append((i, [w for k, (w, _, _) in enumerate(ws) if k not in gone]))
    return out


def texts(seed=1):
    rng = random.Random(seed)
    vocab = ["alpha", "beta", "gamma", "delta", "Éta", "theta", "iota", "kappa", "zeta", "mu", "nu", "xi"] + ["w%d" % k for k in range(150)]
    sentence = lambda: " ".join(rng.choices(vocab, k=rng.randint(1, 25))) + rng.choice((".", "!", "?", "\n", "", ","))
    passages = [" ".join(sentence() for _ in range(8)) for _ in range(4)]
    out = []
    for _ in range(60):
        parts = [sentence() for _ in range(rng.randint(0, 12))]
        for p in rng.sample(passages, rng.choice((0, 0, 1, 2))):
            parts.insert(rng.randint(0, len(parts)), p)
        out.append(" ".join(parts))
    return out


def test_against_brute_force(spark):
    docs = [*enumerate(texts()), (None, texts()[3]), (100, texts()[3]), (101, None), (102, ""), (103, "one. two. three. " * 30), (103, texts()[5])]
    df = spark.createDataFrame([(*d, len(d[1] or ""), "x") for d in docs], "doc_id long, text string, n_chars long, first string")
    got = substring.dedup(df).collect()
    assert len(got) == len(docs)
    want = brute(docs)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.text.split()) for r in got if r.text is not None), key=key) == sorted(want, key=key)
    old = {d[0]: d[1] for d in docs}
    for r in got:
        if r.text is not None:
            assert r.n_chars == len(r.text)
        if r.doc_id is not None and r.doc_id != 103 and r.removed:
            left, at = "", 0
            for s, e in (map(int, x.split(":")) for x in r.removed.split(",")):
                left, at = left + old[r.doc_id][at:s], e
            assert (left + old[r.doc_id][at:]).split() == r.text.split()
    assert sum(r.n_removed > 0 for r in got) > 10


def test_a_passage_inside_other_sentences_goes():
    passage = "Here is the first of it. Then comes a second sentence with more words, and a third one follows that. Next to last, there is this. And at the end we have quite a long sentence that closes the whole passage for good."
    a, b = substring.Cut(f"Some words {passage} more here".encode()), substring.Cut(f"Quite other text stands before {passage} and after".encode())
    left, _ = b.without(b.covered(set(a.hashes)))
    assert len(left.split()) < 5 + 2 + 20


def test_every_passage_of_over_50_words_goes(spark):
    rng = random.Random(5)
    vocab = ["w%d" % k for k in range(400)]
    uncut = vocab[:40]
    kinds = [lambda n: rng.choices(uncut, k=n), lambda n: rng.choices(vocab, k=n), lambda n: [w + rng.choice(("", "", "", ".", ",")) for w in rng.choices(vocab, k=n)], lambda n: (rng.choices(uncut, k=rng.randint(1, 3)) * n)[:n]]
    passages = [kind(n) for kind in kinds for n in (51, 52, 60) for _ in range(40)]
    around = lambda n: ["x%d" % rng.randrange(10**9) + rng.choice(("", "", ".")) for _ in range(n)]
    docs, id_ = [], 0
    for k, p in enumerate(passages):
        for _ in range(2):
            docs.append((id_, k, " ".join(around(rng.randint(0, 20)) + p + around(rng.randint(0, 20)))))
            id_ += 1
    got = substring.dedup(spark.createDataFrame(docs, "doc_id long, passage long, text string")).collect()
    for r in got:
        if r.doc_id % 2:
            words = passages[r.passage]
            text = docs[r.doc_id][2].split()
            assert len(text) - len(r.text.split()) >= substring.INSIDE, words
    assert substring.Cut(b"and " * 51).part.tolist() == [True]
    twice = substring.Cut(b"and " * 150)
    assert 31 <= len(twice.without(twice.covered(set()))[0].split()) <= 62


def test_empty_table(spark):
    assert substring.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_sentences_are_units():
    text = "One two three four five six seven. " * 2 + "Alpha beta gamma delta epsilon zeta eta theta. " * 2 + "Nine ten eleven twelve thirteen fourteen. " * 3
    starts = [k for k, w in enumerate(text.split()) if k == 0 or text.split()[k - 1].endswith(".")]
    cut = substring.Cut(text.encode())
    assert len(cut.hashes) and set(cut.begin.tolist()) <= set(starts) and not cut.part.any()


def test_clashing_names_and_long_texts(spark):
    rng = random.Random(8)
    long = " ".join("w%d" % rng.randrange(10**6) + rng.choice(("", "", ".")) for _ in range(60_000))
    schema = "doc_id long, text string, n_removed string, gone int, __id int, __h long, owner string, removed int"
    df = spark.createDataFrame([(1, long, "a", 1, 1, 1, "o", 1), (2, "before " + long, "b", 2, 2, 2, "p", 2), (None, None, None, None, None, None, None, None)], schema)
    got = substring.dedup(df)
    assert got.columns == [*df.columns, "_n_removed", "_removed"]
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].text == long and rows[1].n_removed == "a" and len(rows[2].text) < 200 and rows[2]._n_removed > 300_000 and rows[None].text is None
