import random

import sentencepiece

from fieldframe.llm import pieces

PATH = pieces.default_path()
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(1)
    parts = ["hello", "world", "über", "naïve", "日本", "😀", "x" * 20, "123", "▁", "\n", "\t", "the", "Straße", "don't", "привет", "  ", "ⴰ"]
    return ["".join(rng.choice(parts) + rng.choice(("", " ", " ")) for _ in range(rng.randrange(0, 12))) for _ in range(40)] + ["", " ", "  a", "a ", "▁x"]


def brute(text):
    """Best score over all segmentations of the whole text into pieces and single characters."""
    table = {}
    for k in range(MODEL.get_piece_size()):
        if not (MODEL.is_byte(k) or MODEL.is_control(k) or MODEL.is_unknown(k)):
            table[MODEL.id_to_piece(k).replace("▁", " ")] = MODEL.get_score(k)
    text = " " + text if text else ""
    best = [0.0] + [None] * len(text)
    for e in range(1, len(text) + 1):
        ways = [best[s] + table[text[s:e]] for s in range(max(0, e - 48), e) if text[s:e] in table]
        best[e] = max(ways + ([] if text[e - 1] in table else [best[e - 1] + pieces.UNKNOWN]))
    return best[-1]


def score(ids):
    """Bytes of one character count once."""
    out, k = 0.0, 0
    while k < len(ids):
        if MODEL.is_byte(ids[k]):
            lead = ids[k] - 3
            k += 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
            out += pieces.UNKNOWN
        else:
            out += MODEL.get_score(ids[k])
            k += 1
    return out


def test_best_path_and_round_trip(spark):
    docs = [*enumerate(texts()), (None, "no id"), (3, texts()[3]), (3, "other"), (99, None), (100, "long " * 20_000)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, ids int")
    coded = pieces.encode(df, PATH).cache()
    got = coded.collect()
    assert len(got) == len(docs)
    # With a dictionary of two words, or of none, all others' lattices are folded in their tasks, with the same result.
    for n in (0, 2):
        assert sorted(map(str, pieces.encode(df, PATH, n).collect())) == sorted(map(str, got))
    want = sorted((str(i), brute(t or "")) for i, t in docs)
    assert [x for x, _ in want] == sorted(str(r.doc_id) for r in got)
    for (_, a), b in zip(sorted(want), sorted((str(r.doc_id), score(r.ids)) for r in got), strict=True):
        assert abs(a - b[1]) < 1e-3 * max(1, abs(a) / 1e3)
    back = pieces.decode(coded, PATH).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in docs)


def test_runs_of_spaces(spark):
    table = {MODEL.id_to_piece(k).replace("▁", " "): MODEL.get_score(k) for k in range(MODEL.get_piece_size()) if not (MODEL.is_byte(k) or MODEL.is_control(k) or MODEL.is_unknown(k))}
    assert not any(" " in w.lstrip(" ") for w in table)
    docs = list(enumerate(["if x:\n return", "def f(a):\n    if a:\n        return  a\n", "a" + " " * 37 + "b", "   lead", "tail     ", " " * 16, "a\t  b  \n  c", "one two", ""]))

    def best(text):
        text = " " + text if text else ""
        out = [0.0] + [None] * len(text)
        for e in range(1, len(text) + 1):
            out[e] = max([out[s] + table[text[s:e]] for s in range(max(0, e - 64), e) if text[s:e] in table] + ([] if text[e - 1] in table else [out[e - 1] + pieces.UNKNOWN]))
        return out[-1]

    coded = pieces.encode(spark.createDataFrame(docs, "doc_id long, text string"), PATH).cache()
    got = {r.doc_id: r.ids for r in coded.collect()}
    for k, t in docs:
        assert abs(score(got[k]) - best(t)) < 1e-3 * max(1, abs(best(t)) / 1e3), t
    assert {r.doc_id: r.text for r in pieces.decode(coded, PATH).collect()} == dict(docs)
    theirs = spark.createDataFrame([(k, MODEL.encode(t)) for k, t in docs], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(theirs, PATH).collect()} == dict(docs)


def test_empty_table(spark):
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_long_unbroken_words(spark):
    docs = [(1, "ab" * 50_000), (2, " " * 100_000), (3, "日本語" * 10_000), (4, "q" * 100_000)]
    coded = pieces.encode(spark.createDataFrame(docs, "doc_id long, text string"), PATH).cache()
    for r in coded.collect():
        assert abs(score(r.ids) - (best := brute(docs[r.doc_id - 1][1]))) < 1e-6 * abs(best)
    assert {r.doc_id: r.text for r in pieces.decode(coded, PATH).collect()} == dict(docs)


def test_decode_odd_ids(spark):
    rows = [(1, None), (2, []), (3, [0, 1, 2, 99_999_999]), (None, MODEL.encode("hello")), (4, [3 + 0xC3])]
    got = pieces.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()
    assert [(r.doc_id, r.text) for r in got] == [(1, ""), (2, ""), (3, ""), (None, "hello"), (4, "\ufffd")]


def test_query_decodes(spark, tmp_path):
    import hashlib

    docs = [(k, t) for k, t in enumerate(texts())] + [(50, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in pieces.query(spark, str(tmp_path)).collect():
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id if r.doc_id < 50 else -1][1] or "").encode()).hexdigest()
