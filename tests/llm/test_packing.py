import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from fieldframe.llm import packing

PATH = packing.default_path()


def test_words_alone_encode_like_the_whole_text():
    t = Tokenizer.from_file(PATH)
    rng = random.Random(4)
    parts = ["It's", "DON'T", " ", "\n", "\x0b", "\t\r\n", "\x0c", "\x1c", "\x85", " ", "　", "é", "é", "́", "İ", "Σ", "ß", "12", "...", "<|endoftext|>", "<|startoftext|>x", "日本", "'ll", " ", "a\x00b", "###", "😀", "‍"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 30))) for _ in range(800)]
    for text, got in zip(texts, packing.encode_words([x.encode() for x in texts], PATH), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, g in enumerate(gaps) if g >= n]
        if fit:
            gaps[min(fit, key=lambda k: gaps[k])] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def held(rows, capacity):
    """The sequences of rows (sequence_id, offset, length), which must lie gapless from 0."""
    by = {}
    for sequence, offset, n in rows:
        by.setdefault(sequence, []).append((offset, n))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def swept(items, longest, cuts):
    """What sweeps of parts of the items, cut there, and the numbers of what they leave over match and open."""
    import pyarrow as pa

    pairs, rest = [], []
    for part, some in enumerate(np.split(np.arange(len(items)), cuts)):
        mine = [items[k] for k in some]
        batch = pa.table({"size": [i[0] for i in mine], "is_gap": [i[1] for i in mine], "id": [i[2] for i in mine]}).to_batches() if mine else []
        packing.TaskContext = type("C", (), {"get": staticmethod(lambda p=part: type("T", (), {"partitionId": lambda self: p})())})
        for out in packing.sweep(longest)(iter(batch)):
            rest += [tuple(r.values()) for r in out.to_pylist()]
    sums = sorted((r[4], r[1], r[2], r[3], r[5]) for r in rest if r[0] == packing.SUMS)
    docs, slots, matched, opened = packing.resolve(sums)
    pairs = [(r[1], r[2]) for r in rest if r[0] == packing.MATCH]
    left = packing.rows_of([r for r in rest if r[0] in (packing.DOC, packing.SLOT)])
    numbers = [tuple(r.values()) for out in packing.number(docs, slots)(iter([left])) for r in out.to_pylist()]
    takes = {no: key for kind, no, key, _ in numbers if kind == packing.TAKES}
    taken = {no: key for kind, no, key, _ in numbers if kind == packing.TAKEN}
    assert set(takes) == set(taken) == set(range(matched))
    opens = sorted((no, key) for kind, no, key, _ in numbers if kind == packing.OPENS)
    assert [no for no, _ in opens] == list(range(opened))
    return sorted(pairs + [(takes[no], taken[no]) for no in takes]), sorted(key for _, key in opens)


@pytest.mark.parametrize("seed", range(30))
def test_parts_match_like_one_sweep(seed, monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", None)
    rng = random.Random(seed)
    longest = rng.choice((3, 10, 40))
    items = [(rng.randint(1, longest), False, k) for k in range(rng.randint(0, 60))]
    items = sorted(items + [(rng.randint(1, rng.choice((longest // 2 + 1, longest, 4 * longest))), True, k) for k in range(rng.randint(0, 40))])
    # Plainly: the gaps in order of size, each for the longest documents below it.
    docs, want = [], []
    for size, is_gap, key in items:
        if not is_gap:
            docs.append((size, key))
            continue
        for _ in range(max(1, size // longest)):
            if docs:
                want.append((docs.pop()[1], key))
    top = max((i[0] for i in items if i[1]), default=0)
    opens = sorted(key for size, key in docs if size > top)
    cuts = sorted(rng.randint(0, len(items)) for _ in range(rng.randint(0, 6)))
    pairs, opened = swept(items, longest, cuts)
    # Equal gaps may change places: which documents are matched, and to what size, is the same.
    size = {key: s for s, is_gap, key in items if is_gap}
    assert sorted((d, size[g]) for d, g in pairs) == sorted((d, size[g]) for d, g in want)
    assert opened == opens


@pytest.mark.parametrize("seed", range(3))
def test_rounds_pack_like_best_fit_decreasing(spark, seed):
    rng = random.Random(seed)
    capacity = (50, 100, 64)[seed]
    lengths = [rng.randint(1, rng.choice((3, capacity // 2, capacity))) for _ in range(1500)]
    df = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(df.repartition(5), capacity).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    used = held([(r.sequence_id, r.offset, r.length) for r in rows], capacity)
    assert used <= 1.02 * best_fit_decreasing(lengths, capacity)


@pytest.mark.parametrize("copies", [200, 400])
def test_what_a_sweep_leaves_over_is_numbered_once(spark, monkeypatch, tmp_path, copies):
    rng = random.Random(1)
    lengths = [rng.randint(1, 50) for _ in range(300)] + [17] * copies
    plain, resolve, left = packing.number, packing.resolve, []

    def resolved(sums):
        out = resolve(sums)
        left.append(sum(s[1] for s in sums) + out[2])  # documents, and the slots of those that are matched
        return out

    def counted(docs, slots):
        run, at = plain(docs, slots), str(tmp_path)

        def counting(batches):
            import uuid

            n = 0
            for b in run(batches):
                n += b.num_rows
                yield b
            with open(f"{at}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(n))

        return counting

    monkeypatch.setattr(packing, "TASK_ROWS", 60)
    monkeypatch.setattr(packing, "resolve", resolved)
    monkeypatch.setattr(packing, "number", counted)
    df = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(df, 50).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    held([(r.sequence_id, r.offset, r.length) for r in rows], 50)
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == sum(left)


def test_rows(spark):
    rng = random.Random(2)
    words = ["the", "of", "Zweihänder", "naïve", "x1y2", "quick"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice((0, 1, 7, 90, 300))))) for i in range(200)]
    docs += [(None, "a b"), (3, docs[3][1]), (500, None), (501, ""), (502, "long word " * 5000)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, part string, place int")
    rows = packing.best_fit(df, PATH, with_ids=True).collect()
    t = Tokenizer.from_file(PATH)
    want = []
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(i, p, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), ids[s : s + 2048]) for p, s in enumerate(range(0, len(ids), 2048))]
    key = lambda r: str(r[:5])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in rows), key=key) == sorted(want, key=key)
    assert held([(r.sequence_id, r.offset, r.length) for r in rows], 2048) == best_fit_decreasing([r.length for r in rows], 2048)


def test_empty_table(spark):
    assert packing.best_fit(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
