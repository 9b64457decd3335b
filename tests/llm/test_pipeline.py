import corpus_pipeline
from fieldframe.llm import common, packing, quality, secrets, simhash, substring

from tests.llm.test_simhash import share, shingles

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.save(stage(spark, docs, SF))
        if name == "quality":
            scores = {r.doc_id: r.predicted for r in quality.classify(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
            assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, p in scores.items() if p)
        if name == "simhash":
            groups = simhash.similar(docs).collect()
            assert sorted(r.doc_id for r in out.collect()) == sorted({r.component_id for r in groups})
            # Against brute force: whoever goes is linked at 0.8 or more to another text of its group.
            sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
            of = {r.doc_id: r.component_id for r in groups}
            linked = {(i, j) for i in sets for j in sets if i != j and share(sets[i], sets[j]) >= 0.8}
            assert all(any((i, j) in linked and of[j] == of[i] for j in sets) for i in sets if of[i] != i)
            assert sum(of[i] == of[j] for i, j in linked) >= 0.97 * len(linked)
        if name == "substring":
            assert {(r.doc_id, r.text) for r in out.collect()} == {(r.doc_id, r.text) for r in substring.dedup(docs).collect()}
        if name == "secrets":
            cost = secrets.GuessCost.from_tokenizer(secrets.default_path())
            assert {(r.doc_id, r.text) for r in out.collect()} == {(r.doc_id, secrets.redact(r.text, secrets.find(r.text, cost))) for r in docs.collect()}
        if k < 4:
            assert out.columns == names
            assert 0 < out.count() <= before
            assert all(r.n_chars == len(r.text) for r in out.collect())
        else:
            rows = out.collect()
            assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
            assert sum(r.length for r in rows) == sum(len(x) // 4 + 1 for x in packing.encode_words([r.text.encode() for r in docs.collect()], packing.default_path()))
        docs = out
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()))


def test_stages_on_odd_rows_and_clashing_names(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, an empty table, and columns named like those the stages
    use inside."""
    inner = ["score", "__score", "__id", "__gone", "__of", "kept", "owner", "gone", "h", "fp", "n_removed", "removed", "label", "length", "part", "place"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in inner)
    more = ["x"] * len(inner)
    prose = "This is a plain sentence about the weather. It has been fine for some days now. Nobody expects that to last for long. "
    long = prose * 3000
    rows = [(1, prose, "en", "s", len(prose), *more), (1, prose, "en", "s", len(prose), *more), (2, None, None, None, None, *[None] * len(inner)), (None, prose + "Another end.", "en", "s", None, *more), (3, "", "en", "s", 0, *more), (4, long, "en", "s", len(long), *more), (5, "password = hunter2!xyzzy9Q", None, "s", None, *more)]
    spark.createDataFrame([(1, 1, 0), (4, 1, 0), (3, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, table, str(tmp_path))
            out = got.collect()
            if k < 4:
                assert got.columns == table.columns, name
            if table.isEmpty():
                assert out == []
            elif name == "simhash":
                assert sorted((r.doc_id or 0, r.source) for r in out if r.doc_id != 2) == [(0, "s"), (1, "s"), (1, "s"), (5, "s")]  # 2 and 3 have no words, 4 says what 1 says
            elif name in ("substring", "secrets"):
                assert len(out) == len(rows) and [r.text for r in out if r.doc_id == 2] == [None]
            elif name == "packing":
                assert {r.doc_id for r in out} == {1, 2, 3, 4, 5, None}
