"""The pipeline's stages on the smallest tables, each held against its own input."""

import corpus_pipeline
from voltwarden.llm import common

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "best-fit packing"]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(common.written(stage(spark, kept[-1], SF), "stage"))
        assert kept[-1].columns == docs.columns, name
    quality, single, clean, mixed = (k.toPandas() for k in kept[1:])
    assert set(single.doc_id) <= set(quality.doc_id) and single.doc_id.is_unique
    assert set(clean.doc_id) == set(single.doc_id)
    assert not clean.text.str.contains(r'token = "[0-9a-f]{40}"').any()
    assert set(mixed.doc_id) <= set(clean.doc_id) and mixed.groupby("doc_id").size().max() <= 3
    last = corpus_pipeline.STAGES[-1][1](spark, kept[-1], SF).toPandas()
    assert last.groupby("sequence_id").length.sum().max() <= 2048
    assert set(last.doc_id) == set(mixed.doc_id)


def test_one_row_a_group(spark):
    words = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [
        (None, words("a")),  # like no other, without an id
        (5, words("b")), (5, words("b")), (9, words("b") + " more"), (None, words("b")),  # copies
        (None, words("c")), (None, words("c") + " more"),  # copies without any id
        (5, words("d")),  # another text with an id that is there
        (7, ""), (7, ""), (8, None), (None, ""), (None, ""),  # without words
    ]
    df = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.jaccard_join(spark, df.repartition(3), SF).collect()
    ids = lambda k: [r.doc_id for r in got if (r.text or "").startswith(k)]
    assert ids("a") == [None] and ids("b") == [5] and ids("c") == [None] and ids("d") == [5]
    assert sorted((r.doc_id or 0, r.text) for r in got if r.text == "") == [(0, ""), (0, ""), (7, "")]
    assert [r.doc_id for r in got if r.text is None] == [8] and len(got) == 8


ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, __row int"


def test_odd_tables(spark, monkeypatch):
    """Each stage takes null and empty texts, null ids and sources, repeated rows, very long texts and extra columns."""
    from voltwarden.llm import quality

    long = "every word of this text is one of many plain words that follow each other " * 3000
    rows = [(1, None, None, None), (2, "", "en", "web"), (None, "some plain text about nothing at all", None, "web"), (3, long, "en", None), (3, long, "en", None), (4, " \t\n", "en", "web"), (5, 'a token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" here', "en", "web"), (5, "another text", "de", "web")]
    df = spark.createDataFrame([(i, t, la, s, len(t or ""), "x", 1) for i, t, la, s in rows], ODD)
    yes = quality.fit(df.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int"))  # nothing labelled: all accepted
    monkeypatch.setattr(quality, "fit", lambda *a, **k: yes)
    counts = []
    for given in (df, df.limit(0)):
        docs = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.written(stage(spark, docs, SF), "odd")
            assert docs.columns == corpus_pipeline.COLUMNS, name
            counts.append(docs.count())
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        counts.append(last.agg({"sequence_id": "max"}).first()[0])
        assert last.count() >= docs.count()
    assert counts[:3] == [8, 7, 7] and counts[5:9] == [0, 0, 0, 0]
    clean = corpus_pipeline.secret_scan(spark, df, SF).collect()
    assert sum("[SECRET]" in (r.text or "") for r in clean) == 1 and sum(r.text is None for r in clean) == 1


def test_tables_of_a_run_are_cleared(spark):
    """run() leaves only what its result reads."""
    import os

    left = lambda: set(os.listdir(common.shared_dir(spark).removeprefix("file://") + "/voltwarden"))
    common.shared_path(spark, "x")
    before = left() if os.path.isdir(common.shared_dir(spark).removeprefix("file://") + "/voltwarden") else set()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    assert {x.rsplit("-", 1)[0] for x in left() - before} <= {"pieces", "lengths", "mixing-sources-to-target-weights"}
