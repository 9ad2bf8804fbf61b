"""The pipeline's stages."""

import random


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rnd = random.Random(3)
    vocab = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(500)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    leak = prose(20)
    shared = prose(12)
    texts = [prose(60) + ".\n" + prose(40) for _ in range(60)]
    texts += ["SPAM!! " * 80 for _ in range(20)]
    texts += [texts[0].replace("\n", " "), texts[1] + " " + leak + " " + texts[2], texts[3] + "\n" + shared, texts[4] + "\n" + shared]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(not t.startswith("SPAM")), 0) for i, t in enumerate(texts) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5
    after = {}
    step = docs
    for k, (name, f) in enumerate(cp.STAGES):
        f(spark, step, d).write.parquet(f"{d}/{k}")
        step = spark.read.parquet(f"{d}/{k}")
        after[name] = step
        if k < 4:
            assert step.columns == docs.columns
    ids = {n: {r["doc_id"] for r in x.select("doc_id").collect()} for n, x in after.items()}
    assert ids["quality classifier"] == set(range(60)) | {80, 81, 82, 83}
    # nothing of 83 is its own
    assert ids["quality classifier"] - ids["line dedup"] == {83}
    lines = {r["doc_id"]: r["text"] for r in after["line dedup"].collect()}
    assert lines[82] == shared
    assert {80} <= ids["line dedup"] - ids["SimHash near-dedup"] <= {80, 82}
    assert ids["SimHash near-dedup"] - ids["benchmark decontamination"] == {81}
    assert set(range(60)) <= ids["packing"]
    got = sorted(map(tuple, cp.run(spark, d).collect()), key=repr)
    assert got == sorted(map(tuple, step.collect()), key=repr)


def folder(spark, d, rows, labels, bench):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    folder(spark, str(tmp_path), [], [], [])
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_pipeline_without_labels_keeps_all_and_drops_near_copies(spark, tmp_path):
    import corpus_pipeline as cp

    rnd = random.Random(5)
    prose = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=5)) for _ in range(n))
    lines = [prose(30) for _ in range(8)]
    edited = [*lines[:5], *(x.replace(x.split()[3], prose(1), 1).replace(x.split()[9], prose(1), 1) for x in lines[5:])]
    rows = [(1, "\n".join(lines), "en", "a", 0, "k"), (2, "\n".join(edited), "en", "a", 0, "k"), (3, "\n".join(lines), None, None, None, None), (3, "\n".join(lines), None, None, None, None), (4, None, "en", "b", 0, "k"), (5, "", "en", "b", 0, "k"), (None, prose(50), "de", "b/c/d", 3, "k"), (7, prose(20_000), "en", "c", 1, "k")]
    folder(spark, str(tmp_path), rows, [], [(1, None), (None, "unheard of words")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, f in cp.STAGES[:4]:
        docs = f(spark, docs, str(tmp_path))
        assert len(docs.columns) == 6, name
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "4", "5", "7", "None"]
    out = cp.run(spark, str(tmp_path)).toPandas()
    assert set(out["doc_id"].fillna(-1)) == {1, 7, -1}


def test_quality_scores_once_and_starts_one_kind_of_worker(spark, tmp_path, monkeypatch):
    import corpus_pipeline as cp
    from pyspark import RDD

    rows = [(i, "words of a text " * 9 if i % 2 else "SPAM!! " * 9, "en", f"src{i % 3}/a/b", 0, "k") for i in range(40)]
    folder(spark, str(tmp_path), rows, [(i, i % 2, 0) for i in range(20)], [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    with monkeypatch.context() as m:
        m.setattr(RDD, "_to_java_object_rdd", lambda self: 1 / 0)  # rows by way of the RDD API, whose workers are others
        out = cp._quality(spark, docs, str(tmp_path))
    # two in a chain are two workers a task, which later stages use and keep both
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r["doc_id"] for r in out.collect()} == set(range(1, 40, 2))
