"""The classifiers: held-out accuracy, shrinkage and defined cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenlake.llm import op02_quality as Q
from tokenlake.llm import op10_toxicity as X

VOCAB = ["".join(random.Random(i).choices("abcdefghilmnoprst", k=3 + i % 6)) for i in range(400)]


def prose(rnd, n):
    return " ".join(rnd.choice(VOCAB) + rnd.choice(["", "", "", ".", ","]) for _ in range(n))


def junk(rnd, n):
    w = rnd.choice(VOCAB)
    return rnd.choice([" ".join([w] * n), prose(rnd, n).upper().replace(" ", "!! "), " ".join(x + "%%%" for x in prose(rnd, n).split())])


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        bad, site = rnd.random() < 0.3, f"http://Host{i % 7}.example/p{i % 3}/page{i}"
        n = rnd.randrange(20, 200)
        text = junk(rnd, n) if bad else prose(rnd, n)
        toxic = rnd.random() < 0.25
        if toxic:
            w = text.split(" ")
            for _ in range(4):
                w.insert(rnd.randrange(len(w)), "grumpf" + rnd.choice(["", "ig", "en", "heit", "s"]))
            text = " ".join(w)
        rows.append((i, text, ("en", "de")[i % 2], site))
        labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache()
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def test_quality_on_held_out_documents(labelled):
    docs, labels = labelled
    got = Q.judged(docs, labels.filter("doc_id < 300")).join(labels, "doc_id").filter("doc_id >= 300").select("keep", "quality").toPandas()
    assert (got["keep"] == (got["quality"] == 1)).mean() > 0.97
    left = Q.kept(docs, labels.filter("doc_id < 300"))
    assert left.columns == docs.columns


def test_posteriors_equal_direct_computation(labelled):
    docs, labels = labelled
    model = Q.train(docs, labels)
    rows, c = Q.posterior(docs, model)
    got = rows.select("doc_id", *[F.col(v).alias(k) for k, v in c.items()]).toPandas().set_index("doc_id").sort_index()
    pdf = docs.toPandas().set_index("doc_id").sort_index()
    p = 1 / (1 + np.exp(-model.evidence(pa.array(pdf["text"], pa.large_string()))))
    assert got["p"].to_numpy() == pytest.approx(p, abs=1e-9)
    host = pdf["source"].str.replace("http://", "").str.split("/").str[0].str.lower()
    path = pdf["source"].str.split("/").str[3]
    assert (got["host"] == host).all() and (got["path"] == path).all()
    prior = p.mean()

    def strength(groups):
        g = [p[x] for x in groups]
        n = np.array([len(x) for x in g])
        mean = p.mean()
        between = sum(len(x) * (x.mean() - mean) ** 2 for x in g)
        within = sum(((x - x.mean()) ** 2).sum() for x in g) / (len(p) - len(g))
        spread = (between - (len(g) - 1) * within) / (len(p) - (n**2).sum() / len(p))
        return np.clip(within / spread, Q.K_MIN, Q.K_MAX) if spread > 0 else Q.K_MAX

    by_host = pdf.groupby(host.to_numpy()).indices
    by_path = pdf.groupby([host.to_numpy(), path.to_numpy()]).indices
    kh, kp = strength(by_host.values()), strength(by_path.values())
    for i in range(0, 600, 37):
        h, s = by_host[host.iloc[i]], by_path[host.iloc[i], path.iloc[i]]
        hp = (p[h].sum() - p[i] + kh * prior) / (len(h) - 1 + kh)
        pp = (p[s].sum() - p[i] + kp * hp) / (len(s) - 1 + kp)
        assert got["host_p"].iloc[i] == pytest.approx(hp) and got["path_p"].iloc[i] == pytest.approx(pp)


def test_quality_cases(spark, labelled):
    docs, labels = labelled
    t = docs.first()["text"]
    rows = [(1, None, None, 1), (1, "", "a.b", 2), (None, t, "a.b/c/d", 3), (None, t, "a.b/c/d", 3), (2, t * 500, "x", 4)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string, score int")
    train = docs.select("doc_id", "text")
    model = Q.train(train, labels)
    out, c = Q.posterior(odd, model)
    assert out.count() == 5
    assert out.filter("text = '' or text is null").select(c["logit"]).distinct().first()[0] == pytest.approx(model.prior)
    assert out.filter("source is null").first()[c["host"]] == ""
    assert Q.posterior(odd.limit(0), model)[0].collect() == []
    assert Q.train(docs, labels.limit(0)) == Q.UNTRAINED
    twice = labels.union(labels.withColumn("quality", 1 - F.col("quality")))
    assert Q.train(docs, twice) == Q.UNTRAINED


def test_large_site_tables_take_the_join(labelled, monkeypatch):
    docs, labels = labelled
    want = sorted(map(tuple, Q.judged(docs, labels).select("doc_id", "keep").collect()))
    monkeypatch.setattr(Q, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, Q.judged(docs, labels).select("doc_id", "keep").collect())) == want


def test_toxicity_on_held_out_documents(labelled):
    docs, labels = labelled
    scores = X.classify(docs, labels.filter("doc_id < 400")).withColumnRenamed("toxic", "hit")
    got = scores.join(labels, "doc_id").filter("doc_id >= 400").select("hit", "toxic").toPandas()
    assert got["hit"][got["toxic"] == 1].mean() > 0.9 and got["hit"][got["toxic"] == 0].mean() < 0.05


def direct_score(model, words):
    """Score of one text, position by position."""
    if not len(words):
        return 0.0
    rows = [model.table[w].sum(0) for w in words]
    feats = []
    for i, width in enumerate(X.WIDTHS):
        at = X._AT[i]
        best = np.full(X.FILTERS, -np.inf)
        for s in range(max(1, len(rows) - width + 1)):
            best = np.maximum(best, sum(rows[s + j][at + j * X.FILTERS : at + (j + 1) * X.FILTERS] for j in range(width) if s + j < len(rows)))
        feats.append(best)
    x = np.maximum(np.concatenate(feats) + model.bias, 0)
    return 1 / (1 + np.exp(-(x @ model.out + model.out_bias)))


def test_scores_equal_direct_computation(monkeypatch):
    rnd = random.Random(5)
    texts = [prose(rnd, n) for n in (1, 2, 3, 4, 30, 200)] + ["", "one", "!!", prose(rnd, 77), "x y"]
    model = X.fit(texts, np.array([0, 1] * 5 + [0]), epochs=1)
    words, off = X.hashed_words(pa.array(texts))
    want = [direct_score(model, words[a:b]) for a, b in zip(off, off[1:])]
    for chunk in (1 << 16, 7, 1):
        monkeypatch.setattr(X, "CHUNK", chunk)
        assert model.score(words, off) == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_toxicity_cases(spark, labelled):
    docs, labels = labelled
    model = X.train(docs, labels)
    t = "grumpf " + docs.first()["text"] + " grumpfig grumpfen"
    rows = [(1, None, "en", 0), (2, "", None, 1), (None, t, "xx", 2), (None, t, "xx", 2), (3, t * 2000, "en", 3)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = X.scored(odd, model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 5 and not by[1]["toxic"] and by[1]["score"] == 0 == by[2]["score"]
    assert {r["threshold"] for r in got if r["lang"] == "xx" or r["lang"] is None} == {model.common}
    assert by[None]["toxic"] and by[3]["toxic"]
    assert X.scored(odd.limit(0), model).collect() == []


def test_thresholds_cover_all_labels_outside_the_fit(labelled):
    docs, labels = labelled
    model, fitted = X.fit_sample(docs, labels, 200)
    assert len(fitted) == 150
    sample = [r[0] for r in X.labelled_sample(docs, labels, "toxic", 200)]
    rare = docs.withColumn("lang", F.when(F.col("doc_id").isin(sample), F.col("lang")).otherwise("xx"))
    model = X.train(rare, labels, 200)
    rows = X.scored(rare, model).drop("toxic").join(labels, "doc_id").filter(~F.col("doc_id").isin(fitted)).toPandas()
    assert len(rows) == 450 and set(model.by_lang) == {"en", "de", "xx"}

    def f1(limit):
        hit = rows["score"] >= limit
        return 2 * (hit & (rows["toxic"] == 1)).sum() / (hit.sum() + rows["toxic"].sum())

    assert f1(model.common) >= max(map(f1, rows["score"])) - 0.01


def test_samples_have_whole_texts(spark):
    long = "plain words " * 20_000 + "the end"
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, "tiny")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3)], "doc_id long, toxic int")
    assert X.labelled_sample(docs, labels, "toxic") == [(1, long, 1), (2, "short", 0), (3, "tiny", 1)]
    assert X.labelled_sample(docs, labels, "toxic", max_bytes=100) == [(2, "short", 0), (3, "tiny", 1)]


def test_samples_are_bounded_by_rows_and_taken_of_what_there_is(spark):
    docs = spark.createDataFrame([(1, "hot")] * 900 + [(1, f"hot {i}") for i in range(300)] + [(2, "own")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5000)], "doc_id long, toxic int")
    got = X.labelled_sample(docs, labels, "toxic", max_rows=50)
    assert len(got) == 50 and len(set(got)) == 50
    few = X.labelled_sample(docs.filter("doc_id = 2"), labels, "toxic", max_rows=2)
    assert few == [(2, "own", 0)]


def test_without_training_data(spark, labelled):
    docs, labels = labelled
    for none in (labels.limit(0), labels.filter("quality = 1 and toxic = 0")):
        got = Q.judged(docs, none).select("doc_p", "keep").distinct().collect()
        assert [tuple(r) for r in got] == [(0.5, True)]
        assert Q.kept(docs, none).count() == docs.count()
        assert [tuple(r) for r in X.classify(docs, none).select("score", "toxic").distinct().collect()] == [(0.0, False)]
    assert Q.judged(docs.limit(0), labels).collect() == [] and Q.kept(docs.limit(0), labels).collect() == []
    assert X.classify(docs.limit(0), labels).collect() == []


def test_output_names_in_the_input_do_not_clash(labelled):
    docs, labels = labelled
    odd = docs.withColumns({c: F.lit("x") for c in ("score", "keep", "host", "path", "h", "y", "threshold", "bin", "sum", "n")})
    assert Q.judged(odd, labels).columns == ["doc_id", "host", "path", "doc_p", "host_p", "path_p", "score", "keep"]
    assert Q.kept(odd, labels).columns == odd.columns and Q.kept(odd, labels).count() > 0
    assert X.classify(odd, labels).columns == ["doc_id", "lang", "score", "threshold", "toxic"]


def test_sites(spark):
    urls = {"http://H.com/a/b?next=/c/d": ("h.com", "a"), "h.com/a/b/c#x/y": ("h.com", "a/b"), "src0": ("src0", ""), None: ("", ""), "h.com?x=/a/b": ("h.com", ""), "https://h.com/": ("h.com", "")}
    rows = spark.createDataFrame([(k,) for k in urls], "source string")
    host, path = Q.site(F.col("source"))
    assert {r[0]: (r[1], r[2]) for r in rows.select("source", host, path).collect()} == urls


def test_training_in_pieces_equals_training_at_once(monkeypatch):
    rnd = random.Random(3)
    texts = [prose(rnd, n) + (" grumpf" if n % 2 else "") for n in range(1, 41)]
    y = np.array([n % 2 for n in range(1, 41)])
    whole = X.fit(texts, y, epochs=2)
    monkeypatch.setattr(X, "CHUNK", 7)
    assert X.fit(texts, y, epochs=2).table == pytest.approx(whole.table, abs=1e-3)
