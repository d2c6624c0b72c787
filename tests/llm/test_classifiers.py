import random

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import quality as ql
from cairn.llm import toxicity as tx
from cairn.llm import url_filter as uf

SMALL = "/root/testdata/sf0.01"


def test_quality_held_out_accuracy(spark):
    scored = ql.op7_quality(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert scored.count() == docs.count()
    both = scored.join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in both]) >= 0.95
    assert all(0 <= r.score <= 1 for r in both)


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (5, 7)], "doc_id long, quality int")
    model, features = ql.fit_quality(docs, labels)
    scores = [r.s for r in features.select(ql.score_udf(model)("features").alias("s")).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    none = labels.limit(0)
    model, _ = ql.fit_quality(docs, none)
    assert model.scores(np.zeros((2, len(ql.FEATURES)))).tolist() == [0.5, 0.5]
    assert ql.fit_quality(empty, labels)[1].count() == 0
    kept = ql.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_moments_are_sums_over_all_rows(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1001)], "doc_id long, quality int")
    _, features = ql.fit_quality(docs, labels)
    rows = ql.training_rows(features, labels, "doc_id", "quality")
    got = ql.moments(rows)
    for k in (0, 1):
        x = np.array([r.features for r in rows.where(F.col("label") == k).collect()])
        assert got[k][0] == len(x)
        np.testing.assert_allclose(got[k][1], x.sum(0))
        np.testing.assert_allclose(got[k][2], x.T @ x)


def test_toxic_words_are_learned_and_found_anywhere():
    rng = random.Random(0)
    words = [f"w{k}" for k in range(300)]
    bad = ["scumbag", "vileling", "vileness", "vilesome"]
    texts, y = [], []
    for k in range(500):
        t = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if k % 4 == 0:
            t[rng.randrange(len(t))] = rng.choice(bad)
        texts.append(tx.encode(" ".join(t)))
        y.append(float(k % 4 == 0))
    y = np.array(y)
    net = tx.train(texts, y, np.ones(len(y)), 1)
    tx.calibrate(net, texts, y, np.ones(len(y)))
    far = tx.encode(" ".join(rng.choice(words) for _ in range(tx.BLOCK + 500)) + " SCUMBAG!")
    assert net.score(far) >= 0.7 > net.score(far[:-1])
    assert net.score(tx.encode("w1 w2 vilehood w3")) >= 0.7
    assert 0 <= net.score(tx.encode("")) < 0.7 and net.score(tx.encode(None)) == net.score(tx.encode(""))


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(i, 0) for i in range(60)] + [(None, 1), (2, None)], "doc_id long, toxic int")
    net = tx.fit_toxicity(docs, labels)
    scores = [r.s for r in docs.select(tx.toxicity_udf(net)("text").alias("s")).collect()]
    assert len(scores) == docs.count() and all(0 <= s < 0.7 for s in scores)
    assert empty.select(tx.toxicity_udf(tx.fit_toxicity(empty, labels))("text")).count() == 0


URLS = [
    ("https://a.org/x?p=1", "a.org", "/x", "org/", "allow"), ("http://EXAMPLE.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
    ("x://b.example.org/en/12#f", "b.example.org", "/en/12", "example.org/en/1", "block"), ("x://b.example.org/en/2", "b.example.org", "/en/2", "org/", "allow"),
    ("x://badexample.org/es/1", "badexample.org", "/es/1", "org/", "allow"), ("x://k.com/fr/?q", "k.com", "/fr/", "com/fr/", "allow"), ("x://k.com/de/", "k.com", "/de/", "com/de/", "block"),
    ("x://k.com/FR/", "k.com", "/FR/", None, None), ("x://a.org", "a.org", "", None, None), ("x://a.org?/x", "a.org", "", None, None), ("a.org/x", "", "", None, None), ("", "", "", None, None), (None, "", "", None, None),
    ("x://a://b/c", "a:", "//b/c", None, None), ("x://u@h.net:8/p#a?b", "u@h.net:8", "/p", None, None),
]


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(k, u[0]) for k, u in enumerate(URLS)] + [(0, URLS[0][0])], "page_id long, url string").withColumn("label", F.lit("x"))
    got = {r.page_id: r for r in uf.filter_urls(pages).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(URLS):
        r = got[k]
        assert (r.host, r.path, r.rule) == (host, path, rule), URLS[k]
        assert r.verdict == verdict or (verdict is None and r.verdict in ("allow", "block"))


def test_url_trees_learn(spark):
    rows = [(k, f"https://h{k % 9}.com/{'fr' if k % 2 else 'de'}/{k}") for k in range(300)] + [(900 + k, f"https://h{k}.net/{'fr' if k % 2 else 'de'}/{k}") for k in range(9)]
    out = uf.filter_urls(spark.createDataFrame(rows, "page_id long, url string"))
    assert out.count() == len(rows)
    assert {r.verdict for r in out.where("rule is null").collect()} <= {"allow", "block"}
    assert uf.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    same = spark.createDataFrame([(1, "x://q.net/a"), (2, "x://a.org/b")], "page_id long, url string")
    assert {r.verdict for r in uf.filter_urls(same).collect()} == {"allow"}
