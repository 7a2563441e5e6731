"""The quality scorer is fitted in a task: no sampled text and no features come to the driver."""

import os

import numpy as np

from anamnesis.llm import quality as Q


def test_scorer_is_fitted_outside_the_driver(spark, monkeypatch):
    driver, plain = os.getpid(), Q.fit_scorer

    def fitted(*args):
        assert os.getpid() != driver
        return plain(*args)

    good = "The river rises in the hills, and it runs for many miles through quiet fields. Nobody knows why."
    texts = [f"{good} {k} {good[k:]}" for k in range(30)] + ["$$ ## buy buy buy buy buy buy buy buy buy NOW %% && " * 3 + str(k) for k in range(10)] + [None, "", "  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted(Q.scored(docs).collect())
    monkeypatch.setattr(Q, "fit_scorer", fitted)
    assert sorted(Q.scored(docs).collect()) == want
    # the plain definition: features of one text after another, in the order of the hash
    sample = docs.where("length(text) > 0").selectExpr("doc_id", "text", "shiftrightunsigned(xxhash64(doc_id, text), 34) AS h").orderBy("h", "doc_id").collect()
    belief, rows, target = {r.doc_id: r.posterior for r in want}, [], []
    for r in sample:
        data = np.frombuffer(r.text.encode(), np.uint8)
        m, word, bounds, _ = Q.measures(data, np.array([0, len(data)]))
        rows += Q.hashed(m, word, bounds, Q.BITS)
        target.append(belief[r.doc_id])
    w = plain(rows, np.array(target), Q.BITS).astype(np.float32)
    score = {r.doc_id: r.score for r in want}
    for (index, value), r in zip(rows, sample, strict=True):
        if r.text.strip():
            assert abs(score[r.doc_id] - 1 / (1 + np.exp(-(w[index] @ value + w[-1])))) < 1e-6


def test_empty_table(spark):
    assert Q.scored(spark.createDataFrame([], "doc_id long, text string")).collect() == []
