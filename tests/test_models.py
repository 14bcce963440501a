import math

import numpy as np
from pyspark.sql import functions as F
from pytest import approx

from mailsift.operators import models as MD
from mailsift.operators.tfidf import TfidfModel

DOCS = [(1, "cheap pills cheap offer now", "phishing"), (2, "meeting notes attached offer", "legitimate"),
        (3, "cheap offer click now", "phishing"), (4, "project meeting tomorrow notes", "legitimate"),
        (5, "notes from the meeting", "legitimate")]


def test_tfidf_idf_and_norm(spark):
    df = spark.createDataFrame(DOCS, "row_id long, text string, label string")
    m = TfidfModel.fit(df, min_df=2, max_features=100)
    voc = {t: (ix, d, idf) for t, ix, d, _, idf in m.vocab}
    assert [t for t, *_ in m.vocab] == sorted(voc)
    assert voc["cheap"][2] == approx(math.log(6 / 3) + 1)
    for r in m.transform(df).collect():
        if r.pairs:
            assert sum(p.w ** 2 for p in r.pairs) == approx(1.0)


def test_naive_bayes_matches_closed_form(spark):
    df = spark.createDataFrame(DOCS, "row_id long, text string, label string")
    m = TfidfModel.fit(df, min_df=2, max_features=100)
    feats = MD.featurise(m, df)
    nf = m.size + 6
    nb = MD.fit_naive_bayes(feats, nf, MD.feature_names(m))
    X = np.zeros((len(DOCS), nf))
    y = []
    for i, r in enumerate(sorted(feats.collect(), key=lambda r: r.row_id)):
        for p in r.pairs:
            X[i, p.ix] = p.w
        y.append(r.label)
    y = np.array(y)
    fc = {c: X[y == c].sum(0) + 1.0 for c in ("legitimate", "phishing")}
    lp = {c: np.log(fc[c] / fc[c].sum()) for c in fc}
    assert nb.coef == approx(list(lp["phishing"] - lp["legitimate"]))
    assert nb.intercept == approx(math.log(2 / 3))
    margins = {r.row_id: r.margin for r in nb.score(feats).collect()}
    for i, rid in enumerate(sorted(margins)):
        assert margins[rid] == approx(float(X[i] @ (lp["phishing"] - lp["legitimate"]) + math.log(2 / 3)))
