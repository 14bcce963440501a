import numpy as np

from mailsift.functions import constants as K
from mailsift.operators import models as MD
from mailsift.operators import surrogate as SG
from mailsift.operators.models import LinearModel
from mailsift.operators.tfidf import TfidfModel

TFIDF = TfidfModel([("alpha", 0, 2, 3, 1.5), ("alpha beta", 1, 2, 2, 1.3), ("beta", 2, 2, 2, 1.2)], 5)
MODEL = LinearModel("Logistic Regression", [2.0, 0.7, -2.0, 0.3, 0.2, 0.1, -0.4, 0.05, 0.9], 0.1, True, [])
TEXTS = ["alpha beta alpha!! verify now at http://www.x.org", "the beta of alpha", "", "Urgent CARD alpha-beta beta", "ünïcode wörds alpha 12"]


def test_copies_are_scored_as_the_plan_scores_texts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "row_id long, text string")
    margins = {r.row_id: r.m for r in MD.featurise(TFIDF, df, keep=["row_id"]).select("row_id", MODEL.margin().alias("m")).collect()}
    scorer = SG.TextScorer.of(TFIDF, MODEL)
    for i, t in enumerate(TEXTS):
        assert abs(scorer.margin(t) - margins[i]) < 1e-9


def test_weights_recover_the_driving_word():
    rng = np.random.default_rng(0)
    z = (rng.random((200, 4)) < 0.5).astype(float)
    z[0] = 1
    found = SG._weights(z, 0.2 + 0.6 * z[:, 2], ["a", "b", "c", "d"], 2)
    assert found[0][0] == "c" and found[0][1] > 0


def test_hard_probabilities_for_a_model_without_margin():
    hard = LinearModel("x", MODEL.coef, 0.1, False, [], {"has_margin": False})
    assert {SG.TextScorer.of(TFIDF, hard).probability(t) for t in TEXTS} <= {0.0, 1.0}


def test_explanations_do_not_depend_on_the_partitioning(spark):
    rows = [(i, t, K.PHISHING) for i, t in enumerate(TEXTS + ["alpha beta gamma delta epsilon zeta alpha"])]
    df = spark.createDataFrame(rows, "uid long, cleaned_text string, prediction string")
    run = lambda d: sorted(map(str, SG.local_surrogate(TFIDF, MODEL, d, 60).collect()))
    assert run(df.coalesce(1)) == run(df.repartition(5))
    by = {r.uid: r for r in SG.local_surrogate(TFIDF, MODEL, df, 60).collect()}
    assert by[2].surrogate_features == [] and by[5].surrogate_features[0].feature in ("alpha", "beta")


ODD = TEXTS + ["Verify NOW, verify  now sign in sign\tin", "http://a http:b//c https://www.d www.e. WWW.f", "http:x//y alpha", "ΑΣ ΟΔΟΣ alpha", "İstanbul alpha beta",
               "alpha gamma beta, alpha: beta alpha alpha beta the beta", "a b c d", "!!! ... ", "x_1 alpha_beta alpha the beta", "beta alpha " * 300]


def test_margins_of_all_copies_are_those_of_their_texts():
    rng = np.random.default_rng(3)
    for tfidf in (TFIDF, TfidfModel(TFIDF.vocab, 5, sublinear=False), TfidfModel(TFIDF.vocab[::2], 5, n_max=1)):
        model = MODEL if len(tfidf.vocab) == 3 else LinearModel("x", MODEL.coef[1:], 0.1, True, [])
        scorer = SG.TextScorer.of(tfidf, model)
        for text in ODD:
            copies = SG.Copies(text)
            z = (rng.random((60, len(copies.words))) < 0.6).astype(float)
            z[0] = 1
            want = [scorer.margin(copies.text_of(row)) for row in z]
            assert np.allclose(copies.margins(z, scorer), want, rtol=0, atol=1e-9), text


def test_matrix_products_are_faster_than_texts():
    import time
    rng = np.random.default_rng(4)
    terms = sorted({f"w{i}" for i in range(400)} | {f"w{i} w{j}" for i in range(0, 400, 7) for j in range(0, 400, 9)})
    tfidf = TfidfModel([(t, i, 2, 2, 1.5) for i, t in enumerate(terms)], 50)
    scorer = SG.TextScorer.of(tfidf, LinearModel("x", rng.standard_normal(len(terms) + 6).tolist(), 0.0, True, []))
    copies = SG.Copies(" ".join(f"w{i}" for i in rng.integers(0, 400, 1200)))
    z = (rng.random((500, len(copies.words))) < 0.5).astype(float)
    scorer.pairs()
    begin = time.perf_counter()
    fast = copies.margins(z, scorer)
    middle = time.perf_counter()
    slow = [scorer.margin(copies.text_of(row)) for row in z]
    end = time.perf_counter()
    assert np.allclose(fast, slow, atol=1e-9) and end - middle > 5 * (middle - begin)


LOWER = [t.lower() for t in ODD] + ["beta alpha of alpha beta alpha alpha beta", "alpha the x of beta alpha beta beta", "alpha " * 70 + "gamma beta", "verify now http://www.x.org alpha beta ! card"]


def test_pairs_of_lower_case_texts_are_counted_by_candidates(monkeypatch):
    def refused(*_):
        raise AssertionError("all places of all copies were looked at")
    monkeypatch.setattr(SG.Copies, "_side_by_side", refused)
    rng = np.random.default_rng(5)
    again = TfidfModel([*TFIDF.vocab, ("alpha alpha", 3, 2, 2, 1.1), ("beta alpha", 4, 2, 2, 1.7), ("the beta", 5, 2, 2, 1.7)], 5)
    coef = [2.0, 0.7, -2.0, 0.9, -0.6, 5.0, 0.3, 0.2, 0.1, -0.4, 0.05, 0.9]
    for tfidf in (again, TfidfModel(again.vocab, 5, sublinear=False)):
        scorer = SG.TextScorer.of(tfidf, LinearModel("x", coef, 0.1, True, []))
        for text, held in [(t, SG._HELD) for t in LOWER] + [(LOWER[0], 1), (LOWER[-4], 1)]:
            monkeypatch.setattr(SG, "_HELD", held)  # the copies in parts of 64, too
            copies = SG.Copies(text)
            z = (rng.random((150, len(copies.words))) < 0.5).astype(float)
            z[0], z[1] = 1, 0
            if copies._plain(scorer):
                want = [scorer.margin(copies.text_of(row)) for row in z]
                assert np.allclose(copies.margins(z, scorer), want, rtol=0, atol=1e-9), text


def test_copies_are_drawn_as_before():
    for d in (1, 2, 7, 40):
        rng = np.random.default_rng([42, SG.crc32(b"text")])
        want = np.ones((30, d))
        for i in range(1, 30):
            want[i, rng.permutation(d)[:rng.integers(1, d + 1)]] = 0
        assert (SG.drawn_copies("text", d, 30, 42) == want).all()


def test_selection_makes_only_chosen_columns_orthogonal(monkeypatch):
    rng = np.random.default_rng(6)
    x, t = rng.standard_normal((200, 30)), rng.standard_normal(200)
    want = SG._selected_whole(x, t, 6)
    twice = np.column_stack([x[:, :3], x[:, :2]])  # dependent columns: nothing is left of the copies
    assert SG._selected(twice, t, 5)[:3] == SG._selected_whole(twice, t, 5)[:3]
    noise = 1e-16 * rng.random(200)  # a constant's rounding
    assert SG._selected(x, noise, 6) == SG._selected_whole(x, noise, 6)

    def refused(*_):
        raise AssertionError("all columns were made orthogonal")
    monkeypatch.setattr(SG, "_selected_whole", refused)
    assert SG._selected(x, t, 6) == want
