from pyspark.sql import functions as F

from conftest import one
from mailsift.functions import text as T
from mailsift.operators.tfidf import term_frequencies


def test_clean_text_label_boundary(spark):
    got = one(spark, T.clean_text("x"), ["subject:hello", "Subject: hello", None])
    assert got == ["hello", "subject: hello", ""]


def test_clean_text_single_pass_keeps_double_blanks(spark):
    assert one(spark, T.clean_text("x"), ["a  Subject:Re from:bob body:x"]) == ["a  re  bob  x"]


def test_clean_text_unicode_whitespace(spark):
    assert one(spark, T.clean_text("x"), [" A  b\x1c\x85c\t"]) == ["a b c"]


def test_normalise_label(spark):
    got = one(spark, T.normalise_label("x"), [" SPAM ", "Safe Email", "1", "1.0", None, "benign"])
    assert got == ["phishing", "legitimate", "phishing", "1.0", "", "legitimate"]


def test_strip_html(spark):
    assert one(spark, T.strip_html("x"), ["<p>a &amp; b</p><script>x</script>"]) == ["a &amp; b x"]


def test_tokens_ngrams(spark):
    toks = one(spark, T.tokens("x"), ["The quick, brown fox_1 a é-été"])
    assert toks == [["the", "quick", "brown", "fox_1", "été"]]
    grams = one(spark, T.ngrams(T.drop_stop_words(T.tokens("x"))), ["the quick brown fox"])
    assert grams == [["quick", "brown", "fox", "quick brown", "brown fox"]]
    assert one(spark, T.ngrams(T.tokens("x")), ["x", ""]) == [[], []]


def test_term_counts_in_row(spark):
    df = spark.createDataFrame([(1, "spam spam eggs spam"), (2, ""), (3, "and the")], "row_id long, text string")
    rows = sorted((r.row_id, r.term, r.tf) for r in term_frequencies(df).collect())
    assert rows == [(1, "eggs", 1), (1, "eggs spam", 1), (1, "spam", 3), (1, "spam eggs", 1), (1, "spam spam", 1)]


def test_strip_ws_unicode_ends(spark):
    assert one(spark, T.strip_ws("x"), ["　\x85 a b \x1f", "\xa0"]) == ["a b", ""]


def test_terms_are_made_once_however_they_are_listed(spark):
    from mailsift.operators import tfidf as TF
    docs = spark.createDataFrame([(1, "cheap pills cheap"), (2, ""), (3, None), (4, "the")], "row_id long, text string")
    frequencies = TF.term_frequencies(docs)
    assert sorted(map(tuple, frequencies.collect())) == [(1, "cheap", 2), (1, "cheap pills", 1), (1, "pills", 1), (1, "pills cheap", 1)]
    model = TF.TfidfModel([("cheap", 0, 1, 2, 1.0)], 4)
    for df in (frequencies, TF.document_frequencies(TF.doc_terms(docs)), model.long_form(docs)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1
    assert [r.row_id for r in model.long_form(docs).collect()] == [1]
