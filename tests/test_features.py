from pytest import approx

from conftest import one
from mailsift.functions import features as FE


def test_link_count_non_overlapping(spark):
    assert one(spark, FE.link_count("x"), ["HTTP://www.a.com https://b", None]) == [3, 0]


def test_keywords_are_substrings(spark):
    assert one(spark, FE.has_payment_words("x"), ["discard", "nothing"]) == [1, 0]
    assert one(spark, FE.has_urgent_words("x"), ["VERIFY NOW please"]) == [1]


def test_exclamations_and_uppercase(spark):
    assert one(spark, FE.exclamation_count("x"), ["a!!b!", ""]) == [3, 0]
    assert one(spark, FE.uppercase_ratio("x"), ["ABcd1!", "123", "ÉÉéé"]) == approx([0.5, 0.0, 0.5])
