"""Tokeniser, stop words and 1/2-grams."""

from tuneshelf.functions import fixed
from tuneshelf.functions.text import with_terms


def terms_of(spark, text):
    df = with_terms(spark.createDataFrame([(text,)], "t string"), "t")
    return df.collect()[0]["terms"]


def test_stop_word_list_size():
    assert len(fixed.STOP_WORDS) == 318 and len(set(fixed.STOP_WORDS)) == 318


def test_unicode_word_runs(spark):
    assert terms_of(spark, "Beyoncé 東京") == ["beyoncé", "東京", "beyoncé 東京"]


def test_single_chars_dropped_and_bigrams_after_stop_words(spark):
    # "the" and "of" are stop words; "a" and "9" are one character
    assert terms_of(spark, "The best of a 9 Rock Song") == ["best", "rock", "song", "best rock", "rock song"]


def test_repeats_kept(spark):
    assert terms_of(spark, "pop pop pop") == ["pop", "pop", "pop", "pop pop", "pop pop"]


def test_empty_and_one_token(spark):
    assert terms_of(spark, "") == []
    assert terms_of(spark, "jazz") == ["jazz"]
    assert terms_of(spark, None) == [] or terms_of(spark, None) is None
