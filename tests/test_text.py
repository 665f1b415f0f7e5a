import html
import random
import urllib.parse

import pytest
from pyspark.sql import functions as F

from hirelode.functions import text


def test_trim_removes_every_unicode_blank(values):
    got = values(text.utrim, "\t a  ", " b　", "\x1cc\x1f", "", None, "a b")
    assert got == ["a", "b", "c", "", None, "a b"]


def test_fold_umlauts(values):
    got = values(text.fold_umlauts, " KÖLN ", "Straße", "Äpfel", None)
    assert got == ["koeln", "strasse", "aepfel", ""]


def test_first_non_empty_takes_the_first_with_text(values):
    both = lambda a, b: text.first_non_empty(a, b, default="none")
    assert values(both, ("  ", "x"), ("y ", "x"), (None, ""), columns=("a", "b")) == ["x", "y", "none"]
    first = lambda a, b: text.first_only(a, "none")
    assert values(first, ("  ", "x"), ("y", "x"), columns=("a", "b")) == ["none", "y"]


def test_clean_text_drops_other_letters(values):
    got = values(text.clean_text, "Für  Python/SQL & C++", "", None, "a\n\nb")
    assert got == ["f r python sql c", "", "", "a b"]


def test_clean_text_is_idempotent(spark):
    once = spark.range(1).select(text.clean_text(F.lit(" Ä-b  C#d ")).alias("v"))
    assert once.select(text.clean_text("v") == F.col("v")).first()[0]


def test_tokens_are_distinct_and_empty_for_blank_text(values):
    got = values(text.tokens, "b a B, a", "", "***")
    assert [sorted(g) for g in got] == [["a", "b"], [], []]


def test_whole_word_respects_umlauts_and_quotes_the_word(values):
    assert values(lambda v: text.contains_whole_word(v, "ai"), "an ai.", "aiä", "mail", "ai") == [
        True, False, False, True,
    ]
    assert values(lambda v: text.contains_whole_word(v, "a.i"), "a.i", "axi") == [True, False]


def test_contains_any_is_a_substring_test(values):
    words = ("data", "data engineer", "ci/cd", "c++")
    got = values(lambda v: text.contains_any(v, words), "metadata", "my ci/cd", "use c++", "c", "")
    assert got == [True, True, True, False, False]
    assert text.needed(words) == ["data", "ci/cd", "c++"]


def test_unquote_keeps_plus_and_bad_escapes(values):
    assert values(text.unquote, "a%20b+c", "100%", "%zz", "ok", None) == [
        "a b+c", "100%", "%zz", "ok", None,
    ]
    mixed = ("a%20b%zz", "100%25%", "%%20", "%C3%A9%", "a%2", "%2%41", "+%2B+")
    assert values(text.unquote, *mixed) == [urllib.parse.unquote(v) for v in mixed]


def test_references_are_decoded_once_and_by_their_html5_names(values):
    shapes = (
        "&#38;lt; &lt;", "&amp;lt;", "&#x26;amp;", "team&commat;firma.de", "&NotEqualTilde;", "&nosuch;", "a & b",
        "&#128;&#x99;", "&#0;", "&#xD800;", "&auml;&Auml;&#228;", "&&amp;&", "", "plain", "&lt;&gt;&quot;&apos;",
        "line\n&amp;\nline", "&fjlig;", "&#1114112;", "f&uuml r", "&uumlber", "a&ltb", "x&ampy", "&notit; &notin;", "&AMP",
        "&#00000000065;", "&#65 &#x41g", "&#x000000000000000000000000041;", "&#99999999999999999999999;", "&#xFFFFFFFFFFFFFFFF",
        "&#1;&#11;&#127;&#xFDD0;&#xFFFF;&#x1FFFE;&#9;", "&#;", "&#x;", "&#xg", "&copycat", "&frac12x", "&sup;&sup2", "&unknown&lt",
    )
    assert values(text.unescape_html, *shapes) == [html.unescape(v) for v in shapes]
    assert values(text.unescape_html, None) == [None]


def test_form_encode(values):
    assert values(text.form_encode, "a b~*ü-_.", "P,I") == ["a+b~%2A%C3%BC-_.", "P%2CI"]


def test_unescape_html(values):
    got = values(
        text.unescape_html, "a&amp;b", "&amp;lt;", "&lt;p&gt;", "x&#64;y", "&#x40;", "&uuml;&nope;",
        "&#55296;", "plain", None,
    )
    assert got == ["a&b", "&lt;", "<p>", "x@y", "@", "ü&nope;", "\ufffd", "plain", None]


def test_rounding_equals_exact_decimal_rounding(spark):
    chance = random.Random(7)
    cases = [2.675, 3.125, 0.125, 0.375, 2.665, 1.005, 0.285, 100.0, 0.0, -2.675, -3.125, 1e-9, 99.995]
    cases += [chance.uniform(-100, 100) for _ in range(2000)]
    cases += [m / t * 100 for t in (7, 16, 32, 96, 160) for m in range(t)]
    df = spark.createDataFrame([(c,) for c in cases], "x double")
    for x, r in df.select("x", text.round_half_even(F.col("x"))).collect():
        assert r == pytest.approx(round(x, 2), abs=0), x


def test_let_evaluates_once(spark, plan):
    df = spark.range(3).select(text.let(F.col("id") + 1, lambda x: x * x + x).alias("v"))
    assert [r.v for r in df.orderBy("v").collect()] == [2, 6, 12]
