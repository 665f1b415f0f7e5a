import pytest
from pyspark.sql import functions as F

from hirelode import rules
from hirelode.functions import emails
from hirelode.operators import contacts

KEPT = {
    " Info@Firma.DE ": "info@firma.de",
    "http://jobs@firma.de": "jobs@firma.de",
    "HTTP://jobs@firma.de": "jobs@firma.de",
    "in​fo@firma.de﻿": "info@firma.de",
    "in fo@firma.de": "info@firma.de",
    "a@b@firma.de": None,
    "ab@c@firma.de": "ab@c@firma.de",
    "x@mail3.example.com": None,
    "hr@mail3.example.com": "hr@mail3.example.com",
    "testing1@firma.de": "testing1@firma.de",
    "demo-shop@firma.de": "demo-shop@firma.de",
    "salesforce@firma.de": "salesforce@firma.de",
}
REJECTED = [
    "", " ", "nodomain", "@firma.de", "info@", "info@firma", "info@fir..ma.de", "info@firma.de.",
    "a@firma.de", "info@firma.de/x", "info@fir\\ma.de", "für@firma.de", "in fo@firma.de",
    "dpo-x@firma.de", "x+noreply@firma.de", "ab@personion.net", "ab@x.invalid", "ab@x.local",
    "ab@example.com", "ab@doe.com", "ab@site.test", "ab@cdn.min.js", "ab@x.7z", "support@firma.de",
    "kundenbetreuung@firma.de", "bounces-9@firma.de", "privacy.team@firma.de",
    "my-unsubscribe@firma.de", "test12@firma.de", "demo.@firma.de", "fake_7@firma.de",
    "ab@we.that", "a\tb@firma.de", None,
]


def test_normalize_keeps(values):
    assert values(emails.normalize_email, *KEPT) == list(KEPT.values())


def test_normalize_rejects(values):
    assert values(emails.normalize_email, *REJECTED) == [None] * len(REJECTED)


def test_normalize_is_idempotent(values):
    kept = [k for k in KEPT.values() if k]
    assert values(emails.normalize_email, *kept) == kept


@pytest.mark.parametrize("local", rules.BLOCKED_LOCALPARTS)
def test_every_blocked_local_part_is_a_word_of_its_own(local):
    assert local == local.strip().lower() and "@" not in local


def test_blocked_lists_reject(values):
    bad = [f"{x}@firma.de" for x in rules.BLOCKED_LOCALPARTS]
    bad += [f"{x}1@firma.de" for x in rules.BLOCKED_LOCAL_PREFIXES]
    bad += [f"x{x}y@firma.de" for x in rules.BLOCKED_LOCAL_FRAGMENTS]
    bad += [f"info@{x}" for x in rules.BLOCKED_DOMAINS]
    bad += [f"info@x{x}" for x in rules.BLOCKED_DOMAIN_SUFFIXES + rules.BLOCKED_FILE_SUFFIXES]
    assert values(emails.normalize_email, *bad) == [None] * len(bad)


def test_find_emails_plain_and_obfuscated(values):
    got = values(
        emails.find_emails,
        "Mail Info@Firma.de or hr (at) firma (dot) de.",
        "jobs[AT]firma[DOT]de, x at y dot org",
        "äinfo@firma.de",
        "no address here. at all",
        "",
        None,
    )
    assert set(got[0]) == {"Info@Firma.de", "info@firma.de", "hr@firma.de"}
    assert set(got[1]) == {"jobs@firma.de", "x@y.org"}
    assert got[2] == []
    assert got[4] == [] and got[5] == []


def test_mailto_in_any_case(values):
    got = values(emails.mailto_address, "MAILTO:Info%40Firma.de?subject=x", "https://a.de", "mailto:", None)
    assert got == ["info@firma.de", None, None, None]


def test_asset_emails(values):
    got = values(
        emails.is_asset_email, "logo@2x.PNG", "a@domain.com", "x@sub.domain.com",
        "0123456789abcdef@sentry.io", "0123@sentry.io", "domain.com",
    )
    assert got == [True, True, False, True, False, True]


def test_page_emails_reads_source_text_and_mailto(spark):
    html = """<html><head><title>t@head.de</title></head><body><script>var e='no@script.de'</script>
    <p>Write to jo<b>bs</b>@firma.de</p><!-- c@comment.org -->
    <a href="MAILTO:team%40firma.de?x=1">us</a><p>info&#64;firma.de</p>
    <img src="logo@2x.png"></body></html>"""
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    got = {r.email for r in contacts.page_emails(pages).collect()}
    # The source is searched as it is, scripts and comments included.
    assert {"jobs@firma.de", "team@firma.de", "info@firma.de", "no@script.de"} <= got
    assert "logo@2x.png" not in got


def test_first_hit_page(spark):
    rows = [("a", 2, "x@a.de"), ("a", 2, "y@a.de"), ("a", 3, "z@a.de"), ("b", 7, "x@b.de"), ("a", 2, "x@a.de")]
    df = spark.createDataFrame(rows, "website string, rank int, email string")
    got = sorted(tuple(r) for r in contacts.first_hit_page(df).collect())
    assert got == [("a", 2, "x@a.de"), ("a", 2, "y@a.de"), ("b", 7, "x@b.de")]


def test_tracked_emails_are_screened_again(spark):
    known = spark.createDataFrame([("Info@firma.de",), ("support@firma.de",)], "email string")
    new = spark.createDataFrame([("hr@firma.de",), ("info@firma.de",)], "email string")
    got = sorted(r.email for r in contacts.tracked_emails(new, known).collect())
    assert got == ["hr@firma.de", "info@firma.de"]


def test_patterns_stay_in_the_jvm(spark, plan):
    df = spark.range(1).select(emails.normalize_email(F.lit("a@b.de")))
    assert "EvalPython" not in plan(df)
