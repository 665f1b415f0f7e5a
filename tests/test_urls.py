import random
from urllib.parse import urljoin, urlparse

from hirelode.functions import urls


def test_clean_url(values):
    assert values(urls.clean_url, "https://a.de/x/?q=1", "https://a.de", None) == [
        "https://a.de/x/", "https://a.de", None,
    ]
    assert values(lambda v: urls.clean_url(v, True), "https://a.de/x//?q") == ["https://a.de/x"]


def test_domain_keeps_port_and_case(values):
    cases = ["https://www.X_y.de:8080/a", "http://WWW.a.de", "a.de/x", "//h.de/x", "mailto:a@b.de", ""]
    assert values(urls.url_domain, *cases) == ["X_y.de:8080", "WWW.a.de", "", "h.de", "", ""]
    assert values(lambda v: urls.url_domain(v, True), "http://WWW.A.de") == ["a.de"]


def test_resolve_agrees_with_the_standard_library(values):
    chance = random.Random(3)
    bases = ["http://h.de", "http://h.de/", "https://h.de/a/b", "https://h.de/a/b/?x=1", "http://h.de:81/a;p"]
    parts = ["..", ".", "a", "b c", "", "x.html", "%20"]
    hrefs = ["", "#f", "?q=1", "/r", "//o.de/x", "HTTPS://O.de/X?y#z", "mailto:a@b.de", "tel:1", "a:b",
             "../../..", "./", "x/../y/./z/..", "/a/./b/../c/", "x//y"]
    hrefs += ["/".join(chance.choices(parts, k=chance.randint(1, 6))) for _ in range(150)]
    pairs = [(b, h) for b in bases for h in hrefs]

    def expected(base, href):
        target = urljoin(base, href)
        if urlparse(target).scheme not in ("http", "https"):
            return None
        return target

    got = values(urls.resolve_url, *pairs, columns=("base", "href"))
    for (base, href), target in zip(pairs, got, strict=True):
        wanted = expected(base, href)
        if wanted is None or target is None:
            assert target == wanted, (base, href)
        else:
            # An empty path and "/" address the same page.
            a, b = urlparse(target), urlparse(wanted)
            assert (a.scheme, a.netloc, a.path or "/", a.query) == (
                b.scheme, b.netloc, b.path or "/", b.query), (base, href)


def test_canonical_url(values):
    assert values(urls.canonical_url, "HTTP://h.de/A/?q#f", "https://h.de/", "https://h.de/a;v=1") == [
        "http://h.de/A", "https://h.de", "https://h.de/a",
    ]


def test_redirects(values):
    redirect = "https://www.google.com/aclk?x=1&adurl=https%3A%2F%2Fa.de%2Fx+y%3Fz&k=2"
    plain = "https://www.google.com/url?q=1"
    assert values(urls.is_redirect, redirect, plain, "https://a.de", None) == [True, True, False, None]
    assert values(urls.redirect_target, redirect, plain, "https://a.de?adurl=x") == [
        "https://a.de/x y?z", None, None,
    ]
    assert values(urls.website_of, redirect, plain, "https://a.de/?u=1", " ") == [
        "https://a.de/x y", None, "https://a.de/", None,
    ]


def test_place_token_keeps_plus(values):
    got = values(urls.place_token, "https://m/data=!4m!1s0x1%3A2+3!8m", "https://m/data=!8m", None)
    assert got == ["0x1:2+3", None, None]


def test_search_url(values):
    assert values(urls.search_url, "a b") == [
        "https://www.linkedin.com/jobs/search/?keywords=a+b&location=Berlin%2C+Germany"
        "&f_TPR=r86400&f_JT=P%2CI"
    ]
