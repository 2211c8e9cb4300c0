import re

import pytest

from spanveil.llm import urls
from spanveil.llm.queries import URL_RULES

URLS = [
    (1, "http://Example.ORG/es/1?x=1"),
    (2, "https://www.example.org/en/12#a"),
    (3, "https://a.b.org"),
    (4, "http://org/"),
    (5, "http://myorg/x"),
    (6, "https://shop.com/fr/casino"),
    (7, "https://shop.com/de/"),
    (8, "https://cheap-pills.net/x"),
    (9, "https://cheap.net/x"),
    (10, "https://cheap.net/cheap?cheap=1"),
    (11, "https://casinos1.net/"),
    (12, "https://CASINO-win.net"),
    (13, "no scheme casino"),
    (14, None),
    (15, ""),
    (16, "https://example.org:80/es/"),
    (17, "https://x.net/" + "a" * 50000 + "/spam"),
    (17, "https://x.net/" + "a" * 50000 + "/spam"),
    (None, "ftp://weird.net/%20free?bets"),
]


def plain(url):
    """Rules and vocabulary by regular expressions."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.text), default=None)
    hit = lambda t: bool(re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", (url or "").lower()))
    bad = any(map(hit, urls.STRICT)) or sum(map(hit, urls.SOFT)) >= 2
    return host, path, rule.text if rule else None, rule.verdict if rule else "block" if bad else "allow"


def test_judgement_equals_plain_version(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in URLS], "page_id long, url string, host string, verdict string")
    got = sorted((tuple(r)[:5] for r in urls.judge(pages, URL_RULES).collect()), key=repr)
    assert got == sorted(((i, *plain(u)) for i, u in URLS), key=repr)


def test_empty_table_and_empty_vocabulary(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none, URL_RULES).count() == 0
    one = spark.createDataFrame([(1, "http://casino.net/")], "page_id long, url string")
    assert urls.judge(one, (), urls.Vocabulary((), ())).first()["verdict"] == "allow"


@pytest.mark.parametrize(("url", "terms"), [("http://a.net/xcasino", {}), ("http://a.net/casino", {"casino": 2}), ("http://free.bets/", {"free": 1, "bets": 1})])
def test_terms_need_boundaries(url, terms):
    assert urls.Judge(urls.Vocabulary(), ()).hits(url) == terms
