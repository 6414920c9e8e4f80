import re

from tests.llm.conftest import rows_of
from tickloom.llm import url_filters as u

URLS = [
    (1, "https://www.Example.com/en/1?x=/net/es/"), (2, "http://example.com/en"), (3, "ftp://a.example.com/en/#t"), (4, None), (5, ""),
    (6, "no scheme"), (7, "x://net/es/9"), (8, "https://sub.net/fr/"), (9, "https://subnet/fr/"), (None, "https://a.com/"), (11, "https://a.com"),
    (12, "https://a.b.spam-farm.org/x"), (13, "https://h.org/get/tool.exe"), (14, "https://h.org/tool.exec"), (15, "a://b://c.com/"),
    (7, "x://net/es/9"), (16, "https://WWW.EXAMPLE.COM/EN/"), (17, "https://example.com/english"), (18, "https://x.com/\n"), (19, "://com/"),
]


def brute(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for rule in u.RULES:
        h, p = rule.shown.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append(rule)
    if fits:
        best = max(fits, key=lambda r: len(r.shown))
        return host, path, best.shown, best.verdict
    own = any(re.search(r.pattern, f"{host}#{path}") for r in u.OWN_RULES)
    return host, path, None, "block" if own else "allow"


def test_equals_every_rule_tried(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").selectExpr("*", "1 AS rule", "2 AS host", "3 AS token")
    assert rows_of(u.judge(pages)) == sorted(((i, *brute(x)) for i, x in URLS), key=str)


def test_whole_table_and_empty(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert rows_of(u.judge(pages)) == sorted(((r["page_id"], *brute(r["url"])) for r in pages.collect()), key=str)
    assert u.judge(pages.where("false")).count() == 0


def test_rarest_token(spark):
    pages = spark.createDataFrame([("example.com", "/en/")] * 9 + [("www.example.com", "/de/")], "host string, path string")
    index = {r["shown"]: r["token"] for r in u.rule_index(pages, u.RULES).collect()}
    assert index["www.example.com/en/"] == "h:www" and index["example.com/en/"] == "p:en"
