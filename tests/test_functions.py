import re
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from pagetally.functions import agents, uri
from pagetally.sources import territories


def evaluate(spark, texts, **columns):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return rows.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()


URIS = {
    # text: (scheme, host, path, referrer)
    "https://example.com/a/b?c#d": ("https", "example.com", "/a/b", "example.com"),
    "HTTP://user:p@ss@Example.com:8080": ("http", "Example.com", None, "Example.com"),
    "//cdn.example.com/x": (None, "cdn.example.com", "/x", "cdn.example.com"),
    "http://[::1]:80/x": ("http", "::1", "/x", "::1"),
    "example.com": (None, None, "example.com", "example.com"),
    "example.com/path?x": (None, None, "example.com/path", "example.com/path"),
    "mailto:a@b": ("mailto", None, "a@b", None),
    "android-app://com.app": ("android-app", "com.app", None, "com.app"),
    "?q=1": (None, None, None, None),
    "#top": (None, None, None, None),
    "file:///etc/x": ("file", None, "/etc/x", None),
    "/only/path": (None, None, "/only/path", "/only/path"),
    "/a?b/c#d": (None, None, "/a", "/a"),
    "/a#d?e": (None, None, "/a", "/a"),
    "": (None, None, None, None),
}


def test_uri_parts(spark):
    x = F.col("x")
    got = evaluate(spark, URIS, s=uri.scheme(x), h=uri.host(x), p=uri.path(x), r=uri.referrer(x))
    assert {text: tuple(row)[1:] for text, row in zip(URIS, got)} == URIS


DECODED = ["a+b", "a%20b", "%zz", "100%", "caf%C3%A9", "%2B+%25", "%e2%82%ac", "a%2", "%%41"]


def test_percent_decode(spark):
    got = evaluate(spark, DECODED, d=uri.percent_decode(F.col("x")))
    assert [r["d"] for r in got] == [unquote(t) for t in DECODED]


QUERIES = {
    "?utm_source=a&utm_source=b": "b",
    "utm_source=a+b%20c": "a+b c",
    "??utm_source=x": "x",
    "utm_source": "",
    "utm_source=": "",
    "utm_source=a=b": "a=b",
    "utm%5Fsource=k": "k",
    "xutm_source=k": None,
    "&&utm_source=z&": "z",
    "": None,
    "other=1": None,
}


def test_last_value(spark):
    got = evaluate(spark, QUERIES, v=uri.last_value(uri.query_pairs(F.col("x")), "utm_source"))
    assert {text: row["v"] for text, row in zip(QUERIES, got)} == QUERIES


ALLOWED = {
    "?utm_source=a&x=1&utm_medium=b&utm_source=c d": "?utm_source=c+d&utm_medium=b",
    "x=1&y=2": "",
    "": "",
    "utm_content=caf%C3%A9+x": "?utm_content=caf%C3%A9+x",
}


def test_keep_allowed(spark):
    got = evaluate(spark, ALLOWED, v=uri.keep_allowed(F.col("x")))
    assert {text: row["v"] for text, row in zip(ALLOWED, got)} == ALLOWED


def test_null_passes(spark):
    x = F.lit(None).cast("string")
    row = spark.range(1).select(
        uri.host(x).alias("h"), uri.path(x).alias("p"), uri.referrer(x).alias("r"), uri.is_absolute(x).alias("a"),
        uri.last_value(uri.query_pairs(x), "k").alias("v"), agents.is_bot(x).alias("b"), agents.browser(x).alias("w"),
    ).first()
    assert tuple(row) == (None,) * 7


def test_strip_www_and_local_hosts(spark):
    x = F.col("x")
    hosts = ["www.example.com", "www.www.a", "a.www.b", "localhost", "172.31.0.1", "172.32.0.1", "10.0.0.1"]
    got = evaluate(spark, hosts, s=uri.strip_www(x), l=uri.is_local_host(x))
    assert [r["s"] for r in got] == ["example.com", "a", "a.www.b", *hosts[3:]]
    assert [r["l"] for r in got] == [False, False, False, True, True, False, True]


AGENTS = {
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/121.0.0.0 Safari/537.36 Edg/121.0.2277": (
        "Microsoft Edge", "121.0.2277", "Windows", "10.0"),
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_3_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) CriOS/121.0.6167.66 Mobile/15E148 Safari/604.1": (
        "Chrome", "121.0.6167.66", "iOS", "17.3.1"),
    "Mozilla/5.0 (iPad; CPU OS 17_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Safari/604.1": (
        "Safari", "17.1", "iOS", "17.1"),
    "Mozilla/5.0 (Linux; Android 12; SM-G991B) AppleWebKit/537.36 (KHTML, like Gecko) SamsungBrowser/23.0 Chrome/115.0.0.0 Mobile Safari/537.36": (
        "Samsung Browser", "23.0", "Android", "12"),
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/16.6 Safari/605.1.15": (
        "Safari", "16.6", "macOS", "10.15.7"),
    "Mozilla/5.0 (X11; Linux x86_64; rv:122.0) Gecko/20100101 Firefox/122.": ("Firefox", "122", "GNU/Linux", None),
    "something else": (None, None, None, None),
}


def test_agents(spark):
    x = F.col("x")
    got = evaluate(
        spark, AGENTS, b=agents.browser(x), v=agents.browser_version(x), o=agents.operating_system(x),
        w=agents.operating_system_version(x), bot=agents.is_bot(x),
    )
    assert {text: tuple(row)[1:5] for text, row in zip(AGENTS, got)} == AGENTS
    assert not any(r["bot"] for r in got)


@pytest.mark.parametrize("name", ["Googlebot/2.1", "my-CRAWLER", "HeadlessChrome/1", "curl/8.0"])
def test_bots(spark, name):
    assert evaluate(spark, [name], bot=agents.is_bot(F.col("x")))[0]["bot"]


def test_zone_and_country_files(spark):
    zones = {r["zone"]: r["country_code"] for r in territories.zone_territories(spark).collect()}
    names = {r["country_code"]: r["name"] for r in territories.territory_names(spark).collect()}
    assert zones["Europe/Paris"] == "FR" and names["FR"] == "France"
    assert all(re.fullmatch("[A-Z]{2}", code) for code in zones.values())
