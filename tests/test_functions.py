import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from lodestar.functions import dates, scores, text, urls

NOW = "2026-10-21T12:00:00Z"


def test_tokenize(one):
    assert one(text.tokenize, a="Zug7 東京駅前 1984, ほし") == ["zug7", "東京", "京駅", "駅前", "1984", "ほし"]
    assert one(text.tokenize, a="k 川 Ünï_x") == ["k", "川", "ünï", "x"]
    assert one(text.tokenize, a="Ünï_x, 9 k") == ["ünï", "x", "9", "k"]
    assert one(text.tokenize, a="") == []


def test_normalize_and_hashes(one):
    assert one(text.normalize_text, a="  a \t\r\nb\n\n\n\n c  ") == "a\nb\n\n c"
    sha = one(text.content_sha, a="green tea\nat noon")
    assert sha == one(text.content_sha, a="\n green tea \t\r\nat noon  \n") == hashlib.sha256(b"green tea\nat noon").hexdigest()[:16]
    assert one(text.fnv1a32, a="foobar") == 3214735720
    assert one(text.fnv1a32, a="") == 2166136261
    assert one(text.short_hash, a="foobar") == "bf9cf968"
    full = hashlib.sha256("c\0hello".encode()).digest()
    assert one(lambda a: text.content_id(F.lit("c"), a), a="hello") == str(int.from_bytes(full[:8], "big"))


def test_tags(one):
    assert one(text.expand_tags, a=["#art/jazz/live", " ", "q", "art"]) == ["art", "art/jazz", "art/jazz/live", "q"]
    assert one(text.parse_tags, a="#a, b ,,c") == ["a", "b", "c"]
    assert one(text.tags_text, a=["a/b", "c"]) == "a b c"
    assert one(text.clean_list, a=[" a", "a", ""]) == ["a"]


def test_names(one):
    assert one(lambda a: text.truncate_runes(a, 3), a="çöğüş") == "çöğ…"
    assert one(lambda a: text.truncate_runes(a, 1), a="🚲🚲") == "🚲…"
    assert one(lambda a, b: text.doc_slug(a, b), a="Tea & Cake? 東京", b="") == "tea---cake--東京"
    assert one(lambda a, b: text.doc_slug(a, b), a=" ", b="https://x.com/a/Some-Page?x=1") == "some-page"
    assert one(lambda a, b: text.doc_slug(a, b), a="", b="") == "document"
    assert one(text.sanitize_segment, a=" Ab C!./") == "ab-c"
    assert one(text.safe_key, a="docs/a.md") == "docs/a.md"
    assert one(text.safe_key, a="docs/a b.md").startswith("docs/a_b.md__")
    assert one(text.safe_key, a="") == "direct_text"
    assert one(text.title_from_text, a="\n## \n#  The title\nx") == "The title"


def test_front_matter(one):
    assert one(text.strip_front_matter, a="---\na: 1\n---\nbody") == "body"
    assert one(text.strip_front_matter, a="﻿---\r\na: 1\r\n---\r\nbody") == "body"
    assert one(text.strip_front_matter, a="---\nno end") == "---\nno end"
    assert one(text.strip_front_matter, a="x\n---\ny\n---\n") == "x\n---\ny\n---\n"


def test_binary(spark):
    rows = spark.createDataFrame([(bytearray(b"a\0b"),), (bytearray(b"ab"),), (bytearray(b"\x10\x01"),)], "c binary")
    assert [r[0] for r in rows.select(text.looks_binary(F.col("c"))).collect()] == [True, False, False]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://shop.test/tea?utm_campaign=may&size=2&gclid=z", "https://shop.test/tea?size=2"),
        ("https://shop.test/tea#price?x=1", "https://shop.test/tea"),
        ("https://shop.test/tea/green/", "https://shop.test/tea/green"),
        ("https://shop.test/?spm=9", "https://shop.test"),
        ("HTTP://Shop.Test/Tea", "http://Shop.Test/Tea"),
        ("https://shop.test/tea?REF=me&cup=1&cup=2", "https://shop.test/tea?cup=1&cup=2"),
        ("https://shop.test/tea/?cup=1", "https://shop.test/tea?cup=1"),
        ("", ""),
    ],
)
def test_canonical_url(one, url, want):
    assert one(urls.canonical_url, a=url) == want


def test_hosts(one):
    assert one(urls.url_host, a="http://www.shop.test/tea") == "shop.test"
    assert one(urls.url_host, a="https://me:pw@Shop.Test:9000/tea") == "shop.test"
    assert one(urls.url_host, a="shop.test/tea?cup=1") == "shop.test"


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("closed on 3 Mar 2031, 18:00", "2031-03-03"),
        ("Opened April 1st, 2030 at noon", "2030-04-01"),
        ("Sept. 5 2029", "2029-09-05"),
        ("no 12 teas, but 30 June 2033", "2033-06-30"),
        ("(tea-7 May 2032)", "2032-05-07"),
        ("May 22nd 2032; 3 junk 2031, 44 May 2031", "2032-05-22"),
        ("June 31, 2032, July 2, 2032", "2032-07-02"),
        ("May, 3 2031 and 3, May 2031", None),
        ("due 2031-03-03.", None),
        ("due 2031-03-03 or so", "2031-03-03"),
        ("tag tea-2031-03-03-beta is out", None),
        ("shop.test/2031/03/03/tea", None),
        ("30 February 2031", None),
        ("3 Mar 1950", None),
        ("ö" * 760 + " 2031-03-03", None),
        ("2031-14-03 then 2031-03-04", "2031-03-04"),
    ],
)
def test_date_from_text(one, said, want):
    assert one(lambda a: dates.date_from_text(a).cast("string"), a=said) == want


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("2026-10-16T09:10:11Z", "2026-10-16 09:10:11"),
        ("2026-10-16T09:10:11.5+02:00", "2026-10-16 07:10:11.5"),
        ("2026-10-16T09:10:11+0200", "2026-10-16 07:10:11"),
        ("2026-10-16T09:10:11", "2026-10-16 09:10:11"),
        ("2026-10-16 09:10:11", "2026-10-16 09:10:11"),
        ("2026-10-16", "2026-10-16 00:00:00"),
        ("2026/10/16", "2026-10-16 00:00:00"),
        ("Fri, 16 Oct 2026 09:10:11 GMT", "2026-10-16 09:10:11"),
        ("Fri, 16 Oct 2026 09:10:11 +0200", "2026-10-16 07:10:11"),
        ("Thu, 1 Oct 2026 09:10:11 +0000", "2026-10-01 09:10:11"),
        ("2026-02-31", None),
        ("soon", None),
    ],
)
def test_parse_date(one, said, want):
    assert one(lambda a: dates.parse_date(a).cast("string"), a=said) == want


def test_ages(one):
    now = F.lit(NOW).cast("timestamp")
    age = lambda a: dates.age(dates.parse_date(a), now)
    assert one(age, a="2026-10-21T06:30:00Z") == "5 hours ago"
    assert one(age, a="2026-10-17T11:00:00Z") == "4 days ago"
    assert one(age, a="2026-06-20T12:00:00Z") == "4 months ago"
    assert one(age, a="") == "unknown"
    assert one(age, a="2027-01-01") == "just now"
    fresh = lambda a: dates.fresh(dates.parse_date(a), now, 7)
    assert one(fresh, a="2026-10-15T00:00:00Z") is True
    assert one(fresh, a="2026-10-01T00:00:00Z") is False
    assert one(fresh, a="") is False


def test_ledger_month(one):
    month = lambda a, b: dates.ledger_month(a, dates.parse_date(b))
    assert one(month, a="2031-03-04/web/tea/093000-0a1b2c3d-cup.md", b="2031-03-04T09:30:00Z") == "2031-03"
    assert one(month, a="attic/cup.md", b="2031-04-01T01:00:00+02:00") == "2031-03"
    assert one(month, a="attic/cup.md", b="") == "unknown"
    assert [dates.day_bucket(d) for d in (0, 1, 7, 31, 400)] == ["", "day", "week", "month", "year"]


def test_scores(spark):
    row = spark.range(1).select(
        scores.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0))).alias("a"),
        scores.cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0))).alias("b"),
        scores.upper_median(F.array(F.lit(4.0), F.lit(1.0), F.lit(3.0), F.lit(2.0))).alias("c"),
        scores.sigmoid(F.lit(0.0)).alias("d"),
    ).first()
    assert tuple(row) == (1.0, 0.0, 3.0, 0.5)
