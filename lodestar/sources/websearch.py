"""Web search services as a Spark data source: spark.read.format("websearch").

Each service is two pure functions, one that builds the request and one that
reads the response. The request runs in the reader; a response may be given as
an option instead, for tests and replays. The named service is asked and no
other: there is no failover. Dates are parsed natively by ``with_dates``.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestar.functions.dates import date_from_text, day_bucket, parse_date, qdr_bucket

SCHEMA = "rank int, title string, url string, snippet string, summary string, content string, chunks array<string>, dated string, dated_text string, authority int, score double, provider string"


@dataclass
class Query:
    text: str
    count: int = 10
    freshness_days: int = 0
    lang: str = ""
    topic: str = ""
    need_content: bool = False
    options: dict[str, str] = field(default_factory=dict)


@dataclass
class Request:
    url: str
    body: dict | None = None
    headers: dict[str, str] = field(default_factory=dict)


def _hit(**given) -> dict:
    return {"title": "", "url": "", "snippet": "", "summary": "", "content": "", "chunks": [], "dated": "", "dated_text": "", "authority": -1, "score": 0.0} | {k: v for k, v in given.items() if v is not None}


def _limited(count: int, most: int) -> int:
    return min(count if count > 0 else 10, most)


def _base(q: Query, default: str) -> str:
    return (q.options.get("base_url", "").strip() or default).rstrip("/")


def _bearer(q: Query) -> dict[str, str]:
    key = q.options.get("api_key", "").strip()
    if not key:
        raise ValueError("no api key is configured")
    return {"Authorization": f"Bearer {key}"}


def deepseek_request(q: Query, today: datetime | None = None) -> Request:
    text = q.text
    if q.freshness_days > 0 and not any(x in text.lower() for x in ("after:", "before:")):
        text += f" after:{(today or datetime.now(UTC)) - timedelta(days=q.freshness_days):%Y-%m-%d}"
    most = int(q.options.get("max_count") or 50)
    body = {"query": text, "count": _limited(q.count, min(most, 50) if most > 0 else 50), "need_content": q.need_content}
    return Request(_base(q, "https://api.deepseek.com") + "/v1/tools/search", body, _bearer(q))


def deepseek_hits(data: dict, q: Query) -> list[dict]:
    return [
        _hit(title=(r.get("title") or "").strip() or (r.get("site_name") or "").strip(), url=r.get("url"), snippet=r.get("snippet"), summary=r.get("summary"), content=r.get("content"), dated=r.get("date"), authority=r.get("authority"), score=r.get("rerank_score"))
        for r in data.get("results") or []
    ]


def tavily_request(q: Query) -> Request:
    depth, topic = q.options.get("search_depth", "").strip().lower(), q.topic.strip() or "general"
    body = {"query": q.text, "search_depth": depth if depth in ("advanced", "fast") else "basic", "chunks_per_source": 3, "max_results": _limited(q.count, 20), "topic": topic, "language": q.lang, "include_published_date": True}
    if topic == "general":
        body["country"] = q.options.get("country", "").strip().upper()
    if q.need_content:
        body["include_raw_content"] = "markdown"
    body["time_range"] = day_bucket(q.freshness_days)
    return Request(_base(q, "https://api.tavily.com") + "/search", {k: v for k, v in body.items() if v != ""}, _bearer(q))


def tavily_hits(data: dict, q: Query) -> list[dict]:
    return [_hit(title=r.get("title"), url=r.get("url"), snippet=r.get("content"), content=r.get("raw_content"), chunks=r.get("chunks"), dated=r.get("published_date"), dated_text=r.get("raw_content"), score=r.get("score")) for r in data.get("results") or []]


def firecrawl_request(q: Query) -> Request:
    body = {"query": q.text, "limit": _limited(q.count, 50), "sources": ["news" if q.topic == "news" else "web"], "country": q.options.get("country", "").strip().upper(), "location": q.options.get("location", "").strip(), "tbs": qdr_bucket(q.freshness_days)}
    if q.need_content:
        body["scrapeOptions"] = {"formats": [{"type": "markdown"}], "onlyMainContent": True}
    return Request(_base(q, "https://api.firecrawl.dev/v2") + "/search", {k: v for k, v in body.items() if v != ""}, _bearer(q))


def firecrawl_hits(data: dict, q: Query) -> list[dict]:
    if not data.get("success") and data.get("error"):
        raise RuntimeError(data["error"])
    found = data.get("data") or {}
    web = [_hit(title=(r.get("title") or "").strip() or ((r.get("metadata") or {}).get("title") or "").strip(), url=r.get("url"), snippet=r.get("description"), content=r.get("markdown"), dated_text="\n".join(x for x in (r.get("markdown"), r.get("description")) if x)) for r in found.get("web") or []]
    return web + [_hit(title=r.get("title"), url=r.get("url"), snippet=r.get("snippet"), content=r.get("markdown"), dated=r.get("date")) for r in found.get("news") or []]


def searxng_request(q: Query) -> Request:
    o = q.options
    if not o.get("base_url", "").strip():
        raise ValueError("no base url is configured")
    days = q.freshness_days
    safe = int(o.get("safesearch") or 0)
    values = {
        "q": q.text,
        "format": "json",
        "language": o.get("language", "").strip() or q.lang,
        "categories": o.get("categories", "").strip(),
        "safesearch": str(min(safe, 2)) if safe > 0 else "",
        "engines": o.get("engines", ""),
        "time_range": "" if days <= 0 or days > 365 else "day" if days <= 1 else "month" if days <= 31 else "year",
    }
    return Request(_base(q, "") + "/search?" + urllib.parse.urlencode({k: v for k, v in values.items() if v}))


def searxng_hits(data: dict, q: Query) -> list[dict]:
    hits = [_hit(title=r.get("title"), url=r.get("url"), snippet=r.get("content"), dated=r.get("publishedDate"), score=r.get("score") or 1.0 / (i + 1)) for i, r in enumerate(data.get("results") or [])]
    return [h for h in hits if h["url"].strip()][: q.count if q.count > 0 else 10]


SERVICES = {"deepseek": (deepseek_request, deepseek_hits), "tavily": (tavily_request, tavily_hits), "firecrawl": (firecrawl_request, firecrawl_hits), "searxng": (searxng_request, searxng_hits)}


def service(name: str):
    try:
        return SERVICES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown provider {name!r}; there are {sorted(SERVICES)}") from None


def fetch(request: Request, timeout: float) -> dict:
    data = None if request.body is None else json.dumps(request.body).encode()
    call = urllib.request.Request(request.url, data, request.headers | {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(call, timeout=timeout) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"HTTP {e.code}: {e.read().decode(errors='replace')[:500]}") from e


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = {k.lower(): v for k, v in self.options.items()}
        name = o["provider"].strip().lower()
        build, parse = service(name)
        q = Query(o["query"], int(o.get("count") or 10), int(o.get("freshness_days") or 0), o.get("lang", ""), o.get("topic", ""), o.get("need_content", "false").lower() == "true", o)
        data = json.loads(o["response"]) if "response" in o else fetch(build(q), float(o.get("timeout") or 30))
        rank = 0
        for h in parse(data, q):
            if url := h["url"].strip():
                rank += 1
                yield rank, h["title"], url, h["snippet"], h["summary"], h["content"], h["chunks"], h["dated"], h["dated_text"], int(h["authority"]), float(h["score"]), name


class WebSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "websearch"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebSearch)


def with_dates(hits: DataFrame) -> DataFrame:
    """published_at from the service's date, else from the text."""
    found = F.coalesce(parse_date(F.col("dated")), date_from_text(F.col("dated_text")).cast("timestamp"))
    return hits.withColumn("published_at", found).drop("dated", "dated_text")


def search(spark: SparkSession, provider: str, query: str, **options: object) -> DataFrame:
    """Hits of one service for one query, with their dates."""
    service(provider)
    register(spark)
    given = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    return with_dates(spark.read.format("websearch").options(provider=provider, query=query, **given).load())
