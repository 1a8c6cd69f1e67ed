"""Fetching pages over HTTP, on the executors, with a pause between requests to one host."""

from __future__ import annotations

import heapq
import time
from collections import deque
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawldex.sources.config import WebRequest

DELAY = 0.25  # seconds between two requests of a task to the same host
TIMEOUT = 20.0
MOST_WAITING = 10_000  # addresses that a task holds while their hosts pause
MOST_BYTES = 16 << 20  # of a body; larger answers have none


class _Stay(urllib.request.HTTPRedirectHandler):
    """Redirects are answers of their own: they are not followed."""

    def redirect_request(self, *_):
        return None


def get(url: str, request: WebRequest) -> tuple[int | None, str | None, str | None]:
    """(code, html, error) of one address; only text answers have html."""
    headers = {"User-Agent": request.user_agent, "Accept-Language": request.accept_language} | ({"Referer": request.referrer} if request.referrer else {})
    try:
        with urllib.request.build_opener(_Stay).open(urllib.request.Request(url, headers=headers), timeout=TIMEOUT) as answer:
            kind = answer.headers.get_content_type()
            if not kind.startswith("text/") and not kind.endswith("+xml"):
                return answer.status, None, None
            body = answer.read(MOST_BYTES + 1)
            if len(body) > MOST_BYTES:
                return answer.status, None, f"the body has more than {MOST_BYTES} bytes"
            return answer.status, body.decode(answer.headers.get_content_charset() or "utf-8", "replace"), None
    except urllib.error.HTTPError as error:
        return error.code, None, None
    except (OSError, ValueError) as error:
        return None, None, f"{type(error).__name__}: {error}"[:255]


def fetch(urls: DataFrame, request: WebRequest | None = None, delay: float = DELAY) -> DataFrame:
    """Rows (url, code, html, error) of distinct addresses (column url).

    A host's addresses go to one task, so that its pause holds. A task takes its hosts in turns, the one that may be asked first; while one pauses, others are fetched.
    """
    request = request or WebRequest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        due: list[tuple[float, str]] = []
        waiting: dict[str, deque[str]] = {}

        def next_page() -> pd.DataFrame:
            at, host = heapq.heappop(due)
            time.sleep(max(0.0, at - time.monotonic()))
            url = waiting[host].popleft()
            code, html, error = get(url, request)
            heapq.heappush(due, (time.monotonic() + delay, host)) if waiting[host] else waiting.pop(host)
            return pd.DataFrame({"url": [url], "code": pd.array([code], "Int32"), "html": [html], "error": [error]})

        for batch in batches:
            for url in batch["url"]:
                host = urlsplit(url).netloc
                if host not in waiting:
                    waiting[host] = deque()
                    heapq.heappush(due, (time.monotonic(), host))
                waiting[host].append(url)
            while sum(map(len, waiting.values())) > MOST_WAITING:
                yield next_page()
        while due:
            yield next_page()

    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    return urls.select("url").distinct().repartition(host).mapInPandas(run, "url string, code int, html string, error string")
