"""Fetching pages and files over HTTP, in the executors. Only where a network is there; tests give their own opener."""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Answers after which a URL isn't tried again.
FINAL = {403, 404, 410}
Opener = Callable[[str, float], tuple[int, dict[str, str], bytes]]


def over_http(url: str, timeout: float) -> tuple[int, dict[str, str], bytes]:
    """Status, headers by lower-case name, body."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
            return answer.status, {k.lower(): v for k, v in answer.headers.items()}, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, {}, b""


def fetched(url: str, opener: Opener, tries: int = 3, timeout: float = 15.0, pause: float = 1.0, html: bool = True) -> tuple[bytes | None, str, str]:
    """Body or None, error, content type. Failures are tried again after 1, 2, 4 ... times the pause."""
    error = ""
    for k in range(tries):
        try:
            status, headers, body = opener(url, timeout)
        except OSError as e:
            error = f"{type(e).__name__}: {e}"[:200]
        else:
            kind = headers.get("content-type", "")
            if status == 200:
                return (body, "", kind) if ("html" in kind) == html else (None, f"content type {kind}", kind)
            error = f"HTTP {status}"
            if status in FINAL:
                break
        if k + 1 < tries:
            time.sleep(pause * 2**k)
    return None, error, ""


def decoded(body: bytes, kind: str) -> str:
    """By the header's charset, else the page's own, else UTF-8."""
    named = re.search(r"charset=[\"']?([\w-]+)", kind) or re.search(r"charset=[\"']?([\w-]+)", body[:2000].decode("ascii", "ignore"))
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def fetch_pages(urls: DataFrame, opener: Opener = over_http, delay: float = 1.0, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """urls: url. url, html (null if it failed), error. Each task waits `delay` seconds between its requests; partition
    the URLs by host to be polite to each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url in frame["url"]:
                body, error, kind = fetched(url, opener, tries, pause=pause)
                rows.append((url, None if body is None else decoded(body, kind), error))
                time.sleep(delay)
            yield pd.DataFrame(rows, columns=["url", "html", "error"])

    return urls.select("url").mapInPandas(run, "url string, html string, error string")


def fetch_files(urls: DataFrame, opener: Opener = over_http, delay: float = 1.0, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """urls: url. url, content (null if it failed), error. An HTML answer is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url in frame["url"]:
                body, error, _ = fetched(url, opener, tries, 30.0, pause, html=False)
                rows.append((url, body, error))
                time.sleep(delay)
            yield pd.DataFrame(rows, columns=["url", "content", "error"])

    return urls.select("url").mapInPandas(run, "url string, content binary, error string")
