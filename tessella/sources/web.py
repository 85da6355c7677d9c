"""Fetching pages: retries, and the walk through a paged listing. The opener is passed in, so tests need no network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessella.functions.html import decode, listing_links

#: Tries for a page, and the replies that are worth another.
TRIES = 5
AGAIN = frozenset((429, 500, 502, 503, 504))
Opener = Callable[[str], tuple[int, bytes]]


def fetch(url: str, opener: Opener, *, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> bytes | None:
    """A page's bytes; None after ``tries`` failures or another refusal. Waits 1, 2, 4 ... seconds in between."""
    for n in range(tries):
        try:
            status, content = opener(url)
            if status == 200:
                return content
            if status not in AGAIN:
                return None
        except OSError:
            pass
        if n + 1 < tries:
            sleep(2**n)
    return None


def walk(start: str, base: str, opener: Opener, **options: object) -> Iterator[tuple[str, str]]:
    """("doc", url) of every document of a listing, page after page, and ("failed", url) where a page can't be read.

    A page met before ends the walk.
    """
    seen, url = set(), start
    while url and url not in seen:
        seen.add(url)
        content = fetch(url, opener, **options)
        if content is None:
            yield "failed", url
            return
        links = listing_links(decode(content), base)
        yield from (x for x in links if x[0] == "doc")
        url = next((u for k, u in links if k == "next"), None)


def fetched(urls: DataFrame, opener: Opener, **options: object) -> DataFrame:
    """(url, content) of a table of urls, fetched where their partitions are; content is null after failure."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"url": part["url"], "content": [fetch(u, opener, **options) if u else None for u in part["url"]]})

    return urls.select("url").mapInPandas(run, "url string, content binary")
