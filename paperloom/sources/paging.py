"""Services that answer in pages: a cursor leads from each to the next, and a limit cuts them off.

Requests that fail for a while (no connection, a timeout, 429, 502, 503, 504) are made again; other refusals end a query with what it has,
and errors of the program are errors.  One query is one task of a batch.  A stream moves by one page of each query at a time; its
offsets hold each query's cursor and what was taken, so that any part of it can be read again and gives the same rows.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

# Statuses of requests that may be made again, attempts, least and greatest seconds between them; items of a page, items asked
# for of a service that filters only afterwards, and the cursor of a first page.
AGAIN, ATTEMPTS, LEAST_WAIT, MOST_WAIT = (429, 502, 503, 504), 3, 2.0, 15.0
PAGE, SURPLUS, MOST_AT_ONCE, FIRST = 200, 2, 100, "*"


class Refused(OSError):
    """A service's answer that is no success."""

    def __init__(self, status: int, text: str = ""):
        super().__init__(f"{status} {text}".strip())
        self.status = status


def passing(error: BaseException) -> bool:
    """Whether a request that failed so may be made again."""
    return error.status in AGAIN if isinstance(error, Refused) else isinstance(error, ConnectionError | TimeoutError)


def requested(call, attempts: int = ATTEMPTS, sleep=time.sleep):
    """What ``call`` returns; after a passing failure it is called again, with waits that double."""
    for k in range(attempts):
        try:
            return call()
        except OSError as error:
            if not passing(error) or k + 1 == attempts:
                raise
            sleep(min(MOST_WAIT, LEAST_WAIT * 2**k))
    raise AssertionError


def size_for(limit: int, filtered_later: bool) -> int:
    """Items to ask for at once: a page, or for a service whose rows are filtered afterwards twice as many as wanted, within its bound."""
    return min(limit * SURPLUS, MOST_AT_ONCE) if filtered_later else PAGE


def walk(page, query: str, limit: int, start: str | None = FIRST, taken: int = 0, sleep=time.sleep) -> Iterator[tuple[list[str], str | None, int]]:
    """Items, next cursor and items taken so far of each page of a query from a cursor on, up to ``limit`` items.

    ``page`` (query, cursor) gives items and the next cursor, none after the last page.  A query ends early where a request is refused.
    """
    cursor = start
    while cursor and taken < limit:
        try:
            items, after = requested(lambda c=cursor: page(query, c), sleep=sleep)
        except OSError:
            return
        items = items[: limit - taken]
        taken, cursor = taken + len(items), after or None
        yield items, cursor, taken


class QueryPart(InputPartition):
    def __init__(self, query: str):
        self.query = query


class PagedReader(DataSourceReader):
    """One partition for each query."""

    def __init__(self, source: PagedSource):
        self.source = source

    def partitions(self):
        return [QueryPart(q) for q in self.source.queries] or [QueryPart("")]

    def read(self, partition):
        if partition.query:
            for items, _, _ in walk(self.source.page, partition.query, self.source.limit):
                for raw in items:
                    yield self.source.label, partition.query, raw


class PagedStream(SimpleDataSourceStreamReader):
    """One page of each query a batch.  The offset of a query is its cursor (null at its end) and the items taken before it."""

    def __init__(self, source: PagedSource):
        self.source = source

    def initialOffset(self):
        return {q: [FIRST, 0] for q in self.source.queries}

    def read(self, start):
        rows, end = [], dict(start)
        for query, (cursor, taken) in start.items():
            for items, after, upto in walk(self.source.page, query, self.source.limit, cursor, taken):
                rows += [(self.source.label, query, raw) for raw in items]
                end[query] = [after if upto < self.source.limit else None, upto]
                break
        return iter(rows), end

    def readBetweenOffsets(self, start, end):
        """The pages from one offset to another, again."""
        for query, (cursor, taken) in start.items():
            _, wanted = end.get(query, (None, taken))
            for items, _, upto in walk(self.source.page, query, self.source.limit, cursor, taken) if taken < wanted else ():
                yield from ((self.source.label, query, raw) for raw in items)
                if upto >= wanted:
                    break

    def commit(self, end):
        """Nothing is kept that could be let go."""


class PagedSource(DataSource):
    """Options: ``queries``, one a line, ``limit``, ``source``, the label.  Subclasses say how a ``page`` is asked for."""

    def __init__(self, options):
        self.options = options
        self.queries = list(dict.fromkeys(q for q in options.get("queries", "").split("\n") if q))
        self.limit, self.label = int(options.get("limit", PAGE)), options.get("source", "")

    def page(self, query: str, cursor: str) -> tuple[list[str], str | None]:
        raise NotImplementedError

    def schema(self) -> str:
        return "source string, query string, raw string"

    def reader(self, schema):
        return PagedReader(self)

    def simpleStreamReader(self, schema):
        return PagedStream(self)


class RecordedPages(PagedSource):
    """``format("recorded_pages")``: under the option ``path``, a folder that all executors see, one file for each request, named by
    :meth:`file`, with the service's reply; ``items`` and ``cursor`` say where in a reply those are."""

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    @staticmethod
    def file(query: str, cursor: str) -> str:
        return hashlib.sha256(f"{query}\n{cursor}".encode()).hexdigest()[:24] + ".json"

    def page(self, query: str, cursor: str) -> tuple[list[str], str | None]:
        path = Path(self.options.get("path", "")) / self.file(query, cursor)
        if not path.exists():
            raise Refused(404, query)
        reply = json.loads(path.read_text(encoding="utf-8"))
        if (status := reply.get("status", 200)) >= 400:
            raise Refused(status)
        after = reply
        for step in self.options.get("cursor", "meta.next_cursor").split("."):
            after = (after or {}).get(step)
        return [json.dumps(x, ensure_ascii=False) for x in reply.get(self.options.get("items", "results")) or []], after
