"""A catalogue search as a data source, for batches and streams.

One partition for each entity and chunk of time; a partition reads its pages by token, each with
bounded retries. How a page is got is the fetcher's matter: any picklable object with

    page(aoi_id, start, end, token) -> (list of items, token of the next page or None)
    newest(aoi_id) -> the instant of the newest item as text, or None     (streams only)

where start and end are closed bounds in ISO form. Filters on aoi_id and datetime
prune partitions. A stream's offset is each entity's newest instant; a batch reads from the
offset before, less an overlap for late items, so every batch can be read again.
"""

from __future__ import annotations

import json
import random
import time
import urllib.request
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "aoi_id string, id string, datetime timestamp, item string, page string, place int"
CHUNK_DAYS, TRIES, LONGEST_PAUSE, PAGE_ITEMS = 90, 5, 30.0, 500
_SECOND = timedelta(seconds=1)


@dataclass
class Chunk(InputPartition):
    aoi_id: str
    start: datetime
    end: datetime


def instant(text: str) -> datetime:
    at = datetime.fromisoformat(text)
    return at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)


def chunks(aoi_id: str, start: datetime, end: datetime, days: int = CHUNK_DAYS) -> list[Chunk]:
    """The closed chunks of [start, end], a second apart."""
    step = timedelta(days=days)
    count = (end - start) // step + 1 if start <= end else 0
    return [Chunk(aoi_id, start + k * step, min(end, start + (k + 1) * step - _SECOND)) for k in range(count)]


def fetched(fetcher: Any, chunk: Chunk, tries: int, pause: Callable[[float], None]) -> Iterator[tuple]:
    """Rows of a chunk, page by page."""
    token, number = None, 0
    start, end = chunk.start.isoformat(), chunk.end.isoformat()
    while True:
        for left in range(tries - 1, -1, -1):
            try:
                items, token = fetcher.page(chunk.aoi_id, start, end, token)
                break
            except Exception:
                if not left:
                    raise
                pause(min(LONGEST_PAUSE, 2.0 ** (tries - 1 - left) + random.random()))
        page = f"{chunk.aoi_id}/{start}/{number:06d}"
        for place, item in enumerate(items):
            if isinstance(item, dict):  # anything else is no item
                yield chunk.aoi_id, str(item.get("id")), _taken(item), json.dumps(item), page, place
        if token is None:
            return
        number += 1


def _taken(item: Mapping) -> datetime | None:
    try:
        return instant(item["properties"]["datetime"])
    except (KeyError, TypeError, ValueError):
        return None


class _Search:
    """What a batch and a stream reader share: the options."""

    def __init__(self, fetcher: Any, options: Mapping[str, str], pause: Callable[[float], None]) -> None:
        self.fetcher, self.pause = fetcher, pause
        self.days, self.tries = int(options.get("chunkdays", CHUNK_DAYS)), int(options.get("tries", TRIES))
        if "windows" in options:
            self.windows = {a: (instant(s), instant(e)) for a, s, e in json.loads(options["windows"])}
        else:
            whole = (instant(options["start"]), instant(options["end"]))
            self.windows = dict.fromkeys(json.loads(options["entities"]), whole)

    def read(self, partition: Chunk) -> Iterator[tuple]:
        return fetched(self.fetcher, partition, self.tries, self.pause)


class _Reader(_Search, DataSourceReader):
    low: datetime | None = None
    high: datetime | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Entities are pruned for good; bounds of time prune chunks, and Spark filters what they let through."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("aoi_id",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.windows = {a: w for a, w in self.windows.items() if a in wanted}
                continue
            if getattr(f, "attribute", None) == ("datetime",) and isinstance(getattr(f, "value", None), datetime):
                at = f.value.astimezone(timezone.utc)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low or at, at)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high or at, at)
            yield f

    def partitions(self) -> Sequence[Chunk]:
        out = [c for a, (s, e) in self.windows.items() for c in chunks(a, s, e, self.days)]
        if self.low is not None:
            out = [Chunk(c.aoi_id, max(c.start, self.low), c.end) for c in out if c.end >= self.low]
        if self.high is not None:
            out = [Chunk(c.aoi_id, c.start, min(c.end, self.high)) for c in out if c.start <= self.high]
        return out


class _StreamReader(_Search, DataSourceStreamReader):
    def __init__(self, fetcher: Any, options: Mapping[str, str], pause: Callable[[float], None]) -> None:
        super().__init__(fetcher, options, pause)
        self.overlap = timedelta(days=int(options.get("overlapdays", 0)))

    def initialOffset(self) -> dict:  # noqa: N802
        return dict.fromkeys(self.windows, "")

    def latestOffset(self) -> dict:  # noqa: N802
        """The newest instant of each entity, not past its window."""
        out = {}
        for a, (_, end) in self.windows.items():
            newest = self.fetcher.newest(a)
            out[a] = "" if newest is None else min(instant(newest), end).isoformat()
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[Chunk]:
        """An entity that is new asks for its whole window; others from their old offset less the overlap."""
        out: list[Chunk] = []
        for a, until in end.items():
            before = start.get(a, "")
            if until and (not before or instant(until) > instant(before)) and a in self.windows:
                first = self.windows[a][0]
                out += chunks(a, first if not before else max(first, instant(before) - self.overlap), instant(until), self.days)
        return out

    def commit(self, end: dict) -> None:
        """Offsets live in the query's checkpoint; the catalogue keeps none."""


def register(spark: SparkSession, fetcher: Any, name: str = "scene_search", pause: Callable[[float], None] = time.sleep) -> str:
    """Make spark.read.format(name) and spark.readStream.format(name) search by this fetcher.

    Options: windows (JSON list of [aoi_id, start, end]), or entities (JSON list), start and
    end; chunkDays, tries and, for streams, overlapDays.
    """

    class SceneSearch(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(fetcher, self.options, pause)

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
            return _StreamReader(fetcher, self.options, pause)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SceneSearch)
    return name


def search(windows: DataFrame, name: str = "scene_search") -> DataFrame:
    """The source's rows for (aoi_id, start, end): one row an entity of the settings."""
    rows = [[r.aoi_id, r.s, r.e] for r in windows.selectExpr("aoi_id", "date_format(start, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\") s", "date_format(end, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\") e").distinct().collect()]
    return windows.sparkSession.read.format(name).option("windows", json.dumps(rows)).load()


class HttpFetcher:
    """Pages of an HTTP search that answers POSTed queries with a FeatureCollection and a link to the next page."""

    def __init__(self, url: str, collection: str, shapes: Mapping[str, Mapping], limit: int = PAGE_ITEMS, timeout: float = 60.0) -> None:
        self.url, self.collection, self.shapes, self.limit, self.timeout = url, collection, dict(shapes), limit, timeout

    def _ask(self, url: str, body: Mapping | None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(url, data, {"Content-Type": "application/json"})  # noqa: S310
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
            return json.load(answer)

    def page(self, aoi_id: str, start: str, end: str, token: str | None) -> tuple[list, str | None]:
        body = {"collections": [self.collection], "intersects": self.shapes[aoi_id], "datetime": f"{start}/{end}", "limit": self.limit}
        link = json.loads(token) if token else {"href": self.url, "body": body}
        answer = self._ask(link["href"], link["body"])
        following = next((n for n in answer.get("links", []) if n.get("rel") == "next"), None)
        if following is None:
            return answer["features"], None
        asked = None if following.get("method", "GET") == "GET" else (link["body"] or {}) | following.get("body", {})
        return answer["features"], json.dumps({"href": following["href"], "body": asked})

    def newest(self, aoi_id: str) -> str | None:
        body = {"collections": [self.collection], "intersects": self.shapes[aoi_id], "limit": 1, "sortby": [{"field": "properties.datetime", "direction": "desc"}]}
        found = self._ask(self.url, body)["features"]
        return found[0]["properties"]["datetime"] if found else None
