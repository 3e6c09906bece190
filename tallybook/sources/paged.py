"""Answers that come page by page, newest first: a data source that stops where rows are known.

Every stream (an agency and category, say) is a partition that asks for one page after the other. A page that holds a row no
newer than `since` is the last one asked for; its newer rows and those whose date can't be read are kept. `full` reads all pages:
with nothing known there is nothing to stop at, so a stream of many pages is read in ranges of pages, each by a task of its own.
As a streaming source the offset of each stream is the newest date given out, so a restart goes on where it stopped.

    pages = load_pages(spark, client, streams=["roads", "water"], since="2024-01-31")

A client is any picklable object with `fetch(stream, page) -> (rows, total)`: rows as dicts, none after the last page. `LandedPages`
reads pages that lie in a folder; one that asks a portal has the same form.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime
from typing import Any, Protocol

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "stream string, page int, place int, issued date, value string"
#: Pages of a range, rows of a batch, and texts of dates whose days are kept.
RANGE, ROWS, MOST_DAYS = 500, 2000, 100_000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Client(Protocol):
    def fetch(self, stream: str, page: int) -> tuple[list[dict], int]:
        """A page's rows (page 0 has the newest) and how many rows there are in all."""


class LandedPages:
    """Pages in a folder that all tasks reach: `stream=.../block=.../*`, with a line for each of a block's PAGES pages, its number, a tab and a JSON object {total, data}."""

    PAGES = 100

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.held: tuple[tuple[str, int] | None, dict[int, str]] = (None, {})

    def _block(self, stream: str, block: int) -> dict[int, str]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder if "://" in self.folder else self.folder.replace("file:", "", 1))
        listed = store.get_file_info(fs.FileSelector(f"{root}/stream={stream}/block={block}", allow_not_found=True))
        files = [f.path for f in listed if f.is_file and not f.base_name.startswith((".", "_"))]
        lines = (line.split("\t", 1) for path in files for line in store.open_input_stream(path).read().decode().split("\n") if line)
        return {int(page): answer for page, answer in lines}

    def fetch(self, stream: str, page: int) -> tuple[list[dict], int]:
        place = stream, page // self.PAGES
        if self.held[0] != place:
            self.held = place, self._block(*place)
        if page not in self.held[1]:
            return [], 0
        answer = json.loads(self.held[1][page])
        return answer["data"], answer["total"]


class Stretch(InputPartition):
    """One stream's rows newer than `since` and, if given, not newer than `upto`.

    A range has those that stood on the pages from `first` to before `last` (None: to the end) when there were `total` rows, `size` on a
    page; rows that come or go later move all others, but none into another range.
    """

    def __init__(self, stream: str, since: str | None, upto: str | None = None, first: int = 0, last: int | None = None, size: int = 0, total: int = 0) -> None:
        self.stream, self.since, self.upto = stream, since, upto
        self.first, self.last, self.size, self.total = first, last, size, total

    def holds(self, place: int, total: int) -> bool:
        """Whether the row at a place of the stream, which has `total` rows now, belongs here."""
        planned = place - (total - self.total)
        return not self.size or ((not self.first or planned >= self.first * self.size) and (self.last is None or planned < self.last * self.size))


class Pages:
    """What a batch and a stream have in common: the client, and the loop over a stream's pages."""

    def __init__(self, options: dict[str, str]) -> None:
        self.client: Client = cloudpickle.loads(bytes.fromhex(options["client"]))
        self.streams: list[str] = json.loads(options["streams"])
        self.field, self.form = options.get("datefield", "publishedDate"), options.get("dateformat", "%d-%m-%Y")
        self.since = None if options.get("full", "false") == "true" else options.get("since")

        self.width, self.read_days = len(datetime(2000, 1, 1).strftime(self.form)), {}

    def issued(self, row: dict) -> str | None:
        told = str(row.get(self.field))[: self.width]
        if told not in self.read_days:
            if len(self.read_days) >= MOST_DAYS:
                self.read_days.clear()
            try:
                self.read_days[told] = datetime.strptime(told, self.form).date().isoformat()
            except ValueError:
                self.read_days[told] = None
        return self.read_days[told]

    def stretches(self, stream: str, since: str | None, upto: str | None = None) -> list[InputPartition]:
        """One where a known row has to be looked for page by page, else one for every RANGE pages."""
        if not since:
            rows, total = self.client.fetch(stream, 0)
            pages = -(-total // len(rows)) if rows else 0
            if pages > RANGE:
                return [Stretch(stream, since, upto, a, a + RANGE if a + RANGE < pages else None, len(rows), total) for a in range(0, pages, RANGE)]
        return [Stretch(stream, since, upto)]

    def rows(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        page, had, held = part.first, 0, []
        if part.first:
            page = max(0, (part.first * part.size + self.client.fetch(part.stream, part.first)[1] - part.total) // part.size)
        while True:
            rows, total = self.client.fetch(part.stream, page)
            dated = [(page, k, self.issued(row), row) for k, row in enumerate(rows) if part.holds(page * part.size + k, total)]
            new = [r for r in dated if not part.since or not r[2] or r[2] > part.since]
            held += [r for r in new if not part.upto or not r[2] or r[2] <= part.upto]
            had += len(rows)
            page += 1
            ended = had >= total if not part.size else part.last is not None and not part.holds(page * part.size, total)
            over = not rows or len(new) < len(dated) or ended
            if held and (over or len(held) >= ROWS):
                yield self._batch(part.stream, held)
                held = []
            if over:
                return

    def _batch(self, stream: str, rows: list[tuple[int, int, str | None, dict]]) -> pa.RecordBatch:
        pages, places, days, told = zip(*rows)
        columns = [
            pa.array([stream] * len(rows), pa.string()), pa.array(pages, pa.int32()), pa.array(places, pa.int32()),
            pa.array(days, pa.string()).cast(pa.date32()), pa.array([json.dumps(r) for r in told], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["stream", "page", "place", "issued", "value"])


class PagesReader(Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [p for s in self.streams for p in self.stretches(s, self.since)]

    def read(self, partition: Any) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class PushedPagesReader(PagesReader):
    """The same where the session pushes filters down: streams that aren't asked for aren't read."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and tuple(f.attribute) == ("stream",):
                wanted = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.streams = [s for s in self.streams if s in wanted]
            else:
                yield f


class PagesStreamReader(Pages, DataSourceStreamReader):
    """Offsets: the newest date of each stream (empty: nothing yet)."""

    def initialOffset(self) -> dict:
        return {s: self.since or "" for s in self.streams}

    def latestOffset(self) -> dict:
        newest = {}
        for s in self.streams:
            rows, _ = self.client.fetch(s, 0)
            newest[s] = max([self.since or "", *(d for row in rows if (d := self.issued(row)))])
        return newest

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [p for s in self.streams if end[s] and end[s] > start.get(s, "") for p in self.stretches(s, start.get(s) or None, end[s])]

    def read(self, partition: Any) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return (PushedPagesReader if self.options.get("pushdown") == "true" else PagesReader)(dict(self.options))

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return PagesStreamReader(dict(self.options))


def _options(spark: SparkSession, client: Client, streams: list[str], since: str | None, full: bool, options: dict[str, str]) -> dict[str, str]:
    spark.dataSource.register(PagedSource)
    given = {"client": cloudpickle.dumps(client).hex(), "streams": json.dumps(streams), "full": str(full).lower(), "pushdown": spark.conf.get(PUSHDOWN, "false")}
    return given | options | ({"since": since} if since else {})


def load_pages(spark: SparkSession, client: Client, streams: list[str], since: str | None = None, full: bool = False, **options: str) -> DataFrame:
    """stream, page, place, issued, value (the row as JSON) of the pages up to the first that holds a row of `since` or before."""
    return spark.read.format("pages").options(**_options(spark, client, streams, since, full, options)).load()


def stream_pages(spark: SparkSession, client: Client, streams: list[str], since: str | None = None, **options: str) -> DataFrame:
    """The same as a stream: each batch has what is newer than the last one's newest date; rows without a date come whenever their page is read."""
    return spark.readStream.format("pages").options(**_options(spark, client, streams, since, False, options)).load()
