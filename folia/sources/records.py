"""Records of paged services (issues, wiki pages, tickets, list items, files) as a Spark data source.

A service gives the records of a collection (a project, a space, a table) page by
page.  Each task reads some pages of one collection; a filter on ``collection``
leaves the other collections out, and one on ``updated`` goes into the addresses
where the template has ``{since}``, so fewer pages are asked for.  Pages are had
from any address that ``urllib`` opens, so recorded pages in a folder do as well.

    records.register(spark)
    spark.read.format("records").option("service", "jira").option("collections", "OPS,WEB")
        .option("template", "https://host/search?jql=project={collection}&startAt={start}&maxResults={size}").load()
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

SCHEMA = "source_id string, collection string, title string, updated string, content string, record string"


@dataclass(frozen=True)
class Shape:
    """Where a service's answers have what a record needs; ``[]`` in a path goes through a list."""

    items: str
    total: str
    id: str
    title: str
    updated: str
    texts: tuple[str, ...]


# Names of fields in the services' answers.
SHAPES = {
    "jira": Shape("issues", "total", "key", "fields.summary", "fields.updated", ("fields.summary", "fields.description", "fields.comment.comments[].body", "fields.subtasks[].fields.summary")),
    "confluence": Shape("results", "totalSize", "id", "title", "history.lastUpdated.when", ("body.storage.value", "children.comment.results[].body.storage.value", "children.attachment.results[].title")),
    "servicenow": Shape("result", "total", "sys_id", "short_description", "sys_updated_on", ("short_description", "description", "comments", "work_notes")),
    "sharepoint": Shape("value", "total", "id", "fields.Title", "lastModifiedDateTime", ("fields.Title", "fields.Body", "webUrl")),
    "drive": Shape("files", "total", "id", "name", "modifiedTime", ("name", "description")),
}


def at(record: object, path: str) -> list:
    """The values at a path; what isn't there gives none."""
    found = [record]
    for name in path.split("."):
        found = [x[name.removesuffix("[]")] for x in found if isinstance(x, dict) and x.get(name.removesuffix("[]")) is not None]
        if name.endswith("[]"):
            found = [y for x in found if isinstance(x, list) for y in x]
    return found


def _first(record: object, path: str) -> str | None:
    got = at(record, path)
    return str(got[0]) if got else None


@dataclass
class Pages(InputPartition):
    collection: str
    starts: tuple[int, ...]


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.service, self.template = options["service"], options["template"]
        self.shape, self.size, self.some = SHAPES[self.service], int(options.get("pagesize", "50")), int(options.get("pagespertask", "20"))
        self.token, self.since = options.get("token"), options.get("since", "")
        named = [c.strip() for c in options.get("collections", "").split(",") if c.strip()]
        # a space whose name begins with ~ belongs to a person
        self.collections = [c for c in named if options.get("personal", "false") == "true" or not c.startswith("~")]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("collection",):
                self.collections = [c for c in self.collections if c == f.value]
            elif isinstance(f, In) and f.attribute == ("collection",):
                self.collections = [c for c in self.collections if c in f.value]
            elif isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("updated",) and "{since}" in self.template:
                self.since = max(self.since, f.value)
                yield f  # the service may round times, so rows are compared again
            else:
                yield f

    def _page(self, collection: str, start: int) -> dict:
        url = self.template.format(collection=collection, start=start, size=self.size, since=self.since)
        head = {"Authorization": f"Bearer {self.token}"} if self.token else {}
        with urlopen(Request(url, headers=head), timeout=60) as answer:  # noqa: S310
            return json.load(answer)

    def partitions(self) -> list[InputPartition]:
        """Some pages of a collection each; the first answer says how many records there are."""
        out = []
        for c in self.collections:
            total = int(_first(self._page(c, 0), self.shape.total) or 0)
            starts = list(range(0, total, self.size))
            out += [Pages(c, tuple(starts[k : k + self.some])) for k in range(0, len(starts), self.some)]
        return out or [Pages("", ())]

    def read(self, partition: Pages) -> Iterator[tuple]:
        s = self.shape
        for start in partition.starts:
            for r in (x for items in at(self._page(partition.collection, start), s.items) for x in items):
                texts = [str(t).strip() for p in s.texts for t in at(r, p)]
                yield (f"{self.service}://{partition.collection}/{_first(r, s.id)}", partition.collection, _first(r, s.title), _first(r, s.updated), "\n\n".join(filter(None, texts)), json.dumps(r, ensure_ascii=False, sort_keys=True))


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordSource)
