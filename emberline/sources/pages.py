"""Pages of a service, landed as files, as a Spark source: a partition for each page, or for a run of pages where they are many."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "offset bigint, place int, item string"
PAGE = 2000
#: Partitions at most; a task for each of very many small pages would cost more than reading them.
PARTITIONS = 256
#: Which offsets a filter of a kind lets through.
KEEPS = {
    EqualTo: lambda offset, value: offset == value,
    GreaterThan: lambda offset, value: offset > value,
    GreaterThanOrEqual: lambda offset, value: offset >= value,
    LessThan: lambda offset, value: offset < value,
    LessThanOrEqual: lambda offset, value: offset <= value,
    In: lambda offset, value: offset in value,
}


class PageRun(InputPartition):
    """Pages (offset, files) that a task reads one after the other."""

    def __init__(self, pages: list[tuple[int, tuple[str, ...]]]):
        super().__init__(pages)


class PagesReader(DataSourceReader):
    """Lists the pages when a query is planned, and reads a page, or a run of pages, in each task."""

    def __init__(self, path: str, size: int, items: str):
        self.path, self.size, self.items, self.wanted = path, size, items, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters of the offset choose pages; the others are left to Spark."""
        for f in filters:
            if type(f) in KEEPS and getattr(f, "attribute", ()) == ("offset",) and f.value is not None:
                self.wanted.append((KEEPS[type(f)], f.value))
            else:
                yield f

    def _listed(self) -> dict[int, tuple[str, ...]]:
        store, root = fs.FileSystem.from_uri(self.path)
        found: dict[int, list[str]] = {}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            folder, _, name = info.path.rpartition("/")
            label = folder.rpartition("/")[2]
            if info.type == fs.FileType.File and label.startswith("offset=") and not name.startswith((".", "_")):
                found.setdefault(int(label.removeprefix("offset=")), []).append(info.path)
        return {offset: tuple(sorted(files)) for offset, files in found.items()}

    def partitions(self) -> list[PageRun]:
        """The pages from offset 0 on, as far as none is missing: a client gets no page after one that isn't there."""
        found, pages = self._listed(), []
        while (offset := len(pages) * self.size) in found:
            pages.append((offset, found[offset]))
        kept = [p for p in pages if all(keep(p[0], value) for keep, value in self.wanted)]
        run = -(-len(kept) // PARTITIONS)
        return [PageRun(kept[k : k + run]) for k in range(0, len(kept), run or 1)]

    def read(self, run: PageRun | None) -> Iterator[tuple]:
        """The pages' items as text, or a row without an item for a page without any; a page that is no JSON raises."""
        if run is None:  # Spark's stand-in where no page is left
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        for offset, files in run.value:
            yield from self._page(store, offset, files)

    def _page(self, store: fs.FileSystem, offset: int, files: tuple[str, ...]) -> Iterator[tuple]:
        place = 0
        for name in files:
            with store.open_input_stream(name) as stream:
                text = stream.read()
            try:
                items = list(json.loads(text)[self.items])
            except (ValueError, KeyError, TypeError) as fault:
                raise ValueError(f"page {offset} ({name}) has no {self.items}") from fault
            for item in items:
                yield offset, place, json.dumps(item, ensure_ascii=False)
                place += 1
        if not place:
            yield offset, 0, None


class Pages(DataSource):
    """Folders offset=0, offset=<size> ... below a path, each with a page's JSON: an object with an array of items.

    Options: path, size (items of a full page), items (the array's name). path is one that Arrow can open (local, HDFS, S3).
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options["path"], int(self.options.get("size", PAGE)), self.options.get("items", "features"))


def all_pages(spark: SparkSession, path: str, size: int = PAGE, items: str = "features") -> DataFrame:
    """offset, place and item of every page that is there; filters of the offset leave out pages before they are read."""
    spark.dataSource.register(Pages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("pages").option("size", size).option("items", items).load(path)


def read_pages(spark: SparkSession, path: str, schema: str, size: int = PAGE, items: str = "features") -> DataFrame:
    """The items of the pages up to the first that isn't full, as columns of schema; later pages are leftovers of another run.

    Pages are read in parallel. One number reaches the driver, the offset of the first page that isn't full, so the pages after
    it are left out when the result is planned. Items that don't fit the schema are nulls.
    """
    pages = all_pages(spark, path, size, items)
    last = pages.groupBy("offset").agg(F.count("item").alias("n")).where(F.col("n") < size).agg(F.min("offset")).first()[0]
    kept = pages if last is None else pages.where(F.col("offset") <= last)
    return kept.where(F.col("item").isNotNull()).select(F.from_json("item", schema).alias("i")).select("i.*")
