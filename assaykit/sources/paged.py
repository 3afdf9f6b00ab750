"""Pages of an interface that hands out a token for the next one, as a data source.

    spark.dataSource.register(PagedSource)
    spark.read.format("pages").option("path", folder).load()

read_pages(spark, folder) has the same rows without their place, for any number of pages.

A captured page is a file page-<token>.json: {"records": [...], "nextPageToken": "..."}; the first
page's token is empty, the last page names none. A
partition has FILES pages or fewer, so pages are read in parallel, and a lost executor costs its pages.

With the option rows = captured or rows = missing the driver only lists the folder, place is null, and
the read gives the captured pages' records, or each token whose page is missing, once for every page
that names it; read_pages joins the two. Without it place is the page's position along the chain of
tokens, which goes on behind a missing page at the earliest captured page that no other leads to; for
that the driver opens every page.

A missing token has a row with missing = true, so that it can be fetched and the read repeated.

Defined results: a page without records has no row; a page that is no JSON object has one row with
broken = true and its text as the record; a page named twice in the chain is read once; an empty folder
has one row, for the missing first page.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "token string, place int, record string, missing boolean, broken boolean"
ARROW = pa.schema([("token", pa.string()), ("place", pa.int32()), ("record", pa.string()), ("missing", pa.bool_()), ("broken", pa.bool_())])
#: Pages of a partition, and how many of them are opened side by side.
FILES, ABREAST = 200, 8


def _files(path: str):
    """File system and folder of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _text(path: str, token: str) -> str:
    files, root = _files(path)
    with files.open_input_stream(f"{root}/page-{token}.json") as f:
        return f.read().decode("utf-8", "replace")


def _page(text: str) -> dict | None:
    try:
        page = json.loads(text)
    except json.JSONDecodeError:
        return None
    return page if isinstance(page, dict) else None


def chain(links: dict[str, str | None]) -> list[tuple[str, bool]]:
    """Tokens in order, and whether their page is missing; links: token -> next token of each captured page."""
    led = {n for n in links.values() if n}
    heads = sorted(t for t in links if t not in led and t)
    out, seen, token = [], set(), ""
    while True:
        while token is not None and token not in seen:
            seen.add(token)
            out.append((token, token not in links))
            token = links.get(token) or None
        rest = [t for t in heads if t not in seen] or sorted(t for t in links if t not in seen)
        if not rest:
            return out
        token = rest[0]


@dataclass
class Pages(InputPartition):
    """(place, token, missing) of each page."""

    pages: list[tuple[int | None, str, bool]]


class PagedReader(DataSourceReader):
    def __init__(self, path: str, rows: str):
        self.path, self.rows = path, rows

    def partitions(self) -> list[Pages]:
        from pyarrow import fs

        files, root = _files(self.path)
        names = (f.base_name for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)))
        tokens = sorted(n[len("page-") : -len(".json")] for n in names if n.startswith("page-") and n.endswith(".json"))
        if self.rows == "all":
            links = {token: (_page(_text(self.path, token)) or {}).get("nextPageToken") for token in tokens}
            each = iter([(k, token, missing) for k, (token, missing) in enumerate(chain(links))])
        else:
            first = [(None, "", True)] if self.rows == "missing" and "" not in tokens[:1] else []
            each = iter(first + [(None, token, False) for token in tokens])
        return [Pages(some) for some in iter(lambda: list(islice(each, FILES)), [])]

    def read(self, partition: Pages | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no page at all
            return
        here = {token for _, token, missing in partition.pages if not missing}
        made = self._lost if self.rows == "missing" else self._records
        with ThreadPoolExecutor(ABREAST) as pool:
            # As many pages as are open at once are held at once.
            for at in range(0, len(partition.pages), ABREAST):
                rows = [r for some in pool.map(lambda p: list(made(p, here)), partition.pages[at : at + ABREAST]) for r in some]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)

    def _records(self, page: tuple[int | None, str, bool], here: set[str]) -> Iterable[tuple]:
        place, token, missing = page
        if missing:
            return [(token, place, None, True, False)]
        text = _text(self.path, token)
        if (body := _page(text)) is None:
            return [(token, place, text, False, True)]
        return [(token, place, json.dumps(record, ensure_ascii=False), False, False) for record in body.get("records") or []]

    def _lost(self, page: tuple[int | None, str, bool], here: set[str]) -> Iterable[tuple]:
        """The token that a page names, if its page was not captured."""
        from pyarrow import fs

        _, token, missing = page
        onward = token if missing else (_page(_text(self.path, token)) or {}).get("nextPageToken")
        if not missing:
            if not onward or onward in here:
                return []
            files, root = _files(self.path)
            if files.get_file_info(f"{root}/page-{onward}.json").type == fs.FileType.File:
                return []
        return [(onward, None, None, True, False)]


class PagedSource(DataSource):
    """Options: path, the folder of captured pages; rows, all (the default), captured or missing."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PagedReader:
        rows = self.options.get("rows", "all")
        if rows not in ("all", "captured", "missing"):
            raise ValueError(f"rows = {rows} is none of all, captured, missing")
        return PagedReader(self.options["path"], rows)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """token, record, missing, broken of every captured page and of each missing one once; the driver opens no page."""
    spark.dataSource.register(PagedSource)
    rows = lambda which: spark.read.format("pages").option("path", path).option("rows", which).load().drop("place")
    return rows("captured").unionByName(rows("missing").distinct())
