"""A dataset that is served in pages by offset, as a Python data source.

The dataset is a folder of JSON answers ``<offset, 12 digits>.json`` with ``{"rows": [...],
"num_rows_total": n}``; pyarrow opens it, so any address that pyarrow knows will do. A task
reads a range of offsets, one page at a time, and ends at its first empty page, which a
missing file is too; beyond it such a dataset has no more rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType

#: Fixed value: the most rows that a page has.
PAGE_ROWS = 100


class OffsetRange(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


def fetch_page(folder: str, offset: int) -> dict:
    """The answer for an offset; an empty one where there is none."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    path = f"{root}/{offset:012d}.json"
    if files.get_file_info(path).type == fs.FileType.NotFound:
        return {"rows": []}
    with files.open_input_stream(path) as stream:
        return json.loads(stream.read())


def _value(raw: object, kind: DataType) -> object:
    """A field's value; blank text and NA are null, what doesn't fit the type is an error."""
    if isinstance(raw, str) and (not raw.strip() or raw.strip().upper() == "NA"):
        return None
    if raw is None:
        return None
    if isinstance(kind, StringType):
        return raw.strip() if isinstance(raw, str) else json.dumps(raw)
    if isinstance(kind, BooleanType) != isinstance(raw, bool) or isinstance(raw, (list, dict)):
        raise ValueError(raw)
    if isinstance(kind, BooleanType):
        return raw
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        number = int(raw)
        bits = {ByteType: 7, ShortType: 15, IntegerType: 31, LongType: 63}[type(kind)]
        if isinstance(raw, float) and number != raw or not -(1 << bits) <= number < 1 << bits:
            raise ValueError(raw)
        return number
    if isinstance(kind, (FloatType, DoubleType)):
        return float(raw)
    raise TypeError(f"a paged dataset has no columns of type {kind.simpleString()}")


def rows_of(answer: dict, schema: StructType) -> Iterator[tuple]:
    """The legible rows of a page; a row that isn't an object, has a value of another kind or lacks a field that can't be null is left out."""
    for raw in answer.get("rows") or []:
        row = raw.get("row", raw) if isinstance(raw, dict) else None
        if not isinstance(row, dict):
            continue
        try:
            made = tuple(_value(row.get(f.name), f.dataType) for f in schema)
        except (ValueError, OverflowError):
            continue
        if all(v is not None or f.nullable for v, f in zip(made, schema)):
            yield made


def write_pages(rows: DataFrame, number: str, first: int, folder: str) -> None:
    """Rows numbered by the column ``number`` from ``first`` on, without gaps, as pages; a retried task writes its pages again."""
    total = rows.count()
    page = F.floor((F.col(number) - first) / PAGE_ROWS) * PAGE_ROWS
    packed = rows.groupBy(page.alias("at")).agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col(number).alias("__n"), F.struct(*rows.columns).alias("row"))))).alias("rows"))

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        files.create_dir(root)
        for part in parts:
            for at, text in zip(part["at"], part["rows"]):
                draft = f"{root}/.{uuid.uuid4().hex}"
                with files.open_output_stream(draft) as out:
                    out.write(f'{{"num_rows_total": {total}, "rows": {text}}}'.encode())
                files.move(draft, f"{root}/{at:012d}.json")
            yield part[["at"]]

    packed.mapInPandas(write, "at long").write.format("noop").mode("overwrite").save()


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.folder, self.schema = options["path"], schema
        self.page = min(max(1, int(options.get("pagesize", PAGE_ROWS))), PAGE_ROWS)
        self.start = int(options.get("offset", 0))
        self.limit = int(options["limit"]) if "limit" in options else None
        self.pages_a_task = max(1, int(options.get("pagespertask", 16)))
        if self.start % self.page:
            raise ValueError(f"offset {self.start} isn't the beginning of a page of {self.page} rows")

    def partitions(self) -> list[InputPartition]:
        total = fetch_page(self.folder, 0).get("num_rows_total")
        ends = [x for x in (total, None if self.limit is None else self.start + self.limit) if x is not None]
        if not ends:
            return [OffsetRange(self.start, 1 << 62)]  # nothing says where it ends: one task follows the pages
        step = self.page * self.pages_a_task
        return [OffsetRange(a, min(a + step, min(ends))) for a in range(self.start, min(ends), step)] or [OffsetRange(0, 0)]

    def read(self, partition: OffsetRange) -> Iterator[tuple]:
        for offset in range(partition.start, partition.end, self.page):
            answer = fetch_page(self.folder, offset)
            if not answer.get("rows"):
                return
            answer["rows"] = answer["rows"][: partition.end - offset]
            yield from rows_of(answer, self.schema)


class PagedRows(DataSource):
    """``spark.read.format("paged_rows").schema(...).option("offset", ...).option("limit", ...).load(folder)``.

    Other options: ``pageSize`` (at most 100, as the pages were made), ``pagesPerTask``. The
    schema is needed; fields that mustn't be null drop the rows that lack them.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options, schema)
