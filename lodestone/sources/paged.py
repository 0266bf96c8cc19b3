"""Datasets behind a paging interface as a Spark data source, in batch and as a stream.

A fetcher answers (offset, length) with {"rows": [{"row_idx": n, "row": {...}}, ...], "num_rows_total": n}. A run of pages is a partition,
so executors fetch pages side by side and a lost task fetches its pages again; few pages have a partition each, many share ``RUNS``
partitions until these hold ``RUN`` pages. A fetcher may have ``spans``, which tells the driver once where its storage divides the rows:
a partition then takes whole spans, as far as pages allow, and its fetcher gets these alone. A page that fails is asked for once more
after a pause; one that fails again, or comes back short, fails its task rather than lose rows. ``start`` resumes behind the rows that
a target already holds; as a stream the offset is kept in the checkpoint, and each batch takes what has come since.

Rows are (row_idx, row): the row as JSON text, to be read with ``from_json``.
"""

from __future__ import annotations

import bisect
import importlib
import itertools
import json
import os
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow.dataset
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "row_idx long, row string"
#: Rows of a page, seconds before a page is asked for again.
PAGE, PAUSE = 100, 2.0
#: Partitions of few pages, pages of a partition beyond, rows of a file in memory at once.
RUNS, RUN, BATCH = 64, 100, 1000


def http_pages(options: dict[str, str]) -> Callable[[int, int], dict]:
    """Pages by GET: ``url`` with dataset, config, split, offset and length."""
    told = {k: options[k] for k in ("dataset", "config", "split") if k in options}

    def fetch(offset: int, length: int) -> dict:
        asked = urllib.parse.urlencode(told | {"offset": offset, "length": length})
        with urllib.request.urlopen(f"{options['url']}?{asked}", timeout=float(options.get("timeout", 60))) as answer:
            return json.load(answer)

    return fetch


def _row_groups(options: dict[str, str]) -> list[tuple[int, int, str, int]]:
    """(first row, rows, file, row group) of a Parquet file or folder, from the footers."""
    out, at = [], 0
    for f in pyarrow.dataset.dataset(options["path"], format="parquet").get_fragments():
        for g in f.row_groups:
            if g.num_rows:
                out.append((at, g.num_rows, f.path, g.id))
                at += g.num_rows
    return out


def file_pages(options: dict[str, str]) -> Callable[[int, int], dict]:
    """Pages of a Parquet file or folder at ``path``. Pages in order read each row group once, a batch at a time; one that lies before the last
    starts over."""
    spans = json.loads(options["spans"]) if "spans" in options else _row_groups(options)
    total = spans[-1][0] + spans[-1][1] if spans else 0
    held: dict = {"at": 0, "rows": iter(())}

    def rows_from(start: int) -> Iterator[dict]:
        path = options["path"]
        files = pyarrow.fs.FileSystem.from_uri(path if ":" in path else os.path.abspath(path))[0]
        for first, n, file, group in spans:
            at = first
            if first + n <= start:
                continue
            with files.open_input_file(file) as source:
                for b in pyarrow.parquet.ParquetFile(source).iter_batches(BATCH, row_groups=[group]):
                    if at + b.num_rows > start:
                        yield from b.slice(max(0, start - at)).to_pylist()
                    at += b.num_rows

    def fetch(offset: int, length: int) -> dict:
        if offset != held["at"] or not offset:
            held["rows"] = rows_from(offset)
        found = list(itertools.islice(held["rows"], length))
        held["at"] = offset + len(found)
        return {"rows": [{"row_idx": offset + i, "row": r} for i, r in enumerate(found)], "num_rows_total": total}

    return fetch


file_pages.spans = _row_groups


class Pages(InputPartition):
    """A run of pages: rows from ``offset`` on, and the spans that hold them."""

    def __init__(self, offset: int, length: int, spans: list[tuple] | None = None):
        super().__init__(offset)
        self.offset, self.length, self.spans = offset, length, spans


class _Pages:
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.size, self.first = int(options.get("page", PAGE)), int(options.get("start", 0))

    def source(self) -> Callable:
        module, _, name = self.options.get("fetcher", f"{__name__}:http_pages").partition(":")
        return getattr(importlib.import_module(module), name)

    def fetcher(self, spans: list[tuple] | None = None) -> Callable[[int, int], dict]:
        """A fetcher that asks once more, anew, for a page that fails."""
        options = self.options if spans is None else self.options | {"spans": json.dumps(spans)}
        ask = self.source()(options)

        def fetch(offset: int, length: int) -> dict:
            nonlocal ask
            try:
                return ask(offset, length)
            except (OSError, ValueError):
                time.sleep(float(self.options.get("pause", PAUSE)))
                ask = self.source()(options)
                return ask(offset, length)

        return fetch

    def total(self) -> int:
        return int(self.fetcher()(self.first, 1)["num_rows_total"])

    def runs(self, start: int, end: int) -> list[Pages]:
        """The pages from ``start`` to ``end`` in runs."""
        spans = getattr(self.source(), "spans", None)
        n = -(-(end - start) // self.size)
        if spans is None:
            step = self.size * min(RUN, max(1, -(-n // RUNS)))
            return [Pages(i, min(step, end - i)) for i in range(start, end, step)]
        told, cuts = spans(self.options), [start]
        for first, rows, *_ in told:
            upto = min(end, start + -(-(first + rows - start) // self.size) * self.size)  # a page's rest lies in the next spans
            if upto - cuts[-1] >= self.size * RUN:
                cuts.append(upto)
        cuts += [end] * (cuts[-1] < end)
        ends = [first + rows for first, rows, *_ in told]
        held = lambda i, k: told[bisect.bisect_right(ends, i) : bisect.bisect_left(told, (k,))]
        return [Pages(i, k - i, held(i, k)) for i, k in itertools.pairwise(cuts)]

    def rows(self, run: Pages) -> Iterator[tuple[int, str]]:
        fetch = self.fetcher(run.spans)
        for at in range(run.offset, run.offset + run.length, self.size):
            n = min(self.size, run.offset + run.length - at)
            found = fetch(at, n)["rows"]
            if len(found) != n:
                raise ValueError(f"page at {at} has {len(found)} rows, not {n}")
            for r in found:
                yield int(r["row_idx"]), json.dumps(r["row"], ensure_ascii=False)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.held = _Pages(options)

    def partitions(self) -> list[Pages]:
        return self.held.runs(self.held.first, self.held.total()) or [Pages(self.held.first, 0)]

    def read(self, run: Pages) -> Iterator[tuple[int, str]]:
        return self.held.rows(run)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.held = _Pages(options)

    def initialOffset(self) -> dict:
        return {"offset": self.held.first}

    def latestOffset(self) -> dict:
        return {"offset": self.held.total()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.held.runs(start["offset"], end["offset"])

    def read(self, run: Pages) -> Iterator[tuple[int, str]]:
        return self.held.rows(run)

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def read(spark: SparkSession, **options) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").options(**options).load()


def read_stream(spark: SparkSession, **options) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.readStream.format("paged").options(**options).load()


def resumed(spark: SparkSession, target: DataFrame, **options) -> DataFrame:
    """The rows behind those that ``target`` holds; pages are asked for from its row count on."""
    return read(spark, **options, start=str(target.count()))
