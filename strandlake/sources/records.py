"""Records of a remote store by number, as a Spark data source: in batch by ranges of numbers, as a stream by offsets.

``spark.dataSource.register(Records)`` once, then ``spark.read.format("records").options(...)``.  Options: ``fetcher`` names a
function ``package.module:function`` that gets the options on the worker and gives a ``Fetcher``; ``pattern`` makes a record's name
from its number (``NM_{id:06d}.1``); ``first`` and ``last`` bound the numbers, ``step`` those of one task; ``tries`` and ``wait``
rule retries.  A record that can't be had is a row with its problem, so one failure doesn't lose a task's other records.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.plugins import brought

SCHEMA = "id long, asked string, text string, problem string"


class Fetcher:
    """A connection: ``get`` raises LookupError for what isn't there, OSError for what may work later."""

    def get(self, name: str) -> bytes:
        raise NotImplementedError

    def latest(self) -> int:
        """The largest number there is by now; only streams ask."""
        raise NotImplementedError


class Folder(Fetcher):
    """Records as files of a folder (fixtures, or a mirror), the largest number in a file ``latest``."""

    def __init__(self, options: dict[str, str]) -> None:
        self.store, self.root = fs.FileSystem.from_uri(options["folder"])

    def get(self, name: str) -> bytes:
        try:
            with self.store.open_input_file(f"{self.root}/{name}") as f:
                return f.read()
        except FileNotFoundError as e:
            raise LookupError(name) from e

    def latest(self) -> int:
        return int(self.get("latest"))


@dataclass
class Span(InputPartition):
    first: int
    last: int


class _Reader:
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options = dict(options)
        self.pattern = options["pattern"]
        self.first, self.step = int(options.get("first", "0")), int(options.get("step", "100"))
        self.last = int(options["last"]) if "last" in options else None
        self.tries, self.wait = int(options.get("tries", "5")), float(options.get("wait", "1"))
        if self.step < 1 or "fetcher" not in options:
            raise ValueError("a fetcher and a step of 1 or more are needed")

    def fetcher(self) -> Fetcher:
        module, name = self.options["fetcher"].split(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def spans(self, first: int, last: int) -> list[Span]:
        return [Span(at, min(at + self.step - 1, last)) for at in range(first, last + 1, self.step)]

    def read(self, partition: Span) -> Iterator[tuple]:
        get = self.fetcher().get
        for i in range(partition.first, partition.last + 1):
            yield (i, *brought(get, self.pattern.format(id=i), self.tries, self.wait))


class _Batch(_Reader, DataSourceReader):
    def partitions(self) -> list[Span]:
        if self.last is None:
            raise ValueError("a batch needs the last number")
        return self.spans(self.first, self.last)


class _Stream(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"next": self.first}

    def latestOffset(self) -> dict:
        there = self.fetcher().latest()
        return {"next": max(self.first, 1 + (there if self.last is None else min(there, self.last)))}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return self.spans(start["next"], end["next"] - 1)

    def commit(self, end: dict) -> None:
        pass


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)
