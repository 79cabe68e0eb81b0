"""Landed vendor responses as a data source: ``spark.read.format("vendor_feed")`` and ``spark.readStream``.

Whatever downloads them puts a symbol's responses under
``<path>/<symbol>/<day>.json``, named by the day up to which they know the
vendor's releases.  Each is an object with ``observations``: dates, values as
texts, and, where the vendor keeps revisions, ``realtime_start``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Before every release.
NEVER = "0001-01-01"
SCHEMA = "symbol string, date date, value double, realtime_start date, release_date date, vintage string, lag_assumed boolean"


class Part(InputPartition):
    """One symbol's responses; releases up to ``low`` are known already."""

    def __init__(self, symbol: str, files: tuple[str, ...], low: str) -> None:
        self.symbol, self.files, self.low = symbol, files, low


class _Store:
    """The folder of responses, on any file system that Arrow knows (a URI) or a shared path."""

    def __init__(self, options: dict) -> None:
        from pyarrow import fs

        path = options["path"]
        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.symbols = [s for s in options.get("symbols", "").split(",") if s]
        self.lag, self.lags = int(options.get("lag", "1")), json.loads(options.get("lags", "{}"))

    def landed(self) -> list[tuple[str, str, str]]:
        """Symbol, day and path of each response, from listings alone."""
        from pyarrow import fs

        out = []
        for f in self.files.get_file_info(fs.FileSelector(self.root, recursive=True)):
            name = f.path.removeprefix(self.root.rstrip("/") + "/").split("/")
            if f.type == fs.FileType.File and len(name) == 2 and name[1].endswith(".json") and (not self.symbols or name[0] in self.symbols):
                out.append((name[0], name[1].removesuffix(".json"), f.path))
        return sorted(out)

    def parts(self, low: str = NEVER, high: str | None = None) -> list[Part]:
        found: dict[str, list[str]] = {}
        for symbol, day, path in self.landed():
            if low < day and (high is None or day <= high):
                found.setdefault(symbol, []).append(path)
        return [Part(s, tuple(files), low) for s, files in found.items()]

    def rows(self, part: Part) -> Iterator[tuple]:
        """A row per observation with a value; equal rows of several responses once.

        Without ``realtime_start`` an observation is assumed to be released
        its series' lag after its date, as a first vintage.
        """
        seen: set[tuple] = set()
        for path in part.files:
            with self.files.open_input_stream(path) as f:
                response = json.loads(f.read())
            for o in response.get("observations") or []:
                try:
                    day, value = date.fromisoformat(o["date"]), float(o["value"])
                except (KeyError, TypeError, ValueError):  # vendors write "." for no value
                    continue
                start = date.fromisoformat(o["realtime_start"]) if o.get("realtime_start") else None
                release = start or day + timedelta(days=self.lags.get(part.symbol, self.lag))
                row = (part.symbol, day, value, start, release, start.isoformat() if start else "initial", start is None)
                if row not in seen and (start is None or part.low < start.isoformat()):
                    seen.add(row)
                    yield row


class _Batch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Part]:
        return _Store(self.options).parts()

    def read(self, part: Part) -> Iterator[tuple]:
        return _Store(self.options).rows(part)


class _Stream(DataSourceStreamReader):
    """The offset is a response's day: later responses are read, and in them what was released later."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"release": NEVER}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"release": max((day for _, day, _ in _Store(self.options).landed()), default=NEVER)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return _Store(self.options).parts(start["release"], end["release"])

    def read(self, part: Part) -> Iterator[tuple]:
        return _Store(self.options).rows(part)

    def commit(self, end: dict) -> None:
        pass


class VendorFeed(DataSource):
    """Options: ``path``; ``symbols``, a list with commas; ``lag``, days, and ``lags``, a JSON map by symbol, for what has no release date.

    A partition per symbol.  A stream reads a release once, by its
    ``realtime_start``; an observation without one comes again with each
    response that has it, for the natural key to tell.  Responses land in the
    order of their days; one that comes after a later one is left to the
    batch form.
    """

    @classmethod
    def name(cls) -> str:
        return "vendor_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VendorFeed)
