"""The source and sink interfaces as Spark data sources in Python: files that grow.

``tidewater_tail`` reads the lines of a folder's files while they grow, ``tidewater_log`` a log
of JSON messages in such files, and appends to it. A partition is a file and is named by
it, so a new file moves no other; an offset is the byte at which a line begins. A last line
without its end is left until it is finished. ``startingOffsets`` is earliest or latest, and
a checkpoint wins over it. The driver looks at the end of each file only; tasks read spans of
``splitBytes``, each the lines that begin in it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..session import ship_package
from ..sources.avro import AvroSource, files_of, system_of
from ..sources.sequence import SequenceSource

SPLIT_BYTES, CHUNK = 64 << 20, 1 << 16


@dataclass
class Span(InputPartition):
    """Lines of a file that begin from ``start`` to below ``stop``; ``first`` says that one begins at ``start``."""

    path: str
    name: str
    start: int
    stop: int
    first: bool


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class _Tail(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], pattern: str):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.start = options["path"], options.get("startingoffsets", "earliest")
        self.pattern, self.split_bytes = options.get("pattern", pattern), int(options.get("splitbytes", SPLIT_BYTES))
        if self.start not in ("earliest", "latest"):
            raise ValueError(f"startingOffsets is earliest or latest, not {self.start}")

    def _ends(self) -> dict[str, int]:
        """The byte after the last whole line of each file."""
        system, found = files_of(self.path)
        out = {}
        for info in found:
            if fnmatchcase(info.base_name, self.pattern):
                at = info.size
                with system.open_input_file(info.path) as source:
                    while at > 0:
                        start = max(0, at - CHUNK)
                        source.seek(start)
                        end = source.read(at - start).rfind(b"\n")
                        if end >= 0:
                            out[info.base_name] = start + end + 1
                            break
                        at = start
        return out

    def initialOffset(self) -> dict:
        return self._ends() if self.start == "latest" else {}

    def latestOffset(self) -> dict:
        return self._ends()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for name in sorted(end):
            low = start.get(name, 0)
            if end[name] < low:
                raise ValueError(f"{name} has lost lines that were read: it ended at {low} and ends at {end[name]}")
            out += [Span(self.path, name, at, min(at + self.split_bytes, end[name]), at == low) for at in range(low, end[name], self.split_bytes)]
        return out

    def _lines(self, span: Span) -> Iterator[tuple[int, bytes]]:
        """(offset, line without its end); the last one may go on beyond the span."""
        system, top = system_of(span.path)
        with system.open_input_file(f"{top}/{span.name}") as source:
            at = span.start if span.first else span.start - 1
            source.seek(at)
            rest, skip = b"", not span.first
            while at + (0 if skip else len(rest)) < span.stop or rest:
                data = rest + source.read(CHUNK)
                if len(data) == len(rest):
                    return  # a file that was cut since
                begin = 0
                while (stop := data.find(b"\n", begin)) >= 0:
                    if not skip:
                        if at + begin >= span.stop:
                            return
                        yield at + begin, data[begin:stop].removesuffix(b"\r")
                    skip, begin = False, stop + 1
                at, rest = at + begin, data[begin:]
                if at >= span.stop and not skip:
                    return

    def commit(self, end: dict) -> None:
        pass


class _Lines(_Tail):
    def read(self, span: Span) -> Iterator[tuple]:
        for at, line in self._lines(span):
            yield span.name, at, line.decode("utf-8", "replace")


class _Messages(_Tail):
    def read(self, span: Span) -> Iterator[tuple]:
        for at, line in self._lines(span):
            message = json.loads(line)
            yield span.name, at, message.get("key"), message.get("value")


class TailSource(DataSource):
    """``spark.readStream.format("tidewater_tail").option("pattern", "*.txt").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "tidewater_tail"

    def schema(self) -> str:
        return "file string, offset long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Lines(self.options, "*")


class QueueSource(DataSource):
    """``spark.readStream.format("tidewater_log").load(path)`` and ``df.write.format("tidewater_log").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "tidewater_log"

    def schema(self) -> str:
        return "partition string, offset long, key string, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Messages(self.options, "*.log")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> Written:
        system, top = system_of(self.path)
        system.create_dir(top, recursive=True)
        name = uuid.uuid4().hex
        with system.open_output_stream(f"{top}/.{name}") as out:
            for r in rows:
                out.write(json.dumps({"key": r["key"], "value": r["value"]}).encode() + b"\n")
        return Written(f"{top}/.{name}", f"{top}/{name}.log")

    def commit(self, messages) -> None:
        system, _ = system_of(self.path)
        for m in messages:
            system.move(m.temporary, m.final)

    def abort(self, messages) -> None:
        system, _ = system_of(self.path)
        for m in messages:
            if m and system.get_file_info(m.temporary).type == fs.FileType.File:
                system.delete_file(m.temporary)


def register_sources(spark: SparkSession) -> None:
    """Makes the formats tidewater_tail, tidewater_log, tidewater_avro and tidewater_sequence known to a session."""
    ship_package(spark)
    for source in (TailSource, QueueSource, AvroSource, SequenceSource):
        spark.dataSource.register(source)
