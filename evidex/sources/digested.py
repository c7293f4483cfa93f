"""A data source of record files with digests: `spark.read.format("digested")` and `df.write.format("digested")`.

Each task writes one file of canonical JSON lines among the pending ones and reports its name, rows, bytes and SHA-256. The
commit moves the files in and then replaces the manifest, which alone says what belongs to the data; an abort removes what
is pending. So a failed task leaves nothing that a reader sees, and a retried one counts once. A reader takes a file a task
and fails where a file isn't what its digest says.
"""

from __future__ import annotations

import base64
import datetime
import decimal
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MANIFEST = "_manifest.json"


def _place(path: str):
    """The file system of a path that driver and executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def canonical(value) -> str:
    """JSON with sorted names and no blanks; values that JSON lacks as text."""

    def other(v):
        if isinstance(v, (bytes, bytearray)):
            return base64.b64encode(v).decode()
        if isinstance(v, (datetime.datetime, datetime.date)):
            return v.isoformat()
        if isinstance(v, decimal.Decimal):
            return str(v)
        raise TypeError(f"no text for {type(v).__name__}")

    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=other)


def parsed(value, kind: T.DataType):
    """A value of JSON as `kind`."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return Row(**{f.name: parsed(value.get(f.name), f.dataType) for f in kind.fields})
    if isinstance(kind, T.ArrayType):
        return [parsed(x, kind.elementType) for x in value]
    if isinstance(kind, T.MapType):
        return {k: parsed(x, kind.valueType) for k, x in value.items()}
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return datetime.datetime.fromisoformat(value)
    if isinstance(kind, T.DateType):
        return datetime.date.fromisoformat(value)
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(value)
    if isinstance(kind, T.BinaryType):
        return base64.b64decode(value)
    return float(value) if isinstance(kind, (T.DoubleType, T.FloatType)) else value


def manifest(path: str) -> dict:
    """`files` (name to rows, bytes and sha256) and the `integrity` hash over them; empty before the first commit."""
    system, at = _place(path)
    try:
        with system.open_input_stream(f"{at}/{MANIFEST}") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return {"files": {}, "integrity": integrity({})}


def integrity(files: dict) -> str:
    """SHA-256 over names and digests, in order of the names."""
    return hashlib.sha256("\n".join(f"{n} {files[n]['sha256']}" for n in sorted(files)).encode()).hexdigest()


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    bytes: int
    sha256: str


@dataclass
class File(InputPartition):
    name: str
    sha256: str


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        system, at = _place(self.path)
        pending = f"{at}/_pending-{self.job}"
        system.create_dir(pending, recursive=True)
        name, n, size, digest = f"{uuid.uuid4().hex}.jsonl", 0, 0, hashlib.sha256()
        with system.open_output_stream(f"{pending}/{name}") as out:
            for row in rows:
                line = (canonical(row.asDict(recursive=True)) + "\n").encode()
                out.write(line)
                digest.update(line)
                n, size = n + 1, size + len(line)
        return Written(name, n, size, digest.hexdigest())

    def commit(self, messages: list[Written | None]) -> None:
        system, at = _place(self.path)
        files = {} if self.overwrite else manifest(self.path)["files"]
        system.create_dir(f"{at}/data", recursive=True)
        for m in filter(None, messages):
            if m.rows:
                system.move(f"{at}/_pending-{self.job}/{m.name}", f"{at}/data/{m.name}")
                files[m.name] = {"rows": m.rows, "bytes": m.bytes, "sha256": m.sha256}
        with system.open_output_stream(f"{at}/.{self.job}") as out:
            out.write(canonical({"files": files, "integrity": integrity(files)}).encode())
        system.move(f"{at}/.{self.job}", f"{at}/{MANIFEST}")
        self._tidy()

    def abort(self, messages: list[Written | None]) -> None:
        self._tidy()

    def _tidy(self) -> None:
        from pyarrow import fs

        system, at = _place(self.path)
        if system.get_file_info(f"{at}/_pending-{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{at}/_pending-{self.job}")


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[File]:
        listed = manifest(self.path)
        if integrity(listed["files"]) != listed["integrity"]:
            raise ValueError(f"the manifest of {self.path} doesn't agree with its integrity hash")
        return [File(n, f["sha256"]) for n, f in sorted(listed["files"].items())] or [File("", "")]

    def read(self, file: File) -> Iterator[tuple]:
        if not file.name:
            return
        system, at = _place(self.path)
        digest = hashlib.sha256()
        with system.open_input_stream(f"{at}/data/{file.name}") as f:
            while block := f.read(1 << 20):
                digest.update(block)
        if digest.hexdigest() != file.sha256:
            raise ValueError(f"{file.name} is not what its digest says")
        rest = b""
        with system.open_input_stream(f"{at}/data/{file.name}") as f:
            while block := f.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    record = json.loads(line)
                    yield tuple(parsed(record.get(c.name), c.dataType) for c in self.schema.fields)


class Digested(DataSource):
    """Options: path, in a folder that driver and executors share. The schema is the reader's to give."""

    @classmethod
    def name(cls) -> str:
        return "digested"

    def schema(self) -> T.StructType:
        raise ValueError("give the schema of the records")

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Digested)
