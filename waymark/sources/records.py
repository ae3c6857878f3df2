"""Record collections as a data source of their own: a folder of JSON files that is read in parallel, and a sink that
leaves every record once.

Reading. `format("records")` lists the folder once, deals the files to partitions and gives the declared columns. With `lines`
every line is a record, else every file. `__file`, if declared, is the file's name unless the record says otherwise. What doesn't
parse or doesn't fit the declared types ends the job, or in `mode` quarantine comes as a row whose `_error` says why.

Writing. Tasks stage files under names of their own; the commit is one log entry that lists them, created if and only if the
version before is the newest one. A failed, killed or repeated task leaves a file that no entry lists, and a batch whose name the
log holds is written once however often it is sent. Readers of a folder with a log see the listed files alone. With `compression`
staged files are compressed, and readers know them by their names.

Paths are local or have a scheme that pyarrow reads, and have to be reachable from every executor."""

from __future__ import annotations

import fnmatch
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from waymark.operators import schema as rules
from waymark.sources.staged import remove, staged

LOG, STAGED = "_log", "_staged"
#: Ends of the names of compressed files, by which readers know them, and how many bytes of records one of theirs counts as.
ENDS, UNPACKED = {"zstd": ".zst", "gzip": ".gz"}, 10
#: The one column of rows that are texts of records already.
TEXT = "__json"
#: Files and bytes of one partition; filesPerPartition sets another number.
FILES, BYTES = 500, 64 << 20


class Conflict(RuntimeError):
    """Another batch was committed meanwhile."""


def _open(path: str) -> tuple[fs.FileSystem, str]:
    at = urlparse(path)
    if at.scheme in ("", "file"):
        return fs.LocalFileSystem(), at.path.rstrip("/")
    found, inner = fs.FileSystem.from_uri(path)
    return found, inner.rstrip("/")


def _names(disk: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """Files right in a folder, by name; none if it is missing."""
    return sorted((i for i in disk.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.type == fs.FileType.File), key=lambda i: i.base_name)


def log_entries(path: str) -> list[dict]:
    """The commits of a folder, oldest first."""
    disk, folder = _open(path)
    return [json.loads(disk.open_input_file(i.path).read()) for i in _names(disk, f"{folder}/{LOG}") if i.base_name.endswith(".json")]


def _typed(value, kind: T.DataType):
    """A parsed JSON value as a value of a Spark type; an error if it is of another kind."""
    if value is None:
        return None
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        return tuple(_typed(value.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType) and isinstance(value, list):
        return [_typed(x, kind.elementType) for x in value]
    if isinstance(kind, T.MapType) and isinstance(value, dict):
        return {k: _typed(x, kind.valueType) for k, x in value.items()}
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    fits = {
        T.StringType: isinstance(value, str), T.BooleanType: isinstance(value, bool), T.DoubleType: number,
        T.LongType: number and value == int(value) if number and abs(value) < 1 << 63 else False, T.IntegerType: number and abs(value) < 1 << 31 and value == int(value),
    }
    if not fits.get(type(kind), False):
        raise ValueError(f"{json.dumps(value)[:60]} is no {kind.simpleString()}")
    return float(value) if isinstance(kind, T.DoubleType) else int(value) if isinstance(kind, (T.LongType, T.IntegerType)) else value


@dataclass
class Files(InputPartition):
    names: list[str]


class RecordReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.lines, self.glob = options.get("lines", "false") == "true", options.get("glob", "*.json")
        self.files, self.quarantine = int(options.get("filesPerPartition", FILES)), options.get("mode", "failfast") == "quarantine"
        if self.quarantine and "_error" not in schema.fieldNames():
            raise ValueError("mode quarantine needs a column _error")

    def partitions(self) -> list[Files]:
        disk, folder = _open(self.path)
        listed = [n for e in log_entries(self.path) for n in e["files"]]
        infos = disk.get_file_info([f"{folder}/{n}" for n in listed]) if listed else [i for i in _names(disk, folder) if fnmatch.fnmatch(i.base_name, self.glob)]
        out, held = [Files([])], 0
        for i in infos:
            size = i.size * (UNPACKED if i.path.endswith(tuple(ENDS.values())) else 1)
            if len(out[-1].names) == self.files or out[-1].names and held + size > BYTES:
                out.append(Files([]))
                held = 0
            out[-1].names.append(i.path)
            held += size
        return out

    def _row(self, name: str, raw: bytes) -> tuple:
        try:
            record = json.loads(raw)
            record = record if isinstance(record, dict) else {}  # a record without fields
            return tuple(_typed(record.get(f.name, name if f.name == "__file" else None), f.dataType) for f in self.schema)
        except ValueError as why:
            if not self.quarantine:
                raise ValueError(f"Invalid record in {name}: {why}") from why
            own = {"__file": name, "_error": str(why)}
            return tuple(own.get(f.name) for f in self.schema)

    def read(self, partition: Files) -> Iterator[tuple]:
        disk, _ = _open(self.path)
        for path in partition.names:
            name = path.rsplit("/", 1)[-1]
            lines = self.lines or name.endswith((".jsonl", *(f".jsonl{end}" for end in ENDS.values())))
            with disk.open_input_stream(path) as f:
                for raw in _split(f) if lines else [f.read()]:
                    yield self._row(name, raw)


def _split(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The lines of a stream that hold anything, read piece by piece."""
    rest = b""
    while piece := stream.read(size):
        *lines, rest = (rest + piece).split(b"\n")
        yield from (x for x in lines if x.strip())
    if rest.strip():
        yield rest


@dataclass
class Staged(WriterCommitMessage):
    name: str
    n: int


class RecordWriter(DataSourceWriter):
    codec: str | None = None

    def __init__(self, schema: T.StructType, options: dict):
        self.names, self.path = schema.fieldNames(), options["path"]
        self.batch = options.get("batch") or uuid.uuid4().hex
        self.expected = options.get("expected")
        self.codec = options.get("compression")
        if self.codec not in (None, *ENDS):
            raise ValueError(f"compression {self.codec} is none of {', '.join(ENDS)}")

    def write(self, iterator) -> Staged:
        at, (disk, folder) = TaskContext.get(), _open(self.path)
        name = f"{STAGED}/{uuid.uuid4().hex}-{at.partitionId()}-{at.taskAttemptId()}.jsonl{ENDS.get(self.codec, '')}"
        disk.create_dir(f"{folder}/{STAGED}", recursive=True)
        n = 0
        with disk.open_output_stream(f"{folder}/{name}", compression=self.codec) as out:
            for row in iterator:
                text = row[0] if self.names == [TEXT] else json.dumps({k: v for k, v in row.asDict(recursive=True).items() if v is not None}, ensure_ascii=False)
                out.write(text.encode() + b"\n")
                n += 1
        return Staged(name, n)

    def commit(self, messages: list) -> None:
        entries, (disk, folder) = log_entries(self.path), _open(self.path)
        if any(e["batch"] == self.batch for e in entries):
            return self.abort(messages)
        if self.expected is not None and int(self.expected) != len(entries):
            self.abort(messages)
            raise Conflict(f"{self.path} is at version {len(entries)}, not {self.expected}")
        kept = [m for m in messages if m is not None and m.n]
        entry = {"batch": self.batch, "files": [m.name for m in kept], "n": sum(m.n for m in kept)}
        disk.create_dir(f"{folder}/{LOG}", recursive=True)
        name = f"{folder}/{LOG}/{len(entries):020d}.json"
        if isinstance(disk, fs.LocalFileSystem):
            try:
                with open(name, "x", encoding="utf-8") as out:
                    out.write(json.dumps(entry))
            except FileExistsError as why:
                raise Conflict(f"{self.path} has got version {len(entries)}") from why
            return None
        if disk.get_file_info(name).type != fs.FileType.NotFound:
            raise Conflict(f"{self.path} has got version {len(entries)}")
        with disk.open_output_stream(name) as out:  # such stores create a file whole or not at all
            out.write(json.dumps(entry).encode())
        return None

    def abort(self, messages: list) -> None:
        disk, folder = _open(self.path)
        for m in messages:
            if m is not None:
                disk.delete_file(f"{folder}/{m.name}")


class Records(DataSource):
    """The data source `records`."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        raise ValueError("records are read with a declared schema")

    def reader(self, schema: T.StructType) -> RecordReader:
        return RecordReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> RecordWriter:
        if overwrite:
            raise ValueError("records are only added")
        return RecordWriter(schema, self.options)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, **options) -> DataFrame:
    """The records of a folder; a missing folder has none."""
    spark.dataSource.register(Records)
    return spark.read.format("records").schema(schema).options(path=path, **{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).load()


def judged(rows: DataFrame, fields: tuple, keep: list[str]) -> tuple[str, DataFrame]:
    """Rows as a declared schema judges them, written once: (the table's path, the table). It has the columns to keep, the issues and,
    of rows without any, all columns as `_record`; of the others nothing more, as nothing more is asked of them."""
    issues = rules.issues(rows, fields)
    record = F.when(F.size("issues") == 0, F.struct(*("`" + c.replace("`", "``") + "`" for c in rows.columns))).alias("_record")
    return staged(issues.select(*keep, "issues", record), "judged")


def write_judged(rows: DataFrame, path: str, fields: tuple, key: str, order: list[Column], batch: str, quarantine: str, compression: str | None = None) -> None:
    """`write_records` for rows of a judged table, which keeps the key; batches that share rows have them judged once."""
    spark = rows.sparkSession
    spark.dataSource.register(Records)
    done = log_entries(path)
    if any(e["batch"] == batch for e in done):
        return
    options = {"batch": batch} | ({"compression": compression} if compression else {})
    refused = rows.filter(F.size("issues") > 0).select(key, F.inline("issues"))
    refused.select(F.to_json(F.struct(*refused.columns)).alias(TEXT)).write.format("records").mode("append").options(path=quarantine, **options).save()
    # of rows with issues, which have no record, none is taken
    valid = rows.filter(F.size("issues") == 0).select("_record.*")
    first = valid.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_nth = 1")
    new = first.join(read_records(spark, path, T.StructType([first.schema[key]])), key, "left_anti") if done else first
    names = [f.name for f in fields if f.name in first.columns]
    # the engine makes the texts of the records; a task only writes them
    new.select(F.to_json(F.struct(*names)).alias(TEXT)).write.format("records").mode("append").options(path=path, expected=str(len(done)), **options).save()


def write_records(rows: DataFrame, path: str, fields: tuple, key: str, order: list[Column], batch: str, quarantine: str, compression: str | None = None) -> None:
    """Adds the rows that keep every rule of a declared schema, cut down to its fields, one for each key and none whose key the folder
    holds; of rows with one key the first in `order` is new. The issues of the others go to quarantine. A batch counts once;
    a batch that is beaten to the log by another one ends with a Conflict and may be sent again. Files are compressed by a codec
    of pyarrow's (zstd, gzip) if one is named."""
    if any(e["batch"] == batch for e in log_entries(path)):
        return
    at, table = judged(rows, fields, [key])
    try:
        write_judged(table, path, fields, key, order, batch, quarantine, compression)
    finally:
        remove(rows.sparkSession, at)


def vacuum(path: str) -> int:
    """Deletes staged files that no log entry lists, when nothing is being written; gives their number."""
    disk, folder = _open(path)
    listed = {n for e in log_entries(path) for n in e["files"]}
    gone = [i.path for i in _names(disk, f"{folder}/{STAGED}") if f"{STAGED}/{i.base_name}" not in listed]
    for p in gone:
        disk.delete_file(p)
    return len(gone)
