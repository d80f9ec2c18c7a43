"""One JSON record in a file of its own, as a data source that tasks read and write."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "id string, written timestamp, record string"
#: Files that one task reads.
FILES_PER_TASK = 2000
STAGED = "_staged-"
_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    names: list[tuple[str, datetime]]


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    ids: list[str]


class RecordReader(DataSourceReader):
    """Records of a folder. Bounds on the time of writing are tested on the listing, so files that don't fit are never opened. Damaged records are left out."""

    def __init__(self, path: str):
        self.path, self.tests = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the base class's name
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("written",):
                self.tests.append(f)
            else:
                yield f

    def _fits(self, written: datetime) -> bool:
        def same_kind(value: datetime) -> datetime:
            return value if value.tzinfo else value.astimezone()  # a time without a zone is one of the session's machine

        return all(_TESTS[type(f)](written, same_kind(f.value)) for f in self.tests)

    def partitions(self) -> list[Files]:
        files, folder = _place(self.path)
        found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        names = sorted((i.path, i.mtime) for i in found if i.is_file and i.base_name.endswith(".json") and self._fits(i.mtime))
        return [Files(names[k : k + FILES_PER_TASK]) for k in range(0, len(names), FILES_PER_TASK)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        files, _ = _place(self.path)
        for name, written in partition.names:
            try:
                text = files.open_input_stream(name).read().decode()
                json.loads(text)
            except (OSError, ValueError):
                continue
            yield name.rpartition("/")[2].removesuffix(".json"), written, text


class RecordWriter(DataSourceWriter):
    """Each task writes to a folder of its own beside the records. They are moved in place when all tasks have ended well; else nothing stays."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.overwrite, self.fields = path, overwrite, schema.names
        self.staging = f"{STAGED}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        files, root = _place(self.path)
        folder, ids = f"{root}/{self.staging}/{uuid.uuid4().hex}", []
        files.create_dir(folder, recursive=True)
        for row in iterator:
            name, text = row["id"], row["record"]
            if not name or "/" in name or name.startswith("."):
                raise ValueError(f"not a record's id: {name!r}")
            json.loads(text)  # a record that is no JSON fails the job
            with files.open_output_stream(f"{folder}/{name}.json") as out:
                out.write(text.encode())
            ids.append(name)
        return Staged(folder, ids)

    def commit(self, messages: list[Staged | None]) -> None:
        files, root = _place(self.path)
        kept = set()
        for m in filter(None, messages):
            for name in m.ids:
                files.move(f"{m.folder}/{name}.json", f"{root}/{name}.json")
                kept.add(f"{name}.json")
        if self.overwrite:
            for i in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if i.is_file and i.base_name.endswith(".json") and i.base_name not in kept:
                    files.delete_file(i.path)
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        files, root = _place(self.path)
        if files.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.staging}")


class RecordFiles(DataSource):
    """format("records"), option path: rows of id, written (when reading) and record, a JSON text."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], schema, overwrite)


def patched(records: DataFrame, patches: DataFrame) -> DataFrame:
    """records (id, record) with the fields of their patch (id, patch: a JSON object) in place of their own; other fields and records stay as they are."""

    def fields(c: str) -> Column:
        return F.try_variant_get(F.try_parse_json(F.col(c)), "$", "map<string,variant>")

    joined = records.join(patches.select("id", "patch"), "id", "left").withColumns({"_own": fields("record"), "_new": fields("patch")})
    merged = F.map_concat(F.map_filter("_own", lambda k, _: ~F.map_contains_key("_new", k)), F.col("_new"))
    changed = F.col("_own").isNotNull() & F.col("_new").isNotNull()
    return joined.withColumn("record", F.when(changed, F.to_json(merged)).otherwise(F.col("record"))).drop("patch", "_own", "_new")


def utc(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)
