"""Files out of rows, one a row: a Python data source that writes (filename, content) as a tree of files.

A task writes into a folder of its attempt below path/_staging-<job>. Only when all tasks are through does the driver
move the files of the attempts that counted to their places; whatever else is there, of failed or repeated attempts,
goes with the staging folder. A job that fails leaves nothing, and a file is there once or not at all.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "lodemill_files"
#: Files that the driver moves at a time.
MOVERS = 16


def _store(path: str):
    """pyarrow's file system for a path or URL, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """An attempt's folder and the names of the files it has written there."""

    folder: str
    names: list[str]


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str, replace: bool):
        self.path, self.replace, self.staging = path, replace, f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        store, staging = _store(self.staging)
        folder, made, names = f"{staging}/{uuid.uuid4().hex}", set(), []
        for filename, content in rows:
            name = posixpath.normpath(filename or "")
            if not filename or name.startswith(("/", "..")) or name == ".":
                raise ValueError(f"no file name below the folder: {filename!r}")
            parent = posixpath.dirname(f"{folder}/{name}")
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(bytes(content or b""))
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, staging = _store(self.staging)
        top = posixpath.dirname(staging)
        pairs = [(f"{m.folder}/{n}", n) for m in messages if m is not None for n in m.names]
        seen: set[str] = set()
        twice = next((n for _, n in pairs if n in seen or seen.add(n)), None)
        if twice is not None:
            self.abort(messages)
            raise ValueError(f"a file name is given twice: {twice}")
        if self.replace:
            for x in store.get_file_info(_selector(top)):
                if x.path.rstrip("/") != staging:
                    (store.delete_dir if x.type.name == "Directory" else store.delete_file)(x.path)
        for parent in {posixpath.dirname(f"{top}/{n}") for _, n in pairs}:
            store.create_dir(parent, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda p: store.move(p[0], f"{top}/{p[1]}"), pairs))
        if store.get_file_info(staging).type.name == "Directory":
            store.delete_dir(staging)

    def abort(self, messages: list[Written | None]) -> None:
        store, staging = _store(self.staging)
        if store.get_file_info(staging).type.name == "Directory":
            store.delete_dir(staging)


def _selector(folder: str):
    from pyarrow import fs

    return fs.FileSelector(folder, allow_not_found=True)


class FilesSource(DataSource):
    """Writes rows (filename string, content binary) as files below the option path."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "filename string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, path: str, filename: str | Column = "filename", content: str | Column = "content", replace: bool = False) -> None:
    """One file a row, below path: a name may hold folders; a null content is an empty file; a name that is given twice, is empty or
    leads out of the path stops the job, which then leaves nothing. replace: what was there before goes."""
    rows.sparkSession.dataSource.register(FilesSource)
    named = rows.select((F.col(filename) if isinstance(filename, str) else filename).alias("filename"), (F.col(content) if isinstance(content, str) else content).cast("binary").alias("content"))
    named.write.format(NAME).option("path", path).mode("overwrite" if replace else "append").save()


def export_files(records: DataFrame, path: str, name: str = "_name", ecosystem: str | None = None) -> None:
    """Documents (v) as one JSON file each, indented, keys sorted: name.json, in a folder an ecosystem if a column has it. Characters
    that make no file name become _; of several records of one name the further ones are name_1, name_2 by _path."""
    from lodemill.operators import audit

    safe = F.regexp_replace(F.coalesce(F.col(name), F.lit("unknown")), r"[^\w.+@-]", "_")
    folder = F.concat(F.coalesce(F.col(ecosystem), F.lit("unknown")), F.lit("/")) if ecosystem else F.lit("")
    named = audit.numbered_copies(records.select(F.concat(folder, safe).alias("_file"), "_path", F.to_json("v", {"pretty": "true"}).alias("content")), "_file", ["_path"])
    write_files(named, path, F.concat(F.col("file_name"), F.lit(".json")))
