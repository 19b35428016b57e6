"""Documents as files of their own with a manifest, written together or not at all.

    write_documents(rows, folder, levels=("dataset", "subject", "activity"))

Each task writes its rows' files into a staging folder of the job and says in its commit message
which it wrote, and under which levels. Once all tasks have committed, the files move to
their places, and the messages, as a tree, become the manifest, which is written last and
moved to its name. A job that fails leaves neither a file nor a manifest; what an earlier
one left is replaced only then. Files are opened through Arrow's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import ship

FORMAT, MANIFEST = "documents", "_manifest.json"


def _open_store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def tree(listed: Sequence[Sequence[str]]) -> dict:
    """(level, level, ..., file) rows as nested mappings with sorted lists of files."""
    out: dict = {}
    for *levels, last, file in sorted(listed):
        at = out
        for level in levels:
            at = at.setdefault(level, {})
        at.setdefault(last, []).append(file)
    return out


@dataclass
class Listed(WriterCommitMessage):
    """(staged name, levels and file) of each document of a task."""

    documents: list[tuple[str, tuple[str, ...]]]


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str, levels: list[str]):
        self.path, self.levels, self.job = path, levels, uuid.uuid4().hex

    def _staging(self, folder: str) -> str:
        return f"{folder}/.staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = _open_store(self.path)
        store.create_dir(self._staging(folder), recursive=True)
        done = []
        for batch in iterator:
            for row in batch.to_pylist():
                name = f"{self._staging(folder)}/{uuid.uuid4().hex}"
                with store.open_output_stream(name) as stream:
                    stream.write(row["json"].encode())
                done.append((name, tuple(str(row[x]) for x in (*self.levels, "file"))))
        return Listed(done)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, folder = _open_store(self.path)
        documents = sorted((d for m in messages if m is not None for d in m.documents), key=lambda d: d[1])
        files = [place[-1] for _, place in documents]
        if len(files) != len(set(files)):
            self.abort(messages)
            raise ValueError("two documents have one file name")
        final = f"{folder}/{MANIFEST}"
        if store.get_file_info(final).type == fs.FileType.File:
            store.delete_file(final)
        for name, place in documents:
            store.move(name, f"{folder}/{place[-1]}")
        listing = f"{self._staging(folder)}/{MANIFEST}"
        store.create_dir(self._staging(folder), recursive=True)
        with store.open_output_stream(listing) as stream:
            stream.write(json.dumps(tree([place for _, place in documents])).encode())
        store.move(listing, final)
        store.delete_dir(self._staging(folder))

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, folder = _open_store(self.path)
        if store.get_file_info(self._staging(folder)).type == fs.FileType.Directory:
            store.delete_dir(self._staging(folder))


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return DocumentWriter(self.options["path"], [x for x in self.options.get("levels", "").split(",") if x])


def write_documents(rows: DataFrame, folder: str, levels: Sequence[str] = ("dataset", "subject", "activity")) -> None:
    """``rows``: the columns of ``levels``, ``file`` (a name) and ``json``, a document each."""
    ship(rows.sparkSession)
    rows.sparkSession.dataSource.register(Documents)
    rows.select(*levels, "file", "json").write.format(FORMAT).option("levels", ",".join(levels)).mode("append").save(folder)


def read_manifest(spark: SparkSession, folder: str) -> dict | None:
    """The tree of the last whole write; None where there is none."""
    from pyarrow import fs

    store, place = _open_store(folder)
    if store.get_file_info(f"{place}/{MANIFEST}").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{place}/{MANIFEST}") as stream:
        return json.loads(stream.read())
