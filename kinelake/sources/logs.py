"""The two datasets' raw logs as Spark data sources, read and written.

    register(spark)
    spark.read.format("pamap2").load(folder)
    read_logs(spark, "mhealth", folder)
    write_logs(rows, "pamap2", folder)

Rows and columns are those of ``raw.read_pamap2`` and ``raw.read_mhealth``; ``ord`` is the
line's first byte, which orders a file. A file is read in byte ranges, each by its own
task; a line belongs to the range that its first byte is in. ``subjects`` chooses files before
any is opened. (Conditions are not pushed down: Spark 4.1 keeps what one plan has pushed for
later plans of the same table that have no condition, which then lack rows.)

The second dataset's lines have no time: it is their number in the file. ``read_logs`` counts
the lines of all ranges in a first pass and hands each range the number of lines before
it, one number a range; without that the source takes a file as one range, which knows
its own numbers. Options: ``splitBytes`` (64 MB), ``leastSplits`` of a file (1), ``inG``, ``subjects``.

Writing: each task writes the files (or parts, ``subject1-part00002.dat``) of its subjects under names of its own, and tells what
it wrote in its commit message; once all tasks have committed, the files get their names
and the messages become the manifest. A task that fails leaves no file and no manifest.

Files are opened through Arrow's file systems: local or mounted folders, S3, GCS and HDFS.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.samples import AXES, STANDARD_GRAVITY
from ..session import ship
from . import raw

SPLIT_BYTES, READ_BYTES = 64 << 20, 4 << 20
MANIFEST = "_manifest.json"


@dataclass(frozen=True)
class Layout:
    """One dataset's files: their names, columns, and where the channels of a node begin."""

    name: str
    file: str
    width: int
    gap: str
    label: int
    accel: dict
    gyro: dict
    mag: dict
    clock: int | None
    rate_hz: float
    gyro_in_degrees: bool

    def part_of(self, file: str) -> tuple[str, int] | None:
        """(subject, part) of a file's name; a file that is not in parts is part 0."""
        found = re.fullmatch(re.escape(self.file).replace(r"\{\}", r"(subject\d+)(?:-part(\d+))?"), file.rsplit("/", 1)[-1])
        return (found.group(1), int(found.group(2) or 0)) if found else None

    def name_of(self, subject: str, part: int, parts: int) -> str:
        return self.file.format(subject if parts == 1 else f"{subject}-part{part:05d}")

    def columns(self) -> list[tuple[str, int, str]]:
        """(column, place in the line, kind) of every node's axes, in the order of ``raw``'s readers."""
        out = []
        for node in raw.NODES:
            for i, a in enumerate(AXES):
                for kind, begins in (("acc", self.accel), ("gyr", self.gyro), ("mag", self.mag)):
                    if begins[node] is not None:
                        out.append((f"{node}_{kind}_{a}", begins[node] + i, kind))
        return out

    def schema(self) -> str:
        own = ["heart_rate double"] if self.clock is not None else ["ecg_lead1 double", "ecg_lead2 double"]
        return ", ".join(["t double", "ord long", "activity int", *own, *[f"{c} double" for c, _, _ in self.columns()], "subject string", "dataset string"])


def _blocks(start: int) -> dict:
    return {node: at + start for node, at in raw.PAMAP2_BLOCK.items()}


LAYOUTS = {
    "pamap2": Layout("pamap2", "{}.dat", raw.PAMAP2_COLUMNS, " ", 1, _blocks(raw.PAMAP2_ACCEL), _blocks(raw.PAMAP2_GYRO), _blocks(raw.PAMAP2_MAG), 0, raw.PAMAP2_RATE_HZ, False),
    "mhealth": Layout("mhealth", "mHealth_{}.log", raw.MHEALTH_COLUMNS, "\t", raw.MHEALTH_LABEL, raw.MHEALTH_ACCEL, raw.MHEALTH_GYRO, raw.MHEALTH_MAG, None, raw.MHEALTH_RATE_HZ, True),
}


@dataclass
class Range(InputPartition):
    """The lines of ``file`` that begin in [start, end); ``first_row`` lines are before them."""

    file: str
    subject: str
    start: int
    end: int
    first_row: int = 0
    base: int = 0  # bytes of the subject's parts before this one


def _open_store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def lines_of(stream, start: int, end: int) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first byte, lines) of the lines that begin in [start, end), some at a time."""
    at = start
    held = b""
    if start:
        # The line that the byte before the range belongs to is the range before's.
        stream.seek(start - 1)
        at, held = start - 1, stream.read(READ_BYTES)
        while held and b"\n" not in held:
            at += len(held)
            held = stream.read(READ_BYTES)
        cut = held.find(b"\n") + 1
        at, held = at + cut, held[cut:]
    else:
        stream.seek(0)
    last = False
    while not last and at < end:
        more = stream.read(READ_BYTES)
        last = not more
        held += more
        stop = len(held) if last else held.rfind(b"\n") + 1
        if not stop:
            continue
        whole, held = held[:stop], held[stop:]
        if at + stop > end:
            # The range's last line begins before ``end`` and may reach beyond it.
            cut = whole.find(b"\n", max(0, end - at - 1)) + 1 or stop
            whole, last = whole[:cut], True
        if whole:
            yield at, whole.splitlines(keepends=True)
        at += stop


def parsed(layout: Layout, lines: list[bytes], where: str) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, which lines have any); refuses lines of another width."""
    cells = [line.split() for line in lines]
    there = np.array([bool(c) for c in cells], bool)
    odd = next((len(c) for c in cells if c and len(c) != layout.width), None)
    if odd is not None:
        raise raw.SourceError(f"{where}: a line has {odd} columns, not {layout.width}")
    flat = [x for c in cells for x in c]
    return np.array(flat, "S").astype(np.float64).reshape(-1, layout.width), there


class LogReader(DataSourceReader):
    def __init__(self, layout: Layout, options: dict[str, str]):
        self.layout, self.options = layout, options
        self.wanted = set(options["subjects"].split(",")) if "subjects" in options else None
        self.in_g = options.get("inG", "true").lower() != "false"
        self.counting = options.get("countLines", "false").lower() == "true"

    def files(self) -> list[tuple[str, str, int]]:
        """(path in its store, subject, bytes), by subject and part."""
        from pyarrow import fs

        store, folder = _open_store(self.options["path"])
        found = [(x.path, self.layout.part_of(x.path), x.size) for x in store.get_file_info(fs.FileSelector(folder)) if x.is_file]
        found = sorted((x for x in found if x[1] and (self.wanted is None or x[1][0] in self.wanted)), key=lambda x: (len(x[1][0]), x[1]))
        return [(path, part[0], size) for path, part, size in found]

    def partitions(self) -> Sequence[InputPartition]:
        before = json.loads(self.options.get("rowsBefore", "{}"))
        most, least = int(self.options.get("splitBytes", SPLIT_BYTES)), int(self.options.get("leastSplits", 1))
        out, files = [], self.files()
        whole = Counter()
        for _, subject, size in files:
            whole[subject] += size
        base = Counter()
        for file, subject, size in files:
            step = max(1, min(most, -(-whole[subject] // least)))
            if self.layout.clock is None and not self.counting and subject not in before:
                if size < whole[subject]:
                    raise raw.SourceError(f"{subject} is in parts, whose lines are numbered by read_logs")
                step = max(1, size)
            rows, at = before.get(subject, {}), base[subject]
            out += [Range(file, subject, a, min(a + step, size), int(rows.get(str(at + a), 0)), at) for a in range(0, size, step)]
            base[subject] += size
        return out or [Range("", "", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, _ = _open_store(self.options["path"])
        with store.open_input_file(partition.file) as stream:
            if self.counting:
                n = sum(len(lines) for _, lines in lines_of(stream, partition.start, partition.end))
                yield pa.RecordBatch.from_arrays([pa.array([partition.subject]), pa.array([partition.base + partition.start], pa.int64()), pa.array([n], pa.int64())], ["subject", "start", "n"])
                return
            row = partition.first_row
            for at, lines in lines_of(stream, partition.start, partition.end):
                yield self.batch(partition, at, row, lines)
                row += len(lines)

    def batch(self, partition: Range, at: int, row: int, lines: list[bytes]) -> pa.RecordBatch:
        layout = self.layout
        cells, there = parsed(layout, lines, partition.file)
        size = np.array([len(line) for line in lines], np.int64)
        begins = (partition.base + at + np.cumsum(size) - size)[there]
        clock = cells[:, layout.clock] if layout.clock is not None else (row + np.flatnonzero(there)) / layout.rate_hz
        columns: list[pa.Array] = [pa.array(clock), pa.array(begins), pa.array(cells[:, layout.label].astype(np.int32))]
        if layout.clock is not None:
            heart = cells[:, 2]
            columns.append(pa.array(heart, mask=np.isnan(heart)))
        else:
            columns += [pa.array(cells[:, i]) for i in raw.MHEALTH_ECG]
        for _, place, kind in layout.columns():
            value = cells[:, place]
            if kind == "acc" and self.in_g:
                value = value / STANDARD_GRAVITY
            elif kind == "gyr" and not layout.gyro_in_degrees:
                value = np.degrees(value)
            columns.append(pa.array(value))
        columns += [pa.array([name] * len(begins), pa.string()) for name in (partition.subject, layout.name)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in layout.schema().split(", ")])


@dataclass
class Written(WriterCommitMessage):
    """(subject, own name, rows, bytes) of each file of a task."""

    files: list[tuple[str, str, int, int]]


class LogWriter(DataSourceArrowWriter):
    """Rows of (subject, cells array<double>), each subject in one task and in order; with the option ``parts``: in successive tasks, a part each."""

    def __init__(self, layout: Layout, options: dict[str, str]):
        self.layout, self.path = layout, options["path"]
        self.in_parts = options.get("parts", "false").lower() == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = _open_store(self.path)
        store.create_dir(folder, recursive=True)
        files: list[tuple[str, str, int, int]] = []
        subject = stream = None
        try:
            for batch in iterator:
                for own, cells in zip(batch.column("subject").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                    if len(cells) != self.layout.width:
                        raise raw.SourceError(f"{own}: a row has {len(cells)} cells, not {self.layout.width}")
                    if own != subject:
                        if stream is not None:
                            stream.close()
                        name = f"{folder}/.{own}-{uuid.uuid4().hex}"
                        stream, subject = store.open_output_stream(name), own
                        files.append((own, name, 0, 0))
                    line = (self.layout.gap.join("NaN" if x is None or x != x else repr(x) for x in cells) + "\n").encode()
                    stream.write(line)
                    files[-1] = (own, files[-1][1], files[-1][2] + 1, files[-1][3] + len(line))
            if stream is not None:
                stream.close()
        except BaseException:
            if stream is not None:
                stream.close()
            for _, name, _, _ in files:
                store.delete_file(name)
            raise
        return Written(files)

    def commit(self, messages) -> None:
        store, folder = _open_store(self.path)
        # Messages are in the order of tasks, and so are a subject's parts.
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f[0])
        parts = Counter(f[0] for f in files)
        twice = sorted(subject for subject, n in parts.items() if n > 1)
        if twice and not self.in_parts:
            self.abort(messages)
            raise raw.SourceError(f"rows of {twice[:5]} came from several tasks")
        manifest = []
        seen = Counter()
        for subject, name, rows, size in files:
            final = self.layout.name_of(subject, seen[subject], parts[subject])
            seen[subject] += 1
            store.move(name, f"{folder}/{final}")
            manifest.append({"subject": subject, "file": final, "rows": rows, "bytes": size})
        with store.open_output_stream(f"{folder}/.{MANIFEST}") as stream:
            stream.write(json.dumps({"dataset": self.layout.name, "files": manifest}).encode())
        store.move(f"{folder}/.{MANIFEST}", f"{folder}/{MANIFEST}")

    def abort(self, messages) -> None:
        store, _ = _open_store(self.path)
        for m in messages:
            for _, name, _, _ in m.files if m is not None else ():
                store.delete_file(name)


class Logs(DataSource):
    layout: Layout

    @classmethod
    def name(cls) -> str:
        return cls.layout.name

    def schema(self) -> str:
        return "subject string, start long, n long" if self.options.get("countLines", "false").lower() == "true" else self.layout.schema()

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.layout, self._options())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return LogWriter(self.layout, self._options())

    def _options(self) -> dict[str, str]:
        """Names of options without regard to case."""
        return {k: self.options[k] for k in ("path", "splitBytes", "leastSplits", "inG", "countLines", "rowsBefore", "subjects", "parts") if k in self.options}


class Pamap2Logs(Logs):
    layout = LAYOUTS["pamap2"]


class MhealthLogs(Logs):
    layout = LAYOUTS["mhealth"]


def register(spark: SparkSession) -> None:
    """Make the formats "pamap2" and "mhealth" known to the session."""
    ship(spark)
    for source in (Pamap2Logs, MhealthLogs):
        spark.dataSource.register(source)


def read_logs(spark: SparkSession, dataset: str, path: str, subjects: Sequence[str] | None = None, **options: object) -> DataFrame:
    """The dataset's wide rows (of some subjects); every file is split, whether or not its lines carry a time."""
    register(spark)
    asked = spark.read.format(dataset).options(**{k: str(v) for k, v in options.items()})
    if subjects is not None:
        asked = asked.option("subjects", ",".join(subjects))
    if LAYOUTS[dataset].clock is not None:
        return asked.load(path)
    counts: dict[str, list[tuple[int, int]]] = {}
    for r in asked.option("countLines", "true").load(path).collect():  # a number a range
        if r["subject"]:
            counts.setdefault(r["subject"], []).append((r["start"], r["n"]))
    before: dict[str, dict[str, int]] = {}
    for subject, ranges in counts.items():
        rows = 0
        for start, n in sorted(ranges):
            before.setdefault(subject, {})[str(start)] = rows
            rows += n
    return asked.option("countLines", "false").option("rowsBefore", json.dumps(before)).load(path)


def write_logs(rows: DataFrame, dataset: str, path: str, order: Sequence[str]) -> None:
    """Write ``rows`` (subject, cells and the columns of ``order``) as the dataset's log files and their manifest.

    Rows are dealt by ranges of subject and order: a subject that several ranges have becomes a file a range, in parts
    that the readers take as one file, so that no task has all of a subject.
    """
    register(rows.sparkSession)
    rows.repartitionByRange("subject", *order).sortWithinPartitions("subject", *order).select("subject", "cells").write.format(dataset).option("parts", "true").mode("append").save(path)


def manifest(path: str) -> dict | None:
    """What the last whole write has left in the folder; None where there is none."""
    from pyarrow import fs

    store, folder = _open_store(path)
    if store.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{folder}/{MANIFEST}") as stream:
        return json.loads(stream.read())
