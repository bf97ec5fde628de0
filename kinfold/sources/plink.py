"""Data sources for files of rows of fixed width: a .bed reader that is split by byte ranges, and a writer in place.

The reader plans from the file's size alone: each task gets whole rows of a few megabytes and reads just their bytes, of
files of any size. Of places (markers) and persons asked for only the bytes of those rows are read.

The writer takes (at, data): bytes and where they stand. Every task writes its own ranges into one file beside the final
one, which takes its name once the ranges written add up to the whole. A task that runs again writes the same bytes again.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MAGIC = b"\x6c\x1b"
#: Bytes of one task's rows (four genotypes a byte), genotypes of one batch, and bytes written at once.
TASK_BYTES, BATCH, HELD = 1 << 20, 200_000, 1 << 20
Runs = list[tuple[int, int]]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def decode(data: bytes, width: int) -> np.ndarray:
    """Dosages [rows, width], -9 missing, of whole rows of two-bit codes."""
    step = (width + 3) // 4
    raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, step)
    codes = (raw[:, :, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3
    return np.array([0, -9, 1, 2], dtype=np.int32)[codes.reshape(len(raw), step * 4)[:, :width]]


def within(runs: Runs, lo: int, hi: int) -> Runs:
    """The parts of runs of numbers [a, b) that lie in [lo, hi)."""
    return [(max(a, lo), min(b, hi)) for a, b in runs if max(a, lo) < min(b, hi)]


def runs_of(numbers: list[int]) -> Runs:
    out: Runs = []
    for n in sorted(set(numbers)):
        if out and out[-1][1] == n:
            out[-1] = (out[-1][0], n + 1)
        else:
            out.append((n, n + 1))
    return out


def merged_runs(runs: Runs) -> Runs:
    out: Runs = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


@dataclass
class Rows(InputPartition):
    """Rows [lo, hi) of the file, the places in them that are wanted, and how the file is laid out."""

    lo: int
    hi: int
    across: Runs
    width: int
    by_marker: bool


class BedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.people, self.markers = options["path"], int(options["people"]), int(options["markers"])
        self.task_rows = int(options["task_rows"]) if "task_rows" in options else None
        wanted = lambda name, n: [(0, n)] if name not in options else within([tuple(r) for r in json.loads(options[name])], 0, n)
        self.places, self.persons = wanted("places", self.markers), wanted("persons", self.people)

    def partitions(self) -> list[Rows]:
        files, path = opened(self.path)
        with files.open_input_file(path) as f:
            head, size = f.read(3), f.size()
        if head[:2] != MAGIC:
            raise ValueError("no .bed file")
        by_marker = head[2] == 1
        rows, width = (self.markers, self.people) if by_marker else (self.people, self.markers)
        step = (width + 3) // 4
        if size != 3 + rows * step:
            raise ValueError(f"{self.path} has {size} bytes, not the {3 + rows * step} of {rows} rows")
        along, across = (self.places, self.persons) if by_marker else (self.persons, self.places)
        n = self.task_rows or max(1, TASK_BYTES // max(1, step))
        return [Rows(at, min(hi, at + n), across, width, by_marker) for lo, hi in along for at in range(lo, hi, n)] if across else []

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        files, path = opened(self.path)
        width, bytes_ = partition.width, (partition.width + 3) // 4
        step = max(1, BATCH // max(1, width))
        with files.open_input_file(path) as f:
            for lo in range(partition.lo, partition.hi, step):
                n = min(partition.hi - lo, step)
                dosages = decode(f.read_at(n * bytes_, 3 + lo * bytes_), width)
                for a, b in partition.across:
                    for c in range(a, b, BATCH):
                        part = dosages[:, c : min(b, c + BATCH)]
                        row, col = np.indices(part.shape, dtype=np.int32)
                        place, person = (row.ravel() + lo, col.ravel() + c) if partition.by_marker else (col.ravel() + c, row.ravel() + lo)
                        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (person, place, part.ravel())], names=["person", "place", "dosage"])


class BedSource(DataSource):
    """person, place, dosage of a .bed file. Options: path, people, markers (their numbers), places and persons (runs [lo, hi) of those
    wanted, in JSON), task_rows. Rows are picked by these options: pushed filters would stay with the DataFrame, as Spark plans
    a source once, and narrow its other uses."""

    @classmethod
    def name(cls) -> str:
        return "kinfold_bed"

    def schema(self) -> str:
        return "person int, place int, dosage int"

    def reader(self, schema) -> BedReader:  # noqa: ARG002
        return BedReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    n: int


class ByteWriter(DataSourceArrowWriter):
    """Bytes in place, in a folder that all machines mount under one path."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        self.part = f"{path}.{uuid.uuid4().hex}.part"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        n, file = 0, os.open(self.part, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            held, size, start, end = [], 0, 0, -1
            for batch in iterator:
                for at, data in zip(batch.column("at").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    if at != end or size > HELD:  # neighbours are written at once
                        self.put(file, held, start)
                        held, size, start, end = [], 0, at, at
                    held.append(data)
                    size += len(data)
                    end += len(data)
                    n += len(data)
            self.put(file, held, start)
            os.fsync(file)
        finally:
            os.close(file)
        return Written(n)

    def put(self, file: int, held: list[bytes], at: int) -> None:
        data = memoryview(b"".join(held))
        while data:
            n = os.pwrite(file, data, at)
            data, at = data[n:], at + n

    def commit(self, messages: list[Written]) -> None:
        n = sum(m.n for m in messages if m is not None)
        if self.size == 0 and not os.path.exists(self.part):
            open(self.part, "wb").close()
        if n != self.size or os.path.getsize(self.part) != self.size:
            os.remove(self.part)
            raise ValueError(f"{n} bytes were written, of {self.size}")
        os.replace(self.part, self.path)

    def abort(self, messages: list[Written]) -> None:  # noqa: ARG002
        if os.path.exists(self.part):
            os.remove(self.part)


class ByteSource(DataSource):
    """Writes rows of (at, data) into one file of `size` bytes at `path`."""

    @classmethod
    def name(cls) -> str:
        return "kinfold_bytes"

    def schema(self) -> str:
        return "at long, data binary"

    def writer(self, schema, overwrite: bool) -> ByteWriter:  # noqa: ARG002
        return ByteWriter(dict(self.options)["path"], int(dict(self.options)["size"]))


def bed_rows(spark: SparkSession, path: str, people: int, markers: int, places: Runs | None = None, persons: Runs | None = None, task_rows: int | None = None) -> DataFrame:
    """person, place, dosage of a .bed file, of the runs [lo, hi) of places and persons alone, if given."""
    spark.dataSource.register(BedSource)
    options = {"path": path, "people": people, "markers": markers}
    options |= {k: json.dumps(v) for k, v in (("places", places), ("persons", persons)) if v is not None} | ({} if task_rows is None else {"task_rows": task_rows})
    return spark.read.format("kinfold_bed").options(**options).load()


def write_bytes(rows: DataFrame, path: str, size: int) -> None:
    """rows: (at, data), which cover all bytes of the file once."""
    path = path.removeprefix("file://").removeprefix("file:")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    rows.sparkSession.dataSource.register(ByteSource)
    rows.select("at", "data").write.format("kinfold_bytes").option("path", path).option("size", size).mode("append").save()
