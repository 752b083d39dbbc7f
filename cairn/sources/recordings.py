"""Recordings of I/Q samples as a source: files of any length, read by many tasks, each from a byte range of whole samples.

Registered as `iq_recording`; options: path (a file or a folder of files), format (u8_iq, s8_iq, s16_iq, cf32_iq), full_scale and
samples (the longest range that is read; a task has one, or of very many short ones several, of SAMPLES samples together). Rows: file, sample (from 0 in each file), i and q, as parts of the full scale. Files are opened by
pyarrow's file systems, so a path on HDFS needs libhdfs on the executors.

Results for odd input: an empty file gives no rows; a file that does not end with a whole sample is an error before anything is read;
files whose names begin with a dot or underscore are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Numbers, what the middle of the scale is, and the full scale of each format.
FORMATS = {"u8_iq": ("<u1", 127.5, 127.5), "s8_iq": ("<i1", 0.0, 128.0), "s16_iq": ("<i2", 0.0, 32768.0), "cf32_iq": ("<f4", 0.0, 1.0)}
SAMPLES = 1 << 20
#: Fixed value: up to so many ranges each has a task of its own.
TASKS = 256
_BATCH = 1 << 16


@dataclass
class Ranges(InputPartition):
    """Runs of samples: file, first, count and the longest range in which the run is read."""

    runs: list[tuple[str, int, int]]
    most: int


def dealt(runs: list[tuple[str, int, int]], most: int) -> list[Ranges]:
    """Runs cut into ranges of at most `most` samples, a task for each; where these are very many, several go to a task."""
    number = sum(-(-n // most) for _, _, n in runs)
    # a whole number of ranges for each task, so that files are cut between ranges only
    each = 1 if number <= TASKS else max(1, min(-(-number // TASKS), SAMPLES // most))
    out, now, free = [], [], each
    for file, first, left in runs:
        while left:
            n = min(left, free * most)
            now.append((file, first, n))
            first, left, free = first + n, left - n, free - -(-n // most)
            if not free:
                out.append(Ranges(now, most))
                now, free = [], each
    return [*out, Ranges(now, most)] if now else out


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.format = options["path"], options.get("format", "u8_iq")
        if self.format not in FORMATS:
            raise ValueError(f"unknown format {self.format!r}; one of {sorted(FORMATS)}")
        self.kind, self.middle, scale = FORMATS[self.format]
        self.scale, self.most = float(options.get("full_scale") or scale), int(options.get("samples") or SAMPLES)
        self.width = 2 * np.dtype(self.kind).itemsize

    def partitions(self) -> list[Ranges]:
        system, at = _opened(self.path)
        one = system.get_file_info(at)
        found = [one] if one.is_file else system.get_file_info(fs.FileSelector(at))
        runs = []
        for f in sorted((f for f in found if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            if f.size % self.width:
                raise ValueError(f"{f.base_name}: I and Q must pair, {f.size} bytes are no whole number of samples of {self.width}")
            runs.append((f.path, 0, f.size // self.width))
        return dealt(runs, self.most)

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        for file, first, count in part.runs:
            yield from self._run(system, file, first, count, min(_BATCH, part.most))

    def _run(self, system: fs.FileSystem, file: str, first: int, count: int, most: int) -> Iterator[pa.RecordBatch]:
        name = file.rsplit("/", 1)[-1]
        with system.open_input_file(file) as source:
            for a in range(first, first + count, most):
                n = min(most, first + count - a)
                source.seek(a * self.width)
                v = ((np.frombuffer(source.read(n * self.width), self.kind).astype(np.float32) - np.float32(self.middle)) / np.float32(self.scale)).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(a, a + n)), pa.array(v[:, 0].copy()), pa.array(v[:, 1].copy())], names=["file", "sample", "i", "q"])


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "iq_recording"

    def schema(self) -> str:
        return "file string, sample long, i float, q float"

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Recordings)
