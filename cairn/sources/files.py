"""One file for each row, and back.

A folder with very many files is slow to fill and to list, and its list goes through the driver. `spread` puts each file into one of
FOLDERS folders, by its name; `read_spread` lists and reads them in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a file name does not keep.
_UNSAFE = r"[^A-Za-z0-9._-]+"
#: How many folders files are spread over, how many tasks read them, and what they read at once.
FOLDERS, _TASKS, _FILES, _BYTES = 1024, 128, 512, 8 << 20


def write_each(docs: DataFrame, folder: str, name: str, content: str, spread: bool = False) -> DataFrame:
    """Write each row's content (text or bytes) as a file of that name, and return name, path, size and sha256 of each.

    Names become safe ones; rows of one name are one file, of the least content, so that a task that runs twice writes the
    same. A file appears whole, under its own name, when it is done. Rows without a name or content write nothing. folder:
    a URI that pyarrow's file systems can write, shared by all executors. The files are written when the result is.
    spread: into folders below it, for `read_spread`.
    """
    safe = F.regexp_replace(F.col(name), _UNSAFE, "_")
    one = docs.select(safe.alias("name"), F.col(content).cast("binary").alias("content")).where("name IS NOT NULL AND name NOT IN ('', '.', '..') AND content IS NOT NULL")
    one = one.groupBy("name").agg(F.min("content").alias("content"))
    place = F.concat(F.lpad((F.crc32("name") % FOLDERS).cast("string"), 4, "0"), F.lit("/"), "name") if spread else F.col("name")
    one = one.withColumn("place", place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, made = TaskContext.get().taskAttemptId(), set()
        for b in batches:
            for p, n, c in zip(b.column("place").to_pylist(), b.column("name").to_pylist(), b.column("content")):
                at = f"{root}/{p}"[: -len(n) - 1]
                if spread and at not in made:
                    store.create_dir(at, recursive=True)
                    made.add(at)
                attempt = f"{at}/.{n}.{task}"
                with store.open_output_stream(attempt) as out:
                    out.write(c.as_buffer())
                store.move(attempt, f"{at}/{n}")
            yield b

    written = one.mapInArrow(run, "name string, content binary, place string")
    return written.select("name", F.concat(F.lit(folder.rstrip("/") + "/"), "place").alias("path"), F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_each(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """name, path, size, modified and content of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def read_spread(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """The same of files that `write_each` has spread; the driver sees none of their names. What a task has not finished is left out."""
    base = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("name", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("content", pa.binary())])

        def rows(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found), schema)], schema=schema)

        for b in batches:
            for part in b.column("id").to_pylist():
                some, held = [], 0
                for f in store.get_file_info(fs.FileSelector(f"{root}/{part:04d}", allow_not_found=True)):
                    if not f.is_file or f.base_name.startswith(".") or not fnmatchcase(f.base_name, glob):
                        continue
                    with store.open_input_stream(f.path) as source:
                        content = source.read()
                    some.append((f.base_name, f"{base}/{part:04d}/{f.base_name}", len(content), f.mtime, content))
                    held += len(content)
                    if len(some) == _FILES or held >= _BYTES:
                        yield rows(some)
                        some, held = [], 0
                if some:
                    yield rows(some)

    return spark.range(0, FOLDERS, 1, _TASKS).mapInArrow(run, "name string, path string, size long, modified timestamp, content binary")
