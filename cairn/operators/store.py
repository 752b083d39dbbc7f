"""A table of results by the digest of what they were made from: each content is worked on once, over any number of runs.

The table is a folder that driver and executors share: parts (Parquet folders) and numbered manifests, each of which names the parts
that count. A run keeps the digests that no part has, computes them, writes a part and then a new manifest under the next number. A
manifest appears whole, by a rename that refuses an existing name, so a writer that is killed leaves the table as it was; of two
writers at once one finds its number taken, leaves out what the other has brought meanwhile, and tries again: the first wins. That needs a
file system whose renames are atomic (HDFS, a shared disk); on stores without, let one writer work at a time.

Results for odd input: rows without a digest are not worked on; rows of one digest are worked on once; results that repeat a digest
count once; a digest for which nothing is computed is tried again by the next run; an empty or missing folder is an empty table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Results:
    """schema: of the results, with a column `digest`."""

    spark: SparkSession
    folder: str
    schema: str

    def _path(self, *names: str) -> JavaObject:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder.rstrip("/"), *names]))

    def _system(self) -> JavaObject:
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> tuple[int, list[str]]:
        """The last manifest's number and its parts; 0 and none before the first."""
        system, at = self._system(), self._path("manifests")
        if not system.exists(at):
            return 0, []
        numbers = [int(n[:-5]) for f in system.listStatus(at) if (n := f.getPath().getName()).endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return 0, []
        stream = system.open(self._path("manifests", f"{max(numbers):012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return max(numbers), json.loads(text)["parts"]

    def _published(self, number: int, parts: list[str]) -> bool:
        """Write a manifest under a number; False if another one has it."""
        jvm = self.spark._jvm
        hidden = self._path("manifests", f".{uuid.uuid4().hex}")
        stream = self._system().create(hidden, True)
        try:
            stream.write(bytearray(json.dumps({"parts": parts}).encode()))
        finally:
            stream.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri() if hidden.toUri().getScheme() else self._system().getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(hidden, self._path("manifests", f"{number:012d}.json"), plain)
        except Py4JJavaError as error:
            self._system().delete(hidden, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def _parts(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._path("parts", n).toString() for n in names])

    def read(self) -> DataFrame:
        """All results; each digest once."""
        return self._parts(self.manifest()[1])

    def missing(self, rows: DataFrame, digest: str = "digest") -> DataFrame:
        """The rows, one for each digest, whose digest has no result yet."""
        new = rows.where(F.col(digest).isNotNull()).join(self.read().select(F.col("digest").alias(digest)), digest, "left_anti")
        return new.dropDuplicates([digest])

    def _written(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(self._path("parts", name).toString())
        return name

    def add(self, results: DataFrame) -> int:
        """Append results whose digests are new, and return how many; of equal digests one counts."""
        number, before = self.manifest()
        kept = results.where("digest IS NOT NULL").dropDuplicates(["digest"])
        kept = self._written(kept.join(self._parts(before).select("digest"), "digest", "left_anti").selectExpr(*self._columns()))
        while not self._published(number + 1, [*before, kept]):
            number, after = self.manifest()
            came = [p for p in after if p not in before]
            before = after
            if came:
                kept = self._written(self._parts([kept]).join(self._parts(came).select("digest"), "digest", "left_anti").selectExpr(*self._columns()))
        return self._parts([kept]).count()

    def _columns(self) -> list[str]:
        return [f"`{c}`" for c in self.spark.createDataFrame([], self.schema).columns]

    def run(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame], digest: str = "digest") -> int:
        """Compute what has no result yet and append it; the number of new results."""
        return self.add(compute(self.missing(rows, digest)))

    def compacted(self) -> None:
        """One part in place of all; what other writers append meanwhile stays a part of its own."""
        number, parts = self.manifest()
        if len(parts) < 2:
            return
        one = self._written(self._parts(parts))
        while not self._published(number + 1, [one, *[p for p in self.manifest()[1] if p not in parts]]):
            number, now = self.manifest()
            if not set(parts) <= set(now):
                return  # compacted by another
        return

    def orphans(self) -> list[str]:
        """Parts that the last manifest does not name: left by killed writers, replaced, or about to be published."""
        at = self._path("parts")
        listed = [f.getPath().getName() for f in self._system().listStatus(at)] if self._system().exists(at) else []
        return sorted(set(listed) - set(self.manifest()[1]))
