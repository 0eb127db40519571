"""Tables of immutable snapshots, swapped by one pointer.

A version is a folder of its own that nothing changes once it is written, and a pointer names it.
Pointers are numbered files, each put in place by one rename that fails if the number is taken, so a
reader finds the last one and the whole snapshot behind it, a writer that dies before its rename has
changed nothing, and of two writers one is told that it came too late. A pointer also has the number
of the batch that made it: a batch that is replayed after its pointer was written changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Versions that stay: readers of the one before the last may still be at work.
KEEP = 2


class Conflict(RuntimeError):
    """Another writer has put a version in place since the table was read."""


class Versioned:
    """A table at a path; step is called with a name between any two steps of a write, for tests that end there."""

    def __init__(self, spark: SparkSession, path: str, keep: int = KEEP, step=lambda name: None):
        self.spark, self.path, self.keep, self.step = spark, path.rstrip("/"), keep, step

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, part: str) -> list[str]:
        """Names in a folder of the table."""
        fs, at = self._fs(), self._path(part)
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in self._listed("versions") if n.isdigit())

    def _pointer(self, number: int) -> dict:
        stream = self._fs().open(self._path("versions", f"{number:020d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"version": number}
        finally:
            stream.close()

    def head(self) -> dict | None:
        """The last pointer: version, snapshot, schema, batch and note; None if there is no version."""
        numbers = self._numbers()
        return self._pointer(numbers[-1]) if numbers else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of the last version, or of one that stays; None if there is none."""
        at = self.head() if version is None else self._pointer(version) if version in self._numbers() else None
        if at is None:
            return None
        return self.spark.read.schema(StructType.fromJson(at["schema"])).parquet(f"{self.path}/snapshots/{at['snapshot']}")

    def replace(self, df: DataFrame, batch: int | None = None, note: str = "", after: int | None = None, by: list[str] | None = None) -> int:
        """Put df in place as a whole, in folders by the columns of by; the number of its version.

        With batch, a number that grows, nothing is done if that batch or a later one is in place. With after, the
        version that df was made from, a write that another has overtaken raises Conflict.
        """
        head = self.head()
        if batch is not None and head is not None and head["batch"] is not None and head["batch"] >= batch:
            return head["version"]
        last = head["version"] if head else 0
        if after is not None and after != last:
            raise Conflict(f"{self.path} is at version {last}, not {after}")
        self.step("begin")
        snapshot = uuid.uuid4().hex
        df.write.partitionBy(*(by or [])).parquet(f"{self.path}/snapshots/{snapshot}")
        self.step("written")
        kept = batch if batch is not None else head["batch"] if head else None
        text = json.dumps({"snapshot": snapshot, "schema": json.loads(df.schema.json()), "batch": kept, "note": note})
        fs, new = self._fs(), self._path("versions", f"_{snapshot}")
        stream = fs.create(new, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.step("pointed")
        self._rename(new, self._path("versions", f"{last + 1:020d}"))
        self.step("swapped")
        self.clean()
        self.step("cleaned")
        return last + 1

    def _rename(self, new, at) -> None:
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration()) if at.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(new, at, none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                self._fs().delete(new, False)
                raise Conflict(f"{self.path} has a version {at.getName()} already") from e
            raise

    def clean(self) -> None:
        """Delete pointers but the last `keep`, then what no pointer names: snapshots of old versions and of writers that died.

        Snapshots are looked up before pointers, so that one that is swapped in meanwhile is not among them, and
        one that a writer still fills is spared for as long as no version is younger.
        """
        fs, numbers = self._fs(), self._numbers()
        if not numbers:
            return
        at = {x.getPath().getName(): x.getModificationTime() for x in fs.listStatus(self._path("snapshots"))}
        for n in numbers[: -self.keep]:
            fs.delete(self._path("versions", f"{n:020d}"), False)
        stays = {self._pointer(n)["snapshot"] for n in self._numbers()}
        swapped = fs.getFileStatus(self._path("versions", f"{numbers[-1]:020d}")).getModificationTime()
        for name, modified in at.items():
            if name not in stays and modified < swapped:
                fs.delete(self._path("snapshots", name), True)
        for name in self._listed("versions"):
            if name.startswith("_") and name[1:] not in at:
                continue
            if name.startswith("_") and at[name[1:]] < swapped:
                fs.delete(self._path("versions", name), False)

    def drop(self) -> None:
        """Delete the table: pointers first, so that no pointer outlives its snapshot."""
        self._fs().delete(self._path("versions"), True)
        self._fs().delete(self._path(), True)
