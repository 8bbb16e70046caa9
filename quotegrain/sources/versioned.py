"""Tables in parts that change by whole versions.

Data lies in immutable folders, one for each write and part. A version is a small manifest that lists the folders of each
part; it appears under its number by one rename, which fails if that number is there. Readers stay with the version that
they opened; a write that fails leaves folders that no manifest lists. There is one writer at a time: of two that start
from the same version the second fails.

``replace`` swaps the parts that it is given for new ones: bars by month. ``upsert`` adds folders of the batch's rows only,
in buckets of their keys; the last write of a key wins when rows are read. Folders of a bucket are merged in levels, so
a row is written again once for each level, not for each batch.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

#: Folders of one level of a bucket that are merged into one of the next.
FAN = 8
#: The version that wrote a row, and the part columns that paths give.
_VERSION, _WRITE, _PART = "_version", "_write", "_part"


class Folder:
    """The few file operations of a driver that Spark's readers and writers don't have, on any file system it knows."""

    def __init__(self, spark: SparkSession, path: str):
        self._hadoop = spark._jvm.org.apache.hadoop
        self._rename = spark.sparkContext._gateway.new_array(self._hadoop.fs.Options.Rename, 0)
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self.at(path).getFileSystem(self._conf)
        self._context = self._hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)

    def at(self, path: str):
        return self._hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        if not self._fs.exists(self.at(path)):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self.at(path)))

    def write_once(self, path: str, text: str) -> None:
        """Fails if there is such a file; nobody sees a part of it."""
        made = f"{path}.{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self.at(made), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self._context.rename(self.at(made), self.at(path), self._rename)

    def delete(self, path: str) -> None:
        self._fs.delete(self.at(path), True)


@dataclass(frozen=True)
class Manifest:
    """``parts``: of each part its folders with their levels. ``batch``: the last one that ``upsert`` took in."""

    version: int = 0
    schema: str = ""
    batch: int = -1
    parts: dict[str, list[tuple[str, int]]] = field(default_factory=dict)

    @property
    def folders(self) -> set[str]:
        return {folder for held in self.parts.values() for folder, _ in held}


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, fan: int = FAN):
        self.spark, self.path, self.fan, self._files = spark, path.rstrip("/"), fan, Folder(spark, path)

    def versions(self) -> list[int]:
        return [int(name[:-5]) for name in self._files.names(f"{self.path}/manifests") if name.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest:
        """Of the newest version, if none is named; version 0 is empty."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return Manifest()
        text = self.spark.read.text(f"{self.path}/manifests/{version:012d}.json", wholetext=True).first()[0]
        held = json.loads(text)
        return Manifest(version, held["schema"], held["batch"], {part: [tuple(x) for x in folders] for part, folders in held["parts"].items()})

    def _commit(self, base: Manifest, schema: StructType, parts: dict, batch: int | None = None) -> Manifest:
        new = Manifest(base.version + 1, schema.json(), base.batch if batch is None else batch, {p: f for p, f in parts.items() if f})
        self._files.write_once(f"{self.path}/manifests/{new.version:012d}.json", json.dumps({"schema": new.schema, "batch": new.batch, "parts": new.parts}))
        return new

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Writes rows with a column _part as new folders; returns the folder of each part. Rows of a part meet, so that it has
        few files; large parts are split again by Spark."""
        write = uuid.uuid4().hex
        rows.hint("rebalance", _PART).write.partitionBy(_PART).parquet(f"{self.path}/data/{_WRITE}={write}")
        names = self._files.names(f"{self.path}/data/{_WRITE}={write}")
        return {n.split("=", 1)[1]: f"{_WRITE}={write}/{n}" for n in names if n.startswith(f"{_PART}=")}

    def _rows(self, schema: StructType, folders: set[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/data/{folder}" for folder in sorted(folders)]
        return self.spark.read.option("basePath", f"{self.path}/data").schema(schema).parquet(*paths).select(*schema.names)

    def read(self, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
        """All rows of a version, or those of some parts; only their folders are read."""
        held = self.manifest(version)
        wanted = held.parts if parts is None else {p: held.parts[p] for p in parts if p in held.parts}
        if not held.version:
            raise FileNotFoundError(f"{self.path} has no version")
        return self._rows(StructType.fromJson(json.loads(held.schema)), {folder for x in wanted.values() for folder, _ in x})

    def replace(self, rows: DataFrame, part: str, base: Manifest | None = None) -> Manifest:
        """The parts (values of the text column ``part``) that rows have become these rows; other parts stay."""
        base = base or self.manifest()
        made = self._write(rows.withColumn(_PART, F.col(part)))
        return self._commit(base, rows.schema, {**base.parts, **{p: [(folder, 0)] for p, folder in made.items()}})

    def upsert(self, batch: DataFrame, keys: list[str], number: int, buckets: int = 16) -> Manifest:
        """Takes in a numbered batch of rows with different keys; one with a number that was taken in already is none."""
        base = self.manifest()
        if number <= base.batch:
            batch.write.format("noop").mode("overwrite").save()  # a stream's state of this batch is stored as it is computed
            return base
        rows = batch.withColumns({_VERSION: F.lit(base.version + 1).cast("long"), _PART: bucket_of(keys, buckets)})
        made = self._write(rows)
        parts = {**base.parts, **{p: [*base.parts.get(p, []), (folder, 0)] for p, folder in made.items()}}
        schema = rows.drop(_PART).schema
        return self._commit(base, schema, self._merged(schema, parts, keys, buckets), number)

    def _merged(self, schema: StructType, parts: dict, keys: list[str], buckets: int) -> dict:
        """Parts whose folders of one level are fewer than ``fan``; only folders of full levels are read and written."""
        level = 0
        while any(lv >= level for held in parts.values() for _, lv in held):
            full = {p: [f for f, lv in held if lv == level] for p, held in parts.items()}
            full = {p: folders for p, folders in full.items() if len(folders) >= self.fan}
            if full:
                rows = newest_rows(self._rows(schema, {f for folders in full.values() for f in folders}), keys)
                made = self._write(rows.withColumn(_PART, bucket_of(keys, buckets)))
                parts = {**parts, **{p: [(made[p], level + 1), *(x for x in parts[p] if x[0] not in full[p])] for p in full}}
            level += 1
        return parts

    def current(self, keys: list[str], version: int | None = None) -> DataFrame:
        """The last write of each key."""
        return newest_rows(self.read(version), keys).drop(_VERSION)

    def expire(self, keep: int = 2) -> list[str]:
        """Deletes all but the newest versions, and folders that none of these lists; returns what went. For the writer,
        between writes: a reader of an older version loses its files."""
        versions = sorted(self.versions())
        if not versions:
            return []
        live = set().union(*(self.manifest(v).folders for v in versions[-keep:]))
        gone = [f"manifests/{v:012d}.json" for v in versions[:-keep]]
        for write in self._files.names(f"{self.path}/data"):
            held = [f"{write}/{part}" for part in self._files.names(f"{self.path}/data/{write}") if part.startswith(f"{_PART}=")]
            dead = [f for f in held if f not in live]
            gone += [f"data/{write}"] if len(dead) == len(held) else [f"data/{f}" for f in dead]
        for path in gone:
            self._files.delete(f"{self.path}/{path}")
        return gone


def bucket_of(keys: list[str], buckets: int) -> Column:
    """The part in which ``upsert`` puts a row."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")


def newest_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that are written with their version, each key's last."""
    by = Window.partitionBy(*keys).orderBy(F.desc(_VERSION))
    return rows.withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_k")
