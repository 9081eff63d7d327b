"""Sinks: CSV tables, JSON reports, refreshed case files and the versioned memory store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

POINTER = StructType([StructField("version", LongType()), StructField("path", StringType())])


def write_csv_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder with header per table, quotes doubled within quotes (RFC 4180).

    Empty text is written as two quotes and null as nothing, so the two stay apart.
    """
    for name, df in tables.items():
        df.write.mode("errorifexists").options(header=True, escape='"', emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{folder}/{name}")


def write_json_report(df: DataFrame, path: str) -> None:
    """Report rows as JSON lines; text is written as it is, nulls included."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def refreshed_lines(lines: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Case lines (position, case_id, line) with the refreshed ones replaced, the others untouched."""
    new = refreshed.select("case_id", F.col("line").alias("_new"))
    return lines.join(new, "case_id", "left").select("position", "case_id", F.coalesce("_new", "line").alias("line"))


class MemoryStore:
    """A keyed table kept as numbered parquet snapshots in a shared folder.

    A new snapshot goes to a fresh path and is announced by a one-row pointer file
    only once it is complete, so readers never see a half-written version and a
    failed write leaves the last one in force.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _pointers(self) -> DataFrame | None:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/pointers")
        if not jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm_path):
            return None
        return self.spark.read.schema(POINTER).json(f"{self.folder}/pointers/*")

    def current(self) -> tuple[int, str | None]:
        pointers = self._pointers()
        row = pointers.orderBy(F.col("version").desc()).first() if pointers is not None else None
        return (row["version"], row["path"]) if row else (-1, None)

    def read(self) -> DataFrame | None:
        _, path = self.current()
        return self.spark.read.parquet(path) if path else None

    def write(self, df: DataFrame, version: int | None = None) -> int:
        """Write ``df`` as ``version``, the next one unless given, and return it.

        A version at or below the current one is another writer's, so it is an error, never a silent loss.
        """
        current = self.current()[0]
        version = current + 1 if version is None else version
        if version <= current:
            raise ValueError(f"version {version} of {self.folder} exists already; the current one is {current}")
        path = f"{self.folder}/data/v{version}"
        df.write.mode("overwrite").parquet(path)  # only leftovers of a failed attempt can be there
        pointer = self.spark.range(1).select(F.lit(version).cast("bigint").alias("version"), F.lit(path).alias("path"))
        pointer.coalesce(1).write.mode("overwrite").json(f"{self.folder}/pointers/v{version}")
        return version


def _path(spark: SparkSession, path: str):
    """The path and its file system, as Spark sees them."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    own, system = _path(spark, path)
    return [f.getPath().getName() for f in system.listStatus(own)] if system.exists(own) else []


def _drop(spark: SparkSession, path: str) -> None:
    own, system = _path(spark, path)
    system.delete(own, True)


class Ledger:
    """Numbered lists of rows in a folder; the last complete one is in force.

    A list is a few rows, written as one and only seen once it is complete. Of two writers of the same number the second fails.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def versions(self) -> list[int]:
        numbered = [int(n[1:]) for n in _names(self.spark, self.folder) if n.startswith("v") and n[1:].isdigit()]
        return sorted(v for v in numbered if "_SUCCESS" in _names(self.spark, f"{self.folder}/v{v}"))

    def next(self) -> int:
        """A number that no list, complete or not, has."""
        return 1 + max((int(n[1:]) for n in _names(self.spark, self.folder) if n.startswith("v") and n[1:].isdigit()), default=-1)

    def rows(self, version: int) -> list:
        return self.spark.read.schema(self.schema).json(f"{self.folder}/v{version}").collect()

    def last(self) -> tuple[int, list]:
        found = self.versions()
        return (found[-1], self.rows(found[-1])) if found else (-1, [])

    def write(self, version: int, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("errorifexists").json(f"{self.folder}/v{version}")


class BucketStore:
    """A keyed table in hash buckets of the key. A merge rewrites the buckets that the batch touches and no others.

    A ledger says which file folder is in force for each bucket, so readers see a merge whole or not at all, and a failed one changes nothing.
    The last ``keep`` versions can be read; what no one of them names is removed.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = 64, keep: int = 2):
        self.spark, self.folder, self.key, self.buckets, self.keep = spark, folder.rstrip("/"), key, buckets, keep
        self.ledger = Ledger(spark, f"{self.folder}/ledger", "bucket int, path string")

    def read(self, version: int | None = None) -> DataFrame | None:
        rows = self.ledger.last()[1] if version is None else self.ledger.rows(version)
        return self.spark.read.parquet(*sorted(r["path"] for r in rows)) if rows else None

    def merge(self, batch: DataFrame, fold) -> int:
        """Fold ``batch`` into the store; ``fold`` makes one row per key of any mix of batch and stored rows. Returns the new version."""
        held = {r["bucket"]: r["path"] for r in self.ledger.last()[1]}
        version = self.ledger.next()
        own = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        staged = f"{self.folder}/staged/v{version}"
        batch.write.mode("overwrite").parquet(staged)
        batch = self.spark.read.parquet(staged)
        touched = [r[0] for r in batch.select(own).distinct().collect()]  # at most one row per bucket
        old = [held[b] for b in touched if b in held]
        both = batch.unionByName(self.spark.read.parquet(*old), allowMissingColumns=True) if old else batch
        data = f"{self.folder}/data/v{version}"
        fold(both).withColumn("store_bucket", own).write.mode("overwrite").partitionBy("store_bucket").parquet(data)
        held |= {b: f"{data}/store_bucket={b}" for b in touched}
        self.ledger.write(version, sorted(held.items()))
        _drop(self.spark, staged)
        self.expire()
        return version

    def expire(self) -> None:
        versions = self.ledger.versions()
        needed = {r["path"] for v in versions[-self.keep:] for r in self.ledger.rows(v)}
        for v in versions[:-self.keep]:
            for row in self.ledger.rows(v):
                if row["path"] not in needed:
                    _drop(self.spark, row["path"])
            _drop(self.spark, f"{self.ledger.folder}/v{v}")


class BatchLog:
    """Rows of micro-batches in a shared folder, one part for each (stream, batch), folded into larger parts as they pile up.

    A batch that is run again replaces its own part, and a stream with another checkpoint has other parts, so no
    batch is lost or kept twice. ``compact`` folds parts of batches that can no longer run again, ``fan`` parts of a level into one of the
    next, so a reader meets a few parts a level however many batches there were. A ledger names the parts in force and, for
    each stream, the last batch they hold.
    """

    def __init__(self, spark: SparkSession, folder: str, fan: int = 8):
        self.spark, self.folder, self.fan = spark, folder.rstrip("/"), fan
        self.ledger = Ledger(spark, f"{self.folder}/ledger", "kind string, name string, number long")

    def _state(self) -> tuple[dict[str, int], dict[str, int], list[str]]:
        """Level of each part, last batch held of each stream, and what was replaced last time."""
        rows = self.ledger.last()[1]
        pick = lambda kind: {r["name"]: r["number"] for r in rows if r["kind"] == kind}
        return pick("part"), pick("stream"), sorted(pick("gone"))

    def _raw(self, held: dict[str, int]) -> dict[tuple[str, int], str]:
        """Paths of the batches that no part holds yet."""
        found = {}
        for stream in _names(self.spark, f"{self.folder}/raw"):
            for batch in _names(self.spark, f"{self.folder}/raw/{stream}"):
                own, path = (stream.partition("=")[2], int(batch.partition("=")[2])), f"{self.folder}/raw/{stream}/{batch}"
                if own[1] > held.get(own[0], -1) and "_SUCCESS" in _names(self.spark, path):
                    found[own] = path
        return found

    def write(self, df: DataFrame, stream: str, batch: int) -> None:
        if batch > self._state()[1].get(stream, -1):  # else a part holds it already
            df.write.mode("overwrite").parquet(f"{self.folder}/raw/stream_id={stream}/batch_no={batch}")

    def parts(self) -> list[str]:
        """Paths that a reader has to read."""
        parts, held, _ = self._state()
        return sorted([*parts, *self._raw(held).values()])

    def read(self) -> DataFrame:
        return self.spark.read.parquet(*self.parts())

    def compact(self, fold) -> None:
        """Fold what has piled up; ``fold`` has to give the same whether rows are folded at once or part by part."""
        parts, held, gone = self._state()
        raw = self._raw(held)
        last = {}
        for stream, batch in raw:
            last[stream] = max(batch, last.get(stream, -1))
        ready = {own: path for own, path in raw.items() if own[1] < last[own[0]]}  # the last batch may run again
        replaced: list[str] = []

        def into(level: int, paths: list[str]) -> None:
            path = f"{self.folder}/parts/{uuid.uuid4().hex}"
            fold(self.spark.read.parquet(*paths)).write.parquet(path)
            parts[path] = level
            replaced.extend(paths)

        if len(ready) >= self.fan:
            into(1, sorted(ready.values()))
            for stream, batch in ready:
                held[stream] = max(batch, held.get(stream, -1))
        level = 1
        while len(own := sorted(p for p, at in parts.items() if at == level)) >= self.fan:
            for p in own:
                del parts[p]
            into(level + 1, own)
            level += 1
        if replaced:
            rows = [("part", p, at) for p, at in parts.items()] + [("stream", s, b) for s, b in held.items()] + [("gone", p, 0) for p in replaced]
            self.ledger.write(self.ledger.next(), rows)
            for path in gone:  # readers of the ledger before the last may still have read these
                _drop(self.spark, path)
