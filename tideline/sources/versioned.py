"""Tables in versions: a manifest names what belongs to a version, so what a writer adds is seen at once or not at all.

Data go to fresh folders that nothing reads yet. A version exists once its manifest does: it is written
aside and renamed into place, which fails if another writer was first. Readers take the newest manifest; a
version that they have begun to read stays as it is until :func:`expire` removes it. The folder has to be on
a file system whose rename is atomic.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideline.session import cut
from tideline.sources.tables import upsert_latest

MANIFESTS = "_manifests"
#: Parts of a keyed table by hash of the key; an upsert rewrites those that it has rows for.
BUCKETS = 256
RETRIES = 8


class Conflict(RuntimeError):
    """Another writer has published the version first."""


@dataclass(frozen=True)
class Version:
    """One version of what is under ``path``: folders and schemas of its tables, and whatever its writer noted."""

    spark: SparkSession
    path: str
    number: int = -1
    parts: Mapping[str, str] = field(default_factory=dict)
    schemas: Mapping[str, str] = field(default_factory=dict)
    info: Mapping[str, object] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(self.schemas[name]))).parquet(self.folder(name))

    def folder(self, name: str) -> str:
        return f"{self.path}/{self.parts[name]}"


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    where, fs = _at(spark, f"{path}/{MANIFESTS}")
    if not fs.exists(where):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def read_version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The newest version, or the given one; an empty one with number -1 where nothing has been published."""
    if number is None:
        known = _numbers(spark, path)
        if not known:
            return Version(spark, path)
        number = known[-1]
    text = spark.read.text(f"{path}/{MANIFESTS}/{number:09d}.json", wholetext=True).first()["value"]
    found = json.loads(text)
    return Version(spark, path, number, found["parts"], found["schemas"], found["info"])


def _commit(spark: SparkSession, path: str, number: int, content: dict) -> None:
    jvm = spark.sparkContext._jvm
    aside, fs = _at(spark, f"{path}/{MANIFESTS}/.{uuid.uuid4().hex}")
    final, _ = _at(spark, f"{path}/{MANIFESTS}/{number:09d}.json")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(aside, final, never)
    except Py4JJavaError as error:
        fs.delete(aside, False)
        if "FileAlreadyExists" in str(error.java_exception):
            raise Conflict(f"version {number} of {path} is there already") from error
        raise


def publish(
    spark: SparkSession, path: str, tables: Mapping[str, DataFrame], info: Mapping[str, object] | None = None,
    check: Callable[[str], Mapping[str, object]] | None = None, base: int | None = None,
) -> Version:
    """Publish these tables as one new version after ``base`` (the newest by default).

    ``check`` gets the new version's folder before it is visible; it may add files there, what it returns is
    noted in ``info``, and if it raises nothing is published. A writer that was overtaken gets :class:`Conflict`.
    """
    number = (read_version(spark, path).number if base is None else base) + 1
    folder = f"data/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{folder}/{name}")
    noted = {**(info or {}), **(check(f"{path}/{folder}") if check else {})}
    parts = {name: f"{folder}/{name}" for name in tables}
    schemas = {name: df.schema.json() for name, df in tables.items()}
    _commit(spark, path, number, {"parts": parts, "schemas": schemas, "info": noted})
    return Version(spark, path, number, parts, schemas, noted)


def _bucket(key: Sequence[str], buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _touched(placed: DataFrame) -> list[int]:
    return sorted(r["__bucket"] for r in placed.select("__bucket").distinct().collect())  # a number of buckets at most


def rows_beside(version: Version, wanted: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of a table that :func:`upsert` keeps, from the buckets that the keys in ``wanted`` fall into.

    These are all rows of those keys and some of others; no further bucket is read.
    """
    schema = StructType.fromJson(json.loads(version.schemas["rows"]))
    touched = _touched(wanted.select(_bucket(key, int(version.info["buckets"])).alias("__bucket")))
    there = [version.folder(f"{b:05d}") for b in touched if f"{b:05d}" in version.parts]
    return version.spark.read.schema(schema).parquet(*there) if there else version.spark.createDataFrame([], schema)


def upsert(
    spark: SparkSession, path: str, updates: DataFrame, key: Sequence[str], order: Sequence[str], buckets: int = BUCKETS,
    info: Mapping[str, object] | None = None,
) -> Version:
    """Insert or overwrite rows of a keyed table: per key the row with the greatest ``order`` stays.

    The table lies in buckets by hash of the key. Only buckets that the updates touch are read and written
    anew; the new version names the old files for all others. A writer that was overtaken tries again on
    the newer version. ``order`` should end with a column that breaks ties. The number of buckets is that of the first version.
    ``info`` is noted in the new version.
    """
    fixed = cut(updates)
    for _ in range(RETRIES):
        before = read_version(spark, path)
        many = int(before.info.get("buckets", buckets))
        placed = fixed.withColumn("__bucket", _bucket(key, many))
        touched = _touched(placed)
        if not touched and before.number >= 0:
            return before
        folder = f"data/{uuid.uuid4().hex}"
        old = [before.folder(f"{b:05d}") for b in touched if f"{b:05d}" in before.parts]
        state = spark.read.schema(fixed.schema).parquet(*old) if old else fixed.limit(0)
        rows = upsert_latest(state, fixed, key, order).withColumn("__bucket", _bucket(key, many))
        rows.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{path}/{folder}")
        parts = {**before.parts, **{f"{b:05d}": f"{folder}/__bucket={b}" for b in touched}}
        try:
            content = {"parts": parts, "schemas": {"rows": fixed.schema.json()}, "info": {**(info or {}), "buckets": many, "key": list(key), "rewritten": len(touched)}}
            _commit(spark, path, before.number + 1, content)
        except Conflict:
            continue
        return read_version(spark, path, before.number + 1)
    raise Conflict(f"{path}: overtaken {RETRIES} times")


def keyed_table(version: Version) -> DataFrame:
    """All rows of a table that :func:`upsert` keeps."""
    schema = StructType.fromJson(json.loads(version.schemas["rows"]))
    if not version.parts:
        return version.spark.createDataFrame([], schema)
    return version.spark.read.schema(schema).parquet(*[version.folder(name) for name in sorted(version.parts)])


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove versions but the newest ``keep``, and folders that no remaining version names; returns how many went.

    Not to be run beside a writer: data that it has not published yet would go as well.
    """
    numbers = _numbers(spark, path)
    kept = [read_version(spark, path, n) for n in numbers[-keep:]]
    named = {p for v in kept for p in v.parts.values()} | {p.rsplit("/", 1)[0] for v in kept for p in v.parts.values()}
    for n in numbers[:-keep]:
        where, fs = _at(spark, f"{path}/{MANIFESTS}/{n:09d}.json")
        fs.delete(where, False)
    where, fs = _at(spark, f"{path}/data")
    gone = 0
    for folder in fs.listStatus(where) if fs.exists(where) else []:
        name = f"data/{folder.getPath().getName()}"
        inner = [] if name not in named else [f for f in fs.listStatus(folder.getPath()) if "=" in f.getPath().getName()]
        for stale in [folder] if name not in named else [f for f in inner if f"{name}/{f.getPath().getName()}" not in named]:
            fs.delete(stale.getPath(), True)
            gone += 1
    return gone
