"""Tables of files under numbered manifests: appends and replaced partitions that readers see whole or not at all.

A table is a folder. Every write goes to a folder of its own, `data/_write=<name>/<by>=<value>`, and counts only once a
manifest `_log/<number>.json` names it. A manifest lists the live (write, value) folders, one entry per write and partition
value, so its size follows the calendar or the number of shards and not the rows. The next manifest takes its number by a
rename that fails if the name exists; who loses the race starts again from the winner's manifest. A writer that dies before
the rename leaves files that nobody reads, and a reader keeps the snapshot it took until `expire` removes it.

Needs a file system whose rename does not overwrite (HDFS and its like, and local folders with one writer at a time).

Defined results: an empty write adds no entry but keeps the schema; a NULL partition value has a folder of its own that
every bounded read leaves out; columns must agree with the table's by name and type.
"""

import json
import re
import time
import uuid
from collections.abc import Callable
from typing import Any, NamedTuple
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WRITE = "_write"
_NOTHING = "__HIVE_DEFAULT_PARTITION__"
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class Conflict(RuntimeError):
    """Another writer has replaced what this one was about to replace."""


class Snapshot(NamedTuple):
    number: int
    by: str
    schema: dict  # of the written columns, `by` included
    entries: list[list[str]]  # [write, folder value]
    sources: dict[str, int]  # last batch taken from each source

    def fields(self) -> T.StructType:
        return T.StructType.fromJson(self.schema)

    def value(self, folder_value: str) -> Any:
        """A partition value as its column holds it."""
        if folder_value == _NOTHING:
            return None
        text = unquote(folder_value)
        return int(text) if isinstance(self.fields()[self.by].dataType, _WHOLE) else text


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    where, fs = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def numbers(spark: SparkSession, table: str) -> list[int]:
    """The snapshots that can still be read, oldest first."""
    return [int(n[:12]) for n in _names(spark, f"{table}/_log") if re.fullmatch(r"\d{12}\.json", n)]


def snapshot(spark: SparkSession, table: str, number: int | None = None) -> Snapshot | None:
    """The newest snapshot or the one named; None for a table that nobody has written."""
    if number is None:
        known = numbers(spark, table)
        if not known:
            return None
        number = known[-1]
    where, fs = _place(spark, f"{table}/_log/{number:012d}.json")
    stream = fs.open(where)
    try:
        return Snapshot(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def _renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Renames unless the target exists."""
    fs, jvm = spark._jvm.org.apache.hadoop.fs, spark._jvm
    start, end = fs.Path(source), fs.Path(target)
    rule = getattr(fs, "Options$Rename")
    rules = spark.sparkContext._gateway.new_array(rule, 1)
    rules[0] = rule.NONE
    try:
        qualified = end.getFileSystem(spark._jsc.hadoopConfiguration())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.getUri(), spark._jsc.hadoopConfiguration())
        context.rename(start, end, rules)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def _commit(spark: SparkSession, table: str, change: Callable[[Snapshot | None], Snapshot | None]) -> Snapshot:
    """Applies `change` to the newest snapshot until its result gets the next number. None leaves the table as it is."""
    while True:
        base = snapshot(spark, table)
        new = change(base)
        if new is None:
            return base
        draft = f"{table}/_log/.draft-{uuid.uuid4().hex}"
        where, fs = _place(spark, draft)
        out = fs.create(where, False)
        out.write(bytearray(json.dumps(new._asdict()).encode()))
        out.close()
        if _renamed(spark, draft, f"{table}/_log/{new.number:012d}.json"):
            return new
        fs.delete(where, False)


def _written(df: DataFrame, table: str, by: str, number: int) -> tuple[dict, list[list[str]]]:
    """Writes the rows to a new folder: their schema and the entries a manifest needs."""
    name = f"{number:012d}-{uuid.uuid4().hex[:12]}"
    path = f"{table}/data/{WRITE}={name}"
    df = df.drop(WRITE)
    df.write.partitionBy(by).parquet(path)
    fields = [T.StructField(f.name, f.dataType, True, f.metadata) for f in df.schema.fields]
    values = [n[len(by) + 1 :] for n in _names(df.sparkSession, path) if n.startswith(f"{by}=")]
    return T.StructType(fields).jsonValue(), [[name, v] for v in values]


def _agree(base: Snapshot | None, by: str, schema: dict) -> None:
    if base is None:
        return
    shape = lambda s: sorted((f["name"], json.dumps(f["type"], sort_keys=True)) for f in s["fields"])
    if base.by != by or shape(base.schema) != shape(schema):
        raise ValueError(f"columns differ from those of the table: {shape(schema)} by {by}, not {shape(base.schema)} by {base.by}")


def append(df: DataFrame, table: str, by: str, source: str | None = None, batch: int = 0) -> Snapshot:
    """Adds rows. With a `source`, its batches count once: one not newer than the last that was committed is left out."""
    spark = df.sparkSession
    base = snapshot(spark, table)
    done = lambda s: source is not None and s is not None and s.sources.get(source, -1) >= batch
    if done(base):
        return base
    schema, entries = _written(df, table, by, 1 + (base.number if base else 0))

    def change(now):
        if done(now):
            return None
        _agree(now, by, schema)
        seen = {**(now.sources if now else {}), **({source: batch} if source is not None else {})}
        return Snapshot(1 + (now.number if now else 0), by, now.schema if now else schema, [*(now.entries if now else []), *entries], seen)

    return _commit(spark, table, change)


def replace(df: DataFrame, table: str, base: Snapshot, values) -> Snapshot:
    """Puts `df` in the place of the partitions with these values, as `base` has them.

    Rows that others append to them meanwhile stay. If another writer has replaced one of them, `Conflict` is raised and
    nothing changes. `df` may be read from the table: files are never changed in place.
    """
    spark, wanted = df.sparkSession, set(values)
    schema, entries = _written(df, table, base.by, base.number + 1)
    if strange := {base.value(v) for _, v in entries} - wanted:
        raise ValueError(f"rows outside of the replaced partitions: {sorted(strange, key=str)}")
    old = {(w, v) for w, v in base.entries if base.value(v) in wanted}

    def change(now):
        _agree(now, base.by, schema)
        if not old <= {(w, v) for w, v in now.entries}:
            raise Conflict(f"{table}: partitions of snapshot {base.number} were replaced by snapshot {now.number} or before")
        return now._replace(number=now.number + 1, entries=[e for e in now.entries if tuple(e) not in old] + entries)

    return _commit(spark, table, change)


def read(spark: SparkSession, table: str, at: Snapshot | None = None, least=None, largest=None) -> DataFrame:
    """The rows of a snapshot (the newest), with the write they came by in `_write`.

    Bounds on the partition value leave out whole folders before a file is listed, and reach the scan as filters as well.
    """
    at = at or snapshot(spark, table)
    if at is None:
        raise FileNotFoundError(f"no snapshot in {table}")

    def inside(value) -> bool:
        if least is None and largest is None:
            return True
        return value is not None and (least is None or value >= least) and (largest is None or value <= largest)

    paths = [f"{table}/data/{WRITE}={w}/{at.by}={v}" for w, v in at.entries if inside(at.value(v))]
    schema = at.fields().add(WRITE, T.StringType())
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{table}/data").parquet(*paths)
    if least is not None:
        rows = rows.filter(F.col(at.by) >= F.lit(least))
    return rows if largest is None else rows.filter(F.col(at.by) <= F.lit(largest))


def expire(spark: SparkSession, table: str, keep: int = 10, hours: float = 24.0) -> int:
    """Deletes all but the newest `keep` manifests and the partition folders that none of these names.

    Folders changed in the last `hours` stay, as their writer may not have committed yet. Returns the folders deleted.
    """
    known = numbers(spark, table)
    for n in known[:-keep]:
        where, fs = _place(spark, f"{table}/_log/{n:012d}.json")
        fs.delete(where, False)
    live = [snapshot(spark, table, n) for n in known[-keep:]]
    named = {(w, f"{s.by}={v}") for s in live for w, v in s.entries}
    gone, limit = 0, (time.time() - hours * 3600) * 1000
    for write in _names(spark, f"{table}/data"):
        where, fs = _place(spark, f"{table}/data/{write}")
        parts = [s for s in fs.listStatus(where) if s.isDirectory()]
        dead = [s for s in parts if (write.split("=", 1)[1], s.getPath().getName()) not in named and s.getModificationTime() <= limit]
        for s in dead:
            fs.delete(s.getPath(), True)
        gone += len(dead)
        if len(dead) == len(parts) and fs.getFileStatus(where).getModificationTime() <= limit:
            fs.delete(where, True)
    return gone
