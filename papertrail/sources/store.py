"""Tables that grow by batches: a batch is seen whole or not at all, and a replayed one replaces itself.

``path/run=<first>-<last>.<attempt>/`` holds the rows of the batches ``first`` to ``last``; the empty file of the same name in
``path/_commits/`` is made last and makes the run visible.  What a write left behind that did not come that far is never
read.  Readers take, of each range, the latest attempt, and ignore ranges that lie within a larger one: so a merge of
earlier runs becomes visible at once by one file, and a replay of a batch that has been merged changes nothing.

Merging goes by powers of ``fan``: a table of n batches has at most about fan * log(n) runs, and each row is rewritten once
per power.  Only batches before the one being written are merged; a stream starts a batch when the one before is
committed, so no merge holds a batch that could still be replayed with other rows.  What is hidden is deleted some time
later (``keep_seconds``), so that readers with an older listing can end.

``by`` columns are partition folders: a filter on them opens the files of those folders only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BATCH, BUCKET = "_batch", "_bucket"
_NAME = re.compile(r"(-?\d+)-(-?\d+)\.(\d+)$")


def bucket(key: str, buckets: int) -> Column:
    """The bucket of a key: the same for the value's text, whatever its type."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


@dataclass(frozen=True, order=True)
class Run:
    first: int
    last: int
    attempt: int

    @property
    def name(self) -> str:
        return f"{self.first}-{self.last}.{self.attempt}"


def visible(runs: list[Run]) -> list[Run]:
    """Of each range the latest attempt, without ranges inside others, in order."""
    latest: dict[tuple[int, int], Run] = {}
    for run in sorted(runs):
        latest[run.first, run.last] = run
    out: list[Run] = []
    for run in sorted(latest.values(), key=lambda r: (r.first, -r.last)):
        if not out or run.last > out[-1].last:
            out.append(run)
    return out


class _Files:
    """The few calls on Spark's file system that commits need."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.at(path).getFileSystem(self.conf)

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> dict[str, int]:
        """Name -> time of change, in seconds; nothing where there is no folder."""
        if not self.fs.exists(self.at(path)):
            return {}
        return {s.getPath().getName(): s.getModificationTime() // 1000 for s in self.fs.listStatus(self.at(path))}

    def create(self, path: str) -> None:
        self.fs.create(self.at(path), False).close()

    def write(self, path: str, text: str) -> None:
        stream = self.fs.create(self.at(path), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def read(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)

    def now(self) -> int:
        return self.jvm.java.lang.System.currentTimeMillis() // 1000

    def is_folder(self, path: str) -> bool:
        return self.fs.getFileStatus(self.at(path)).isDirectory()


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a table is a folder of files, not one file."""
    return _Files(spark, path).is_folder(path)


@dataclass
class BatchStore:
    """``fold`` turns the rows of several runs into those of one; it must give the same rows when run over its own results.
    ``blooms`` are columns whose Parquet Bloom filters let a search by value skip row groups."""

    spark: SparkSession
    path: str
    by: tuple[str, ...] = ()
    fold: Callable[[DataFrame], DataFrame] | None = None
    fmt: str = "parquet"
    fan: int = 8
    keep_seconds: int = 86_400
    blooms: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        self.path = self.path.rstrip("/")
        self.files = _Files(self.spark, self.path)

    def runs(self) -> list[Run]:
        found = (_NAME.match(name) for name in self.files.names(f"{self.path}/_commits"))
        return visible([Run(*map(int, m.groups())) for m in found if m])

    def batches(self) -> list[int]:
        """Last batches of the visible runs."""
        return [r.last for r in self.runs()]

    def _folder(self, run: Run) -> str:
        return f"{self.path}/run={run.name}"

    def schema(self) -> StructType | None:
        """Columns of the newest run; rows of older ones have nulls for what they lack."""
        runs = self.runs()
        return self._schema(max(runs, key=lambda r: r.last)) if runs else None

    def _schema(self, run: Run) -> StructType:
        return StructType.fromJson(json.loads(self.files.read(f"{self._folder(run)}/_schema")))

    def _load(self, runs: list[Run], schema: StructType) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.format(self.fmt).schema(schema).option("basePath", self.path) \
            .load([self._folder(r) for r in runs]).select(*schema.names)

    def read(self, before: int | None = None, schema: StructType | None = None) -> DataFrame:
        """All rows of committed batches (of those below ``before``), with ``_batch``, the batch that brought them."""
        runs = [r for r in self.runs() if before is None or r.last < before]
        schema = schema or self.schema()
        if schema is None:
            raise ValueError(f"no committed batch in {self.path}")
        return self._load(runs, schema)

    def write(self, df: DataFrame, batch_id: int) -> Run:
        """The rows of one batch; the same batch written again replaces itself."""
        self.merge(before=batch_id)
        return self._commit(df.withColumn(BATCH, F.lit(batch_id).cast("long")), batch_id, batch_id)

    def _commit(self, df: DataFrame, first: int, last: int) -> Run:
        taken = [int(m.group(3)) for m in map(_NAME.match, self.files.names(f"{self.path}/_commits"))
                 if m and (int(m.group(1)), int(m.group(2))) == (first, last)]
        run = Run(first, last, max(taken, default=-1) + 1)
        writer = df.write.mode("overwrite").format(self.fmt).options(**self.options)
        for column in self.blooms:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        if self.by:
            writer = writer.partitionBy(*self.by)
        writer.save(self._folder(run))
        self.files.write(f"{self._folder(run)}/_schema", df.schema.json())
        self.files.create(f"{self.path}/_commits/{run.name}")
        return run

    def merge(self, before: int) -> None:
        """Bring full blocks of ``fan``, ``fan`` * ``fan``, … batches below ``before`` into one run each."""
        size = self.fan
        while size <= before:
            last = before // size * size - 1
            inside = [r for r in self.runs() if r.first > last - size and r.last <= last]
            if len(inside) > 1:
                self._merge(inside)
            size *= self.fan

    def compact(self, upto: int) -> None:
        """All runs of batches up to ``upto`` as one."""
        inside = [r for r in self.runs() if r.last <= upto]
        if len(inside) > 1:
            self._merge(inside)

    def _merge(self, runs: list[Run]) -> None:
        df = self._load(runs, self._schema(max(runs, key=lambda r: r.last)))
        columns = df.columns
        if self.fold is not None:
            df = self.fold(df).select(*columns)
        elif self.by:
            df = df.repartition(*self.by)
        self._commit(df, min(r.first for r in runs), max(r.last for r in runs))
        self.clean()

    def clean(self) -> None:
        """Delete what has been hidden, or was never committed, for ``keep_seconds``."""
        shown, limit = {r.name for r in self.runs()}, self.files.now() - self.keep_seconds
        for name, changed in self.files.names(f"{self.path}/_commits").items():
            if _NAME.match(name) and name not in shown and changed <= limit:
                self.files.delete(f"{self.path}/_commits/{name}")
        for name, changed in self.files.names(self.path).items():
            if name.startswith("run=") and name[4:] not in shown and changed <= limit:
                self.files.delete(f"{self.path}/{name}")


def committed_batch(spark: SparkSession, checkpoint: str) -> int:
    """The last batch a stream's checkpoint says is done, -1 where there is none."""
    done = _Files(spark, checkpoint).names(f"{checkpoint.rstrip('/')}/commits")
    return max((int(name) for name in done if name.isdigit()), default=-1)
