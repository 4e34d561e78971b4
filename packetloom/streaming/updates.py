"""Tables of updates that stay small: newest batches, runs of batches, and a base.

Batch n writes ``batch_id=n``. Every eighth batch merges the last eight into a run, every eighth
run merges with the base before it into a new base; of each key the newest row stays. So a reader
opens one base, at most seven runs and seven batches, however long the stream has run. What a
run or a base replaces goes one generation later: a batch that is run again after a
failure finds all it read before, and writes the same folders again.

Bases and runs are below ``_merged``, which Spark's own reading of the folder passes over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Batches of a run, and runs of a base.
RUN, BASE = 8, 8
#: Folders that a reader opens at most.
MOST_FOLDERS = 1 + (BASE - 1) + (RUN - 1)


def latest(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last written row of each key of an update table; without keys the last batch's rows."""
    return newest(updates, keys).drop("batch_id")


def newest(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As :func:`latest`, with the batch."""
    if not keys:
        return updates.filter(F.col("batch_id") == updates.agg(F.max("batch_id")).scalar())
    values = [c for c in updates.columns if c not in keys]
    return (
        updates.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
        .select(*keys, "_v.*")
        .select(*updates.columns)
    )


def _numbered(schema: T.StructType) -> T.StructType:
    return T.StructType([*[f for f in schema if f.name != "batch_id"], T.StructField("batch_id", T.LongType())])


class UpdateTable:
    """The folder of an update table with the key of its rows."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), list(keys)

    def _hadoop(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, parent: str, name: str) -> list[int]:
        """Numbers of the complete folders ``name=number``."""
        files, path = self._hadoop(parent)
        if not files.exists(path):
            return []
        found = []
        for status in files.listStatus(path):
            label = status.getPath().getName()
            if label.startswith(f"{name}=") and self._complete(f"{parent}/{label}"):
                found.append(int(label.split("=")[1]))
        return sorted(found)

    def _complete(self, folder: str) -> bool:
        files, path = self._hadoop(f"{folder}/_SUCCESS")
        return files.exists(path)

    def _remove(self, folder: str) -> None:
        files, path = self._hadoop(folder)
        files.delete(path, True)

    def _batch(self, n: int) -> str:
        return f"{self.folder}/batch_id={n}"

    def _run(self, r: int) -> str:
        return f"{self.folder}/_merged/run={r}"

    def _base(self, b: int) -> str:
        return f"{self.folder}/_merged/base={b}"

    def _read(self, schema, base: int | None, runs: Sequence[int], batches: Sequence[int]) -> DataFrame:
        whole, names = self.spark.read.schema(schema), schema.names
        parts = [whole.parquet(p).select(*names) for p in ([self._base(base)] if base is not None else []) + [self._run(r) for r in runs]]
        one = self.spark.read.schema(T.StructType([f for f in schema if f.name != "batch_id"]))
        parts += [one.parquet(self._batch(n)).withColumn("batch_id", F.lit(n).cast("bigint")).select(*names) for n in batches]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def folders(self) -> tuple[int | None, list[int], list[int]]:
        """The base, runs and batches that hold the current table."""
        merged = f"{self.folder}/_merged"
        base = max(self._numbers(merged, "base"), default=None)
        first_run = 0 if base is None else (base + 1) * BASE
        runs = [r for r in self._numbers(merged, "run") if r >= first_run]
        first = (runs[-1] + 1 if runs else first_run) * RUN
        return base, runs, [n for n in self._numbers(self.folder, "batch_id") if n >= first]

    def write(self, rows: DataFrame, batch: int) -> None:
        """Store what a batch changed and merge where it is time; again for the same batch, the same."""
        rows.write.mode("overwrite").parquet(self._batch(batch))
        schema = _numbered(rows.schema)
        if (batch + 1) % RUN:
            return
        run = batch // RUN
        merged = self._read(schema, None, [], range(run * RUN, batch + 1))
        newest(merged, self.keys).write.mode("overwrite").parquet(self._run(run))
        if (run + 1) % BASE == 0:
            base = run // BASE
            merged = self._read(schema, base - 1 if base else None, range(base * BASE, run + 1), [])
            newest(merged, self.keys).write.mode("overwrite").parquet(self._base(base))
            for r in range(max(base - 1, 0) * BASE, base * BASE):
                self._remove(self._run(r))
            if base > 1:
                self._remove(self._base(base - 2))
        for n in range(max(run - 1, 0) * RUN, run * RUN):
            self._remove(self._batch(n))

    def exists(self) -> bool:
        return any(x not in (None, []) for x in self.folders())

    def read(self) -> DataFrame:
        """The newest row of each key."""
        base, runs, batches = self.folders()
        some = self._base(base) if base is not None else self._run(runs[0]) if runs else self._batch(batches[0])
        schema = _numbered(self.spark.read.parquet(some).schema)
        return latest(self._read(schema, base, runs, batches), self.keys)
