"""A keyed table in buckets: what an upsert changes is written, and only then named.

Rows lie in buckets by a hash of their key; a bucket is a list of folders of Parquet
files.  A change writes new folders for the buckets that incoming keys fall in, and
then a manifest, one small file that names the folders of every bucket.  Readers
follow the newest manifest, so a run that fails before it leaves the old version as
it was, and older versions stay readable until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StructField, StructType

from .tables import remove

_BUCKET = "__bucket"


def fingerprint(df: DataFrame) -> Column:
    """A hash of a whole row, by which ties are settled the same way in every run."""
    return F.xxhash64(*[F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, MapType) else F.col(f.name) for f in df.schema.fields])


def one_per_key(df: DataFrame, keys: list[str], order: list[Column] = ()) -> DataFrame:
    """The row of each key that comes last in the given order; ties are settled by the rows' hash."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order], fingerprint(df))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


class ConflictError(RuntimeError):
    """Another writer has committed a version since this one was read."""


class KeyedTable:
    """Rows by key in the folder ``path``.  A null in a key column is a value like any other."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType | None = None, buckets: int | None = None, bucket_by: list[str] | None = None) -> None:
        """Opens the table at path; where there is none yet, a first change makes one of this schema."""
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.state = self._newest()
        if self.state is None:
            if schema is None:
                raise ValueError(f"there is no table at {path}; give its schema")
            n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self.state = {"version": 0, "buckets": n, "by": list(bucket_by or keys), "schema": schema.jsonValue(), "files": {}, "marks": {}}

    # ---- versions ----

    def _manifests(self) -> DataFrame:
        return self.spark.read.schema("state string, v long").option("basePath", f"{self.path}/manifest").parquet(f"{self.path}/manifest")

    def _newest(self) -> dict | None:
        try:
            last = self._manifests().orderBy(F.desc("v")).limit(1).collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return json.loads(last[0].state) if last else None

    @property
    def version(self) -> int:
        return self.state["version"]

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(self.state["schema"])

    def mark(self, name: str) -> int:
        """The last number that a change left under this name (-1: none); streams keep their batch there."""
        return self.state["marks"].get(name, -1)

    def _commit(self, files: dict[str, list[str]], marks: dict[str, int] | None) -> None:
        state = {**self.state, "files": {**self.state["files"], **files}, "marks": {**self.state["marks"], **(marks or {})}, "version": self.version + 1}
        row = self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1)
        while True:
            try:
                row.write.mode("error").parquet(f"{self.path}/manifest/v={state['version']}")
                break
            except AnalysisException as e:
                newest = self._newest()
                if e.getCondition() != "PATH_ALREADY_EXISTS" or (newest and newest["version"] > self.version):
                    raise ConflictError(f"{self.path} is at version {newest and newest['version']}, not {self.version}") from e
                state["version"] += 1  # left by a run that failed on its way
                row = self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1)
        self.state = state

    # ---- reading ----

    def read(self, version: int | None = None, buckets: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
        """The rows of the newest version seen by this object, or of an earlier one; of some buckets only, if given."""
        state = self.state
        if version is not None and version != self.version:
            state = json.loads(self._manifests().where(F.col("v") == version).first().state)
        schema = StructType.fromJson(state["schema"])
        wanted = state["files"] if buckets is None else {str(b): state["files"].get(str(b), []) for b in buckets}
        at = [f"{self.path}/data/{folder}/{_BUCKET}={b}" for b, folders in wanted.items() for folder in folders]
        rows = self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)
        return rows.select(*columns) if columns else rows

    def folders(self) -> dict[int, list[str]]:
        """The folders of each bucket that has rows."""
        return {int(b): list(f) for b, f in self.state["files"].items() if f}

    # ---- writing ----

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """(folder, the buckets it has rows of): rows by bucket, one file a bucket."""
        folder = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64(*self.state["by"]), F.lit(self.state["buckets"])).cast("int")
        dealt = rows.select(*self.schema.names).withColumn(_BUCKET, bucket).repartition(_BUCKET)
        dealt.write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{folder}")
        written = self.spark.read.schema(StructType([*self.schema.fields, StructField(_BUCKET, IntegerType())])).parquet(f"{self.path}/data/{folder}")
        held = [r[0] for r in written.select(_BUCKET).distinct().collect()]
        if not held:
            remove(self.spark, f"{self.path}/data/{folder}")
        return folder, held

    def _staged(self, incoming: DataFrame) -> tuple[DataFrame, str, list[int]]:
        folder, touched = self._write(incoming)
        at = [f"{self.path}/data/{folder}/{_BUCKET}={b}" for b in touched]
        rows = self.spark.read.schema(self.schema).parquet(*at) if at else self.spark.createDataFrame([], self.schema)
        return rows, folder, touched

    def _on(self, a: DataFrame, b: DataFrame) -> Column:
        on = F.lit(True)
        for k in self.keys:
            on = on & a[k].eqNullSafe(b[f"__{k}"])
        return on

    def _keys_of(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(k).alias(f"__{k}") for k in self.keys])

    def _without(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        other = self._keys_of(keys)
        return rows.join(other, self._on(rows, other), "left_anti")

    def upsert(self, incoming: DataFrame, order: list[Column] = (), marks: dict[str, int] | None = None) -> None:
        """Incoming rows replace stored ones of their key; of several incoming rows of a key the last in the given order counts."""
        rows, folder, touched = self._staged(one_per_key(incoming.select(*self.schema.names), self.keys, order))
        kept, others = self._write(self._without(self.read(buckets=touched), rows))
        self._commit({str(b): [folder, kept] if b in others else [folder] for b in touched}, marks)

    def insert_new(self, incoming: DataFrame, order: list[Column] = (), marks: dict[str, int] | None = None) -> None:
        """Incoming rows whose key is not stored yet are added, the last in the given order of each key; stored rows stay and are not rewritten."""
        rows, folder, touched = self._staged(one_per_key(incoming.select(*self.schema.names), self.keys, order))
        new, fresh = self._write(self._without(rows, self.read(buckets=touched, columns=self.keys)))
        self._commit({str(b): [*self.state["files"].get(str(b), []), new] for b in fresh}, marks)
        remove(self.spark, f"{self.path}/data/{folder}")

    def merge(self, incoming: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], marks: dict[str, int] | None = None) -> None:
        """Stored rows of the incoming keys are replaced by combine(incoming, stored), which gives a row for each of these keys.

        incoming has the table's columns and one row a key; stored holds all rows of
        the buckets that the keys fall in.
        """
        rows, folder, touched = self._staged(incoming)
        stored = self.read(buckets=touched)
        new, held = self._write(combine(rows, stored))
        kept, others = self._write(self._without(stored, rows))
        self._commit({str(b): [*([new] if b in held else []), *([kept] if b in others else [])] for b in touched}, marks)
        remove(self.spark, f"{self.path}/data/{folder}")

    def update_columns(self, incoming: DataFrame, cols: list[str], set_null: bool = False, order: list[Column] = ()) -> None:
        """Only the named columns change, only of stored keys; an incoming null changes nothing unless set_null."""
        names = [*self.keys, *cols]
        given = one_per_key(incoming.select(*names), self.keys, order)
        wide = given.select(*[F.col(c) if c in names else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.schema.names])

        def combine(rows: DataFrame, stored: DataFrame) -> DataFrame:
            new = rows.select(*[F.col(c).alias(f"__{c}") for c in names], F.lit(True).alias("__new"))
            both = stored.join(new, self._on(stored, new))
            value = lambda c: F.col(f"__{c}") if set_null else F.coalesce(f"__{c}", c)
            return both.select(*[value(c).alias(c) if c in cols else F.col(c) for c in self.schema.names])

        self.merge(wide, combine)

    def delete(self, keys: DataFrame) -> None:
        """Takes out the rows of these keys."""
        wide = keys.select(*self.keys).distinct().select(*[F.col(c) if c in self.keys else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.schema.names])
        self.merge(wide, lambda rows, stored: rows.where("false"))

    def compact(self, folders: int = 8) -> None:
        """Buckets of more than so many folders are written anew, each as one."""
        many = [b for b, f in self.folders().items() if len(f) > folders]
        if many:
            folder, held = self._write(self.read(buckets=many))
            self._commit({str(b): [folder] if b in held else [] for b in many}, None)

    def vacuum(self) -> None:
        """Removes what only earlier versions name; they cannot be read any more."""
        live = {f for folders in self.state["files"].values() for f in folders}
        for row in self._manifests().where(F.col("v") < self.version).collect():
            old = {f for folders in json.loads(row.state)["files"].values() for f in folders}
            for folder in sorted(old - live):
                remove(self.spark, f"{self.path}/data/{folder}")
            remove(self.spark, f"{self.path}/manifest/v={row.v}")
            live |= old
