"""Reading feeds and tables, and writing keyed ones."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas


def shared(spark: SparkSession) -> str:
    """A fresh folder that all executors see; a temporary one only on a local master where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or "file://" + tempfile.mkdtemp(prefix="spark-draft-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it back: what several passes read is computed once, and plans stay small."""
    path = f"{shared(df.sparkSession)}-{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, in whatever store it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*tables: DataFrame) -> None:
    """Removes saved tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._saved_at)


_ROWS = "array<variant>"


def _feeds(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(context..., file, ok, rows): each file's JSON, parsed once, and its list of rows; the names of the context columns."""
    text = spark.read.text(path, wholetext=True).select("*", F.col("_metadata.file_path").alias("file"))
    context = [c for c in text.columns if c not in ("value", "file")]
    parsed = text.select(*context, "file", "value", F.try_parse_json("value").alias("v"))
    fields = F.try_variant_get("v", "$", "map<string,variant>")
    as_list = lambda v: F.try_variant_get(v, "$", _ROWS)
    # only an object without results is asked for its keys in the order of the file
    ordered = F.filter(F.json_object_keys("value"), lambda k: as_list(F.try_element_at(fields, k)).isNotNull())
    rows = F.coalesce(as_list(F.col("v")), as_list(F.try_element_at(fields, F.lit("results"))), as_list(F.try_element_at(fields, F.get(ordered, F.lit(0)))))
    return parsed.select(*context, "file", F.col("v").isNotNull().alias("ok"), rows.alias("rows")), context


def read_ratings(spark: SparkSession, path: str, row: str = schemas.CARD_RATING) -> DataFrame:
    """Rows of feed files laid out as set_code=/format=/filter_context=/run_date=.

    A file is a list of rows, an object with ``results``, or an object whose first
    list value holds the rows.  A field that is missing or of another type is null.
    Files that hold no rows in any of these ways are listed by rejected_feeds.
    """
    feeds, context = _feeds(spark, path)
    each = feeds.select(*context, F.posexplode("rows").alias("ingest_seq", "r"))
    fields = [c.strip().split(" ", 1) for c in row.split(",")]
    return each.select(*context, "ingest_seq", *[F.try_variant_get("r", f"$.{name}", kind).alias(name) for name, kind in fields])


def rejected_feeds(spark: SparkSession, path: str) -> DataFrame:
    """(context..., file, reason): files that are no JSON, or hold no list of rows."""
    feeds, context = _feeds(spark, path)
    return feeds.where("rows is null").select(*context, "file", F.when(F.col("ok"), "no list of rows").otherwise("no JSON").alias("reason"))


def read_table(spark: SparkSession, root: str, name: str, set_code: str | None = None, fmt: str | None = None, columns: Iterable[str] | None = None) -> DataFrame:
    """A table kept as Parquet by set_code and format; only the asked partitions and columns are read."""
    df = spark.read.parquet(f"{root}/{name}")
    if set_code is not None:
        df = df.where(F.col("set_code") == set_code)
    if fmt is not None:
        df = df.where(F.col("format") == fmt)
    return df.select(*columns) if columns else df


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order_col: str | None = None) -> DataFrame:
    """S3: incoming rows replace stored ones of the same key; other stored rows stay.

    Of several incoming rows of a key the last by order_col wins; ties go to the
    least row, so a run again gives the same.  KeyedTable writes the result in place.
    """
    new = last_by_key(incoming, keys, [F.col(order_col)] if order_col else [], settle=True)
    return current.join(new.select(*keys), keys, "left_anti").select(*current.columns).unionByName(new.select(*current.columns))


def last_by_key(df: DataFrame, keys: list[str], order: list[Column], settle: bool = False) -> DataFrame:
    """The row of each key that comes last in the given order; with ``settle`` ties go to the least row as text."""
    ties = [F.to_json(F.struct(*df.columns))] if settle else []
    w = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order], *ties)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def upsert_columns(current: DataFrame, incoming: DataFrame, keys: list[str], cols: list[str], set_null: bool = False) -> DataFrame:
    """Only the named columns change, and only where a row of the key comes in; an incoming null counts only with set_null."""
    new = last_by_key(incoming.select(*keys, *cols), keys, [], settle=True).select(*keys, *[F.col(c).alias(f"__{c}") for c in cols], F.lit(True).alias("__in"))
    joined = current.join(new, keys, "left")
    value = lambda c: F.when(F.col("__in"), F.col(f"__{c}")).otherwise(F.col(c)) if set_null else F.coalesce(f"__{c}", c)
    return joined.select(*[value(c).alias(c) if c in cols else F.col(c) for c in current.columns])


def replace_partitions(df: DataFrame, path: str, by: tuple[str, ...] = ("set_code", "format")) -> None:
    """The partitions that df has rows for are replaced; all others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def select_sets(sets: DataFrame, targets: DataFrame | None = None, embargoed: Iterable[str] = ()) -> DataFrame:
    """Active sets with a start date, of the targets if given, newest first."""
    out = sets.where("active and start_date is not null")
    if targets is not None:
        out = out.join(targets.select("code").distinct(), "code", "left_semi")
    banned = list(embargoed)
    return (out.where(~F.col("code").isin(banned)) if banned else out).orderBy(F.desc("start_date"), "code")


def missing_targets(sets: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets that are not active sets."""
    return targets.select("code").distinct().join(sets.where("active").select("code"), "code", "left_anti")


def export_deck_text(skeletons: DataFrame, keys: tuple[str, ...] = ("set_code", "format", "archetype_name", "is_alternative")) -> DataFrame:
    """S7: 'Deck' and one line 'count name' per card in first-seen order."""
    cards = skeletons.select(*keys, F.posexplode("deck_list").alias("pos", "card"))
    lines = cards.groupBy(*keys, F.col("card.name").alias("name")).agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    listed = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(" ", F.col("n").cast("string"), "name").alias("line")))).alias("l"))
    return listed.select(*keys, F.concat(F.lit("Deck\n"), F.array_join("l.line", "\n")).alias("deck_text"))
