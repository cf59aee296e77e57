"""Keyed Parquet tables: upsert, insert-if-absent, registry, backfill, retention.

A table is a folder with two Parquet tables that are only ever added to. `data` has whole partitions, each below the number
of the write that made it. `commits` has a row for each partition that a write replaced, added as one file when its data are
whole. What a reader sees of a partition is its newest committed write, so a reader never writes, sees all partitions of a
write or none, and a job that dies leaves nothing that counts: the next write takes its number and replaces its files. One
writer at a time. `clean` removes what no reader sees any more.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from vayuspark.functions.calendar import as_ts
from vayuspark.operators.windows import keep_last
from vayuspark.session import cut_lineage


DATA, COMMITS, WRITE, WHOLE = "data", "commits", "write_number", "whole_table"
_COMMIT = T.StructType().add(WRITE, T.LongType()).add("column", T.StringType()).add("part", T.StringType())
#: Partition values that a filter names one by one; beyond, it names the range they span.
MOST_VALUES = 1000
#: Batches of a backfill in one pass over its input.
BATCHES = 32


def _commits(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_COMMIT).parquet(f"{path}/{COMMITS}")
    except AnalysisException:
        return spark.createDataFrame([], _COMMIT)


def _newest(spark: SparkSession, path: str) -> list:
    """The newest write of each partition: as many rows as the table has had partitions."""
    return _commits(spark, path).groupBy("column", "part").agg(F.max(WRITE).alias(WRITE)).collect()


def _place(column: str) -> Column:
    return F.concat_ws("/", F.col(WRITE).cast("string"), F.coalesce(F.col(column).cast("string"), F.lit("")))


def _current(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """What the newest writes have of each partition; only their folders are read. None before the first write."""
    newest = _newest(spark, path)
    if not newest:
        return None
    column, reader = newest[0]["column"], spark.read
    if schema is not None:
        hidden = [T.StructField(column, T.StringType())] if column not in schema.names else []
        reader = reader.schema(T.StructType([*schema.fields, *hidden, _COMMIT[WRITE]]))
    data = reader.parquet(f"{path}/{DATA}")
    kept = data.where(_place(column).isin([f"{r[WRITE]}/{r['part'] or ''}" for r in newest]))
    return kept.drop(WRITE) if schema is None else kept.select(*schema.names)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or an empty one with the schema when nothing was written yet."""
    found = _current(spark, path, schema)
    return spark.createDataFrame([], schema) if found is None else found


def touched(rows: DataFrame, partition: str) -> list:
    """The partitions that rows have; there are as many as a batch has days."""
    return [r[0] for r in rows.select(partition).distinct().collect()]


def replace_partitions(rows: DataFrame, path: str, partition: str, parts: list) -> None:
    """The given partitions are what `rows` has of them from now on; rows of no other may be given.

    Spark sizes the files and splits a partition too big for one task.
    """
    if not parts:
        return
    spark = rows.sparkSession
    number = _commits(spark, path).agg(F.coalesce(F.max(WRITE), F.lit(0)) + 1).first()[0]
    rows.hint("rebalance", partition).write.mode("overwrite").partitionBy(partition).parquet(f"{path}/{DATA}/{WRITE}={number}")
    done = spark.createDataFrame([(number, partition, None if p is None else str(p)) for p in parts], _COMMIT)
    done.coalesce(1).write.mode("append").parquet(f"{path}/{COMMITS}")


def replace_table(rows: DataFrame, path: str) -> None:
    """A table without a date, as a whole: one partition of its own. `rows` may be worked out from the table as it is."""
    replace_partitions(cut_lineage(rows, "whole").withColumn(WHOLE, F.lit(0)), path, WHOLE, [0])


def clean(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the data of writes that are no partition's newest, but for the last `keep`; returns how many writes went.

    For a time when no reader is at work on an older state.
    """
    newest = {r[WRITE] for r in _newest(spark, path)}
    numbers = sorted(r[0] for r in _commits(spark, path).select(WRITE).distinct().collect())
    file_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = file_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [n for n in numbers[: len(numbers) - keep] if n not in newest]
    return sum(files.delete(file_path(f"{path}/{DATA}/{WRITE}={n}"), True) for n in old)


def only(existing: DataFrame, parts: list, partition: str) -> DataFrame:
    """What `existing` has in some partitions, named as values, so that no other folder is read.

    A batch over very many is read by their range.
    """
    known = [v for v in parts if v is not None]
    column = F.col(partition)
    if not known:
        kept = F.lit(False)
    elif len(known) <= MOST_VALUES:
        kept = column.isin(known)
    else:
        kept = column.between(min(known), max(known))
    return existing.where(kept | column.isNull() if None in parts else kept)


def merge_rows(existing: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the latest by `order`; all other columns are replaced together."""
    return keep_last(existing.unionByName(rows.select(*existing.columns)), keys, order)


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], order: list[str], partition: str) -> None:
    rows = cut_lineage(rows, "rows")        # read twice below, whatever it takes to work them out
    parts = touched(rows, partition)
    existing = only(read_table(spark, path, rows.schema), parts, partition)
    if len([p for p in parts if p is not None]) > MOST_VALUES:      # read by a range: no other partition may be written
        existing = existing.join(rows.select(partition).distinct(), existing[partition].eqNullSafe(rows[partition]), "left_semi")
    replace_partitions(merge_rows(existing.select(*rows.columns), rows, keys, order), path, partition, parts)


def insert_if_absent(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], partition: str, order: list[str] | None = None) -> None:
    """Rows with new keys; existing rows win. Only the partitions that get rows are written again."""
    rows = cut_lineage(rows, "rows")
    table = read_table(spark, path, rows.schema)
    existing = only(table, touched(rows, partition), partition)
    fresh = cut_lineage(keep_last(rows, keys, order).join(existing.select(*keys), keys, "left_anti").select(*rows.columns), "fresh")
    parts = touched(fresh, partition)
    kept = only(table, parts, partition)
    if len([p for p in parts if p is not None]) > MOST_VALUES:
        kept = kept.join(fresh.select(partition).distinct(), kept[partition].eqNullSafe(fresh[partition]), "left_semi")
    replace_partitions(kept.select(*rows.columns).unionByName(fresh), path, partition, parts)


def register_model(registry: DataFrame, cards: DataFrame, now) -> DataFrame:
    """Registry after cards (model_version, card) come into use; empty cards change nothing."""
    new = cards.where(~F.coalesce(F.trim("card"), F.lit("")).isin("", "{}")).select(
        "model_version", F.col("card").alias("_card")
    )
    now = as_ts(now)
    joined = registry.join(new, "model_version", "full_outer")
    used = F.when(F.col("_card").isNotNull(), now)
    return joined.select(
        "model_version", F.coalesce("_card", "card").alias("card"),
        F.coalesce(F.col("first_used_at"), now).alias("first_used_at"),
        F.coalesce(used, F.col("last_used_at")).alias("last_used_at"),
    )


def upsert_nodes(nodes: DataFrame, rows: DataFrame, now) -> DataFrame:
    """Node table after rows: known nodes take name, state and kind, keep place and creation time."""
    fresh = rows.select("location_hash", *[F.col(c).alias(f"_{c}") for c in ("location_name", "state", "lat", "lon", "kind")])
    joined = nodes.join(fresh, "location_hash", "full_outer")
    seen = F.col("_location_name").isNotNull()
    take = lambda c: F.when(seen, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    keep = lambda c: F.coalesce(c, f"_{c}").alias(c)
    return joined.select(
        "location_hash", take("location_name"), take("state"), keep("lat"), keep("lon"), take("kind"),
        F.coalesce(F.col("created_at"), as_ts(now)).alias("created_at"),
    )


def backfill_write(spark: SparkSession, rows: DataFrame, path: str, batch: str = "batch") -> int:
    """Write the batches that are not there yet, a null batch like any other; returns how many were there before.

    `BATCHES` batches are one write, which counts when it is whole, so a run that died goes on where it stopped.
    """
    done = {r["part"] for r in _newest(spark, path)}
    text = F.col(batch).cast("string")
    missing = sorted((r[0] for r in rows.select(text).distinct().collect() if r[0] not in done), key=lambda x: (x is not None, x))
    for low in range(0, len(missing), BATCHES):
        some = missing[low : low + BATCHES]
        known = [x for x in some if x is not None]
        replace_partitions(rows.where(text.isin(known) | text.isNull() if None in some else text.isin(known)), path, batch, some)
    return len(done)


def prune_counts(table: DataFrame, column: str, cutoff, name: str) -> DataFrame:
    """How many rows are older than the cutoff, and how many stay."""
    old = F.col(column) < as_ts(cutoff)
    return table.agg(F.count_if(old).alias("dropped"), F.count_if(~old).alias("kept")).select(
        F.lit(name).alias("table_name"), "dropped", "kept"
    )


def prune_rows(table: DataFrame, column: str, cutoff) -> DataFrame:
    return table.where(F.col(column) >= as_ts(cutoff))


def prune(spark: SparkSession, path: str, column: str, partition: str, as_of: datetime, keep_days: int) -> dict[str, int]:
    """Drop rows strictly older than the cutoff from a table partitioned by the day of `column`; how many went and stay.

    Older days go as a whole and are only counted, the day of the cutoff is written again. A table that is empty or not
    there stays so.
    """
    cutoff = as_of - timedelta(days=keep_days)
    table = _current(spark, path)
    if table is None:
        return {"dropped": 0, "kept": 0}
    sizes = {r[partition]: r["count"] for r in table.where(F.col(partition).isNotNull()).groupBy(partition).count().collect()}
    sizes = {d if isinstance(d, date) else date.fromisoformat(d): n for d, n in sizes.items()}
    day = table.where(F.col(partition) == F.lit(cutoff.date()))
    edge = prune_counts(day, column, cutoff, path).first()
    gone = [d for d in sizes if d < cutoff.date()]
    if edge["dropped"]:
        gone.append(cutoff.date())
    replace_partitions(prune_rows(day, column, cutoff), path, partition, gone)
    later = sum(n for d, n in sizes.items() if d > cutoff.date())
    return {"dropped": edge["dropped"] + sum(n for d, n in sizes.items() if d < cutoff.date()), "kept": edge["kept"] + later}
