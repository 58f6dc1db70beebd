"""Sources and sinks: filtered reads that reach the scan, CSV with declared schemas, keyed metric tables, datasets."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import clean
from ..operators.metrics import upsert

CSV_SCHEMAS = {
    "tasks": "id string, user_id string, title string, status string, priority string, context_tag string, context_location_id string, due_at timestamp, estimated_minutes int, created_at timestamp, completed_at timestamp",
    "task_events": "id string, task_id string, user_id string, event_type string, occurred_at timestamp, location_id string",
    "interruptions": "id string, user_id string, task_id string, interruption_type string, occurred_at timestamp, duration_seconds int, location_id string",
    "locations": "id string, user_id string, name string, location_type string",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, one of our own, but only
    if driver and executors are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file:///tmp/tideline-checkpoints"  # one machine, as in tests
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, for steps that use it several times."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str, *order: str, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """``df`` as a table of ``buckets`` buckets by ``key``, one file each, sorted by ``key`` and ``order``: windows, groups
    and joins by the key, or by it and more, read it without a shuffle, however often they do.

    ``path`` defaults to a new one in the shared folder, ``buckets`` to the session's shuffle partitions; tables that are
    joined need the same number. Rows of one key are one bucket's; sorted files let filters on the key skip row groups."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key, *order).option("path", path or scratch_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def _file_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads."""
    spark, size = df.sparkSession, 0
    for f in df.inputFiles():
        at = spark._jvm.org.apache.hadoop.fs.Path(f)
        size += at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
    return size


def spread_by(df: DataFrame, *keys: str, of: DataFrame | None = None, each: int = 8 << 20) -> DataFrame:
    """``df`` by ``keys`` in a partition for each ``each`` bytes of the files that ``of`` (itself, if not given) reads, where
    these are more than the session's shuffle partitions: a task's memory then doesn't grow with the input, and windows,
    groups and joins by the keys need no further shuffle. A smaller ``df`` stays as it is."""
    n = -(-_file_bytes(df if of is None else of) // each)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def merged_if_large(df: DataFrame, of: DataFrame | None = None, most: int = 4 << 20) -> DataFrame:
    """``df``, for a join by sorting and merging if the files that ``of`` (itself, if not given) reads are larger than
    ``most`` bytes: Spark would broadcast up to 10 MB of compressed columns, whose rows can take the driver over 100 MB."""
    return df.hint("merge") if _file_bytes(df if of is None else of) > most else df


def write_cleaned(events: DataFrame, interruptions: DataFrame, tasks: DataFrame, aliases: dict[str, str], path: str) -> DataFrame:
    """Clean three tables, write them below ``path`` as events, interruptions and tasks, and return the counts of
    ``clean.cleaning_report``: they are observed in the pass that writes, so no table is read again for them.

    Folders that exist are replaced; of a task that is run again, only one run's counts are taken."""
    n, changed = F.count(F.lit(1)).alias("n"), F.col("event_type") != F.lower(F.trim("event_type"))
    missing = lambda c: F.count_if(F.col(c).isNull())
    flags = {"categories_normalised": "category_changed", "priorities_clamped": "priority_clamped", "anomalies_flagged": "is_anomaly"}
    steps = {
        "events": (events, clean.clean_events, {"types_normalised": F.count_if(changed)}, {}),
        "interruptions": (interruptions, clean.clean_interruptions, {"durations_filled": missing("duration_seconds"), "ends_filled": missing("end_time")}, {}),
        "tasks": (tasks, lambda d: clean.clean_tasks(d, aliases), {}, {k: F.count_if(c) for k, c in flags.items()}),
    }
    rows = []
    for name, (raw, cleaned, before, after) in steps.items():
        came, went = Observation(f"{name} in"), Observation(f"{name} out")
        seen = raw.observe(came, n, *[c.alias(k) for k, c in before.items()])
        cleaned(seen).observe(went, n, *[c.alias(k) for k, c in after.items()]).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
        out = went.get
        into = came.get if out["n"] else dict.fromkeys(("n", *before), 0)  # Spark drops what lies below an empty result
        rows.append((name, "duplicates_removed", into["n"] - out["n"]))
        rows += [(name, k, (into if k in before else out)[k]) for k in (*before, *after)]
    return events.sparkSession.createDataFrame(rows, "table_name string, operation string, rows long")


def read_rows(spark: SparkSession, path: str, stamp: str, since: str | None = None, users: list | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows since a time and of some users; filter and columns are pushed to the Parquet scan."""
    d = spark.read.parquet(path)
    d = d.where(F.col(stamp) >= F.lit(since).cast(dict(d.dtypes)[stamp])) if since else d
    d = d.where(F.col("user_id").isin(users)) if users else d
    return d.select(*columns) if columns else d


def read_tasks(spark: SparkSession, path: str, since: str | None = None, users: list | None = None) -> DataFrame:
    """Tasks created since a time."""
    return read_rows(spark, path, "created_at", since, users)


def read_interruptions(spark: SparkSession, path: str, since: str | None = None, users: list | None = None) -> DataFrame:
    """Interruptions begun since a time; unknown durations are 0."""
    return read_rows(spark, path, "start_time", since, users).withColumn("duration_seconds", F.coalesce("duration_seconds", F.lit(0)))


def read_sessions(spark: SparkSession, path: str, since: str | None = None, users: list | None = None) -> DataFrame:
    """Sessions begun since a time."""
    return read_rows(spark, path, "session_start", since, users)


def read_events(spark: SparkSession, path: str, since: str | None = None, schema: str | None = None) -> DataFrame:
    """Events since a time, with their location; with a ``schema``, as a stream of the folder's files."""
    d = spark.readStream.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    return d.where(F.col("event_time") >= F.lit(since).cast("timestamp")) if since else d


def write_csv_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Times keep their microseconds."""
    for name, d in tables.items():
        d.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(f"{folder}/{name}.csv")


def location_labels(locations: DataFrame) -> DataFrame:
    return locations.select("id", "label")


def read_csv_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four CSV tables, with declared schemas, so that no pass infers them."""
    return {name: spark.read.schema(schema).option("header", True).csv(f"{folder}/{name}.csv") for name, schema in CSV_SCHEMAS.items()}


def upsert_metrics(new: DataFrame, path: str, target: str, keys: list[str], order: str = "computed_at") -> None:
    """The metrics at ``path`` with new rows, the last written of a key, as a new version at ``target``: readers of the
    old version are not disturbed, and a failed write leaves it as it was."""
    upsert(new.sparkSession.read.parquet(path), new, keys, order).write.mode("overwrite").parquet(target)


def upsert_partitions(new: DataFrame, path: str, keys: list[str], partition: str, batch: int, target: str = "_batch") -> None:
    """New rows of batch ``batch`` into the table at ``path``, partitioned by ``partition``: a row of a later batch replaces
    those of its keys. Only the partitions that the rows fall into are read and rewritten, by dynamic overwrite; the files
    of all others stay as they are. Each row carries its batch, and rows of a key that has this or a later batch change
    nothing, so a batch that comes again, whole or after a failure half way, leaves the table as one run of it does."""
    spark = new.sparkSession
    new = stored(new.withColumn(target, F.lit(batch).cast("long")), "upsert")
    if exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path)
        days = [r[0] for r in new.select(partition).distinct().collect()]  # the partitions of one batch
        of = F.col(partition).isin([d for d in days if d is not None]) | (F.col(partition).isNull() if None in days else F.lit(False))
        both = old.where(of).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        # An earlier run of this batch may have written some partitions, so its rows and those of later ones stay.
        first = Window.partitionBy(*keys).orderBy(F.desc(target), "_new")
        both = both.withColumn("_n", F.row_number().over(first))
        changed = both.groupBy(partition).agg(F.max((F.col("_new") == 1) & (F.col("_n") == 1)).alias("_c")).where("_c")
        both = stored(both, "upserted")  # the files that it reads are about to be replaced
        changed = [r[0] for r in changed.collect()]
        rows = both.where("_n = 1").where(F.col(partition).isin([d for d in changed if d is not None]) | (F.col(partition).isNull() if None in changed else F.lit(False))).drop("_n", "_new")
        if not changed:
            return
    else:
        rows = new
    rows.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def export_dataset(features: DataFrame, path: str, label: str, key: str) -> None:
    """Features and labels of each split as Parquet, and the schema and a summary as JSON."""
    features.drop(label).write.mode("overwrite").partitionBy("split").parquet(f"{path}/features")
    features.select(key, label, "split").write.mode("overwrite").partitionBy("split").parquet(f"{path}/labels")
    spark = features.sparkSession
    spark.createDataFrame([(c, t) for c, t in features.dtypes], "name string, type string").coalesce(1).write.mode("overwrite").json(f"{path}/schema")
    features.groupBy("split").agg(F.count("*").alias("rows"), F.avg(label).alias("rate")).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
