"""What the operators of this subpackage share: the shared folder, materialised steps, connected components."""

from __future__ import annotations

import gc
import re
import uuid
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, one of our own, but only
    if driver and executors are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file:///tmp/tideline-checkpoints"  # one machine, as in tests
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


BATCH = 2000  # rows
_made: list[str] = []  # scratch of this driver's steps, until it is released


def put(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df``, written as Parquet to the shared folder and read again, and where it is."""
    path = f"{shared_dir(df.sparkSession)}/{PurePosixPath(name).name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again.

    Later steps then read files that outlive any executor, with column pruning. ``release`` removes them."""
    again, path = put(df, name)
    _made.append(path)
    return again


def scratch() -> int:
    """How many steps have scratch by now, see ``settled``."""
    return len(_made)


def settled(df: DataFrame, name: str, since: int | None = None) -> DataFrame:
    """``written``, and the shuffle files of steps before it go: Spark's cleaner removes those that no live DataFrame needs,
    once the driver's JVM has collected its garbage, which by itself it does every 30 minutes. With ``since``, a former
    ``scratch()``, the scratch of the steps after that goes too, as only this result is read from here on."""
    spark = df.sparkSession
    again, path = put(df, name)
    if since is not None:
        release(spark, since)
    _made.append(path)
    del df
    gc.collect()
    spark._jvm.System.gc()
    return again


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def release(spark: SparkSession, since: int = 0) -> None:
    """Remove the scratch of all steps so far, but of the first ``since``; results that were made from it must have been
    written."""
    while len(_made) > since:
        remove(spark, _made.pop())


def modest_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH`` rows instead of Spark's default of 10,000, as whole texts are long: a batch is held
    several times, in the JVM and in Python. A session that has set its own number keeps it."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(text: str = "text"):
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits of a row's id and text: rows that agree in both have the same key."""
    whose = F.coalesce(F.concat(F.lit("i"), F.col(doc_id).cast("string")), F.lit(""))
    return F.md5(F.concat(whose, F.lit("\0"), text_of(text)).cast("binary"))


def fold(doc_id: str, mod: int):
    """crc32 of the id as text, modulo ``mod`` (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def without(docs: DataFrame, key: Column, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key``, of the kind of the one column of ``dropped``, isn't in it.

    A bitmap of bounded size lets most rows pass; the others meet the dropped keys in a join, so few texts are moved."""
    from .bitmap import bitmap, screened

    (name,) = dropped.columns
    shared = bitmap(dropped.distinct(), name)
    keyed = docs.withColumn("_key", key)
    hashed = F.xxhash64("_key")
    maybe = screened(keyed, hashed, shared).join(dropped.select(F.col(name).alias("_key")).hint("merge"), "_key", "left_anti")
    return screened(keyed, hashed, shared, there=False).unionByName(maybe).select(*docs.columns)


def thinned(docs: DataFrame, key: Column, table: DataFrame, stays: Column) -> DataFrame:
    """The rows of ``docs`` whose ``key`` isn't in column _k of ``table``, and of those whose key is, one for each key for
    which ``stays``, over the columns of both, holds."""
    from .bitmap import bitmap, screened

    keyed = docs.withColumn("_k", key)
    shared = bitmap(table.select("_k"), "_k")
    hashed = F.xxhash64("_k")
    maybe = written(screened(keyed, hashed, shared).join(table.withColumn("_there", F.lit(True)).hint("merge"), "_k", "left"), "maybe")
    one = maybe.where(F.col("_there") & stays).dropDuplicates(["_k"])
    rest = screened(keyed, hashed, shared, there=False)
    return rest.select(*docs.columns).unionByName(maybe.where("_there IS NULL").select(*docs.columns)).unionByName(one.select(*docs.columns))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a long, b long) as (node, root), root the smallest node reached.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). A round is two aggregations and two joins over
    the edges, so no node's neighbours are gathered in one row; a very common node is split by AQE's skew join. The
    edges of each round are written to the shared folder. Merge joins at every size, as both sides grow with the input. An empty input gives an empty result."""
    spark = edges.sparkSession
    a, b = F.col("a"), F.col("b")
    now, path = put(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # Large star: every neighbour larger than u points to the smallest of u and its neighbours.
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where(b > a).join(low.hint("merge"), F.col("a") == F.col("u")).select(b.alias("a"), F.col("m").alias("b")).distinct()
        # Small star: u and its smaller neighbours point to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        pairs = large.join(low.hint("merge"), F.col("a") == F.col("u"))
        small = pairs.where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        last = path
        now, path = put(small.distinct(), "edges")
        remove(spark, last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if state[0] == state[2] and tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    _made.append(path)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
