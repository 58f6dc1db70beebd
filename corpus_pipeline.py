"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns the rows that stay, with the columns of ``docs``; the last returns
packed pieces. A stage removes the scratch of those before it, so their results must have been written. Rows with the
same id and text count as copies of each other. Null and empty texts are scored, grouped, searched and packed as empty
texts, null ids as ids of their own kind; other columns pass through whatever their names are; an empty table passes
every stage and gives no pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontaminate, exact_dedup, jaccard_join, packing, quality
from tideline.llm.shared import modest_batches, put, read_table, release, remove, row_key, thinned, without, written


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with other columns out of the way, and the names to give back; scratch of earlier stages is removed."""
    release(docs.sparkSession)
    modest_batches(docs.sparkSession)
    names = {c: f"_in_{c}" for c in docs.columns if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed(names), {v: k for k, v in names.items()}


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    plain, names = _plain(docs)
    model = quality.train(plain, read_table(spark, sf_dir, "labels"))
    return quality.score(plain, model).where("predicted = 1").select(*plain.columns).withColumnsRenamed(names)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of equal normalised texts."""
    plain, names = _plain(docs)
    found = exact_dedup.exact_dedup(exact_dedup.in_batches(plain)).where("group_size > 1")
    groups = written(found.groupBy(F.col("text_sha256").alias("_k")).agg(F.first("keep_id").alias("_keep")), "copies")
    key = exact_dedup.sha256(exact_dedup.normalised())
    return thinned(plain, key, groups, F.col("doc_id").eqNullSafe(F.col("_keep"))).withColumnsRenamed(names).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles of similarity 0.8 or more."""
    plain, names = _plain(docs)
    linked = written(jaccard_join.jaccard_join(plain, n=5, num=80, den=100, rows=True).where("n_links > 0").select("doc_id", "row", "group"), "linked")
    stay = linked.groupBy("group").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("_k")).select("_k", F.lit(True).alias("_stays"))
    table = linked.select(F.col("row").alias("_k")).distinct().join(stay.hint("merge"), "_k", "left")
    return thinned(plain, row_key(), table, F.col("_stays")).withColumnsRenamed(names).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    plain, names = _plain(docs)
    hit = written(decontaminate.decontaminate(plain, read_table(spark, sf_dir, "benchmark")).where("contaminated").select("key"), "hit")
    return without(plain, row_key(), hit).withColumnsRenamed(names).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, packed into sequences."""
    release(spark)
    modest_batches(spark)
    return packing.best_fit_pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]
ORACLE_SQL = None  # the classifier's and the packing's results are not SQL's


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
