"""Bounded samples of labelled rows, for classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold


def sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, most: int) -> DataFrame:
    """(doc_id, y, text) of at most ``most`` labelled documents outside the held-out fold, chosen by a hash of the id.

    Labels repeated for an id are averaged; of rows that repeat an id the smallest text is taken; null labels and ids are left out."""
    ok = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", mod) != held))
    ids = ok.groupBy("doc_id").agg(F.avg(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id")  # ``ids`` has at most ``most`` rows
    return found.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))


def beside(docs: DataFrame, made: tuple[str, ...]) -> list[str]:
    """The columns of ``docs`` that stay beside those that a score makes, which replace columns of the same name."""
    return [c for c in docs.columns if c.lower() not in made]
