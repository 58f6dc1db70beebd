"""Patterns of context sessions: frequent interruptions, slow resumption, clusters and anomalies."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import r6
from .stats import quantiles


def frequency_patterns(sessions: DataFrame, least: int = 5, z: float = 1.0) -> DataFrame:
    """(kind, category, context) of at least ``least`` sessions whose mean rate of interruptions or of switches a second
    stands out of all sessions' mean by ``z`` of their standard deviations; a session without duration has the rate 0."""
    seconds = F.col("session_duration_seconds")
    rate = lambda c: F.when(seconds > 0, F.col(c) / seconds).otherwise(0.0)
    rated = sessions.select("task_category", "context", rate("num_interruptions").alias("interruption"), rate("num_context_switches").alias("switch"))
    both = F.stack(F.lit(2), F.lit("interruption"), "interruption", F.lit("switch"), "switch").alias("kind", "rate")
    rated = rated.select("task_category", "context", both)
    g = rated.where("task_category IS NOT NULL AND context IS NOT NULL").groupBy("kind", "task_category", "context").agg(F.avg("rate").alias("rate"), F.count("*").alias("n")).where(F.col("n") >= least)
    p = rated.groupBy("kind").agg(F.avg("rate").alias("population"), F.stddev_pop("rate").alias("s"))  # two rows
    score = (F.col("rate") - F.col("population")) / F.when(F.col("s") == 0, 1e-9).otherwise(F.col("s"))
    d = g.join(F.broadcast(p), "kind").withColumn("z", score).where(F.col("z") >= z)
    confidence = F.least(F.greatest(F.col("z") / 4, F.lit(0.0)), F.lit(1.0))
    return d.select("kind", "task_category", "context", "n", *[r6(F.col(c)).alias(c) for c in ("rate", "population", "z")], r6(confidence).alias("confidence"))


def resume_delay_pattern(sessions: DataFrame, short_s: float = 30.0) -> DataFrame:
    """Sessions where short interruptions cost at least twice their own time to resume."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    short = F.filter("interruption_durations_seconds", lambda x: x <= short_s)
    d = sessions.withColumn("_short", short).where((F.col("num_interruptions") >= 2) & (F.size("_short") >= 1) & (F.size("resume_delays_seconds") >= 1))
    mean_short, mean_delay = total("_short") / F.size("_short"), total("resume_delays_seconds") / F.size("resume_delays_seconds")
    return d.where(mean_delay >= 2 * mean_short).select("user_id", "task_id", "seq", r6(mean_delay).alias("avg_delay"), r6(mean_short).alias("avg_short"))


MEASURES = ["session_duration_seconds", "focused_time_seconds", "interruption_time_seconds", "num_interruptions", "num_context_switches", "avg_delay"]


def _measures(sessions: DataFrame) -> DataFrame:
    delay = F.when(F.size("resume_delays_seconds") > 0, F.aggregate("resume_delays_seconds", F.lit(0.0), lambda a, x: a + x) / F.size("resume_delays_seconds")).otherwise(0.0)
    return sessions.withColumn("avg_delay", delay).select("user_id", "task_id", "seq", *[F.col(m).cast("double").alias(m) for m in MEASURES])


def clusters(sessions: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """K-means on standardised measures: size, share, centroid in raw units and a label."""
    d = _measures(sessions)
    model = Pipeline(stages=[VectorAssembler(inputCols=MEASURES, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_s", withMean=True), KMeans(featuresCol="_s", k=k, seed=seed, predictionCol="cluster")]).fit(d)
    c = model.transform(d).groupBy("cluster").agg(F.count("*").alias("n"), *[r6(F.avg(m)).alias(m) for m in MEASURES])
    mean = d.agg(*[F.avg(m).alias(f"m_{m}") for m in MEASURES], F.count("*").alias("total"))
    return label(c.crossJoin(F.broadcast(mean)))  # one row


def label(d: DataFrame) -> DataFrame:
    """Name groups by comparing their means with the population's (columns m_*)."""
    above = lambda m: F.col(m) > F.col(f"m_{m}")
    name = F.when(above("num_interruptions") & above("interruption_time_seconds"), "interrupted").when(above("num_context_switches"), "switching").when(above("focused_time_seconds"), "deep_focus").otherwise("short")
    return d.withColumns({"share": r6(F.col("n") / F.col("total")), "label": name}).drop("total", *[f"m_{m}" for m in MEASURES])


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> list:
    """One isolation tree as rows of (feature, cut, left, right, path length)."""
    nodes: list = []

    def length(n: int) -> float:
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def add(rows: np.ndarray, d: int) -> int:
        at = len(nodes)
        nodes.append(None)
        spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
        if d >= depth or not len(spread):
            nodes[at] = (-1, 0.0, -1, -1, d + length(len(rows)))
            return at
        f = int(rng.choice(spread))
        cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        left = rows[:, f] < cut
        nodes[at] = (f, cut, add(rows[left], d + 1), add(rows[~left], d + 1), 0.0)
        return at

    add(x, 0)
    return nodes


def anomalies(sessions: DataFrame, trees: int = 64, sample: int = 256, share: float = 0.05, seed: int = 7) -> DataFrame:
    """Isolation forest (Liu, Ting and Zhou 2008): each tree is grown by a task from at most ``sample`` sampled rows; the
    trees, of bounded size, are broadcast and every session is scored; the share with the highest scores is returned."""
    d = _measures(sessions)
    n = d.count()
    if n < 10:
        return d.limit(0).select("user_id", "task_id", "seq", F.lit(0.0).alias("score"))
    chance = int(min(1.0, 2 * sample / n) * 1_000_000)
    # A row's trees are drawn first, so only sampled rows are multiplied.
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(t, "user_id", "task_id", "seq", F.lit(seed)), F.lit(1_000_000)) < chance)
    rows = d.withColumn("_trees", drawn).where(F.size("_trees") > 0).select(F.explode("_trees").alias("tree"), "user_id", "task_id", "seq", *MEASURES)

    def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(["user_id", "task_id", "seq"])[MEASURES].to_numpy(float)
        rng = np.random.default_rng(seed * 1000 + int(key[0]))
        x = x[rng.permutation(len(x))[:sample]]
        nodes = _grow(x, rng, int(np.ceil(np.log2(max(len(x), 2)))))
        return pd.DataFrame([(int(key[0]), i, *node, len(x)) for i, node in enumerate(nodes)], columns=["tree", "node", "f", "cut", "a", "b", "path", "m"])

    grown = rows.groupBy("tree").applyInPandas(grow, "tree int, node int, f int, cut double, a int, b int, path double, m int").toPandas()
    forest = [g.sort_values("node") for _, g in grown.groupby("tree")]
    shared = d.sparkSession.sparkContext.broadcast([tuple(g[c].to_numpy() for c in ("f", "cut", "a", "b", "path")) + (int(g["m"].iloc[0]),) for g in forest])

    def score(batches):
        for pdf in batches:
            x = pdf[MEASURES].to_numpy(float)
            total = np.zeros(len(x))
            for f, cut, a, b, path, m in shared.value:
                at = np.zeros(len(x), np.int64)
                while (f[at] >= 0).any():
                    go = f[at] >= 0
                    left = x[np.arange(len(x)), np.maximum(f[at], 0)] < cut[at]
                    at = np.where(go, np.where(left, a[at], b[at]), at)
                norm = 2 * (np.log(max(m - 1, 1)) + 0.5772156649) - 2 * (m - 1) / max(m, 1)
                total += path[at] / max(norm, 1e-9)
            yield pdf[["user_id", "task_id", "seq"]].assign(score=np.round(2 ** -(total / len(shared.value)), 6))

    s = d.mapInPandas(score, "user_id long, task_id long, seq long, score double")
    cut = quantiles(s, "score", {"cut": 1 - share})
    return s.crossJoin(F.broadcast(cut)).where(F.col("score") >= F.col("cut")).drop("cut")  # one row


def all_patterns(*found: DataFrame) -> DataFrame:
    """(id, kind, subject, value) of every kind of pattern; the id is a digest of kind and subject, so it stays the same."""
    d = reduce(DataFrame.unionByName, found)
    return d.select(F.substring(F.sha2(F.concat_ws("|", "kind", "subject"), 256), 1, 12).alias("id"), "kind", "subject", "value")
