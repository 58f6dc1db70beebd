"""Statistics by any keys; quantiles are interpolated and exact, deviations are those of a sample.

Ranks and quantiles come from counts of distinct values, dealt to ranges of values; sums over the ranges give each its
offset, so no task orders more than one range of one key."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import r6


def _clean(c: Column) -> Column:
    """A correlation of constants is null."""
    return F.when(~F.isnan(c), c)


def ranked_counts(df: DataFrame, value: str, *keys: str, ranges: int = 64) -> DataFrame:
    """(keys, _v, _n, _below, _total): each distinct value's rows, the key's rows with smaller ones, and all of them.

    Ranges are cut at approximate quantiles of all values, ``ranges`` numbers; any cut gives exact counts."""
    v = F.col(value).alias("_v")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, v).agg(F.count("*").alias("_n"))
    at = df.agg(F.percentile_approx(value, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(1000)).alias("q")).first()["q"] or []
    cuts = F.array(*[F.lit(x) for x in sorted(set(at))]).cast(f"array<{dict(df.dtypes)[value]}>")
    c = counts.withColumn("_r", F.size(F.filter(cuts, lambda x: x < F.col("_v"))))
    part = c.groupBy(*keys, "_r").agg(F.sum("_n").alias("_s"))
    w = Window.partitionBy(*keys)
    part = part.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_r").alias("_k_r"), F.coalesce(F.sum("_s").over(w.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"), F.sum("_s").over(w).alias("_total"))
    on = F.col("_r") == F.col("_k_r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    before = F.sum("_n").over(Window.partitionBy(*keys, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1))
    return c.join(part, on).select(*keys, "_v", "_n", (F.col("_off") + F.coalesce(before, F.lit(0))).alias("_below"), "_total")


def quantiles(df: DataFrame, value: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """Interpolated quantiles of each key, exact, named as in ``shares``."""
    r = ranked_counts(df, value, *keys)

    def at(p: float) -> Column:
        pos = (F.col("_total").cast("double") - 1) * p
        have = lambda x: (F.col("_below") <= x) & (x < F.col("_below") + F.col("_n"))
        low = F.max(F.when(have(F.floor(pos)), F.col("_v").cast("double")))
        high = F.max(F.when(have(F.ceil(pos)), F.col("_v").cast("double")))
        return low + (high - low) * F.max(pos - F.floor(pos))

    return r.groupBy(*keys).agg(*[at(p).alias(name) for name, p in shares.items()])


def _beside(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Join by keys that may be null; one row each without keys."""
    if not keys:
        return a.join(F.broadcast(b))
    on = [a[k].eqNullSafe(b[k]) for k in keys]
    return a.join(b, reduce(lambda x, y: x & y, on)).drop(*[b[k] for k in keys])


def distribution(df: DataFrame, value: str, *keys: str) -> DataFrame:
    n = F.count(value)
    level = F.when(n >= 30, "HIGH").when(n >= 10, "MEDIUM").otherwise("LOW")
    plain = df.groupBy(*keys).agg(n.alias("n"), r6(F.avg(value)).alias("mean"), r6(F.stddev_samp(value)).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"), level.alias("confidence"))
    q = quantiles(df, value, {"median": 0.5, "q25": 0.25, "q75": 0.75}, *keys)
    return _beside(plain, q.withColumn("iqr", F.col("q75") - F.col("q25")).withColumns({c: r6(F.col(c)) for c in ("median", "q25", "q75", "iqr")}), *keys)


def correlations(df: DataFrame, columns: list[str], ranked: bool = False) -> DataFrame:
    """Upper triangle of the correlation matrix, on rows where both are set; ``ranked``: of average ranks (Spearman).

    Ranks come from ``ranked_counts``."""
    for c in columns if ranked else []:
        df = df.join(ranked_counts(df, c).select(F.col("_v").alias(c), (F.col("_below") + (F.col("_n") + 1) / 2).alias(f"_r_{c}")), c, "left")
    of = {c: F.col(f"_r_{c}" if ranked else c).cast("double") for c in columns}
    pairs = list(combinations(columns, 2))
    row = df.agg(*[_clean(F.corr(of[a], of[b])).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r6(F.col(f"_{i}")).alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def inversions(first: np.ndarray, second: np.ndarray, weight: np.ndarray) -> float:
    """Weight of the pairs in opposite order: larger in ``first`` and smaller in ``second``; ties in either don't count.

    In the order of ``first``, two ranks of ``second`` part at one bit: at each, zeros that follow ones are counted."""
    order = np.lexsort((second, first))
    rank, w = np.unique(second, return_inverse=True)[1][order], weight[order].astype(float)
    total = 0.0
    for bit in range(int(rank.max(initial=0)).bit_length()):
        at = np.argsort(rank >> (bit + 1), kind="stable")
        group, one, n = rank[at] >> (bit + 1), (rank[at] >> bit & 1).astype(bool), w[at]
        ones = np.cumsum(np.where(one, n, 0.0))
        start = np.searchsorted(group, group)
        total += float((np.where(one, 0.0, n) * (ones - np.where(start > 0, ones[start - 1], 0.0))).sum())
    return total


def kendall(df: DataFrame, columns: list[str], ranges: int = 64) -> DataFrame:
    """Upper triangle of Kendall's tau-b, (a, b, r), on rows where both are set and no NaN; null where one is constant.

    Pairs of rows in opposite order are counted over ranges of values, cut at approximate quantiles, where any cut gives
    the exact count: within each range of the first column, within each range of the second between different ranges of
    the first, and between cells of both, of which there are (2 * ranges + 1)**2 at most. A value that is a cut is a range
    of its own and all ties, so common values make no large task. ``ranges`` grows with the rows: a task sorts about
    1 / ranges of the distinct pairs of values."""
    whole = {"tinyint", "smallint", "int", "bigint"}
    d = df.select(*[F.col(c).cast("long" if t in whole else "double").alias(c) for c, t in df.dtypes if c in columns])
    d = d.select(*[c if dict(d.dtypes)[c] == "bigint" else F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns])
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = d.agg(*[F.percentile_approx(c, shares, F.lit(1000)).alias(c) for c in columns]).first()

    def range_of(c: str, v: str) -> Column:  # even: between two cuts; odd: a cut
        at = F.array(*[F.lit(x) for x in sorted(set(cuts[c] or []))]).cast(f"array<{dict(d.dtypes)[c]}>")
        return 2 * F.size(F.filter(at, lambda x: x < F.col(v))) + F.array_contains(at, F.col(v)).cast("int")

    def opposed(rows: DataFrame, by: Column, x: str, y: str) -> DataFrame:
        def count(t: pa.Table) -> pa.Table:
            return pa.table({"q": [inversions(*(t[c].to_numpy() for c in ("x", "y", "n")))]})

        return rows.select(by.alias("by"), F.col(x).alias("x"), F.col(y).alias("y"), "n").groupBy("by").applyInArrow(count, "q double")

    def tau(a: str, b: str) -> DataFrame:
        c = d.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
        c = c.withColumns({"rx": range_of(a, "x"), "ry": range_of(b, "y")})
        cells = c.groupBy("rx", "ry").agg(F.sum("n").alias("n"))
        strips = c.where("ry % 2 = 0").groupBy("ry", "rx", "y").agg(F.sum("n").alias("n"))
        q = opposed(c.where("rx % 2 = 0"), F.col("rx"), "x", "y").unionByName(opposed(strips, F.col("ry"), "rx", "y")).unionByName(opposed(cells, F.lit(0), "rx", "ry"))
        two = lambda n: F.coalesce(F.sum(F.col(n).cast("double") * (F.col(n) - 1) / 2), F.lit(0.0))
        ties = lambda k, name: c.groupBy(k).agg(F.sum("n").alias("n")).agg(two("n").alias(name))
        row = c.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("m"), two("n").alias("both"))
        for one in (ties("x", "tx"), ties("y", "ty"), q.agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("q"))):
            row = row.crossJoin(F.broadcast(one))  # one row each
        pairs = F.col("m") * (F.col("m") - 1) / 2
        score = pairs - F.col("tx") - F.col("ty") + F.col("both") - 2 * F.col("q")
        return row.select(F.lit(a).alias("a"), F.lit(b).alias("b"), r6(F.try_divide(score, F.sqrt(pairs - F.col("tx")) * F.sqrt(pairs - F.col("ty")))).alias("r"))

    return reduce(DataFrame.unionByName, [tau(a, b) for a, b in combinations(columns, 2)])


def trend(series: DataFrame, day: str, value: str, *keys: str, least: int = 5) -> DataFrame:
    """Least-squares line against days since the first, with direction and confidence; too few points give nulls."""
    first = series.groupBy(*keys).agg(F.min(day).alias("_first"))
    d = series.join(first, list(keys)) if keys else series.crossJoin(F.broadcast(first))  # one row
    x, y = F.datediff(day, "_first").cast("double"), F.col(value).cast("double")
    n, slope, r2 = F.count(y), F.regr_slope(y, x), F.regr_r2(y, x)
    ok = n >= least
    out = d.groupBy(*keys).agg(n.alias("n"), F.when(ok, r6(slope)).alias("slope"), F.when(ok, r6(F.regr_intercept(y, x))).alias("intercept"), F.when(ok, r6(r2)).alias("r2"))
    way = F.when(F.col("slope").isNull(), "insufficient").when(F.abs("slope") < 0.001, "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    return out.withColumns({"direction": way, "confidence": F.when((F.col("n") >= 30) & (F.col("r2") > 0.5), "HIGH").when((F.col("n") >= 10) & (F.col("r2") > 0.3), "MEDIUM").otherwise("LOW")})


def compare(df: DataFrame, value: str, group: Column) -> DataFrame:
    """Two groups, ``group`` true and false: differences and Cohen's d with its label."""
    a, b = F.when(group, F.col(value)), F.when(~group, F.col(value))
    d = df.agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    mid = quantiles(df.where(group.isNotNull()).select(group.alias("_g"), value), value, {"m": 0.5}, "_g")
    d = d.join(F.broadcast(mid.agg(F.max(F.when(F.col("_g"), F.col("m"))).alias("d1"), F.max(F.when(~F.col("_g"), F.col("m"))).alias("d2"))))  # one row
    pooled = F.sqrt((F.col("v1") + F.col("v2")) / 2)
    cohen = F.when(pooled > 0, (F.col("m1") - F.col("m2")) / pooled).otherwise(0.0)
    size = F.when(F.abs(cohen) < 0.2, "negligible").when(F.abs(cohen) < 0.5, "small").when(F.abs(cohen) < 0.8, "medium").otherwise("large")
    return d.select("n1", "n2", r6(F.col("m1") - F.col("m2")).alias("mean_difference"), r6(F.col("d1") - F.col("d2")).alias("median_difference"), r6(cohen).alias("cohens_d"), size.alias("effect"))


def percentile_rank(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Share of the key's values strictly below, times 100, and its band."""
    r = ranked_counts(df, value, *keys).select(*keys, F.col("_v").alias(value), (F.col("_below") / F.col("_total") * 100).alias("_x"))
    d = _beside(df, r, *keys, value)
    x = F.col("_x")
    band = F.when(x >= 75, "top").when(x >= 50, "above_average").when(x >= 25, "below_average").otherwise("bottom")
    return d.withColumns({"rank": r6(x), "band": band}).drop("_x")


def moving_averages(series: DataFrame, order: str, value: str, *keys: str, windows: tuple[int, ...] = (7, 14, 30)) -> DataFrame:
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    return series.withColumns({f"ma_{k}": F.when(n >= k, r6(F.avg(value).over(w.orderBy(order).rowsBetween(1 - k, 0)))) for k in windows})


def outliers(df: DataFrame, value: str, method: str = "iqr", times: float = 1.5) -> DataFrame:
    """Rows outside the quartiles by ``times`` their distance, or with a z-score above ``times``."""
    if method == "iqr":
        spread = times * (F.col("b") - F.col("a"))
        b = quantiles(df, value, {"a": 0.25, "b": 0.75}).select((F.col("a") - spread).alias("_lo"), (F.col("b") + spread).alias("_hi"))
    else:
        b = df.agg((F.avg(value) - times * F.stddev_samp(value)).alias("_lo"), (F.avg(value) + times * F.stddev_samp(value)).alias("_hi"))
    return df.crossJoin(F.broadcast(b)).where((F.col(value) < F.col("_lo")) | (F.col(value) > F.col("_hi"))).drop("_lo", "_hi")  # one row


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-squared over the full grid, zero cells included, and Cramer's V with its label."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o"))
    ra, rb = (cells.groupBy(c).agg(F.sum("o").alias(f"n_{i}")) for i, c in enumerate((a, b)))
    n = cells.agg(F.sum("o").alias("n"))
    # sum over the grid of (o - e)^2 / e = sum of o^2 / e over filled cells - n
    d = cells.join(ra, a).join(rb, b).crossJoin(F.broadcast(n))  # one row
    of = lambda c: F.col(c).cast("double")  # noqa: E731  # o * o * n leaves a long at some million rows
    chi = d.agg((F.sum(of("o") * of("o") * of("n") / (of("n_0") * of("n_1"))) - F.first("n")).alias("chi2"), F.first("n").alias("n"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c"))
    k = F.least("r", "c") - 1
    v = F.when((k > 0) & (F.col("n") > 0), F.sqrt(F.greatest(F.lit(0.0), F.col("chi2")) / (F.col("n") * k))).otherwise(0.0)
    return chi.select(r6(F.col("chi2")).alias("chi2"), r6(v).alias("v"), F.when(v < 0.1, "negligible").when(v < 0.3, "weak").when(v < 0.5, "moderate").otherwise("strong").alias("association"))


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, nulls, rate and band of each column, in one pass."""
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    d = row.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])).alias("x")).select("x.column_name", F.col("_n").alias("rows"), "x.nulls", r6(F.try_divide("x.nulls", "_n")).alias("rate"))
    return d.withColumn("band", F.when(F.col("rate") > 0.2, "high").when(F.col("rate") > 0.05, "medium").when(F.col("rate") > 0.001, "low").otherwise("ok"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null rate, bounds and mean of numeric columns, in one pass."""
    row = df.agg(F.count("*").alias("_n"), *[x for i, c in enumerate(columns) for x in (F.count_if(F.col(c).isNull()).alias(f"_z{i}"), F.min(c).cast("double").alias(f"_a{i}"), F.max(c).cast("double").alias(f"_b{i}"), F.avg(c).alias(f"_m{i}"))])
    return row.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), r6(F.try_divide(f"_z{i}", "_n")).alias("null_rate"), F.col(f"_a{i}").alias("low"), F.col(f"_b{i}").alias("high"), r6(F.col(f"_m{i}")).alias("mean")) for i, c in enumerate(columns)])).alias("x")).select("x.*")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    return reduce(DataFrame.unionByName, [d.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"), F.lit(len(d.columns)).alias("columns")) for name, d in tables.items()])


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows in which each feature is set, the mean over features, and whether it is below 90 %."""
    row = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    mean = sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)
    d = row.select(mean.alias("_m"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in columns])).alias("x"))
    return d.select("x.feature", r6(F.col("x.v")).alias("completeness"), r6(F.col("_m")).alias("mean_completeness"), (F.col("x.v") < 0.9).alias("is_low"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive digest of all rows."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("digest"))


def union(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
