"""Splits, model fits with MLlib, evaluation by distributed aggregates, calibration and attributions."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..sources.tables import scratch_path, stored
from .stats import quantiles


def temporal_split(df: DataFrame, order: str, key: str, share: float = 0.8) -> DataFrame:
    """The first floor(n * share) dated rows by time and key are train, the rest test; rows without a time are
    ``undated``. Rows that agree in time and key are told apart by a hash of the whole row, so each row stays one.

    Two reads find the cut: counts by day, then, for the cut's day, counts by instant and key, which are kept and summed by
    second, instant and key. Only if the cut falls among rows of one time and key are these ranked."""
    day = 86_400_000_000
    d = df.withColumn("_t", F.unix_micros(F.col(order).cast("timestamp")))

    def cut(counts: DataFrame, unit: Column, left: Column) -> tuple | None:
        """The last unit (in order) before which at most ``left`` rows lie, how many do, its rows, and ``left``."""
        n = counts.groupBy(unit.alias("u")).agg(F.sum("n").alias("n"))  # days, seconds of one, instants of one, or its keys
        first = Window.orderBy("u").rowsBetween(Window.unboundedPreceding, -1)
        n = n.withColumns({"before": F.coalesce(F.sum("n").over(first), F.lit(0)), "left": left.cast("long")})
        return n.where(F.col("before") <= F.col("left")).agg(F.max_by(F.struct("u", "before", "n", "left"), F.struct("before", "n")).alias("x")).first()["x"]

    days = d.where("_t IS NOT NULL").groupBy(F.floor(F.col("_t") / day).alias("day")).agg(F.count("*").alias("n"))
    at = cut(days, F.col("day"), F.floor(F.sum("n").over(Window.partitionBy()) * share))
    if at is None:
        return df.withColumn("split", F.lit("undated"))
    inside = (F.col("_t") >= at["u"] * day) & (F.col("_t") < (at["u"] + 1) * day)
    counts = stored(d.where(inside).groupBy("_t", F.col(key).alias("_key")).agg(F.count("*").alias("n")), "cut")
    left = at["left"] - at["before"]
    second = cut(counts, F.floor(F.col("_t") / 1_000_000), F.lit(left))
    counts, left = counts.where(F.floor(F.col("_t") / 1_000_000) == second["u"]), left - second["before"]
    instant = cut(counts, F.col("_t"), F.lit(left))
    counts, left = counts.where(F.col("_t") == instant["u"]), left - instant["before"]
    tied = cut(counts, F.col("_key"), F.lit(left))
    left -= tied["before"]
    edge = F.lit(tied["u"]).cast(dict(df.dtypes)[key])
    then = F.col("_t") == instant["u"]
    at_edge = F.coalesce(then & F.col(key).eqNullSafe(edge), F.lit(False))
    less = F.lit(False) if tied["u"] is None else F.col(key).isNull() | (F.col(key) < edge)  # a null key is the first
    train = (F.col("_t") < instant["u"]) | (then & less)
    named = lambda d, edge_train: d.withColumn("split", F.when(F.col("_t").isNull(), "undated").when(train | (at_edge & edge_train), "train").otherwise("test")).drop("_t")
    if left in (0, tied["n"]):
        return named(d, F.lit(left > 0))
    rank = Window.partitionBy("_t").orderBy(F.xxhash64(*df.columns), *[c for c, kind in df.dtypes if not kind.startswith(("map", "array", "struct"))])
    ranked = d.where(at_edge).withColumn("_n", F.row_number().over(rank))
    return named(d.where(~at_edge), F.lit(False)).unionByName(named(ranked, F.col("_n") <= left).drop("_n"))


def chronological_split(df: DataFrame, date: str, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """By distinct dates, which are few: the first share train, the next validation, the rest test; rows without a date
    are ``undated``."""
    days = df.select(F.to_date(date).alias("_day")).where("_day IS NOT NULL").distinct()
    k = F.row_number().over(Window.orderBy("_day"))
    n = F.count("*").over(Window.partitionBy())
    named = days.withColumns({"_k": k, "_n": n}).select("_day", F.when(F.col("_k") <= F.floor(F.col("_n") * train), "train").when(F.col("_k") <= F.floor(F.col("_n") * train) + F.floor(F.col("_n") * val), "val").otherwise("test").alias("split"))
    return df.withColumn("_day", F.to_date(date)).join(named, "_day", "left").drop("_day").withColumn("split", F.coalesce("split", F.lit("undated")))


def split_summary(df: DataFrame, date: str, label: str) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"), F.min(F.to_date(date)).alias("first"), F.max(F.to_date(date)).alias("last"), r6(F.avg(label)).alias("rate"))


def split_audit(df: DataFrame, date: str) -> DataFrame:
    """Whether the splits' dates are ordered and disjoint, and how many users more than one split has."""
    d = df.groupBy("split").agg(F.min(F.to_date(date)).alias("a"), F.max(F.to_date(date)).alias("b"))
    at = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c)))
    dates = d.agg((at("train", "b") < at("val", "a")).alias("train_before_val"), (at("val", "b") < at("test", "a")).alias("val_before_test"))
    users = df.groupBy("user_id").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("shared_users"))
    return dates.crossJoin(users)  # one row each


def walk_forward(df: DataFrame, date: str, k: int = 5, gap: int = 0) -> DataFrame:
    """(fold, role, day): test windows of n // (k + 1) dates in turn, training on all dates before, less ``gap``."""
    days = df.select(F.to_date(date).alias("day")).distinct()
    d = days.withColumns({"i": F.row_number().over(Window.orderBy("day")) - 1, "n": F.count("*").over(Window.partitionBy())})
    d = d.withColumn("size", F.floor(F.col("n") / (k + 1))).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    start = F.col("fold") * F.col("size")
    end = F.when(F.col("fold") == k, F.col("n")).otherwise(start + F.col("size"))
    role = F.when(F.col("i") < start - gap, "train").when((F.col("i") >= start) & (F.col("i") < end), "test")
    return d.select("fold", role.alias("role"), "day").where("role IS NOT NULL")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (2 * rows of the class), as ``weight``."""
    n = df.groupBy(label).agg(F.count("*").alias("_c"))
    total = df.agg(F.count("*").alias("_n"))
    return df.join(F.broadcast(n), label).crossJoin(F.broadcast(total)).withColumn("weight", F.col("_n") / (2 * F.col("_c"))).drop("_c", "_n")  # two classes, one row


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The commonest value of each column, the smallest of equally common ones."""
    out = {}
    for c in columns:
        top = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").first()
        out[c] = top["v"] if top else ""
    return out


def preprocess(df: DataFrame, categorical: list[str], numeric: list[str], scale: bool = True) -> list:
    """Median and mode imputation, optional scaling and one-hot encoding that tolerates unknown values."""
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}_i" for c in numeric])]
    if categorical:
        filled = ", ".join(f"coalesce(cast(`{c}` as string), '{v.replace(chr(39), chr(39) * 2)}') AS `{c}_f`" for c, v in modes(df, categorical).items())
        stages += [SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")]
        stages += [StringIndexer(inputCols=[f"{c}_f" for c in categorical], outputCols=[f"{c}_k" for c in categorical], handleInvalid="keep")]
        stages += [OneHotEncoder(inputCols=[f"{c}_k" for c in categorical], outputCols=[f"{c}_v" for c in categorical], handleInvalid="keep")]
    stages += [VectorAssembler(inputCols=[f"{c}_i" for c in numeric], outputCol="_numbers")]
    stages += [StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True)] if scale else []
    return stages + [VectorAssembler(inputCols=["_scaled" if scale else "_numbers", *[f"{c}_v" for c in categorical]], outputCol="features")]


def majority(train: DataFrame, label: str) -> DataFrame:
    """The constant prediction: the commonest label, the smaller of equally common ones, and its rate of positives."""
    n = train.groupBy(label).agg(F.count("*").alias("n"))
    return n.agg(F.max_by(label, F.struct("n", -F.col(label))).alias("label"), r6(F.sum(F.col(label) * F.col("n")) / F.sum("n")).alias("rate"))


def fit(df: DataFrame, categorical: list[str], numeric: list[str], label: str, model: str = "logistic", seed: int = 42, **params) -> PipelineModel:
    """A balanced pipeline: ``logistic``, ``forest`` or ``boosted`` trees; positives of boosted trees weigh rows of class 0
    per row of class 1."""
    common = {"labelCol": label, "weightCol": "weight", "featuresCol": "features"}
    last = {"logistic": lambda: LogisticRegression(**common, maxIter=50, **params), "forest": lambda: RandomForestClassifier(**common, seed=seed, **{"numTrees": 50, "maxDepth": 8} | params), "boosted": lambda: GBTClassifier(**common, seed=seed, **{"maxIter": 20, "maxDepth": 4} | params)}[model]()
    weighted = positive_weights(df, label) if model == "boosted" else class_weights(df, label)
    fitted = Pipeline(stages=preprocess(df, categorical, numeric, model == "logistic") + [last]).fit(weighted)
    return PipelineModel([*fitted.stages[:-1], unbound(fitted.stages[-1], df)])


def unbound(model, df: DataFrame):
    """The model as it is saved, without the summary of its training: that holds the session, which Spark can't send to
    tasks together with the model once the session has had an ``Observation``."""
    if not getattr(model, "hasSummary", False):
        return model
    path = scratch_path(df.sparkSession, "model")
    model.write().save(path)
    return type(model).load(path)


def positive_weights(df: DataFrame, label: str) -> DataFrame:
    """Negatives weigh 1, positives negatives / positives, as ``weight``."""
    pos = F.count_if(F.col(label) == 1)
    ratio = df.agg(F.when(pos > 0, (F.count("*") - pos) / pos).otherwise(1.0).alias("_w"))
    return df.join(F.broadcast(ratio)).withColumn("weight", F.when(F.col(label) == 1, F.col("_w")).otherwise(1.0)).drop("_w")  # one row


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``p``, the probability of class 1, and its band."""
    d = model.transform(df).withColumn("p", vector_to_array("probability")[1])
    return d.withColumn("band", risk_band(F.col("p")))


def risk_band(p: Column) -> Column:
    return F.when(p < 0.33, "LOW").when(p < 0.66, "MEDIUM").otherwise("HIGH")


def confusion(df: DataFrame, label: str, p: str, threshold: float = 0.5, *keys: str) -> DataFrame:
    yes, pos = F.col(p) >= threshold, F.col(label) == 1
    d = df.groupBy(*keys).agg(F.count_if(yes & pos).alias("tp"), F.count_if(yes & ~pos).alias("fp"), F.count_if(~yes & pos).alias("fn"), F.count_if(~yes & ~pos).alias("tn"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return d.withColumns({"accuracy": r6(div(tp + tn, tp + fp + fn + tn)), "precision": r6(div(tp, tp + fp)), "recall": r6(div(tp, tp + fn)), "f1": r6(div(2 * tp, 2 * tp + fp + fn)), "specificity": r6(div(tn, tn + fp))})


def _met(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys of which null is one value."""
    b = b.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return a.join(b, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])).drop(*[f"_k_{k}" for k in keys])


def ranking_quality(df: DataFrame, label: str, p: str, *keys: str, ranges: int = 1024) -> DataFrame:
    """ROC-AUC with ties, average precision and Brier score, exact: sums over distinct scores in order. Scores are dealt to
    ranges of equal width, whose sums give each its offset, so no task orders more than a range of a key. Rows without a
    score or a label count in none of them; a null key is a group."""
    df = df.where(F.col(p).isNotNull() & F.col(label).isNotNull())
    c = df.groupBy(*keys, F.col(p).alias("_s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"), F.sum((F.col(p) - F.col(label)) ** 2).alias("sq"))
    c = c.withColumn("_r", F.floor(F.col("_s") * ranges))
    part = c.groupBy(*keys, "_r").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    w = Window.partitionBy(*keys)
    above = w.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*keys, "_r", *[F.coalesce(F.sum(x).over(above), F.lit(0)).alias(f"{x}_off") for x in ("_pos", "_neg")], F.sum("_pos").over(w).alias("P"), F.sum("_neg").over(w).alias("N"))
    down = Window.partitionBy(*keys, "_r").orderBy(F.desc("_s"))
    c = _met(c, part, [*keys, "_r"]).withColumns({"tp": F.sum("pos").over(down) + F.col("_pos_off"), "fp": F.sum("neg").over(down) + F.col("_neg_off")})
    below = F.col("N") - F.col("fp")
    return c.groupBy(*keys).agg(r6(F.sum(F.col("pos") * (below + F.col("neg") / 2)) / F.max(F.nullif(F.col("P") * F.col("N"), F.lit(0)))).alias("roc_auc"), r6(F.sum(F.col("pos") / F.nullif(F.col("P"), F.lit(0)) * F.col("tp") / (F.col("tp") + F.col("fp")))).alias("average_precision"), r6(F.sum("sq") / F.sum(F.col("pos") + F.col("neg"))).alias("brier"))


def tune_threshold(df: DataFrame, label: str, p: str, metric: str = "f1") -> DataFrame:
    """181 thresholds from .05 to .95: the first with the best f1, recall, precision or accuracy. Counts go by
    half-percent bins of the score."""
    bins = df.groupBy(F.floor(F.round(F.col(p) * 200, 6)).cast("int").alias("b")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count("*").alias("n"))
    t = df.sparkSession.range(10, 191).select(F.col("id").cast("int").alias("t"))
    c = t.join(F.broadcast(bins), F.col("b") >= F.col("t"), "left").groupBy("t").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("yes"))  # at most 201 rows
    total = bins.agg(F.sum("pos").alias("P"), F.sum("n").alias("all"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, yes, P = F.col("tp"), F.col("yes"), F.col("P")
    value = {"f1": div(2 * tp, yes + P), "recall": div(tp, P), "precision": div(tp, yes), "accuracy": div(tp + F.col("all") - yes - P + tp, F.col("all"))}[metric]
    c = c.crossJoin(F.broadcast(total)).withColumn(metric, r6(value))
    return c.agg(F.max_by(F.col("t") / 200, F.struct(metric, -F.col("t"))).alias("threshold"), F.max(metric).alias(metric))


def calibration_error(df: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    """Weighted gap of mean score and rate in quantile bins."""
    names = {f"q{i}": i / bins for i in range(1, bins)}
    edges = quantiles(df, p, names).select(F.array(*names).alias("e"))
    d = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("e", lambda e: F.col(p) > e)))  # one row
    g = d.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("m"), F.avg(label).alias("y"))
    return g.agg(r6(F.sum(F.col("n") * F.abs(F.col("m") - F.col("y"))) / F.sum("n")).alias("ece"))


def evaluate(df: DataFrame, label: str, p: str, *keys: str, threshold: float = 0.5) -> DataFrame:
    """Ranking quality, F1 at a threshold, rows and rate of positives, by any keys."""
    f1 = confusion(df, label, p, threshold, *keys).select(*keys, "f1")
    n = df.groupBy(*keys).agg(F.count("*").alias("rows"), r6(F.avg(label)).alias("positive_rate"))
    q = ranking_quality(df, label, p, *keys)
    return _met(_met(q, f1, [*keys]), n, [*keys]) if keys else q.crossJoin(f1).crossJoin(n)  # one row each


def select_model(metrics: DataFrame) -> DataFrame:
    """The model of the best average precision, then ROC-AUC, then F1; metrics should be those of the validation split."""
    return metrics.agg(F.max_by("model", F.struct("average_precision", "roc_auc", "f1", "model")).alias("model"))


def segments(df: DataFrame, label: str, models: dict[str, str], of: dict[str, Column], least: int = 10) -> DataFrame:
    """Quality of each model (name: its score's column) in each segment (name: its condition) of at least so many rows.
    A row meets the segments that it is in as an array, so the table is read once."""
    named = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in of.items()]))
    scores = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("p")) for m, c in models.items()])
    d = df.select(F.col(label).alias("y"), F.explode(named).alias("segment"), scores.alias("s")).select("y", "segment", F.explode("s").alias("s")).select("y", "segment", "s.model", "s.p")
    return evaluate(d, "y", "p", "segment", "model").where(F.col("rows") >= least)


def compare_models(metrics: DataFrame, metric: str) -> DataFrame:
    """Every pair of models: the difference of a metric, its share of the second's in percent, and the better one."""
    a, b = (metrics.select(F.col("model").alias(f"model_{x}"), F.col(metric).alias(x)) for x in "ab")
    diff = F.col("a") - F.col("b")
    return a.join(b, F.col("model_a") < F.col("model_b")).select("model_a", "model_b", F.round(diff, 5).alias("difference"), F.when(F.col("b") != 0, F.round(diff / F.col("b") * 100, 3)).alias("percent_improvement"), F.when(diff > 0, F.col("model_a")).otherwise(F.col("model_b")).alias("better"))  # models are few


def cross_validate(df: DataFrame, date: str, label: str, fit_score, k: int = 5, gap: int = 0) -> DataFrame:
    """Metrics of walk-forward folds: ``fit_score(train, test)`` gives test rows with p. One row a fold."""
    folds = walk_forward(df, date, k, gap)
    out = []
    for fold in range(1, k + 1):
        days = folds.where(F.col("fold") == fold).select("role", F.col("day").alias("_day"))
        d = df.withColumn("_day", F.to_date(date)).join(F.broadcast(days), "_day").drop("_day")  # a row for each date
        scored = fit_score(d.where("role = 'train'").drop("role"), d.where("role = 'test'").drop("role"))
        out.append(evaluate(scored, label, "p").withColumn("fold", F.lit(fold)))
    return reduce(DataFrame.unionByName, out)


def cv_summary(folds: DataFrame, metrics: tuple[str, ...] = ("roc_auc", "average_precision", "brier", "f1")) -> DataFrame:
    """Mean, deviation (of the population) and bounds of each metric over the folds."""
    d = folds.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("x")).select("x.metric", "x.v")
    return d.groupBy("metric").agg(F.count("v").alias("folds"), r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v")).alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))


def calibrate(val: DataFrame, label: str, p: str, to: DataFrame) -> DataFrame:
    """Isotonic and sigmoid calibration fitted on ``val``; both added to ``to``."""
    iso = IsotonicRegression(featuresCol="_f", labelCol=label, predictionCol="p_isotonic")
    sig = LogisticRegression(featuresCol="_f", labelCol=label, probabilityCol="_sp", rawPredictionCol="_sr", predictionCol="_sy")
    a = VectorAssembler(inputCols=[p], outputCol="_f")
    v, t = a.transform(val), a.transform(to)
    d = unbound(sig.fit(v), v).transform(iso.fit(v).transform(t))
    return d.withColumn("p_sigmoid", vector_to_array("_sp")[1]).drop("_f", "_sp", "_sr", "_sy")


def best_calibration(val: DataFrame, label: str, p: str) -> DataFrame:
    """(method, brier): raw, isotonic and sigmoid scores on ``val``, the best first; a calibration is taken only if it is
    better than the raw score."""
    d = calibrate(val, label, p, val)
    sq = lambda c: F.avg((F.col(c) - F.col(label)) ** 2)
    row = d.agg(sq(p).alias("raw"), sq("p_isotonic").alias("isotonic"), sq("p_sigmoid").alias("sigmoid"))
    of = row.select(F.explode(F.array(*[F.struct(F.col(m).alias("brier"), F.lit(i).alias("o"), F.lit(m).alias("method")) for i, m in enumerate(("raw", "isotonic", "sigmoid"))])).alias("x")).select("x.*")
    return of.withColumn("chosen", F.row_number().over(Window.orderBy("brier", "o")) == 1).select("method", r6(F.col("brier")).alias("brier"), "chosen")  # three rows


def apply_calibration(best: DataFrame, scored: DataFrame, p: str = "p") -> DataFrame:
    """Add p_calibrated, the score of the chosen method, to rows that ``calibrate`` has scored."""
    chosen = best.where("chosen").select("method")
    value = F.when(F.col("method") == "isotonic", F.col("p_isotonic")).when(F.col("method") == "sigmoid", F.col("p_sigmoid")).otherwise(F.col(p))
    return scored.join(F.broadcast(chosen)).withColumn("p_calibrated", value).drop("method")  # one row


def model_importance(model: PipelineModel, df: DataFrame, features: str = "features") -> DataFrame:
    """(feature, importance) of a tree model's own importances, or the absolute coefficients of a linear one, by the
    columns that ``fit`` was given; a category is column=value."""
    last = model.stages[-1]
    values = (last.featureImportances if hasattr(last, "featureImportances") else last.coefficients).toArray()
    attrs = model.transform(df).schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    inputs = {x.getOutputCol(): x.getInputCols() for x in model.stages if isinstance(x, VectorAssembler)}
    for c in inputs.get(features, []):
        names = {i: n.replace(f"{c}_", f"{c.removesuffix('_v')}=", 1) if n.startswith(f"{c}_") and c.endswith("_v") else n for i, n in names.items()}
    names |= {i: c.removesuffix("_i") for i, c in enumerate(inputs.get("_numbers", []))}  # come first
    return df.sparkSession.createDataFrame([(names.get(i, f"f{i}"), float(abs(v))) for i, v in enumerate(values)], "feature string, importance double")


def score_and_write(model: PipelineModel, df: DataFrame, weights: dict[str, float], path: str, key: str, k: int = 3) -> None:
    """Score rows, join their reasons with bars and write them as Parquet."""
    out = contributions(score(model, df), weights, k)
    joined = F.array_join(F.transform("reasons", lambda x: F.concat_ws(" ", x["feature"], x["direction"])), " | ")
    out.select(key, "p", "band", joined.alias("reasons")).write.mode("overwrite").parquet(path)


def contributions(df: DataFrame, weights: dict[str, float], k: int = 3) -> DataFrame:
    """Linear attributions weight * (value - mean): the k largest of each row, with their direction."""
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in weights])
    d = df.crossJoin(F.broadcast(means))  # one row
    parts = F.array(*[F.struct(F.abs(w * (F.col(c) - F.col(f"_m_{c}"))).alias("size"), F.lit(c).alias("feature"), (w * (F.col(c) - F.col(f"_m_{c}"))).alias("value")) for c, w in weights.items()])
    top = F.slice(F.reverse(F.array_sort(F.filter(parts, lambda x: x["size"].isNotNull()))), 1, k)
    return d.withColumn("reasons", F.transform(top, lambda x: F.struct(x["feature"].alias("feature"), F.round(x["value"], 6).alias("value"), F.when(x["value"] > 0, "raises").otherwise("lowers").alias("direction")))).drop(*[f"_m_{c}" for c in weights])


def global_importance(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Mean absolute attribution of each feature."""
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in weights])
    row = df.crossJoin(F.broadcast(means)).agg(*[F.avg(F.abs(w * (F.col(c) - F.col(f"_m_{c}")))).alias(c) for c, w in weights.items()])  # one row
    return row.select(F.explode(F.create_map(*chain(*[(F.lit(c), F.col(c)) for c in weights]))).alias("feature", "importance")).withColumn("importance", r6(F.col("importance")))


def precision_at(df: DataFrame, k: int) -> DataFrame:
    """precision@k and recall@k of rows with ``ranked`` and ``relevant`` arrays."""
    top = F.slice("ranked", 1, k)
    hits = F.size(F.array_intersect(top, "relevant"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return df.withColumns({"precision": r6(div(hits, F.size(top))), "recall": r6(div(hits, F.size("relevant")))})
