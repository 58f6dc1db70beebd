"""Baskets, association rules and recommendations."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..sources.tables import stored

FEW = 10_000  # rules that every task may hold


def baskets(rows: DataFrame, keys: list[str], item: str, least: int = 2) -> DataFrame:
    """Items of each key, each once and in order, of keys with at least so many rows."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias("items"), F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")


def itemsets(items: DataFrame, support: float) -> DataFrame:
    """(itemset, freq) of all sizes from rows with an ``items`` array, by FP-growth."""
    return FPGrowth(itemsCol="items", minSupport=support, minConfidence=0.0).fit(items.select("items")).freqItemsets.select(F.array_sort("items").alias("itemset"), "freq")


def context_itemsets(rows: DataFrame, support: float) -> DataFrame:
    """(context, itemset, freq, n) of all sizes with ``support`` among their context's n baskets, from (basket_id, context,
    item) rows; contexts of one basket have none, rows without a context are left out.

    Items that are rare in their context are left out first; the others carry their context, so one run of FP-growth
    mines many contexts. It has one least count, so contexts are taken together whose least counts are within twice each
    other: at most one run for every doubling of a context's size."""
    rows = rows.where(F.col("context").isNotNull())
    n = rows.groupBy("context").agg(F.count_distinct("basket_id").alias("n")).where("n >= 2")
    n = n.withColumn("least", F.greatest(F.ceil(F.round(F.col("n") * support, 9)), F.lit(1))).withColumn("band", F.floor(F.log2("least")).cast("int"))
    item = rows.groupBy("context", "item").agg(F.count_distinct("basket_id").alias("f")).join(n, "context").where(F.col("f") >= F.col("least"))
    name = F.concat(F.length("context").cast("string"), F.lit(":"), "context", "item")  # read back by its length
    kept = rows.join(item.select("context", "item", "band"), ["context", "item"]).groupBy("band", "context", "basket_id").agg(F.collect_set(name).alias("items"))
    kept, bands = stored(kept, "context-baskets"), {r["band"]: r["least"] for r in n.groupBy("band").agg(F.min("least").alias("least")).collect()}  # a row for each doubling
    parts = []
    for band, least in sorted(bands.items()):
        baskets_ = kept.where(F.col("band") == band).select("items")
        total = baskets_.count()
        if total:
            parts.append(FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / total), minConfidence=0.0).fit(baskets_).freqItemsets)
    if not parts:
        kinds = dict(rows.dtypes)
        return rows.sparkSession.createDataFrame([], f"context {kinds['context']}, itemset array<{kinds['item']}>, freq long, n long")
    size = lambda x: F.substring_index(x, ":", 1)
    rest = lambda x: F.substr(x, F.length(size(x)) + 2)
    d = reduce(DataFrame.unionByName, parts).withColumn("context", F.left(rest(F.col("items")[0]), size(F.col("items")[0]).cast("int")))
    d = d.select("context", F.array_sort(F.transform("items", lambda x: F.substr(rest(x), size(x).cast("int") + 1))).alias("itemset"), "freq")
    return d.join(n, "context").where(F.col("freq") >= F.col("least")).select("context", "itemset", "freq", "n")


def context_rules(rows: DataFrame, support: float = 0.1, confidence: float = 0.3, lift: float = 1.0) -> DataFrame:
    """Rules of every size within each context: (context, antecedents, consequents, support, confidence, lift, leverage,
    conviction), the measures being those of the context's baskets."""
    return rules(stored(context_itemsets(rows, support), "context-itemsets"), F.col("n"), confidence, lift, "context").drop("n")


def rules(sets: DataFrame, n: int | Column, confidence: float, lift: float = 0.0, *scope: str) -> DataFrame:
    """Every antecedent and consequent of each itemset of any size, with the usual measures, over ``n`` baskets, a number
    or a column of ``sets`` that is the same within a scope; conviction is null where confidence is 1. Subsets are bit
    masks, exploded by their high and then their low bits, so that no array of masks is long."""
    n = F.lit(n) if isinstance(n, int) else n
    bits, low = F.size("itemset"), F.least(F.size("itemset"), F.lit(12))
    upto = lambda k: F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), k).cast("long") - 1)
    wide = sets.where(bits >= 2).withColumn("hi", F.explode(upto(bits - low))).withColumn("lo", F.explode(upto(low)))
    masks = wide.withColumn("m", F.col("hi") * 4096 + F.col("lo")).where((F.col("m") > 0) & (F.col("m") < F.pow(F.lit(2), bits).cast("long") - 1))
    pick = lambda want: F.filter("itemset", lambda x, i: F.call_function("getbit", F.col("m"), i) == want)
    d = masks.select(*scope, pick(1).alias("antecedents"), pick(0).alias("consequents"), "freq", n.alias("n"))
    a = sets.select(*scope, F.col("itemset").alias("antecedents"), F.col("freq").alias("fa"))
    c = sets.select(*scope, F.col("itemset").alias("consequents"), F.col("freq").alias("fc"))
    d = d.join(a, [*scope, "antecedents"]).join(c, [*scope, "consequents"])
    return _measures(d, F.col("n")).drop("n").where((F.col("confidence") >= confidence) & (F.col("lift") >= lift))


def _measures(d: DataFrame, n: Column) -> DataFrame:
    s, conf = F.col("freq") / n, F.col("freq") / F.col("fa")
    sc = F.col("fc") / n
    return d.select(*[c for c in d.columns if c not in ("freq", "fa", "fc")], r6(s).alias("support"), r6(conf).alias("confidence"), r6(conf / sc).alias("lift"), r6(s - F.col("fa") / n * sc).alias("leverage"), r6(F.when(conf < 1, (1 - sc) / (1 - conf))).alias("conviction"))


def pair_rules(rows: DataFrame, support: float, confidence: float, *scope: str) -> DataFrame:
    """One-to-one rules from (basket_id, item) rows, within each scope; pairs are counted by a join on the basket.

    Only items that reach the support take part, so a basket's pairs are those of its frequent items."""
    keys = list(scope)
    n = rows.groupBy(*keys).agg(F.count_distinct("basket_id").alias("n"))
    n = n.where("n >= 2") if keys else n  # a scope with one basket has no rules
    item = rows.groupBy(*keys, "item").agg(F.count("*").alias("f"))
    item = (item.join(n, keys) if keys else item.crossJoin(F.broadcast(n))).where(F.col("f") >= support * F.col("n"))  # one row without a scope
    kept = rows.join(item.select(*keys, "item"), [*keys, "item"])
    a, b = kept.withColumnRenamed("item", "antecedent"), kept.withColumnRenamed("item", "consequent")
    half = a.join(b, [*keys, "basket_id"]).where("antecedent < consequent").groupBy(*keys, "antecedent", "consequent").agg(F.count("*").alias("freq"))  # mirrored once counted
    both = half.unionByName(half.select(*keys, F.col("consequent").alias("antecedent"), F.col("antecedent").alias("consequent"), "freq"))
    fa = item.select(*keys, F.col("item").alias("antecedent"), F.col("f").alias("fa"), "n")
    fc = item.select(*keys, F.col("item").alias("consequent"), F.col("f").alias("fc"))
    d = both.join(fa, [*keys, "antecedent"]).join(fc, [*keys, "consequent"])
    return _measures(d, F.col("n")).drop("n").where((F.col("support") >= support) & (F.col("confidence") >= confidence))


def popularity_rules(rows: DataFrame, *scope: str, support: float = 0.0, confidence: float = 0.0, lift: float = 0.0, weights: DataFrame | None = None) -> DataFrame:
    """Rules without antecedent, within each scope of two baskets or more: support as confidence, lift 1; items that miss
    a threshold have none. With ``weights`` (consequent, weight), also the weighted confidence."""
    n = rows.groupBy(*scope).agg(F.count_distinct("basket_id").alias("n"))
    items = rows.groupBy(*scope, "item").agg(F.count("*").alias("f"))
    d = items.join(n.where("n >= 2"), list(scope)) if scope else items.crossJoin(F.broadcast(n))  # one row
    share = F.col("f") / F.col("n")
    d = d.where((share >= max(support, confidence)) & (F.lit(1.0) >= lift))
    d = d.select(*scope, F.col("item").alias("consequent"), r6(share).alias("support"), r6(share).alias("confidence"), F.lit(1.0).alias("lift"))
    return d if weights is None else weighted_confidence(d, weights, "consequent")


def acceptance_weights(feedback: DataFrame, *keys: str) -> DataFrame:
    """1 + 4 * accepted / (accepted + dismissed); deferred ones don't count."""
    yes, no = F.count_if(F.col("action") == "ACCEPTED"), F.count_if(F.col("action") == "DISMISSED")
    return feedback.groupBy(*keys).agg(yes.alias("accepted"), no.alias("dismissed"), F.when(yes + no > 0, r6(1 + 4 * yes / (yes + no))).otherwise(1.0).alias("weight"))


def weighted_confidence(found: DataFrame, weights: DataFrame, *keys: str) -> DataFrame:
    w = F.least(F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(1.0)), F.lit(5.0))
    return found.join(weights.select(*keys, "weight"), list(keys), "left").withColumn("weighted_confidence", r6(F.col("confidence") * w)).drop("weight")


def general_rules(popular: DataFrame) -> DataFrame:
    """Popularity rules in the form of mined ones: an empty antecedent, which every visit satisfies."""
    more = [c for c in ("context", "weighted_confidence") if c in popular.columns]
    return popular.select(F.array().cast("array<string>").alias("antecedents"), F.array("consequent").alias("consequents"), "support", "confidence", "lift", *more)


def recommend(found: DataFrame, visits: DataFrame, confidence: float = 0.5, support: float = 0.05, lift: float = 1.0, top: int = 5, hidden: DataFrame | None = None) -> DataFrame:
    """Per visit (visit_id, done array): rules (antecedents, consequents, support, confidence, lift, weighted_confidence)
    all of whose antecedents are done, or that have none, and whose consequent isn't; the best rule of each task by lift
    and weighted confidence, without ``hidden`` tasks (visit_id, task), then the best tasks. Where rules and visits have a
    ``context``, only rules of the visit's own count.

    A rule meets visits through its rarest antecedent only, so a common task doesn't fan out. Rules without antecedents
    are read in the order of the ranking, as a threshold algorithm would: a done or hidden task, or one with another rule,
    can cost a visit one place each, so a visit stops after ``top`` more than it has of these, and each context's list is
    cut where the longest visit stops.

    Without hidden tasks, visits to a context with the same tasks done have the same recommendations, which are made once
    for all of them.

    Visits are never broadcast: Spark would judge them by their stored files, in which done tasks are up to a hundred times
    smaller than as rows. Rules with antecedents are, if they are few by their count."""
    scope = ["context"] if "context" in found.columns and "context" in visits.columns else []
    if hidden is None:
        kinds = stored(visits.groupBy(*scope, "done").agg(F.min("visit_id").alias("visit_id")), "kinds")
        best = _recommend(found, kinds, scope, confidence, support, lift, top, None)
        made = [c for c in best.columns if c != "visit_id"]
        lists = best.groupBy("visit_id").agg(F.collect_list(F.struct(*made)).alias("_made"))  # of ``top`` at most
        with_lists = kinds.join(lists.hint("merge"), "visit_id").drop("visit_id")
        d = visits.select("visit_id", *scope, "done").join(with_lists.hint("merge"), [*scope, "done"])
        return d.select("visit_id", F.inline("_made")).select("visit_id", *made)
    return _recommend(found, visits, scope, confidence, support, lift, top, hidden)


def _recommend(found: DataFrame, visits: DataFrame, scope: list[str], confidence: float, support: float, lift: float, top: int, hidden: DataFrame | None) -> DataFrame:
    ok = found.where((F.col("confidence") >= confidence) & (F.col("support") >= support) & (F.col("lift") >= lift))
    ok = ok.withColumn("rid", F.xxhash64(*scope, "antecedents", "consequents")).withColumn("w", F.coalesce("weighted_confidence", "confidence"))
    one = visits.select("visit_id", *scope, "done", F.explode("done").alias("item"))
    seen = one.groupBy(*scope, "item").agg(F.count("*").alias("n"))
    rarest = ok.select("rid", *scope, F.explode("antecedents").alias("item")).join(seen.hint("merge"), [*scope, "item"], "left").groupBy("rid").agg(F.min_by("item", F.struct(F.coalesce("n", F.lit(0)), "item")).alias("item"))
    mined = ok.join(rarest.hint("merge"), "rid")
    few = ok.where(F.size("antecedents") > 0).limit(FEW + 1).count() <= FEW
    met = one.join(F.broadcast(mined) if few else mined.hint("merge"), [*scope, "item"]).where(F.size(F.array_except("antecedents", "done")) == 0)
    columns = ["visit_id", "antecedents", "task", "lift", "w", "support"]
    met = met.select("visit_id", "done", "antecedents", "lift", "w", "support", F.explode("consequents").alias("task")).where(~F.array_contains("done", F.col("task"))).select(*columns)
    rank = Window.partitionBy("visit_id", "task").orderBy(F.desc("lift"), F.desc("w"), F.array_join("antecedents", ","))
    met = stored(met.withColumn("_b", F.row_number().over(rank)).where("_b = 1").select(*columns), "met")
    need = visits.select("visit_id", *scope, "done").join(met.groupBy("visit_id").agg(F.count("*").cast("int").alias("m")).hint("merge"), "visit_id", "left")
    if hidden is not None:
        hidden = stored(hidden.select("visit_id", "task").distinct(), "hidden")
        need = need.join(hidden.groupBy("visit_id").agg(F.count("*").cast("int").alias("h")).hint("merge"), "visit_id", "left")
    need = need.withColumn("stop", F.coalesce("m", F.lit(0)) + (F.lit(0) if hidden is None else F.coalesce("h", F.lit(0))) + top)
    most = need.agg(F.max(F.col("stop") + F.size("done"))).first()[0] or 0
    bare = ok.where(F.size("antecedents") == 0).select(*scope, "lift", "w", "support", F.explode("consequents").alias("task"))
    order = [F.desc("w"), F.desc("lift"), F.desc("support"), "task"]
    # A literal bound, so that each task keeps its first ``most`` rows of a context before the shuffle.
    listed = bare.withColumn("at", F.row_number().over(Window.partitionBy(*(scope or [F.lit(0)])).orderBy(*order))).where(F.col("at") <= most)
    listed = listed.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("at", "task", "w", "lift", "support"))).alias("bare"))
    all_ = need.join(listed, scope) if scope else need.crossJoin(F.broadcast(listed))  # one row of at most ``most``
    open_ = F.slice(F.filter("bare", lambda x: ~F.array_contains("done", x["task"])), F.lit(1), F.col("stop"))
    free = all_.select("visit_id", F.array().cast(dict(ok.dtypes)["antecedents"]).alias("antecedents"), F.explode(open_).alias("x")).select("visit_id", "antecedents", *[F.col(f"x.{c}").alias(c) for c in columns[2:]])
    d = met.unionByName(free).withColumn("_b", F.row_number().over(rank)).where("_b = 1")
    d = d if hidden is None else d.join(hidden.hint("merge"), ["visit_id", "task"], "left_anti")
    d = d.withColumn("position", F.row_number().over(Window.partitionBy("visit_id").orderBy(*order)))
    return d.where(F.col("position") <= top).select("visit_id", "task", "antecedents", "lift", F.col("w").alias("weighted_confidence"), "position")


def hidden_tasks(visits: DataFrame, marks: DataFrame, cooldown_s: int = 3600) -> DataFrame:
    """(visit_id, task): tasks that a show or dismissal (user_id, context, task, t in seconds) hides from a visit
    (visit_id, user_id, context, t): those marked within the cooldown before it. As both kinds of mark last equally long,
    the latest decides, whichever it is. Visits meet marks of their own and the previous stretch of one cooldown."""
    at = lambda c: F.floor(F.col(c) / cooldown_s)
    v = visits.select("visit_id", "user_id", "context", F.col("t").alias("now"), F.explode(F.array(at("t"), at("t") - 1)).alias("stretch"))
    m = marks.select("user_id", "context", "task", "t", at("t").alias("stretch")).distinct()
    return v.join(m, ["user_id", "context", "stretch"]).where((F.col("t") <= F.col("now")) & (F.col("now") < F.col("t") + cooldown_s)).select("visit_id", "task").distinct()


def suppressed(shown: DataFrame, cooldown_s: int = 3600, dismiss_s: int | None = None) -> DataFrame:
    """Shows and dismissals of (user, task), and of the ``context`` if there is one, in order: a show is hidden while an
    earlier row's cooldown lasts, which is ``dismiss_s`` for a dismissal if that is given.

    A dismissal (``dismissed`` true) sets the end of the cooldown anew, a show only moves it later. So the end is that
    of the last dismissal or of any later show, whichever is latest."""
    w = Window.partitionBy("user_id", *(["context"] if "context" in shown.columns else []), "task_id").orderBy("t", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = shown.withColumn("dismissed", F.coalesce("dismissed", F.lit(False))) if "dismissed" in shown.columns else shown.withColumn("dismissed", F.lit(False))
    d = d.withColumn("_since", F.coalesce(F.sum(F.col("dismissed").cast("int")).over(before), F.lit(0)))
    # The rows before this one from the last dismissal on, which has the largest number of dismissals up to itself.
    own = F.struct((F.col("_since") + F.col("dismissed").cast("int")).alias("k"), (F.col("t") + F.when(F.col("dismissed"), cooldown_s if dismiss_s is None else dismiss_s).otherwise(cooldown_s)).alias("until"))
    last = F.max(own).over(before)
    return d.withColumn("hidden", F.coalesce(F.col("t") < last["until"], F.lit(False))).drop("_since")


def prioritise(recs: DataFrame, risk: DataFrame) -> DataFrame:
    """Half confidence and half risk, or confidence alone where no risk is known."""
    return recs.join(risk, ["user_id", "task_id"], "left").withColumn("priority", r6(F.coalesce(0.5 * F.col("confidence") + 0.5 * F.col("risk"), F.col("confidence"))))


def detect(predictions: DataFrame, context: DataFrame, associations: DataFrame) -> DataFrame:
    """Detectors over three tables: (user_id, insight, type, priority, minutes, confidence, frequency, subject). A task at
    high risk is of the same type as one that is often forgotten; ``frequency`` is the count that is the evidence of
    forgetting or switching."""

    def out(df: DataFrame, name: str, subject: Column, priority: Column, minutes: Column = None, confidence: Column = None, frequency: Column = None, kind: str = None) -> DataFrame:
        number = lambda c, n: (F.lit(None) if c is None else c).cast("double").alias(n)
        return df.select("user_id", F.lit(name).alias("insight"), F.lit(kind or name).alias("type"), priority.alias("priority"), number(minutes, "minutes"), number(confidence, "confidence"), number(frequency, "frequency"), subject.cast("string").alias("subject"))

    p, switches = F.col("probability"), F.col("switches")
    return reduce(DataFrame.unionByName, [
        out(predictions.where("forgotten >= 3"), "frequent_forgetting", F.col("task_id"), F.when(p >= 0.75, "HIGH").when(p >= 0.5, "MEDIUM").otherwise("LOW"), None, p, F.col("forgotten")),
        out(predictions.where("probability >= 0.75 OR risk_level = 'HIGH'"), "high_risk", F.col("task_id"), F.lit("HIGH"), None, p, None, "frequent_forgetting"),
        out(context.where("switches >= 5"), "context_switching", F.col("user_id"), F.when(switches >= 10, "HIGH").otherwise("MEDIUM"), F.col("recovery_minutes"), None, switches),
        out(context.where("interruption_minutes >= 15"), "interruptions", F.col("user_id"), F.lit("HIGH"), F.col("interruption_minutes")),
        out(context.where("affected_category IS NOT NULL"), "affected_category", F.col("affected_category"), F.lit("MEDIUM")),
        out(associations.where("confidence >= 0.7 AND lift >= 1.2"), "association", F.col("task_id"), F.lit("MEDIUM"), None, F.col("confidence")),
    ])


def rank_insights(found: DataFrame) -> DataFrame:
    """0.25 minutes / 60 + 0.25 confidence (0.5 unknown) + 0.3 frequency / 10 (0 unknown) + 0.1 repeated type + 0.05 or
    0.1 by priority; bands at 0.66 and 0.33, HIGH never below MEDIUM."""
    same = F.count("*").over(Window.partitionBy("user_id", "type"))
    one, none = F.lit(1.0), F.lit(0.0)
    score = 0.3 * F.least(one, F.coalesce("frequency", none) / 10) + 0.25 * F.least(one, F.coalesce("minutes", none) / 60) + 0.25 * F.coalesce("confidence", F.lit(0.5)) + F.when(same > 1, 0.1).otherwise(0.0) + 0.05 + 0.05 * F.when(F.col("priority") == "HIGH", 1.0).otherwise(0.5)
    d = found.withColumn("score", r6(score))
    band = F.when(F.col("score") >= 0.66, "HIGH").when((F.col("score") >= 0.33) | (F.col("priority") == "HIGH"), "MEDIUM").otherwise("LOW")
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "insight", "subject")
    return d.withColumns({"band": band, "position": F.row_number().over(order)})


def friction_trend(daily: DataFrame) -> DataFrame:
    """Users whose daily friction rises or falls: (user_id, insight, priority, first, last, slope, points) by the sign of
    the least-squares slope over at least two periods; a slope of 0 gives none."""
    w = Window.partitionBy("user_id").orderBy("period_start")
    d = daily.withColumn("_i", (F.row_number().over(w) - 1).cast("double"))
    g = d.groupBy("user_id").agg(F.count("*").alias("points"), F.min_by("friction", "period_start").alias("first"), F.max_by("friction", "period_start").alias("last"), F.round(F.regr_slope("friction", "_i"), 8).alias("slope"))
    up = F.col("slope") > 0
    return g.where((F.col("points") >= 2) & (F.col("slope") != 0)).select("user_id", F.when(up, "increasing_friction").otherwise("decreasing_friction").alias("insight"), F.when(up, "MEDIUM").otherwise("LOW").alias("priority"), "first", "last", "slope", "points")


def associate_recommendations(associations: DataFrame, predictions: DataFrame, least: float = 0.5, top: int = 5) -> DataFrame:
    """Recommendations of each user from associations (user_id, context, task, confidence), with the first prediction
    (user_id, task, probability, id) of the task if there is one: type by the risk, rank by 0.6 confidence + 0.4 risk, the best ``top``."""
    first = predictions.groupBy("user_id", "task").agg(F.min_by("probability", "id").alias("risk"))
    d = associations.where(F.col("confidence") >= least).join(first, ["user_id", "task"], "left")
    strength = F.greatest("confidence", F.coalesce("risk", F.col("confidence")))
    kind = F.when(F.col("risk") >= 0.5, "recurring_forgotten_task_prevention").otherwise("context_based_reminder")
    d = d.withColumns({"type": kind, "rank_score": F.round(0.6 * F.col("confidence") + 0.4 * F.coalesce("risk", F.lit(0.0)), 4), "evidence_strength": F.round(strength, 4), "impact_score": F.round(F.when(F.col("risk") > 0, F.col("risk")).otherwise(F.col("confidence")), 4), "priority": F.when(strength >= 0.75, "HIGH").when(strength >= 0.5, "MEDIUM").otherwise("LOW")})
    key = F.concat_ws("|", F.col("user_id").cast("string"), "type", F.col("context").cast("string"), F.col("task").cast("string"))
    order = Window.partitionBy("user_id").orderBy(F.desc("rank_score"), "context", "task")
    d = d.withColumns({"id": F.concat(F.lit("rec-"), F.substring(F.sha2(key, 256), 1, 12)), "position": F.row_number().over(order)})
    return d.where(F.col("position") <= top).select("user_id", "id", "type", "context", "task", "confidence", "risk", "evidence_strength", "impact_score", "priority", "rank_score", "position")


def daily_summary(ranked: DataFrame, predictions: DataFrame, associations: DataFrame, context: DataFrame, top: int = 3) -> DataFrame:
    """One row a user of any table: the first insight (or context switching where there is none but context is known),
    the task of the highest risk, the strongest association of 0.7 or more, minutes that could be saved, and the first
    ``top`` insights."""
    r = ranked.where(F.col("position") <= top).groupBy("user_id").agg(F.min_by("insight", "position").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "insight"))), lambda x: x["insight"]), ",").alias("top_insights"))
    p = predictions.groupBy("user_id").agg(F.max_by("task", F.struct("probability", -F.col("id"))).alias("highest_risk_task"), F.max("probability").alias("highest_risk"))
    a = associations.where("confidence >= 0.7").groupBy("user_id").agg(F.max_by("context", F.struct("confidence", -F.col("task"))).alias("reminder_context"))
    c = context.groupBy("user_id").agg(F.round(F.sum("recovery_minutes"), 1).alias("avoidable_minutes"))
    d = r.join(p, "user_id", "full").join(a, "user_id", "full").join(c, "user_id", "full")
    return d.withColumn("biggest_friction", F.coalesce("first", F.when(F.col("avoidable_minutes").isNotNull(), "context_switching"))).drop("first")


def rule_report(found: DataFrame) -> DataFrame:
    """Mined rules flattened for reading, the strongest first."""
    flat = lambda c: F.array_join(c, " + ").alias(c)
    keys = [c for c in ("context",) if c in found.columns]
    return found.select(*keys, flat("antecedents"), flat("consequents"), "support", "confidence", "lift").orderBy(F.desc("lift"), F.desc("confidence"))


def current_predictions(rows: DataFrame, risk: str | None = None) -> DataFrame:
    """Validity of each prediction: until the task's next one; the last is current. With ``risk``, those of that level."""
    w = Window.partitionBy("task_id").orderBy("valid_from", "id")
    d = rows.withColumn("valid_until", F.lead("valid_from").over(w)).withColumn("is_current", F.col("valid_until").isNull())
    return d.where(F.col("risk_level") == risk) if risk else d


def feedback_stats(recs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Counts of each action by recommendation, 0 where there is none, and the status that the latest one sets."""
    n = lambda a: F.count_if(F.col("action") == a)
    last = F.max_by("action", F.struct("at", "fid"))
    f = feedback.groupBy("rec_id").agg(n("ACCEPTED").alias("accepted"), n("DISMISSED").alias("dismissed"), n("DEFERRED").alias("deferred"), last.alias("last"))
    d = recs.join(f, "rec_id", "left").na.fill(0, ["accepted", "dismissed", "deferred"])
    return d.withColumn("status", F.when(F.col("last") == "ACCEPTED", "accepted").when(F.col("last") == "DISMISSED", "dismissed").otherwise("open")).drop("last")


def follow_up_tasks(stats: DataFrame) -> DataFrame:
    """A task due in 24 hours for each accepted recommendation, its id a digest of the recommendation's."""
    return stats.where("status = 'accepted'").select("rec_id", F.substring(F.sha2(F.concat_ws("|", F.lit("follow-up"), F.col("rec_id").cast("string")), 256), 1, 12).alias("task_id"), F.timestamp_micros(F.unix_micros("at") + 86_400_000_000).alias("deadline_at"))


def unfaithful_numbers(rows: DataFrame, text: str, payload: str, within: float = 0.6) -> DataFrame:
    """Numbers in a text that no payload number, or 100 times one, is near; 0, 1 and 2 are allowed."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.try_cast("double"))
    near = lambda v: F.exists(payload, lambda p: (F.abs(v - p) <= within) | (F.abs(v - p * 100) <= within))
    bad = F.filter(found, lambda v: v.isNull() | (~v.isin(0.0, 1.0, 2.0) & ~near(v)))
    return rows.withColumn("unfaithful", F.size(bad)).withColumn("faithful", F.col("unfaithful") == 0)
