"""Evaluation aggregates. Each says what a null means; none shares that rule
silently with another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.labels import penalised


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def confusion_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    """Accuracy, precision, recall and F1 of both classes, and the support; a
    ratio without a denominator is 0."""
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    pn, rn = _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    total = tp + fp + fn + tn
    return [
        _ratio(tp + tn, total).alias("accuracy"), p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"),
        pn.alias("precision_neg"), rn.alias("recall_neg"), _f1(pn, rn).alias("f1_neg"), total.cast("long").alias("support"),
    ]


def binary_metrics(rows: DataFrame, truth: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """One pass over rows; null truths are left out, null predictions count as
    wrong. Without rows a global result is all zeros."""
    t, p = F.col(truth), penalised(F.col(truth), F.col(prediction))
    counts = rows.groupBy(*(by or [])).agg(
        F.count_if(t & p).alias("_tp"), F.count_if(~t & p).alias("_fp"), F.count_if(t & ~p).alias("_fn"), F.count_if(~t & ~p).alias("_tn")
    )
    return counts.select(*(by or []), *confusion_metrics(*(F.col(c) for c in ("_tp", "_fp", "_fn", "_tn"))))


def binary_metrics_with_total(rows: DataFrame, truth: str, prediction: str, group: str, total: str = "all") -> DataFrame:
    """``binary_metrics`` for each group and for all rows, in one pass."""
    t, p = F.col(truth), penalised(F.col(truth), F.col(prediction))
    flags = rows.select(group, (t & p).alias("_a"), (~t & p).alias("_b"), (t & ~p).alias("_c"), (~t & ~p).alias("_d"))
    counts = flags.groupingSets([[F.col(group)], []], F.col(group)).agg(
        F.grouping(group).alias("_g"), *[F.count_if(F.col(c)).alias(n) for c, n in (("_a", "_tp"), ("_b", "_fp"), ("_c", "_fn"), ("_d", "_tn"))]
    )
    name = F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(group)).alias(group)
    return counts.select(name, *confusion_metrics(*(F.col(c) for c in ("_tp", "_fp", "_fn", "_tn"))))


def macro_metrics(rows: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Accuracy and unweighted means over the labels in truth or prediction."""
    pairs = rows.select(F.col(truth).alias("t"), F.col(prediction).alias("p")).groupBy("t", "p").agg(F.count("*").alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    votes = pairs.select(F.col("t").alias("label"), F.col("n").alias("gt"), F.lit(0).cast("long").alias("pred"), hit.alias("tp"))
    votes = votes.unionByName(pairs.select(F.col("p").alias("label"), F.lit(0).cast("long").alias("gt"), F.col("n").alias("pred"), F.lit(0).cast("long").alias("tp")))
    each = votes.filter("label IS NOT NULL").groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("gt").alias("gt"), F.sum("pred").alias("pred"))
    scored = each.select("tp", "gt", _ratio(F.col("tp"), F.col("pred")).alias("p"), _ratio(F.col("tp"), F.col("gt")).alias("r"))
    means = scored.agg(F.sum("tp").alias("tp"), F.sum("gt").alias("support"), F.avg("p").alias("p"), F.avg("r").alias("r"), F.avg(_f1(F.col("p"), F.col("r"))).alias("f"))
    zero = F.lit(0.0)
    return means.select(
        _ratio(F.col("tp"), F.col("support")).alias("accuracy"), F.coalesce("p", zero).alias("precision_macro"), F.coalesce("r", zero).alias("recall_macro"),
        F.coalesce("f", zero).alias("f1_macro"), F.coalesce("support", F.lit(0)).cast("long").alias("support"),
    )


#: Ranges of scores that a class is ordered in.
RANGES = 64


def average_precision(rows: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """Sum over distinct scores, falling, of recall gained times precision; 0
    without positives. Null scores come last.

    Rows are first added up by score, so ties cost one row a distinct score. The
    scores are then dealt into ranges of about as many rows, whose sums are the
    offsets of what follows: a class of any size is ordered range by range.
    """
    steps = rows.groupBy(*by, F.col(score).alias("_score")).agg(F.sum(F.col(label).cast("long")).alias("_y"), F.count("*").alias("_n"))
    shares = [(i + 1) / RANGES for i in range(RANGES - 1)]
    found = rows.select(F.percentile_approx(score, shares, 1000).alias("b")).first().b or []
    bounds = F.array(*[F.lit(b) for b in sorted(set(found))]) if found else None
    above = F.size(F.filter(bounds, lambda b: b > F.col("_score"))) if found else F.lit(0)
    steps = steps.withColumn("_range", F.when(F.col("_score").isNull(), F.lit(RANGES)).otherwise(above))
    totals = steps.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_range").alias("_r")).agg(F.sum("_y").alias("_y0"), F.sum("_n").alias("_n0"))
    before = Window.partitionBy(*[f"_by{i}" for i in range(len(by))]).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[f"_by{i}" for i in range(len(by))], "_r", F.coalesce(F.sum("_y0").over(before), F.lit(0)).alias("_y0"), F.coalesce(F.sum("_n0").over(before), F.lit(0)).alias("_n0"))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    down = Window.partitionBy(*by, "_range").orderBy(F.desc("_score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("_hits", F.sum("_y").over(down)).withColumn("_seen", F.sum("_n").over(down)).join(totals, same)
    gained = F.col("_y") * (F.col("_hits") + F.col("_y0")) / (F.col("_seen") + F.col("_n0"))
    out = steps.groupBy(*by).agg(F.sum("_y").alias("positives"), F.sum(gained).alias("_s"))
    return out.select(*by, "positives", _ratio(F.col("_s"), F.col("positives")).alias("average_precision"))


def mean_average_precision(rows: DataFrame, label: str, score: str, by: str) -> DataFrame:
    """Mean over the classes that have a positive; 0 if there is none."""
    each = average_precision(rows, label, score, [by]).filter("positives > 0")
    return each.agg(F.coalesce(F.avg("average_precision"), F.lit(0.0)).alias("mean_ap"), F.count("*").alias("n_classes"))


def image_any(rows: DataFrame, image: str, truth: str, final: str) -> DataFrame:
    """A truth is null where all are; a prediction takes null for false, and an
    image without objects (one null row of an outer join) is false."""
    return rows.groupBy(image).agg(F.bool_or(truth).alias("gt_nature"), F.bool_or(F.coalesce(F.col(final), F.lit(False))).alias("pred_nature"))


def any_positive(rows: DataFrame, image: str, axis: str, truth: str, prediction: str, pool: str | None = None) -> DataFrame:
    """Image-level metrics over the columns whose axis is true: present if any
    is. With ``pool`` only images where that column is true for some present
    class count. A truth of one kind only gives zeros."""
    on = F.coalesce(F.col(axis), F.lit(False))
    images = rows.groupBy(image).agg(
        F.coalesce(F.bool_or(on & F.col(truth)), F.lit(False)).alias("t"),
        F.coalesce(F.bool_or(on & F.col(prediction)), F.lit(False)).alias("p"),
        (F.coalesce(F.bool_or(F.coalesce(F.col(pool), F.lit(False)) & F.col(truth)), F.lit(False)) if pool else F.lit(True)).alias("_pool"),
    )
    return _two_kinds(images.filter("_pool"))


def any_positive_direct(rows: DataFrame, image: str, axis: str, truth: str, prediction: str) -> DataFrame:
    """Image-level truth as in ``any_positive`` against one prediction an image
    (true if any of its rows says so); a missing one counts as wrong. A truth of
    one kind only gives zeros."""
    on = F.coalesce(F.col(axis), F.lit(False))
    images = rows.groupBy(image).agg(F.coalesce(F.bool_or(on & F.col(truth)), F.lit(False)).alias("t"), F.bool_or(prediction).alias("_p"))
    return _two_kinds(images.withColumn("p", penalised(F.col("t"), F.col("_p"))))


def _two_kinds(images: DataFrame) -> DataFrame:
    """Metrics of t and p; zeros unless both kinds of t are there."""
    t, p = F.col("t"), F.col("p")
    counts = images.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    both = ((F.col("tp") + F.col("fn")) > 0) & ((F.col("fp") + F.col("tn")) > 0)
    return counts.select(*confusion_metrics(*(F.when(both, F.col(c)).otherwise(0) for c in ("tp", "fp", "fn", "tn"))))


def truth_composition(rows: DataFrame) -> DataFrame:
    """Rows by ground truth: nature or not, and each sub-label."""
    cases = {"nature": "gt_nature", "no_nature": "NOT gt_nature", "biotic": "gt_biotic", "abiotic": "NOT gt_biotic", "material": "gt_material", "immaterial": "NOT gt_material"}
    return rows.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in cases.items()])


def class_stats(rows: DataFrame, key: str, name: str, seq: str) -> DataFrame:
    """Distinct classes (by key, else name; the first row of each counts) by
    axis; sub-axes of nature alone; rows without a nature label are left out."""
    identity = F.coalesce(F.nullif(F.col(key), F.lit("")), F.col(name))
    first = rows.filter("gt_nature IS NOT NULL").groupBy(identity.alias("_id")).agg(F.min_by(F.struct("gt_nature", "gt_biotic", "gt_material"), seq).alias("c")).select("c.*")
    n = F.col("gt_nature")
    return first.agg(
        F.count("*").alias("total"), F.count_if(n).alias("nature"), F.count_if(~n).alias("no_nature"),
        F.count_if(n & F.col("gt_biotic")).alias("biotic"), F.count_if(n & ~F.col("gt_biotic")).alias("abiotic"),
        F.count_if(n & F.col("gt_material")).alias("material"), F.count_if(n & ~F.col("gt_material")).alias("immaterial"),
    )


def class_coverage(nodes: DataFrame) -> DataFrame:
    """Labels of each class's own node; sub-axes are not gated on nature."""
    n = F.col("is_nature")
    return nodes.agg(
        F.count("*").alias("total"), F.count_if(n).alias("nature"), F.count_if(~n).alias("no_nature"), F.count_if(n.isNull()).alias("unmapped"),
        F.count_if(F.col("life_category") == "biotic").alias("biotic"), F.count_if(F.col("life_category") == "abiotic").alias("abiotic"),
        F.count_if(F.col("tangibility") == "material").alias("material"), F.count_if(F.col("tangibility") == "immaterial").alias("immaterial"),
    )


def coverage_report(stats: DataFrame, title: str) -> DataFrame:
    """A coverage row as lines of text."""
    lines = [F.lit(title), *[F.format_string(f"  {c}: %d", F.col(c)) for c in stats.columns]]
    return stats.select(F.explode(F.array(*lines)).alias("line"))


def mean_or_zero(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def hierarchical_means(rows: DataFrame, mapped: str = "mapped") -> DataFrame:
    """Means of hP, hR, hF1 with failures as 0 and over the mapped alone."""
    m = F.col(mapped)
    means = [mean_or_zero(F.coalesce(c, F.lit(0.0))).alias(f"{c}_all") for c in ("hp", "hr", "hf1")]
    means += [mean_or_zero(F.when(m, F.col(c))).alias(f"{c}_mapped") for c in ("hp", "hr", "hf1")]
    return rows.agg(*means, F.count("*").alias("support"), F.count_if(~m).alias("failures"), mean_or_zero((~m).cast("double")).alias("failure_rate"))


def extraction_diagnostics(objects: DataFrame, image: str) -> DataFrame:
    """objects: a row per object (null for an image without), with mapped and
    parse_failed. Rates are 0 without a denominator."""
    has = F.col("object").isNotNull()
    images = objects.groupBy(image).agg(F.count_if(has).alias("n"), F.count_if(has & F.col("mapped")).alias("m"), F.count_if(has & F.col("parse_failed")).alias("f"))
    return images.agg(
        F.count("*").alias("images"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("objects"), mean_or_zero(F.col("n").cast("double")).alias("objects_per_image"),
        _ratio(F.sum("f"), F.sum("n")).alias("parse_failure_rate"), _ratio(F.sum("m"), F.sum("n")).alias("mapping_rate"), _ratio(F.sum("n") - F.sum("m"), F.sum("n")).alias("fallback_rate"),
    )


def extraction_hits(targets: DataFrame, matched: str = "obj_idx") -> DataFrame:
    """Share of the targets with a truth that an extracted object matches."""
    hit = F.col(matched).isNotNull()
    return targets.filter("gt_nature IS NOT NULL").agg(F.count("*").alias("targets"), F.count_if(hit).alias("hits"), mean_or_zero(hit.cast("double")).alias("extraction_hit_rate"))


def image_rates(objects: DataFrame, image: str) -> DataFrame:
    """Rates of one image; null where it has no objects."""
    counts = objects.groupBy(image).agg(F.count("object").alias("objects"), F.count_if(F.col("mapped") & F.col("object").isNotNull()).alias("mapped"))
    return counts.select(image, "objects", F.try_divide(F.col("mapped").cast("double"), F.col("objects").cast("double")).alias("mapped_rate"))


def flag_rate(rows: DataFrame, flag: str, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.count_if(F.col(flag)).alias("n_true"), mean_or_zero(F.col(flag).cast("double")).alias("rate"), F.count("*").alias("total"))


def top1_accuracy(rows: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Share of equal ids among rows with a truth that isn't blank."""
    real = rows.filter(F.col(truth).isNotNull() & (F.col(truth).cast("string") != ""))
    return real.agg(mean_or_zero(F.coalesce(F.col(truth) == F.col(prediction), F.lit(False)).cast("double")).alias("accuracy"), F.count("*").alias("support"))


def models_tracked(rows: DataFrame, predictions: str) -> DataFrame:
    """Distinct keys over all maps of a column."""
    return rows.select(F.explode(F.map_keys(predictions)).alias("model")).agg(F.countDistinct("model").alias("models"))
