"""Metric tables: per-class ratios, the micro average and the threshold sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "ALL_CLASSES"

#: Fixed values of the sweep: 50 thresholds from one hundredth upwards, as sums of doubles.
SWEEP_START, SWEEP_STEP, SWEEP_COUNT = 0.01, 0.01, 50


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def with_ratios(counts: DataFrame, digits: bool = False) -> DataFrame:
    """Add Precision, Recall, F1 and Bias (%) to ``TP, FP, FN``; 0 where a denominator is 0.

    Unrounded unless ``digits``, which gives 4 decimals and 2 for the bias.
    """
    tp, fp, fn = F.col("TP"), F.col("FP"), F.col("FN")
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    out = counts.withColumns({"Precision": precision, "Recall": recall})
    p, r = F.col("Precision"), F.col("Recall")
    out = out.withColumns({"F1": ratio(2.0 * p * r, p + r), "Bias (%)": ratio((fp - fn) * 100.0, tp + fn)})
    if digits:
        out = out.withColumns({**{c: F.round(c, 4) for c in ("Precision", "Recall", "F1")}, "Bias (%)": F.round("Bias (%)", 2)})
    return out


def table(counts: DataFrame, names: dict[int, str] | None = None, digits: bool = False) -> DataFrame:
    """The metrics table from ``class_id, TP, FP, FN``: classes in order, then ``ALL_CLASSES``.

    One rollup gives both levels.  A class without a name goes by its number.
    """
    label = F.col("class_id").cast("string")
    if names:
        known = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
        label = F.coalesce(F.try_element_at(known, F.col("class_id")), label)
    rolled = counts.rollup("class_id").agg(
        *[F.sum(c).alias(c) for c in ("TP", "FP", "FN")], F.grouping("class_id").alias("__all")
    )
    named = rolled.withColumn("Class", F.when(F.col("__all") == 1, ALL).otherwise(label))
    return with_ratios(named, digits).orderBy("__all", "class_id").select("Class", "TP", "FP", "FN", "Precision", "Recall", "F1", "Bias (%)")


def all_classes(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """``counts`` with a zero row for each further ``class_id`` of ``classes``."""
    zero = {c: 0 for c in ("TP", "FP", "FN")}
    return classes.select("class_id").distinct().join(counts, "class_id", "full").na.fill(zero)


def evaluation_filter(features: DataFrame, target_class: str) -> DataFrame:
    """Features of one class, whatever its case, that weren't deleted."""
    return features.where((F.lower("class_name") == target_class.lower()) & ~F.coalesce(F.col("deleted"), F.lit(False)))


def threshold_sweep(features: DataFrame) -> DataFrame:
    """One row for each threshold: counts, shares and ratios.

    ``features`` has ``label`` (TP, FP, FN) and ``confidence``; TP and FP without
    a confidence are left out.  A TP below the threshold becomes an FN.  Each
    row falls into one of 51 bins by the number of thresholds that it reaches;
    sums over the bins from above give all thresholds in one pass.
    """
    step = lambda i: SWEEP_START + i * SWEEP_STEP
    cuts = F.array(*[F.lit(step(i)) for i in range(SWEEP_COUNT)])
    reached = F.size(F.filter(cuts, lambda t: F.col("confidence") >= t))
    used = features.where("label = 'FN' or (label in ('TP', 'FP') and confidence is not null)")
    bins = (
        used.withColumn("bin", F.when(F.col("label") == "FN", 0).otherwise(reached))
        .groupBy("bin").agg(*[F.count_if(F.col("label") == k).alias(k) for k in ("TP", "FP", "FN")])
    )
    # at most 51 rows from here on
    grid = features.sparkSession.range(SWEEP_COUNT).select(F.col("id").cast("int").alias("i"))
    above = lambda c: F.coalesce(F.sum(F.when(F.col("bin") > F.col("i"), F.col(c))), F.lit(0)).alias(c)
    missed = F.coalesce(F.sum("FN"), F.lit(0)) + F.coalesce(F.sum(F.when(F.col("bin") <= F.col("i"), F.col("TP"))), F.lit(0))
    rows = grid.join(F.broadcast(bins), how="left").groupBy("i").agg(above("TP"), above("FP"), missed.alias("FN"))
    return sweep_table(rows.withColumn("threshold", F.lit(SWEEP_START) + F.col("i") * F.lit(SWEEP_STEP)))


def sweep_table(rows: DataFrame) -> DataFrame:
    total = F.col("TP") + F.col("FP") + F.col("FN")
    share = lambda c: ratio(F.col(c) * 100.0, total).alias(f"share_{c}")
    return with_ratios(rows).select("i", "threshold", "TP", "FP", "FN", *[share(c) for c in ("TP", "FP", "FN")], "Precision", "Recall", "F1")


def sweep_display(sweep: DataFrame) -> DataFrame:
    """The sweep as it is printed: text thresholds and percentages."""
    percent = lambda c: F.format_string("%.1f%%", F.col(f"share_{c}")).alias(f"% {c}")
    return sweep.orderBy("i").select(
        F.format_string("%.2f", "threshold").alias("Seuil"), "TP", "FP", "FN", *[percent(c) for c in ("TP", "FP", "FN")],
        "Precision", "Recall", F.col("F1").alias("F1-Score"),
    )


def bar_chart_rows(metrics: DataFrame) -> DataFrame:
    """What the metric bar chart shows: every class but the micro average."""
    return metrics.where(F.col("Class") != ALL)
