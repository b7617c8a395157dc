"""Metrics of predictions, and comparisons of models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.columns import ladder, nearest_rank, ratio
from textloom.operators.cohort import MIN_CELL, Refused

KEYS = ("row_id", "diagnosis")
TOLERANCE = 1e-9
BAND_PHI = 0.5
#: Pieces of a model's scores.
PIECES = 256


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def binary_metrics(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """precision, recall, f1 and accuracy; 0 where a denominator is 0."""
    one = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("label").alias("positives"), F.count_if(F.expr("label and predicted")).alias("tp"),
        F.count_if(F.expr("predicted and not label")).alias("fp"), F.count_if(F.expr("label and not predicted")).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return one.select(*keys, "n", "positives", F.round(_zero(p), 9).alias("precision"), F.round(_zero(r), 9).alias("recall"), F.round(_zero(f1), 9).alias("f1"),
        F.round(ratio(F.col("n") - F.col("fp") - F.col("fn"), F.col("n")), 9).alias("accuracy"))


def score_groups(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row for each distinct score: positives and negatives there, above and in all.

    Scores are counted first.  Running sums go over pieces between approximate quantiles of a model's scores, then within each piece, so
    that no task sorts all scores of a model.
    """
    g = rows.groupBy(*keys, "score").agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    cuts = g.groupBy(*keys).agg(F.percentile_approx("score", [k / PIECES for k in range(1, PIECES)], 10 * PIECES).alias("cuts"))  # a row for each model
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    g = g.join(F.broadcast(cuts.toDF(*[f"__{k}" for k in keys], "__cuts")), same)
    g = g.withColumn("__piece", F.when(F.col("score").isNull(), -1).otherwise(F.size(F.filter("__cuts", lambda c: c <= F.col("score"))))).drop("__cuts",
        *[f"__{k}" for k in keys])
    every, above = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.desc("__piece")).rowsBetween(Window.unboundedPreceding, -1)
    per = g.groupBy(*keys, "__piece").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))  # PIECES rows for each model
    per = per.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__piece").alias("__at"),
        *[F.coalesce(F.sum(x).over(w), F.lit(0)).alias(name) for name, x, w in (("__tp", "p", above), ("__fp", "n", above), ("P", "p", every), ("N", "n", every))])
    g = g.join(F.broadcast(per), [*same, F.col("__piece") == F.col("__at")])
    down = Window.partitionBy(*keys, "__piece").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return g.select(*keys, "score", "pos", "neg", (F.col("__tp") + F.sum("pos").over(down)).alias("tp"), (F.col("__fp") + F.sum("neg").over(down)).alias("fp"), "P", "N")


def roc_auc(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The chance that a positive scores above a negative, half for ties; null if a class is missing."""
    g = score_groups(rows, keys)
    wins = F.sum((F.col("pos") * (F.col("N") - F.col("fp"))).cast("double") + (F.col("pos") * F.col("neg")).cast("double") / 2)
    return g.groupBy(*keys).agg(wins.alias("w"), F.max("P").alias("P"), F.max("N").alias("N")).select(*keys,
        F.round(ratio(F.col("w"), (F.col("P") * F.col("N"))), 9).alias("roc_auc"))


def average_precision(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The sum over distinct thresholds of precision times the gain in recall, without interpolation."""
    g = score_groups(rows, keys)
    step = F.sum(F.col("pos").cast("double") / F.col("P").cast("double") * F.col("tp").cast("double") / (F.col("tp") + F.col("fp")).cast("double"))
    return g.where("P > 0").groupBy(*keys).agg(F.round(step, 9).alias("pr_auc"))


def max_f1(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The best F1 over thresholds that scores attain; ties are never cut, and the highest threshold wins."""
    g = score_groups(rows, keys).where("P > 0")
    f1 = (2 * F.col("tp")).cast("double") / (F.col("tp") + F.col("fp") + F.col("P")).cast("double")
    best = g.withColumn("f1", F.round(f1, 12)).groupBy(*keys).agg(F.max(F.struct("f1", "score")).alias("b"))
    return best.select(*keys, F.round(F.col("b.f1"), 9).alias("max_f1"), F.round(F.col("b.score"), 9).alias("threshold"))


def macro_max_f1(rows: DataFrame) -> DataFrame:
    """For each model the mean over folds of the mean over diagnoses."""
    per = max_f1(rows, ("row_id", "fold", "diagnosis"))
    return per.groupBy("row_id", "fold").agg(F.avg("max_f1").alias("m")).groupBy("row_id").agg(F.round(F.avg("m"), 9).alias("macro_max_f1"))


def model_evaluation(rows: DataFrame) -> DataFrame:
    """All metrics of each model and diagnosis, folds pooled."""
    return binary_metrics(rows).join(roc_auc(rows), list(KEYS)).join(average_precision(rows), list(KEYS), "left")


def evaluation_faults(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of counts that must be 0: repeated keys (whatever the fold), predictions without a note, cells of one class, cells with a small class."""
    repeated = rows.groupBy("row_id", "note_id", "diagnosis").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    unknown = rows.join(truth.select(F.col("note_id").alias("tn")), F.col("note_id") == F.col("tn"), "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    cells = rows.groupBy(*KEYS).agg(F.count_if("label").alias("p"),
        F.count_if(~F.col("label")).alias("n")).agg(F.count_if((F.col("p") == 0) | (F.col("n") == 0)).alias("one_class"),
        F.count_if((F.col("p") < MIN_CELL) | (F.col("n") < MIN_CELL)).alias("small"))
    return repeated.crossJoin(F.broadcast(unknown)).crossJoin(F.broadcast(cells))


def fold_gaps(rows: DataFrame) -> DataFrame:
    """For each model and diagnosis: notes that another model predicts and it does not, from the distinct keys of both."""
    grid = rows.select("diagnosis", "fold", "note_id").distinct().join(F.broadcast(rows.select("row_id", F.col("diagnosis").alias("gd")).distinct()),
        F.col("diagnosis") == F.col("gd")).drop("gd")
    own = rows.select(F.col("row_id").alias("r"), F.col("diagnosis").alias("d"), F.col("fold").alias("f"), F.col("note_id").alias("n")).distinct()
    gone = grid.join(own, (F.col("row_id") == F.col("r")) & (F.col("diagnosis") == F.col("d")) & (F.col("fold") == F.col("f")) & (F.col("note_id") == F.col("n")),
        "left_anti")
    return gone.groupBy("row_id", "diagnosis").agg(F.count(F.lit(1)).alias("missing"))


def publishable_metrics(metrics: DataFrame, least: int = MIN_CELL) -> DataFrame:
    """Metrics are null where a class has fewer than least notes."""
    ok = (F.col("positives") >= least) & (F.col("n") - F.col("positives") >= least)
    return metrics.select(*[c if c in ("row_id", "diagnosis", "n", "positives") else F.when(ok, F.col(c)).alias(c) for c in metrics.columns])


def latency_summary(values: DataFrame, column: str) -> DataFrame:
    """One row: values, and the ranks of a half and of 95 % of them."""
    n, (p50, p95) = nearest_rank(values, column, (0.5, 0.95))
    return values.sparkSession.createDataFrame([(n, p50, p95)], "n long, p50 double, p95 double")


def same_predictions(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: pairs, differing labels, scores apart by more than TOLERANCE, rows without a partner."""
    x = a.select("note_id", "diagnosis", F.col("predicted").alias("pa"), F.col("score").alias("sa"))
    y = b.select("note_id", "diagnosis", F.col("predicted").alias("pb"), F.col("score").alias("sb"))
    rows = x.join(y, ["note_id", "diagnosis"], "full_outer")
    gap = F.abs(F.col("sa") - F.col("sb")) > TOLERANCE * F.greatest(F.abs("sa"), F.abs("sb"))
    return rows.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("pa") != F.col("pb")).alias("labels_differ"), F.count_if(gap).alias("scores_differ"),
        F.count_if(F.col("sa").isNull() | F.col("sb").isNull()).alias("alone"))


def pair_phi(rows: DataFrame, a: str, b: str) -> DataFrame:
    """For each fold and diagnosis: the correlation of two models' errors, null when a margin is empty; and rows without a partner."""
    err = F.col("label") != F.col("predicted")
    x = rows.where(F.col("row_id") == a).select("fold", "diagnosis", "note_id", err.alias("ea"))
    y = rows.where(F.col("row_id") == b).select("fold", "diagnosis", "note_id", err.alias("eb"))
    z = x.join(y, ["fold", "diagnosis", "note_id"], "full_outer")
    n = lambda c: F.count_if(F.expr(c)).cast("double")
    g = z.groupBy("fold", "diagnosis").agg(n("ea and eb").alias("n11"), n("ea and not eb").alias("n10"), n("eb and not ea").alias("n01"),
        n("not ea and not eb").alias("n00"), F.count_if(F.expr("ea is null or eb is null")).alias("alone"))
    margins = (F.col("n11") + F.col("n10")) * (F.col("n01") + F.col("n00")) * (F.col("n11") + F.col("n01")) * (F.col("n10") + F.col("n00"))
    phi = F.when(margins > 0, (F.col("n11") * F.col("n00") - F.col("n10") * F.col("n01")) / F.sqrt(margins))
    return g.select("fold", "diagnosis", F.round(phi, 9).alias("phi"), "alone")


def error_correlation(phi: DataFrame) -> DataFrame:
    """One row: the mean of the defined cells, how many there are, and whether errors are alike enough to do without an ensemble."""
    m = F.avg("phi")
    return phi.agg(F.round(m, 9).alias("mean_phi"), F.count("phi").alias("defined"), F.count(F.lit(1)).alias("cells"),
        ladder([(m.isNull(), "undecidable"), (m < BAND_PHI, "yes")], "no").alias("ensemble"))


def screening_grid_faults(results: DataFrame, axes: dict[str, list]) -> DataFrame:
    """One row: cells missing from the full grid of axes, cells outside it, repeated cells."""
    spark, grid = results.sparkSession, None
    for name, values in axes.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        grid = one if grid is None else grid.crossJoin(F.broadcast(one))  # the configured grid, not data
    cells = results.select(*axes)
    own = cells.distinct()
    missing = grid.exceptAll(own).agg(F.count(F.lit(1)).alias("missing"))
    outside = own.exceptAll(grid).agg(F.count(F.lit(1)).alias("outside"))
    repeated = cells.groupBy(*axes).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    return missing.crossJoin(F.broadcast(outside)).crossJoin(F.broadcast(repeated))


def screening_summary(results: DataFrame) -> DataFrame:
    """family, vectorizer, mean macro-F1 over folds, its standard error, the family's rank by its best vectorizer, and whether it lies in the band.

    Macro-F1 of a fold is the mean over diagnoses; ties go to the first by name; the band is one standard error below the winner.
    """
    fold = results.groupBy("family", "vectorizer", "fold").agg(F.avg("f1").alias("f"))
    cell = fold.groupBy("family", "vectorizer").agg(F.round(F.avg("f"), 9).alias("mean"),
        F.round(F.stddev_samp("f") / F.sqrt(F.count(F.lit(1)).cast("double")), 9).alias("se"))
    best = cell.withColumn("r", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("mean"), "vectorizer"))).where("r = 1").drop("r")
    winner = best.agg(F.max_by(F.struct("mean", "se"), F.struct("mean")).alias("w"))  # one row
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("mean"), "family"))  # a row for each family
    out = best.crossJoin(F.broadcast(winner)).withColumn("rank", rank.cast("long"))
    return out.select("family", "vectorizer", "mean", "se", "rank", (F.col("mean") >= F.col("w.mean") - F.coalesce("w.se", F.lit(0.0))).alias("in_band"))


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial of the highest value; of equal ones the earlier."""
    return trials.groupBy("diagnosis").agg(F.max_by(F.struct("trial", "value"), F.struct("value", -F.col("trial"))).alias("b")).select("diagnosis", "b.trial", "b.value")


@dataclass(frozen=True)
class DecisionRule:
    """Non-inferior above -margin, inferior below it, else inconclusive; and what a cheaper model may claim."""

    margin: float = 0.02
    least_notes: int = 25_000
    latency_ratio: float = 10.0
    energy_ratio: float = 10.0
    seed_multiple: float = 2.0

    def verdict(self, low: float, high: float, notes: int) -> str:
        if notes < self.least_notes or not -1 <= low <= high <= 1:
            raise Refused("too few notes, or bounds that are none")
        return "non-inferior" if low > -self.margin else "inferior" if high < -self.margin else "inconclusive"

    def is_cheaper(self, latency: float, energy: float) -> bool:
        """Whether the other model costs enough times as much, in either."""
        _costs(latency, energy)
        return latency >= self.latency_ratio or energy >= self.energy_ratio

    def is_seed_sensitive(self, difference: float, deviation: float) -> bool:
        """Whether the difference is nearer to -margin than seeds alone make it vary."""
        _costs(deviation)
        if not -1 <= difference <= 1:
            raise Refused("a difference that is none")
        return abs(difference + self.margin) < self.seed_multiple * deviation

    @staticmethod
    def is_credible(f1: float, baseline: float) -> bool:
        if not (0 <= f1 <= 1 and 0 <= baseline <= 1):
            raise Refused("an F1 that is none")
        return f1 > baseline

    def dominates(self, low: float, high: float, notes: int, latency: float, energy: float) -> bool:
        """Non-inferior, dearer in nothing and cheaper in something: latency and energy of the other model over this one's."""
        _costs(latency, energy)
        return self.verdict(low, high, notes) == "non-inferior" and min(latency, energy) >= 1 < max(latency, energy)


def _costs(*values: float) -> None:
    if not all(0 <= x < float("inf") for x in values):
        raise Refused("a cost that is none")


def cluster_bootstrap(rows: DataFrame, a: str, b: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """One row: the difference of two models' accuracy, with the 2.5 and 97.5 percentile of resamples of patients.

    Each patient draws a Poisson(1) weight for each resample from a digest: patients are pre-aggregated to two sums, and the
    resamples to one row each before they meet.
    """
    right = (F.col("label") == F.col("predicted")).cast("long")
    x = rows.where(F.col("row_id").isin(a, b)).groupBy("subject_id").agg(F.sum(F.when(F.col("row_id") == a, right)).alias("ra"),
        F.count_if(F.col("row_id") == a).alias("na"), F.sum(F.when(F.col("row_id") == b, right)).alias("rb"), F.count_if(F.col("row_id") == b).alias("nb")).fillna(0)
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("k").cast("string"), F.col("subject_id").cast("string"))), 1, 13), 16,
        10).cast("double") / float(1 << 52)
    cdf, total, p = [], 0.0, 0.36787944117144233
    for k in range(12):
        total += p
        cdf.append(total)
        p /= k + 1
    weight = sum(((u >= c).cast("int") for c in cdf), F.lit(0))
    drawn = x.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(resamples)))).withColumn("w", F.when(F.col("k") == 0, 1).otherwise(weight))
    diff = drawn.groupBy("k").agg((ratio(F.sum(F.col("w") * F.col("ra")), F.sum(F.col("w") * F.col("na"))) - ratio(F.sum(F.col("w") * F.col("rb")),
        F.sum(F.col("w") * F.col("nb")))).alias("d"))
    q = lambda p: F.expr(f"percentile_disc({p}) within group (order by if(k > 0, d, null))")
    return diff.agg(F.round(F.max(F.when(F.col("k") == 0, F.col("d"))), 9).alias("difference"), F.round(q(0.025), 9).alias("low"), F.round(q(0.975), 9).alias("high"))
