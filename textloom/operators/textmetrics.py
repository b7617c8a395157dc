"""Measures of note texts, all from one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.columns import quantile_disc
from textloom.functions.notetext import AGE, AGE_SUFFIX

PERCENTS = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
SHORT, MEDIUM, LONG = 100, 500, 50_000
REFERENCE_MARKERS, TOLERANCE = 60.6, 0.05
RESIDUAL = {"bracketed": r"\[\*\*[^\]]*\*\*\]", "tag": r"</?[A-Za-z][^<>]*>", "crossed": r"X{3,}"}
#: A masked age after the words that introduce it, and one in digits.
ANCHOR = rf"(?i)is an? ___{AGE_SUFFIX}[mf]?(?![a-z])"
NUMERIC_AGE = rf"(?i)(?<![A-Za-z0-9_])[0-9]{{1,3}}{AGE_SUFFIX}[mf]?(?![a-z])"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def note_metrics(notes: DataFrame) -> DataFrame:
    """One narrow row for each note; a null text is measured as an empty one."""
    text = F.coalesce("text", F.lit(""))
    runs = F.regexp_extract_all(text, F.lit("_{3,}"), F.lit(0))
    rows = notes.select("note_id", text.alias("t"), runs.alias("runs"))
    t = F.col("t")
    return rows.select(
        "note_id", F.length("t").cast("long").alias("chars"), _count(t, r"\S+").alias("words"),
        F.size(F.filter("runs", lambda x: F.length(x) == 3)).cast("long").alias("markers"),
        F.size(F.filter("runs", lambda x: F.length(x) > 3)).cast("long").alias("longer_runs"),
        *[_count(t, p).alias(k) for k, p in RESIDUAL.items()],
        _count(t, AGE).alias("age_masks"), t.rlike(ANCHOR).alias("age_anchor"), _count(t, NUMERIC_AGE).alias("numeric_ages"),
        F.when(F.length("t") > 0, F.sha2("t", 256)).alias("fingerprint"))


def length_percentiles(metrics: DataFrame, columns: tuple[str, ...] = ("chars", "words", "markers")) -> DataFrame:
    long = metrics.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*columns))).alias("metric", "x"))
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"),
        *[quantile_disc("x", p).alias(f"p{round(p * 100):02d}") for p in PERCENTS])


def length_histogram(metrics: DataFrame, column: str = "chars") -> DataFrame:
    """Counts in bins of a tenth of a decade; rows of 0 have no bin."""
    x = F.col(column)
    return metrics.where(x > 0).groupBy((F.floor(F.log10(x.cast("double")) * 10) / F.lit(10.0)).cast("double").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_shares(histogram: DataFrame) -> DataFrame:
    return histogram.select("bin", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9).alias("share"))


def marker_summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count(F.lit(1)).alias("notes"), F.coalesce(F.sum("markers"), F.lit(0)).alias("markers"), F.count_if(F.col("markers") > 0).alias("with_marker"),
        F.coalesce(F.sum("longer_runs"), F.lit(0)).alias("longer_runs"))


def residual_masks(metrics: DataFrame) -> DataFrame:
    """pattern, notes that hold it, occurrences: one pass, then turned."""
    one = metrics.agg(*[F.count_if(F.col(k) > 0).alias(f"n_{k}") for k in RESIDUAL], *[F.coalesce(F.sum(k), F.lit(0)).alias(f"o_{k}") for k in RESIDUAL])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("pattern"), F.col(f"n_{k}").alias("notes"), F.col(f"o_{k}").alias("occurrences")) for k in RESIDUAL])))


def note_quality(metrics: DataFrame) -> DataFrame:
    """Empty, short, medium and long notes, and copies beyond the first of the same text (empty ones apart)."""
    c = F.col("chars")
    return metrics.agg(F.count_if(c == 0).alias("empty"), F.count_if((c > 0) & (c < SHORT)).alias("short"), F.count_if((c >= SHORT) & (c < MEDIUM)).alias("medium"),
        F.count_if(c > LONG).alias("long"), (F.count("fingerprint") - F.count_distinct("fingerprint")).alias("duplicates"))


def age_masks(metrics: DataFrame) -> DataFrame:
    a = F.col("age_masks")
    return metrics.agg(F.count(F.lit(1)).alias("notes"), F.count_if(a == 0).alias("none"), F.count_if(a == 1).alias("one"), F.count_if(a > 1).alias("many"),
        F.count_if("age_anchor").alias("anchored"), F.count_if(F.col("numeric_ages") > 0).alias("numeric"))


def marker_means(metrics: DataFrame) -> DataFrame:
    """One row: marks, longer runs and residual masks a note; null without notes."""
    residual = sum((F.col(k) for k in RESIDUAL), F.lit(0))
    return metrics.agg(F.round(F.avg("markers"), 9).alias("exact"), F.round(F.avg("longer_runs"), 9).alias("longer"), F.round(F.avg(residual), 9).alias("residual"))


def marker_verdict(exact: float | None, residual: float | None) -> str:
    """Whether the mean number of marks is that of the reference, alone or with residual masks."""
    if exact is None or residual is None:
        return "undecidable"
    near = [abs(x - REFERENCE_MARKERS) <= TOLERANCE * REFERENCE_MARKERS for x in (exact, exact + residual)]
    return "exact" if near[0] else "with residual" if near[1] else "different"


def age_verdict(numeric: int) -> str:
    return "numeric" if numeric else "masked"


def residual_verdict(occurrences: int) -> str:
    return "some" if occurrences else "none"


def exact_duplicates(notes: DataFrame) -> DataFrame:
    """Groups of equal texts: the smallest note_id stands for each, by digest and checked by nothing weaker than SHA-256."""
    return notes.where(F.length("text") > 0).groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("note_id").alias("note_id"),
        F.count(F.lit(1)).alias("copies")).where("copies > 1").select("note_id", "copies")
