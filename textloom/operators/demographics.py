"""Who the patients are: recoded attributes, ages, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.columns import ladder

MASKED_AGE, AGE_CAP = 91, 90
ATTRIBUTES = ("gender", "insurance", "language", "marital", "race", "age_band")


def demographic_notes(notes: DataFrame, patients: DataFrame, admissions: DataFrame) -> DataFrame:
    """One row for each note: attributes recoded by fixed lists, so that no raw value passes; age at admission; what is missing."""
    p = patients.select(F.col("subject_id").alias("ps"), "gender", "anchor_age", "anchor_year")
    a = admissions.select(F.col("hadm_id").alias("ah"), "admit_year", "insurance", "language", "marital_status", "race")
    rows = notes.select("note_id", "subject_id", "hadm_id").join(p, F.col("subject_id") == F.col("ps"), "left").join(a, F.col("hadm_id") == F.col("ah"), "left")
    anchor, year, admit = (F.expr(f"try_cast({c} as int)") for c in ("anchor_age", "anchor_year", "admit_year"))
    age = F.when(anchor == MASKED_AGE, F.lit(AGE_CAP)).when(anchor.isNotNull() & year.isNotNull() & admit.isNotNull(), F.least(anchor + admit - year, F.lit(AGE_CAP)))
    race = F.col("race")
    return rows.select(
        "note_id", "subject_id",
        ladder([(F.col("gender") == "F", "female"), (F.col("gender") == "M", "male")], "unknown").alias("gender"),
        ladder([(F.col("insurance").isin("Medicare", "Medicaid", "Private"), F.lower("insurance")), (F.col("insurance").isNull(), "unknown")],
            "other").alias("insurance"),
        ladder([(F.col("language") == "ENGLISH", "english"), (F.col("language").isNull() | F.col("language").isin("?", ""), "unknown")], "other").alias("language"),
        ladder([(F.col("marital_status").isin("MARRIED", "SINGLE", "WIDOWED", "DIVORCED"), F.lower("marital_status"))], "unknown").alias("marital"),
        ladder([(race.like("WHITE%"), "white"), (race.like("BLACK%"), "black"), (race.like("ASIAN%"), "asian"),
            (race.like("HISPANIC%") | (race == "SOUTH AMERICAN"), "hispanic"),
            (race.isNull() | race.isin("UNKNOWN", "UNABLE TO OBTAIN", "PATIENT DECLINED TO ANSWER"), "unknown")], "other").alias("race"),
        age.cast("long").alias("age"),
        ladder([(age.isNull(), "unknown"), (age < 30, "<30"), (age >= 90, "90+")], F.concat((F.floor(age / 10) * 10).cast("string"), F.lit("s"))).alias("age_band"),
        (anchor == MASKED_AGE).alias("masked"), F.col("ps").isNull().alias("no_patient"), F.col("ah").isNull().alias("no_admission"))


def demographic_summary(rows: DataFrame) -> DataFrame:
    """One row: patients, notes, quartiles of age, missing links, masked ages."""
    q = [F.expr(f"percentile(age, {p})").cast("double").alias(f"age_q{int(p * 100)}") for p in (0.25, 0.5, 0.75)]
    return rows.agg(F.count_distinct("subject_id").alias("patients"), F.count(F.lit(1)).alias("notes"), *q, F.count_if("no_patient").alias("no_patient"),
        F.count_if("no_admission").alias("no_admission"), F.count_if("masked").alias("masked"))


def attribute_counts(rows: DataFrame) -> DataFrame:
    """attribute, category, n: patients for gender, notes for the others, in one pass over distinct patients and one over notes."""
    per_note = rows.select(F.explode(F.map_from_arrays(F.array(*[F.lit(a) for a in ATTRIBUTES[1:]]), F.array(*ATTRIBUTES[1:]))).alias("attribute", "category"))
    per_patient = rows.select(F.lit("gender").alias("attribute"), F.col("gender").alias("category"), "subject_id").distinct().drop("subject_id")
    return per_patient.unionByName(per_note).groupBy("attribute", "category").agg(F.count(F.lit(1)).alias("n"))


def age_gender_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gender", "age_band").agg(F.count(F.lit(1)).alias("n"))


def attribute_table(counts: DataFrame) -> DataFrame:
    """Counts with the share within the attribute, most frequent first, `unknown` last; label is blank on repeats."""
    all_n = F.sum("n").over(Window.partitionBy("attribute"))
    order = Window.partitionBy("attribute").orderBy((F.col("category") == "unknown").cast("int"), F.desc("n"), "category")
    rank = F.row_number().over(order)
    return counts.select("attribute", "category", "n", F.round(F.col("n") / all_n, 6).alias("share"), rank.cast("long").alias("position"),
        F.when(rank == 1, F.col("attribute")).otherwise("").alias("label"))


def majority(counts: DataFrame, attribute: str) -> DataFrame:
    """The most frequent known category of an attribute; ties go to the first by name; no row if there is none."""
    known = counts.where((F.col("attribute") == attribute) & (F.col("category") != "unknown"))
    return known.orderBy(F.desc("n"), "category").limit(1).select("attribute", "category", "n")
