"""The input corpus: which notes count, and what its selection leaves out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.columns import bigint, ladder

MIN_CHARS = 100
STEPS = ("all", "coded", "long enough", "unique")


def input_corpus_selection(notes: DataFrame, diagnoses: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """note_id, subject_id, hadm_id, has_icd and copy: the rank among candidates with the same text, null for other notes.

    A candidate has an admission with a diagnosis row, of whatever code, and a text of min_chars at least.  Only
    candidates are ranked, by note_id.  Texts are grouped by two digests in place of themselves, so no window carries text.
    """
    coded = diagnoses.where("hadm_id is not null").select(F.col("hadm_id").alias("__coded")).distinct()
    rows = notes.select("note_id", "subject_id", "hadm_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), F.sha2("text", 256).alias("digest"))
    rows = rows.join(coded, F.col("hadm_id") == F.col("__coded"), "left").withColumn("has_icd", F.col("__coded").isNotNull()).drop("__coded")
    rows = rows.withColumn("candidate", F.col("has_icd") & (F.col("chars") >= min_chars))
    # notes that are no candidates are groups of their own, so one pass ranks all and none of them share a task
    group = F.when(F.col("candidate"), F.col("digest")).otherwise(F.concat(F.lit("note "), F.coalesce("note_id",
        F.xxhash64("subject_id", "hadm_id", "digest").cast("string"))))
    rank = F.row_number().over(Window.partitionBy("group").orderBy("note_id"))
    return rows.withColumn("group", group).withColumn("copy", F.when(F.col("candidate"), rank)).select("note_id", "subject_id", "hadm_id", "has_icd", bigint("copy"))


def input_corpus(notes: DataFrame, diagnoses: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The notes of the corpus: first copies of candidates."""
    return input_corpus_selection(notes, diagnoses, min_chars).where("copy = 1").drop("copy")


def corpus_funnel(selection: DataFrame) -> DataFrame:
    """For each step: notes, patients and patients with several notes, recomputed step by step; zeros for empty steps."""
    steps = F.array(*[F.when(c, F.lit(k)) for k, c in enumerate([F.lit(True), F.col("has_icd"), F.col("copy").isNotNull(),
        F.coalesce(F.col("copy") == 1, F.lit(False))])])
    rows = selection.select("subject_id", F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("position"))
    per = rows.groupBy("position", "subject_id").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("position").agg(F.sum("n").alias("notes"), F.count("subject_id").alias("patients"),
        F.count_if(F.col("subject_id").isNotNull() & (F.col("n") > 1)).alias("several"))
    grid = selection.sparkSession.createDataFrame([(k, s) for k, s in enumerate(STEPS)], "position int, step string")
    return grid.join(F.broadcast(out), "position", "left").select(bigint("position"), "step",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("notes", "patients", "several")])


def corpus_comparison(corpora: dict[str, DataFrame]) -> DataFrame:
    """indicator and value for several corpora (note_id, subject_id, hadm_id, text), each measured in one pass."""
    out = None
    for name, notes in corpora.items():
        one = notes.agg(
            F.count(F.lit(1)).alias("notes"), F.count_distinct("subject_id").alias("patients"), F.count_distinct("hadm_id").alias("admissions"),
            F.count_if(F.col("hadm_id").isNull()).alias("without admission"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"))
        one = one.unpivot([], one.columns, "indicator", "value").select(F.lit(name).alias("corpus"), "indicator", "value")
        out = one if out is None else out.unionByName(one)
    return out


def patient_summary(notes: DataFrame) -> DataFrame:
    """One row: patients, admissions (without null), notes, patients with several notes."""
    per = notes.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
    several = per.agg(F.count_if(F.col("subject_id").isNotNull() & (F.col("n") > 1)).alias("several"))
    return notes.agg(F.count_distinct("subject_id").alias("patients"), F.count_distinct("hadm_id").alias("admissions"),
        F.count(F.lit(1)).alias("notes")).crossJoin(F.broadcast(several))


def notes_per(notes: DataFrame, key: str, cap: int) -> DataFrame:
    """How many keys have 1, 2, ... notes; cap and more are one bucket."""
    per = notes.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    bucket = F.least(F.col("n"), F.lit(cap))
    return per.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("keys")).select("bucket",
        F.when(F.col("bucket") == cap, F.lit(f"{cap}+")).otherwise(F.col("bucket").cast("string")).alias("label"), "keys")


def notes_per_patient(notes: DataFrame) -> DataFrame:
    return notes_per(notes, "subject_id", 10)


def notes_per_admission(notes: DataFrame) -> DataFrame:
    return notes_per(notes, "hadm_id", 3)


def hadm_coverage(corpora: dict[str, DataFrame], diagnoses: DataFrame) -> DataFrame:
    """For each corpus: notes, without admission, with an admission that has no code, with code; the last three add up to notes."""
    coded = diagnoses.where("hadm_id is not null").select(F.col("hadm_id").alias("__coded")).distinct()
    out = None
    for name, notes in corpora.items():
        rows = notes.select("hadm_id").join(coded, F.col("hadm_id") == F.col("__coded"), "left")
        one = rows.agg(F.count(F.lit(1)).alias("notes"), F.count_if(F.col("hadm_id").isNull()).alias("no_admission"),
            F.count_if(F.col("hadm_id").isNotNull() & F.col("__coded").isNull()).alias("no_code"), F.count_if(F.col("__coded").isNotNull()).alias("with_code"))
        one = one.select(F.lit(name).alias("corpus"), *one.columns)
        out = one if out is None else out.unionByName(one)
    return out


def coverage_verdict(notes: int, with_code: int, least: float = 0.9) -> str:
    """`undecidable` for what cannot be decided."""
    return "undecidable" if not notes else "yes" if with_code / notes >= least else "no"


def icd_era(notes: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """hadm_id, subject_id and era of each admission that has a note: only 9, only 10, both or none of the versions."""
    admissions = notes.where("hadm_id is not null").groupBy("hadm_id").agg(F.min("subject_id").alias("subject_id"))
    version = F.expr("try_cast(icd_version as int)")
    codes = diagnoses.groupBy(F.col("hadm_id").alias("h")).agg(F.bool_or(F.coalesce(version == 9, F.lit(False))).alias("nine"),
        F.bool_or(F.coalesce(version == 10, F.lit(False))).alias("ten"))
    nine, ten = F.coalesce("nine", F.lit(False)), F.coalesce("ten", F.lit(False))
    return admissions.join(codes, F.col("hadm_id") == F.col("h"), "left").select("hadm_id", "subject_id",
        ladder([(nine & ten, "both"), (nine, "only 9"), (ten, "only 10")], "none").alias("era"))


def icd_era_by_group(eras: DataFrame, patients: DataFrame) -> DataFrame:
    """Admissions by anchor period and era; patients that are missing are `unknown`."""
    rows = eras.join(patients.select(F.col("subject_id").alias("s"), "anchor_year_group"), F.col("subject_id") == F.col("s"), "left")
    return rows.groupBy(F.coalesce("anchor_year_group", F.lit("unknown")).alias("period"), "era").agg(F.count(F.lit(1)).alias("admissions"))


def era_transition(by_group: DataFrame) -> DataFrame:
    """One row: whether the periods with version 9 and with version 10 overlap."""
    nine = F.collect_set(F.when(F.col("era").isin("only 9", "both"), F.col("period")))
    ten = F.collect_set(F.when(F.col("era").isin("only 10", "both"), F.col("period")))
    return by_group.agg(nine.alias("a"), ten.alias("b")).select(ladder([((F.size("a") == 0) | (F.size("b") == 0), "none"), (F.arrays_overlap("a", "b"), "overlap")],
        "separated").alias("transition"))
