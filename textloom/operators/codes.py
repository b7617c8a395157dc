"""Diagnosis codes of the corpus: eras, rankings, prevalence, co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.columns import ladder, ratio
from textloom.functions.icd import POOL, Candidate, charlson, code_group, diagnosis_of, matches, normal_code, version_number

MIN_LABEL, TOP = 10, 20
BAND, REDUNDANT, ERA_RATIO = (0.05, 0.60), 0.5, 1.5


def diagnosis_codes(notes: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Distinct (note_id, hadm_id, code, version) of the notes; malformed codes and versions are left out."""
    codes = diagnoses.select(F.col("hadm_id").alias("h"), normal_code(F.col("icd_code")).alias("code"),
        version_number(F.col("icd_version")).alias("version")).where("code is not null and version is not null").distinct()
    return notes.select("note_id", "hadm_id").join(codes, F.col("hadm_id") == F.col("h")).select("note_id", "hadm_id", "code",
        F.col("version").cast("long").alias("version"))


def era_summary(notes: DataFrame, codes: DataFrame) -> DataFrame:
    """One row: notes with codes of version 9 only, 10 only, both, neither, and with a symptom chapter."""
    symptom = ((F.col("version") == 9) & F.substring("code", 1, 2).isin("78", "79")) | ((F.col("version") == 10) & F.col("code").startswith("R"))
    per = codes.groupBy("note_id").agg(F.bool_or(F.col("version") == 9).alias("nine"), F.bool_or(F.col("version") == 10).alias("ten"),
        F.bool_or(symptom).alias("symptom"))
    counts = per.agg(F.count_if(F.expr("nine and not ten")).alias("only9"), F.count_if(F.expr("ten and not nine")).alias("only10"),
        F.count_if(F.expr("nine and ten")).alias("both"), F.count_if("symptom").alias("symptom"), F.count(F.lit(1)).alias("some"))
    return notes.agg(F.count(F.lit(1)).alias("notes")).crossJoin(F.broadcast(counts)).select("notes", "only9", "only10", "both",
        (F.col("notes") - F.col("some")).alias("neither"), "symptom")


def group_counts(codes: DataFrame, categories: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    """category and distinct notes for prefix categories (such as comorbidity groups); no hierarchy between them."""
    names = F.array(*[F.when(matches(F.col("code"), F.col("version"), *p), F.lit(k)) for k, p in categories.items()])
    rows = codes.select("note_id", F.explode(F.array_compact(names)).alias("category")).distinct()
    found = rows.groupBy("category").agg(F.count(F.lit(1)).alias("notes"))
    grid = codes.sparkSession.createDataFrame([(k,) for k in categories], "category string")
    return grid.join(F.broadcast(found), "category", "left").select("category", F.coalesce("notes", F.lit(0)).cast("long").alias("notes"))


#: All groups of the index; they do not exclude each other.
COMORBIDITIES = charlson()


def uncovered_groups(counts: DataFrame, notes: DataFrame, pool: tuple[Candidate, ...] = POOL) -> DataFrame:
    """Groups (category, notes, share) whose share of all notes lies in the band, and that no candidate of the pool stands for."""
    total = notes.agg(F.count(F.lit(1)).alias("total"))  # one row
    rows = counts.crossJoin(F.broadcast(total)).withColumn("share", ratio("notes", "total"))
    return rows.where(F.col("share").between(*BAND) & ~F.col("category").isin([g for c in pool for g in c.groups])).select("category", "notes",
        F.round("share", 6).alias("share"))


def era_gaps(prevalence: DataFrame) -> DataFrame:
    """Candidates whose shares of the notes of the two versions differ by more than ERA_RATIO; a share of 0 against another counts."""
    nine, ten = ratio("n9", "total9"), ratio("n10", "total10")
    rows = prevalence.select("candidate", nine.alias("share9"), ten.alias("share10")).where("share9 is not null and share10 is not null")
    rows = rows.where(F.greatest("share9", "share10") > ERA_RATIO * F.least("share9", "share10"))
    return rows.select("candidate", F.round("share9", 6).alias("share9"), F.round("share10", 6).alias("share10"))


def code_ranking(codes: DataFrame, titles: DataFrame, min_label: int = MIN_LABEL, top: int = TOP) -> DataFrame:
    """The most frequent code groups of each version, with the title of the group's most frequent full code.

    Only a code with min_label notes gives its title; the share is of all notes with a code of the version.
    """
    codes = codes.withColumn("grp", code_group(F.col("code"), F.col("version")))
    # notes of codes, of groups and of versions from one pass over the codes
    rows = codes.select("note_id", "version", F.explode(F.array(F.struct(F.lit(0).alias("level"), "grp", "code"),
        F.struct(F.lit(1).alias("level"), "grp", F.lit(None).cast("string").alias("code")),
        F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("grp"), F.lit(None).cast("string").alias("code")))).alias("x")).select("note_id", "version",
        "x.*").distinct()
    counts = rows.groupBy("level", "version", "grp", "code").agg(F.count(F.lit(1)).alias("n"))
    full = counts.where("level = 0").select("version", "grp", "code", F.col("n").alias("n_code"))
    best = full.where(F.col("n_code") >= min_label).withColumn("r", F.row_number().over(Window.partitionBy("version", "grp").orderBy(F.desc("n_code"),
        "code"))).where("r = 1")
    t = titles.select(F.trim("icd_code").alias("tc"), version_number(F.col("icd_version")).alias("tv"), "long_title")
    best = best.join(t, (F.col("code") == F.col("tc")) & (F.col("version") == F.col("tv")), "left").select(F.col("version").alias("bv"), F.col("grp").alias("bg"),
        "long_title")
    per_group = counts.where("level = 1").select("version", "grp", "n").where(F.col("n") >= min_label)
    totals = counts.where("level = 2").select(F.col("version").alias("ov"), F.col("n").alias("all_n"))
    out = per_group.join(F.broadcast(totals), F.col("version") == F.col("ov")).join(best, (F.col("version") == F.col("bv")) & (F.col("grp") == F.col("bg")), "left")
    out = out.withColumn("position", F.row_number().over(Window.partitionBy("version").orderBy(F.desc("n"), "grp"))).where(F.col("position") <= top)
    return out.select("version", "grp", F.coalesce("long_title", F.lit("unknown")).alias("title"), "n", F.round(F.col("n") / F.col("all_n"), 6).alias("share"),
        F.col("position").cast("long").alias("position"))


def candidate_notes(codes: DataFrame, pool: tuple[Candidate, ...] = POOL) -> DataFrame:
    """Distinct (note_id, candidate, version)."""
    rows = codes.select("note_id", diagnosis_of(F.col("code"), F.col("version"), pool).alias("candidate"), "version")
    return rows.where("candidate is not null").distinct()


def pool_frame(spark, pool: tuple[Candidate, ...] = POOL) -> DataFrame:
    """position, candidate, chapter: one row for each candidate, in the order of the pool."""
    return spark.createDataFrame([(k, c.key, c.chapter) for k, c in enumerate(pool)], "position long, candidate string, chapter string")


def candidate_prevalence(notes: DataFrame, codes: DataFrame, pool: tuple[Candidate, ...] = POOL) -> DataFrame:
    """Notes of each candidate, by version and in all, with zeros, and the notes with codes of each version."""
    rows = candidate_notes(codes, pool).groupBy("candidate").agg(F.count_distinct("note_id").alias("n"), F.count_if(F.col("version") == 9).alias("n9"),
        F.count_if(F.col("version") == 10).alias("n10"))
    per = codes.groupBy("note_id").agg(F.bool_or(F.col("version") == 9).alias("nine"), F.bool_or(F.col("version") == 10).alias("ten"))
    totals = per.agg(F.count_if("nine").alias("total9"), F.count_if("ten").alias("total10")).crossJoin(F.broadcast(notes.agg(F.count(F.lit(1)).alias("total"))))
    out = pool_frame(notes.sparkSession, pool).join(F.broadcast(rows), "candidate", "left").crossJoin(F.broadcast(totals))
    return out.select("position", "candidate", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "n9", "n10")], "total9", "total10", "total")


def cooccurrence(codes: DataFrame, pool: tuple[Candidate, ...] = POOL) -> DataFrame:
    """All ordered pairs of different candidates: notes with both, with each, and the share of the first that has the second.

    A note has at most as many rows as the pool, so the pairs come from one array for each note, without a self-join.
    """
    sets = candidate_notes(codes, pool).groupBy("note_id").agg(F.collect_set("candidate").alias("c"))
    pairs = sets.select(F.explode("c").alias("a"), "c").select("a", F.explode("c").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    spark = codes.sparkSession
    names = [c.key for c in pool]
    grid = spark.createDataFrame([(a, b) for a in names for b in names if a != b], "a string, b string")
    own = pairs.where("a = b").select(F.col("a").alias("k"), F.col("n").alias("own"))
    both = pairs.where("a <> b")
    out = grid.join(F.broadcast(both), ["a", "b"], "left").join(F.broadcast(own).toDF("ka", "n_a"), F.col("a") == F.col("ka"),
        "left").join(F.broadcast(own).toDF("kb", "n_b"), F.col("b") == F.col("kb"), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long") for c in ("n", "n_a", "n_b")]
    return out.select("a", "b", counts[0].alias("n_both"), counts[1].alias("n_a"), counts[2].alias("n_b"), F.round(ratio(counts[0], counts[1]), 6).alias("share"))


def preselection(prevalence: DataFrame) -> DataFrame:
    """Each candidate's share of all notes, whether it lies in the band, and whether its versions differ by ERA_RATIO."""
    share = ratio("n", "total")
    r9, r10 = ratio("n9", "total9"), ratio("n10", "total10")
    gap = F.try_divide(F.greatest(r9, r10), F.least(r9, r10)) >= ERA_RATIO
    return prevalence.select("candidate", F.round(share, 6).alias("share"), ladder([(share.isNull(), "undecidable"), (share.between(*BAND), "yes")],
        "no").alias("in_band"), gap.alias("era_gap"))


def redundant_pairs(cells: DataFrame) -> DataFrame:
    """Pairs of which at least REDUNDANT of the smaller candidate's notes have the other."""
    return cells.where((F.col("a") < F.col("b")) & (F.col("n_both") >= REDUNDANT * F.least("n_a", "n_b")) & (F.least("n_a", "n_b") > 0)).select("a", "b", "n_both")


def label_codes(diagnoses: DataFrame, pool: tuple[Candidate, ...] = POOL) -> DataFrame:
    """Distinct raw pairs of code and version with their diagnosis, and whether the pair is malformed."""
    rows = diagnoses.select("icd_code", "icd_version").distinct()
    code, version = normal_code(F.col("icd_code")), version_number(F.col("icd_version"))
    return rows.select("icd_code", "icd_version", diagnosis_of(code, version, pool).alias("diagnosis"), (code.isNull() | version.isNull()).alias("invalid"))
