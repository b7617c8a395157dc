"""The funnel of twelve notes, by hand, and empty tables."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import codes, cohort, corpus, demographics, evaluation, mentions, sections, textmetrics

PAD = "x" * 100


def notes_of(spark, rows):
    return spark.createDataFrame(rows, "note_id string, subject_id string, hadm_id string, text string")


def diagnoses_of(spark, rows):
    return spark.createDataFrame(rows, "hadm_id string, icd_code string, icd_version string")


@pytest.fixture(scope="module")
def twelve(spark):
    notes = notes_of(spark, [
        ("1-DS-1", "1", "10", "a" + PAD), ("2-DS-1", "2", "20", "b" + PAD), ("3-DS-1", "3", None, "f" + PAD), ("4-DS-1", "4", "40", "g" + PAD),
        ("5-DS-1", "5", "50", "short"), ("6-DS-1", "6", "60", None), ("7-DS-1", "7", "70", "h" + PAD), ("1-DS-2", "1", "80", "a" + PAD),
        ("8-DS-1", "8", "90", "c" + PAD), ("9-DS-1", "9", "100", "c" + PAD), ("10-DS-1", "10", "110", "d" + PAD), ("10-DS-2", "10", "110", "e" + PAD)])
    diagnoses = diagnoses_of(spark, [("10", "I10", "10"), ("10", "E119", "10"), ("20", "4273", "9"), ("50", "E119", "10"), ("60", "E119", "10"), ("70", None, "10"),
        ("80", "N189", "10"), ("100", "J189", "10"), ("110", "J449", "10")])
    return notes, diagnoses


def test_funnel(twelve):
    got = corpus.corpus_funnel(corpus.input_corpus_selection(*twelve)).orderBy("position").collect()
    assert [(r["notes"], r["patients"], r["several"]) for r in got] == [(12, 10, 2), (9, 7, 2), (7, 5, 2), (6, 5, 1)]


def test_note_without_code_does_not_suppress_its_copy(twelve):
    kept = {r["note_id"] for r in corpus.input_corpus(*twelve).collect()}
    assert kept == {"1-DS-1", "2-DS-1", "7-DS-1", "9-DS-1", "10-DS-1", "10-DS-2"}


def test_cohort_labels(spark, twelve):
    notes, diagnoses = twelve
    made = cohort.cohort(notes, corpus.input_corpus(notes, diagnoses), diagnoses)
    got = {r["note_id"]: [k for k in cohort_labels() if r[k]] for r in made.collect()}
    assert got == {"1-DS-1": ["diabetes"], "2-DS-1": ["atrial_fibrillation"], "7-DS-1": [], "9-DS-1": ["pneumonia"], "10-DS-1": ["copd"], "10-DS-2": ["copd"]}
    assert codes.label_codes(diagnoses).where("invalid").count() == 1
    with pytest.raises(cohort.Refused) as e:
        cohort.ensure_publishable(cohort.positives(made))
    assert not any(c.isdigit() for c in str(e.value))


def cohort_labels():
    return [c.key for c in codes.POOL]


def test_empty_tables(spark):
    notes, diagnoses = notes_of(spark, []), diagnoses_of(spark, [])
    funnel = corpus.corpus_funnel(corpus.input_corpus_selection(notes, diagnoses)).collect()
    assert [r["notes"] for r in funnel] == [0, 0, 0, 0]
    assert corpus.patient_summary(notes).first()["patients"] == 0
    metrics = textmetrics.note_metrics(notes)
    assert textmetrics.marker_summary(metrics).first()["markers"] == 0
    assert textmetrics.note_quality(metrics).first()["duplicates"] == 0
    c = codes.diagnosis_codes(notes, diagnoses)
    assert codes.era_summary(notes, c).first()["neither"] == 0
    assert {r["n_both"] for r in codes.cooccurrence(c).collect()} == {0}
    flags = mentions.mention_flags(notes)
    assert {r["result"] for r in mentions.rubric(mentions.mention_agreement(flags, c)).collect()} == {"undecidable"}
    spans = sections.section_spans(notes)
    assert sections.section_skeleton(notes, spans).where("in_skeleton").count() == 0
    assert sections.strip_share(spans).first()["share"] is None
    assert corpus.coverage_verdict(0, 0) == "undecidable"


def test_masked_age_maps_to_the_cap(spark):
    notes = notes_of(spark, [("1-DS-1", "1", "10", "t"), ("2-DS-1", "2", "20", "t"), ("3-DS-1", "3", "30", "t")])
    patients = spark.createDataFrame([("1", "F", "91", "2150"), ("2", "M", "80", "2150"), ("3", "M", "x", "2150")],
        "subject_id string, gender string, anchor_age string, anchor_year string")
    admissions = spark.createDataFrame([("10", "2150", None, None, None, None), ("20", "2165", None, None, None, None), ("30", "2150", None, None, None, None)],
        "hadm_id string, admit_year string, insurance string, language string, marital_status string, race string")
    got = {r["note_id"]: (r["age"], r["age_band"]) for r in demographics.demographic_notes(notes, patients, admissions).collect()}
    assert got == {"1-DS-1": (90, "90+"), "2-DS-1": (90, "90+"), "3-DS-1": (None, "unknown")}


def scored(spark, labels, scores):
    return spark.createDataFrame([("m", "d", bool(t), float(s)) for t, s in zip(labels, scores)], "row_id string, diagnosis string, label boolean, score double")


@pytest.mark.parametrize("labels,scores,f1", [([1, 1, 0, 1, 0, 0], [0.9, 0.8, 0.7, 0.6, 0.2, 0.1], 6 / 7), ([1, 0], [0.5, 0.5], 2 / 3)])
def test_max_f1(spark, labels, scores, f1):
    assert abs(evaluation.max_f1(scored(spark, labels, scores)).first()["max_f1"] - f1) < 1e-8


def test_split_contract(spark):
    strata = spark.range(1, 121).select(F.col("id").alias("subject_id"), (F.col("id") % 3).alias("stratum"))
    split = cohort.partition(strata)
    sizes = [r["count"] for r in split.join(strata, "subject_id").groupBy("fold", "stratum").count().collect()]
    assert split.count() == 120 and max(sizes) - min(sizes) <= 1
    assert cohort.split_digest(split) == cohort.split_digest(cohort.partition(strata.orderBy(F.rand())))
    notes = strata.select("subject_id")
    cohort.ensure_split(split, notes)
    with pytest.raises(cohort.Refused):
        cohort.ensure_split(split.limit(100), notes)


def test_decision_rule():
    rule = evaluation.DecisionRule()
    assert rule.verdict(-0.01, 0.02, 30_000) == "non-inferior"
    assert rule.verdict(-0.05, -0.03, 30_000) == "inferior"
    assert rule.verdict(-0.02, 0.02, 30_000) == "inconclusive"
    with pytest.raises(cohort.Refused):
        rule.verdict(-0.01, 0.02, 10)
