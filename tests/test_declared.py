"""Configurations, declared experiments, manifests, decisions, published numbers, typed tables and the command line."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textloom import __main__ as command
from textloom.functions import icd, numbers
from textloom.functions.sections import split_sections, lookup
from textloom.operators import cohort, codes, evaluation, sections, textmetrics, tokens
from textloom.operators.cohort import Refused
from textloom.plans import experiments
from textloom.sources import configs, tables

D = "0" * 64


def put(tmp_path, name, body):
    (tmp_path / name).write_text(body if isinstance(body, str) else json.dumps(body))
    return f"file://{tmp_path}/{name}"


# --- configurations -----------------------------------------------------------------------------------------------
POOL = [{"key": "a", "nine": ["250"], "ten": ["E11"], "acronyms": ["DM"], "variants": ["type 2"], "misspellings": {"diabtes": "diabetes"}, "groups": ["diabetes"]},
    {"key": "b", "ten": ["J44"], "chapter": "x", "keywords": ["y"]}]


def test_pool(spark, tmp_path):
    pool = configs.load_pool(spark, put(tmp_path, "pool.json", POOL))
    assert [c.key for c in pool] == ["a", "b"] and pool[0].misspellings == (("diabtes", "diabetes"),) and pool[1].nine == ()


@pytest.mark.parametrize("wrong", [
    "no json", [{"key": "a"}], [{"key": "a", "ten": ["E1!"]}], [{"key": "a", "ten": ["e11"]}], [POOL[0], {"key": "b", "ten": ["E119"]}], [POOL[0], POOL[0]],
        [POOL[0], {"key": "c", "ten": ["J"], "acronyms": ["DM"]}],
    [POOL[0], {"key": "c", "ten": ["J"], "variants": ["TYPE 2"]}], [{**POOL[0], "other": 1}], [{"key": "a", "ten": ["E11"], "acronyms": ["D M"]}],
        [{"key": "x y", "ten": ["E1"], "variants": ["x y"]}]])
def test_refused_pools(spark, tmp_path, wrong):
    with pytest.raises(Refused):
        configs.load_pool(spark, put(tmp_path, "pool.json", wrong))


def test_lexicon_and_catalog(spark, tmp_path):
    lexicon, fields = configs.load_lexicon(spark, put(tmp_path, "l.json", {"sections": [{"key": "a", "synonyms": ["allergies"]},
        {"key": "d", "synonyms": ["final diagnosis"], "diagnostic": True}], "fields": ["name"]}))
    assert [s for s, *_ in split_sections("Name: x\nAllergies: y", lookup(lexicon, fields))] == ["OTHER", "a"] and lexicon[1].diagnostic
    for wrong in ({"sections": [{"key": "a", "synonyms": ["Allergies"]}]}, {"sections": [{"key": "a", "synonyms": ["x y z", "x y z"]}]}, {"other": []}):
        with pytest.raises(Refused):
            configs.load_lexicon(spark, put(tmp_path, "l.json", wrong))
    found = configs.load_catalog(spark, put(tmp_path, "t.json", [{"url": "https://example.org/x/notes.csv.gz", "sha256": D}, {"url": "codes.csv", "sha256": D}]))
    assert set(found) == {"notes", "codes"}
    for wrong in ([{"url": "a/n.csv", "sha256": D}, {"url": "b/n.csv.gz", "sha256": D}], [{"url": "n.csv", "sha256": "0"}]):
        with pytest.raises(Refused):
            configs.load_catalog(spark, put(tmp_path, "t.json", wrong))


# --- codes --------------------------------------------------------------------------------------------------------
def test_groups_of_the_index(spark):
    assert icd.prefixes("I60-I62 G45 042-044 0930") == ("I60", "I61", "I62", "G45", "042", "043", "044", "0930")
    groups = icd.charlson()
    assert len(groups) == 17 and all(nine and ten for nine, ten in groups.values())
    rows = [("1", "I219", 10), ("1", "4280", 9), ("2", "E1165", 10), ("2", "E112", 10), ("3", "C7951", 10), ("3", "1985", 9), ("4", "E119", 9)]
    got = {r["category"]: r["notes"] for r in codes.group_counts(spark.createDataFrame(rows, "note_id string, code string, version int"), groups).collect()}
    assert {k: n for k, n in got.items() if n} == {"myocardial infarction": 1, "heart failure": 1, "diabetes": 1, "diabetes with complications": 1, "metastases": 1}
    counts = spark.createDataFrame([("diabetes", 20), ("dementia", 20), ("paralysis", 4), ("malignancy", 61)], "category string, notes long")
    assert [r["category"] for r in codes.uncovered_groups(counts, spark.range(100)).collect()] == ["dementia"]


def test_era_gaps(spark):
    rows = [("a", 10, 15, 100, 100), ("b", 10, 16, 100, 100), ("c", 0, 1, 100, 100), ("d", 1, 1, 0, 100), ("e", 0, 0, 100, 100)]
    frame = spark.createDataFrame(rows, "candidate string, n9 long, n10 long, total9 long, total10 long")
    assert {r["candidate"] for r in codes.era_gaps(frame).collect()} == {"b", "c"}


# --- sections -----------------------------------------------------------------------------------------------------
def test_literal_sections(spark):
    headers = {"Plan": "p", "Plan of care": "c"}
    texts = {"1": "before\nPlan: a\nPlan of care: b\nPlan: c", "2": "Plan:x\n Plan: y", "3": "", "4": None}
    got = sections.literal_sections(spark.createDataFrame(list(texts.items()), "note_id string, text string"), headers).orderBy("note_id", "position").collect()
    assert [(r["note_id"], r["position"], r["section"], r["body"]) for r in got] == [
        ("1", 0, None, "before\n"), ("1", 1, "p", " a\n"), ("1", 2, "c", " b\n"), ("1", 3, "p", " c"), ("2", 0, None, ""), ("2", 1, "p", "x\n Plan: y"),
            ("3", 0, None, ""), ("4", 0, None, "")]
    spans = spark.createDataFrame([("1", 0), ("1", 1), ("2", 0), ("9", 0)], "note_id string, position int")
    corpus = spark.createDataFrame([("1",), ("2",)], "note_id string")
    assert sections.segment_corpus(spans, corpus).count() == 3
    for bad in (spans.unionByName(spans.limit(1)), spans.where("note_id <> '2'")):
        with pytest.raises(Refused):
            sections.segment_corpus(bad, corpus)


# --- splits -------------------------------------------------------------------------------------------------------
def test_split_with_its_facts(spark, tmp_path):
    split = spark.createDataFrame([(k, None if k % 6 == 5 else k % 6) for k in range(30)], "subject_id long, fold int")
    digest = cohort.materialize_split(split, f"file://{tmp_path}/split", seed=3)
    back, facts = cohort.read_split(spark, f"file://{tmp_path}/split")
    assert facts == {"seed": 3, "folds": 5, "sha256": digest} and sorted(back.collect(), key=lambda r: r[0]) == sorted(split.collect(), key=lambda r: r[0])
    plain = f"file://{tmp_path}/plain"
    split.write.parquet(plain)
    wrong = f"file://{tmp_path}/wrong"
    split.where("subject_id > 0").withMetadata("fold", facts).write.parquet(wrong)
    for path in (plain, wrong):
        with pytest.raises(Refused):
            cohort.read_split(spark, path)


# --- verdicts -----------------------------------------------------------------------------------------------------
def test_verdicts(spark):
    assert [tokens.translation_verdict(*x) for x in ((0, 0), (0, 3), (1, 3))] == ["undecidable", "whole", "cut"]
    assert [tokens.other_language_verdict(*x) for x in ((None, 1.0), (0.9, 0.86), (0.9, 0.8))] == ["undecidable", "alike", "less"]
    assert [tokens.corpus_verdict(*x) for x in ((None, 1), (1, 1), (1, 2), (2, 1))] == ["undecidable", "equal", "first", "second"]
    assert [textmetrics.marker_verdict(*x) for x in ((None, 0.0), (60.0, 5.0), (50.0, 10.0), (20.0, 1.0))] == ["undecidable", "exact", "with residual", "different"]
    assert (textmetrics.age_verdict(0), textmetrics.age_verdict(2), textmetrics.residual_verdict(0), textmetrics.residual_verdict(1)) == ("masked", "numeric", "none",
        "some")


def test_decision_rule():
    rule = evaluation.DecisionRule(least_notes=10)
    assert [rule.verdict(*x, 10) for x in ((-0.019, 0.1), (-0.02, 0.1), (-0.1, -0.021))] == ["non-inferior", "inconclusive", "inferior"]
    assert rule.is_cheaper(10, 0) and rule.is_cheaper(1, 10) and not rule.is_cheaper(9, 9)
    assert rule.is_seed_sensitive(-0.03, 0.006) and not rule.is_seed_sensitive(-0.03, 0.0049)
    assert rule.is_credible(0.5, 0.4) and not rule.is_credible(0.4, 0.4)
    assert rule.dominates(0, 0.1, 10, 1, 2) and not rule.dominates(0, 0.1, 10, 1, 1) and not rule.dominates(0, 0.1, 10, 0.9, 5) and not rule.dominates(-0.05, 0.1, 10, 2,
        2)
    for wrong in (lambda: rule.verdict(0, 0, 9), lambda: rule.verdict(0.1, 0, 10), lambda: rule.is_cheaper(-1, 0), lambda: rule.is_cheaper(float("nan"), 0),
        lambda: rule.is_seed_sensitive(2, 0), lambda: rule.is_credible(2, 0)):
        with pytest.raises(Refused):
            wrong()


# --- numbers ------------------------------------------------------------------------------------------------------
def test_published_numbers(spark):
    rows = [(1234567, 2000000), (22, 100000), (0, 5), (5, 0), (None, 5), (1, 3), (5, 5)]
    got = spark.createDataFrame(rows, "n long, t long").select(numbers.number_text(F.col("n")), numbers.percent_text(F.col("n"), F.col("t")),
        numbers.percent_label(F.col("n"), F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("1 234 567", "61,7", "61,7 %"), ("22", "< 0,1", "< 0,1 %"), ("0", "0,0", "0,0 %"), ("5", "–", "–"), ("–", "–", "–"),
        ("1", "33,3", "33,3 %"), ("5", "100,0", "100,0 %")]


# --- experiments --------------------------------------------------------------------------------------------------
def test_search_spaces():
    inner = experiments.Space({"depth": experiments.Interval(1, 9)})
    space = experiments.Space({"c": experiments.Interval(0.01, 100.0, log=True), "kind": experiments.Choice(("svm", "tree")),
        "n": experiments.Interval(1, 1000, log=True)}, {("kind", "tree"): inner})
    rng = random.Random(1)
    drawn = [space.draw(lambda name: rng.random()) for _ in range(300)]
    assert all(d in space for d in drawn) and {d["kind"] for d in drawn} == {"svm",
        "tree"} and {d["tree.depth"] for d in drawn if d["kind"] == "tree"} == set(range(1, 10))
    assert 0.3 < sum(d["c"] < 1 for d in drawn) / 300 < 0.7 and 0.3 < sum(d["n"] < 32 for d in drawn) / 300 < 0.7
    good = {"c": 1.0, "kind": "svm", "n": 3}
    assert good in space
    for wrong in ({**good, "c": 1}, {**good, "c": float("nan")}, {**good, "n": 3.0}, {**good, "n": 0}, {**good, "kind": "x"}, {**good, "more": 1}, {"c": 1.0},
        {**good, "tree.depth": 3}, {**good, "kind": "tree"}):
        assert wrong not in space
    for bad in (lambda: experiments.Interval(2, 1), lambda: experiments.Interval(1.0, 1.0), lambda: experiments.Interval(0, 2, log=True),
        lambda: experiments.Interval(1, 2.0), lambda: experiments.Choice(()), lambda: experiments.Choice((1, 1)), lambda: experiments.Space({}),
        lambda: experiments.Space({"a": experiments.Choice((1,))}, {("a", 2): inner})):
        with pytest.raises(Refused):
            bad()
    assert 1 in experiments.Choice((1, True)) and True in experiments.Choice((1, True)) and 1.0 not in experiments.Choice((1, True))


def test_matrix():
    E = experiments.Experiment
    assert set(experiments.check_matrix([E("a", "en", "svm", 5), E("b", "cs", "svm", 5), E("c", "en", "svm", 5, normalize=True)])) == {"a", "b", "c"}
    for wrong in ([], [E("a", "en", "m", 5), E("a", "cs", "m", 5)], [E("a", "en", "m", 5), E("b", "en", "m", 5)], [E("a", "en", "m", 5), E("b", "cs", "m", 6)],
        [E("a", "cs", "m", 5, strip_sections=True)], [E("a", "cs", "m", 5, normalize=True)], [E("a", "en", "m", 5, normalize=True, classical=False)],
        [E("a", "en", "m", 0)]):
        with pytest.raises(Refused):
            experiments.check_matrix(wrong)


def test_manifests_and_lineage(spark, tmp_path):
    one = experiments.Manifest("train", "r1", 0, "2026-01-01", "2026-01-02", {"cohort": D}, {"model": "1" * 64}, {"c": 1})
    two = experiments.Manifest("evaluate", "r1", 0, "2026-01-03", "2026-01-03", {"model": "1" * 64}, {"metrics": "2" * 64})
    path = f"file://{tmp_path}/m"
    experiments.write_manifest(spark, path, one)
    assert experiments.read_manifest(spark, path) == one
    pairs = [("train", "evaluate", "model")]
    metrics = spark.createDataFrame([("r1", None, 0.5)], "row_id string, diagnosis string, f1 double")
    facts = experiments.write_report(spark, metrics, f"file://{tmp_path}/report", [one, two], pairs)
    assert facts["runs"] == {"train": "r1", "evaluate": "r1"}
    assert tables.read_json_lines(spark, f"file://{tmp_path}/report", "row_id string, diagnosis string, f1 double").collect() == metrics.collect()
    assert "diagnosis" in (next((tmp_path / "report").glob("part-*"))).read_text()
    assert tables.verify_provenance(spark, f"file://{tmp_path}/report")["runs"] == facts["runs"]
    other = experiments.Manifest("evaluate", "r1", 0, "1", "1", {"model": "3" * 64}, {"metrics": "2" * 64})
    for wrong in ([one, other], [one], [one, two, two]):
        with pytest.raises(Refused):
            experiments.check_lineage(wrong, pairs)
    for bad in ({"inputs": {"a": "x"}}, {"outputs": {}}, {"finished": "2025"}, {"inputs": {"model": D}}, {"step": ""}):
        with pytest.raises(Refused):
            experiments.Manifest(**({"step": "s", "run": "r", "seed": 0, "started": "2026", "finished": "2026", "inputs": {}, "outputs": {"model": D}} | bad))


def test_audit_pin(spark):
    reference = spark.createDataFrame([("a",), ("b",), ("b",)], "text string")
    pin = experiments.pin_audit("13-grams", ("x", "y"), reference)
    experiments.check_audit(pin, "13-grams", ("y", "x"), reference.repartition(3))
    for args in (("12-grams", ("x", "y"), reference), ("13-grams", ("x",), reference), ("13-grams", ("x", "y"), reference.distinct())):
        with pytest.raises(Refused):
            experiments.check_audit(pin, *args)


# --- typed tables -------------------------------------------------------------------------------------------------
def test_typed_tables(spark, tmp_path):
    notes = spark.createDataFrame([("1", "a", None, "x"), ("2", "b", "h", None), ("3", "a", "h", "")], tables.NOTES)
    path = f"file://{tmp_path}/notes"
    tables.write_table(notes.select("text", "hadm_id", "note_id", "subject_id"), path, tables.NOTES)
    assert tables.notes_of(spark, path).columns == tables.NOTES.names and tables.notes_of(spark, path, notes.where("subject_id = 'a'")).count() == 2
    assert [len(b) for b in tables.batches(spark, path, tables.NOTES, ["note_id"], 2)] == [2, 1]
    with pytest.raises(Refused):
        tables.write_table(notes.drop("text"), path, tables.NOTES)
    empty = spark.createDataFrame([], tables.TRIALS)
    tables.write_parts({"a": (notes, tables.NOTES), "b": (empty, tables.TRIALS)}, f"file://{tmp_path}/parts")
    assert spark.read.parquet(f"file://{tmp_path}/parts/b").schema == tables.TRIALS
    with pytest.raises(Refused):
        tables.write_parts({"c": (notes, tables.NOTES), "d": (empty, tables.NOTES)}, f"file://{tmp_path}/other")
    assert not (tmp_path / "other").exists()


# --- the command line ---------------------------------------------------------------------------------------------
def test_command(spark, tmp_path, capsys):
    assert command.main(["corpus_funnel", "/root/testdata/sf0.001", f"file://{tmp_path}/out"]) == command.DONE
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 4
    assert command.main(["--list"]) == command.DONE and "corpus_funnel" in capsys.readouterr().out
    assert command.main(["nothing", "a", "b"]) == command.USAGE
    assert command.main(["corpus_funnel", "/nowhere", f"file://{tmp_path}/out2"]) == command.REFUSED
