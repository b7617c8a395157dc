"""Every query of the catalog against DuckDB on the smallest tables; the ones without SQL must give rows."""

import collections
import math
import random
import re

import duckdb
import pytest

import __spark_entry__ as entry
from textloom.functions.sections import lookup, split_sections
from textloom.operators import preprocessing
from textloom.plans import catalog
from textloom.plans.lens import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows(names, table):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(cell(r[k]) for k in order) for r in table)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    cur = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, cur.fetchall())


#: Grids of models, which take minutes: their parts are tested in tests/test_linear.py.
GRIDS = {"screening_results", "boosted_trees_on_components"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE) - GRIDS))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["logistic_regression", "linear_svm", "nb_svm", "naive_bayes", "boosted_trees_on_components", "tuned_threshold"])
def test_classifiers_run_with_the_defaults_of_the_operator(spark, monkeypatch, name):
    seen = []
    for f in ("cross_validated", "tuned_threshold"):
        monkeypatch.setattr(catalog.features, f, lambda rows, family, folds, **options: seen.append((rows, folds, options)))
    catalog.QUERIES[name](spark, SF)
    [(rows, folds, options)] = seen
    assert folds == [0, 1, 2, 3, 4] and not options and {r["fold"] for r in rows.select("fold").distinct().collect()} == set(folds)


def test_bootstrap_draws_two_thousand_resamples(spark):
    import hashlib
    import random

    rng = random.Random(4)
    rows = [(m, rng.randrange(9), rng.random() < 0.5, rng.random() < 0.6) for m in "ab" for _ in range(60)]
    frame = spark.createDataFrame(rows, "row_id string, subject_id long, label boolean, predicted boolean")
    cdf = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]

    def weight(k, subject):
        u = int(hashlib.md5(f"0:{k}:{subject}".encode()).hexdigest()[:13], 16) / (1 << 52)
        return sum(u >= c for c in cdf)

    def accuracy(m, weights):
        mine = [(weights[s], y == p) for x, s, y, p in rows if x == m]
        return sum(w for w, right in mine if right) / sum(w for w, _ in mine)

    drawn = [{s: weight(k, s) for s in range(9)} for k in range(1, 2001)]
    diffs = sorted(accuracy("a", w) - accuracy("b", w) for w in drawn if any(w.values()))
    got = catalog.evaluation.cluster_bootstrap(frame, "a", "b").first()
    assert (got["low"], got["high"]) == tuple(pytest.approx(diffs[math.ceil(q * len(diffs)) - 1], abs=1e-6) for q in (0.025, 0.975))
    assert got["low"] < got["difference"] < got["high"]


def odd_notes():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "x", "the", "\u212aelvin", "İstanbul", "déjà", "vu", "___"]
    return [(k, " ".join(rng.choices(words, k=rng.choice([0, 3, 30, 200])))) for k in range(120)] + [(501, ""), (None, "alpha beta gamma " * 30)]


def test_ngrams_of_odd_notes_equal_sql(spark, tmp_path):
    """A note without id, empty ones, letters that become ASCII in lower case."""
    spark.createDataFrame(odd_notes(), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("ngram_counts", "ngram_counts_by_section"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        cur = con.execute(catalog.ORACLE[name])
        want = rows([d[0] for d in cur.description], cur.fetchall())
        assert len(want) > 20 and rows(df.columns, df.collect()) == want, name


def test_ngrams_of_repeated_ids_count_a_note_once(spark):
    notes = [(None if k is None else str(k // 3 if k < 60 else k), f"Allergies: {t}\nChief Complaint:\n{t[::-1]} {t}") for k, t in odd_notes()] + [("7", None)]
    notes, found, seen, times, having = notes + notes[:9], collections.defaultdict(set), collections.defaultdict(set), collections.Counter(), collections.defaultdict(set)
    for note, text in notes:
        for section, _, a, z in split_sections(text or "", lookup()):
            having[section] |= {note} - {None}
            w = [x for x in re.findall("[a-z]{2,}", text[a:z].replace("İ", "i").lower()) if x not in preprocessing.STOP]
            for gram in [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]:
                found[section, gram] |= {note} - {None}
                seen[gram] |= {note} - {None}
                times[section, gram] += 1
    want = {(s, g): (len(x), times[s, g], round(len(x) / len(having[s]), 6)) for (s, g), x in found.items() if len(seen[g]) >= 10}
    got = preprocessing.ngram_counts(spark.createDataFrame(notes, "note_id string, text string").repartition(3), by_section=True).collect()
    assert {(r["section"], r["gram"]): (r["notes"], r["occurrences"], r["share"]) for r in got} == want and len(got) == len(want) > 20


def test_ngrams_bring_to_the_shuffle_only_grams_that_may_pass(spark):
    """A thousand notes whose words are all their own: the rows that leave the tasks are those of the words that all share."""
    notes = spark.createDataFrame([(str(k), "Allergies: alpha " + " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}{chr(97 + i)}z"
        for i in range(20))) for k in range(1000)], "note_id string, text string")
    df = preprocessing.ngram_counts(notes, by_section=True)
    assert [(r["gram"], r["notes"], r["occurrences"]) for r in df.collect()] == [("alpha", 1000, 1000)]
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
