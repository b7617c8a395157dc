"""Checks of generated corpora: overlap with a reference, statistics, translations, placeholders."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.columns import ratio
from textloom.session import ship

GRAM = 13
RATIO_BAND = (0.8, 1.6)
#: Fixed value: words of the audit are marks of three underscores, or runs of letters and digits.
TOKEN = r"___|[\p{L}\p{N}]+"


def nfkc(texts: DataFrame, column: str = "text") -> DataFrame:
    """texts with the column in compatibility normal form; plain ASCII needs no Python and stays as it is."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    form = F.pandas_udf(run, "string")
    plain = texts.where(F.coalesce(~F.col(column).rlike(r"[^\x00-\x7F]"), F.lit(True)))
    other = texts.where(F.col(column).rlike(r"[^\x00-\x7F]"))
    return plain.unionByName(other.withColumn(column, form(column)))


def audit_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def grams(rows: DataFrame, key: str, n: int = GRAM) -> DataFrame:
    """key, position and gram for every run of n words."""
    w = F.col("w")
    at = F.sequence(F.lit(1), F.size(w) - (n - 1))
    made = F.when(F.size(w) >= n, F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " ")))
    return rows.select(key, audit_tokens(F.col("text")).alias("w")).select(key, F.posexplode(made).alias("position", "gram"))


def gram_digests(rows: DataFrame, key: str, n: int = GRAM, step: int = 1) -> DataFrame:
    """key and a 64-bit digest for the run of n words at every step-th word."""
    w = F.col("w")
    at = F.sequence(F.lit(1), F.size(w) - (n - 1), F.lit(step))
    made = F.when(F.size(w) >= n, F.transform(at, lambda i: F.xxhash64(F.slice(w, i, n))))
    return rows.select(key, audit_tokens(F.col("text")).alias("w")).select(key, F.explode(made).alias("digest"))


def overlap_audit(corpus: DataFrame, reference: DataFrame, excluded: DataFrame | None = None, n: int = GRAM) -> DataFrame:
    """note_id, shared grams and first position for corpus notes that share an n-gram with the reference.

    Only positions and counts come out.  excluded holds grams (of structural labels) that do not count on the corpus's side.
    The reference's distinct runs are one side of a join on digests; the engine broadcasts them if they are small.
    """
    # wherever n words lie, a run of about half of them starts at a multiple of `step`: such runs pick the notes that may share
    # a gram, and only these are compared by text
    run = (n + 1) // 2
    ref_digests = gram_digests(reference, "ref_id", run).select("digest").distinct()
    some = gram_digests(corpus, "note_id", run, step=n - run + 1).join(ref_digests, "digest", "left_semi").select(F.col("note_id").alias("sn")).distinct()
    own = grams(corpus.join(some, F.col("note_id") == F.col("sn"), "left_semi"), "note_id", n)
    if excluded is not None:
        own = own.join(excluded.select(F.col("gram").alias("xg")).distinct(), F.col("gram") == F.col("xg"), "left_anti")
    ref = grams(reference, "ref_id", n).select(F.col("gram").alias("rg")).distinct()
    hit = own.join(ref, F.col("gram") == F.col("rg"), "left_semi")
    return hit.groupBy("note_id").agg(F.count_distinct("gram").alias("shared"), F.min("position").cast("long").alias("first_position"))


def subject_collisions(corpus: DataFrame, reference: DataFrame) -> DataFrame:
    """Distinct subjects of the corpus that the reference has too."""
    return corpus.select("subject_id").distinct().join(reference.select(F.col("subject_id").alias("r")), F.col("subject_id") == F.col("r"), "left_semi")


def audit_gate(overlap: DataFrame, collisions: DataFrame) -> DataFrame:
    """One row: whether the corpus is clean; any shared gram or subject means it is not."""
    a = overlap.agg(F.count(F.lit(1)).alias("notes"))
    b = collisions.agg(F.count(F.lit(1)).alias("subjects"))
    return a.crossJoin(F.broadcast(b)).select("notes", "subjects", ((F.col("notes") == 0) & (F.col("subjects") == 0)).alias("clean"))


def reference_difference(pinned: DataFrame, found: DataFrame) -> DataFrame:
    """One row: rows of each multiset that the other lacks."""
    gone = pinned.exceptAll(found).agg(F.count(F.lit(1)).alias("gone"))
    return gone.crossJoin(F.broadcast(found.exceptAll(pinned).agg(F.count(F.lit(1)).alias("new"))))


def corpus_statistics(notes: DataFrame) -> DataFrame:
    """One row: notes, median words, deviation of the log of characters, marks in a thousand words."""
    words = F.regexp_count("text", F.lit(r"\S+")).cast("long")
    marks = F.regexp_count("text", F.lit(r"(?<!_)___(?!_)")).cast("long")
    rows = notes.select(words.alias("words"), F.when(F.length("text") > 0, F.log(F.length("text").cast("double"))).alias("log_chars"), marks.alias("marks"))
    return rows.agg(F.count(F.lit(1)).alias("notes"), F.expr("percentile(words, 0.5)").cast("double").alias("median_words"),
        F.round(F.stddev_samp("log_chars"), 9).alias("log_deviation"), F.round(ratio(F.sum("marks") * 1000, F.sum("words")), 9).alias("marks_per_thousand"))


def statistics_violations(statistics: DataFrame, target: dict[str, float], tolerance: float = 0.1) -> DataFrame:
    """name, value, target for statistics that are off by more than the tolerance."""
    cells = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("target")) for k, v in target.items()])
    return statistics.select(F.inline(cells)).where(F.col("value").isNull() | (F.abs(F.col("value") - F.col("target")) > tolerance * F.abs("target")))


def translation_checks(source: DataFrame, target: DataFrame) -> DataFrame:
    """pair_id and reason for pairs (pair_id, text) that are missing, empty, of odd length or with other marks."""
    a, b = source.select("pair_id", F.col("text").alias("a")), target.select("pair_id", F.col("text").alias("b"))
    rows = a.withColumn("ha", F.lit(True)).join(b.withColumn("hb", F.lit(True)), "pair_id", "full_outer")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    r = ratio(F.length("b"), F.length("a"))
    mark = F.lit(r"(?<!_)___(?!_)")
    reasons = F.array(
        F.when(F.col("ha").isNull(), "no source"), F.when(F.col("hb").isNull(), "no translation"),
        F.when(F.col("ha") & F.col("hb") & blank("b"), "empty"), F.when(F.col("ha") & F.col("hb") & ~blank("b") & ~r.between(*RATIO_BAND), "length"),
        F.when(F.col("ha") & F.col("hb") & (F.regexp_count("a", mark) != F.regexp_count("b", mark)), "marks"))
    return rows.select("pair_id", F.explode(F.array_compact(reasons)).alias("reason"))


def binding(parts: DataFrame, whole: DataFrame) -> DataFrame:
    """pair_id where the trimmed parts, put together by blank lines in their order, are not the whole text, by digest."""
    made = parts.groupBy(F.col("pair_id").alias("p")).agg(F.array_sort(F.collect_list(F.struct("position", F.trim("text").alias("t")))).alias("x")).select("p",
        F.sha2(F.array_join(F.transform("x", lambda s: s["t"]), "\n\n"), 256).alias("made"))
    return whole.join(made, F.col("pair_id") == F.col("p"), "left").where(~F.coalesce(F.sha2("text", 256) == F.col("made"), F.lit(False))).select("pair_id")


def mask_markers(text: Column) -> Column:
    """Each mark of three underscores becomes [[n]], counted through the note."""
    gaps = F.split(text, r"(?<!_)___(?!_)")
    return F.array_join(F.transform(gaps, lambda g, i: F.when(i == 0, g).otherwise(F.concat(F.lit("[["), i.cast("string"), F.lit("]]"), g))), "")


def restore_markers(text: Column) -> Column:
    return F.regexp_replace(text, r"\[\[[0-9]+\]\]", "___")


def placeholder_problems(source: Column, target: Column) -> Column:
    """missing, extra and duplicated placeholders of a masked translation, as one sorted array of texts."""
    find = lambda t: F.regexp_extract_all(t, F.lit(r"\[\[[0-9]+\]\]"), F.lit(0))
    a, b = find(source), find(target)
    twice = F.filter(F.array_distinct(b), lambda x: F.size(F.filter(b, lambda y: y == x)) > 1)
    tag = lambda name, xs: F.transform(xs, lambda x: F.concat(F.lit(name + " "), x))
    return F.array_sort(F.concat(tag("missing", F.array_except(a, b)), tag("extra", F.array_except(b, a)), tag("duplicated", twice)))


def collect_requests(planned: DataFrame, answers: DataFrame) -> DataFrame:
    """key and state of planned requests: done, failed or open; the open ones are what a resumed run sends."""
    a = answers.select(F.col("key").alias("ak"), F.coalesce(F.trim("answer") != "", F.lit(False)).alias("ok")).groupBy("ak").agg(F.bool_or("ok").alias("ok"))
    return planned.join(a, F.col("key") == F.col("ak"), "left").select("key",
        F.when(F.col("ok"), "done").when(F.col("ok").isNull(), "open").otherwise("failed").alias("state"))


def demo_examples(rows: DataFrame) -> DataFrame:
    """The first positive and the first negative prediction of each diagnosis and truth, by note."""
    rank = F.row_number().over(Window.partitionBy("row_id", "diagnosis", "label").orderBy("note_id"))
    return rows.withColumn("r", rank).where("r = 1").select("row_id", "diagnosis", "label", "note_id", "predicted")
