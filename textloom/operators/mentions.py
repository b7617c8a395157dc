"""Mentions of diagnoses in text, and which of them are negated."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.columns import ladder, ratio, words_of
from textloom.functions.icd import POOL, Candidate, diagnosis_of

#: Cues of negation, and the window after a cue.
CUES = ("no", "not", "without", "denies", "ne", "kein", "sin", "pas")
WINDOW = 40
SYMPTOMS = {"pain": ("are", "les"), "fever": ("this", "est"), "cough": ("from", "des")}
LEAST_AGREEMENT, SELECTED, BAND = 0.5, 5, (0.05, 0.60)


def _phrase(p: str) -> str:
    return r"\s+".join(re.escape(w) for w in p.split())


def mention_pattern(keywords: tuple[str, ...], acronyms: tuple[str, ...] = ()) -> str:
    """Phrases in any case with any white space between words, acronyms as written, between ASCII word borders."""
    parts = []
    if keywords:
        parts.append("(?i:" + "|".join(_phrase(k) for k in sorted(keywords, key=len, reverse=True)) + ")")
    parts += [re.escape(a) for a in sorted(acronyms, key=len, reverse=True)]
    return words_of("|".join(parts))


def negated_pattern(pattern: str) -> str:
    """A cue, then at most WINDOW characters without a full stop, semicolon or newline, then the mention."""
    return words_of("(?i:" + "|".join(_phrase(c) for c in CUES) + ")") + r"[^.;\n]{0,%d}?" % WINDOW + pattern


def mentioned(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def asserted(text: Column, pattern: str) -> Column:
    """Whether a mention is left when negated spans are deleted; looked at only where there is a mention."""
    return F.when(mentioned(text, pattern), F.regexp_replace(text, negated_pattern(pattern), " ").rlike(pattern)).otherwise(F.lit(False))


def mention_flags(notes: DataFrame, pool: tuple[Candidate, ...] = POOL) -> DataFrame:
    """note_id and, for each candidate, whether it is mentioned and asserted: one pass over the texts."""
    text = F.col("text")
    columns = []
    for c in pool:
        p = mention_pattern(c.keywords, c.acronyms)
        columns += [mentioned(text, p).alias(f"m_{c.key}"), asserted(text, p).alias(f"a_{c.key}")]
    return notes.select("note_id", *columns)


def mention_agreement(flags: DataFrame, codes: DataFrame, pool: tuple[Candidate, ...] = POOL) -> DataFrame:
    """For each candidate: notes coded, mentioned, asserted, both ways, and all notes; one wide aggregate, then turned."""
    coded = codes.select(F.col("note_id").alias("n"),
        diagnosis_of(F.col("code"), F.col("version"), pool).alias("d")).where("d is not null").groupBy("n").agg(F.collect_set("d").alias("coded"))
    rows = flags.join(coded, F.col("note_id") == F.col("n"), "left")
    aggs, cells = [F.count(F.lit(1)).alias("total")], []
    for k, c in enumerate(pool):
        i = F.coalesce(F.array_contains("coded", c.key), F.lit(False))
        m, a = F.col(f"m_{c.key}"), F.col(f"a_{c.key}")
        for name, x in (("icd", i), ("mention", m), ("assertion", a), ("icd_mention", i & m), ("icd_assertion", i & a)):
            aggs.append(F.count_if(x).alias(f"{name}_{c.key}"))
        cells.append(F.struct(F.lit(k).cast("long").alias("position"), F.lit(c.key).alias("candidate"), F.lit(c.chapter).alias("chapter"),
            *[F.col(f"{n}_{c.key}").alias(n) for n in ("icd", "mention", "assertion", "icd_mention", "icd_assertion")], F.col("total").alias("total")))
    return rows.agg(*aggs).select(F.inline(F.array(*cells)))


def symptom_mentions(notes: DataFrame, symptoms: dict[str, tuple[str, ...]] = SYMPTOMS) -> DataFrame:
    one = notes.agg(*[F.count_if(mentioned(F.col("text"), mention_pattern(words))).alias(k) for k, words in symptoms.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("symptom"), F.col(k).alias("notes")) for k in symptoms])))


def rubric(agreement: DataFrame) -> DataFrame:
    """Prevalence and agreement of each candidate, and pass, fail or `undecidable`, which wins over fail."""
    share, agree = ratio("icd", "total"), ratio("icd_assertion", "icd")
    result = ladder([(share.isNull() | agree.isNull(), "undecidable"), (share.between(*BAND) & (agree >= LEAST_AGREEMENT), "pass")], "fail")
    return agreement.select("position", "candidate", "chapter", F.round(share, 6).alias("share"), F.round(agree, 6).alias("agreement"), result.alias("result"))


def select_five(rubric: DataFrame, places: int = SELECTED) -> DataFrame:
    """The best candidate of each chapter among those that pass, then others by agreement; the result in pool order.

    Ties go to the earlier candidate.
    """
    good = rubric.where("result = 'pass'")
    good = good.withColumn("r", F.row_number().over(Window.partitionBy("chapter").orderBy(F.desc("agreement"), "position")))
    good = good.withColumn("winner", F.col("r") == 1)
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("winner"), F.desc("agreement"), "position"))  # a row for each candidate
    return good.withColumn("place", place).where(F.col("place") <= places).select("position", "candidate", "chapter", "winner")


def synthetic_parameters(agreement: DataFrame, cells: DataFrame) -> DataFrame:
    """name and value, four digits: prevalence, rates of mention and assertion, and the conditional matrix with ones on its diagonal."""
    one = agreement.select("candidate", F.inline(F.array(
        F.struct(F.lit("prevalence").alias("kind"), F.round(ratio("icd", "total"), 4).alias("value")),
        F.struct(F.lit("mention").alias("kind"), F.round(ratio("icd_mention", "icd"), 4).alias("value")),
        F.struct(F.lit("assertion").alias("kind"), F.round(ratio("icd_assertion", "icd"), 4).alias("value")),
        F.struct(F.lit("given itself").alias("kind"), F.lit(1.0).alias("value")))))
    pairs = cells.select(F.col("a").alias("candidate"), F.concat(F.lit("given "), F.col("b")).alias("kind"), F.round(ratio("n_both", "n_b"), 4).alias("value"))
    return one.unionByName(pairs)
