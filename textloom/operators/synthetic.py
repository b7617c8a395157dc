"""Synthetic corpora: label distributions, patients, note plans and tables."""

from __future__ import annotations

import math
import random
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.columns import ratio
from textloom.functions.icd import POOL


def max_entropy_joint(marginals: list[float], pairs: dict[tuple[int, int], float], tolerance: float = 1e-9, passes: int = 10_000) -> dict[tuple[int, ...], float]:
    """The joint distribution of binary labels with the given marginals and pair probabilities, by proportional fitting.

    Starts uniform, so of all that fit it has the largest entropy.  Cells of pairs of probability 0 stay 0.  Refuses
    margins that no distribution has.
    """
    n = len(marginals)
    cells = {c: 1.0 / 2**n for c in product((0, 1), repeat=n)}
    goals = [((i,), p) for i, p in enumerate(marginals)] + [(ij, p) for ij, p in pairs.items()]
    worst = 1.0
    for _ in range(passes):
        worst = 0.0
        for which, p in goals:
            inside = sum(v for c, v in cells.items() if all(c[i] for i in which))
            worst = max(worst, abs(inside - p))
            up = p / inside if inside > 0 else 0.0
            down = (1 - p) / (1 - inside) if inside < 1 else 0.0
            for c in cells:
                cells[c] *= up if all(c[i] for i in which) else down
        if worst < tolerance:
            total = sum(cells.values())
            return {c: v / total for c, v in cells.items()}
    raise ValueError("the margins contradict one another")


def conditional(joint: dict[tuple[int, ...], float], target: int, given: dict[int, int]) -> float | None:
    """P(target | given), None if the condition never holds."""
    base = sum(v for c, v in joint.items() if all(c[i] == x for i, x in given.items()))
    both = sum(v for c, v in joint.items() if c[target] and all(c[i] == x for i, x in given.items()))
    return both / base if base > 0 else None


def label_shares(notes: DataFrame, labels: list[str]) -> DataFrame:
    """label, notes and share."""
    one = notes.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(x).alias(x) for x in labels])
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("notes"), F.round(ratio(x, "n"), 9).alias("share")) for x in labels])))


def prevalence_outliers(shares: DataFrame, target: dict[str, float], tolerance: float = 0.02) -> DataFrame:
    goal = F.create_map(*[F.lit(x) for kv in target.items() for x in kv])
    return shares.withColumn("target", F.element_at(goal, F.col("label"))).where(F.abs(F.col("share") - F.col("target")) > tolerance)


def continuation_ratio(mean: float, most: int, steps: int = 200) -> float:
    """The ratio of a geometric distribution on 1..most whose mean is given, by bisection."""
    if not 1 <= mean <= (most + 1) / 2:
        raise ValueError("no such mean")

    def average(q: float) -> float:
        w = [q**k for k in range(most)]
        return sum((k + 1) * x for k, x in enumerate(w)) / sum(w)

    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if average(mid) < mean else (low, mid)
    return (low + high) / 2


def required_notes(prevalences: list[float], positives: int = 5, parts: int = 5) -> int:
    """The smallest hundred of notes that has positives expected positives of the rarest label in a part."""
    return 100 * math.ceil(positives * parts / min(prevalences) / 100 - 1e-12)


def allocate(words: int, weights: dict[str, float]) -> dict[str, int]:
    """Whole words by weight, the rest to the largest remainders, ties by name."""
    total = sum(weights.values())
    exact = {k: words * w / total for k, w in weights.items()}
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: words - sum(out.values())]:
        out[k] += 1
    return out


def allocate_rows(rows: DataFrame) -> DataFrame:
    """The same as a table operation: rows (unit, name, weight, words) get `given`."""
    every = Window.partitionBy("unit")
    exact = F.col("words") * F.col("weight") / F.sum("weight").over(every)
    x = rows.withColumn("exact", exact).withColumn("base", F.floor("exact"))
    rank = F.row_number().over(Window.partitionBy("unit").orderBy(F.col("base") - F.col("exact"), "name"))
    left = F.col("words") - F.sum("base").over(every)
    return x.withColumn("rank", rank).withColumn("left", left).select("unit", "name",
        (F.col("base") + (F.col("rank") <= F.col("left")).cast("long")).cast("long").alias("given"))


def phase_random(seed: int, phase: str) -> random.Random:
    """A stream of its own for each phase, so phases do not disturb one another."""
    return random.Random(f"{seed}:{phase}")


def sample_patients(spark: SparkSession, n: int, joint: dict[tuple[int, ...], float], seed: int = 0, mean: float = 1.6, most: int = 5) -> DataFrame:
    """note_id, subject_id and a boolean for each candidate: patients with labels drawn from joint and a geometric number of notes.

    Draws come from digests of (seed, phase, patient), so any executor makes the same rows.
    """
    cells = sorted(joint.items())
    edge, total = [], 0.0
    for c, v in cells:
        total += v
        edge.append((total, c))
    u = lambda phase, *more: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(phase), F.col("id").cast("string"), *more)), 1, 13), 16,
        10).cast("double") / float(1 << 52)
    q = continuation_ratio(mean, most)
    weights = [q**k for k in range(most)]
    notes = F.lit(1) + sum(((u("notes") >= sum(weights[: k + 1]) / sum(weights)).cast("int") for k in range(most - 1)), F.lit(0))
    pick = sum(((F.col("u") >= e).cast("int") for e, _ in edge[:-1]), F.lit(0))
    labels = F.element_at(F.array(*[F.array(*[F.lit(bool(x)) for x in c]) for _, c in edge]), pick + 1)
    rows = spark.range(1, n + 1).withColumn("u", u("labels")).withColumn("labels", labels).withColumn("k", F.explode(F.sequence(F.lit(1), notes)))
    return rows.select(F.concat(F.col("id").cast("string"), F.lit("-DS-"), F.col("k").cast("string")).alias("note_id"), F.col("id").cast("string").alias("subject_id"),
        *[F.col("labels")[i].alias(c.key) for i, c in enumerate(POOL[: len(cells[0][0])])])


def corpus_tables(notes: DataFrame) -> dict[str, DataFrame]:
    """Clinical tables that show the labels of notes: discharge, diagnoses_icd, patients, admissions; all columns text."""
    hadm = F.regexp_replace("note_id", "-DS-", "0")
    own = [F.when(F.col(c.key), F.struct(F.lit(c.ten[0]).alias("icd_code"), F.lit("10").alias("icd_version"))) for c in POOL if c.key in notes.columns]
    codes = F.array_compact(F.array(F.struct(F.lit("Z00").alias("icd_code"), F.lit("10").alias("icd_version")), *own))
    return {
        "discharge": notes.select("note_id", "subject_id", hadm.alias("hadm_id"),
            F.concat(F.lit("Name: ___\nBrief Hospital Course:\n"), F.repeat(F.concat(F.lit("note "), "note_id", F.lit(" ")), 12)).alias("text")),
        "diagnoses_icd": notes.select("subject_id", hadm.alias("hadm_id"), F.posexplode(codes).alias("seq_num", "c")).select("subject_id", "hadm_id",
            F.col("seq_num").cast("string").alias("seq_num"), "c.icd_code", "c.icd_version"),
        "patients": notes.select("subject_id").distinct().select("subject_id", F.lit("F").alias("gender"), F.lit("50").alias("anchor_age"),
            F.lit("2150").alias("anchor_year"), F.lit("2008 - 2010").alias("anchor_year_group")),
        "admissions": notes.select(hadm.alias("hadm_id"), "subject_id", F.lit("2150-01-01 00:00:00").alias("admittime")),
    }


def letters(n):
    """A number as lower-case letters, 26 digits, for words that hold no digit."""
    digits = F.transform(F.sequence(F.lit(5), F.lit(0), F.lit(-1)), lambda i: F.chr(F.lit(97) + (F.floor(n / F.pow(F.lit(26.0), i)) % 26).cast("int")))
    return F.array_join(digits, "")


def sentinel_tables(table: DataFrame, name: str, order: list[str]) -> DataFrame:
    """The table with every cell replaced by a word that names its place, for tests that look for leaked cells.

    Rows are numbered in the given order; this is for fixtures, not for large tables.
    """
    rows = table.withColumn("__n", F.row_number().over(Window.partitionBy().orderBy(*order)))
    return rows.select(*[F.concat(F.lit(f"{name}x{c}x"), letters(F.col("__n"))).alias(c) for c in table.columns])


def note_violations(notes: DataFrame, plans: DataFrame) -> DataFrame:
    """note_id and reason where a text and its plan (labels, sections, words, marks) disagree; every rule is a column expression."""
    rows = plans.select(F.col("note_id").alias("pn"), "sections", "least_words", "most_words", "marks", "required", "forbidden").join(notes.select("note_id", "text"),
        F.col("pn") == F.col("note_id"), "left")
    words = F.regexp_count("text", F.lit(r"\S+"))
    at = F.transform("sections", lambda s: F.instr(F.col("text"), F.concat(s, F.lit(":"))))
    low = F.lower("text")
    reasons = F.array(
        F.when(F.col("note_id").isNull(), "no text"),
        F.when(F.exists(at, lambda x: x == 0), "section missing"),
        F.when(~F.exists(at, lambda x: x == 0) & (F.array_sort(at) != at), "section order"),
        F.when((words < F.col("least_words")) | (words > F.col("most_words")), "length"),
        F.when(F.regexp_count("text", F.lit(r"(?<!_)___(?!_)")) != F.col("marks"), "marks"),
        F.when(F.exists("required", lambda m: ~F.contains(low, F.lower(m))), "mention missing"),
        F.when(F.exists("forbidden", lambda m: F.contains(low, F.lower(m))), "mention not planned"))
    return rows.select(F.col("pn").alias("note_id"), F.explode(F.array_compact(reasons)).alias("reason"))


def extract_rows(notes: DataFrame) -> DataFrame:
    """note_id and target for a reference extract with four kinds of cuts, by the place of the note in the order of ids."""
    kind = F.pmod(F.xxhash64("note_id"), F.lit(4))
    lines = F.split("text", "\n")
    return notes.select("note_id", F.when(kind == 0, F.col("text")).when(kind == 1,
        F.array_join(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(1))), "\n")).when(kind == 2,
        F.concat("text", F.lit("\nmore"))).otherwise(F.get(lines, F.lit(0))).alias("target"))
