"""How a reference extract of one section agrees with the parsed section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.columns import ladder, quantile_disc
from textloom.functions.sections import OTHER

SECTION = "hospital_course"
#: Spellings of the header that the extract leaves out, in their order.
HEADERS = ("Brief Hospital Course:", "BRIEF HOSPITAL COURSE:", "Hospital Course:", "HOSPITAL COURSE:")
#: White space of all scripts.
SPACE = "[\\t\\n\\x0B\\f\\r\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def clean(text: Column) -> Column:
    """Runs of blanks become one, header spellings go, newlines and then all white space become single blanks."""
    out = F.regexp_replace(text, " +", " ")
    for h in HEADERS:
        out = F.replace(out, F.lit(h), F.lit(""))
    return F.trim(F.regexp_replace(F.replace(out, F.lit("\n"), F.lit(" ")), SPACE + "+", " "))


def check_extract(extract: DataFrame) -> DataFrame:
    """One row: rows, null notes, null targets, repeated notes; all but the first must be 0."""
    per = extract.groupBy("note_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("target").isNull()).alias("null_targets"))
    return per.agg(F.sum("n").alias("rows"), F.count_if(F.col("note_id").isNull()).alias("null_notes"), F.sum("null_targets").alias("null_targets"),
        F.count_if(F.col("n") > 1).alias("repeated"))


def paired(notes: DataFrame, spans: DataFrame, extract: DataFrame) -> DataFrame:
    """note_id, category of agreement and difference of lengths; texts do not leave this function.

    The first that holds: not found; equal; the reference starts with ours and goes on with our next section;
    reference longer; ours longer; reference inside ours; ours inside reference; other.
    """
    w = Window.partitionBy("note_id").orderBy("position")
    parts = spans.withColumn("next_start", F.lead("body_start").over(w)).withColumn("next_end", F.lead("body_end").over(w)).withColumn("next_section",
        F.lead("section").over(w)).where(F.col("section") == SECTION)
    text = notes.select(F.col("note_id").cast("string").alias("note_id"), "text")
    body = lambda a, z: clean(F.substring(F.col("text"), F.col(a).cast("int") + 1, (F.col(z) - F.col(a)).cast("int")))
    ours = text.join(parts.select(F.col("note_id").alias("pn"), "body_start", "body_end", "next_start", "next_end", "next_section"), F.col("note_id") == F.col("pn"),
        "left").select("note_id", body("body_start", "body_end").alias("ours"),
        F.when(F.col("next_section") != OTHER, body("next_start", "next_end")).alias("following"), "next_section")
    ref = extract.select(F.col("note_id").cast("string").alias("rn"), F.trim("target").alias("ref"))
    rows = ours.join(ref, F.col("note_id") == F.col("rn"))
    o, r = F.col("ours"), F.col("ref")
    rest = F.ltrim(F.expr("substring(ref, length(ours) + 1)"))
    rest = F.when(rest.contains(":"), F.ltrim(F.regexp_replace(rest, r"\A[A-Za-z ]{0,48}:", ""))).otherwise(rest)
    category = ladder([
        (o.isNull() | (o == ""), "not found"), (o == r, "equal"),
        (r.startswith(o) & F.col("following").isNotNull() & (F.col("following") != "") & rest.startswith(F.col("following")), "swallows next"),
        (r.startswith(o), "reference longer"), (o.startswith(r), "ours longer"), (o.contains(r), "reference inside"), (r.contains(o), "ours inside")], "other")
    return rows.select("note_id", category.alias("category"), F.abs(F.length(o) - F.length(r)).cast("long").alias("diff"), "next_section")


def bhc_agreement(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("category").agg(F.count(F.lit(1)).alias("notes"), quantile_disc("diff", 0.5).alias("median_diff"))


def unpaired(notes: DataFrame, extract: DataFrame) -> DataFrame:
    """One row: notes without a reference, references without a note, by two anti-joins."""
    a, b = notes.select(F.col("note_id").cast("string").alias("a")), extract.select(F.col("note_id").cast("string").alias("b"))
    left = a.join(b, F.col("a") == F.col("b"), "left_anti").agg(F.count(F.lit(1)).alias("only_notes"))
    right = b.join(a, F.col("a") == F.col("b"), "left_anti").agg(F.count(F.lit(1)).alias("only_reference"))
    return left.crossJoin(F.broadcast(right))


def bhc_cut_sections(pairs: DataFrame) -> DataFrame:
    """Which section follows where our section ends too early."""
    cut = pairs.where(F.col("category").isin("swallows next", "reference longer"))
    return cut.groupBy(F.coalesce("next_section", F.lit("end")).alias("next_section")).agg(F.count(F.lit(1)).alias("notes"))


def bhc_cut_causes(pairs: DataFrame) -> DataFrame:
    """property, value, notes for early ends: three groupings of the same rows in one pass."""
    cut = pairs.where(F.col("category").isin("swallows next", "reference longer"))
    size = ladder([(F.col("diff") < 50, "<50"), (F.col("diff") < 500, "50-499")], "500+")
    rows = cut.select(F.inline(F.array(
        F.struct(F.lit("category").alias("property"), F.col("category").alias("value")),
        F.struct(F.lit("next").alias("property"), F.coalesce("next_section", F.lit("end")).alias("value")),
        F.struct(F.lit("missing").alias("property"), size.alias("value")))))
    return rows.groupBy("property", "value").agg(F.count(F.lit(1)).alias("notes"))
