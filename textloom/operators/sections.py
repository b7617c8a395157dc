"""Headers and sections of notes."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.columns import ladder, quantile_disc, ratio
from textloom.functions.sections import HEADER_JAVA, LEXICON, MIN_HEADER, OTHER, PREAMBLE, check_lexicon, lookup, normal_header_column, split_sections, strip_sections
from textloom.session import ship
from textloom.sources.tables import feature_table

MIN_LABEL, SHARE, TOP, CANDIDATE = 10, 0.01, 40, 0.5
SKELETON = 0.5
MASK = "___"


def note_headers(notes: DataFrame) -> DataFrame:
    """note_id, header, norm: every header of every note, of MIN_HEADER characters at least in normal form."""
    rows = notes.select("note_id", F.explode(F.regexp_extract_all("text", F.lit(HEADER_JAVA), F.lit(1))).alias("header"))
    return rows.withColumn("norm", normal_header_column(F.col("header"))).where(F.length("norm") >= MIN_HEADER)


def lexicon_frame(spark) -> DataFrame:
    """section, synonym, position, diagnostic; refuses a lexicon with collisions."""
    check_lexicon()
    return spark.createDataFrame([(x.key, s, k, x.diagnostic) for k, x in enumerate(LEXICON) for s in x.synonyms],
        "section string, synonym string, position long, diagnostic boolean")


def publishable_floor(notes: DataFrame) -> DataFrame:
    """One row: the least number of notes that a published label needs."""
    return notes.agg(F.greatest(F.lit(MIN_LABEL), F.ceil(F.lit(SHARE) * F.count(F.lit(1)))).cast("long").alias("floor"), F.count(F.lit(1)).alias("total"))


def header_ranking(notes: DataFrame, headers: DataFrame, top: int = TOP) -> DataFrame:
    """The headers in most notes, with their most frequent spelling and kind."""
    df = headers.groupBy("norm").agg(F.count_distinct("note_id").alias("notes"), F.count(F.lit(1)).alias("used"))
    spelling = headers.groupBy("norm", "header").agg(F.count(F.lit(1)).alias("times"))
    spelling = spelling.withColumn("r", F.row_number().over(Window.partitionBy("norm").orderBy(F.desc("times"),
        "header"))).where("r = 1").select(F.col("norm").alias("sn"), F.col("header").alias("spelling"))
    known = [s for x in LEXICON for s in x.synonyms]
    kind = ladder([(F.col("norm").isin(known), "section"), (F.col("norm").isin(list(PREAMBLE)), "preamble")], "other")
    out = df.crossJoin(F.broadcast(publishable_floor(notes))).where("notes >= floor").join(spelling, F.col("norm") == F.col("sn"))
    return out.select("norm", "spelling", kind.alias("kind"), "notes", "used", F.round(F.col("notes") / F.col("total"), 6).alias("share")).orderBy(F.desc("notes"),
        "norm").limit(top)


def header_candidates(ranking: DataFrame) -> DataFrame:
    """Headers outside the lexicon that at least half of the notes have."""
    return ranking.where((F.col("kind") == "other") & (F.col("share") >= CANDIDATE)).select("norm", "notes")


def header_totals(notes: DataFrame, headers: DataFrame) -> DataFrame:
    """One row: distinct headers, notes with any, with one of the lexicon, with none."""
    known = F.col("norm").isin([s for x in LEXICON for s in x.synonyms])
    one = headers.agg(F.count_distinct("norm").alias("headers"), F.count_distinct("note_id").alias("with_any"),
        F.count_distinct(F.when(known, F.col("note_id"))).alias("with_section"))
    return one.crossJoin(F.broadcast(notes.agg(F.count(F.lit(1)).alias("total")))).select("headers", "with_any", "with_section",
        (F.col("total") - F.col("with_any")).alias("without"))


def lexicon_coverage(headers: DataFrame, by: str = "section") -> DataFrame:
    """For each section or synonym: notes that have it and notes that have it twice or more; zeros are kept."""
    lex = lexicon_frame(headers.sparkSession)
    per = headers.join(F.broadcast(lex), F.col("norm") == F.col("synonym")).groupBy(by, "note_id").agg(F.count(F.lit(1)).alias("n"))
    found = per.groupBy(F.col(by).alias("k")).agg(F.count(F.lit(1)).alias("notes"), F.count_if(F.col("n") >= 2).alias("repeated"))
    return lex.select(by).distinct().join(F.broadcast(found), F.col(by) == F.col("k"), "left").select(by,
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("notes", "repeated")])


def _spans(batches):
    names = lookup()
    for batch in batches:
        out: list = [[] for _ in range(8)]
        for note, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for k, (section, a, b, z) in enumerate(split_sections(text or "", names)):
                body = text[b:z]
                bare = body.strip()
                start = b + len(body) - len(body.lstrip())
                for x, v in zip(out, (note, k, section, z - a, len(bare), bare == MASK, start, start + len(bare))):
                    x.append(v)
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)],
            ["note_id", "position", "section", "span_chars", "body_chars", "body_masked", "body_start", "body_end"])


def section_spans(notes: DataFrame) -> DataFrame:
    """The parts of all notes; lengths and offsets in code points, the body without white space around it."""
    ship(notes.sparkSession)
    return notes.select(F.col("note_id").cast("string"), "text").mapInArrow(_spans,
        "note_id string, position long, section string, span_chars long, body_chars long, body_masked boolean, body_start long, body_end long")


def strip_diagnostic_sections(notes: DataFrame) -> DataFrame:
    """note_id and the text without its diagnostic sections."""
    ship(notes.sparkSession)
    keys = {x.key for x in LEXICON if x.diagnostic}

    def run(batches):
        names = lookup()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else strip_sections(t, names, keys) for t in batch.column(1).to_pylist()],
                pa.string())], ["note_id", "text"])

    return notes.select(F.col("note_id").cast("string"), "text").mapInArrow(run, "note_id string, text string")


def section_skeleton(notes: DataFrame, spans: DataFrame) -> DataFrame:
    """For each section: notes, coverage, median and quartiles of its place among the note's sections, and whether it belongs to the skeleton."""
    named = spans.where(F.col("section") != OTHER).withColumn("place", F.row_number().over(Window.partitionBy("note_id").orderBy("position")) - 1)
    found = named.groupBy(F.col("section").alias("k")).agg(F.count_distinct("note_id").alias("notes"),
        *[F.expr(f"percentile(place, {p})").cast("double").alias(n) for n, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))])
    total = notes.agg(F.count(F.lit(1)).alias("total"))
    lex = lexicon_frame(spans.sparkSession).select("section").distinct()
    out = lex.join(F.broadcast(found), F.col("section") == F.col("k"), "left").crossJoin(F.broadcast(total))
    n = F.coalesce("notes", F.lit(0)).cast("long")
    return out.select("section", n.alias("notes"), F.round(ratio(n, F.col("total")), 6).alias("coverage"), "median", "q25", "q75",
        F.coalesce(ratio(n, F.col("total")) >= SKELETON, F.lit(False)).alias("in_skeleton"))


def _members(skeleton: DataFrame) -> DataFrame:
    """The skeleton's sections with their order: a row for each section of the lexicon at most."""
    order = Window.partitionBy().orderBy("median", F.desc("notes"), "section")
    return skeleton.where("in_skeleton").select(F.col("section").alias("ms"), F.row_number().over(order).alias("rank"))


def order_consistency(spans: DataFrame, skeleton: DataFrame) -> DataFrame:
    """One row: notes with two skeleton sections or more, and how many of these are in the skeleton's order."""
    rows = spans.join(F.broadcast(_members(skeleton)), F.col("section") == F.col("ms"))
    rows = rows.withColumn("wrong", F.coalesce(F.col("rank") < F.lag("rank").over(Window.partitionBy("note_id").orderBy("position")), F.lit(False)))
    per = rows.groupBy("note_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("wrong").alias("wrong")).where("n >= 2")
    return per.agg(F.count(F.lit(1)).alias("judged"), F.count_if(~F.col("wrong")).alias("in_order"))


def section_precedence(spans: DataFrame, skeleton: DataFrame) -> DataFrame:
    """All ordered pairs of skeleton sections: notes with both, and notes in which the first comes first.

    A note has a section once at most, so the pairs come from one array for each note.
    """
    members = F.broadcast(_members(skeleton))
    sets = spans.join(members, F.col("section") == F.col("ms")).groupBy("note_id").agg(F.collect_list(F.struct("section", "position")).alias("s"))
    pairs = sets.select(F.explode("s").alias("x"), "s").select("x", F.explode("s").alias("y")).where("x.section <> y.section")
    found = pairs.groupBy(F.col("x.section").alias("fa"), F.col("y.section").alias("fb")).agg(F.count(F.lit(1)).alias("both"),
        F.count_if(F.expr("x.position < y.position")).alias("first"))
    m = _members(skeleton).select(F.col("ms").alias("a"))
    grid = m.crossJoin(F.broadcast(m.toDF("b"))).where("a <> b")
    return grid.join(F.broadcast(found), (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb")), "left").select("a", "b",
        F.coalesce("both", F.lit(0)).cast("long").alias("both"), F.coalesce("first", F.lit(0)).cast("long").alias("first"))


def _per_note(notes: DataFrame, spans: DataFrame) -> DataFrame:
    per = spans.where(F.col("section") != OTHER).groupBy(F.col("note_id").alias("sn")).agg(F.count(F.lit(1)).alias("sections"))
    return notes.select(F.col("note_id").cast("string").alias("note_id")).join(per, F.col("note_id") == F.col("sn"), "left").select("note_id",
        F.coalesce("sections", F.lit(0)).cast("long").alias("sections"))


def sections_per_note(notes: DataFrame, spans: DataFrame) -> DataFrame:
    """How many notes have 0, 1, ... sections; the numbers between are kept with zero."""
    found = _per_note(notes, spans).groupBy(F.col("sections").alias("s")).agg(F.count(F.lit(1)).alias("notes"))
    grid = notes.sparkSession.range(len(LEXICON) + 1).select(F.col("id").alias("sections"))
    return grid.join(F.broadcast(found), F.col("sections") == F.col("s"), "left").select("sections", F.coalesce("notes", F.lit(0)).cast("long").alias("notes"))


def section_count_percentiles(notes: DataFrame, spans: DataFrame) -> DataFrame:
    return _per_note(notes, spans).agg(*[quantile_disc("sections", p).alias(n) for n, p in (("p10", 0.1), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95))],
        F.max("sections").alias("most"))


def body_lengths(spans: DataFrame) -> DataFrame:
    """For each section: notes, masked ones, quantiles of the body's characters, summed within a note."""
    per = spans.where(F.col("section") != OTHER).groupBy("section", "note_id").agg(F.sum("body_chars").alias("chars"), F.bool_and("body_masked").alias("masked"))
    return per.groupBy("section").agg(F.count(F.lit(1)).alias("notes"), F.count_if("masked").alias("masked"),
        *[quantile_disc("chars", p).alias(f"p{round(p * 100)}") for p in (0.5, 0.75, 0.95)])


def strip_share(spans: DataFrame) -> DataFrame:
    """One row: notes with a diagnostic section, and the share of characters that stripping takes, overall and in the median note."""
    keys = [x.key for x in LEXICON if x.diagnostic]
    hit = F.col("section").isin(keys)
    per = spans.groupBy("note_id").agg(F.sum("span_chars").alias("chars"), F.sum(F.when(hit, F.col("span_chars")).otherwise(0)).alias("gone"))
    return per.agg(F.count_if(F.col("gone") > 0).alias("notes"), F.round(ratio(F.sum("gone"), F.sum("chars")), 9).alias("share"),
        F.round(F.expr("percentile(gone / chars, 0.5)"), 9).alias("median_share"))


def strip_residue(notes: DataFrame, spans: DataFrame) -> DataFrame:
    """One row: kept parts, and notes, in which a header of a diagnostic section is left, each part searched by itself."""
    keys = [x.key for x in LEXICON if x.diagnostic]
    names = [s for x in LEXICON if x.diagnostic for s in x.synonyms]
    total = Window.partitionBy("note_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    kept = spans.withColumn("start", F.coalesce(F.sum("span_chars").over(total), F.lit(0))).where(~F.col("section").isin(keys))
    rows = kept.join(notes.select(F.col("note_id").cast("string").alias("nn"), "text"), F.col("note_id") == F.col("nn"))
    part = F.substring(F.col("text"), F.col("start").cast("int") + 1, F.col("span_chars").cast("int"))
    left = F.exists(F.regexp_extract_all(part, F.lit(HEADER_JAVA), F.lit(1)), lambda h: normal_header_column(h).isin(names))
    return rows.where(left).agg(F.count(F.lit(1)).alias("parts"), F.count_distinct("note_id").alias("notes"))


def headerless_notes(spans: DataFrame) -> DataFrame:
    """Sectioned and headerless notes, with quantiles of their length, which the spans add up to."""
    per = spans.groupBy("note_id").agg(F.bool_or(F.col("section") != OTHER).alias("sectioned"), F.sum("span_chars").alias("chars"))
    return per.groupBy("sectioned").agg(F.count(F.lit(1)).alias("notes"), quantile_disc("chars", 0.5).alias("p50"), quantile_disc("chars", 0.95).alias("p95"))


def headerless_histogram(spans: DataFrame) -> DataFrame:
    per = spans.groupBy("note_id").agg(F.bool_or(F.col("section") != OTHER).alias("sectioned"), F.sum("span_chars").alias("chars")).where("chars > 0")
    return per.groupBy("sectioned", (F.floor(F.log10(F.col("chars").cast("double")) * 10) / F.lit(10.0)).cast("double").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def literal_sections(notes: DataFrame, headers: dict[str, str]) -> DataFrame:
    """note_id, position, section, body: the text cut at exact headers with a colon at the start of a line, each time one occurs.

    Position 0 is what comes before the first header (section null); bodies and headers, put together, are the text.
    """
    names = sorted(headers, key=lambda h: (-len(h), h))
    pattern = "(?md)^(" + "|".join(re.escape(h) for h in names) + "):"
    text = F.coalesce("text", F.lit(""))
    keys = F.create_map(*[F.lit(x) for kv in headers.items() for x in kv])
    rows = notes.select("note_id", F.split(text, pattern).alias("bodies"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("found"))
    rows = rows.select("note_id", "found", F.posexplode("bodies").alias("position", "body"))
    return rows.select("note_id", F.col("position").cast("long").alias("position"), F.try_element_at(keys, F.get("found", F.col("position") - 1)).alias("section"),
        "body")


def segment_corpus(spans: DataFrame, corpus: DataFrame) -> DataFrame:
    """The spans of the corpus; refused if a position is given twice or a note of the corpus has none."""
    return feature_table(spans, corpus, ["note_id", "position"], complete=True)
