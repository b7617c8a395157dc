"""Removal of benchmark text: a broadcast hash set of normalised test n-grams against the windows of all documents.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z have become a-z.  A window is ten
consecutive words of an item; an item of fewer words, but not none, is one window.  Built from DataFrame
functions only:

1. Each window of m words holds a run of a = (m + 1) / 2 words (rounded down) that starts at a multiple
   of m - a + 1, wherever the window lies in a document.  So it is enough to look up the runs of a words at
   every (m - a + 1)-th word of a document among all runs of a words of the windows.  Words are split first and
   lower-cased one by one: the built-in lower-casing looks at the letters around a capital sigma, so on whole texts it
   can tell equal words apart; word by word it joins more than the exact one and loses nothing.
2. Documents with such a run are read again, and all their windows are joined as strings with the
   windows of the items: only equal texts count.
3. Positions are merged into hit words.

The windows are broadcast while there are at most BROADCAST_WINDOWS of them, else they are joined by a
shuffle.  Null and empty texts have no words; an item without id hits words but is not counted as an item;
repeated rows are returned as often as they come; a null doc_id is returned; other columns are ignored.  Empty
tables give an empty result, or rows without hits.  The words of one text, however long, are one array of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import BROADCAST_IDS, Scratch, ascii_lower, fresh, read

#: Words of a window.
WINDOW = 10
#: Windows of about 100 bytes that may be broadcast.
BROADCAST_WINDOWS = 100_000
_SEP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_SEP_ANY_CASE = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_WORD_ANY_CASE = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SEP), lambda w: w != "")


def _grams(words: Column, m: int, step: int = 1) -> Column:
    """The runs of m words at every step-th word, joined by a space; an empty array if there are too few words."""
    at = F.sequence(F.lit(1), F.size(words) - (m - 1), F.lit(step))
    return F.when(F.size(words) >= m, F.transform(at, lambda i: F.array_join(F.slice(words, i, m), " "))).otherwise(F.array().cast("array<string>"))


def _hashes(words: Column, m: int, step: int) -> Column:
    at = F.sequence(F.lit(0), F.size(words) - m, F.lit(step))
    return F.when(F.size(words) >= m, F.transform(at, lambda i: F.xxhash64(F.lit(m), *[F.get(words, i + k)
        for k in range(m)]))).otherwise(F.array().cast("array<bigint>"))


def _run(m: int) -> tuple[int, int]:
    a = max(1, m // 2)
    return a, m - a + 1


def windows(benchmark: DataFrame) -> DataFrame:
    """One row for each distinct window: m (its words), gram, items (the ids of its items as strings)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), _words(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("gram", F.explode(F.when(F.size("w") >= WINDOW, _grams(F.col("w"), WINDOW)).otherwise(F.array(F.array_join("w", " ")))))
    items = items.withColumn("m", F.least(F.size("w"), F.lit(WINDOW)))
    return items.groupBy("m", "gram").agg(F.collect_set("item").alias("items"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_WINDOWS else df


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, spans (merged runs of hit words as structs of start and end), items (sorted)."""
    scratch = scratch or Scratch(spark)
    docs = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text"))
    wins = scratch.write(windows(benchmark), "windows")
    n_wins = wins.count()
    sizes = sorted(r["m"] for r in wins.select("m").distinct().collect())  # WINDOW values at most

    loose = wins.select("m", F.transform(F.split("gram", " "), F.lower).alias("w"))
    loose = loose.select(F.explode(F.concat(F.array().cast("array<bigint>"), *[F.when(F.col("m") == m, _hashes(F.col("w"), _run(m)[0],
        1)).otherwise(F.array().cast("array<bigint>")) for m in sizes])).alias("h")).distinct()
    loose = loose.withColumn("hit", F.lit(True))
    scan = docs.select("doc_id", "th", F.transform(F.split(F.coalesce("text", F.lit("")), _SEP_ANY_CASE), F.lower).alias("w"))
    n_words = F.size("w") - (F.get("w", F.lit(0)) == "").cast("int") - ((F.size("w") > 1) & (F.element_at("w", -1) == "")).cast("int")
    scan = scan.select("doc_id", "th", n_words.cast("long").alias("n_words"),
        F.concat(F.array().cast("array<bigint>"), *[_hashes(F.col("w"), *_run(m)) for m in sizes]).alias("h"))
    scan = scan.select("doc_id", "th", "n_words", F.posexplode_outer("h").alias("p", "h"))
    scan = scan.join(_small(loose, WINDOW * n_wins // 2), "h", "left").where("hit or p is null or p = 0")
    scan = scan.groupBy("doc_id", "th").agg(F.max("n_words").alias("n_words"), F.count_if(F.expr("p is null or p = 0")).alias("copies"),
        F.coalesce(F.bool_or("hit"), F.lit(False)).alias("hit"))
    scan = scratch.write(scan, "scan")

    hit = scan.where("hit").select(F.col("doc_id").alias("d"), F.col("th").alias("t"))
    if hit.count() <= BROADCAST_IDS // 2:
        hit = F.broadcast(hit)
    found = docs.join(hit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left_semi").select("doc_id", "th",
        _words(ascii_lower(F.col("text"))).alias("w"))
    def placed(m: int) -> Column:
        return F.transform(_grams(F.col("w"), m), lambda g, i: F.struct(F.lit(m).alias("m"), i.alias("start"), g.alias("gram")))

    all_grams = [placed(m) for m in sizes]
    if all_grams:
        found = found.select("doc_id", "th", F.inline(F.concat(*all_grams)))
        found = found.join(_small(wins, n_wins), ["m", "gram"])
        found = found.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("m")).alias("end")))).alias("s"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        merged = F.aggregate("s", F.array().cast("array<struct<start:int,end:int>>"), lambda out,
            x: F.when((F.size(out) > 0) & (F.element_at(out, -1)["end"] >= x["start"]),
            F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"),
            F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(out, F.array(x))))
        found = found.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), merged.alias("spans"), "items")
        scan = scan.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("th").eqNullSafe(F.col("t")), "left")
    else:
        scan = scan.withColumn("spans", F.lit(None)).withColumn("items", F.lit(None))
    spans = F.coalesce(F.col("spans").cast("array<struct<start:int,end:int>>"), F.array().cast("array<struct<start:int,end:int>>"))
    items = F.coalesce(F.col("items").cast("array<string>"), F.array().cast("array<string>"))
    return scan.select("doc_id", "th", "n_words", spans.alias("spans"), items.alias("items"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """docs without the documents that hold a window, or (remove="spans") without the words that are hit; columns as in docs."""
    scratch = Scratch(spark)
    d, t, spans, th = (fresh(x) for x in ("id", "text", "spans", "th"))
    hit = contamination(spark, docs, benchmark, scratch).where(F.size("spans") > 0).select(F.col("doc_id").alias(d), F.col("th").alias(t),
        F.col("spans").alias(spans)).distinct()
    hit = scratch.write(hit, "hit")
    side = F.broadcast(hit) if remove == "documents" and hit.count() <= BROADCAST_IDS // 2 else hit
    if remove == "documents":
        same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t))
        return docs.join(side.drop(spans), same, "left_anti")
    out = docs.withColumn(th, F.xxhash64("text")).join(side, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(th) == F.col(t)), "left")
    gaps = F.split("text", _WORD_ANY_CASE)
    words = F.regexp_extract_all("text", F.lit("(" + _WORD_ANY_CASE + ")"))
    left = F.transform(words, lambda w, i: F.when(F.exists(spans, lambda x: (i >= x["start"]) & (i < x["end"])), F.lit("")).otherwise(w))
    text = F.array_join(F.zip_with(gaps, left, lambda g, w: F.concat(F.coalesce(g, F.lit("")), F.coalesce(w, F.lit("")))), "")
    return out.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(text)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i + 1 : i + m], ' ') AS gram FROM bi),
ms AS (SELECT DISTINCT m FROM win),
dp AS (SELECT doc_id, w, m, unnest(range(0, len(w) - m + 1)) AS i FROM d, ms WHERE len(w) >= m),
hit AS (SELECT p.doc_id, p.i, p.m, win.item_id FROM (SELECT doc_id, i, m, array_to_string(w[i + 1 : i + m], ' ') AS gram FROM dp) p JOIN win ON win.m = p.m AND win.gram = p.gram),
pos AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS x FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
