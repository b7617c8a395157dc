"""Mixing of sources to target weights by Poisson replication.

A source of n rows and target share w gets the mean repetition rate total * w / n.  Each row draws its number
of copies from the Poisson distribution with that mean, by inverting it at a number between 0 and 1 that the
MD5 of seed, doc_id and draw gives; rates above PIECE are sums of draws with equal smaller rates.  Rows are
exploded by their counts and dealt out by the MD5 of seed, doc_id and copy, sorted by it within partitions: a
global shuffle that any rerun repeats.  DataFrame functions only.

Without given weights a source's share is in proportion to its rows to the power of ALPHA, and total is the
number of input rows.  A null source is a source; sources without a given weight get none and vanish, as do
rows that draw 0.  A null doc_id draws as the empty text; repeated rows draw alike.  The rates are broadcast
while there are at most 100,000 sources, else joined; a source that holds a third of all rows is one row of
that table.  An empty table gives an empty result.  Columns of the input that are named copy
or shuffle_key, in any case, are replaced; all others are carried along.  Texts, however long, are only carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, fresh, read

ALPHA, PIECE, SEED = 0.5, 16.0, 17
_BROADCAST_SOURCES = 100_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _cdf(rate: Column) -> Column:
    """P(X <= k) for k from 0 to where the rest is below double precision; empty for a rate that is not positive."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    terms = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int"))
    step = lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * rate / k)).alias("c"))
    return F.aggregate(terms, start, step)["c"]


def rates(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None) -> DataFrame:
    """One row for each source that has a positive weight: src, rate, draws, cdf."""
    n = docs.groupBy(F.col("source").alias("src")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow("n", F.lit(ALPHA)))
    else:
        w = weights.groupBy(F.col("source").alias("of")).agg(F.sum(F.col("weight").cast("double")).alias("w"))
        n = n.join(w, F.col("src").eqNullSafe(F.col("of"))).drop("of").where("w > 0")
    sums = n.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))  # one row
    n = n.crossJoin(F.broadcast(sums)).withColumn("rate", (F.lit(float(total)) if total else F.col("all_n")) * F.col("w") / F.col("all_w") / F.col("n"))
    n = n.withColumn("draws", F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int"))
    return n.select("src", "rate", "draws", _cdf(F.col("rate") / F.col("draws")).alias("cdf"))


def mix(spark: SparkSession, docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, seed: int = SEED) -> DataFrame:
    """The columns of docs, with copy (from 1) and shuffle_key (the place in the global order)."""
    table = Scratch(spark).write(rates(docs, weights, total), "rates")
    n_sources = table.count()
    src, rate, draws, cdf, u, copies = (fresh(x) for x in ("src", "rate", "draws", "cdf", "u", "copies"))
    table = table.toDF(src, rate, draws, cdf)
    side = F.broadcast(table) if n_sources <= _BROADCAST_SOURCES else table
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    draw = lambda j: F.size(F.filter(cdf, lambda c: c <= uniform(F.lit(str(seed)), key, j.cast("string"))))
    one = F.size(F.filter(cdf, lambda c: c <= F.col(u)))
    many = F.aggregate(F.sequence(F.lit(2), F.greatest(F.col(draws), F.lit(2))), F.lit(0), lambda s, j: s + draw(j))
    names = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    out = docs.select(*names).join(side, F.col("source").eqNullSafe(F.col(src))).withColumn(u, uniform(F.lit(str(seed)), key, F.lit("1")))
    out = out.withColumn(copies, one + F.when(F.col(draws) > 1, many).otherwise(0)).where(F.col(copies) > 0)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), key, F.col("copy").cast("string"))))
    return out.select(*names, "copy", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark, read(spark, sf_dir, "documents"))
    return out.withColumn("copy", F.col("copy").cast("long"))


ORACLE = f"""
WITH n AS (SELECT source AS src, count(*)::DOUBLE AS n, pow(count(*)::DOUBLE, {ALPHA}) AS w FROM documents GROUP BY source),
r AS (SELECT src, sum(n) OVER () * w / sum(w) OVER () / n AS rate FROM n),
d AS (SELECT src, rate, greatest(ceil(rate / {PIECE}), 1)::INT AS draws FROM r),
k AS (SELECT src, rate / draws AS l, draws, unnest(range(0, (ceil(rate / draws + 12 * sqrt(rate / draws) + 20))::INT + 1)) AS k FROM d),
c AS (SELECT src, draws, k, sum(exp(-l + k * ln(l) - lgamma(k + 1))) OVER (PARTITION BY src ORDER BY k) AS c FROM k),
cdf AS (SELECT src, draws, list(c ORDER BY k) AS cdf FROM c GROUP BY src, draws),
u AS (SELECT doc_id, text, lang, source, n_chars, cdf, unnest(range(1, draws + 1)) AS j FROM documents JOIN cdf ON source IS NOT DISTINCT FROM src),
v AS (SELECT doc_id, text, lang, source, n_chars, len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('{SEED}:' || doc_id || ':' || j), 1, 13))::BIGINT::DOUBLE / {1 << 52})) AS n FROM u),
t AS (SELECT doc_id, text, lang, source, n_chars, sum(n) AS n FROM v GROUP BY ALL),
e AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n::BIGINT + 1)) AS copy FROM t)
SELECT doc_id, text, lang, source, n_chars, copy::BIGINT AS copy, md5('order{SEED}:' || doc_id || ':' || copy) AS shuffle_key FROM e
"""
