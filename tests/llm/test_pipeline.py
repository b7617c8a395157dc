"""The pipeline's stages on small tables: what each keeps, and that odd rows pass."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import registry

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_the_columns_and_drop_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, "12 34 !!", None, None, None), (9002, None, "en", "s", 0)], docs.schema)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first()["text"]
    planted = spark.createDataFrame([(9003, f"and so it is {item} the end of it", "en", "src0", 1)], docs.schema)
    docs = docs.unionByName(extra).unionByName(planted).withColumn("rep", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        assert out.columns[: len(docs.columns)] == docs.columns
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "language_id":
            assert 9001 not in ids and 9002 not in ids and 9003 in ids
        if name == "near_duplicates":
            assert out.count() == len(ids) and out.join(docs, "doc_id", "left_anti").count() == 0
        if name == "decontamination":
            assert 9003 not in ids
        if name == "sharding":
            assert {"slot", "shard"} <= set(out.columns)
        docs = out if name != "sharding" else docs


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*COLUMNS, "slot", "shard"] and out.count() > 50


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(registry.ORACLE[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    df = registry.QUERIES[name](spark, SF)
    assert want == sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
