"""Sources, sinks and tables that grow."""

import gzip
import json

import pytest

from textloom.operators.cohort import Refused
from textloom.sources import tables as t
from textloom.streaming.incremental import process_new_files


def test_csv_keeps_everything(spark, tmp_path):
    p = tmp_path / "notes.csv"
    p.write_bytes('﻿id,text\n1,"a ""quoted"" line\nand another"\n2,NA\n3,\n4, nan \n'.encode())
    df = t.read_csv(spark, str(p))
    assert df.columns == ["id", "text"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", 'a "quoted" line\nand another'), ("2", "NA"), ("3", None), ("4", " nan ")]
    assert t.record_count(spark, str(p)) == 5  # the header is a record
    shape = t.convert_csv(spark, str(p), str(tmp_path / "out"))
    t.verify_shape(shape, {"rows": 4, "columns": ["id", "text"]})
    with pytest.raises(Refused):
        t.verify_shape(shape, {"rows": 5, "columns": ["id", "text"]})


def test_csv_refusals(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"open\n')
    (tmp_path / "b.csv.gz").write_text("id\n1\n")
    (tmp_path / "c.csv").write_bytes(b"id,\xff\n1,2\n")
    for name in ("a.csv", "b.csv.gz", "c.csv"):
        with pytest.raises(Exception):
            t.read_csv(spark, str(tmp_path / name)).collect()
    with gzip.open(tmp_path / "d.csv.gz", "wt") as f:
        f.write("id\n1\n")
    assert t.read_csv(spark, str(tmp_path / "d.csv.gz")).count() == 1
    assert t.logical_name("x/notes.csv.gz") == "notes"


def test_catalog_and_contracts(spark, tmp_path):
    df = spark.createDataFrame([("1", 1), ("2", None)], "note_id string, n long")
    df.write.parquet(str(tmp_path / "data" / "notes.parquet"))
    assert t.catalog(spark, str(tmp_path / "data")) == ["notes"]
    t.check_contract(df, {"note_id": "string"})
    for wrong in ({"note_id": "bigint"}, {"n": "bigint"}, {"gone": "string"}):
        with pytest.raises(Refused) as e:
            t.check_contract(df, wrong)
        assert "2" not in str(e.value)
    with pytest.raises(Refused):
        t.catalog(spark, str(tmp_path / "none"))


def test_parts_resume(spark, tmp_path):
    folder = str(tmp_path / "parts")
    parts = t.Parts(spark, folder, "run 1")
    parts.write(0, spark.range(3))
    parts.write(1, spark.range(3, 5))
    assert t.Parts(spark, folder, "run 1").done() == [0, 1]
    with pytest.raises(Refused):
        t.Parts(spark, folder, "run 2")
    assert parts.finish(str(tmp_path / "all")).count() == 5


def test_cache_and_provenance(spark, tmp_path):
    built = []
    build = lambda: built.append(1) or spark.range(4)
    for _ in range(2):
        assert t.cached(spark, str(tmp_path / "cache"), {"a": "1"}, build).count() == 4
    assert built == [1]
    table = str(tmp_path / "table")
    spark.range(4).write.parquet(table)
    t.write_provenance(spark, table, {"seed": 0})
    assert t.verify_provenance(spark, table)["seed"] == 0
    spark.range(5).write.mode("overwrite").parquet(table)
    with pytest.raises(Refused):
        t.verify_provenance(spark, table)


def test_guard_and_folders(spark, tmp_path):
    with pytest.raises(Refused):
        t.guard_access(spark, str(tmp_path), {"BLOCK": "1"}, ("BLOCK",))
    (tmp_path / "synthetic.json").write_text(json.dumps({"synthetic": True}))
    t.guard_access(spark, str(tmp_path), {"BLOCK": "1"}, ("BLOCK",))
    for language in ("en", "cs"):
        (tmp_path / language).mkdir()
        (tmp_path / language / "1-DS-1.txt").write_bytes(b"one\r\ntwo\n")
    rows = t.corpus_folder(spark, str(tmp_path), ("en", "cs")).collect()
    assert {(r["language"], r["note_id"], r["text"]) for r in rows} == {("en", "1-DS-1", "one\r\ntwo\n"), ("cs", "1-DS-1", "one\r\ntwo\n")}
    (tmp_path / "cs" / "2-DS-1.txt").write_text("x")
    with pytest.raises(Refused):
        t.paired_folders(t.text_folder(spark, str(tmp_path / "en")), t.text_folder(spark, str(tmp_path / "cs")))


def test_reconcile():
    assert t.reconcile({"a": 1, "b": 2}, {"a", "b"}, {"a": 1, "b": 3}, {"a"}) == {"b": (2, 3)}
    for counts in ({"a": 1}, {"a": 1, "c": 1}, {"b": 1}):
        with pytest.raises(Refused):
            t.reconcile(counts, {"a", "b"}, {"a": 1, "b": 3}, {"a"})


def test_new_files_are_processed_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.range(3).write.parquet(source)
    schema = spark.range(0).schema
    assert process_new_files(spark, source, schema, lambda df: df, target, mark) == 1
    spark.range(3, 5).write.mode("append").parquet(source)
    assert process_new_files(spark, source, schema, lambda df: df, target, mark) == 1
    assert sorted(r["id"] for r in spark.read.parquet(f"{target}/batch=0", f"{target}/batch=1").collect()) == [0, 1, 2, 3, 4]
