"""What the operators share: heavy keys, components, folders."""

import collections
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from textloom.llm import common


def test_heavy_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 4)
    rng = random.Random(1)
    rows = [(rng.choice([0] * 20 + list(range(30))), k) for k in range(400)]
    frame = spark.createDataFrame([*rows, (None, 1000)], "key long, x long")
    counts = collections.Counter(k for k, _ in rows)
    table = spark.createDataFrame([(k, n, k * 10) for k, n in counts.items() if k != 7], "key long, n long, y long")
    got = common.join_heavy(frame, table, ["key"], "n", len(rows))
    assert sorted((r["key"], r["x"], r["y"]) for r in got.collect()) == sorted((k, x, k * 10) for k, x in rows if k != 7)
    assert sum(n * 4 >= len(rows) for n in counts.values()) == 1


@pytest.mark.parametrize("edges,want", [
    ([], {}),
    ([(1, 1)], {}),
    ([(k, k + 1) for k in range(40)], {k: 0 for k in range(41)}),
    ([(9, k) for k in range(20, 60)] + [(3, 70), (70, 71)], {9: 9, **{k: 9 for k in range(20, 60)}, 3: 3, 70: 3, 71: 3}),
])
def test_components(spark, edges, want):
    scratch = common.Scratch(spark)
    got = common.components(scratch, spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["comp"] for r in got.collect()} == want
    scratch.clear()


def test_narrow_tables_keep_their_rows_and_are_deleted(spark):
    scratch = common.Scratch(spark)
    table = scratch.write(spark.range(100).repartition(50), "t", narrow=True)
    assert table.count() == 100 and table.rdd.getNumPartitions() <= 50
    scratch.drop(table)
    with pytest.raises(Exception):
        spark.read.parquet(table._scratch_path).count()
    scratch.clear()


def test_a_cluster_needs_a_shared_folder():
    def session(master):
        conf = SimpleNamespace(get=lambda key, default=None: default, set=lambda key, value: None)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            common.scratch_dir(session(master))
    assert common.scratch_dir(session("local[2]"))


def test_batches_are_bounded_unless_the_session_says_otherwise(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        common.ready(spark)
        own = spark.conf.get(key)
        spark.conf.set(key, str(common._DEFAULT_BATCH))
        common.ready(spark)
        assert spark.conf.get(key).rstrip("bB") == str(common.BATCH_BYTES) and own == "64m"
    finally:
        spark.conf.set(key, before)


def test_fresh_names_differ():
    assert len({common.fresh("x") for _ in range(100)}) == 100 and F.col(common.fresh("x")) is not None
