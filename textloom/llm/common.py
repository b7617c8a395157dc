"""What the operators share: reading tables, written intermediate tables, checked broadcasts, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import ship

#: Ids that may be broadcast, 75 bytes each as measured: 15 MB.  More are joined by a shuffle.
BROADCAST_IDS = 200_000


#: Bytes of an Arrow batch, for sessions that leave Spark's default: tasks then hold a few megabytes of texts at a time.
BATCH_BYTES, _DEFAULT_BATCH = 4 << 20, 64 << 20
#: Tasks a core that write a narrow table.
WAVES = 2
#: A key that holds one row in HEAVY or more is heavy: there are at most HEAVY such keys.
HEAVY = 1000


def ready(spark: SparkSession) -> None:
    """Sends the package to the executors, and bounds the batches that they get."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("bB") == str(_DEFAULT_BATCH):
        spark.conf.set(key, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def release() -> None:
    """Gives memory that a worker no longer needs back to the system; workers live on for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow, with this package sent to the executors."""

    def run(batches):
        yield from function(batches)
        release()

    ready(df.sparkSession)
    return df.mapInArrow(run, schema)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared folder that the session names; only a local session may do without one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


class Scratch:
    """Tables written to the shared folder, so that lost executors cost one stage and no lineage grows."""

    def __init__(self, spark: SparkSession):
        ready(spark)
        self.spark, self.root, self.n = spark, scratch_dir(spark), 0

    def write(self, df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
        """The table, written and to be read again; a narrow one (some numbers a row) by no more than WAVES tasks a core, in as many files."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        (df.coalesce(WAVES * self.spark.sparkContext.defaultParallelism) if narrow else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for t in tables:
            self._delete(t._scratch_path)

    def clear(self) -> None:
        """Deletes all tables."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def keep_ids(df: DataFrame, key: str, ids: DataFrame, n_ids: int, how: str = "left_semi") -> DataFrame:
    """Rows of df whose key is (left_semi) or is not (left_anti) in ids, a table of one column with n_ids rows."""
    name = fresh("ids")
    ids = ids.toDF(name)
    if n_ids <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, F.col(key) == ids[name], how)


def join_heavy(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows joined with table, whose keys are distinct, and whose weight is the number of rows of the key.

    Heavy keys, at most HEAVY of them, are broadcast, so that their rows stay where they are; the others are joined by a shuffle.
    """
    heavy = table.where(F.col(weight) * HEAVY >= total)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(table.where(F.col(weight) * HEAVY < total), keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(rest)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (id, comp) for each vertex with an edge, comp the smallest id.

    Each vertex takes the smallest label among its neighbours, then the label of its label; rounds go on
    until no label changes.  Sums and joins only: a vertex with very many edges is pre-aggregated, and its
    joins are such that adaptive execution may split them.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.write(both, "edges", narrow=True)
    lab = scratch.write(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), "labels", narrow=True)
    while True:
        near = both.join(lab.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        hooked = scratch.write(lab.join(near, "id").select("id", "comp", F.least("comp", "m").alias("new")), "hooked", narrow=True)
        jumped = hooked.join(hooked.select(F.col("id").alias("new"), F.col("new").alias("far")), "new").select("id", "comp", F.least("new", "far").alias("new"))
        jumped = scratch.write(jumped, "labels", narrow=True)
        changed = jumped.where("comp <> new").limit(1).count()
        scratch.drop(lab, hooked)
        lab = jumped.select("id", F.col("new").alias("comp"))
        lab._scratch_path = jumped._scratch_path
        if not changed:
            scratch.drop(both)
            return lab
