"""Reading and writing tables: lossless CSV, Parquet with contracts, text folders, JSON lines, caches and side-cars.

Refusals name columns and counts, never values.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.cohort import Refused


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The columns that the first line names; a byte order mark is no part of the first name; bytes that are not UTF-8 are refused."""
    line = spark.read.option("encoding", "UTF-8").text(path).limit(1).collect()
    if not line:
        raise Refused("the table has no header")
    text = line[0]["value"].removeprefix("﻿")
    if "�" in text:
        raise Refused("the header is not UTF-8")
    import csv

    names = next(csv.reader([text]))
    if not all(names) or len(set(names)) < len(names):
        raise Refused("the header repeats or lacks a name")
    return names


def check_quotes(spark: SparkSession, path: str) -> None:
    """Refuses a file with an odd number of quotes: a field is not closed."""
    n = spark.read.text(path).agg(F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))).first()[0]
    if (n or 0) % 2:
        raise Refused("a quoted field is not closed")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns text; only an empty field is null, so NA, NULL and nan stay; fields may hold newlines.

    A name that ends in .gz must be compressed.  A row with too many or too few fields fails the query.
    """
    if path.endswith(".gz"):
        head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 2).alias("h")).limit(1).collect()
        if not head or bytes(head[0]["h"]) != b"\x1f\x8b":
            raise Refused("the file is not compressed as its name says")
    check_quotes(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in csv_header(spark, path)])
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=True, multiLine=True, quote='"', escape='"', nullValue="", emptyValue="", mode="FAILFAST",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def convert_csv(spark: SparkSession, source: str, target: str) -> dict:
    """Writes the table as Parquet and gives its shape."""
    df = read_csv(spark, source)
    df.write.mode("overwrite").option("compression", "zstd").parquet(target)
    back = spark.read.parquet(target)
    return {"rows": back.count(), "columns": back.columns}


def verify_shape(shape: dict, expected: dict) -> None:
    """Refuses a load whose rows or ordered columns differ from the inventory."""
    if shape["rows"] != expected["rows"] or list(shape["columns"]) != list(expected["columns"]):
        raise Refused("the load differs from its inventory")


def record_count(spark: SparkSession, path: str) -> int:
    """Records by the parity of quotes, apart from the CSV reader: a record ends on a line up to which quotes are even.

    Lines are counted within splits of one file; the first pass sums the quotes of each split, the second starts from the sum before it.
    """
    lines = spark.read.text(path).select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"),
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("q"))
    lines = lines.persist()
    sums = {r["p"]: r["q"] for r in lines.groupBy("p").agg(F.sum("q").alias("q")).collect()}  # a row for each split
    before, total = {}, 0
    for p in sorted(sums):
        before[p], total = total, total + sums[p]
    from pyspark.sql import Window

    start = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("p")) if before else F.lit(0)
    upto = F.sum("q").over(Window.partitionBy("p").orderBy("i")) + start
    n = lines.select((upto % 2 == 0).alias("end")).agg(F.count_if("end")).first()[0]
    lines.unpersist()
    return n


def logical_name(file: str) -> str:
    name = file.rstrip("/").rpartition("/")[2]
    for suffix in (".gz", ".csv", ".parquet"):
        name = name.removesuffix(suffix)
    return name


def inventory(entries: list[dict]) -> dict[str, dict]:
    """Entries (name, rows, columns) by logical name; refuses names that repeat."""
    out = {logical_name(e["name"]): {"rows": e["rows"], "columns": e["columns"]} for e in entries}
    if len(out) < len(entries):
        raise Refused("the inventory repeats a table")
    return out


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def catalog(spark: SparkSession, folder: str, create_views: bool = True) -> list[str]:
    """One view for each *.parquet of a folder, named by its stem, in order; refuses a folder that is missing or has none."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        raise Refused("the folder is missing")
    names = sorted(s.getPath().getName() for s in fs.listStatus(p))
    names = [n for n in names if n.endswith(".parquet")]
    if not names:
        raise Refused("the folder holds no table")
    for n in names if create_views else []:
        view(spark, n.removesuffix(".parquet"), f"{folder}/{n}")
    return [n.removesuffix(".parquet") for n in names]


def view(spark: SparkSession, name: str, path: str) -> DataFrame:
    try:
        df = spark.read.parquet(path)
    except Exception as e:
        raise Refused(f"{name}: {type(e).__name__}") from None
    df.createOrReplaceTempView(name)
    return df


def check_contract(df: DataFrame, columns: dict[str, str]) -> None:
    """Refuses missing columns, other types, and nulls: one aggregate over all columns."""
    have = dict(df.dtypes)
    missing = [c for c in columns if c not in have]
    wrong = [c for c in columns if c in have and have[c] != columns[c]]
    if missing or wrong:
        raise Refused(f"missing {missing}, of another type {wrong}")
    nulls = columns and df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict()
    if any(nulls.values()):
        raise Refused(f"nulls in {[c for c, n in nulls.items() if n]}")


def read_contract(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    df = spark.read.parquet(path)
    check_contract(df, columns)
    return df.select(*columns)


def read_exact(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """The table if its columns and types are exactly those, else a refusal; columns are chosen after the check."""
    df = spark.read.parquet(path)
    if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in schema]:
        raise Refused("the schema differs")
    check_contract(df, {f.name: f.dataType.simpleString() for f in schema if not f.nullable})
    return df.select(*columns) if columns else df


def string_table(spark: SparkSession, columns: list[str], rows: list[dict]) -> DataFrame:
    """A small table of text columns; missing keys are null."""
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def feature_table(df: DataFrame, corpus: DataFrame, key: list[str], complete: bool = False) -> DataFrame:
    """A feature artifact cut to the corpus; refuses repeated keys and, if complete, notes of the corpus that it lacks."""
    if df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise Refused("the artifact repeats a key")
    ids = corpus.select(F.col("note_id").alias("__n"))
    if complete and ids.join(df, F.col("__n") == F.col("note_id"), "left_anti").limit(1).count():
        raise Refused("the artifact lacks notes of the corpus")
    return df.join(ids, F.col("note_id") == F.col("__n"), "left_semi")


def concat_parts(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Tables one after the other, with their place as `part`."""
    out = None
    for k, p in enumerate(paths):
        one = read_exact(spark, p, schema).withColumn("part", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


class Parts:
    """Resumable units of work: folders unit=<n>, each complete once its success mark is there, under one key."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder, hashlib.sha256(key.encode()).hexdigest()
        mark = f"{folder}/key-{self.key}"
        if exists(spark, folder) and not exists(spark, mark):
            raise Refused("the parts belong to another run")
        fs, p = _fs(spark, mark)
        if not fs.exists(p):
            fs.mkdirs(p)

    def done(self) -> list[int]:
        fs, p = _fs(self.spark, self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        units = sorted(int(n[5:]) for n in names if n.startswith("unit=") and exists(self.spark, f"{self.folder}/{n}/_SUCCESS"))
        if units != list(range(len(units))):
            raise Refused("a part is missing")
        return units

    def write(self, unit: int, df: DataFrame) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/unit={unit}")

    def read(self) -> DataFrame:
        """All units that are done."""
        return self.spark.read.parquet(*[f"{self.folder}/unit={u}" for u in self.done()])

    def finish(self, target: str) -> DataFrame:
        self.read().write.mode("overwrite").parquet(target)
        fs, p = _fs(self.spark, self.folder)
        fs.delete(p, True)
        return self.spark.read.parquet(target)


def cached(spark: SparkSession, folder: str, inputs: dict[str, str], build) -> DataFrame:
    """The table for these inputs: read if it was published, else built, written beside and renamed."""
    key = hashlib.sha256(json.dumps(inputs, sort_keys=True).encode()).hexdigest()
    target = f"{folder}/{key}"
    if not exists(spark, f"{target}/_SUCCESS"):
        staged = f"{folder}/.staged-{uuid.uuid4().hex}"
        build().write.parquet(staged)
        fs, p = _fs(spark, target)
        fs.delete(p, True)
        if not fs.rename(_fs(spark, staged)[1], p):
            raise Refused("the table cannot be published")
    return spark.read.parquet(target)


def missing_embeddings(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts whose digest the cache lacks."""
    rows = texts.select("text", F.sha2("text", 256).alias("text_sha256")).dropDuplicates(["text_sha256"])
    return rows.join(cache.select(F.col("text_sha256").alias("c")), F.col("text_sha256") == F.col("c"), "left_anti")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """name and SHA-256 of each file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"))


def fingerprint(digests: DataFrame) -> str:
    """The digest of the sorted list `sha256  name`, a line for each file."""
    out = hashlib.sha256()
    for r in digests.select(F.concat("sha256", F.lit("  "), "name").alias("l")).orderBy("l").toLocalIterator():
        out.update((r["l"] + "\n").encode())
    return out.hexdigest()


def write_provenance(spark: SparkSession, table: str, facts: dict) -> str:
    """A side-car with the fingerprint of the table's files; gives its path."""
    body = json.dumps({"fingerprint": fingerprint(file_digests(spark, table).where("name like 'part-%'")), **facts}, sort_keys=True)
    path = f"{table.rstrip('/')}.provenance"
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def verify_provenance(spark: SparkSession, table: str) -> dict:
    facts = read_manifest(spark, f"{table.rstrip('/')}.provenance")
    if facts["fingerprint"] != fingerprint(file_digests(spark, table).where("name like 'part-%'")):
        raise Refused("the table is not the one of its side-car")
    return facts


def reconcile(counts: dict[str, int], known: set[str], expected: dict[str, int], mandatory: set[str]) -> dict[str, tuple[int, int]]:
    """Tables whose counts differ from the inventory; refuses unknown tables, set differences and missing mandatory ones."""
    if set(counts) - known or set(counts) ^ set(expected) or mandatory - set(counts):
        raise Refused("the set of tables differs")
    return {k: (n, expected[k]) for k, n in counts.items() if n != expected[k]}


def guard_access(spark: SparkSession, folder: str, environment: dict[str, str], blocking: tuple[str, ...]) -> None:
    """Refuses to read data that no synthetic.json marks as synthetic while a blocking variable is set."""
    marked = False
    if exists(spark, f"{folder}/synthetic.json"):
        try:
            marked = read_manifest(spark, f"{folder}/synthetic.json") == {"synthetic": True}
        except ValueError:
            marked = False
    if not marked and any(environment.get(v) for v in blocking):
        raise Refused("real data may not be read here")


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """name and text of each file, line ends as they are."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("name"), F.col("value").alias("text"))


def paired_folders(a: DataFrame, b: DataFrame) -> DataFrame:
    """name, a, b; refuses names without a counterpart."""
    rows = a.toDF("name", "a").join(b.toDF("name", "b"), "name", "full_outer")
    n = rows.where("a is null or b is null").limit(1).count()
    if n:
        raise Refused("a file lacks its counterpart")
    return rows


def corpus_folder(spark: SparkSession, root: str, languages: tuple[str, ...]) -> DataFrame:
    """language, note_id, text of a tree <language>/<note_id>.txt."""
    out = None
    for language in languages:
        one = text_folder(spark, f"{root}/{language}").select(F.lit(language).alias("language"), F.col("name").alias("note_id"), "text")
        out = one if out is None else out.unionByName(one)
    if out.where("note_id = ''").limit(1).count():
        raise Refused("a file is not expected here")
    return out


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A declared schema; a line that does not fit it fails the query."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def write_json_lines(df: DataFrame, path: str) -> None:
    """A line for each row; null fields are written, so that each line has all keys."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_table(df: DataFrame, path: str, schema: T.StructType) -> None:
    """A typed table: columns in the order and of the types of the schema, or a refusal; an empty one keeps its types."""
    have = {f.name: f.dataType for f in df.schema}
    if have != {f.name: f.dataType for f in schema}:
        raise Refused("the schema differs")
    df.select(*schema.names).write.mode("overwrite").option("compression", "zstd").parquet(path)


def batches(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None, size: int = 10_000):
    """Lists of up to size rows, a partition at a time, of a table whose schema is checked first."""
    rows: list = []
    for r in read_exact(spark, path, schema, columns).toLocalIterator():
        rows.append(r)
        if len(rows) == size:
            yield rows
            rows = []
    if rows:
        yield rows


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _schema(columns: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in (c.split() for c in columns.split(", "))])


#: The tables that runs exchange.
NOTES = _schema("note_id string, subject_id string, hadm_id string, text string")
PREDICTIONS = _schema("row_id string, fold bigint, note_id bigint, subject_id bigint, diagnosis string, label boolean, score double, predicted boolean")
METRICS = _schema("row_id string, diagnosis string, n bigint, positives bigint, precision double, recall double, f1 double, accuracy double, roc_auc double, pr_auc double")
SCREENING = _schema("fold int, vectorizer string, family string, diagnosis string, threshold double, n bigint, positives bigint, precision double, recall double, f1 double, accuracy double")
TRIALS = _schema("diagnosis string, trial int, value double, params string")


def notes_of(spark: SparkSession, path: str, patients: DataFrame | None = None) -> DataFrame:
    """The typed note table, of some patients if they are given."""
    notes = read_exact(spark, path, NOTES)
    return notes if patients is None else notes.join(patients.select(F.col("subject_id").alias("__s")).distinct(), F.col("subject_id") == F.col("__s"), "left_semi")


def write_parts(tables: dict[str, tuple[DataFrame, T.StructType]], folder: str) -> None:
    """Several typed tables of one measurement, all checked before the first is written."""
    for df, schema in tables.values():
        if {f.name: f.dataType for f in df.schema} != {f.name: f.dataType for f in schema}:
            raise Refused("the schema differs")
    for name, (df, schema) in tables.items():
        write_table(df, f"{folder}/{name}", schema)
