"""The relations that the operators work on, derived from the given tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Each may use the given tables and the relations before it.
LENS = {
    # notes with their patient and admission; every tenth note has no admission
    "discharge": """
SELECT concat(CAST(doc_id % 400 + 1 AS STRING), '-DS-', CAST(doc_id + 1 AS STRING)) AS note_id,
       CAST(doc_id % 400 + 1 AS STRING) AS subject_id,
       CASE WHEN doc_id % 10 = 3 THEN NULL ELSE CAST(doc_id + 1 AS STRING) END AS hadm_id, text
FROM documents""",
    # a second corpus: pages as notes
    "radiology": """
SELECT concat(CAST(page_id % 100 + 1 AS STRING), '-RR-', CAST(page_id + 1 AS STRING)) AS note_id,
       CAST(page_id % 100 + 1 AS STRING) AS subject_id,
       CASE WHEN page_id % 8 = 5 THEN NULL ELSE CAST(page_id + 1 AS STRING) END AS hadm_id, html AS text
FROM pages""",
    # codes of admissions, all as text; some are missing or malformed
    "diagnoses_icd": """
SELECT CAST(doc_id + 1 AS STRING) AS hadm_id, icd_code, icd_version FROM (
  SELECT doc_id, 'Z00' AS icd_code, '10' AS icd_version FROM labels
  UNION ALL SELECT doc_id, 'E119', '10' FROM labels WHERE quality = 1 AND doc_id % 2 = 0
  UNION ALL SELECT doc_id, '25000', '9' FROM labels WHERE toxic = 1 OR doc_id % 9 = 1
  UNION ALL SELECT doc_id, 'I48', '10' FROM labels WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, '4273', '9' FROM labels WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 'J189', '10' FROM labels WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, ' n189 ', '10' FROM labels WHERE doc_id % 7 = 0
  UNION ALL SELECT doc_id, 'J449', '10' FROM labels WHERE doc_id % 6 = 1
  UNION ALL SELECT doc_id, CAST(NULL AS STRING), '10' FROM labels WHERE doc_id % 11 = 0
  UNION ALL SELECT doc_id, 'E11.9', '10' FROM labels WHERE doc_id % 13 = 0
  UNION ALL SELECT doc_id, 'E8859', '9' FROM labels WHERE doc_id % 6 = 2) x""",
    # many codes: one note for each order, codes from its parts
    "order_notes": """
SELECT concat(CAST(o_custkey AS STRING), '-DS-', CAST(o_orderkey AS STRING)) AS note_id, CAST(o_custkey AS STRING) AS subject_id,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey AS STRING) END AS hadm_id
FROM orders""",
    "order_codes": """
SELECT CAST(l_orderkey AS STRING) AS hadm_id, upper(replace(replace(p_brand, '#', ''), 'Brand', CASE WHEN l_returnflag = 'A' THEN 'E' ELSE 'B' END)) AS icd_code,
       CASE WHEN l_returnflag = 'N' THEN '10' ELSE '9' END AS icd_version
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "code_titles": """
SELECT upper(replace(p_brand, 'Brand#', 'B')) AS icd_code, '9' AS icd_version, min(p_type) AS long_title FROM part GROUP BY p_brand
UNION ALL SELECT upper(replace(p_brand, 'Brand#', 'B')), '10', max(p_type) FROM part GROUP BY p_brand""",
    "patients": """
SELECT CAST(c_custkey AS STRING) AS subject_id, CASE c_custkey % 7 WHEN 0 THEN 'F' WHEN 1 THEN 'F' WHEN 2 THEN 'M' WHEN 3 THEN 'M' WHEN 4 THEN 'F' WHEN 5 THEN 'M' ELSE '?' END AS gender,
       CASE WHEN c_custkey % 31 = 0 THEN 'x' ELSE CAST(18 + c_custkey % 74 AS STRING) END AS anchor_age, '1993' AS anchor_year,
       CASE c_custkey % 4 WHEN 0 THEN '2008 - 2010' WHEN 1 THEN '2011 - 2013' WHEN 2 THEN '2014 - 2016' ELSE '2017 - 2019' END AS anchor_year_group
FROM customer WHERE c_custkey % 50 <> 49""",
    "admissions": """
SELECT CAST(o_orderkey AS STRING) AS hadm_id, CAST(o_custkey AS STRING) AS subject_id, CAST(year(o_orderdate) AS STRING) AS admit_year,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Medicare' WHEN 'MACHINERY' THEN 'Medicaid' WHEN 'HOUSEHOLD' THEN 'Private' WHEN 'FURNITURE' THEN 'Private' ELSE NULL END AS insurance,
       CASE n_regionkey WHEN 0 THEN 'ENGLISH' WHEN 1 THEN 'ENGLISH' WHEN 2 THEN 'SPANISH' ELSE '?' END AS language,
       CASE c_custkey % 5 WHEN 0 THEN 'MARRIED' WHEN 1 THEN 'SINGLE' WHEN 2 THEN 'WIDOWED' WHEN 3 THEN 'DIVORCED' ELSE '' END AS marital_status,
       CASE WHEN c_custkey % 13 = 0 THEN 'SOUTH AMERICAN' WHEN c_custkey % 13 = 1 THEN 'HISPANIC/LATINO - CUBAN' ELSE CASE n_regionkey WHEN 0 THEN 'BLACK/AFRICAN' WHEN 1 THEN 'WHITE - OTHER EUROPEAN' WHEN 2 THEN 'ASIAN - CHINESE' WHEN 3 THEN 'WHITE' ELSE 'UNABLE TO OBTAIN' END END AS race
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    # notes with headed sections; every part of the text is in one of them
    "sectioned": """
SELECT CAST(doc_id + 1 AS STRING) AS note_id, doc_id,
  concat('Name: ___', chr(10),
    CASE WHEN doc_id % 5 <> 0 THEN concat('Allergies:', chr(10), substring(text, 1, 40), chr(10)) ELSE '' END,
    CASE WHEN doc_id % 10 = 1 THEN concat('Medications on Admission:', chr(10), '___', chr(10)) ELSE '' END,
    'Chief Complaint: ', CASE WHEN doc_id % 5 <> 0 THEN substring(text, 41, 60) ELSE substring(text, 1, 100) END, chr(10),
    CASE WHEN doc_id % 7 = 0 THEN concat('Discharge Diagnosis:', chr(10), '___', chr(10), 'CHIEF COMPLAINT:', chr(10)) ELSE '' END,
    'Brief Hospital Course:', chr(10), substring(text, 101), chr(10),
    CASE WHEN doc_id % 3 = 0 THEN concat('Social  History:', chr(10), substring(text, 301, 50), chr(10)) ELSE '' END,
    'Discharge Diagnosis:', chr(10), substring(text, 21, 80)) AS text
FROM documents""",
    # what a reference extract says is the body of one section
    "extract": """
SELECT CAST(doc_id + 1 AS STRING) AS note_id,
  CASE doc_id % 6 WHEN 0 THEN substring(text, 101) WHEN 1 THEN concat(substring(text, 101), ' Discharge Diagnosis: ', substring(text, 21, 80))
    WHEN 2 THEN concat(substring(text, 101), ' and more') WHEN 3 THEN substring(text, 101, greatest(length(text) - 200, 0)) WHEN 4 THEN substring(text, 151, greatest(length(text) - 250, 0))
    ELSE concat('x', substring(text, 90)) END AS target
FROM documents WHERE doc_id % 11 <> 0""",
    # one prediction for each labelled document, in five folds; scores tie
    "predictions": """
SELECT 'r1' AS row_id, CAST(l.doc_id % 5 AS BIGINT) AS fold, l.doc_id AS note_id, CAST(l.doc_id % 400 + 1 AS BIGINT) AS subject_id,
       CASE l.doc_id % 2 WHEN 0 THEN 'diabetes' ELSE 'copd' END AS diagnosis, l.quality = 1 AS label,
       CAST(d.n_chars % 97 AS DOUBLE) / 97 AS score, d.n_chars % 97 >= 20 AS predicted
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
UNION ALL
SELECT 'r2', CAST(l.doc_id % 5 AS BIGINT), l.doc_id, CAST(l.doc_id % 400 + 1 AS BIGINT),
       CASE l.doc_id % 2 WHEN 0 THEN 'diabetes' ELSE 'copd' END, l.quality = 1, CAST(d.n_chars % 13 AS DOUBLE) / 13, d.n_chars % 13 >= 6
FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.doc_id % 29 <> 0""",
}


#: The same rows in one scan, for Spark.
SPARK_LENS = {
    "diagnoses_icd": """
SELECT CAST(doc_id + 1 AS STRING) AS hadm_id, c.icd_code, c.icd_version FROM labels LATERAL VIEW explode(filter(array(
  named_struct('icd_code', 'Z00', 'icd_version', '10'), IF(quality = 1 AND doc_id % 2 = 0, named_struct('icd_code', 'E119', 'icd_version', '10'), NULL),
  IF(toxic = 1 OR doc_id % 9 = 1, named_struct('icd_code', '25000', 'icd_version', '9'), NULL), IF(doc_id % 3 = 0, named_struct('icd_code', 'I48', 'icd_version', '10'), NULL),
  IF(doc_id % 4 = 0, named_struct('icd_code', '4273', 'icd_version', '9'), NULL), IF(doc_id % 5 = 0, named_struct('icd_code', 'J189', 'icd_version', '10'), NULL),
  IF(doc_id % 7 = 0, named_struct('icd_code', ' n189 ', 'icd_version', '10'), NULL), IF(doc_id % 6 = 1, named_struct('icd_code', 'J449', 'icd_version', '10'), NULL),
  IF(doc_id % 11 = 0, named_struct('icd_code', CAST(NULL AS STRING), 'icd_version', '10'), NULL), IF(doc_id % 13 = 0, named_struct('icd_code', 'E11.9', 'icd_version', '10'), NULL),
  IF(doc_id % 6 = 2, named_struct('icd_code', 'E8859', 'icd_version', '9'), NULL)), x -> x IS NOT NULL)) t AS c""",
}


_registered: dict[str, tuple[str, str]] = {}


def tables(spark: SparkSession, sf_dir: str, sql: str | None = None) -> None:
    """Views of the given tables, of those that sql names if it is given; a view that is there for the same folder stays."""
    for t in TABLES:
        here = (spark.sparkContext.applicationId, sf_dir)
        if (sql is None or re.search(rf"\b{t}\b", sql)) and (_registered.get(t) != here or not spark.catalog.tableExists(t)):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
            _registered[t] = here


def lens(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SPARK_LENS.get(name, LENS[name])
    tables(spark, sf_dir, sql)
    return spark.sql(sql)


def with_lens(names: str, sql: str) -> str:
    """sql with the named relations before it."""
    sql = sql.strip()
    heads = ", ".join(f"{n} AS ({LENS[n]})" for n in names.split())
    return f"WITH {heads}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {heads} {sql}"
