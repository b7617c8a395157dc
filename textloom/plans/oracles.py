"""DuckDB SQL for the queries of the catalog, written from the definitions and apart from the operators."""

from __future__ import annotations

import re

from textloom.functions.icd import POOL
from textloom.functions.sections import LEXICON, PREAMBLE
from textloom.operators.preprocessing import STOP
from textloom.plans.lens import with_lens

KEYS = [c.key for c in POOL]


def _list(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def _w(names: str, *ctes: str, select: str) -> str:
    return with_lens(names, ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + select)


# --- the input corpus ---------------------------------------------------------------------------------------------
_SEL = """sel AS (SELECT note_id, subject_id, hadm_id, has_icd,
  CASE WHEN cand THEN row_number() OVER (PARTITION BY cand, text ORDER BY note_id) END AS copy FROM (
    SELECT *, has_icd AND coalesce(length(text), 0) >= 100 AS cand FROM (
      SELECT *, hadm_id IS NOT NULL AND hadm_id IN (SELECT hadm_id FROM diagnoses_icd WHERE hadm_id IS NOT NULL) AS has_icd FROM discharge)))"""
_CORPUS = "corpus AS (SELECT note_id, subject_id, hadm_id FROM sel WHERE copy = 1)"


def _normal(table: str) -> str:
    return f"""(SELECT DISTINCT hadm_id, CASE WHEN regexp_full_match(upper(trim(icd_code)), '[0-9A-Z]+') THEN upper(trim(icd_code)) END AS code, TRY_CAST(trim(icd_version) AS BIGINT) AS version FROM {table})"""


_CODES = (f"codes AS (SELECT DISTINCT note_id, corpus.hadm_id, code, version FROM corpus JOIN {_normal('diagnoses_icd')} n ON corpus.hadm_id = n.hadm_id "
    f"WHERE code IS NOT NULL AND version IN (9, 10))")
_OCODES = (f"codes AS (SELECT DISTINCT note_id, order_notes.hadm_id, code, version FROM order_notes JOIN {_normal('order_codes')} n ON order_notes.hadm_id = n.hadm_id "
    f"WHERE code IS NOT NULL AND version IN (9, 10))")
_D = "discharge diagnoses_icd"

SELECTION = _w(_D, _SEL, select="SELECT * FROM sel")
FUNNEL = _w(_D, _SEL, """steps AS (SELECT 0 AS position, 'all' AS step, subject_id FROM sel UNION ALL SELECT 1, 'coded', subject_id FROM sel WHERE has_icd
  UNION ALL SELECT 2, 'long enough', subject_id FROM sel WHERE copy IS NOT NULL UNION ALL SELECT 3, 'unique', subject_id FROM sel WHERE copy = 1)""",
    "per AS (SELECT position, step, subject_id, count(*) AS n FROM steps GROUP BY ALL)",
    select=("SELECT CAST(position AS BIGINT) AS position, step, CAST(sum(n) AS BIGINT) AS notes, count(subject_id) AS patients, "
        "count(*) FILTER (WHERE n > 1) AS several FROM per GROUP BY position, step"))
COMPARISON = _w("discharge radiology", "x AS (SELECT 'discharge' AS corpus, * FROM discharge UNION ALL SELECT 'radiology', * FROM radiology)",
    ("a AS (SELECT corpus, count(*) AS notes, count(DISTINCT subject_id) AS patients, count(DISTINCT hadm_id) AS admissions, "
        "count(*) FILTER (WHERE hadm_id IS NULL) AS w, CAST(sum(length(text)) AS BIGINT) AS c FROM x GROUP BY corpus)"),
    select="""SELECT corpus, 'notes' AS indicator, notes AS value FROM a UNION ALL SELECT corpus, 'patients', patients FROM a UNION ALL SELECT corpus, 'admissions', admissions FROM a
  UNION ALL SELECT corpus, 'without admission', w FROM a UNION ALL SELECT corpus, 'characters', c FROM a""")
PATIENT_SUMMARY = _w("order_notes", select=("SELECT count(DISTINCT subject_id) AS patients, count(DISTINCT hadm_id) AS admissions, count(*) AS notes, (SELECT "
    "count(*) FROM (SELECT subject_id FROM order_notes GROUP BY 1 HAVING count(*) > 1)) AS several FROM order_notes"))


def per(key: str, cap: int) -> str:
    return _w("order_notes", f"p AS (SELECT least(count(*), {cap}) AS bucket FROM order_notes WHERE {key} IS NOT NULL GROUP BY {key})",
        select=f"SELECT bucket, CASE WHEN bucket = {cap} THEN '{cap}+' ELSE CAST(bucket AS VARCHAR) END AS label, count(*) AS keys FROM p GROUP BY bucket")


COVERAGE = _w("discharge radiology diagnoses_icd", "x AS (SELECT 'discharge' AS corpus, hadm_id FROM discharge UNION ALL SELECT 'radiology', hadm_id FROM radiology)",
    "f AS (SELECT corpus, hadm_id IS NULL AS no, coalesce(hadm_id IN (SELECT hadm_id FROM diagnoses_icd WHERE hadm_id IS NOT NULL), FALSE) AS code FROM x)",
    select=("SELECT corpus, count(*) AS notes, count(*) FILTER (WHERE no) AS no_admission, count(*) FILTER (WHERE NOT no AND NOT code) AS no_code, "
        "count(*) FILTER (WHERE code) AS with_code FROM f GROUP BY corpus"))
_ERA = """era AS (SELECT hadm_id, subject_id, CASE WHEN nine AND ten THEN 'both' WHEN nine THEN 'only 9' WHEN ten THEN 'only 10' ELSE 'none' END AS era FROM (
  SELECT n.hadm_id, min(subject_id) AS subject_id, coalesce(bool_or(TRY_CAST(icd_version AS INT) = 9), FALSE) AS nine, coalesce(bool_or(TRY_CAST(icd_version AS INT) = 10), FALSE) AS ten
  FROM order_notes n LEFT JOIN order_codes c ON n.hadm_id = c.hadm_id WHERE n.hadm_id IS NOT NULL GROUP BY n.hadm_id))"""
_EBG = "ebg AS (SELECT coalesce(anchor_year_group, 'unknown') AS period, era, count(*) AS admissions FROM era LEFT JOIN patients USING (subject_id) GROUP BY ALL)"
ERA = _w("order_notes order_codes", _ERA, select="SELECT * FROM era")
ERA_BY_GROUP = _w("order_notes order_codes patients", _ERA, _EBG, select="SELECT * FROM ebg")
ERA_TRANSITION = _w("order_notes order_codes patients", _ERA, _EBG, "a AS (SELECT DISTINCT period FROM ebg WHERE era IN ('only 9', 'both'))",
    "b AS (SELECT DISTINCT period FROM ebg WHERE era IN ('only 10', 'both'))",
    select=("SELECT CASE WHEN (SELECT count(*) FROM a) = 0 OR (SELECT count(*) FROM b) = 0 THEN 'none' WHEN EXISTS (SELECT 1 "
        "FROM a JOIN b USING (period)) THEN 'overlap' ELSE 'separated' END AS transition"))
_DEMO = """demo AS (SELECT note_id, n.subject_id, CASE gender WHEN 'F' THEN 'female' WHEN 'M' THEN 'male' ELSE 'unknown' END AS gender,
  CASE WHEN insurance IN ('Medicare', 'Medicaid', 'Private') THEN lower(insurance) WHEN insurance IS NULL THEN 'unknown' ELSE 'other' END AS insurance,
  CASE WHEN language = 'ENGLISH' THEN 'english' WHEN language IS NULL OR language IN ('?', '') THEN 'unknown' ELSE 'other' END AS language,
  CASE WHEN marital_status IN ('MARRIED', 'SINGLE', 'WIDOWED', 'DIVORCED') THEN lower(marital_status) ELSE 'unknown' END AS marital,
  CASE WHEN race LIKE 'WHITE%' THEN 'white' WHEN race LIKE 'BLACK%' THEN 'black' WHEN race LIKE 'ASIAN%' THEN 'asian' WHEN race LIKE 'HISPANIC%' OR race = 'SOUTH AMERICAN' THEN 'hispanic' WHEN race IS NULL OR race IN ('UNKNOWN', 'UNABLE TO OBTAIN', 'PATIENT DECLINED TO ANSWER') THEN 'unknown' ELSE 'other' END AS race,
  CAST(CASE WHEN anchor = 91 THEN 90 WHEN anchor IS NOT NULL AND TRY_CAST(admit_year AS INT) IS NOT NULL AND TRY_CAST(anchor_year AS INT) IS NOT NULL THEN least(anchor + TRY_CAST(admit_year AS INT) - TRY_CAST(anchor_year AS INT), 90) END AS BIGINT) AS age,
  anchor = 91 AS masked, p.subject_id IS NULL AS no_patient, a.hadm_id IS NULL AS no_admission
  FROM order_notes n LEFT JOIN (SELECT *, TRY_CAST(anchor_age AS INT) AS anchor FROM patients) p ON n.subject_id = p.subject_id LEFT JOIN admissions a ON n.hadm_id = a.hadm_id)"""
_DEMO2 = ("dem AS (SELECT * REPLACE (age AS age), CASE WHEN age IS NULL THEN 'unknown' WHEN age < 30 THEN '<30' "
    "WHEN age >= 90 THEN '90+' ELSE CAST(age // 10 * 10 AS VARCHAR) || 's' END AS age_band FROM demo)")
_DL = "order_notes patients admissions"
DEMOGRAPHIC_NOTES = _w(_DL, _DEMO, _DEMO2, select="SELECT * FROM dem")
DEMOGRAPHIC_SUMMARY = _w(_DL, _DEMO,
    select="""SELECT count(DISTINCT subject_id) AS patients, count(*) AS notes, CAST(quantile_cont(age, 0.25) AS DOUBLE) AS age_q25, CAST(quantile_cont(age, 0.5) AS DOUBLE) AS age_q50, CAST(quantile_cont(age, 0.75) AS DOUBLE) AS age_q75,
  count(*) FILTER (WHERE no_patient) AS no_patient, count(*) FILTER (WHERE no_admission) AS no_admission, count(*) FILTER (WHERE masked) AS masked FROM demo""")
_ATTR = ("attr AS (SELECT 'gender' AS attribute, gender AS category, count(DISTINCT subject_id) AS n FROM dem "
    "GROUP BY ALL ") + " ".join(f"UNION ALL SELECT '{a}', {a}, count(*) FROM dem GROUP BY ALL" for a in ("insurance", "language", "marital", "race", "age_band")) + ")"
ATTRIBUTE_COUNTS = _w(_DL, _DEMO, _DEMO2, _ATTR, select="SELECT * FROM attr")
ATTRIBUTE_TABLE = _w(_DL, _DEMO, _DEMO2, _ATTR, ("r AS (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY CASE WHEN category = 'unknown' THEN 1 "
    "ELSE 0 END, n DESC, category) AS position, sum(n) OVER (PARTITION BY attribute) AS t FROM attr)"),
    select="SELECT attribute, category, n, round(n::DOUBLE / t::DOUBLE, 6) AS share, position, CASE WHEN position = 1 THEN attribute ELSE '' END AS label FROM r")
AGE_GENDER = _w(_DL, _DEMO, _DEMO2, select="SELECT gender, age_band, count(*) AS n FROM dem GROUP BY ALL")


def majority(attribute: str) -> str:
    return _w(_DL, _DEMO, _DEMO2, _ATTR, select=(f"SELECT attribute, category, n FROM attr WHERE attribute = '{attribute}' AND category <> 'unknown' "
        f"ORDER BY n DESC, category LIMIT 1"))


# --- text metrics -------------------------------------------------------------------------------------------------
MARKED_NOTES = """SELECT CAST(doc_id + 1 AS STRING) AS note_id, CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN '' ELSE concat('Seen ___ today',
  CASE doc_id % 4 WHEN 0 THEN ', is a ___ year old man.' WHEN 1 THEN ', ___-year-old, then ___ yo,___ y/oF.' WHEN 2 THEN ' aged 45 years old [**Name**] <b>x</b>' ELSE ' _____ and XXXX' END, ' ', text) END AS text FROM documents"""
_M = f"m AS ({MARKED_NOTES})"
_MET = r"""met AS (SELECT note_id, CAST(length(t) AS BIGINT) AS chars, CAST(len(regexp_extract_all(t, '\S+')) AS BIGINT) AS words,
  CAST(len(list_filter(runs, lambda x: length(x) = 3)) AS BIGINT) AS markers, CAST(len(list_filter(runs, lambda x: length(x) > 3)) AS BIGINT) AS longer_runs,
  CAST(len(regexp_extract_all(t, '\[\*\*[^\]]*\*\*\]')) AS BIGINT) AS bracketed, CAST(len(regexp_extract_all(t, '</?[A-Za-z][^<>]*>')) AS BIGINT) AS tag, CAST(len(regexp_extract_all(t, 'X{3,}')) AS BIGINT) AS crossed,
  CAST(len(list_filter(regexp_extract_all(t, '(?i)_+[ -]?(?:years?[ -]?old|yo|y/o|y\.o\.)[a-z]*'), lambda x: regexp_full_match(x, '(?i)___[ -]?(?:years?[ -]?old|yo|y/o|y\.o\.)[mf]?'))) AS BIGINT) AS age_masks,
  regexp_matches(t, '(?i)is an? ___[ -]?(?:years?[ -]?old|yo|y/o|y\.o\.)[mf]?($|[^a-z])') AS age_anchor,
  CAST(len(list_filter(regexp_extract_all(t, '(?i)\b[0-9]{1,3}[ -]?(?:years?[ -]?old|yo|y/o|y\.o\.)[a-z]*'), lambda x: regexp_full_match(x, '(?i)[0-9]+[ -]?(?:years?[ -]?old|yo|y/o|y\.o\.)[mf]?'))) AS BIGINT) AS numeric_ages,
  CASE WHEN length(t) > 0 THEN sha256(t) END AS fingerprint FROM (SELECT note_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '_{3,}') AS runs FROM m))"""


def _met(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([_M, _MET, *ctes]) + "\n" + select


_PC = ", ".join(f"CAST(quantile_disc(x, {p}) AS BIGINT) AS p{round(p * 100):02d}" for p in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99))
_HIST = "h AS (SELECT floor(log10(chars::DOUBLE) * 10) / 10.0::DOUBLE AS bin, count(*) AS n FROM met WHERE chars > 0 GROUP BY 1)"
NOTE_METRICS = _met("SELECT * FROM met")
LENGTH_PERCENTILES = _met((f"SELECT metric, count(*) AS n, round(avg(x), 6) AS mean, min(x) AS min, max(x) AS max, {_PC} FROM u "
    f"GROUP BY metric"), ("u AS (SELECT 'chars' AS metric, chars AS x FROM met UNION ALL SELECT 'words', words FROM met UNION ALL SELECT 'markers', markers "
    "FROM met)"))
LENGTH_HISTOGRAM = _met("SELECT * FROM h", _HIST)
HISTOGRAM_SHARES = _met("SELECT bin, n, round(n::DOUBLE / (sum(n) OVER ())::DOUBLE, 9) AS share FROM h", _HIST)
MARKER_SUMMARY = _met(("SELECT count(*) AS notes, CAST(sum(markers) AS BIGINT) AS markers, count(*) FILTER (WHERE markers > 0) AS with_marker, CAST(sum(longer_runs) AS BIGINT) AS longer_runs "
    "FROM met"))
RESIDUAL_MASKS = _met(" UNION ALL ".join((f"SELECT '{k}' AS pattern, count(*) FILTER (WHERE {k} > 0) AS notes, CAST(sum({k}) AS BIGINT) AS occurrences "
    f"FROM met") for k in ("bracketed", "tag", "crossed")))
NOTE_QUALITY = _met(("SELECT count(*) FILTER (WHERE chars = 0) AS empty, count(*) FILTER (WHERE chars > 0 AND chars < 100) AS short, "
    "count(*) FILTER (WHERE chars >= 100 AND chars < 500) AS medium, count(*) FILTER (WHERE chars > 50000) AS long, "
    "count(fingerprint) - count(DISTINCT fingerprint) AS duplicates FROM met"))
MARKER_MEANS = _met("SELECT round(avg(markers), 9) AS exact, round(avg(longer_runs), 9) AS longer, round(avg(bracketed + tag + crossed), 9) AS residual FROM met")
SHARE_TABLE = _met("""SELECT bin, replace(format('{:,}', n), ',', chr(160)) AS n, CASE WHEN round_even(100.0::DOUBLE * n / t, 1) = 0 THEN '<' || chr(160) || '0,1' ELSE replace(format('{:.1f}', round_even(100.0::DOUBLE * n / t, 1)), '.', ',') END AS share
FROM (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS t FROM h)""", _HIST)
AGE_MASKS = _met(("SELECT count(*) AS notes, count(*) FILTER (WHERE age_masks = 0) AS none, count(*) FILTER (WHERE age_masks = 1) AS one, "
    "count(*) FILTER (WHERE age_masks > 1) AS many, count(*) FILTER (WHERE age_anchor) AS anchored, count(*) FILTER (WHERE numeric_ages > 0) AS numeric "
    "FROM met"))
EXACT_DUPLICATES = _w("discharge", select="SELECT min(note_id) AS note_id, count(*) AS copies FROM discharge WHERE length(text) > 0 GROUP BY text HAVING count(*) > 1")

# --- tokens -------------------------------------------------------------------------------------------------------
_TOK = r"""tok AS (SELECT note_id, CAST(len(regexp_extract_all(t, '\S+')) + 2 AS BIGINT) AS words, CAST(len(regexp_extract_all(t, '[A-Za-z]{1,4}|[0-9]|[^A-Za-z0-9\s]')) + 2 AS BIGINT) AS pieces,
  CAST(len(regexp_extract_all(t, '\S')) + 1 AS BIGINT) AS letters FROM (SELECT note_id, coalesce(text, '') AS t FROM discharge))"""
_TU = "u AS (SELECT 'words' AS tokenizer, words AS x FROM tok UNION ALL SELECT 'pieces', pieces FROM tok UNION ALL SELECT 'letters', letters FROM tok)"
NOTE_TOKENS = _w("discharge", _TOK, select="SELECT * FROM tok")
TOKEN_PERCENTILES = _w("discharge", _TOK, _TU, select=f"SELECT tokenizer, count(*) AS n, min(x) AS min, max(x) AS max, {_PC} FROM u GROUP BY tokenizer")
TOKEN_HISTOGRAM = _w("discharge", _TOK, _TU, select="SELECT tokenizer, floor(log10(x::DOUBLE) * 10) / 10.0::DOUBLE AS bin, count(*) AS n FROM u WHERE x > 0 GROUP BY ALL")
WINDOW_SUMMARY = _w("discharge", _TOK, _TU, ("c AS (SELECT tokenizer, (x - CASE tokenizer WHEN 'letters' THEN 1 ELSE 2 END)::DOUBLE AS content, "
    "CASE tokenizer WHEN 'letters' THEN 2047 ELSE 510 END::DOUBLE AS cap FROM u)"),
    select=("SELECT tokenizer, count(*) AS notes, count(*) FILTER (WHERE content <= cap) AS fit, CAST(sum(CASE "
        "WHEN content > 0 THEN ceil(content / cap) ELSE 0 END) AS BIGINT) AS parts FROM c GROUP BY tokenizer"))
HASH_SAMPLE = _w("discharge", select="SELECT note_id, CAST(length(text) AS BIGINT) AS chars FROM discharge ORDER BY sha256(note_id), note_id LIMIT 100")
PARALLEL_RATIO = _w("discharge", _TOK, "r AS (SELECT (pieces - 2)::DOUBLE / (words - 2) AS r FROM tok WHERE words > 2)",
    select=("SELECT count(*) AS pairs, round(quantile_disc(r, 0.5), 9) AS median, round(quantile_disc(r, 0.95), 9) AS p95 "
    "FROM r"))
TOKEN_WINDOWS = _w("discharge", _TOK, select="SELECT note_id, CAST(greatest(ceil((words - 2)::DOUBLE / 126), 1) AS BIGINT) AS windows, words - 2 AS tokens FROM tok")


# --- codes --------------------------------------------------------------------------------------------------------
def _match(nine, ten, code="code", version="version") -> str:
    return "(" + " OR ".join([f"({version} = 9 AND starts_with({code}, '{p}'))" for p in nine] + [f"({version} = 10 AND starts_with({code}, '{p}'))"
        for p in ten] + ["FALSE"]) + ")"


_DIAG = "CASE " + " ".join(f"WHEN {_match(c.nine, c.ten)} THEN '{c.key}'" for c in POOL) + " END"
_CAND = f"cand AS (SELECT DISTINCT note_id, candidate, version FROM (SELECT note_id, {_DIAG} AS candidate, version FROM codes) WHERE candidate IS NOT NULL)"
_POOL = "pool AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{c.key}', '{c.chapter}')" for k, c in enumerate(POOL)) + ") t(position, candidate, chapter))"
_BASE = (_SEL, _CORPUS, _CODES)
DIAGNOSIS_CODES = _w(_D, *_BASE, select="SELECT * FROM codes")
ERA_SUMMARY = _w(_D, *_BASE, ("p AS (SELECT note_id, bool_or(version = 9) AS nine, bool_or(version = 10) AS ten, bool_or((version = 9 AND code[1:2] IN ('78', '79')) OR (version = 10 AND starts_with(code, 'R'))) AS symptom "
    "FROM codes GROUP BY note_id)"),
    select=("SELECT (SELECT count(*) FROM corpus) AS notes, count(*) FILTER (WHERE nine AND NOT ten) AS only9, "
        "count(*) FILTER (WHERE ten AND NOT nine) AS only10, count(*) FILTER (WHERE nine AND ten) AS both, (SELECT "
        "count(*) FROM corpus) - count(*) AS neither, count(*) FILTER (WHERE symptom) AS symptom FROM p"))


def comorbidities(categories) -> str:
    return _w(_D, *_BASE, select=" UNION ALL ".join(f"SELECT '{k}' AS category, count(DISTINCT note_id) AS notes FROM codes WHERE {_match(*p)}" for k,
        p in categories.items()))


CODE_RANKING = _w("order_notes order_codes code_titles", _OCODES,
    "g AS (SELECT *, code[1:CASE WHEN version = 9 AND starts_with(code, 'E') THEN 4 ELSE 3 END] AS grp FROM codes)",
    "f AS (SELECT version, grp, code, count(DISTINCT note_id) AS n_code FROM g GROUP BY ALL HAVING count(DISTINCT note_id) >= 10)",
    "b AS (SELECT version, grp, code FROM f QUALIFY row_number() OVER (PARTITION BY version, grp ORDER BY n_code DESC, code) = 1)",
    "n AS (SELECT version, grp, count(DISTINCT note_id) AS n FROM g GROUP BY ALL HAVING count(DISTINCT note_id) >= 10)",
        "t AS (SELECT version, count(DISTINCT note_id) AS all_n FROM g GROUP BY version)",
    select="""SELECT n.version, n.grp, coalesce(long_title, 'unknown') AS title, n, round(n::DOUBLE / all_n, 6) AS share, row_number() OVER (PARTITION BY n.version ORDER BY n DESC, n.grp) AS position
  FROM n JOIN t ON n.version = t.version LEFT JOIN b ON n.version = b.version AND n.grp = b.grp LEFT JOIN code_titles c ON c.icd_code = b.code AND TRY_CAST(c.icd_version AS BIGINT) = b.version
  QUALIFY row_number() OVER (PARTITION BY n.version ORDER BY n DESC, n.grp) <= 20""")
CANDIDATE_NOTES = _w(_D, *_BASE, _CAND, select="SELECT * FROM cand")
_PREV = """prev AS (SELECT CAST(position AS BIGINT) AS position, candidate, count(DISTINCT note_id) AS n, count(DISTINCT note_id) FILTER (WHERE version = 9) AS n9, count(DISTINCT note_id) FILTER (WHERE version = 10) AS n10,
  (SELECT count(DISTINCT note_id) FROM codes WHERE version = 9) AS total9, (SELECT count(DISTINCT note_id) FROM codes WHERE version = 10) AS total10, (SELECT count(*) FROM corpus) AS total FROM pool LEFT JOIN cand USING (candidate) GROUP BY position, candidate)"""
_CELLS = """cells AS (SELECT a.candidate AS a, b.candidate AS b, (SELECT count(*) FROM (SELECT DISTINCT note_id FROM cand x WHERE x.candidate = a.candidate) x JOIN (SELECT DISTINCT note_id FROM cand y WHERE y.candidate = b.candidate) y USING (note_id)) AS n_both,
  (SELECT count(DISTINCT note_id) FROM cand x WHERE x.candidate = a.candidate) AS n_a, (SELECT count(DISTINCT note_id) FROM cand x WHERE x.candidate = b.candidate) AS n_b FROM pool a, pool b WHERE a.candidate <> b.candidate)"""
PREVALENCE = _w(_D, *_BASE, _CAND, _POOL, _PREV, select="SELECT * FROM prev")
COOCCURRENCE = _w(_D, *_BASE, _CAND, _POOL, _CELLS, select="SELECT a, b, n_both, n_a, n_b, round(n_both::DOUBLE / nullif(n_a, 0), 6) AS share FROM cells")
PRESELECTION = _w(_D, *_BASE, _CAND, _POOL, _PREV,
    ("r AS (SELECT *, n::DOUBLE / nullif(total, 0) AS s, n9::DOUBLE / nullif(total9, 0) AS r9, n10::DOUBLE / nullif(total10, 0) AS r10 "
    "FROM prev)"),
    select=("SELECT candidate, round(s, 6) AS share, CASE WHEN s IS NULL THEN 'undecidable' WHEN s BETWEEN 0.05 AND 0.60 THEN 'yes' "
        "ELSE 'no' END AS in_band, greatest(r9, r10) / nullif(least(r9, r10), 0) >= 1.5 AS era_gap FROM r"))


def uncovered_groups(categories) -> str:
    known = [g for c in POOL for g in c.groups]
    parts = " UNION ALL ".join(f"SELECT '{k}' AS category, count(DISTINCT note_id) AS notes FROM codes WHERE {_match(*p)}" for k, p in categories.items())
    return _w(_D, *_BASE, f"g AS ({parts})", select=(f"SELECT category, notes, round(notes::DOUBLE / (SELECT count(*) FROM corpus), 6) AS share FROM g "
        f"WHERE notes::DOUBLE / (SELECT count(*) FROM corpus) BETWEEN 0.05 AND 0.60 AND category NOT IN ({_list(known)})"))


ERA_GAPS = _w(_D, *_BASE, _CAND, _POOL, _PREV, "r AS (SELECT candidate, n9::DOUBLE / nullif(total9, 0) AS r9, n10::DOUBLE / nullif(total10, 0) AS r10 FROM prev)",
    select="SELECT candidate, round(r9, 6) AS share9, round(r10, 6) AS share10 FROM r WHERE greatest(r9, r10) > 1.5 * least(r9, r10) AND r9 IS NOT NULL AND r10 IS NOT NULL")
REDUNDANT_PAIRS = _w(_D, *_BASE, _CAND, _POOL, _CELLS, select="SELECT a, b, n_both FROM cells WHERE a < b AND n_both >= 0.5 * least(n_a, n_b) AND least(n_a, n_b) > 0")
LABEL_CODES = _w("diagnoses_icd", "r AS (SELECT DISTINCT icd_code, icd_version FROM diagnoses_icd)",
    ("n AS (SELECT *, CASE WHEN regexp_full_match(upper(trim(icd_code)), '[0-9A-Z]+') THEN upper(trim(icd_code)) END AS code, "
    "CASE trim(icd_version) WHEN '9' THEN 9 WHEN '10' THEN 10 END AS version FROM r)"),
    select=f"SELECT icd_code, icd_version, {_DIAG} AS diagnosis, code IS NULL OR version IS NULL AS invalid FROM n")


# --- mentions -----------------------------------------------------------------------------------------------------
def _re2(keywords, acronyms=()) -> str:
    parts = []
    if keywords:
        parts.append("(?i:" + "|".join(r"\s+".join(re.escape(w) for w in k.split()) for k in sorted(keywords, key=len, reverse=True)) + ")")
    parts += [re.escape(a) for a in sorted(acronyms, key=len, reverse=True)]
    return r"\b(?:" + "|".join(parts) + r")\b"


def _negated(p: str) -> str:
    from textloom.operators.mentions import CUES, WINDOW

    return r"\b(?:(?i:" + "|".join(CUES) + r"))\b[^.;\n]{0," + str(WINDOW) + "}?" + p


_NOTES = "notes AS (SELECT d.note_id, d.text FROM discharge d JOIN corpus USING (note_id))"


def _flags() -> str:
    cols = []
    for c in POOL:
        p = _re2(c.keywords, c.acronyms)
        cols.append(f"coalesce(regexp_matches(text, '{p}'), FALSE) AS m_{c.key}")
        cols.append(f"coalesce(regexp_matches(text, '{p}') AND regexp_matches(regexp_replace(text, '{_negated(p)}', ' ', 'g'), '{p}'), FALSE) AS a_{c.key}")
    return "flags AS (SELECT note_id, " + ", ".join(cols) + " FROM notes)"


def _agree() -> str:
    parts = []
    for k, c in enumerate(POOL):
        i, m, a = f"note_id IN (SELECT note_id FROM cand WHERE candidate = '{c.key}')", f"m_{c.key}", f"a_{c.key}"
        f = ", ".join(f"count(*) FILTER (WHERE {x}) AS {n}" for n, x in (("icd", i), ("mention", m), ("assertion", a), ("icd_mention", f"{i} AND {m}"),
            ("icd_assertion", f"{i} AND {a}")))
        parts.append(f"SELECT CAST({k} AS BIGINT) AS position, '{c.key}' AS candidate, '{c.chapter}' AS chapter, {f}, count(*) AS total FROM flags")
    return "agree AS (" + " UNION ALL ".join(parts) + ")"


def mention_flags() -> str:
    return _w(_D, _SEL, _CORPUS, _NOTES, _flags(), select="SELECT * FROM flags")


def _agreement(*more, select):
    return _w(_D, *_BASE, _CAND, _NOTES, _flags(), _agree(), *more, select=select)


def mention_agreement() -> str:
    return _agreement(select="SELECT * FROM agree")


_RUBRIC = """rub AS (SELECT position, candidate, chapter, round(s, 6) AS share, round(g, 6) AS agreement, CASE WHEN s IS NULL OR g IS NULL THEN 'undecidable' WHEN s BETWEEN 0.05 AND 0.60 AND g >= 0.5 THEN 'pass' ELSE 'fail' END AS result
  FROM (SELECT *, icd::DOUBLE / nullif(total, 0) AS s, icd_assertion::DOUBLE / nullif(icd, 0) AS g FROM agree))"""


def symptom_mentions() -> str:
    from textloom.operators.mentions import SYMPTOMS

    return _w(_D, _SEL, _CORPUS, _NOTES,
        select=" UNION ALL ".join(f"SELECT '{k}' AS symptom, count(*) FILTER (WHERE regexp_matches(text, '{_re2(w)}')) AS notes FROM notes" for k, w in SYMPTOMS.items()))


def rubric() -> str:
    return _agreement(_RUBRIC, select="SELECT * FROM rub")


def select_five() -> str:
    return _agreement(_RUBRIC, "g AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY agreement DESC, position) = 1 AS winner FROM rub WHERE result = 'pass')",
        select="SELECT position, candidate, chapter, winner FROM g QUALIFY row_number() OVER (ORDER BY winner DESC, agreement DESC, position) <= 5")


def synthetic_parameters() -> str:
    return _agreement(_POOL, _CELLS,
        select="""SELECT candidate, 'prevalence' AS kind, round(icd::DOUBLE / nullif(total, 0), 4) AS value FROM agree UNION ALL SELECT candidate, 'mention', round(icd_mention::DOUBLE / nullif(icd, 0), 4) FROM agree
  UNION ALL SELECT candidate, 'assertion', round(icd_assertion::DOUBLE / nullif(icd, 0), 4) FROM agree UNION ALL SELECT candidate, 'given itself', 1.0::DOUBLE FROM agree UNION ALL SELECT a, 'given ' || b, round(n_both::DOUBLE / nullif(n_b, 0), 4) FROM cells""")


# --- sections -----------------------------------------------------------------------------------------------------
_HEAD = r"(?m)^[ \t]*([A-Z][A-Za-z][A-Za-z \-/&()''.]{0,47}):"
_NORM = r"rtrim(regexp_replace(lower({}), '\s+', ' ', 'g'), ' .')"
_HDR = (f"hdr AS (SELECT * FROM (SELECT note_id, header, {_NORM.format('header')} AS norm FROM (SELECT note_id, unnest(regexp_extract_all(text, '{_HEAD}', 1)) AS header "
    f"FROM sectioned)) WHERE length(norm) >= 3)")
_LEX = "lex AS (SELECT * FROM (VALUES " + ", ".join(f"('{x.key}', '{s}')" for x in LEXICON for s in x.synonyms) + ") t(section, synonym))"
_NAMES = "names AS (SELECT * FROM (VALUES " + ", ".join([f"('{s}', '{x.key}', '{x.key}')" for x in LEXICON for s in x.synonyms] + [f"('{p}', 'field {p}', 'OTHER')"
    for p in PREAMBLE]) + ") t(norm, k, section))"
_NORM_LINE = _NORM.format("regexp_extract(line, '" + _HEAD.removeprefix("(?m)") + "', 1)")
# lines with their offsets, headers at line starts, the first of each key, parts, and neighbouring OTHER parts merged
_SPANS = rf"""ln AS (SELECT note_id, text, line, no, coalesce(sum(length(line) + 1) OVER (PARTITION BY note_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM (SELECT note_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM sectioned)),
cut AS (SELECT note_id, text, off AS a, CASE WHEN section = 'OTHER' THEN off ELSE off + length(regexp_extract(line, '^[ \t]*[A-Z][A-Za-z][A-Za-z \-/&()''.]{{0,47}}:')) END AS b, section
  FROM (SELECT ln.*, {_NORM_LINE} AS norm FROM ln) JOIN names USING (norm)
  QUALIFY row_number() OVER (PARTITION BY note_id, k ORDER BY no) = 1),
cuts AS (SELECT * FROM cut UNION ALL SELECT note_id, text, 0, 0, 'OTHER' FROM sectioned WHERE note_id NOT IN (SELECT note_id FROM cut WHERE a = 0)),
part AS (SELECT *, lead(a, 1, length(text)) OVER (PARTITION BY note_id ORDER BY a) AS z, lag(section) OVER (PARTITION BY note_id ORDER BY a) AS before FROM cuts),
grp AS (SELECT *, sum(CASE WHEN section = 'OTHER' AND before = 'OTHER' THEN 0 ELSE 1 END) OVER (PARTITION BY note_id ORDER BY a) AS g FROM part),
merged AS (SELECT note_id, any_value(text) AS text, any_value(section) AS section, min(a) AS a, min(b) AS b, max(z) AS z FROM grp GROUP BY note_id, g),
body AS (SELECT *, text[b + 1 : z] AS t FROM merged WHERE z > a),
spans AS (SELECT note_id, row_number() OVER (PARTITION BY note_id ORDER BY a) - 1 AS position, section, CAST(z - a AS BIGINT) AS span_chars, CAST(length(regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '')) AS BIGINT) AS body_chars,
  regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '') = '___' AS body_masked, CAST(b + length(t) - length(regexp_replace(t, '^\s+', '')) AS BIGINT) AS body_start,
  CAST(b + length(t) - length(regexp_replace(t, '^\s+', '')) + length(regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '')) AS BIGINT) AS body_end, a, z, text FROM body)"""
_S = (_NAMES, _SPANS)
_FLOOR = "(SELECT greatest(10, ceil(0.01::DOUBLE * count(*))) FROM sectioned)"
_RANK = f"""rank AS (SELECT norm, spelling, CASE WHEN norm IN ({_list(s for x in LEXICON for s in x.synonyms)}) THEN 'section' WHEN norm IN ({_list(PREAMBLE)}) THEN 'preamble' ELSE 'other' END AS kind, notes, used, round(notes::DOUBLE / (SELECT count(*) FROM sectioned), 6) AS share
  FROM (SELECT norm, count(DISTINCT note_id) AS notes, count(*) AS used FROM hdr GROUP BY norm) JOIN (SELECT norm, header AS spelling FROM (SELECT norm, header, count(*) AS times FROM hdr GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY norm ORDER BY times DESC, header) = 1) USING (norm)
  WHERE notes >= {_FLOOR} ORDER BY notes DESC, norm LIMIT 40)"""
NOTE_HEADERS = _w("sectioned", _HDR, select="SELECT * FROM hdr")
HEADER_RANKING = _w("sectioned", _HDR, _RANK, select="SELECT * FROM rank")
HEADER_CANDIDATES = _w("sectioned", _HDR, _RANK, select="SELECT norm, notes FROM rank WHERE kind = 'other' AND share >= 0.5")
HEADER_TOTALS = _w("sectioned", _HDR, _LEX,
    select=("SELECT count(DISTINCT norm) AS headers, count(DISTINCT note_id) AS with_any, count(DISTINCT note_id) FILTER (WHERE norm IN (SELECT synonym "
    "FROM lex)) AS with_section, (SELECT count(*) FROM sectioned) - count(DISTINCT note_id) AS without "
    "FROM hdr"))


def coverage_by(by: str) -> str:
    return _w("sectioned", _HDR, _LEX, f"p AS (SELECT {by}, note_id, count(*) AS n FROM hdr JOIN lex ON norm = synonym GROUP BY ALL)",
        select=(f"SELECT l.{by}, count(note_id) AS notes, count(*) FILTER (WHERE n >= 2) AS repeated FROM (SELECT DISTINCT {by} "
            f"FROM lex) l LEFT JOIN p ON l.{by} = p.{by} GROUP BY l.{by}"))


SPANS = _w("sectioned", *_S, select="SELECT * EXCLUDE (a, z, text) FROM spans")
_SKEL = """skel AS (SELECT l.section, count(DISTINCT note_id) AS notes, round(count(DISTINCT note_id)::DOUBLE / (SELECT count(*) FROM sectioned), 6) AS coverage, CAST(quantile_cont(place, 0.5) AS DOUBLE) AS median, CAST(quantile_cont(place, 0.25) AS DOUBLE) AS q25,
  CAST(quantile_cont(place, 0.75) AS DOUBLE) AS q75, count(DISTINCT note_id)::DOUBLE / (SELECT count(*) FROM sectioned) >= 0.5 AS in_skeleton FROM (SELECT DISTINCT section FROM lex) l
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY position) - 1 AS place FROM spans WHERE section <> 'OTHER') s ON l.section = s.section GROUP BY l.section)"""
_MEM = "mem AS (SELECT section, row_number() OVER (ORDER BY median, notes DESC, section) AS r FROM skel WHERE in_skeleton)"
SKELETON = _w("sectioned", *_S, _LEX, _SKEL, select="SELECT * FROM skel")
ORDER_CONSISTENCY = _w("sectioned", *_S, _LEX, _SKEL, _MEM, ("o AS (SELECT note_id, r < lag(r) OVER (PARTITION BY note_id ORDER BY position) AS wrong FROM spans "
    "JOIN mem USING (section))"),
    "p AS (SELECT note_id, coalesce(bool_or(wrong), FALSE) AS wrong FROM o GROUP BY note_id HAVING count(*) >= 2)",
        select="SELECT count(*) AS judged, count(*) FILTER (WHERE NOT wrong) AS in_order FROM p")
PRECEDENCE = _w("sectioned", *_S, _LEX, _SKEL, _MEM, "ms AS (SELECT note_id, section, position FROM spans JOIN mem USING (section))",
    select=("SELECT a.section AS a, b.section AS b, count(y.note_id) AS both, count(*) FILTER (WHERE x.position < y.position) AS first "
        "FROM mem a JOIN mem b ON a.section <> b.section LEFT JOIN ms x ON x.section = a.section LEFT JOIN ms y ON y.section = b.section AND y.note_id = x.note_id "
        "GROUP BY ALL"))
_PN = ("pn AS (SELECT s.note_id, count(x.section) AS sections FROM sectioned s LEFT JOIN (SELECT * FROM spans "
    "WHERE section <> 'OTHER') x ON s.note_id = x.note_id GROUP BY s.note_id)")
SECTIONS_PER_NOTE = _w("sectioned", *_S, _PN, select="SELECT g AS sections, count(note_id) AS notes FROM range(0, 18) t(g) LEFT JOIN pn ON sections = g GROUP BY g")
SECTION_COUNTS = _w("sectioned", *_S, _PN,
    select=("SELECT CAST(quantile_disc(sections, 0.1) AS BIGINT) AS p10, CAST(quantile_disc(sections, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(sections, 0.75) AS BIGINT) AS p75, CAST(quantile_disc(sections, 0.95) AS BIGINT) AS p95, max(sections) AS most "
    "FROM pn"))
BODY_LENGTHS = _w("sectioned", *_S, "p AS (SELECT section, note_id, sum(body_chars) AS c, bool_and(body_masked) AS m FROM spans WHERE section <> 'OTHER' GROUP BY ALL)",
    select=("SELECT section, count(*) AS notes, count(*) FILTER (WHERE m) AS masked, CAST(quantile_disc(c, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(c, 0.75) AS BIGINT) AS p75, CAST(quantile_disc(c, 0.95) AS BIGINT) AS p95 "
        "FROM p GROUP BY section"))
STRIP_SHARE = _w("sectioned", *_S, ("p AS (SELECT note_id, sum(span_chars) AS c, coalesce(sum(span_chars) FILTER (WHERE section = 'discharge_diagnosis'), 0) AS g "
    "FROM spans GROUP BY note_id)"),
    select=("SELECT count(*) FILTER (WHERE g > 0) AS notes, round(sum(g)::DOUBLE / sum(c)::DOUBLE, 9) AS share, "
        "round(quantile_cont(g::DOUBLE / c::DOUBLE, 0.5), 9) AS median_share FROM p"))
STRIP_RESIDUE = _w("sectioned", *_S,
    (f"r AS (SELECT note_id, list_filter(regexp_extract_all(text[a + 1 : z], '{_HEAD}', 1), lambda h: {_NORM.format('h')} IN ('discharge diagnosis', 'final diagnosis')) AS hs "
    f"FROM spans WHERE section <> 'discharge_diagnosis')"),
    select="SELECT count(*) AS parts, count(DISTINCT note_id) AS notes FROM r WHERE len(hs) > 0")
_HL = "p AS (SELECT note_id, bool_or(section <> 'OTHER') AS sectioned, CAST(sum(span_chars) AS BIGINT) AS chars FROM spans GROUP BY note_id)"
HEADERLESS = _w("sectioned", *_S, _HL,
    select=("SELECT sectioned, count(*) AS notes, CAST(quantile_disc(chars, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(chars, 0.95) AS BIGINT) AS p95 "
    "FROM p GROUP BY sectioned"))
HEADERLESS_HISTOGRAM = _w("sectioned", *_S, _HL, select=("SELECT sectioned, floor(log10(chars::DOUBLE) * 10) / 10.0::DOUBLE AS bin, count(*) AS n FROM p WHERE chars > 0 "
    "GROUP BY ALL"))
LITERAL_HEADERS = {"Allergies": "allergies", "Chief Complaint": "chief_complaint", "CHIEF COMPLAINT": "chief_complaint", "Discharge Diagnosis": "discharge_diagnosis"}
_LITERAL = "(?m)^(" + "|".join(sorted(LITERAL_HEADERS, key=lambda h: (-len(h), h))) + "):"
LITERAL = _w("sectioned", f"""c AS (SELECT note_id, regexp_split_to_array(text, '{_LITERAL}') AS b, regexp_extract_all(text, '{_LITERAL}', 1) AS h FROM sectioned), p AS (SELECT note_id, b, h, unnest(range(0, len(b))) AS position FROM c)""",
    select="SELECT note_id, position::BIGINT AS position, CASE h[position] " + " ".join(f"WHEN '{h}' THEN '{k}'" for h,
        k in LITERAL_HEADERS.items()) + " END AS section, sha256(b[position + 1]) AS body FROM p")
STRIPPED = _w("sectioned", *_S,
    select=("SELECT note_id, coalesce(string_agg(text[a + 1 : z], '' ORDER BY a) FILTER (WHERE section <> 'discharge_diagnosis'), '') AS text "
    "FROM spans GROUP BY note_id"))

# --- agreement ----------------------------------------------------------------------------------------------------
_CLEAN = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({}, ' +', ' ', 'g'), 'Brief Hospital Course:', ''), 'BRIEF HOSPITAL COURSE:', ''), 'Hospital Course:', ''), 'HOSPITAL COURSE:', ''), chr(10), ' '), '\\s+', ' ', 'g'))"
_PAIRS = f"""ours AS (SELECT s.note_id, {_CLEAN.format('text[body_start + 1 : body_end]')} AS o, CASE WHEN ns <> 'OTHER' THEN {_CLEAN.format('text[nb + 1 : ne]')} END AS f, ns FROM
  (SELECT *, lead(section) OVER w AS ns, lead(body_start) OVER w AS nb, lead(body_end) OVER w AS ne FROM spans WINDOW w AS (PARTITION BY note_id ORDER BY position)) s WHERE section = 'hospital_course'),
raw AS (SELECT s.note_id, o, f, ns, trim(target) AS r FROM sectioned s LEFT JOIN ours USING (note_id) JOIN extract e ON s.note_id = e.note_id),
rest AS (SELECT *, ltrim(r[length(o) + 1 :]) AS q FROM raw),
pairs AS (SELECT note_id, CASE WHEN o IS NULL OR o = '' THEN 'not found' WHEN o = r THEN 'equal'
  WHEN starts_with(r, o) AND f IS NOT NULL AND f <> '' AND starts_with(CASE WHEN contains(q, ':') THEN ltrim(regexp_replace(q, '^[A-Za-z ]{{0,48}}:', '')) ELSE q END, f) THEN 'swallows next'
  WHEN starts_with(r, o) THEN 'reference longer' WHEN starts_with(o, r) THEN 'ours longer' WHEN contains(o, r) THEN 'reference inside' WHEN contains(r, o) THEN 'ours inside' ELSE 'other' END AS category,
  CAST(abs(length(o) - length(r)) AS BIGINT) AS diff, ns AS next_section FROM rest)"""
_P = ("sectioned extract", *_S, _PAIRS)
CHECK_EXTRACT = _w("extract", select=("SELECT count(*) AS rows, count(*) FILTER (WHERE note_id IS NULL) AS null_notes, count(*) FILTER (WHERE target IS NULL) AS null_targets, "
    "count(*) - count(DISTINCT note_id) AS repeated FROM extract"))
PAIRS = _w(*_P, select="SELECT * FROM pairs")
AGREEMENT = _w(*_P, select="SELECT category, count(*) AS notes, CAST(quantile_disc(diff, 0.5) AS BIGINT) AS median_diff FROM pairs GROUP BY category")
UNPAIRED = _w("sectioned extract", select=("SELECT (SELECT count(*) FROM sectioned WHERE note_id NOT IN (SELECT note_id FROM extract)) AS only_notes, (SELECT "
    "count(*) FROM extract WHERE note_id NOT IN (SELECT note_id FROM sectioned)) AS only_reference"))
_CUT = ("cutp AS (SELECT *, coalesce(next_section, 'end') AS nx, CASE WHEN diff < 50 THEN '<50' WHEN diff < 500 THEN '50-499' "
    "ELSE '500+' END AS sz FROM pairs WHERE category IN ('swallows next', 'reference longer'))")
CUT_SECTIONS = _w(*_P, _CUT, select="SELECT nx AS next_section, count(*) AS notes FROM cutp GROUP BY nx")
CUT_CAUSES = _w(*_P, _CUT, select=("SELECT 'category' AS property, category AS value, count(*) AS notes FROM cutp GROUP BY ALL UNION ALL SELECT 'next', nx, "
    "count(*) FROM cutp GROUP BY ALL UNION ALL SELECT 'missing', sz, count(*) FROM cutp GROUP BY ALL"))

# --- vocabularies -------------------------------------------------------------------------------------------------
ACRONYM_NOTES = """SELECT concat(CAST(doc_id % 400 + 1 AS STRING), '-DS-', CAST(doc_id + 1 AS STRING)) AS note_id, concat('Seen ___ today. ',
  CASE doc_id % 5 WHEN 0 THEN 'Known COPD, DM. ' WHEN 1 THEN 'AF and CKD, AF again. ' WHEN 2 THEN 'Type 2 diabetes; PNA. ' WHEN 3 THEN 'type 2  Diabetes and pneumonitis ' ELSE 'gave 12 pills on the 3rd day, 4,5 mg, 500mg at K3.5 ___ yo ' END, text) AS text FROM documents"""
_AN = f"an AS ({ACRONYM_NOTES})"
_AC = {a: c.key for c in POOL for a in c.acronyms}
_VA = {v: c.key for c in POOL for v in c.variants}


def _terms(table: dict) -> str:
    return "terms AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{d}')" for t, d in table.items()) + ") t(term, diagnosis))"


_AOCC = "occ AS (SELECT note_id, term, diagnosis, CAST(len(regexp_extract_all(text, '\\b' || term || '\\b')) AS BIGINT) AS occurrences FROM an, terms)"
_VOCC = ("occ AS (SELECT note_id, term, diagnosis, CAST(len(regexp_extract_all(text, '(?i)\\b' || replace(term, ' ', '\\s+') || '\\b')) AS BIGINT) AS occurrences "
    "FROM an, terms)")
_TC = """tc AS (SELECT term, diagnosis, CAST(sum(occurrences) AS BIGINT) AS occurrences, count(*) FILTER (WHERE occurrences > 0 AND c) AS both, count(*) FILTER (WHERE occurrences > 0 AND NOT c) AS term_only, count(*) FILTER (WHERE occurrences = 0 AND c) AS code_only, count(*) FILTER (WHERE occurrences = 0 AND NOT c) AS none
  FROM (SELECT o.*, EXISTS (SELECT 1 FROM cand k WHERE k.note_id = o.note_id AND k.candidate = o.diagnosis) AS c FROM occ o) GROUP BY term, diagnosis)"""


def acronym_occurrences() -> str:
    return _w("discharge", _AN, _terms(_AC), _AOCC, select="SELECT * FROM occ")


def variant_occurrences() -> str:
    return _w("discharge", _AN, _terms(_VA), _VOCC, select="SELECT * FROM occ")


def term_cells() -> str:
    return _w(_D, *_BASE, _CAND, _AN, _terms(_AC), _AOCC, _TC, select="SELECT * FROM tc")


def term_summary() -> str:
    return _w(_D, *_BASE, _CAND, _AN, _terms(_AC), _AOCC, _TC,
        select=("SELECT term, occurrences, \"both\" + term_only AS notes, round(term_only::DOUBLE / nullif(\"both\" + term_only, 0), 6) AS without_code "
        "FROM tc"))


#: RE2 cannot look around: matches take a character before and one behind, and a second pass finds those that touch.
_TWICE = {
    "__age__": r"(?i)(^|[^_])___[ -]?(?:years?[ -]?old|yo|y/o|y\.o\.)[mf]?([^a-z]|$)",
    "__deid__": r"(^|[^_])___([^_]|$)",
    "__num__": r"(^|[^A-Za-z0-9_.,]|(?:^|[^0-9])[.,])[0-9]+(?:[.,][0-9]+)*(?:(?i:st|nd|rd|th)([^A-Za-z0-9_]|$))?",
}


def _normal_text(text: str) -> str:
    for word, p in _TWICE.items():
        for _ in range(2):
            text = f"regexp_replace({text}, '{p}', '\\1 {word} \\2', 'g')"
    return text


def _classifier_text(text: str) -> str:
    """Terms one after another, longest first; the given vocabulary has no term that another one's result holds."""
    text = _normal_text(text)
    for a in sorted(_AC, key=lambda x: (-len(x), x)):
        text = f"regexp_replace({text}, '\\b{a}\\b', '{_AC[a].replace('_', ' ')}', 'g')"
    for v in sorted(_VA, key=lambda x: (-len(x), x)):
        text = rf"regexp_replace({text}, '(?i)\b" + r"\s+".join(v.split()) + rf"\b', '{_VA[v].replace('_', ' ')}', 'g')"
    return f"lower({text})"


NORMALIZED = f"WITH {_AN} SELECT note_id, {_normal_text('text')} AS text FROM an"
CLASSIFIER_TEXT = f"WITH {_AN} SELECT note_id, {_classifier_text('text')} AS text FROM an"
def variant_cells() -> str:
    return _w(_D, *_BASE, _CAND, _AN, _terms(_VA), _VOCC, _TC, select="SELECT * FROM tc")


def variant_summary() -> str:
    return _w(_D, *_BASE, _CAND, _AN, _terms(_VA), _VOCC, _TC,
        select=("SELECT term, occurrences, \"both\" + term_only AS notes, round(term_only::DOUBLE / nullif(\"both\" + term_only, 0), 6) AS without_code "
        "FROM tc"))


_VOC = r"voc AS (SELECT note_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]+'), lambda w: length(w) >= 2) AS t FROM an)"
NOTE_PREPROCESSING = (f"WITH {_AN}, {_VOC} SELECT note_id, CAST(len(t) AS BIGINT) AS tokens_raw, CAST(len(list_distinct(t)) AS BIGINT) AS vocabulary, sha256(array_to_string(list_sort(list_distinct(t)), ' ')) AS digest "
    f"FROM voc")
_PRE = r"pre AS (SELECT note_id, list_filter(regexp_extract_all(" + _classifier_text("text") + r", '[\p{L}\p{M}\p{Nd}\p{Pc}]+'), lambda w: length(w) >= 2) AS t FROM an)"
PREPROCESSING_SUMMARY = f"WITH {_AN}, {_VOC}, {_PRE}, u AS (SELECT 'raw' AS kind, t FROM voc UNION ALL SELECT 'preprocessed', t FROM pre)" + """
SELECT kind, CAST(quantile_disc(len(t), 0.5) AS BIGINT) AS p50, CAST(quantile_disc(len(t), 0.95) AS BIGINT) AS p95, CAST(max(len(t)) AS BIGINT) AS most,
  (SELECT count(DISTINCT w) FROM (SELECT unnest(t) AS w FROM u x WHERE x.kind = u.kind)) AS vocabulary FROM u GROUP BY kind"""
TOKEN_FREQUENCY = f"WITH {_AN}, {_VOC} SELECT token, count(*) AS df FROM (SELECT note_id, unnest(list_distinct(t)) AS token FROM voc) GROUP BY token"
_NG = f"""pt AS (SELECT note_id, section, list_filter(regexp_extract_all(lower(text[body_start + 1 : body_end]), '[a-z]{{2,}}'), lambda w: NOT list_contains([{_list(STOP)}], w)) AS w FROM spans WHERE section <> 'OTHER'),
ix AS (SELECT note_id, section, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM pt, (VALUES (1), (2), (3)) v(n) WHERE len(w) >= n),
gr AS (SELECT note_id, section, CAST(n AS BIGINT) AS n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM ix),
gate AS (SELECT n, gram, count(DISTINCT note_id) AS notes, count(*) AS occurrences FROM gr GROUP BY ALL HAVING count(DISTINCT note_id) >= (SELECT greatest(10, ceil(0.01::DOUBLE * count(DISTINCT note_id))) FROM pt))"""


def ngrams(by_section: bool) -> str:
    if not by_section:
        return _w("sectioned", *_S, _NG, select=("SELECT n, gram, notes, occurrences, round(notes::DOUBLE / (SELECT count(DISTINCT note_id) FROM pt), 6) AS share "
            "FROM gate"))
    return _w("sectioned", *_S, _NG, "h AS (SELECT section, count(DISTINCT note_id) AS having_n FROM pt GROUP BY section)",
        select=("SELECT g.section, g.n, g.gram, count(DISTINCT note_id) AS notes, count(*) AS occurrences, round(count(DISTINCT note_id)::DOUBLE / any_value(having_n), 6) AS share "
            "FROM gr g JOIN h ON g.section = h.section WHERE (g.n, g.gram) IN (SELECT n, gram FROM gate) GROUP BY g.section, g.n, g.gram"))


def ngram_ranking() -> str:
    return _w("sectioned", *_S, _NG, select=("SELECT n, gram, notes, row_number() OVER (PARTITION BY n ORDER BY notes DESC, gram) AS position "
        "FROM gate QUALIFY row_number() OVER (PARTITION BY n ORDER BY notes DESC, gram) <= 15"))


def spelling_targets(keywords: dict) -> str:
    rows = ", ".join(f"('{d}', '{w.lower()}')" for d, ps in keywords.items() for p in ps for w in p.split())
    return (f"SELECT target, min(diagnosis) AS diagnosis FROM (SELECT DISTINCT * FROM (VALUES {rows}) t(diagnosis, target)) "
        f"WHERE length(target) >= 6 GROUP BY target HAVING count(*) = 1")


_FREQ = "fr AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT note_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS token FROM discharge) GROUP BY token)"
NEAR_MISS = _w("discharge", _FREQ, "tg AS (SELECT token AS target, df AS target_df FROM fr WHERE length(token) >= 6 ORDER BY df DESC, token LIMIT 20)",
    select=("SELECT token, df, target, 'x' AS diagnosis, target_df FROM fr JOIN tg ON abs(length(token) - length(target)) <= 1 AND damerau_levenshtein(token, target) = 1 AND target_df >= 10 * df "
        "WHERE df >= 2 AND token NOT IN (SELECT target FROM tg)"))
TYPO = _w("discharge", _FREQ, "wd AS (SELECT * FROM fr WHERE length(token) >= 5)",
    ("ky AS (SELECT token, df, token AS k FROM wd UNION SELECT token, df, token[1 : i - 1] || token[i + 1 :] "
    "FROM wd, LATERAL (SELECT unnest(range(1, length(token) + 1)) AS i))"),
    "cn AS (SELECT DISTINCT a.token, a.df FROM ky a JOIN ky b ON a.k = b.k AND b.df >= 100 * a.df WHERE damerau_levenshtein(a.token, b.token) = 1)",
    select=("SELECT (SELECT count(*) FROM wd) AS words, CAST((SELECT sum(df) FROM wd) AS BIGINT) AS df, count(*) AS candidates, CAST(coalesce(sum(df), 0) AS BIGINT) AS candidate_df "
        "FROM cn"))

# --- cohort and split ---------------------------------------------------------------------------------------------
_COH = "coh AS (SELECT note_id, CAST(subject_id AS BIGINT) AS subject_id, 'en' AS language, text, " + ", ".join(f"note_id IN (SELECT note_id FROM cand WHERE candidate = '{k}') AS {k}" for k in KEYS) + " FROM corpus JOIN discharge USING (note_id, subject_id))"
_CO = (_D, *_BASE, _CAND, _COH)
_MASK = " | ".join(f"(CASE WHEN {k} THEN {1 << i} ELSE 0 END)" for i, k in enumerate(KEYS))
_STRATA = f"""pm AS (SELECT subject_id, bit_or(CAST({_MASK} AS BIGINT)) AS mask FROM coh GROUP BY subject_id), mc AS (SELECT mask, count(*) AS n FROM pm GROUP BY mask),
sm AS (SELECT coalesce(sum(n) FILTER (WHERE n < 6), 0) AS pooled, (SELECT mask FROM mc WHERE n >= 6 ORDER BY n DESC, mask LIMIT 1) AS common FROM mc),
st AS (SELECT subject_id, CASE WHEN n >= 6 THEN mask WHEN common IS NULL OR pooled >= 6 THEN -1 ELSE common END AS stratum FROM pm JOIN mc USING (mask), sm),
sp AS (SELECT subject_id, CASE WHEN p < 5 THEN p END AS fold FROM (SELECT subject_id, (row_number() OVER (PARTITION BY stratum ORDER BY sha256('0|' || subject_id), subject_id) + ('0x' || sha256('0|s|' || stratum)[1:8])::BIGINT) % 6 AS p FROM st))"""


def cohort() -> str:
    return _w(*_CO, select="SELECT * REPLACE (sha256(text) AS text) FROM coh")


def positives() -> str:
    return _w(*_CO, select=" UNION ALL ".join((f"SELECT CAST({i} AS BIGINT) AS position, '{k}' AS diagnosis, count(*) FILTER (WHERE {k}) AS positives, "
        f"count(*) FILTER (WHERE NOT {k}) AS negatives FROM coh") for i, k in enumerate(KEYS)))


NOTE_IDENTITY = _w("discharge",
    select=("SELECT note_id, regexp_full_match(note_id, '[1-9][0-9]*-DS-[1-9][0-9]*') AS valid, regexp_full_match(note_id, '[1-9][0-9]*-DS-[1-9][0-9]*') AND split_part(note_id, '-', 1) = subject_id AS own_patient "
    "FROM discharge"))


def strata() -> str:
    return _w(*_CO, _STRATA, select="SELECT * FROM st")


def partition() -> str:
    return _w(*_CO, _STRATA, select="SELECT * FROM sp")


def holdouts() -> str:
    return _w(*_CO, _STRATA, select=("SELECT CAST(h AS BIGINT) AS holdout, subject_id, CASE WHEN fold = h THEN 'test' ELSE 'train' END AS role "
        "FROM sp, range(0, 5) t(h) WHERE fold IS NOT NULL"))


def split_fingerprint() -> str:
    return _w(*_CO, _STRATA, select=("SELECT coalesce(CAST(fold AS VARCHAR), 'development') AS fold, count(*) AS patients, CAST(sum(('0x' || sha256(CAST(subject_id AS VARCHAR))[1:12])::BIGINT) AS BIGINT) AS mark "
        "FROM sp GROUP BY fold"))


def fold_coverage() -> str:
    return _w(*_CO, _STRATA, select="SELECT fold, count(*) AS notes, count(DISTINCT subject_id) AS patients, " + ", ".join(f"count(*) FILTER (WHERE {k}) AS {k}"
        for k in KEYS) + " FROM coh JOIN sp USING (subject_id) GROUP BY fold")


# --- evaluation ---------------------------------------------------------------------------------------------------
_MX = """mx AS (SELECT row_id, diagnosis, n, positives, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE, 9) AS f1, round((n - fp - fn)::DOUBLE / n, 9) AS accuracy
  FROM (SELECT row_id, diagnosis, count(*) AS n, count(*) FILTER (WHERE label) AS positives, count(*) FILTER (WHERE label AND predicted) AS tp, count(*) FILTER (WHERE NOT label AND predicted) AS fp, count(*) FILTER (WHERE label AND NOT predicted) AS fn FROM predictions GROUP BY ALL))"""
_AUC = """auc AS (SELECT p.row_id, p.diagnosis, round(avg(CASE WHEN p.score > q.score THEN 1.0::DOUBLE WHEN p.score = q.score THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 9) AS roc_auc FROM predictions p JOIN predictions q ON p.row_id = q.row_id AND p.diagnosis = q.diagnosis AND p.label AND NOT q.label GROUP BY ALL)"""


def _groups(keys: str) -> str:
    return (f"sg AS (SELECT {keys}, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {keys}) AS P "
        f"FROM (SELECT {keys}, score, count(*) FILTER (WHERE label) AS pos, count(*) FILTER (WHERE NOT label) AS neg "
        f"FROM predictions GROUP BY ALL) WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC))")


_APC = "ap AS (SELECT row_id, diagnosis, round(sum(pos::DOUBLE / P::DOUBLE * tp::DOUBLE / (tp + fp)::DOUBLE), 9) AS pr_auc FROM sg WHERE P > 0 GROUP BY ALL)"
METRICS = _w("predictions", _MX, select="SELECT * FROM mx")
AUC = _w("predictions", _AUC, select="SELECT * FROM auc")
AP = _w("predictions", _groups("row_id, diagnosis"), _APC, select="SELECT * FROM ap")
MAX_F1 = _w("predictions", _groups("row_id, diagnosis"), ("f AS (SELECT row_id, diagnosis, score, round((2 * tp)::DOUBLE / (tp + fp + P)::DOUBLE, 12) AS f1 "
    "FROM sg WHERE P > 0)"), select=("SELECT row_id, diagnosis, round(f1, 9) AS max_f1, round(score, 9) AS threshold FROM f QUALIFY row_number() OVER (PARTITION BY row_id, diagnosis "
    "ORDER BY f1 DESC, score DESC) = 1"))
MACRO_MAX_F1 = _w("predictions", _groups("row_id, fold, diagnosis"),
    ("f AS (SELECT row_id, fold, diagnosis, max(round(round((2 * tp)::DOUBLE / (tp + fp + P)::DOUBLE, 12), 9)) AS f1 "
    "FROM sg WHERE P > 0 GROUP BY ALL)"), "g AS (SELECT row_id, fold, avg(f1) AS m FROM f GROUP BY ALL)",
        select="SELECT row_id, round(avg(m), 9) AS macro_max_f1 FROM g GROUP BY row_id")
MODEL_EVALUATION = _w("predictions", _MX, _AUC, _groups("row_id, diagnosis"), _APC,
    select="SELECT mx.*, roc_auc, pr_auc FROM mx JOIN auc USING (row_id, diagnosis) LEFT JOIN ap USING (row_id, diagnosis)")
FAULTS = _w("predictions discharge", ("c AS (SELECT count(*) FILTER (WHERE label) AS p, count(*) FILTER (WHERE NOT label) AS n FROM predictions "
    "GROUP BY row_id, diagnosis)"),
    select=("SELECT (SELECT count(*) FROM (SELECT 1 FROM predictions GROUP BY row_id, note_id, diagnosis HAVING "
        "count(*) > 1)) AS repeated, (SELECT count(*) FROM predictions WHERE note_id NOT IN (SELECT CAST(hadm_id AS BIGINT) - 1 "
        "FROM discharge WHERE hadm_id IS NOT NULL)) AS unknown, count(*) FILTER (WHERE p = 0 OR n = 0) AS one_class, "
        "count(*) FILTER (WHERE p < 10 OR n < 10) AS small FROM c"))
FOLD_GAPS = _w("predictions", "k AS (SELECT DISTINCT diagnosis, fold, note_id FROM predictions)", "r AS (SELECT DISTINCT row_id, diagnosis FROM predictions)",
    select=("SELECT row_id, diagnosis, count(*) AS missing FROM k JOIN r USING (diagnosis) WHERE (row_id, diagnosis, fold, note_id) NOT IN (SELECT row_id, diagnosis, fold, note_id "
    "FROM predictions) GROUP BY ALL"))
PUBLISHABLE = _w("predictions", _MX,
    select="SELECT row_id, diagnosis, n, positives, " + ", ".join(f"CASE WHEN positives >= 90 AND n - positives >= 90 THEN {c} END AS {c}"
    for c in ("precision", "recall", "f1", "accuracy")) + " FROM mx")
LATENCY = "SELECT count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events"
SAME = _w("predictions", ("z AS (SELECT a.predicted AS pa, b.predicted AS pb, a.score AS sa, b.score AS sb FROM (SELECT * FROM predictions "
    "WHERE row_id = 'r1') a FULL JOIN (SELECT * FROM predictions WHERE row_id = 'r2') b ON a.note_id = b.note_id AND a.diagnosis = b.diagnosis)"),
    select=("SELECT count(*) AS pairs, count(*) FILTER (WHERE pa <> pb) AS labels_differ, count(*) FILTER (WHERE abs(sa - sb) > 1e-9 * greatest(abs(sa), abs(sb))) AS scores_differ, "
        "count(*) FILTER (WHERE sa IS NULL OR sb IS NULL) AS alone FROM z"))
_PHI = """phi AS (SELECT fold, diagnosis, round(CASE WHEN (n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00) > 0 THEN (n11 * n00 - n10 * n01) / sqrt((n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00)) END, 9) AS phi, alone FROM (
  SELECT coalesce(a.fold, b.fold) AS fold, coalesce(a.diagnosis, b.diagnosis) AS diagnosis, (count(*) FILTER (WHERE a.e AND b.e))::DOUBLE AS n11, (count(*) FILTER (WHERE a.e AND NOT b.e))::DOUBLE AS n10, (count(*) FILTER (WHERE b.e AND NOT a.e))::DOUBLE AS n01,
  (count(*) FILTER (WHERE NOT a.e AND NOT b.e))::DOUBLE AS n00, count(*) FILTER (WHERE a.e IS NULL OR b.e IS NULL) AS alone FROM (SELECT *, label <> predicted AS e FROM predictions WHERE row_id = 'r1') a FULL JOIN (SELECT *, label <> predicted AS e FROM predictions WHERE row_id = 'r2') b
  ON a.fold = b.fold AND a.diagnosis = b.diagnosis AND a.note_id = b.note_id GROUP BY 1, 2))"""
PHI = _w("predictions", _PHI, select="SELECT * FROM phi")
ERROR_CORRELATION = _w("predictions", _PHI,
    select=("SELECT round(avg(phi), 9) AS mean_phi, count(phi) AS defined, count(*) AS cells, CASE WHEN avg(phi) IS NULL THEN 'undecidable' "
    "WHEN avg(phi) < 0.5 THEN 'yes' ELSE 'no' END AS ensemble FROM phi"))
SCREENING = """SELECT o_orderstatus AS family, substring(o_orderpriority, 1, 1) AS vectorizer, CAST(o_orderkey % 5 AS INT) AS fold, CASE o_custkey % 2 WHEN 0 THEN 'a' ELSE 'b' END AS diagnosis, CAST(max(o_orderkey % 1000) AS DOUBLE) / 1000 AS f1
FROM orders GROUP BY o_orderstatus, substring(o_orderpriority, 1, 1), o_orderkey % 5, o_custkey % 2"""
_SC = f"sc AS ({SCREENING})"
SCREENING_SUMMARY = f"""WITH {_SC}, f AS (SELECT family, vectorizer, fold, avg(f1) AS f FROM sc GROUP BY ALL), c AS (SELECT family, vectorizer, round(avg(f), 9) AS mean, round(stddev_samp(f) / sqrt(count(*)::DOUBLE), 9) AS se FROM f GROUP BY ALL),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY family ORDER BY mean DESC, vectorizer) = 1), w AS (SELECT mean AS wm, se AS ws FROM b ORDER BY mean DESC LIMIT 1)
SELECT family, vectorizer, mean, se, row_number() OVER (ORDER BY mean DESC, family) AS rank, mean >= wm - coalesce(ws, 0) AS in_band FROM b, w"""
GRID_FAULTS = f"""WITH {_SC}, g AS (SELECT fold, family, vectorizer FROM range(0, 6) a(fold), (VALUES ('F'), ('O'), ('P'), ('X')) b(family), (VALUES ('1'), ('2'), ('3'), ('4'), ('5')) c(vectorizer)), own AS (SELECT DISTINCT fold, family, vectorizer FROM sc)
SELECT (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM own)) AS missing, (SELECT count(*) FROM (SELECT * FROM own EXCEPT SELECT * FROM g)) AS outside, (SELECT count(*) FROM (SELECT 1 FROM sc GROUP BY fold, family, vectorizer HAVING count(*) > 1)) AS repeated"""
BEST_TRIAL = (f"WITH {_SC}, t AS (SELECT family AS diagnosis, fold AS trial, max(round(f1, 2)) AS value FROM sc "
    f"GROUP BY ALL) SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY diagnosis ORDER BY value DESC, trial) = 1")

# --- features -----------------------------------------------------------------------------------------------------
LABELLED = ("SELECT d.doc_id AS id, CAST(d.doc_id % 2 AS INT) AS fold, l.quality = 1 AS label, d.text AS text "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL")
LABELLED_BOTH = ("SELECT d.doc_id AS id, array(l.quality = 1, l.toxic = 1) AS labels, d.text AS text FROM documents d "
    "JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL")
_LT = (rf"lt AS (SELECT id, label, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+'), lambda w: length(w) >= 2 AND regexp_full_match(w, '[a-z]+')) AS t "
    rf"FROM ({LABELLED}))")
_TF = "tf AS (SELECT id, gram, count(*)::DOUBLE AS tf FROM (SELECT id, unnest(t) AS gram FROM lt) GROUP BY ALL)"
TFIDF = f"""WITH {_LT}, {_TF}, df AS (SELECT gram, count(*)::DOUBLE AS df FROM tf GROUP BY gram HAVING count(*) >= 2), raw AS (SELECT id, gram, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM lt)::DOUBLE) / (1 + df)) + 1) AS w FROM tf JOIN df USING (gram)),
wt AS (SELECT id, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw) SELECT id, count(*) AS grams, round(sum(weight), 6) AS total, round(max(weight), 6) AS most FROM wt GROUP BY id"""
_PQ = ("pq AS (SELECT gram, (count(*) FILTER (WHERE label))::DOUBLE AS p, (count(*) FILTER (WHERE NOT label))::DOUBLE AS q "
    "FROM (SELECT label, unnest({}) AS gram FROM lt) GROUP BY gram)")
NB_RATIO = f"WITH {_LT}, {_PQ.format('list_distinct(t)')} SELECT gram, round(ln(((p + 1) / (sum(p + 1) OVER ())) / ((q + 1) / (sum(q + 1) OVER ()))), 6) AS r FROM pq"
COMPLEMENT_NB = (f"WITH {_LT}, {_PQ.format('t')}, lo AS (SELECT gram, ln((p + 1) / (sum(p + 1) OVER ())) - ln((q + 1) / (sum(q + 1) OVER ())) AS o "
    f"FROM pq), s AS (SELECT id, sum(o) AS s FROM (SELECT id, unnest(t) AS gram FROM lt) JOIN lo USING (gram) "
    f"GROUP BY id) SELECT lt.id, round(coalesce(s, 0), 4) AS score FROM lt LEFT JOIN s USING (id)")
CHAR_WB = rf"""WITH w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS x FROM ({LABELLED})), g AS (SELECT id, unnest(CASE WHEN length(x) + 2 >= 3 THEN list_transform(range(1, length(x) + 1), lambda i: (' ' || x || ' ')[i : i + 2]) ELSE [] END || CASE WHEN length(x) + 2 >= 4 THEN list_transform(range(1, length(x)), lambda i: (' ' || x || ' ')[i : i + 3]) ELSE [] END) AS g FROM w)
SELECT d.id, count(g) AS grams, count(DISTINCT g) AS distinct_grams FROM ({LABELLED}) d LEFT JOIN g ON d.id = g.id GROUP BY d.id"""
SCALER = """WITH l AS (SELECT vec_id AS id, unnest(range(0, len(embedding))) AS position, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT position, avg(x) AS m, stddev_pop(x) AS sd FROM l GROUP BY position) SELECT id, position, round(coalesce((x - m) / nullif(sd, 0), 0), 5) AS value FROM l JOIN s USING (position)"""
MEAN_POOL = ("SELECT label, position, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(0, len(embedding))) AS position, unnest(embedding)::DOUBLE AS x "
    "FROM embeddings) GROUP BY ALL")

# --- audits -------------------------------------------------------------------------------------------------------
_OV = r"""ga AS (SELECT doc_id AS note_id, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g')), '___|[a-z0-9]+') AS w FROM documents) WHERE len(w) >= 13),
gb AS (SELECT w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT regexp_extract_all(lower(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g')), '___|[a-z0-9]+') AS w FROM benchmark) WHERE len(w) >= 13),
ov AS (SELECT note_id, count(DISTINCT g) AS shared, min(i) - 1 AS first_position FROM (SELECT note_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM ga) WHERE g IN (SELECT array_to_string(w[i : i + 12], ' ') FROM gb) GROUP BY note_id)"""
OVERLAP = f"WITH {_OV} SELECT * FROM ov"
COLLISIONS = _w("discharge radiology", select="SELECT DISTINCT subject_id FROM discharge WHERE subject_id IN (SELECT subject_id FROM radiology)")
GATE = _w("discharge radiology", _OV, "c AS (SELECT DISTINCT subject_id FROM discharge WHERE subject_id IN (SELECT subject_id FROM radiology))",
    select=("SELECT (SELECT count(*) FROM ov) AS notes, (SELECT count(*) FROM c) AS subjects, (SELECT count(*) "
    "FROM ov) = 0 AND (SELECT count(*) FROM c) = 0 AS clean"))
REFERENCE_DIFFERENCE = ("SELECT (SELECT count(*) FROM (SELECT lang, source FROM documents EXCEPT ALL SELECT lang, source "
    "FROM documents WHERE doc_id % 3 <> 0)) AS gone, (SELECT count(*) FROM (SELECT lang, source FROM documents "
    "WHERE doc_id % 3 <> 0 EXCEPT ALL SELECT lang, source FROM documents)) AS new")
_ST = r"""st AS (SELECT count(*) AS notes, quantile_cont(words, 0.5)::DOUBLE AS median_words, round(stddev_samp(lc), 9) AS log_deviation, round((sum(marks) * 1000)::DOUBLE / sum(words)::DOUBLE, 9) AS marks_per_thousand FROM (
  SELECT len(regexp_extract_all(text, '\S+')) AS words, CASE WHEN length(text) > 0 THEN ln(length(text)::DOUBLE) END AS lc, len(list_filter(regexp_extract_all(text, '_{3,}'), lambda x: length(x) = 3)) AS marks FROM m))"""
STATISTICS = f"WITH {_M}, {_ST} SELECT * FROM st"
STATISTICS_VIOLATIONS = (f"WITH {_M}, {_ST}, u AS (SELECT 'median_words' AS name, median_words AS value, 180.0::DOUBLE AS target "
    f"FROM st UNION ALL SELECT 'log_deviation', log_deviation, 1.0::DOUBLE FROM st UNION ALL SELECT 'marks_per_thousand', marks_per_thousand, 1000.0::DOUBLE "
    f"FROM st) SELECT * FROM u WHERE value IS NULL OR abs(value - target) > 0.1 * abs(target)")
TRANSLATION_SOURCE = "SELECT doc_id AS pair_id, concat('a ___ ', text) AS text FROM documents WHERE doc_id % 9 <> 0"
TRANSLATION_TARGET = ("SELECT doc_id AS pair_id, CASE doc_id % 6 WHEN 0 THEN ' ' WHEN 1 THEN concat('b ___ ', text) WHEN 2 THEN concat('b ', text) "
    "WHEN 3 THEN '___' ELSE concat('b ___ ', text, ' and thirty more characters at its end') END AS text "
    "FROM documents WHERE doc_id % 7 <> 0")
_K = "len(list_filter(regexp_extract_all({}, '_{{3,}}'), lambda x: length(x) = 3))"
TRANSLATION_CHECKS = f"""WITH s AS ({TRANSLATION_SOURCE}), t AS ({TRANSLATION_TARGET}), j AS (SELECT coalesce(s.pair_id, t.pair_id) AS pair_id, s.pair_id IS NOT NULL AS ha, t.pair_id IS NOT NULL AS hb, s.text AS a, t.text AS b FROM s FULL JOIN t ON s.pair_id = t.pair_id)
SELECT pair_id, 'no source' AS reason FROM j WHERE NOT ha UNION ALL SELECT pair_id, 'no translation' FROM j WHERE NOT hb UNION ALL SELECT pair_id, 'empty' FROM j WHERE ha AND hb AND trim(b) = ''
UNION ALL SELECT pair_id, 'length' FROM j WHERE ha AND hb AND trim(b) <> '' AND NOT (length(b)::DOUBLE / length(a) BETWEEN 0.8 AND 1.6) UNION ALL SELECT pair_id, 'marks' FROM j WHERE ha AND hb AND {_K.format('a')} <> {_K.format('b')}"""
BINDING_WHOLE = "SELECT doc_id AS pair_id, concat('one ', CAST(doc_id AS STRING), chr(10), chr(10), 'two') AS text FROM documents"
BINDING_PARTS = ("SELECT doc_id AS pair_id, 0 AS position, concat(' one ', CAST(doc_id AS STRING), ' ') AS text FROM documents "
    "WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 1, CASE WHEN doc_id % 4 = 0 THEN 'too' ELSE 'two' END "
    "FROM documents")
BINDING = (f"WITH w AS ({BINDING_WHOLE}), p AS ({BINDING_PARTS}), m AS (SELECT pair_id, string_agg(trim(text), chr(10) || chr(10) "
    f"ORDER BY position) AS t FROM p GROUP BY pair_id) SELECT w.pair_id FROM w LEFT JOIN m ON w.pair_id = m.pair_id "
    f"WHERE m.t IS DISTINCT FROM w.text")
# marks of three underscores stand between other characters than underscores; the nth gap is followed by the nth number
MASKED = f"""WITH {_M}, g AS (SELECT note_id, coalesce(text, '') AS text, string_split(replace(replace(coalesce(text, ''), '_____', chr(1)), '___', chr(2)), chr(2)) AS g FROM m)
SELECT note_id, sha256(replace(array_to_string(list_transform(g, lambda x, i: CASE WHEN i = 1 THEN x ELSE '[[' || (i - 1) || ']]' || x END), ''), chr(1), '_____')) AS masked, sha256(text) AS restored FROM g"""
PLACEHOLDER_ROWS = ("SELECT doc_id AS pair_id, 'x [[1]] y [[2]]' AS a, CASE doc_id % 4 WHEN 0 THEN '[[1]] [[2]]' WHEN 1 THEN '[[2]] [[2]]' "
    "WHEN 2 THEN '[[1]] [[2]] [[3]]' ELSE 'none' END AS b FROM documents")
PLACEHOLDERS = ("SELECT doc_id AS pair_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'duplicated [[2]], missing [[1]]' "
    "WHEN 2 THEN 'extra [[3]]' ELSE 'missing [[1]], missing [[2]]' END AS problems FROM documents")
ANSWERS = ("SELECT doc_id AS key, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'ok' END AS answer FROM documents WHERE doc_id % 3 <> 0 "
    "UNION ALL SELECT doc_id, 'later' FROM documents WHERE doc_id % 10 = 0")
REQUESTS = (f"WITH a AS (SELECT key, bool_or(trim(answer) <> '') AS ok FROM ({ANSWERS}) GROUP BY key) SELECT doc_id AS key, "
    f"CASE WHEN ok THEN 'done' WHEN ok IS NULL THEN 'open' ELSE 'failed' END AS state FROM documents LEFT "
    f"JOIN a ON doc_id = key")
DEMO = _w("predictions", select=("SELECT row_id, diagnosis, label, note_id, predicted FROM predictions QUALIFY row_number() OVER (PARTITION BY row_id, diagnosis, label "
    "ORDER BY note_id) = 1"))
_SHARES = "sh AS (" + " UNION ALL ".join((f"SELECT '{k}' AS label, count(*) FILTER (WHERE {k}) AS notes, round((count(*) FILTER (WHERE {k}))::DOUBLE / "
    f"count(*), 9) AS share FROM coh") for k in KEYS) + ")"


def label_shares() -> str:
    return _w(*_CO, _SHARES, select="SELECT * FROM sh")


def prevalence_outliers() -> str:
    return _w(*_CO, _SHARES, select="SELECT *, 0.2::DOUBLE AS target FROM sh WHERE abs(share - 0.2) > 0.02")


ALLOCATION_ROWS = ("SELECT o_custkey AS unit, CAST(o_orderkey AS STRING) AS name, CAST(1 + o_orderkey % 7 AS DOUBLE) AS weight, CAST(50 + o_custkey % 9 AS BIGINT) AS words "
    "FROM orders")
ALLOCATION = f"""WITH r AS ({ALLOCATION_ROWS}), e AS (SELECT *, words * weight / sum(weight) OVER (PARTITION BY unit) AS x FROM r), b AS (SELECT *, floor(x) AS f FROM e)
SELECT unit, name, CAST(f + CASE WHEN row_number() OVER (PARTITION BY unit ORDER BY f - x, name) <= words - sum(f) OVER (PARTITION BY unit) THEN 1 ELSE 0 END AS BIGINT) AS given FROM b"""
SENTINEL = """WITH r AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS n FROM nation), l AS (SELECT array_to_string(list_transform([5, 4, 3, 2, 1, 0], lambda i: chr((97 + (floor(n / pow(26, i))::BIGINT % 26))::INT)), '') AS w FROM r) SELECT 'nationxn_nationkeyx' || w AS n_nationkey, 'nationxn_namex' || w AS n_name FROM l"""
PLANS = ("SELECT CAST(doc_id + 1 AS STRING) AS note_id, CASE WHEN doc_id % 2 = 0 THEN array('Chief Complaint', 'Discharge Diagnosis') "
    "ELSE array('Brief Hospital Course', 'Chief Complaint', 'Allergies') END AS sections, 20 AS least_words, 80 AS most_words, 2 AS marks, array('course') AS required, array('zzz') AS forbidden "
    "FROM documents")
NOTE_VIOLATIONS = _w("sectioned",
    r"""p AS (SELECT note_id, text, doc_id, CASE WHEN doc_id % 2 = 0 THEN ['Chief Complaint:', 'Discharge Diagnosis:'] ELSE ['Brief Hospital Course:', 'Chief Complaint:', 'Allergies:'] END AS s FROM sectioned),
q AS (SELECT *, list_transform(s, lambda x: instr(text, x)) AS places, len(regexp_extract_all(text, '\S+')) AS words, len(list_filter(regexp_extract_all(text, '_{3,}'), lambda x: length(x) = 3)) AS marks FROM p)""",
    select="""SELECT note_id, 'section missing' AS reason FROM q WHERE list_contains(places, 0) UNION ALL SELECT note_id, 'section order' FROM q WHERE NOT list_contains(places, 0) AND list_sort(places) <> places
  UNION ALL SELECT note_id, 'length' FROM q WHERE words < 20 OR words > 80 UNION ALL SELECT note_id, 'marks' FROM q WHERE marks <> 2 UNION ALL SELECT note_id, 'mention missing' FROM q WHERE NOT contains(lower(text), 'course') UNION ALL SELECT note_id, 'mention not planned' FROM q WHERE contains(lower(text), 'zzz')""")
WINDOWED = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"
SESSIONS = """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM l) SELECT min(ts) AS session_start, user_id, count(*) AS n FROM g GROUP BY user_id, g"""
