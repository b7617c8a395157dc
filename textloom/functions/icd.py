"""Diagnosis codes: normal form, prefixes, and the candidate pool."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Candidate:
    """A diagnosis with its code prefixes of both versions and the words that mention it."""

    key: str
    nine: tuple[str, ...]
    ten: tuple[str, ...]
    chapter: str = ""
    keywords: tuple[str, ...] = ()
    acronyms: tuple[str, ...] = ()
    variants: tuple[str, ...] = ()
    misspellings: tuple[tuple[str, str], ...] = ()
    groups: tuple[str, ...] = ()


#: Our own pool; the words of its mentions are chosen to occur in the given tables.
POOL = (
    Candidate("diabetes", ("250",), ("E11",), "endocrine", ("the", "there of"), ("DM",), ("type 2 diabetes",), groups=("diabetes", "diabetes with complications")),
    Candidate("copd", ("496",), ("J44",), "respiratory", ("that", "une"), ("COPD",), ("chronic obstructive lung disease",), groups=("pulmonary disease",)),
    Candidate("ckd", ("585",), ("N18",), "genitourinary", ("for", "und die"), ("CKD",), ("chronic renal insufficiency",), groups=("renal disease",)),
    Candidate("pneumonia", ("486",), ("J18",), "respiratory", ("with", "pour"), ("PNA",), ("pneumonitis",)),
    Candidate("atrial_fibrillation", ("4273",), ("I48",), "circulatory", ("have", "para"), ("AF",), ("auricular fibrillation",)),
)


def check_disjoint(pool: tuple[Candidate, ...]) -> None:
    """Refuses a pool in which prefixes of two diagnoses overlap within a version."""
    for version in ("nine", "ten"):
        own = [(c.key, p) for c in pool for p in getattr(c, version)]
        for k, p in own:
            if any(j != k and (p.startswith(q) or q.startswith(p)) for j, q in own):
                raise ValueError(f"prefixes of version {version} overlap")
    if len({c.key for c in pool}) < len(pool):
        raise ValueError("two diagnoses share a name")


def normal_text(code: str) -> str | None:
    """normal_code for a value of the configuration."""
    c = code.strip().upper()
    return c if c.isalnum() and c.isascii() else None


def normal_code(code: Column) -> Column:
    """Upper case without surrounding white space; null if anything but letters and digits is left, or nothing."""
    c = F.upper(F.regexp_replace(code, r"^\s+|\s+$", ""))
    return F.when(c.rlike(r"\A[0-9A-Z]+\z"), c)


def version_number(version: Column) -> Column:
    v = F.trim(version)
    return F.when(v == "9", 9).when(v == "10", 10)


def matches(code: Column, version: Column, nine: tuple[str, ...], ten: tuple[str, ...]) -> Column:
    """Whether the code has a prefix of its own version; false, never null, for empty lists and null codes."""
    out = F.lit(False)
    for number, prefixes in ((9, nine), (10, ten)):
        for p in prefixes:
            out = out | ((version == number) & code.startswith(p))
    return F.coalesce(out, F.lit(False))


def diagnosis_of(code: Column, version: Column, pool: tuple[Candidate, ...] = POOL) -> Column:
    """The key of the one diagnosis whose prefix the code has, else null."""
    check_disjoint(pool)
    return F.coalesce(*[F.when(matches(code, version, c.nine, c.ten), F.lit(c.key)) for c in pool], F.lit(None).cast("string"))


def code_group(code: Column, version: Column) -> Column:
    """The first three characters; four for codes of version 9 that start with E."""
    return F.substring(code, F.lit(1), F.when((version == 9) & code.startswith("E"), 4).otherwise(3))


#: The 17 groups of the Charlson index as published for both versions of codes (Quan and others, 2005).
CHARLSON = {
    "myocardial infarction": ("410 412", "I21 I22 I252"),
    "heart failure": ("39891 40201 40211 40291 40401 40403 40411 40413 40491 40493 4254-4259 428", "I099 I110 I130 I132 I255 I420 I425-I429 I43 I50 P290"),
    "peripheral vascular disease": ("0930 4373 440 441 4431-4439 4471 5571 5579 V434", "I70 I71 I731 I738 I739 I771 I790 I792 K551 K558 K559 Z958 Z959"),
    "cerebrovascular disease": ("36234 430-438", "G45 G46 H340 I60-I69"),
    "dementia": ("290 2941 3312", "F00-F03 F051 G30 G311"),
    "pulmonary disease": ("4168 4169 490-505 5064 5081 5088", "I278 I279 J40-J47 J60-J67 J684 J701 J703"),
    "rheumatic disease": ("4465 7100-7104 7140-7142 7148 725", "M05 M06 M315 M32-M34 M351 M353 M360"),
    "peptic ulcer": ("531-534", "K25-K28"),
    "mild liver disease": ("07022 07023 07032 07033 07044 07054 0706 0709 570 571 5733 5734 5738 5739 V427",
        "B18 K700-K703 K709 K713-K715 K717 K73 K74 K760 K762-K764 K768 K769 Z944"),
    "diabetes": ("2500-2503 2508 2509", "E100 E101 E106 E108 E109 E110 E111 E116 E118 E119 E120 E121 E126 E128 E129 E130 E131 E136 E138 E139 E140 E141 E146 E148 E149"),
    "diabetes with complications": ("2504-2507", "E102-E105 E107 E112-E115 E117 E122-E125 E127 E132-E135 E137 E142-E145 E147"),
    "paralysis": ("3341 342 343 3440-3446 3449", "G041 G114 G801 G802 G81 G82 G830-G834 G839"),
    "renal disease": ("40301 40311 40391 40402 40403 40412 40413 40492 40493 582 5830-5837 585 586 5880 V420 V451 V56",
        "I120 I131 N032-N037 N052-N057 N18 N19 N250 Z490-Z492 Z940 Z992"),
    "malignancy": ("140-172 174-194 1950-1958 200-208 2386", "C00-C26 C30-C34 C37-C41 C43 C45-C58 C60-C76 C81-C85 C88 C90-C97"),
    "severe liver disease": ("4560-4562 5722-5728", "I850 I859 I864 I982 K704 K711 K721 K729 K765-K767"),
    "metastases": ("196-199", "C77-C80"),
    "immunodeficiency": ("042-044", "B20-B22 B24"),
}


def prefixes(ranges: str) -> tuple[str, ...]:
    """The prefixes of a list with ranges: `I60-I62` is I60, I61 and I62."""
    out = []
    for x in ranges.split():
        first, _, last = x.partition("-")
        letter = first.rstrip("0123456789")
        digits = first[len(letter) :]
        stop = int(last[len(letter) :]) if last else int(digits or 0)
        out += [f"{letter}{k:0{len(digits)}d}" for k in range(int(digits), stop + 1)]
    return tuple(out)


def charlson() -> dict[str, tuple[tuple[str, ...], tuple[str, ...]]]:
    """The prefixes of each group, of version 9 and of version 10."""
    return {k: (prefixes(nine), prefixes(ten)) for k, (nine, ten) in CHARLSON.items()}
