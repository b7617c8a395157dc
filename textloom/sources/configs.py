"""Configuration files: the candidate pool, the section lexicon, the catalog of tables.  All are JSON, read once on the driver."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

from textloom.functions.icd import Candidate, check_disjoint, normal_text
from textloom.functions.notetext import acronyms, check_normalization, variants
from textloom.functions.sections import Section, check_lexicon
from textloom.operators.cohort import Refused


def read_config(spark: SparkSession, path: str):
    """The content of a JSON file in any store that Spark reads."""
    try:
        return json.loads(spark.read.text(path, wholetext=True).first()["value"])
    except (TypeError, ValueError) as e:
        raise Refused("the configuration is no JSON") from e


def _fields(entry: dict, known: dict[str, type], name: str) -> dict:
    if not isinstance(entry, dict) or set(entry) - set(known) or any(not isinstance(v, known[k]) for k, v in entry.items()):
        raise Refused(f"an entry of the {name} has unknown or wrong fields")
    return entry


def load_pool(spark: SparkSession, path: str) -> tuple[Candidate, ...]:
    """Candidates with prefixes of both versions and the words that mention them.

    Refused: prefixes that are no codes or overlap between candidates, names, acronyms or variants that two candidates share, and
    corrections that would be corrected again.
    """
    known = {"key": str, "nine": list, "ten": list, "chapter": str, "keywords": list, "acronyms": list, "variants": list, "misspellings": dict, "groups": list}
    out = []
    for entry in read_config(spark, path):
        e = _fields(entry, known, "pool")
        if not e.get("key") or not (e.get("nine") or e.get("ten")):
            raise Refused("a candidate lacks its name or its prefixes")
        lists = {k: tuple(e.get(k, ())) for k, kind in known.items() if kind is list}
        out.append(Candidate(key=e["key"], chapter=e.get("chapter", ""), misspellings=tuple(e.get("misspellings", {}).items()), **lists))
    pool = tuple(out)
    if any(p != normal_text(p) for c in pool for p in (*c.nine, *c.ten)):
        raise Refused("a prefix is no code")
    for kind in ("acronyms", "variants"):
        words = [w.lower() if kind == "variants" else w for c in pool for w in getattr(c, kind)]
        if len(set(words)) < len(words):
            raise Refused(f"two candidates share one of their {kind}")
    try:
        check_disjoint(pool)
        check_normalization(variants(pool))
    except ValueError as e:
        raise Refused(str(e)) from e
    if any(not re.fullmatch(r"[A-Za-z0-9]+", a) for a in acronyms(pool)):
        raise Refused("an acronym is more than a word")
    return pool


def load_lexicon(spark: SparkSession, path: str) -> tuple[tuple[Section, ...], tuple[str, ...]]:
    """Sections with their synonyms, and the administrative fields."""
    body = _fields(read_config(spark, path), {"sections": list, "fields": list}, "lexicon")
    sections = []
    for entry in body.get("sections", ()):
        e = _fields(entry, {"key": str, "synonyms": list, "diagnostic": bool}, "lexicon")
        sections.append(Section(e["key"], tuple(e["synonyms"]), e.get("diagnostic", False)))
    lexicon, fields = tuple(sections), tuple(body.get("fields", ()))
    try:
        check_lexicon(lexicon, fields)
    except ValueError as e:
        raise Refused(str(e)) from e
    return lexicon, fields


@dataclass(frozen=True)
class CatalogTable:
    """A table to be loaded: where from, and the digest of the file."""

    url: str
    sha256: str

    @property
    def name(self) -> str:
        """The name of the file without `.csv` or `.csv.gz`."""
        return re.sub(r"\.csv(\.gz)?$", "", self.url.rstrip("/").rsplit("/", 1)[-1])


def load_catalog(spark: SparkSession, path: str) -> dict[str, CatalogTable]:
    """Tables by name; refused are repeated names and digests that are none."""
    tables = [CatalogTable(**_fields(e, {"url": str, "sha256": str}, "catalog")) for e in read_config(spark, path)]
    if any(not re.fullmatch("[0-9a-f]{64}", t.sha256) for t in tables) or len({t.name for t in tables}) < len(tables):
        raise Refused("the catalog repeats a name, or a digest is none")
    return {t.name: t for t in tables}
