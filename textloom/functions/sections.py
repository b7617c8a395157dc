"""The section lexicon and the parser that cuts a note at its headers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The form of a header, for Java and for Python.
HEADER = r"^[ \t]*([A-Z][A-Za-z][A-Za-z \-/&()'.]{0,47}):"
HEADER_JAVA = "(?md)" + HEADER
MIN_HEADER = 3
OTHER = "OTHER"
_HEADER = re.compile(HEADER, re.M)


@dataclass(frozen=True)
class Section:
    key: str
    synonyms: tuple[str, ...]
    diagnostic: bool = False


#: Our own lexicon.
LEXICON = (
    Section("allergies", ("allergies", "allergy")),
    Section("chief_complaint", ("chief complaint", "reason for admission")),
    Section("present_illness", ("history of present illness",)),
    Section("past_history", ("past medical history",)),
    Section("social_history", ("social history",)),
    Section("family_history", ("family history",)),
    Section("physical_exam", ("physical exam",)),
    Section("results", ("pertinent results",)),
    Section("hospital_course", ("brief hospital course", "hospital course")),
    Section("medications_admission", ("medications on admission",)),
    Section("discharge_medications", ("discharge medications",)),
    Section("disposition", ("discharge disposition",)),
    Section("discharge_diagnosis", ("discharge diagnosis", "final diagnosis"), True),
    Section("condition", ("discharge condition",)),
    Section("instructions", ("discharge instructions",)),
    Section("followup", ("followup instructions",)),
    Section("procedure", ("major surgical or invasive procedure",)),
)
PREAMBLE = ("name", "unit no", "admission date", "discharge date", "date of birth", "sex", "service", "attending")


def check_lexicon(lexicon: tuple[Section, ...] = LEXICON, preamble: tuple[str, ...] = PREAMBLE) -> None:
    """Refuses keys and synonyms that are not unique or not in normal form."""
    names = [s for x in lexicon for s in x.synonyms] + list(preamble)
    if len(set(names)) < len(names) or len({x.key for x in lexicon}) < len(lexicon):
        raise ValueError("the lexicon repeats a name")
    if any(normal_header(n) != n or len(n) < MIN_HEADER for n in names):
        raise ValueError("a name of the lexicon is not in normal form")


def normal_header(header: str) -> str:
    return re.sub(r"\s+", " ", header.lower()).rstrip(" .")


def normal_header_column(header: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.lower(header), r"\s+", " "), F.lit(" ."))


def lookup(lexicon: tuple[Section, ...] = LEXICON, preamble: tuple[str, ...] = PREAMBLE) -> dict[str, tuple[str, str]]:
    """From each name to the key that it starts once, and the section that it opens."""
    return {s: (x.key, x.key) for x in lexicon for s in x.synonyms} | {p: ("field " + p, OTHER) for p in preamble}


def split_sections(text: str, names: dict[str, tuple[str, str]]) -> list[tuple[str, int, int, int]]:
    """(section, start, body, end) of all parts; texts of parts, put together, are the text.

    Only the first header of a key cuts; later ones are body.  The first of an administrative field cuts
    too and opens OTHER; neighbouring OTHER parts are one, and an OTHER part has no header.
    """
    cuts, seen = [], set()
    for m in _HEADER.finditer(text):
        key, section = names.get(normal_header(m[1]), (None, None))
        if key and key not in seen:
            seen.add(key)
            cuts.append((section, m.start(), m.end() if section != OTHER else m.start()))
    if not cuts or cuts[0][1] > 0:
        cuts.insert(0, (OTHER, 0, 0))
    parts: list[tuple[str, int, int, int]] = []
    for k, (section, start, body) in enumerate(cuts):
        end = cuts[k + 1][1] if k + 1 < len(cuts) else len(text)
        if section == OTHER and parts and parts[-1][0] == OTHER:
            parts[-1] = (OTHER, parts[-1][1], parts[-1][2], end)
        elif end > start:
            parts.append((section, start, body, end))
    return parts


def strip_sections(text: str, names: dict[str, tuple[str, str]], keys: set[str]) -> str:
    """The text without the named sections and their headers.  Doing so twice may drop more: a later header becomes the first."""
    return "".join(text[a:z] for s, a, _, z in split_sections(text, names) if s not in keys)
