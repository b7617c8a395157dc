"""Personal data by bootstrapped contextual extraction.

Seed entities are the base matches (email, ip, card, phone) and secrets: runs of SECRET letters, digits and `_`, `-`, `+`, `/` or more that turn
from letters to digits or back at every eighth place or more often.  Seeds and all other tokens that may be identifiers are slots: those with five digits or more or an at sign, and quoted or plain values that an equals sign, a colon or a number sign ties to a word, with
or without digits.  A slot's patterns are the two words before it; the word before it with the word after it; the
word before it with the marks between them, if one is of `=:#`; and the word before it with the slot's shape (runs of digits, of
letters, of both, and other marks).  Patterns and slot values make a graph, scored by Spark in ROUNDS rounds:

- a pattern's confidence for a kind is p / (q + UNKNOWN * u), where p of the distinct values in its slots are known to be
  of the kind, q are known at all and u are not; it counts from MIN_KNOWN values p on and must reach MIN_CONFIDENCE;
- a value that is not known becomes known for the kind of its best pattern if 1 - prod(1 - confidence)
  over its patterns of that kind reaches MIN_CONFIDENCE; ties go to the kind listed first.

Slots of values that became known, and the secrets, are added spans.  Base spans always stay.  Each text is read once: slots
go to a table, and the rounds work on distinct (pattern, value) pairs, which are pre-aggregated, so that a
pattern in a third of all documents is no hot key.

A null text is an empty one.  Rows are told apart by an own number, so repeated rows and null ids are kept
as they come; other columns are ignored; an empty table gives an empty result.  A very long text is read whole, by one task.
Positions are code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, arrow_map, fresh, read

#: The base kinds, and the one that only the method finds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
ROUNDS, MIN_KNOWN, MIN_CONFIDENCE, UNKNOWN = 3, 5, 0.9, 0.25
#: Code points of a secret, at least.
SECRET = 20
#: Code points before and after a slot in which its context words are looked for.
REACH = 60

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SLOT = re.compile(r"[^\s\"'<>(){}\[\],;|]*[0-9@][^\s\"'<>(){}\[\],;|]*")
_VALUE = re.compile(r"[^\W\d_]\x20?[=:#]\x20?(?:\"([^\"\s]+)\"|'([^'\s]+)'|([^\s\"'<>(){}\[\],;|]+))")
_TURN = re.compile("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")
_SECRET = re.compile(rf"[A-Za-z0-9_+/-]{{{SECRET},}}")
_WORD = re.compile(r"[^\W\d_]+")
_EMPTY = hashlib.sha256(b"").hexdigest()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if k % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches that do not overlap.  Work grows with the length of the text: each at sign is tried once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, z) for a, z in emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:] if len(x) > 4 else x) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def _number(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def is_secret(x: str) -> bool:
    """Whether a run of _SECRET's characters goes back and forth between letters and digits as no word or number does."""
    return len(set(x)) >= 8 and len(_TURN.findall(x)) >= max(3, len(x) / 8)


def shape(x: str) -> str:
    """x with each run of letters or digits as one mark: 9 for digits, a for letters, x for both."""
    return re.sub(r"[^\W_]+", lambda m: "9" if m[0].isdigit() else "x" if any(map(str.isdigit, m[0])) else "a", x)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int | None, int, int]]:
    """(kind, start, end) of all slots: base matches, secrets, and with no kind what may be an identifier."""
    found: list = list(base)
    taken = np.zeros(len(text) + 1, bool)
    for _, a, z in base:
        taken[a:z] = True
    secrets = [m.span() for m in _SECRET.finditer(text) if is_secret(m[0])]
    for a, z in secrets:
        taken[a:z] = True
    found += [(len(BASE), a, z) for a, z in secrets]

    def add(a: int, z: int) -> None:
        if a < z and not taken[a:z].any():
            taken[a:z] = True
            found.append((None, a, z))

    for m in _SLOT.finditer(text):
        a, z = m.span()
        while z > a and text[z - 1] in ".:!?-":
            z -= 1
        while a < z and text[a] in ".:!?=-":
            a += 1
        x = text[a:z]
        if "@" in x[1:-1] or sum("0" <= c <= "9" for c in x) >= 5:
            add(a, z)
    for m in _VALUE.finditer(text):
        a, z = m.span(next(k for k in (1, 2, 3) if m[k] is not None))
        while z > a and text[z - 1] in ".:!?":
            z -= 1
        if any(c.isalnum() for c in text[a:z]):
            add(a, z)
    return found


def patterns_of(text: str, a: int, z: int) -> list[int]:
    """Numbers of the lexical patterns around text[a:z]."""
    before = text[max(0, a - REACH) : a].rpartition("\n")[2]
    words = list(_WORD.finditer(before))[-2:]
    after = _WORD.search(text[z : z + REACH].partition("\n")[0])
    if not words:
        return []
    last = words[-1][0].lower()
    out = [_number("s", last, shape(text[a:z]))]
    if len(words) == 2:
        out.append(_number("2", words[0][0].lower(), last))
    if after:
        out.append(_number("1", last, after[0].lower()))
    marks = re.sub(r"\s+", " ", before[words[-1].end() :])
    if any(c in "=:#" for c in marks):
        out.append(_number("m", last, marks))
    return out


def slots(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """All slots with their value and patterns; kind is null for what is no seed."""
    out = []
    for k, a, z in candidates(text, base):
        value = re.sub(r"[\s().-]", "", text[a:z]).lower()
        out.append({"kind": k, "start": a, "end": z, "value": _number("v", value), "patterns": patterns_of(text, a, z)})
    return out


SCHEMA = "rid long, doc_id long, th long, base array<struct<kind:int,start:int,end:int>>, slots array<struct<kind:int,start:int,end:int,value:long,patterns:array<long>>>"
_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_SLOTS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("patterns", pa.list_(pa.int64()))]))


def _scan(batches):
    next_id = TaskContext.get().partitionId() << 40
    for batch in batches:
        n = batch.num_rows
        text = batch.column(1)
        some = pc.fill_null(pc.match_substring_regex(text, "[0-9@=:#]"), False).to_numpy(zero_copy_only=False)
        base: list = [None] * n
        more: list = [None] * n
        for k in np.flatnonzero(some):
            t = text[int(k)].as_py()
            b = base_spans(t)
            s = slots(t, b)
            if b:
                base[k] = [{"kind": x, "start": a, "end": z} for x, a, z in b]
            if s:
                more[k] = s
        rid = np.arange(next_id, next_id + n)
        next_id += n
        yield pa.RecordBatch.from_arrays([pa.array(rid), batch.column(0), batch.column(2), pa.array(base, _SPAN), pa.array(more, _SLOTS)],
            ["rid", "doc_id", "th", "base", "slots"])


def confidences(edges: DataFrame, known: DataFrame) -> DataFrame:
    """pattern, kind, conf of the patterns that count; edges has pattern and value, known value and kind."""
    state = edges.join(known, "value", "left").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"))
    sums = state.groupBy("pattern").agg(F.coalesce(F.sum(F.expr("if(kind is null, 0, n)")), F.lit(0)).alias("q"),
        F.coalesce(F.sum(F.expr("if(kind is null, n, 0)")), F.lit(0)).alias("u"))
    state = state.where(f"kind is not null and n >= {MIN_KNOWN}").join(sums, "pattern")
    return state.select("pattern", "kind", (F.col("n") / (F.col("q") + UNKNOWN * F.col("u"))).alias("conf")).where(f"conf >= {MIN_CONFIDENCE}")


def discovered(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """Spans that patterns add: rid, kind, start, end."""
    cells = rows.where("slots is not null").select("rid", F.inline("slots"))
    edges = cells.select(F.explode("patterns").alias("pattern"), "value", "kind").groupBy("pattern", "value").agg(F.min("kind").alias("kind"))
    edges = scratch.write(edges, "edges")
    known = edges.where("kind is not null").groupBy("value").agg(F.min("kind").alias("kind"))
    edges = edges.drop("kind")
    new = None
    for _ in range(ROUNDS):
        conf = confidences(edges, known)
        found = edges.join(known, "value", "left_anti").join(conf, "pattern").groupBy("value", "kind")
        found = found.agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-9)))))).alias("score"))
        found = found.where(f"score >= {MIN_CONFIDENCE}").groupBy("value").agg(F.max_by("kind", F.struct(F.round("score", 9), -F.col("kind"))).alias("kind"))
        found = scratch.write(found, "found")
        if not found.limit(1).count():
            break
        new = found if new is None else new.unionAll(found)
        known = scratch.write(known.unionAll(found), "known")
    seeds = cells.where(f"kind = {len(BASE)}").select("rid", "kind", "start", "end")
    return seeds if new is None else seeds.unionAll(cells.where("kind is null").drop("kind").join(new, "value").select("rid", "kind", "start", "end"))


def personal_data(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, th (the text's hash), base and added (arrays of kind, start, end; kind is a position in KINDS)."""
    scratch = Scratch(spark)
    rows = scratch.write(arrow_map(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th")), _scan, SCHEMA), "slots")
    added = discovered(scratch, rows).groupBy("rid").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return rows.join(added, "rid", "left").select("doc_id", "th", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))


def redact(spark: SparkSession, docs: DataFrame, mark: str = "[{}]") -> DataFrame:
    """docs with every span replaced by a mark that names its kind; equal texts have equal spans, whatever their ids."""
    raise_kind = F.array(*[F.lit(mark.format(k.upper())) for k in KINDS])
    mine, at = fresh("text"), fresh("spans")
    spans = personal_data(spark, docs).select(F.col("th").alias(mine), F.array_sort(F.transform(F.concat("base", "added"),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))).alias(at)).where(F.size(at) > 0).dropDuplicates([mine])
    out = docs.join(spans, F.xxhash64("text") == F.col(mine), "left")
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("at"))
    merged = F.aggregate(at, start, lambda s, x: F.when(x["start"] < s["at"], s).otherwise(F.struct(F.concat(s["t"],
        F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.get(raise_kind, x["kind"])).alias("t"), x["end"].alias("at"))))
    text = F.when(F.col(at).isNull(), F.col("text")).otherwise(F.concat(merged["t"], F.substring(F.col("text"), merged["at"] + 1, F.length("text"))))
    return out.withColumn("text", text).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(spark, read(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def line(spans):
        return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")

    def count(k: int):
        return F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")  # a second argument would be the position

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    added = F.size("added").cast("long").alias("n_added")
    return out.select("doc_id", *counts, F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.concat("base", "added")).alias("spans"), added)
