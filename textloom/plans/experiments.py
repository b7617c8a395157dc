"""What is declared about experiments: search spaces, the matrix of runs, manifests, and reports with their lineage."""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from textloom.operators.cohort import Refused
from textloom.sources import tables

# --- search spaces ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Interval:
    """Numbers from low to high, whole ones if both are; on a logarithmic scale only above 0."""

    low: float
    high: float
    log: bool = False

    def __post_init__(self):
        if type(self.low) is not type(self.high) or not self.low <= self.high or (not self.whole and self.low == self.high) or (self.log and self.low <= 0):
            raise Refused("an interval has no numbers")

    @property
    def whole(self) -> bool:
        return type(self.low) is int

    def __contains__(self, x) -> bool:
        return type(x) is type(self.low) and math.isfinite(x) and self.low <= x <= self.high

    def at(self, u: float):
        """The number at a share u of the way, in [0, 1)."""
        if self.whole:
            span = (math.log(self.low), math.log(self.high + 1)) if self.log else (self.low, self.high + 1)
            x = span[0] + u * (span[1] - span[0])
            return min(int(math.exp(x) if self.log else x), self.high)
        return math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low))) if self.log else self.low + u * (self.high - self.low)


@dataclass(frozen=True)
class Choice:
    """One of some values; values of different types differ."""

    values: tuple

    def __post_init__(self):
        if not self.values or len({(type(v), v) for v in self.values}) < len(self.values):
            raise Refused("choices are empty or repeat")

    def __contains__(self, x) -> bool:
        return any(type(x) is type(v) and x == v for v in self.values)

    def at(self, u: float):
        return self.values[min(int(u * len(self.values)), len(self.values) - 1)]


@dataclass(frozen=True)
class Space:
    """Parameters by name; branches add theirs, with their name before it, for one value of a choice."""

    params: dict
    branches: dict[tuple[str, object], "Space"] = field(default_factory=dict)

    def __post_init__(self):
        if not self.params or any(not isinstance(self.params.get(n), Choice) or v not in self.params[n] for n, v in self.branches):
            raise Refused("a space has no parameters, or a branch no choice")

    def active(self, values: dict) -> dict:
        """The parameters that these values have to give."""
        out = dict(self.params)
        for (name, value), space in self.branches.items():
            if name in values and values[name] == value:
                inner = {k.removeprefix(f"{value}."): v for k, v in values.items() if k.startswith(f"{value}.")}
                out |= {f"{value}.{k}": p for k, p in space.active(inner).items()}
        return out

    def __contains__(self, values: dict) -> bool:
        known = self.active(values)
        return set(known) == set(values) and all(values[k] in p for k, p in known.items())

    def draw(self, uniform) -> dict:
        """Values of all active parameters; uniform(name) gives a number in [0, 1)."""
        out: dict = {}
        while missing := sorted(set(self.active(out)) - set(out)):
            out |= {k: self.active(out)[k].at(uniform(k)) for k in missing}
        return out


# --- the matrix of experiments ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Experiment:
    id: str
    language: str
    model: str
    trials: int
    strip_sections: bool = False
    normalize: bool = False
    classical: bool = True

    @property
    def axes(self) -> tuple:
        return self.language, self.model, self.strip_sections, self.normalize


def check_matrix(rows: list[Experiment], lexicon_language: str = "en") -> dict[str, Experiment]:
    """Experiments by id.  Refused: repeated ids or axes, different numbers of trials, and rules of one language in another."""
    if not rows or any(n > 1 for n in Counter(r.id for r in rows).values()) or any(n > 1 for n in Counter(r.axes for r in rows).values()):
        raise Refused("experiments are missing or repeat")
    if len({r.trials for r in rows}) > 1 or min(r.trials for r in rows) < 1:
        raise Refused("experiments have different numbers of trials")
    if any((r.strip_sections or r.normalize) and r.language != lexicon_language for r in rows):
        raise Refused("sections and normal forms are known in one language only")
    if any(r.normalize and not r.classical for r in rows):
        raise Refused("normal forms are for classical models")
    return {r.id: r for r in rows}


# --- manifests and lineage ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Manifest:
    """What a run read and wrote, by name and SHA-256, and its settings."""

    step: str
    run: str
    seed: int
    started: str
    finished: str
    inputs: dict[str, str]
    outputs: dict[str, str]
    settings: dict = field(default_factory=dict)

    def __post_init__(self):
        digests = [*self.inputs.values(), *self.outputs.values()]
        if any(len(d) != 64 or set(d) - set("0123456789abcdef") for d in digests):
            raise Refused("a digest is none")
        if not self.step or not self.run or not self.outputs or self.finished < self.started or set(self.inputs) & set(self.outputs):
            raise Refused("the manifest does not fit together")


def write_manifest(spark: SparkSession, path: str, manifest: Manifest) -> None:
    spark.createDataFrame([(json.dumps(asdict(manifest), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    try:
        return Manifest(**tables.read_manifest(spark, path))
    except (TypeError, ValueError) as e:
        raise Refused("the manifest cannot be read") from e


def check_lineage(manifests: list[Manifest], pairs: list[tuple[str, str, str]]) -> None:
    """Refuses steps that did not read what another wrote: pairs are (writing step, reading step, name of the artifact)."""
    by = {m.step: m for m in manifests}
    if len(by) < len(manifests):
        raise Refused("a step has two manifests")
    for writer, reader, name in pairs:
        if writer not in by or reader not in by or by[writer].outputs.get(name) is None or by[writer].outputs[name] != by[reader].inputs.get(name):
            raise Refused(f"{reader} did not read {name} of {writer}")


def write_report(spark: SparkSession, metrics: DataFrame, path: str, manifests: list[Manifest], pairs: list[tuple[str, str, str]]) -> dict:
    """Metrics as JSON lines with the digests of the runs that led to them, once their lineage is checked."""
    check_lineage(manifests, pairs)
    tables.write_json_lines(metrics, path)
    facts = {"runs": {m.step: m.run for m in manifests}, "inputs": {m.step: m.inputs for m in manifests}}
    tables.write_provenance(spark, path, facts)
    return facts


# --- the audit of a corpus ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class AuditPin:
    """What an audit was made with: its method, the labels it knows, and the multiset of its reference texts by digest."""

    method: str
    labels: tuple[str, ...]
    reference: str


def pin_audit(method: str, labels: tuple[str, ...], reference: DataFrame) -> AuditPin:
    """reference has text; its multiset is known by count, sum and xor of hashes, added up where the texts are."""
    from pyspark.sql import functions as F

    h = F.xxhash64("text")
    one = reference.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 40))).alias("s")).first()
    return AuditPin(method, tuple(sorted(labels)), f"{one['n']}:{one['x']}:{one['s']}")


def check_audit(pin: AuditPin, method: str, labels: tuple[str, ...], reference: DataFrame) -> None:
    """Refuses an audit by another method, with other labels, or against other texts than those of the pin."""
    found = pin_audit(method, labels, reference)
    differs = [k for k in ("method", "labels", "reference") if getattr(pin, k) != getattr(found, k)]
    if differs:
        raise Refused(f"the audit differs from its pin in {differs}")
