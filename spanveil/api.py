"""One text at a time: the DataFrame operators behind plain values, for programs and the command line."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from spanveil.operators import policy as policies
from spanveil.operators.redact import as_record
from spanveil.operators.scorer import ModelUnavailable
from spanveil.plans import analyze as plans

__all__ = ["Analysis", "Deidentified", "LeakFound", "ModelUnavailable", "Span", "available_policies", "deidentify", "extract"]

TEXT_DDL = "document bigint, text string"


class LeakFound(RuntimeError):
    """A value that was to be removed is still in the text.  Names none of the values."""


@dataclass(frozen=True)
class Span:
    label: str
    text: str
    start: int
    end: int
    confidence: float
    source: str

    def overlaps(self, other: Span) -> bool:
        return self.start < other.end and other.start < self.end


@dataclass(frozen=True)
class Analysis:
    text: str
    spans: list[Span]
    detector: str

    def by_label(self) -> dict[str, list[Span]]:
        """Spans of each label, labels in the order in which they first appear."""
        return {label: [s for s in self.spans if s.label == label] for label in dict.fromkeys(s.label for s in self.spans)}


@dataclass(frozen=True)
class Deidentified:
    original_text: str
    text: str
    spans: list[Span]
    method: str
    policy: str
    replacements: dict[str, str] = field(default_factory=dict)
    leaks: list[str] = field(default_factory=list)
    audit: dict = field(default_factory=dict)
    #: The record without the values found, as JSON-ready values.
    record: dict = field(default_factory=dict)


def session() -> SparkSession:
    """The running session, or a small local one."""
    return SparkSession.getActiveSession() or SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()


def _spans(rows) -> list[Span]:
    return [Span(r.label, r["text"], r.start, r.end, r.confidence, r.source) for r in rows]


def extract(text: str, labels: Iterable[str] | None = None, spark: SparkSession | None = None, **options) -> Analysis:
    """The spans of a text; ``options`` are those of ``plans.analyze``."""
    df = (spark or session()).createDataFrame([(0, text)], TEXT_DDL)
    row = plans.analyze(df, labels=labels, **options).first()
    return Analysis(text, _spans(row.spans), row.detector)


def deidentify(text: str, policy: str = "ferpa", method: str | None = None, verify: bool = True, spark: SparkSession | None = None, **options) -> Deidentified:
    """A text under a policy; with ``verify`` a leak raises ``LeakFound``.  ``options`` are those of ``plans.deidentify``."""
    df = (spark or session()).createDataFrame([(0, text)], TEXT_DDL)
    out = plans.deidentify(df, policy, method=method, verify=False, **options)
    row = out.withColumn("record", as_record(include_values=False)).first()
    audit = row.audit.asDict(recursive=True) | {"verified": verify}
    if verify and row.leaks:
        raise LeakFound(f"{len(row.leaks)} values are still in the text")
    record = row.record.asDict(recursive=True) | {"audit": audit}
    return Deidentified(text, row.deidentified_text, _spans(row.spans), row.method_used, audit["policy"], dict(row.replacements), list(row.leaks), audit, record)


def available_policies() -> list[str]:
    return policies.available()
