"""From the headers of an extract to canonical columns, and whether the result is usable."""

from __future__ import annotations

from dataclasses import dataclass, field
from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.values import ref
from ledgerlens.sources.schemas import REPORT_TYPES, SPARK_TYPES, Field

SKIP = "__skip__"
DEFAULT_THRESHOLD = 0.6


def exact_mapping(headers: list[str], report_type: str) -> dict[str, str]:
    """{header: canonical} for headers that are an accepted name; a later column wins a shared alias."""
    known = {a.strip().lower(): f.name for f in REPORT_TYPES.get(report_type, ()) for a in f.aliases}
    return {h: known[h.strip().lower()] for h in headers if h.strip().lower() in known}


def _likeness(header: str, column: Field) -> float:
    wanted = header.strip().lower()
    return max(
        (1.0 if wanted == a else SequenceMatcher(None, wanted, a).ratio() for a in column.aliases), default=0.0
    )


def suggest_mapping(
    headers: list[str], report_type: str, threshold: float = DEFAULT_THRESHOLD
) -> dict[str, tuple[str, float]]:
    """{header: (most similar canonical, score to two digits)} at or above the threshold."""
    suggestions = {}
    for h in headers:
        scored = [(_likeness(h, f), f.name) for f in REPORT_TYPES.get(report_type, ())]
        best = max(scored, key=lambda s: s[0], default=(0.0, ""))  # the first column wins a tie
        if best[0] > 0 and best[0] >= threshold:
            suggestions[h] = (best[1], round(best[0], 2))
    return suggestions


def resolve_mapping(
    headers: list[str], report_type: str, mapping: dict[str, str] | None, threshold: float | None
) -> dict[str, str]:
    """The {header: canonical} to apply; two headers on one canonical column are an error."""
    if mapping is not None:
        chosen = {h: c for h, c in mapping.items() if c and c != SKIP and h in headers}
    else:
        chosen = exact_mapping(headers, report_type)
        if threshold is not None:
            left = [h for h in headers if h not in chosen]
            ranked = sorted(suggest_mapping(left, report_type, threshold).items(), key=lambda s: -s[1][1])
            for h, (canonical, _) in ranked:
                if canonical not in chosen.values():
                    chosen[h] = canonical
    clashes = sorted({c for c in chosen.values() if list(chosen.values()).count(c) > 1})
    if clashes:
        raise ValueError(f"several headers map to {', '.join(clashes)}")
    return chosen


def normalize(
    df: DataFrame,
    report_type: str,
    mapping: dict[str, str] | None = None,
    threshold: float | None = None,
    typed: bool = True,
) -> DataFrame:
    """Canonical names and types in one select; unmapped and skipped headers pass through as they are.

    Without a mapping headers are matched exactly, and with a threshold the rest by
    likeness. An unknown report type passes everything. Values that do not fit their
    declared type become NULL.
    """
    chosen = resolve_mapping(df.columns, report_type, mapping, threshold)
    kinds = {f.name: f.type for f in REPORT_TYPES.get(report_type, ())}
    passing = [c for c in df.columns if c not in chosen and c in chosen.values()]
    if passing:
        raise ValueError(f"unmapped headers would clash with mapped columns: {', '.join(passing)}")
    columns = []
    for c in df.columns:
        name = chosen.get(c, c)
        kind = kinds.get(name, "str") if c in chosen else "str"
        value = ref(c).try_cast(SPARK_TYPES[kind]) if typed and kind != "str" else ref(c)
        columns.append(value.alias(name))
    return df.select(*columns)


@dataclass
class Validation:
    report_type: str
    rows: int
    missing_required: list[str]
    unmapped: list[str]
    nulls: dict[str, int] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return self.rows > 0 and not self.missing_required


def validate(df: DataFrame, report_type: str) -> Validation:
    """Required columns, headers outside the schema, rows, and NULLs per column, in one job."""
    fields = REPORT_TYPES.get(report_type, ())
    names = {f.name for f in fields}
    missing = [f.name for f in fields if f.required and f.name not in df.columns]
    unmapped = [c for c in df.columns if fields and c not in names and not c.startswith("_")]
    counts = [F.count("*")] + [F.count_if(ref(c).isNull()) for c in df.columns]
    row = df.agg(*[c.alias(f"n{i}") for i, c in enumerate(counts)]).first()
    return Validation(report_type, row[0], missing, unmapped, dict(zip(df.columns, row[1:])))
