"""The scoring policy: keyword patterns, weights and thresholds, as plain frozen dataclasses.

A policy lives on the driver; its values become literals of column expressions. ``load`` overrides
any part of it from a JSON file.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field

# Stored names of the facility classes and of the region statuses.
TRUSTED = "Trusted ICU Coverage"
GAP = "Likely Medical Gap"
INSUFFICIENT = "Insufficient Data"
REVIEW = "Needs Human Review"
CLASSES = (TRUSTED, GAP, INSUFFICIENT, REVIEW)
CLASS_LABELS = {
    TRUSTED: "Trusted ICU evidence",
    REVIEW: "Needs Human Review",
    GAP: "No ICU evidence in judgeable record",
    INSUFFICIENT: "Insufficient Data",
}
REGION_TRUSTED = "Trusted ICU evidence found"
REGION_GAP = "Potential planning gap"
REGION_DESERT = "Insufficient data to assess"
REGION_VERIFY = "Needs facility verification"
REGION_STATUSES = (REGION_TRUSTED, REGION_GAP, REGION_DESERT, REGION_VERIFY)
UNASSIGNED = "(unassigned)"
GENERAL_SUBTYPE = "general_or_unspecified"
SUBTYPE_LABELS = {
    "neonatal_icu": "NICU (neonatal)",
    "pediatric_icu": "PICU (paediatric)",
    "cardiac_icu": "cardiac ICU / ICCU",
    "medical_icu": "MICU (medical)",
    "surgical_icu": "SICU (surgical)",
    GENERAL_SUBTYPE: "general / unspecified ICU",
}
CONTRADICTION, SUSPICIOUS, DATA_QUALITY = "contradiction", "suspicious", "data_quality"

#: Fields scanned for evidence, in order; all but the first hold lists.
TEXT_FIELDS = ("description", "capability", "specialties", "procedure", "equipment")
LIST_FIELDS = ("capability", "specialties", "procedure", "equipment", "source_urls")
#: Signal groups in the order of scanning.
GROUPS = ("explicit_icu", "equipment", "procedure", "staffing", "specialty_context")


@dataclass(frozen=True)
class Keywords:
    """Regular expressions by signal group, matched whatever the case."""

    explicit_icu: tuple[str, ...] = (
        r"\bicu\b", r"\bi\.c\.u\b", r"\biccu\b", r"\bnicu\b", r"\bpicu\b", r"\bmicu\b", r"\bsicu\b", r"intensive\s+care", r"critical\s+care",
    )
    specialty_context: tuple[str, ...] = (r"criticalcare",)
    cross_organization: tuple[str, ...] = (
        r"\blisted\s+(as|in|under)\b", r"\bdirectory\b", r"\breferral\s+hospital\b", r"\bempanell?ed\b", r"\bpartner\s+(hospital|organi[sz]ation)\b",
    )
    equipment: tuple[str, ...] = (
        r"ventilator", r"\becmo\b", r"multi[- ]?para(meter)?\s+monitor", r"defibrillator", r"\bbipap\b", r"\bcpap\b", r"infusion\s+pump", r"syringe\s+pump", r"central\s+oxygen", r"oxygen\s+pipeline",
    )
    procedure: tuple[str, ...] = (r"intensive\s+care", r"critical\s+care", r"mechanical\s+ventilation", r"intubation", r"life\s+support", r"resuscitation")
    staffing: tuple[str, ...] = (
        r"intensivist", r"critical\s+care\s+(specialist|physician|team|nurse|nursing)", r"icu\s+(staff|nurse|nursing|team)", r"anaesthesi(a|ologist|ology).{0,30}critical",
    )
    negation: tuple[str, ...] = (
        r"\bno\s+(icu|intensive\s+care|critical\s+care|ventilator)",
        r"\bwithout\s+(an?\s+)?(icu|intensive\s+care|ventilator)",
        r"\blacks?\s+(an?\s+)?(icu|intensive\s+care|ventilator)",
        r"\bicu\s+(is\s+)?not\s+available",
        r"\bdoes\s+not\s+(have|offer|provide)\s+(an?\s+)?(icu|intensive\s+care)",
    )
    subtypes: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "neonatal_icu": (r"\bnicu\b", r"neonatal\s+(intensive|critical)\s+care"),
            "pediatric_icu": (r"\bpicu\b", r"p(?:ae|e)diatric\s+(intensive|critical)\s+care"),
            "cardiac_icu": (r"\biccu\b", r"\bcicu\b", r"cardiac\s+(intensive|critical)\s+care", r"coronary\s+care\s+unit", r"cardiac\s+icu"),
            "medical_icu": (r"\bmicu\b", r"medical\s+(intensive|critical)\s+care", r"medical\s+icu"),
            "surgical_icu": (r"\bsicu\b", r"surgical\s+(intensive|critical)\s+care", r"surgical\s+icu", r"post[- ]?surgical\s+icu", r"post[- ]?operative\s+icu"),
        }
    )
    service_verbs: tuple[str, ...] = (
        r"\b(offer|offers|offered|offering)\b", r"\b(provide|provides|provided|providing)\b", r"\b(operate|operates|operating)\b", r"\b(has|have|having)\b",
        r"\b(include|includes|including)\b", r"\b(maintain|maintains|maintaining)\b", r"\bequipped\s+with\b", r"\b(support|supports|supporting)\b",
        r"\b(feature|features|featuring)\b", r"\b(run|runs|running)\b", r"\b(house|houses|housing)\b",
    )
    unit_statements: tuple[str, ...] = (
        r"\bintensive\s+care\s+unit\b", r"\bcritical\s+care\s+(unit|department|centre|center)\b", r"\bicu\s+(unit|department|ward|wing)\b", r"\bdedicated\s+(icu|nicu|picu|intensive\s+care)\b",
    )
    operational_details: tuple[str, ...] = (
        r"\bventilators?\b", r"\bmechanical\s+ventilation\b", r"\bventilator\s+support\b", r"\b\d{1,4}\s*[- ]?bed", r"\bicu\s+beds?\b", r"\bintensivists?\b",
        r"\bcritical\s+care\s+(staff|nurs\w*|team|physician)\b", r"\bcontinuous\s+monitoring\b", r"\blife\s+support\b", r"\bresuscitation\b", r"\bintubation\b",
    )
    bed_count: tuple[str, ...] = (
        r"(\d{1,4})\s*-?\s*bed(?:ded)?\s+(?:[a-z]*\s+)?icu",
        r"(\d{1,4})\s*-?\s*bed(?:ded)?\s+(?:[a-z]*\s+)?(?:intensive|critical)\s+care",
        r"icu[^.;]{0,30}?(\d{1,4})\s*beds?",
        r"(?:intensive|critical)\s+care[^.;]{0,30}?(\d{1,4})\s*beds?",
        r"(\d{1,4})\s*icu\s*beds?",
    )

    def group(self, name: str) -> tuple[str, ...]:
        return getattr(self, name)


@dataclass(frozen=True)
class EvidenceWeights:
    """Fixed values."""

    explicit_claim: int = 35
    equipment: int = 20
    procedure: int = 15
    capacity: int = 10
    staffing: int = 10
    specialty_context: int = 20
    multi_field_bonus: int = 10
    negation_penalty: int = 40
    suspicious_penalty: int = 15


@dataclass(frozen=True)
class CompletenessWeights:
    """Fixed values."""

    description: int = 20
    procedure: int = 15
    equipment: int = 15
    staffing: int = 10
    capacity: int = 10
    source_url: int = 15
    geography: int = 15


@dataclass(frozen=True)
class Thresholds:
    """Fixed values."""

    sufficient_completeness: int = 45
    high_evidence: int = 45
    low_evidence: int = 15
    min_corroboration_categories: int = 2
    region_min_facilities: int = 3
    region_min_data_pct: float = 40.0
    region_min_trusted: int = 1


@dataclass(frozen=True)
class Policy:
    version: str = "v2"
    keywords: Keywords = field(default_factory=Keywords)
    evidence_weights: EvidenceWeights = field(default_factory=EvidenceWeights)
    completeness_weights: CompletenessWeights = field(default_factory=CompletenessWeights)
    thresholds: Thresholds = field(default_factory=Thresholds)
    sparse_record_min_fields: int = 2
    latitudes: tuple[float, float] = (6.0, 38.0)
    longitudes: tuple[float, float] = (68.0, 98.0)
    input_cost_per_mtok: float = 0.15
    output_cost_per_mtok: float = 0.60

    def fingerprint(self) -> str:
        """Twelve hex digits that change with any value of the policy."""
        return hashlib.sha256(json.dumps(dataclasses.asdict(self), sort_keys=True).encode()).hexdigest()[:12]


def overridden(base, values: dict):
    """A copy of a policy (or part of one) with some values replaced, to any depth."""
    names = {f.name for f in dataclasses.fields(base)}
    if unknown := set(values) - names:
        raise ValueError(f"unknown policy values: {sorted(unknown)}")
    new = {}
    for k, v in values.items():
        old = getattr(base, k)
        if dataclasses.is_dataclass(old):
            v = overridden(old, v)
        elif isinstance(old, tuple):
            v = tuple(v)
        elif isinstance(old, dict):
            v = {name: tuple(x) for name, x in v.items()}
        new[k] = v
    return dataclasses.replace(base, **new)


def load(path: str | None = None) -> Policy:
    """The default policy, with what the JSON file at ``path`` overrides."""
    if path is None:
        return Policy()
    with open(path, encoding="utf-8") as f:
        return overridden(Policy(), json.load(f))
