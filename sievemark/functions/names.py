"""What an organisation's name says about its kind: for audits and for review order only, never for
classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemark.functions.text import stripped
from sievemark.policy import CLASS_LABELS, SUBTYPE_LABELS

# Rules in order, the first match counts.
CATEGORY_RULES = (
    ("pharmacy", r"\b(pharmacy|pharmacies|chemist|medical store|drug\s?store|druggist)\b"),
    ("dentist", r"\b(dental|dentist|dentistry|orthodontic|orthodontist)\b"),
    ("hospital_like", r"\b(hospitals?|nursing home|medical college|institute of medical|multi\s?special(i?ty|ities)|super\s?special(i?ty|ities)|sanatorium)\b"),
    ("diagnostics_or_lab", r"\b(diagnostics?|labs?|laborator(y|ies)|pathology|patholab|scans?|scanning|imaging|x-?rays?|radiology|mri|sonography|ultrasound)\b"),
    ("clinic_or_health_center", r"\b(clinics?|polyclinics?|dispensar(y|ies)|health cent(er|re)s?|primary health|community health|phc|chc)\b"),
)
# Fixed value.
DOCTOR = r"^\s*(dr\.?|doctor)\s+"
CATEGORIES = ("hospital_like", "clinic_or_health_center", "pharmacy", "dentist", "individual_doctor", "diagnostics_or_lab", "unknown")
NOT_HOSPITALS = ("pharmacy", "dentist", "individual_doctor", "diagnostics_or_lab")

GENERAL = "Likely general-hospital context"
SPECIALTY = "Specialty or limited-scope hospital context"
OUTPATIENT = "Outpatient / diagnostic context"
UNKNOWN = "Unknown context"
CONTEXTS = (GENERAL, SPECIALTY, OUTPATIENT, UNKNOWN)
CONTEXT_RANK = {GENERAL: 0, SPECIALTY: 1, UNKNOWN: 2, OUTPATIENT: 3}
# Words that tell a context.
HOSPITAL_WORD = r"\b(hospitals?|nursing home|medical college|institute of medical|sanatorium)\b"
SPECIALTY_MARKERS = (
    r"\b(eye|ent|opthal|ophthal|dental|tooth|skin|hair|cosmet|kidney|stone|urolog|ortho|maternity|children|child|p(?:ae|e)diatric|cancer|onco|cardiac|heart|mental|"
    r"psychiatr|ayurved|homoeo|homeo|fertility|ivf|gyn(?:ae|e)c?|obstetric|piles|pulmo|chest|liver|gastro|neuro|spine|joint|knee)\b"
)
OUTPATIENT_MARKERS = (
    r"\b(dental|dentist|dentistry|tooth|pharmacy|pharmacies|chemist|medical store|drug\s?store|path\s?labs?|pathology|patholab|diagnostics?|laborator(y|ies)|labs?|"
    r"scans?|scanning|imaging|x-?rays?|radiology|mri|sonography|ultrasound|physiotherapy|physio)\b"
)
CLINIC_WORD = r"\b(clinics?|polyclinics?|dispensar(y|ies)|care cent(er|re)s?)\b"


def _has(text: Column, pattern: str) -> Column:
    return text.rlike("(?iU)" + pattern)


def _spoken(name: Column, kind: Column) -> Column:
    """Name and organisation type in one; the word "facility" says nothing."""
    both = F.concat_ws(" ", F.nullif(stripped(name), F.lit("")), F.nullif(stripped(kind), F.lit("")))
    return F.regexp_replace(both, r"(?iU)\bfacility\b", " ")


def audit_category(name: Column, kind: Column) -> Column:
    text = _spoken(name, kind)
    out = F.when(stripped(text) == "", "unknown")
    for category, pattern in CATEGORY_RULES:
        out = out.when(_has(text, pattern), category)
    return out.when(_has(text, DOCTOR), "individual_doctor").otherwise("unknown")


def context(name: Column, kind: Column) -> Column:
    text = stripped(_spoken(name, kind))
    hospital = _has(text, HOSPITAL_WORD)
    outpatient = _has(text, OUTPATIENT_MARKERS) | _has(text, CLINIC_WORD) | _has(text, DOCTOR)
    return F.when(text == "", UNKNOWN).when(~hospital & outpatient, OUTPATIENT).when(~hospital, UNKNOWN).when(_has(text, SPECIALTY_MARKERS), SPECIALTY).otherwise(GENERAL)


def looked_up(c: Column, table: dict, default: Column | None = None) -> Column:
    """A short dictionary as a literal map; what it lacks gives ``default``, or null."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), c)
    return found if default is None else F.coalesce(found, default)


def context_rank(c: Column) -> Column:
    return looked_up(c, CONTEXT_RANK)


def class_label(c: Column) -> Column:
    return looked_up(c, CLASS_LABELS, c)


def subtype_label(c: Column) -> Column:
    return looked_up(c, SUBTYPE_LABELS, c)


def region_label(state: Column, district: Column) -> Column:
    return F.when(state.isNull(), "All").otherwise(F.concat_ws(" / ", state, district))


def scope_key(state: Column, district: Column) -> Column:
    return F.concat_ws("/", state, district)
