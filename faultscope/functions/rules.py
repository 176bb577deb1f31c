"""Rule sets: device type, criticality, recommendation, maintenance interval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.functions.text import OUTER_SPACE, ensure_str

# Device patterns and their type names, in rule order.
DEVICE_RULES = [
    ("mri|magnetic resonance", "IRM"),
    ("ct|scanner|computed tomography", "Scanner"),
    ("x[- ]?ray|radiograph|radiology", "Radiologie"),
    ("ultrasound|echograph|sonograph", "Échographe"),
    ("ventilator|respirator", "Ventilateur"),
    ("anesthesia|anaesthesia", "Anesthésie"),
    ("infusion|pump", "Pompe à perfusion"),
    ("defibrillator|aed", "Défibrillateur"),
    ("pacemaker", "Pacemaker"),
    ("dialysis|hemodialysis", "Dialyse"),
    ("endoscope|endoscopy", "Endoscope"),
    ("monitor|ecg|ekg|spo2|oximeter", "Moniteur patient"),
]
OTHER_TYPE = "Autre"

# Word groups that make a cleaned text critical.
CRITICAL_PATTERNS = [
    r"fire|smoke|burn|shock|overheat|short\s?circuit|injur(y|ies)|death|serious",
    r"failure|shutdown|stopp?ed|crash|alarm",
    r"hazard|risk|exposure",
    r"incendie|fumée|brûl\w+|choc|surchauffe|court\s?circuit|blessure|décès|grave",
    r"panne|arr[êe]t|stop|crash|alarme",
    r"danger|risque|exposition",
]
# The accented words above cannot occur in a cleaned text; these are their folded forms.
FOLDED_EXTRAS = [r"fumee|brul\w+|deces"]

# Words of the fallback label, and event types that count as critical.
FALLBACK_WORDS = "death|injur|hemorrhag|cardiac|respiratory|severe"
CRITICAL_EVENT_TYPES = ["death", "injury"]

# Advice by alert prefix.
ALERT_ADVICE = [
    ("Critique", "⚠️ Maintenance immédiate requise"),
    ("Modérée", "🔍 Surveillance accrue"),
]
DEFAULT_ADVICE = "✅ Fonctionnement normal"

# Maintenance interval in operating hours by equipment type.
MAINTENANCE_HOURS = {
    "Défibrillateur": 1000,
    "Ventilateur": 800,
    "Pompe à perfusion": 600,
    "Scanner": 1500,
    "IRM": 2000,
    "Autoclave": 1200,
    "Moniteur patient": 1000,
    "Rayons X": 1200,
    "Incubateur néonatal": 1000,
    "Machine de dialyse": 1000,
    "Bistouri électrique": 1000,
    "Aspirateur chirurgical": 500,
    "Échographe": 1200,
    "Pousse-seringue": 600,
}
DEFAULT_HOURS = 1000


def _bounded(pattern: str) -> str:
    return rf"(?U)\b({pattern})\b"


def device_type(text: Column, policy: str = "first", rules: list[tuple[str, str]] = DEVICE_RULES) -> Column:
    """Device type by word-bounded rules on the lower-cased text, null when none matches.

    ``policy`` says which rule wins when several match: a single text takes the first, a table
    the last. One alternation over all rules rejects most texts before the rules are tried."""
    if policy not in ("first", "last"):
        raise ValueError(f"policy must be 'first' or 'last', not {policy!r}")
    lowered = F.lower(ensure_str(text))
    ordered = rules if policy == "first" else rules[::-1]
    picked = F.coalesce(*[F.when(lowered.rlike(_bounded(p)), F.lit(name)) for p, name in ordered])
    any_rule = _bounded("|".join(p for p, _ in rules))
    return F.when(lowered.rlike(any_rule), picked)


def add_detected_type(df: DataFrame, text_col: str) -> DataFrame:
    """``TypeDetecte`` from generic name, brand name and text; the last matching rule wins."""
    names = [ensure_str(F.col(c)) if c in df.columns else F.lit("") for c in ("generic_name", "brand_name")]
    everything = F.concat_ws(" ", *names, ensure_str(F.col(text_col)))
    return df.withColumn("TypeDetecte", F.coalesce(device_type(everything, "last"), F.lit(OTHER_TYPE)))


def critical_by_words(cleaned: Column, folded: bool = False) -> Column:
    """1 when a cleaned text holds a critical word. ``folded`` adds the unaccented French words."""
    groups = CRITICAL_PATTERNS + (FOLDED_EXTRAS if folded else [])
    return F.coalesce(cleaned.rlike(_bounded("|".join(groups))), F.lit(False)).cast("int")


def critical_by_event_type(event_type: Column, critical: list[str] = CRITICAL_EVENT_TYPES, trim: bool = True) -> Column:
    """1 when the event type is in the critical set, ignoring case and outer white space; null counts as 0."""
    name = F.lower(F.regexp_replace(event_type, OUTER_SPACE, "") if trim else event_type)
    return F.coalesce(name.isin(critical), F.lit(False)).cast("int")


def critical_by_fallback(text: Column) -> Column:
    """Label for tables without an event type, from the lower-cased raw text."""
    return F.coalesce(F.lower(text).rlike(_bounded(FALLBACK_WORDS)), F.lit(False)).cast("int")


def recommendation(alert: Column, rules: list[tuple[str, str]] = ALERT_ADVICE) -> Column:
    level = ensure_str(alert)
    return reduce(
        lambda chain, rule: chain.when(level.startswith(rule[0]), rule[1]),
        rules[1:],
        F.when(level.startswith(rules[0][0]), rules[0][1]),
    ).otherwise(DEFAULT_ADVICE)


def maintenance_hours(equipment: Column, table: dict[str, int] = MAINTENANCE_HOURS) -> Column:
    """Interval by equipment type from a literal map, with a default."""
    entries = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.create_map(*entries)[equipment], F.lit(DEFAULT_HOURS))
