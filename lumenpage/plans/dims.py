"""Small fixed tables: criteria, the separate mapping of rules to criteria, guides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenpage.operators.rules import RULES, Rule

# Success criteria (id, name, level).
CRITERIA = (
    ("1.1.1", "Non-text Content", "A"),
    ("1.2.1", "Audio-only and Video-only (Prerecorded)", "A"),
    ("1.2.2", "Captions (Prerecorded)", "A"),
    ("1.2.3", "Audio Description or Media Alternative (Prerecorded)", "A"),
    ("1.3.1", "Info and Relationships", "A"),
    ("1.3.2", "Meaningful Sequence", "A"),
    ("1.3.3", "Sensory Characteristics", "A"),
    ("1.4.1", "Use of Color", "A"),
    ("1.4.2", "Audio Control", "A"),
    ("2.1.1", "Keyboard", "A"),
    ("2.1.2", "No Keyboard Trap", "A"),
    ("2.2.1", "Timing Adjustable", "A"),
    ("2.2.2", "Pause, Stop, Hide", "A"),
    ("2.3.1", "Three Flashes or Below Threshold", "A"),
    ("2.4.1", "Bypass Blocks", "A"),
    ("2.4.2", "Page Titled", "A"),
    ("2.4.3", "Focus Order", "A"),
    ("2.4.4", "Link Purpose (In Context)", "A"),
    ("2.5.1", "Pointer Gestures", "A"),
    ("2.5.2", "Pointer Cancellation", "A"),
    ("2.5.3", "Label in Name", "A"),
    ("2.5.4", "Motion Actuation", "A"),
    ("3.1.1", "Language of Page", "A"),
    ("3.2.1", "On Focus", "A"),
    ("3.2.2", "On Input", "A"),
    ("3.3.1", "Error Identification", "A"),
    ("3.3.2", "Labels or Instructions", "A"),
    ("4.1.1", "Parsing", "A"),
    ("4.1.2", "Name, Role, Value", "A"),
    ("4.1.3", "Status Messages", "A"),
    ("1.2.4", "Captions (Live)", "AA"),
    ("1.2.5", "Audio Description (Prerecorded)", "AA"),
    ("1.4.3", "Contrast (Minimum)", "AA"),
    ("1.4.4", "Resize Text", "AA"),
    ("1.4.5", "Images of Text", "AA"),
    ("1.4.10", "Reflow", "AA"),
    ("1.4.11", "Non-text Contrast", "AA"),
    ("1.4.12", "Text Spacing", "AA"),
    ("1.4.13", "Content on Hover or Focus", "AA"),
    ("2.4.5", "Multiple Ways", "AA"),
    ("2.4.6", "Headings and Labels", "AA"),
    ("2.4.7", "Focus Visible", "AA"),
    ("2.5.5", "Target Size (Enhanced)", "AAA"),
    ("2.5.6", "Concurrent Input Mechanisms", "AAA"),
    ("2.4.11", "Focus Not Obscured (Minimum)", "AA"),
    ("2.4.12", "Focus Not Obscured (Enhanced)", "AAA"),
    ("2.4.13", "Focus Appearance", "AAA"),
    ("2.5.7", "Dragging Movements", "AA"),
    ("2.5.8", "Target Size (Minimum)", "AA"),
    ("3.2.6", "Consistent Help", "A"),
    ("3.3.7", "Redundant Entry", "A"),
    ("3.3.8", "Accessible Authentication (Minimum)", "AA"),
    ("3.3.9", "Accessible Authentication (Enhanced)", "AAA"),
)
# The published mapping of rules to criteria, where it differs from the rules' own or has further rules.
MAPPING_OTHER = {
    "LNK007": "1.3.1", "LNK008": "1.3.1", "LNK009": "1.3.1", "STR002": "1.3.1", "STR003": "1.4.3", "FORM009": "1.3.1", "PDF001": "1.3.1", "EVT002": "3.2.2",
    "FORM004": "1.3.1", "FORM006": "1.3.1", "LANG001": "3.1.1", "NAV001": "2.4.1", "NAV002": "2.2.1", "PAGE001": "2.4.2", "IMG007": "1.1.1",
}
UNMAPPED = ("IMG009", "LNK011", "LNK012", "DID001", "ARIA002", "ARIA003", "ARIA004")


def criteria_rows(levels: tuple[str, ...] = ("A", "AA")) -> list[tuple[str, str, str]]:
    return [r for r in CRITERIA if r[2] in levels]


def criteria(spark: SparkSession, levels: tuple[str, ...] = ("A", "AA")) -> DataFrame:
    return spark.createDataFrame(criteria_rows(levels), "criterion_id string, name string, level string")


def rule_mapping() -> dict[str, str]:
    return {r.rule_id: r.wcag for r in RULES if r.rule_id not in UNMAPPED} | MAPPING_OTHER


def rules(spark: SparkSession, more: tuple[Rule, ...] = ()) -> DataFrame:
    """The rules in order, and after them those of a user's own."""
    rows = [(r.rule_id, k, r.severity, r.category, r.wcag, r.auto_fix, r.fix) for k, r in enumerate([*RULES, *more])]
    return spark.createDataFrame(rows, "rule_id string, rule_ord int, severity string, category string, wcag_criterion string, can_auto_fix boolean, fix_description string")


def guides(spark: SparkSession) -> DataFrame:
    """A guide for each rule: what it is about, and the steps to repair it."""
    rows = []
    for r in RULES:
        steps = ["Open the page and find the reported element."] + ([f"{r.fix}."] if r.fix else []) + ["Scan the page again and check that the finding is gone."]
        rows.append((r.rule_id, r.category, r.wcag, r.severity, steps, r.auto_fix))
    return spark.createDataFrame(rows, "rule_id string, category string, wcag string, severity string, steps array<string>, auto_fixable boolean")
