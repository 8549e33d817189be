"""The rulebook as JSON files and as dimension tables. A rulebook with a missing or empty section is refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docassay.rulebook import AREA_FACTORS, CRITICAL_TYPES, FIELD_TYPES, RULES, SEVERITY_BANDS, TIME_FACTORS

#: Sections and their columns; a section is one file of JSON lines.
SECTIONS = {
    "rules": "rule_id string, domain string, severity string, doc_types array<string>",
    "severity_bands": "severity string, suspicion double",
    "value_types": "predicate string, type string, critical boolean",
    "unit_factors": "dimension string, unit string, factor double",
}


def write_rulebook(spark: SparkSession, path: str) -> None:
    """Write the built-in rulebook as files that can be edited."""
    rows = {
        "rules": list(RULES),
        "severity_bands": list(SEVERITY_BANDS.items()),
        "value_types": [(p, t, t in CRITICAL_TYPES) for p, t in FIELD_TYPES.items()],
        "unit_factors": [(d, u, None if f is None else float(f)) for d, units in (("area", AREA_FACTORS), ("time", TIME_FACTORS)) for u, f in units.items()],
    }
    for name, columns in SECTIONS.items():
        spark.createDataFrame(rows[name], columns).coalesce(1).write.json(f"{path}/{name}")  # a few dozen rows


def load_rulebook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sections as tables. Raises if one is missing, empty, or holds a row without its first column."""
    out = {}
    for name, columns in SECTIONS.items():
        try:
            df = spark.read.schema(columns).option("mode", "FAILFAST").json(f"{path}/{name}")
            rows = df.collect()  # a rulebook is small by nature
        except Exception as fault:
            raise ValueError(f"rulebook section {name} cannot be read") from fault
        if not rows or any(r[0] is None for r in rows):
            raise ValueError(f"rulebook section {name} is empty or incomplete")
        out[name] = df
    return out
