"""User-defined signals: a function from tables to one signal per document, held to the signal contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay.operators.decision import invalid_signals

SIGNAL = {"doc_id": None, "name": "string", "status": "string", "suspicion": "double", "weight": "double"}

Detector = Callable[[dict[str, DataFrame]], DataFrame]
_DETECTORS: dict[str, Detector] = {}


def detector(name: str):
    """Register a detector; it returns doc_id, status, suspicion, weight (column expressions first, else pandas)."""
    def wrap(fn: Detector) -> Detector:
        _DETECTORS[name] = fn
        return fn

    return wrap


def run_detector(name: str, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(accepted signals, rejected signals with their fault)."""
    out = _DETECTORS[name](tables)
    lacking = {"doc_id", "status", "suspicion", "weight"} - set(out.columns)
    if lacking:
        raise ValueError(f"detector {name} lacks columns {sorted(lacking)}")
    s = out.select("doc_id", F.lit(name).alias("name"), F.col("status").cast("string").alias("status"),
                   F.col("suspicion").cast("double").alias("suspicion"), F.col("weight").cast("double").alias("weight"))
    bad = invalid_signals(s)
    good = s.filter(
        ((F.col("status") == "VALID") & F.coalesce(F.col("suspicion").between(0.0, 1.0), F.lit(False)))
        | (F.col("status").isin("NOT_EVALUATED", "ERROR") & F.col("suspicion").isNull()))
    return good, bad
