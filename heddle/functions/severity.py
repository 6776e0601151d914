"""Ordinals, weights and label maps of severities and categories, stated as data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The levels from mildest to gravest, and what each model gives them.
LEVELS = ("nitpick", "low", "medium", "high", "critical")
PRIORITY = {"critical": 10, "high": 8, "medium": 5, "low": 2, "nitpick": 1}
SAFETY = {"critical": 25, "high": 10, "medium": 5, "low": 2, "nitpick": 1}
REPORT = {"critical": 10.0, "high": 5.0, "medium": 2.0, "low": 1.0, "nitpick": 0.5}
SARIF = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "nitpick": "note"}
CATEGORY_WEIGHT = {"security": 1.5, "bug": 1.3, "compliance": 1.2, "performance": 1.1, "architecture": 1.0, "style": 0.8}
DIMENSION = {"security": "security", "bug": "reliability", "compliance": "reliability", "architecture": "complexity", "style": "hygiene", "performance": "hygiene"}


def lookup(table: dict, c: Column, default=None) -> Column:
    """table[c] as a literal map; `default` where the key is missing."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(m, c)
    return found if default is None else F.coalesce(found, F.lit(default))


def ordinal(severity: Column) -> Column:
    """0 for nitpick up to 4 for critical; null for an unknown level."""
    return lookup({s: i for i, s in enumerate(LEVELS)}, severity)


def level(n: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in LEVELS]), n.cast("int"))


def shift(severity: Column, by: Column) -> Column:
    """Moves up or down the ladder within its ends; an unknown level stays."""
    at = ordinal(severity)
    return F.when(at.isNull(), severity).otherwise(level(F.least(F.greatest(at + by, F.lit(0)), F.lit(len(LEVELS) - 1))))
