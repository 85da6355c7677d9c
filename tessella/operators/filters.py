"""Composable document filters, compiled to one predicate."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """All given conditions must hold. Empty lists and strings are no condition; rows with a null tested value fail.

    ``legal_domain`` is matched anywhere, without case but with accents; % and _ in it are wildcards.
    """

    court: tuple[str, ...] = ()
    legal_domain: str | None = None
    is_auj: bool | None = None
    date_from: datetime.date | None = None
    date_to: datetime.date | None = None
    decision_type: tuple[str, ...] = ()
    extraction_confidence: tuple[str, ...] = ()

    def predicate(self) -> Column:
        tests = [F.lit(True)]
        if self.court:
            tests.append(F.col("court_short").isin(*self.court))
        if self.legal_domain:
            tests.append(F.col("legal_domain").ilike(f"%{self.legal_domain}%"))
        if self.is_auj is not None:
            tests.append(F.col("is_auj") == F.lit(self.is_auj))
        if self.date_from is not None:
            tests.append(F.col("decision_date") >= F.lit(self.date_from))
        if self.date_to is not None:
            tests.append(F.col("decision_date") <= F.lit(self.date_to))
        if self.decision_type:
            tests.append(F.col("decision_type").isin(*self.decision_type))
        if self.extraction_confidence:
            tests.append(F.col("extraction_confidence").isin(*self.extraction_confidence))
        out = tests[0] if len(tests) == 1 else tests[1]
        for t in tests[2:]:
            out = out & t
        return out


def has_key(metadata: Column, key: str) -> Column:
    """Whether a JSON object has a key, also where its value is JSON null."""
    return F.coalesce(F.array_contains(F.json_object_keys(metadata), key), F.lit(False))
