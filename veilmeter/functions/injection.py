"""Rule findings over one text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EVIDENCE_CHARS, INJECTION_RULES


def findings(text: Column) -> Column:
    """First match of every rule, in rule order, with shortened evidence."""
    hits = []
    for rule, pattern in INJECTION_RULES:
        evidence = F.regexp_substr(text, F.lit(pattern))
        hits.append(
            F.when(
                evidence.isNotNull(),
                F.struct(
                    F.lit(rule).alias("rule"),
                    F.substring(evidence, 1, EVIDENCE_CHARS).alias("evidence"),
                ),
            )
        )
    return F.array_compact(F.array(*hits))


def rules(text: Column) -> Column:
    """Names of the rules that match."""
    return F.array_compact(
        F.array(*[F.when(F.rlike(text, F.lit(p)), F.lit(rule)) for rule, p in INJECTION_RULES])
    )
