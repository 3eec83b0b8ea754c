"""Evidence pages: seventeen optional filters over one frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Filters that ask for a value of a column of the same name, or one of a list.
EQUAL = ("country", "source_id", "layer", "entity_type", "entity_id", "provider_id", "job_id", "evidence_type", "mime", "job_status", "status", "extraction_state")
#: Days after which evidence that was verified is ageing, and stale.
AGEING, STALE = 14, 30


def freshness(verified: Column, today: Column) -> Column:
    """fresh, ageing or stale by the days since the check; unverified without one."""
    days = F.date_diff(today, verified)
    return F.when(verified.isNull(), "unverified").when(days > STALE, "stale").when(days > AGEING, "ageing").otherwise("fresh")


def filtered(rows: DataFrame, *, today: str | None = None, query: str | None = None, hash: str | None = None, freshness: str | None = None, verified_from: str | None = None, verified_to: str | None = None, unresolved_conflicts: bool | None = None, **equal) -> DataFrame:
    """The rows that fit every filter that is given; null and empty ones are left out of the plan.

    ``query`` looks for a text in hash, source and entity; ``hash`` is a prefix;
    ``verified_from`` and ``verified_to`` are days, both included. A filter by another name is an error.
    """
    unknown = set(equal) - set(EQUAL)
    if unknown:
        raise ValueError(f"no such filter: {', '.join(sorted(unknown))}")
    day = lambda d: F.lit(d).cast("date")
    now = day(today) if today else F.current_date()
    parts = [F.col(c).isin(v) if isinstance(v, list) else F.col(c) == v for c, v in equal.items() if v not in (None, "", [])]
    if query:
        fields = [c for c in ("hash", "source_id", "entity_id", "evidence_type") if c in rows.columns]
        parts.append(reduce(Column.__or__, [F.contains(F.lower(c), F.lit(query.lower())) for c in fields]))
    if hash:
        parts.append(F.col("hash").startswith(hash.lower()))
    if freshness:
        parts.append(_freshness(F.col("verified_at"), now) == freshness)
    if verified_from:
        parts.append(F.col("verified_at") >= day(verified_from))
    if verified_to:
        parts.append(F.col("verified_at") <= day(verified_to))
    if unresolved_conflicts is not None:
        parts.append(F.col("unresolved_conflicts") == unresolved_conflicts)
    return rows.where(reduce(Column.__and__, parts)) if parts else rows


_freshness = freshness
