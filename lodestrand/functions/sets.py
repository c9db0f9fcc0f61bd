"""Set algebra on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RELATIONS = ("uses", "used_by", "related", "supersedes")


def _col(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>"))


def sorted_unique(a: Column | str) -> Column:
    return F.sort_array(F.array_distinct(_col(a)))


def three_way_merge(shadow: Column | str, current: Column | str, wanted: Column | str) -> Column:
    """wanted, plus what was added to current since shadow, minus what was removed from it; sorted."""
    s, c, a = _col(shadow), _col(current), _col(wanted)
    return F.sort_array(F.array_except(F.array_union(a, F.array_except(c, s)), F.array_except(s, c)))


def three_way_merge_relations(shadow: Column, current: Column, wanted: Column) -> Column:
    return F.struct(*[three_way_merge(shadow[r], current[r], wanted[r]).alias(r) for r in RELATIONS])


def strip_keys(entries: Column | str, owned: tuple[str, ...]) -> Column:
    """Entries (k, v) whose key isn't owned, in their order."""
    return F.filter(entries, lambda e: ~e.k.isin(*owned))
