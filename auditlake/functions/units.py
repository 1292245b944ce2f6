"""Units of measurement."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of one unit (fixed values).
SAME = {"cm3": "ml", "cc": "ml", "milliliter": "ml", "millilitre": "ml", "milliliters": "ml", "millilitres": "ml", "years": "yr", "year": "yr", "yrs": "yr", "y": "yr"}
#: What simple units measure (fixed values).
KINDS = {
    "length": ["mm", "cm", "m", "um", "µm", "nm"], "volume": ["ml", "l", "dl"], "mass": ["kg", "g", "mg", "ug", "µg"],
    "time": ["yr", "mo", "month", "months", "wk", "week", "weeks", "day", "days", "d", "h", "hr", "min", "s", "sec"],
    "percent": ["%", "percent"], "count": ["n", "count"], "pressure": ["mmhg"], "rate": ["bpm"],
}


def _lookup(entries: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(entries.items())))


def normal_unit(unit: Column) -> Column:
    """Lower case without spaces, superscripts as digits, each part of a quotient by its common spelling; empty for a missing one."""
    text = F.translate(F.lower(F.trim(F.coalesce(unit, F.lit("")))), "²³^· ", "23")
    same = _lookup(SAME)
    return F.array_join(F.transform(F.split(text, "/"), lambda part: F.coalesce(F.try_element_at(same, part), part)), "/")


def units_differ(a: Column, b: Column) -> Column:
    """Both are stated and differ."""
    a, b = normal_unit(a), normal_unit(b)
    return (a != "") & (b != "") & (a != b)


def unit_kind(unit: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup({u: kind for kind, units in KINDS.items() for u in units}), normal_unit(unit)), F.lit("unknown"))
