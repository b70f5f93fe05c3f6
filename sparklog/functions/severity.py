from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklog.schema import SEVERITY_FLOORS, UNSPECIFIED

_DESCENDING = sorted(SEVERITY_FLOORS.items(), key=lambda item: -item[1])

# Accepted spellings: all upper or all lower case, and WARNING for WARN.
_SPELLINGS = {label: [label, label.lower()] for label in SEVERITY_FLOORS}
_SPELLINGS["WARN"] += ["WARNING", "warning"]

# OTLP enum names: each floor name stands for itself, suffixes 2-4 for the next values.
OTLP_ENUM = {"SEVERITY_NUMBER_UNSPECIFIED": 0} | {
    f"SEVERITY_NUMBER_{label}{'' if step == 0 else step + 1}": floor + step
    for label, floor in SEVERITY_FLOORS.items()
    for step in range(4)
}


def severity_label(severity: Column) -> Column:
    """Number to label; above 24 is FATAL, zero and below UNSPECIFIED."""
    (first, floor), *rest = _DESCENDING
    start = F.when(severity >= floor, first)
    return reduce(lambda c, item: c.when(severity >= item[1], item[0]), rest, start).otherwise(UNSPECIFIED)


def severity_from_label(label: Column) -> Column:
    """Label to the floor of its range; unknown spellings give 0."""
    chain = F
    for name, spellings in _SPELLINGS.items():
        chain = chain.when(label.isin(spellings), SEVERITY_FLOORS[name])
    return chain.otherwise(0).cast("int")


def read_severity(text: Column) -> Column:
    """A label or a number written as text; a fraction or an out-of-range number gives NULL."""
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int")).when(
        ~text.rlike(r"^[+-]?[\d.]"), severity_from_label(text)
    )


def otlp_severity(text: Column) -> Column:
    """severityNumber as OTLP JSON writes it: a number or an enum name. NULL if neither."""
    names = F.create_map(*[F.lit(x) for pair in OTLP_ENUM.items() for x in pair])
    return F.coalesce(text.try_cast("int"), F.try_element_at(names, text))


def severity_value(value: int | str | None) -> int:
    """A query argument (label, number or numeric text) as a number. 0 means no filter."""
    if value is None or value == "":
        return 0
    for name, spellings in _SPELLINGS.items():
        if value in spellings:
            return SEVERITY_FLOORS[name]
    try:
        number = int(value)
    except (TypeError, ValueError):
        raise ValueError(f"severity: {value!r} is not a known label or integer") from None
    if not -(2**31) <= number < 2**31:
        raise ValueError(f"severity: {number} does not fit 32 bits")
    return number
