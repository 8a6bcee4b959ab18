"""Entity ids: ``Q`` and digits, in any case, with or without outer spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entity_number(c: Column | str) -> Column:
    """The digits of an entity id as bigint; null for null, blank, ``*`` and anything that is no id (also beyond 64 bits)."""
    c = F.col(c) if isinstance(c, str) else c
    digits = F.regexp_extract(c, r"^\s*[Qq](\d+)\s*$", 1)
    return F.when(digits != "", digits).try_cast("bigint")


def entity_numbers(c: Column | str) -> Column:
    """An array of entity ids as the array of their numbers, entries that are no ids left out; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.transform(c, entity_number), lambda x: x.isNotNull())
