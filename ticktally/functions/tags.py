"""Tags are ordered arrays of (name, value); a name may occur more than once.

No lambdas: the names of an array of structs, positions and removals all stay in generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_tag(tags: Column, name: str) -> Column:
    """Value of the first tag with the name; null if there is none.  An empty value is a value."""
    return F.get(tags["value"], (F.array_position(tags["name"], name) - 1).cast("int"))


def has_tag(tags: Column, name: str) -> Column:
    return F.array_contains(tags["name"], name)


def every_tag_is(tags: Column, name: str, value: str) -> Column:
    """The tag is there and all its occurrences have the value."""
    others = F.array_remove(tags, F.struct(F.lit(name).alias("name"), F.lit(value).alias("value")))
    return has_tag(tags, name) & ~F.array_contains(others["name"], name)


def all_of(names: Column, needed: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in needed:
        out = out & F.array_contains(names, n)
    return out
